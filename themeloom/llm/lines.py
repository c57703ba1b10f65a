"""Fuzzy duplicate lines: pigeonhole pieces, min-hash bands, SimHash, edit similarity, connected groups.

Two lines are linked if their edit similarity is at least 0.8 on the normalised line
(lower case, single spaces). Lines of up to EXACT characters meet under every
piece that the pigeonhole principle leaves unedited, so none of their pairs is
missed. Longer lines share one of the band keys of their character n-grams and
have SimHashes within RADIUS bits (the README gives the recall). Of each
connected group the first occurrence stays.

Few lines have a partner. So keys are first sent packed, 6 bytes each, to learn
which of them belong to several lines; only lines with such keys become rows, with
these keys alone, known by a hash of 128 bits and their place. Text is fetched for
lines that have a candidate. An eighth of the keys links most near copies; the
others only compare lines that are not connected by then, so a pair of close copies
is not verified once per key. The runs of documents are told which lines go; texts
of documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm import edits, minhash, simhash
from themeloom.llm.components import components
from themeloom.llm.runs import bucketed, pack, row_arrays
from themeloom.plans.lineage import cut

RADIUS = 24
EXACT = 19
SHORT, SHORT_GRAM, LONG_GRAM = 150, 4, 6
SAMPLED = np.uint64(3)  # of long lines the grams whose hash has these bits clear
BANDS = 24
FIRST = 8  # one of so many keys is compared before the others
TILE = 2048
PART_BYTES = 1 << 19  # what is hashed at once stays in the cache
KEY_PART_BYTES = 1 << 25  # of text, whose keys meet in one task
POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def similar(a: str, b: str) -> bool:
    """Edit distance at most a fifth of the longer line."""
    most = max(len(a), len(b)) // 5
    if abs(len(a) - len(b)) > most:
        return False
    start, end = 0, 0
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) + len(b) > LONG:
        # Long near copies often differ in few places: follow the diagonals first.
        found = few_edits(a, b, min(most, 4 + len(a) // FEW))
        if found is not None:
            return found <= most
        if begins_apart(a, b, most):
            return False
    return edit_distance(a, b) <= most


LONG, FEW = 300, 200


def few_edits(a: str, b: str, limit: int) -> int | None:
    """Levenshtein distance if it is at most ``limit``: the furthest ends of each diagonal."""

    def slide(x: int, y: int) -> int:
        step = 16
        while a[x : x + step] == b[y : y + step]:
            x, y = x + step, y + step
            if x >= len(a) or y >= len(b):
                return min(x, len(a), x + len(b) - y)
            step *= 2
        while x < len(a) and y < len(b) and a[x] == b[y]:
            if a[x : x + step // 2] == b[y : y + step // 2] and step > 1:
                x, y = x + step // 2, y + step // 2
            step = max(step // 2, 1)
        return min(x, len(a), x + len(b) - y)

    goal = len(b) - len(a)
    ends = {0: slide(0, 0)}
    for edits in range(limit + 1):
        if ends.get(goal, -1) >= len(a):
            return edits
        nearer = {}
        for k in range(-edits - 1, edits + 2):
            x = max(ends.get(k, -2) + 1, ends.get(k - 1, -2), ends.get(k + 1, -2) + 1)
            if x >= 0 and x + k >= 0:
                x = min(x, len(a), len(b) - k)
                if x >= 0 and x + k >= 0:
                    nearer[k] = slide(x, x + k)
        ends = nearer
    return None


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors, a bit per character of ``a`` (Myers 1999, Hyyro 2001)."""
    if not a or not b:
        return len(a) + len(b)
    return [len(a), *_scores(a, b)][-1]


def begins_apart(a: str, b: str, most: int) -> bool:
    """Whether the first two fifths of ``a`` alone need more than ``most`` edits."""
    begun = 2 * len(a) // 5
    if not begun:
        return False
    rest = len(a) - begun
    least = begun + abs(rest - len(b))
    for j, score in enumerate(_scores(a[:begun], b[: begun + most]), 1):
        least = min(least, score + abs(rest - (len(b) - j)))
    return least > most


def _scores(a: str, b: str) -> Iterator[int]:
    """The distance of ``a`` (not empty) and each beginning of ``b``."""
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up, right_down = down | ~(diagonal | up) & full, diagonal & up
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up, down = right_down | ~(diagonal | right_up) & full, diagonal & right_up
        yield score


def gram_hashes(lines: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` bytes from each byte of the (non-empty) lines, and where each line starts.

    A line ends in a margin of line feeds, so it has as many n-grams as bytes.
    """
    data = np.frombuffer(b"".join(x + b"\n" * (n - 1) for x in lines), np.uint8)
    size = len(data) - n + 1
    values = np.zeros(size, np.uint64)
    for i in range(n):
        values += (data[i : i + size].astype(np.uint64) + np.uint64(1)) * POWERS[i]
    sizes = np.array([len(x) for x in lines])
    return _mixed(values[data[:size] != 10]), np.cumsum(sizes) - sizes


def word_simhashes(lines: list[bytes]) -> np.ndarray:
    """Majority bits of the hashes of the character n-grams of each (normalised, non-empty) line."""
    hashes, first = gram_hashes(lines, SHORT_GRAM)
    sizes = np.diff(np.append(first, len(hashes)))
    # Eight counts of a byte each are added as one number, 255 n-grams at most.
    pieces = -(-sizes // 255)
    piece = np.cumsum(pieces) - pieces
    starts = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(piece, pieces))
    partial = np.empty((len(starts), 64), np.uint8)
    for s in range(0, len(starts), 1024):
        some = starts[s : s + 1024]
        end = starts[s + 1024] if s + 1024 < len(starts) else len(hashes)
        bits = np.unpackbits(hashes[some[0] : end].astype(">u8").view(np.uint8)).reshape(-1, 64)
        partial[s : s + 1024] = np.add.reduceat(bits.view(np.uint64), some - some[0], axis=0).view(np.uint8)
    counts = np.add.reduceat(partial, piece, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def pieces(line: str) -> set[tuple[int, int, str]]:
    """What a line of up to EXACT characters shares with each similar one of up to EXACT characters.

    The longer line of a pair is cut into one piece more than edits are allowed. One of
    them is unedited, with no more edits before it than pieces, and likewise after
    it: that bounds where in the shorter line it stands.
    """
    n, found = len(line), set()
    for longer in range(max(n, 5), EXACT + 1):
        edits, less = longer // 5, longer - n
        if less > edits:
            break
        for i in range(edits + 1):
            start, end = longer * i // (edits + 1), longer * (i + 1) // (edits + 1)
            low = max(start - i, start - less - (edits - i), 0)
            high = min(start + i, start - less + (edits - i), n - (end - start))
            found.update((longer, i, line[at : at + end - start]) for at in range(low, high + 1))
    return found


def line_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the lines, and the number of the line each belongs to; keys of pieces are odd.

    Lines of up to SHORT bytes have band keys of short n-grams and lines of at least
    four fifths of that of long ones: two similar lines have one kind in common.
    """
    sizes = np.array([len(x) for x in lines])
    letters, keys, owners = sizes.copy(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(sizes <= 4 * EXACT).tolist():
        line = lines[i].decode("utf-8", "surrogatepass")
        letters[i] = len(line)
        if len(line) <= EXACT:
            own = [xxhash.xxh64_intdigest(repr(x)) | 1 for x in pieces(line)]
            keys.append(np.array(own, np.uint64))
            owners.append(np.full(len(own), i))
    long = letters >= (EXACT + 1) * 4 // 5
    for n, rows, chosen in ((SHORT_GRAM, 3, sizes <= SHORT), (LONG_GRAM, 4, sizes >= SHORT * 4 // 5)):
        some = np.flatnonzero(long & chosen)
        if len(some):
            hashes, starts = gram_hashes([lines[i] for i in some], n)
            if n == LONG_GRAM:
                hashes, starts = _sampled(hashes, starts)
            found = minhash.band_keys(hashes, starts, BANDS, rows).view(np.uint64) & ~np.uint64(1)
            keys.append(found.ravel())
            owners.append(np.repeat(some, BANDS))
    return np.concatenate(keys), np.concatenate(owners)


def _sampled(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A quarter of the hashes, chosen by value; a line without any of them has all."""
    kept = (hashes & SAMPLED) == 0
    sizes = np.diff(np.append(starts, len(hashes)))
    kept |= np.repeat(np.add.reduceat(kept, starts, dtype=np.int64) == 0, sizes)
    sizes = np.add.reduceat(kept, starts, dtype=np.int64)
    return hashes[kept], np.cumsum(sizes) - sizes


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _documents(batch, i: int) -> Iterator[tuple[int, list[str]]]:
    data, ends, _, _ = row_arrays(batch, i)
    start = 0
    for number, end in enumerate(ends.tolist()):
        yield number, data[start:end].tobytes().decode("utf-8", "replace").split("\n")
        start = end


def _first_lines(batch, i: int) -> dict[bytes, tuple[int, int, int]]:
    """The non-blank lines of a run, normalised, each with its first place ``(id, doc, line)``."""
    ids = row_arrays(batch, i)[2].tolist()
    seen: dict[bytes, tuple[int, int, int]] = {}
    for doc, lines in _documents(batch, i):
        for number, line in enumerate(lines):
            plain = normalised(line).encode("utf-8", "surrogatepass")
            if plain:
                place = (ids[doc], doc, number)
                if seen.setdefault(plain, place) > place:
                    seen[plain] = place
    return seen


def _names(lines: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.md5(x).digest() for x in lines), np.uint64).reshape(-1, 2)


def _all_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, owners, before = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for part in _parts(lines):
        key, owner = line_keys(part)
        keys.append(key)
        owners.append(owner + before)
        before += len(part)
    return np.concatenate(keys), np.concatenate(owners)


def _marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The part of each hash (its upper ``bits``) over a mark of 32 bits (its lower ones)."""
    return (hashes >> np.uint64(64 - bits)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def sent_keys(runs: DataFrame, bits: int) -> DataFrame:
    """``(part, run, marks, checks, names)``: the distinct keys of a run with 16 bits of their line, and its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lines = list(_first_lines(batch, i))
                if not lines:
                    continue
                keys, owners = _all_keys(lines)
                names = _names(lines)
                marks, checks = _marks(keys, bits), (names[owners, 1] & np.uint64(0xFFFF)).astype(np.uint16)
                order = np.lexsort((checks, marks))
                marks, checks = marks[order], checks[order]
                other = np.append(True, (marks[1:] != marks[:-1]) | (checks[1:] != checks[:-1]))[: len(marks)]
                marks, checks = marks[other], checks[other]
                named = np.sort(_marks(names[:, 0], bits))
                parts = np.unique(np.concatenate([marks, named]) >> np.uint64(32))
                edges = [np.searchsorted(x >> np.uint64(32), [parts, parts + np.uint64(1)], "left") for x in (marks, named)]
                short, short_names = marks.astype(np.uint32), named.astype(np.uint32)
                c = [[], [], []]
                for s, e, t, f in zip(*edges[0].tolist(), *edges[1].tolist(), strict=True):
                    c[0].append(short[s:e].tobytes())
                    c[1].append(checks[s:e].tobytes())
                    c[2].append(short_names[t:f].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.astype(np.int64)), pa.array(np.full(len(parts), batch.column("run")[i].as_py(), np.int64)),
                     *[pa.array(x, pa.binary()) for x in c]],
                    ["part", "run", "marks", "checks", "names"],
                )

    return runs.mapInArrow(run, "part long, run long, marks binary, checks binary, names binary")


def shared_keys(sent: DataFrame) -> DataFrame:
    """``(run, part, marks, names)``: of each run the keys that several lines have, and the lines in several runs.

    Two lines whose checks agree as well (1 of 65,536) look like one to a key.
    """

    def run(table: pa.Table) -> pa.Table:
        of = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c)]
        marks, checks, names = of("marks", np.uint32), of("checks", np.uint16), of("names", np.uint32)
        pairs = np.unique(np.concatenate(marks).astype(np.uint64) << np.uint64(16) | np.concatenate(checks))
        several, again = _repeated(pairs >> np.uint64(16)).astype(np.uint32), _repeated(np.sort(np.concatenate(names)))
        out = {"run": [], "part": [], "marks": [], "names": []}
        for name, part, own, lines in zip(table.column("run").to_pylist(), table.column("part").to_pylist(), marks, names, strict=True):
            own, lines = np.unique(own[_among(own, several)]), lines[_among(lines, again)]
            if len(own) or len(lines):
                for column, x in zip(out.values(), (name, part, own.tobytes(), lines.tobytes()), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return sent.groupBy("part").applyInArrow(run, "run long, part long, marks binary, names binary")


def _repeated(values: np.ndarray) -> np.ndarray:
    return np.unique(values[1:][values[1:] == values[:-1]])


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


LINE = "la long, lb long, sim long, bands array<long>, id long, run long, doc int, line int"


def _shared_lines(table: pa.Table, side: pa.Table, bits: int) -> pa.Table:
    """The first occurrence in its run of each line with a shared key or another run that has it."""

    def known(column: str) -> np.ndarray:
        found = [
            np.uint64(part) << np.uint64(32) | np.frombuffer(body, np.uint32).astype(np.uint64)
            for part, body in zip(side.column("part").to_pylist(), side.column(column).to_pylist(), strict=True)
        ]
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))

    asked = table.num_rows and side.num_rows
    seen = _first_lines(table, 0) if asked else {}
    lines = list(seen)
    keys, owners = _all_keys(lines)
    own = np.flatnonzero(_among(_marks(keys, bits), known("marks")))
    own = own[np.argsort(owners[own], kind="stable")]
    counts = np.bincount(owners[own], minlength=len(lines))
    names = _names(lines)
    some = np.flatnonzero((counts > 0) | _among(_marks(names[:, 0], bits), known("names")))
    offsets = np.append(0, np.cumsum(counts[some])).astype(np.int32)
    chosen = [lines[i] for i in some.tolist()]
    sims = np.concatenate([np.zeros(0, np.uint64), *[word_simhashes(x) for x in _parts(chosen)]])
    id_, doc, number = np.array([seen[x] for x in chosen], np.int64).reshape(-1, 3).T
    name = table.column("run")[0].as_py() if asked else 0
    return pa.table(
        [pa.array(names[some, 0].view(np.int64)), pa.array(names[some, 1].view(np.int64)), pa.array(sims.view(np.int64)),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[own].view(np.int64))), pa.array(id_),
         pa.array(np.full(len(some), name, np.int64)), pa.array(doc.astype(np.int32)), pa.array(number.astype(np.int32))],
        names=["la", "lb", "sim", "bands", "id", "run", "doc", "line"],
    )


def _parts(lines: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for line in lines:
        part.append(line)
        size += len(line)
        if len(part) == 8192 or size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


TEXT = "la long, lb long, sim long, text string, keys array<long>"
KEYED = 400  # longer lines are sent with their keys, so that a pair is verified under the least of those it shares


def _texts(table: pa.Table, side: pa.Table) -> pa.Table:
    """The normalised lines that the side table asks for, long ones with their keys."""
    wanted = {(r["doc"], r["line"]): r for r in side.to_pylist()}
    rows = []
    for i in range(table.num_rows if wanted else 0):
        docs = {d for d, _ in wanted}
        for doc, lines in _documents(table, i):
            if doc in docs:
                for number, line in enumerate(lines):
                    r = wanted.get((doc, number))
                    if r is not None:
                        plain = normalised(line)
                        rows.append((r["la"], r["lb"], r["sim"], plain, r["bands"] if len(plain) > KEYED else None))
    c = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    return pa.table([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["la", "lb", "sim", "text", "keys"])


def _close_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a row of another class in their unit that may be similar; units may span batches.

    That is any for keys of pieces, and one within RADIUS bits for the others.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        units = table.column(0).to_numpy()
        last = int(np.flatnonzero(units != units[-1])[-1]) + 1 if units[0] != units[-1] else 0
        if last:
            yield table.slice(0, last).filter(pa.array(_has_close(table.slice(0, last))))
        held = [table.slice(last)]
    for table in held:
        yield table.filter(pa.array(_has_close(table)))


def _has_close(table: pa.RecordBatch) -> np.ndarray:
    units, sims, classes = table.column(0).to_numpy(), table.column(3).to_numpy().view(np.uint64), table.column(7).to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1])
    ends = np.append(starts[1:], len(units))
    mixed = np.repeat(np.minimum.reduceat(classes, starts) < np.maximum.reduceat(classes, starts), ends - starts)
    near = table.column(6).to_numpy(zero_copy_only=False) & mixed
    for by in range(1, SKIMMED):
        same = np.flatnonzero((units[by:] == units[:-by]) & (classes[by:] != classes[:-by]))
        same = same[np.bitwise_count(sims[same + by] ^ sims[same]) <= RADIUS]
        near[same] = near[same + by] = True
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        for i in range(s, e) if e - s > SKIMMED and mixed[s] else ():
            if not near[i]:
                near[i] = np.any((np.bitwise_count(sims[s:e] ^ sims[i]) <= RADIUS) & (classes[s:e] != classes[i]))
    return near


SKIMMED = 8  # rows of the largest unit whose pairs are compared a whole batch at once


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_units(batches):
        found = similar_links(table)
        if len(found[0]):
            names = table.column(1).to_numpy(), table.column(2).to_numpy()
            ends = [pa.StructArray.from_arrays([pa.array(x[side]) for x in names], ["la", "lb"]) for side in found]
            yield pa.RecordBatch.from_arrays(ends, ["src", "dst"])


ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 17, 1 << 25


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several whole units at a time; units may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) < ROWS_AT_ONCE and sum(x.nbytes for x in held) < BYTES_AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        units = table.column(0).to_numpy()
        last = int(np.searchsorted(units, units[-1]))
        if last:
            yield table.slice(0, last)
        held = [table.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


PAIRS_AT_ONCE, FEW_PAIRS, MANY_CHARACTERS = 8192, 40, 3000


def similar_links(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect the classes of similar lines in units (unit, la, lb, sim, text, mine, diagonal, exact, class, band, keys).

    Each row meets the next one of its unit, then the one after that, and so on;
    only rows not connected by then are compared, some pairs of all units at a time. Of the
    tiles of a large unit a pair is only looked at where its two tiles meet.
    What the SimHashes, lengths and letters leave is decided by edits.
    """
    units, sims, tiles = table.column(0).to_numpy(), table.column(3).to_numpy().view(np.uint64), table.column(5).to_numpy()
    diagonal, exact = (table.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
    texts, letters, sizes = _letters(table)
    band, keys = table.column(9).to_numpy(), table.column(10)
    _, node = np.unique(table.column(8).to_numpy(), return_inverse=True)
    root = np.arange(node.max() + 1)
    last = np.searchsorted(units, units, "right")
    row, by = np.arange(len(units)), 0
    links: list[tuple[int, int]] = []
    while len(row):
        pairs, waiting = [], 0
        while len(row) and waiting < PAIRS_AT_ONCE:
            by += 1
            row = row[row + by < last[row]]
            a, b = row, row + by
            near = (root[node[a]] != root[node[b]]) & (diagonal[a] | (tiles[a] != tiles[b]))
            near &= exact[a] | (np.bitwise_count(sims[a] ^ sims[b]) <= RADIUS)
            longer = np.maximum(sizes[a], sizes[b])
            near &= 5 * np.abs(sizes[a] - sizes[b]) <= longer
            a, b, longer = a[near], b[near], longer[near]
            # Each edit takes at most one letter away and adds at most one.
            more = letters[b] - letters[a]
            changed = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
            near = 5 * changed <= longer
            a, b = a[near], b[near]
            once = ~_met_before(band, keys, a, b)
            pairs.append((a[once], b[once]))
            waiting += int(once.sum())
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        alike = _similar_pairs(texts, sizes, a, b)
        for x, y in zip(a[alike].tolist(), b[alike].tolist(), strict=True):
            one, other = _root(root, node[x]), _root(root, node[y])
            if one != other:
                root[max(one, other)] = min(one, other)
                links.append((x, y))
        while (root != root[root]).any():
            root = root[root]
    src, dst = np.array(links, np.int64).reshape(-1, 2).T
    return src, dst


def _met_before(band: np.ndarray, keys: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a smaller key than that of their unit, and so meet in another unit too."""
    met = np.zeros(len(a), bool)
    offsets, values = keys.offsets.to_numpy(), keys.values.to_numpy()
    sizes = np.diff(offsets)
    both = np.flatnonzero((sizes[a] > 0) & (sizes[b] > 0))
    for start in range(0, len(both), 4096):
        some = both[start : start + 4096]
        sides = []
        for side, none in ((a[some], -1), (b[some], -3)):  # keys of long lines are even
            place = np.arange(sizes[side].max())
            inside = place < sizes[side][:, None]
            at = np.where(inside, offsets[side][:, None] + place, 0)
            sides.append(np.where(inside, values[at], none))
        own, other = sides
        own = np.where(own < band[a[some]][:, None], own, -1)
        met[some] = (own[:, :, None] == other[:, None, :]).any(axis=(1, 2))
    return met


def _root(root: np.ndarray, at: int) -> int:
    while root[at] != at:
        at = root[at]
    return at


def _letters(table: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The texts, how often each has each letter (in 32 classes), and their lengths."""
    texts = table.column(4).to_pylist()
    sizes = np.array([len(x) for x in texts], np.int64)
    letters = np.empty((len(texts), 32), np.int32)
    ends, start = np.cumsum(sizes), 0
    while start < len(texts):
        end = max(int(np.searchsorted(ends, ends[start] - sizes[start] + PART_BYTES, "right")), start + 1)
        data = np.frombuffer("".join(texts[start:end]).encode("utf-32-le"), np.uint32) & 31
        own = np.repeat(np.arange(end - start) << 5, sizes[start:end])
        letters[start:end] = np.bincount(own + data, minlength=32 * (end - start)).reshape(-1, 32)
        start = end
    return texts, letters, sizes


def _similar_pairs(texts: list[str], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of texts are similar; those with many others of about their length are decided together."""
    found, shorter = np.zeros(len(a), bool), np.minimum(sizes[a], sizes[b])
    about = np.floor(np.log2(shorter // 64 + 1)).astype(np.int64)
    many = (np.bincount(about, minlength=1)[about] >= FEW_PAIRS) & (shorter <= MANY_CHARACTERS)
    for i in np.flatnonzero(~many).tolist():
        found[i] = similar(texts[a[i]], texts[b[i]])
    some = np.flatnonzero(many)
    most = np.maximum(sizes[a], sizes[b])[some] // 5
    found[some] = edits.within([(texts[i], texts[j]) for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)], most)
    return found


def _links(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` of similar lines ``(la, lb, sim, place, bands, class)`` of two classes with a common key."""
    units = minhash.dealt(lines.select("la", "lb", "sim", "class", "bands"), "bands", F.struct("la", "lb"), TILE)
    close = cut(
        units.select("unit", "la", "lb", "sim", "mine", "diagonal", F.expr("band & 1 = 1").alias("exact"), "class", "band")
        .repartition("unit").sortWithinPartitions("unit")
        .mapInArrow(_close_rows, "unit long, la long, lb long, sim long, mine int, diagonal boolean, exact boolean, class long, band long")
    )
    asked = lines.join(close.select("la", "lb").distinct(), ["la", "lb"], "left_semi")
    asked = asked.select("la", "lb", "sim", "place.run", "place.doc", "place.line", "bands")
    texts = cut(runs.groupBy("run").cogroup(asked.groupBy("run")).applyInArrow(_texts, TEXT))
    return cut(
        close.drop("sim").join(texts, ["la", "lb"])
        .repartition("unit").sortWithinPartitions("unit", "la", "lb")
        .select("unit", "la", "lb", "sim", "text", "mine", "diagonal", "exact", "class", "band", "keys")
        .mapInArrow(_unit_links, "src struct<la:long,lb:long>, dst struct<la:long,lb:long>")
    )


def _with_class(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """``lines`` with ``class``, the same for connected lines: the first half of the hash of their root."""
    known = roots.select("node.la", "node.lb", F.col("root.la").alias("class"))
    return lines.drop("class").join(known, ["la", "lb"], "left").withColumn("class", F.coalesce("class", "la"))


def _dropped(table: pa.Table, side: pa.Table) -> pa.Table:
    places = list(zip(side.column("doc").to_pylist(), side.column("line").to_pylist(), side.column("kept").to_pylist(), strict=True))
    gone = {(doc, line) for doc, line, _ in places} - {(doc, line) for doc, line, kept in places if kept}
    out = {"k": [], "n_lines": [], "n_removed": [], "text": []}
    for i in range(table.num_rows):
        keys = row_arrays(table, i)[3]
        stays = {(doc, line) for _, doc, line in _first_lines(table, i).values()} - gone
        for doc, lines in _documents(table, i):
            stay = [x for n, x in enumerate(lines) if (doc, n) in stays or not normalised(x)]
            out["k"].append(keys[doc])
            out["n_lines"].append(len(lines))
            out["n_removed"].append(len(lines) - len(stay))
            out["text"].append("\n".join(stay))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def deduplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_lines, n_removed, text)``, one row per row of ``docs``, with the lines that stay.

    Lines end at line feeds; blank lines always stay. Of a connected group the
    occurrence in the smallest key, then the earliest line, stays; null keys
    come last, and rows that repeat a key are in an order of their own. Null
    texts are one blank line; an empty table gives an empty result. Keys must be
    whole numbers; other columns are not looked at.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = bucketed(pack(docs, key, text), parts)
    size = runs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(-(-size // KEY_PART_BYTES), parts).bit_length()
    shared = cut(shared_keys(sent_keys(runs, bits)))
    marked = cut(
        runs.groupBy("run").cogroup(shared.groupBy("run")).applyInArrow(lambda t, s: _shared_lines(t, s, bits), LINE)
    )
    place = F.struct("id", "run", "doc", "line")
    lines = cut(
        marked.groupBy("la", "lb")
        .agg(F.min(place).alias("place"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    )
    early = lambda key: F.pmod(F.shiftright(key, 1), F.lit(FIRST)) == 0
    first = lines.withColumn("bands", F.filter("bands", early)).withColumn("class", F.col("la"))
    roots = components(_links(runs, first))
    others = _with_class(lines.withColumn("bands", F.filter("bands", lambda key: ~early(key))), roots)
    stars = roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))
    roots = components(stars.unionByName(_links(runs, others)))
    node = F.struct("la", "lb")
    grouped = lines.select(node.alias("own"), "place").join(roots, F.col("own") == F.col("node"), "left")
    first = grouped.groupBy(F.coalesce("root", "own").alias("group")).agg(F.min("place").alias("place"))
    kept = cut(first.select("place.run", "place.doc", "place.line", F.lit(True).alias("kept")))
    side = marked.select("run", "doc", "line", F.lit(False).alias("kept")).unionByName(kept)
    found = runs.groupBy("run").cogroup(side.groupBy("run")).applyInArrow(
        _dropped, "k long, n_lines long, n_removed long, text string"
    )
    return found.withColumnRenamed("k", key)
