"""Repeated passages by a distributed merge sort of suffixes.

A document loses every byte that lies in a ``LENGTH``-byte string which also
starts in a document with a smaller id.

Sparse suffixes. Every window of ``LENGTH`` bytes names one of its k-mers as its
anchor (the one of least hash, leftmost), from its own bytes only, so equal
windows agree on it. Only suffixes at anchors are sorted; each brings along the
bytes to its left that its windows reach (an element: left, right, smallest and
largest document).

Runs. Documents are packed into runs of some megabytes. A run sends the hashes
of its anchors, and learns which also stand in other documents: no other window
can repeat, so the others are not sent on. What is left is sorted, equal
elements are folded (a passage that most documents share is one element per
run), and sent on front-coded: the length of the prefix shared with the element
before, and the rest.

Merge. The elements of a part of the anchor hashes meet in one group: a loser
tree merges their runs. It carries for each run's head the prefix shared with
the last output; heads with different lengths are told apart without looking at
bytes, others are compared behind the known prefix. The shared prefixes of the
merged order tell which right sides agree; left sides are refined byte by byte.
Each run is told the smallest document of its windows, and cuts its documents.

Runs are stored as a bucketed table, so they are read three times but shuffled
never.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.runs import NO_ID, bucketed, pack, row_arrays
from themeloom.plans.lineage import cut

LENGTH = 50
GRAM = 24  # bytes of an anchor
SPAN = LENGTH - GRAM + 1  # k-mers in a window; an anchor is reached from 0 to SPAN - 1 bytes left
PART_BYTES = 1 << 28  # of input per part of the anchor hashes
CHUNK = 1 << 17
@dataclass
class Anchors:
    """``at``: positions; ``first``, ``last``: the windows that name it; ``mark``: hash of its k-mer."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    mark: np.ndarray


_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all k-mers (24 = 16 + 8 bytes), by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    eight = None
    for width in (1, 2, 4, 8):
        power = np.uint64(pow(_BASE, width, 1 << 64))
        h = h[:-width] * power + h[width:]
        if width == 4:
            eight = h
    return h[:-8] * np.uint64(pow(_BASE, 8, 1 << 64)) + eight[16:]


def anchors(data: np.ndarray, ends: np.ndarray) -> Anchors:
    """The anchors of all windows that lie inside a document."""
    n = len(data)
    named = np.full(max(n, 1), -1, np.int64)
    marks = np.zeros(max(n, 1), np.uint64)
    for start in range(0, n - LENGTH + 1, CHUNK):
        hashes = _gram_hashes(data[start : start + CHUNK + LENGTH - 1])
        places = np.arange(len(hashes), dtype=np.uint64)
        least = (_mixed(hashes, 0xD6E8FEB86659FD93) & np.uint64(0xFFFFFFFF00000000)) | places
        for width in (1, 2, 4, 8):
            least = np.minimum(least[:-width], least[width:])
        least = np.minimum(least[: -(SPAN - 16)], least[SPAN - 16 :])
        found = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        named[start : start + len(found)] = found + start
        used = np.unique(found)
        marks[used + start] = _mixed(hashes[used], 0xC2B2AE3D27D4EB4F)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    named = np.where(np.cumsum(inside[:n]) > 0, named[:n], -1)
    change = np.flatnonzero(np.diff(named, prepend=-2, append=-2))
    first, last = change[:-1], change[1:] - 1
    used = named[first] >= 0
    first, last = first[used], last[used]
    at = named[first]
    return Anchors(at, first, last, marks[at])


def _parts(mark: np.ndarray, bits: int) -> np.ndarray:
    return (mark >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mark), np.int64)


def _short(mark: np.ndarray) -> np.ndarray:
    """What the parts see of a hash. Clashes only let more elements through."""
    return (mark & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slices(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) for each run of equal values."""
    if len(parts):
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for s, e in zip(starts, np.append(starts[1:], len(parts)), strict=True):
            yield int(parts[s]), int(s), int(e)


def sent_marks(runs: DataFrame, bits: int) -> DataFrame:
    """``(part, run, marks, several)``: a run's distinct marks, and which stand in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, _, _ = row_arrays(batch, i)
                a = anchors(data, ends)
                doc = np.searchsorted(ends, a.at, "right")
                key = _parts(a.mark, bits) << 32 | _short(a.mark).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                heads = np.flatnonzero(np.diff(key, prepend=-1))
                several = (
                    np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
                    if len(heads)
                    else np.zeros(0, bool)
                )
                key = key[heads]
                name = batch.column("run")[i].as_py()
                found = [
                    (p, name, key[s:e].astype(np.uint32).tobytes(), np.packbits(several[s:e]).tobytes())
                    for p, s, e in _slices(key >> 32)
                ]
                if found:
                    c = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())],
                        ["part", "run", "marks", "several"],
                    )

    return runs.mapInArrow(run, "part long, run long, marks binary, several binary")


SIDE = "run long, kind int, part long, body binary, more binary"


def _side(rows: list[tuple]) -> pa.Table:
    c = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["run", "kind", "part", "body", "more"])


def shared_marks(marks: DataFrame) -> DataFrame:
    """Side rows of kind 0: for each run the marks that other documents have as well."""

    def run(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("marks")]
        several = [
            np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(b)).astype(bool)
            for x, b in zip(table.column("several"), blocks, strict=True)
        ]
        every = np.sort(np.concatenate(blocks))
        again = every[1:][every[1:] == every[:-1]]
        found = np.unique(np.concatenate([again, *[b[s] for b, s in zip(blocks, several, strict=True)]]))
        part, rows = table.column("part")[0].as_py(), []
        for name, block in zip(table.column("run").to_pylist(), blocks, strict=True):
            own = block[_among(block, found)]
            if len(own):
                rows.append((name, 0, part, own.tobytes(), None))
        return _side(rows)

    return marks.groupBy("part").applyInArrow(run, SIDE)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[place] == values


@dataclass
class Elements:
    """Distinct elements of a run in order of part and right side, and where each occurs."""

    part: np.ndarray
    right: np.ndarray  # n x LENGTH, zeros behind right_size
    right_size: np.ndarray
    left: np.ndarray  # n x (SPAN - 1), nearest byte first
    left_size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    of: np.ndarray  # element of each occurrence
    at: np.ndarray
    doc: np.ndarray


def elements(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, shared: np.ndarray, bits: int) -> Elements:
    """``shared``: sorted part and short mark of the anchors to keep."""
    a = anchors(data, ends)
    parts = _parts(a.mark, bits)
    kept = _among(parts << 32 | _short(a.mark).astype(np.int64), shared)
    at, first, last, parts = a.at[kept], a.first[kept], a.last[kept], parts[kept]
    doc = np.searchsorted(ends, at, "right")
    right_size = (last + LENGTH - at).astype(np.uint8)
    left_size = (at - first).astype(np.uint8)
    padded = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    right = padded[at[:, None] + np.arange(SPAN, SPAN + LENGTH)]
    right[np.arange(LENGTH) >= right_size[:, None]] = 0
    left = padded[at[:, None] + np.arange(SPAN - 1, 0, -1)]
    left[np.arange(SPAN - 1) >= left_size[:, None]] = 0
    words = np.zeros((len(at), 80), np.uint8)
    words[:, :LENGTH], words[:, 50], words[:, 51] = right, right_size, left_size
    words[:, 54 : 54 + SPAN - 1] = left
    keys = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*[keys[:, j] for j in range(9, -1, -1)], parts))
    sorted_keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]).any(axis=1) | (parts[order][1:] != parts[order][:-1])
    heads = np.flatnonzero(new)
    chosen = order[heads]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    owners = ids[doc]
    low = np.minimum.reduceat(owners[order], heads) if len(heads) else owners[:0]
    high = np.maximum.reduceat(owners[order], heads) if len(heads) else owners[:0]
    return Elements(
        parts[chosen], right[chosen], right_size[chosen], left[chosen], left_size[chosen], low, high, of, at, doc
    )


def front_coded(e: Elements, s: int, t: int) -> bytes:
    """Elements s to t: shared prefix lengths, sizes, documents, then the remaining bytes."""
    right, size = e.right[s:t], e.right_size[s:t]
    prefix = np.zeros(t - s, np.uint8)
    if t - s > 1:
        differ = right[1:] != right[:-1]
        prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        prefix[1:] = np.minimum(prefix[1:], np.minimum(size[1:], size[:-1]))
    places = np.arange(LENGTH)
    rest = right[(places >= prefix[:, None]) & (places < size[:, None])]
    lefts = e.left[s:t][np.arange(SPAN - 1) < e.left_size[s:t, None]]
    fixed = [prefix, size, e.left_size[s:t], e.low[s:t], e.high[s:t] - e.low[s:t]]
    import zstandard

    body = np.array([t - s, s], np.int64).tobytes() + b"".join(x.tobytes() for x in fixed) + rest.tobytes() + lefts.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body)


class FrontCoded:
    """A front-coded block, unpacked but for the strings."""

    def __init__(self, packed: bytes) -> None:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(packed)
        n, self.first = np.frombuffer(body, np.int64, 2).tolist()
        self.prefix, self.size, self.left_size = np.frombuffer(body, np.uint8, 3 * n, 16).reshape(3, n)
        numbers = np.frombuffer(body, np.int64, 2 * n, 16 + 3 * n).reshape(2, n)
        self.low, self.high = numbers[0], numbers[0] + numbers[1]
        start = 16 + 19 * n
        rest = int((self.size.astype(np.int64) - self.prefix).sum())
        self.rest, lefts = body[start : start + rest], np.frombuffer(body, np.uint8, -1, start + rest)
        self.left = np.zeros((n, SPAN - 1), np.uint8)
        self.left[np.arange(SPAN - 1) < self.left_size[:, None]] = lefts

    def strings(self) -> Iterator[tuple[int, bytes]]:
        """(prefix shared with the one before, right side) in order."""
        own, at, rest = b"", 0, self.rest
        for prefix, size in zip(self.prefix.tolist(), self.size.tolist(), strict=True):
            own = own[:prefix] + rest[at : at + size - prefix]
            at += size - prefix
            yield prefix, own


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs with a loser tree; (run, shared prefix with the one before) per output.

    ``known[i]`` is the length of the prefix that run i's head shares with the
    last output (for a loser: with whoever beat it, which is the same as far as
    it counts). Of two heads the one that shares more comes first.
    """
    n = 1 << max(len(runs) - 1, 0).bit_length()
    head: list[bytes | None] = [None] * n
    known = [-1] * n  # -1: the run is at its end
    for i, r in enumerate(runs):
        first = next(r, None)
        if first is not None:
            head[i], known[i] = first[1], 0
    loser = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), with the loser's known prefix brought up to date."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = known[a]
        if at < 0:
            return a, b
        x, y = head[a][at:], head[b][at:]
        if x > y:
            a, b, x, y = b, a, y, x
        size = min(len(x), len(y))
        if x[:size] == y[:size]:
            known[b] = at + size
        else:
            differ = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            known[b] = at + size - (differ.bit_length() + 7) // 8
        return a, b

    winners = list(range(n))
    level = n
    while level > 1:  # the first round, from the leaves up
        level //= 2
        pairs = [play(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
        winners = [p[0] for p in pairs]
        for i, p in enumerate(pairs):
            loser[level + i] = p[1]
    best = winners[0]
    order, prefixes = [], []
    while known[best] >= 0:
        order.append(best)
        prefixes.append(known[best])
        following = next(runs[best], None)
        if following is None:
            known[best] = -1
        else:
            known[best], head[best] = following
        node = (n + best) >> 1
        while node:
            other = loser[node]
            if known[other] > known[best]:
                loser[node], best = best, other
            elif known[other] == known[best]:
                best, loser[node] = play(best, other)
            node >>= 1
    return np.array(order, np.int64), np.array(prefixes, np.int64)


def settled(blocks: list[FrontCoded]) -> Iterator[tuple[int, np.ndarray]]:
    """For each block that has something to cut: rows of (element, from, to, document).

    Windows that reach ``from`` to ``to`` bytes left of the anchor also stand in
    ``document``, the smallest that has them.
    """
    order, prefix = merged([b.strings() for b in blocks])
    place = np.empty(len(order), np.int64)  # in its block
    for b in range(len(blocks)):
        mine = order == b
        place[mine] = np.arange(np.count_nonzero(mine))
    shift = np.concatenate([[0], np.cumsum([len(b.size) for b in blocks])])[:-1]
    take = shift[order] + place
    gather = lambda name: np.concatenate([getattr(b, name) for b in blocks])[take]
    size, left_size, left = gather("size"), gather("left_size"), gather("left")
    low, high = gather("low"), gather("high")
    prefix[:1] = 0
    lefts = np.zeros(len(order), np.int64)
    best = np.full((len(order), SPAN), NO_ID, np.int64)
    for reach in range(SPAN):
        if reach:
            lefts = np.unique(lefts << 8 | left[:, reach - 1], return_inverse=True)[1]
        rights = np.cumsum(prefix < LENGTH - reach)
        whole = np.flatnonzero((left_size >= reach) & (size >= LENGTH - reach))
        if not len(whole):
            continue
        same = rights[whole] * (len(order) + 1) + lefts[whole]
        sorting = np.argsort(same, kind="stable")
        heads = np.flatnonzero(np.diff(same[sorting], prepend=-1))
        counts = np.diff(np.append(heads, len(same)))
        best[whole[sorting], reach] = np.repeat(np.minimum.reduceat(low[whole][sorting], heads), counts)
    useful = best < high[:, None]
    # Neighbouring reaches with the same document are one row.
    same = np.zeros_like(useful)
    same[:, 1:] = useful[:, 1:] & useful[:, :-1] & (best[:, 1:] == best[:, :-1])
    row, start = np.nonzero(useful & ~same)
    follows = np.zeros_like(useful)
    follows[:, :-1] = same[:, 1:]
    _, end = np.nonzero(useful & ~follows)
    which = order[row]
    first = np.array([b.first for b in blocks], np.int64)
    result = np.stack([first[which] + place[row], start, end, best[row, start]], axis=1)
    sorting = np.argsort(which, kind="stable")
    for b, s, e in _slices(which[sorting]):
        yield b, result[sorting[s:e]]


def sent_elements(table: pa.Table, side: pa.Table, bits: int) -> pa.Table:
    rows = []
    for i in range(table.num_rows):
        data, ends, ids, _ = row_arrays(table, i)
        e = elements(data, ends, ids, _shared(side), bits)
        name = table.column("run")[i].as_py()
        rows += [(name, 1, p, front_coded(e, s, t), None) for p, s, t in _slices(e.part)]
    return _side(rows)


def _shared(side: pa.Table) -> np.ndarray:
    found = [
        np.frombuffer(b, np.uint32).astype(np.int64) | p << 32
        for k, p, b in zip(*[side.column(c).to_pylist() for c in ("kind", "part", "body")], strict=True)
        if k == 0
    ]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def merge_part(table: pa.Table) -> pa.Table:
    part, names = table.column("part")[0].as_py(), table.column("run").to_pylist()
    blocks = [FrontCoded(x.as_py()) for x in table.column("body")]
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    return _side([(names[b], 2, part, pack(np.ascontiguousarray(v.T).tobytes()), None) for b, v in settled(blocks)])


CUT = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def cut_documents(table: pa.Table, side: pa.Table, bits: int) -> pa.Table:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out = {name: [] for name in ("k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
    for i in range(table.num_rows):
        data, ends, ids, keys = row_arrays(table, i)
        e = elements(data, ends, ids, _shared(side), bits)
        covered = np.zeros(len(data) + 1, np.int64)
        verdicts = [
            np.frombuffer(unpack(b), np.int64).reshape(4, -1)
            for k, b in zip(side.column("kind").to_pylist(), side.column("body").to_pylist(), strict=True)
            if k == 2
        ]
        if verdicts:
            element, start, end, document = np.concatenate(verdicts, axis=1)
            # All occurrences of the elements: those in later documents than the smallest.
            by_element = np.argsort(e.of, kind="stable")
            bounds = np.searchsorted(e.of[by_element], np.arange(len(e.part) + 1))
            counts = bounds[element + 1] - bounds[element]
            which = np.repeat(np.arange(len(element)), counts)
            within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = by_element[bounds[element][which] + within]
            later = ids[e.doc[place]] > document[which]
            at, which = e.at[place[later]], which[later]
            np.add.at(covered, at - end[which], 1)
            np.add.at(covered, at - start[which] + LENGTH, -1)
        gone = np.cumsum(covered[:-1]) > 0
        starts = np.concatenate([[0], ends[:-1]])
        for key, s, t in zip(keys, starts.tolist(), ends.tolist(), strict=True):
            mask = gone[s:t]
            edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0)).reshape(-1, 2)
            out["k"].append(key)
            out["n_bytes"].append(t - s)
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(len(edges))
            out["kept_sha256"].append(hashlib.sha256(data[s:t][~mask].tobytes()).hexdigest())
            out["spans"].append([{"start": a, "end": b} for a, b in edges.tolist()])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256, spans)``, one row per row of ``docs``.

    ``spans`` are the maximal removed byte ranges. Strings are judged on the
    input; matches never cross documents. Null texts count as empty. A null key
    is larger than all others and not smaller than another null; rows that
    repeat a key are not smaller than one another, so they lose only what
    smaller keys have. An empty table gives an empty result. Keys must be whole
    numbers; other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = bucketed(pack(docs, key, text), parts)
    size = runs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bits = max(-(-size // PART_BYTES), parts).bit_length()
    shared = cut(shared_marks(sent_marks(runs, bits)))
    sent = (
        runs.groupBy("run").cogroup(shared.groupBy("run")).applyInArrow(lambda t, s: sent_elements(t, s, bits), SIDE)
    )
    verdicts = cut(sent.select("part", "run", "body").groupBy("part").applyInArrow(merge_part, SIDE))
    side = shared.unionByName(verdicts)
    found = runs.groupBy("run").cogroup(side.groupBy("run")).applyInArrow(lambda t, s: cut_documents(t, s, bits), CUT)
    return found.withColumnRenamed("k", key)
