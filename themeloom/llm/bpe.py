"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one encoding, so it is enough to store its last
token: the token t that ends there such that the encoding of what is before t
may stand next to t. Appending bytes only adds entries, and after an edit only
the entries behind it are made again, up to where they meet the old ones.

Whether two tokens may stand side by side is seen by taking their merges back,
latest first: if at any time the parts at the seam could have merged earlier,
the pair never occurs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED_PIECES = 300_000  # a worker forgets its pieces beyond that: bounded memory
CACHED_BYTES = 64  # longer pieces are not worth keeping
CACHED_PAIRS = 1_000_000


class Vocabulary:
    """Merge ranks, with what the dynamic program needs to know about tokens.

    Tokens are named by their ranks, 0 to n - 1 without gaps.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        self.sizes = [len(b) for b in self.token]
        self.longest = max(self.sizes)
        # Every end of a token, with the token's rank if it is one itself, else -1.
        self.ends: dict[bytes, int] = {}
        # The rank of the token that two tokens make, by left * n + right.
        self.joined: dict[int, int] = {}
        n = len(ranks)
        for token, rank in ranks.items():
            for i in range(len(token)):
                self.ends.setdefault(token[i:], ranks.get(token[i:], -1))
                if i and token[:i] in ranks and token[i:] in ranks:
                    self.joined[ranks[token[:i]] * n + ranks[token[i:]]] = rank
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def load(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging never makes it."""
        found = self.halves.get(rank)
        if found is None:
            token, joined, n = self.token[rank], self.joined, len(self.token)
            parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
            while len(parts) > 2:
                made = [joined.get(a * n + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                least = min(made)
                if least >= rank:
                    break
                at = made.index(least)
                parts[at : at + 2] = [least]
            found = tuple(parts) if len(parts) == 2 else None
            if found:
                self.halves[rank] = found
        return found

    def fit_together(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        pair = left * len(self.token) + right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        sizes, joined, n = self.sizes, self.joined, len(self.token)
        before = n  # a merge at the seam of a rank below this would have won
        while True:
            if joined.get(left * n + right, before) < before:
                return False
            made_left = left if sizes[left] > 1 else -1
            made_right = right if sizes[right] > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                # Of equal ranks the leftmost merges first: left's own merge precedes the seam's.
                before, left = left, self.split(left)[1]
            else:
                before, right = right + 1, self.split(right)[0]


STRIDE = 64  # bounds the recursion in long pieces


class PieceEncoding:
    """The encoding of one piece, open to appends and edits.

    ``last[i]`` is the last token of the first i bytes, made when first asked
    for: the encoding of the whole only asks for some of the prefixes.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data = vocabulary, data
        self.last: list[int] = [-1] * (len(data) + 1)

    def append(self, data: bytes) -> None:
        self.data += data
        self.last += [-1] * len(data)

    def last_token(self, end: int) -> int:
        for at in range(STRIDE, end, STRIDE):
            if self.last[at] < 0:
                _last_token(self.vocabulary, self.data, self.last, at)
        return _last_token(self.vocabulary, self.data, self.last, end)

    def filled(self) -> list[int]:
        """The last tokens of all prefixes but the empty one."""
        for at in range(1, len(self.data) + 1):
            _last_token(self.vocabulary, self.data, self.last, at)
        return self.last[1:]

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes ``start:end``; returns how many prefixes were encoded anew.

        Prefixes up to ``start`` stay. Behind the new bytes, once as many
        prefixes in a row as the longest token agree with the old ones (last
        tokens inside the unchanged bytes), all later ones do.
        """
        self.filled()
        old, sizes = self.last[end:], self.vocabulary.sizes
        self.data = self.data[:start] + data + self.data[end:]
        fixed, agreed = start + len(data), 0
        self.last = self.last[: start + 1] + [-1] * (len(self.data) - start)
        for at in range(start + 1, len(self.data) + 1):
            found, behind = _last_token(self.vocabulary, self.data, self.last, at), at - fixed
            if behind > 0:
                agreed = agreed + 1 if found == old[behind] and sizes[found] <= behind else 0
                if agreed >= self.vocabulary.longest:
                    self.last[at + 1 :] = old[behind + 1 :]
                    return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        found, end, sizes = [], len(self.data), self.vocabulary.sizes
        if end:
            self.last_token(end)
        while end:
            found.append(_last_token(self.vocabulary, self.data, self.last, end))
            end -= sizes[found[-1]]
        return found[::-1]


def _last_token(v: Vocabulary, data: bytes, last: list[int], end: int) -> int:
    """The longest token at ``end`` that is alone or fits what is before it: the only such one."""
    if last[end] >= 0:
        return last[end]
    get, candidates = v.ends.get, []
    for start in range(end - 1, -1, -1):
        rank = get(data[start:end])
        if rank is None:
            break
        if rank >= 0:
            candidates.append((start, rank))
    n = len(v.token)
    while candidates:
        start, rank = candidates.pop()
        if end - start > 1 and rank not in v.halves and v.split(rank) is None:
            continue
        if start:
            before = last[start]
            if before < 0:
                before = _last_token(v, data, last, start)
            fits = v.pairs.get(before * n + rank)
            if not (v.fit_together(before, rank) if fits is None else fits):
                continue
        last[end] = rank
        return rank
    raise ValueError("the vocabulary lacks a single byte")


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """A piece that is a token as a whole is that token, as in the library to match."""
    whole = vocabulary.ranks.get(piece)
    return [whole] if whole is not None else PieceEncoding(vocabulary, piece).ids()


class TextEncoder:
    """Splits texts by the pattern and encodes each match; keeps what it met often."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import regex

        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.narrow = re.compile(latin_pattern(pattern)).findall
        self.seen: dict[str, tuple[str, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # the same split by the faster library
        except UnicodeEncodeError:
            return self.split(text)
        return self.narrow(text)

    def piece(self, piece: str) -> tuple[str, bytes]:
        """Ids joined by commas, and the bytes that the ids stand for."""
        data = piece.encode("utf-8", "surrogatepass")
        ids = encode_piece(self.vocabulary, data)
        token = self.vocabulary.token
        found = ",".join(map(str, ids)), b"".join([token[i] for i in ids])
        if len(data) <= CACHED_BYTES:
            if len(self.seen) >= CACHED_PIECES:
                self.seen.clear()
            self.seen[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in self.piece(p)[0].split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.vocabulary.token[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, hex digests of the ids joined by commas and of the decoded bytes."""
        known, new = self.seen.get, self.piece
        parts = [known(p) or new(p) for p in self.pieces(text)]
        texts, backs = zip(*parts, strict=True) if parts else ((), ())
        ids = ",".join(texts)
        count = ids.count(",") + 1 if parts else 0
        return count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(backs)).hexdigest()


def latin_pattern(pattern: str) -> str:
    r"""``pattern`` for the standard library, right for texts of code points up to 255.

    ``\p{L}``, ``\p{N}`` and ``\s`` become lists of the characters they match there.
    """
    listed = {
        r"\p{L}": "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == "L"),
        r"\p{N}": "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == "N"),
        r"\s": "\t\n\x0b\x0c\r \x85\xa0",
    }
    listed = {k: "".join(f"\\x{ord(c):02x}" for c in v) for k, v in listed.items()}
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(listed.values())}]")
    for name, members in listed.items():
        inside = inside.replace(name, f"[{members}]")
    return inside.replace(r"\S", f"[^{listed[r'\s']}]")


_ENCODERS: dict[tuple[int, str], TextEncoder] = {}  # one per worker, kept between tasks


def encode_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``, one row per row of ``docs``.

    Whole texts, no special tokens. Null text counts as empty (no ids, digests
    of nothing); null keys and repeated rows get rows like any other. Other
    columns are not looked at. The vocabulary file is read on the driver and
    broadcast (its size is fixed); nothing else is shared between tasks.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary_path, "rb") as file:
        data = file.read()
    shared = spark.sparkContext.broadcast(data)
    name = hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((name, pattern))
        if encoder is None:
            encoder = _ENCODERS[name, pattern] = TextEncoder(Vocabulary.load(shared.value), pattern)
        for batch in batches:
            found = [encoder.digest(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["k", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(key, text)
        .mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .select(F.col("k").alias(key), "n_tokens", "ids_sha256", "decoded_sha256")
    )
