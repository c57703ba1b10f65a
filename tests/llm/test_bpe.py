"""BPE against the tiktoken library, appends and edits against encoding anew."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from themeloom.llm import bpe

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoder():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return bpe.TextEncoder(bpe.Vocabulary.load(file.read()), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def test_texts_of_all_kinds(encoder, library):
    draw = random.Random(1)
    wide = [chr(c) for c in [*range(0x250), *range(0x400, 0x460), *range(0x4E00, 0x4E40), 0x1F600, 0x2028, 0x3000]]
    texts = ["", " ", "\x1c \x85\xa0", "a" * 5000, " \n" * 700, "</s> don't 12345 <|endoftext|>"]
    texts += ["".join(draw.choices(wide if i % 2 else wide[:128], k=draw.randint(0, 40))) for i in range(2000)]
    for text in texts:
        ids = library.encode_ordinary(text)
        assert encoder.encode(text) == ids, repr(text)
        assert encoder.decode(ids) == text.encode()


def test_any_bytes(encoder, library):
    draw = random.Random(2)
    tokens = list(encoder.vocabulary.ranks)
    for _ in range(3000):
        piece = b"".join(draw.choices(tokens, k=draw.randint(1, 6)))
        assert bpe.encode_piece(encoder.vocabulary, piece) == library._encode_single_piece(piece)


def test_appends_and_edits(encoder):
    draw = random.Random(3)
    tokens = list(encoder.vocabulary.ranks)
    for _ in range(300):
        data = b"".join(draw.choices(tokens, k=draw.randint(1, 60)))
        cut = draw.randint(0, len(data))
        grown = bpe.PieceEncoding(encoder.vocabulary, data[:cut])
        grown.ids()
        grown.append(data[cut:])
        assert grown.ids() == bpe.PieceEncoding(encoder.vocabulary, data).ids()
        start = draw.randint(0, len(data))
        end, new = min(len(data), start + draw.randint(0, 4)), b"".join(draw.choices(tokens, k=draw.randint(0, 2)))
        again = grown.edit(start, end, new)
        fresh = bpe.PieceEncoding(encoder.vocabulary, data[:start] + new + data[end:])
        assert grown.filled() == fresh.filled()
        assert again <= len(fresh.data) - start


def test_an_edit_stays_near(encoder):
    encoding = bpe.PieceEncoding(encoder.vocabulary, b"lengthy words of a text " * 200)
    assert encoding.edit(5, 6, b"xyz") < 200


def test_documents(table, library):
    rows = [(1, "Ein Haus, and 12 houses"), (1, "Ein Haus, and 12 houses"), (2, None), (None, ""), (3, "é" * 3000)]
    docs = table(rows, DOCS)
    found = bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()

    def expected(key, text):
        ids = library.encode_ordinary(text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return key, len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())

    assert sorted(map(tuple, found), key=str) == sorted((expected(*r) for r in rows), key=str)
    none = table([], DOCS)
    assert bpe.encode_documents(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
