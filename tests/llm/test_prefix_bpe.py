"""Prefix BPE against the library that the ranks are made for."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm.prefix_bpe import Coder, Pieces, Prefixes, decoded, edited, encoded, reencoded, round_trip, unpacked

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string"
SIGNS = "ab c\n\n 1'sĀ日本é😀\t\0-.’x"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH, PATTERN)


def test_fuzzed_texts_and_edits(library, pieces):
    draw = random.Random(1)
    for _ in range(1500):
        text = "".join(draw.choice(SIGNS) for _ in range(draw.randrange(60)))
        ids = pieces.encode(text)
        assert unpacked(ids) == library.encode_ordinary(text)
        a = draw.randrange(len(text) + 1)
        z, new = draw.randrange(a, len(text) + 1), "".join(draw.choice(SIGNS) for _ in range(draw.randrange(6)))
        changed, ids = reencoded(pieces, text, ids, a, z, new)
        assert changed == text[:a] + new + text[z:] and unpacked(ids) == library.encode_ordinary(changed)


def test_prefixes_append_and_edit(library):
    coder, draw, computed, whole = Coder(PATH), random.Random(2), 0, 0
    for _ in range(150):
        data = "".join(draw.choice("abehintrsoué") for _ in range(draw.randrange(1, 900))).encode()
        own = Prefixes(coder, data)
        a = draw.randrange(len(data) + 1)
        z, new = min(len(data), a + draw.randrange(4)), "".join(draw.choice("aeithr") for _ in range(draw.randrange(5))).encode()
        computed, whole = computed + own.edit(a, z, new), whole + len(data)
        assert own.data == data[:a] + new + data[z:] and own.last == Prefixes(coder, own.data).last
        own.append(b"thing")
        assert own.last == Prefixes(coder, own.data).last and b"".join(coder.tokens[i] for i in own.ids()) == own.data
        assert own.ids() == library._encode_single_piece(own.data)
    assert computed < whole / 2


def test_each_prefix_is_the_encoding_of_its_bytes(library):
    own = Prefixes(Coder(PATH), b"internationalisations")
    for n in range(1, len(own.data) + 1):
        part = Prefixes(own.coder)
        part.data, part.last = own.data[:n], own.last[: n + 1]
        assert part.ids() == library._encode_single_piece(part.data)


TEXTS = [None, "", " ", "\n", "Plain words, and more.", "été  des\t\tmots\r\n", "x" * 30_000, "日本語" * 400, "<|endoftext|> it's", "a\0b \0", "same", "same", " lead", "trail "]


def test_documents(spark, library):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "x") for i, t in enumerate(TEXTS)], SCHEMA + ", ids int, n_tokens string")
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        want.append((i if i != 3 else None, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, round_trip(docs, PATH, PATTERN).collect()), key=str) == sorted(want, key=str)
    ids = encoded(docs, PATH, PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i if i != 3 else None: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: bytes(r.data).decode() for r in decoded(ids, PATH, PATTERN).collect()} == {i if i != 3 else None: t or "" for i, t in enumerate(TEXTS)}
    assert round_trip(docs.limit(0), PATH, PATTERN).collect() == []


def test_edits_as_rows(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], SCHEMA)
    rows = docs.join(encoded(docs, PATH, PATTERN), "doc_id").withColumns({"start": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")), "stop": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") + 2), "new": F.when(F.col("doc_id") % 4 > 0, F.lit(" néw wörds "))})
    for r in edited(rows, PATH, PATTERN).collect():
        old, new = TEXTS[r.doc_id] or "", " néw wörds " if r.doc_id % 4 else ""
        a, z = (r.doc_id, r.doc_id + 2) if r.doc_id % 3 else (len(old), len(old))
        assert r.text == old[:a] + new + old[z:] and r.ids == library.encode_ordinary(r.text)
