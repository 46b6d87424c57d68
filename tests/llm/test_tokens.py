import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_counts, token_records

PIECES = [" ", "  ", "\n", "\t", "\xa0", "　", "a", "don't", "Foo", "FOO,", "12", " x", "<|endoftext|>", "<|startoftext|>", "\x1c", "\0", "é", "é", "É.", "'s", ".", "!!", "\x85", "​", "日本", "́", "İ", "Σ", "ΑΣ", "=", "̸"]


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 9))) for _ in range(n)]


def test_counts_of_odd_texts_equal_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, lengths = Tokenizer.from_file(path), token_counts.Lengths(path)
    for t in odd_texts(5000, 1):
        cut = token_counts.pieces(t)
        assert "".join(map(token_counts.raw, cut)) == t
        assert sum(map(lengths.__getitem__, cut)) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_ids_of_odd_texts_equal_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, words = Tokenizer.from_file(path), token_records.WordIds(path)
    found = odd_texts(5000, 2)
    for t in found:
        assert np.frombuffer(words.encode(t), words.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.fixture(scope="module")
def docs(spark):
    long = "lorem ipsum " * 20_000
    rows = [(5, "Hello, World", "a"), (3, None, "b"), (9, "", None), (1, long, "c"), (1, "tie", "d"), (1, "tie", "d"), (None, "no id", "e"), (7, " lead\n\ntrail ", "f")]
    rows += [(20 + i, t.replace("\0", ""), "x") for i, t in enumerate(odd_texts(300, 3))]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_counts_query(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(((d is None, d or 0), len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, _ in docs.collect())
    got = sorted(((r[0] is None, r[0] or 0), r[1], r[2], r[3]) for r in token_counts.count_tokens(docs, path).collect())
    assert got == want


def test_records_round_trip(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    manifest = token_records.write_records(docs, path, f"file://{tmp_path}/records")
    got = sorted(token_records.read_records(spark, manifest).collect(), key=lambda r: r["start"])
    ids = [(d is None, d) for d, *_ in got]
    assert [d for none, d in ids if not none] == sorted(d for none, d in ids if not none)
    want = {}
    for d, t, _ in docs.collect():
        x = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(d, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    at = 0
    seen = {}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    part = manifest.orderBy("part").first()
    entries = token_records.read_index(part["path"])
    assert len(entries) == part["n_docs"]
    d, offset, _, n = entries[-1]
    found, x = token_records.read_record(part["path"], offset)
    assert (found or 0) == d and len(x) == n


def test_damage_is_found(tmp_path):
    import io

    good = token_records.frame(b"abc")
    assert token_records.unframe(io.BytesIO(good)) == b"abc"
    for i in range(len(good)):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(io.BytesIO(bytes(bad)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert token_records.encode_to_records(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
