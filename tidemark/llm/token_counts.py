"""Token counts by a two-tier lookup on the map side.

A byte-level BPE never merges across pre-tokens, so a text's count is a sum over its pieces.  Texts are cut where a single
space or line feed stands between two non-space characters: the library's pre-tokenizer always ends a pre-token there, so
pieces encode alone exactly as within the text.  Tier one is a broadcast table of the lengths of the most frequent pieces of a
bounded sample of documents (``TABLE_ENTRIES`` at most; it only saves work); tier two is each worker's own cache of ``CACHE_ENTRIES``
at most, whose misses the library encodes (pieces of plain letters by its model alone, as they
are one pre-token each).  Pieces are never shuffled.

Null text counts as empty (0 tokens); one long run without such a place is one piece; repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Generations, byte_level, hashed_sample, held, simple, texts, utf8

LIMIT = 1024
TABLE_ENTRIES, TABLE_DOCUMENTS, CACHE_ENTRIES = 65_536, 2000, 600_000

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def pieces(text: str) -> list[str]:
    """Their concatenation is the text, a space before each but the first and those that start with a line feed.

    Pieces come without that space; one that had none (the first, or an odd one) stands behind a NUL mark, and one behind a
    line feed keeps it.  Plain texts, with single spaces and line feeds alone between words, take the fast way.
    """
    if not text:
        return []
    words = text.split()
    if words and len(text) - len("".join(words)) == len(words) - 1 == text.count(" ") + text.count("\n") and "\0" not in text:
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]
        return out
    cut = _CUT.split(text)
    return ["\0" + p if p[:1] != " " or p[1:2] in (" ", "\n", "\0", "") or i == 0 else p[1:] for i, p in enumerate(cut)]


def raw(piece: str) -> str:
    """The stretch of text that a piece stands for."""
    return piece[1:] if piece[0] == "\0" else piece if piece[0] == "\n" else " " + piece


class Lengths(Generations):
    """piece -> number of tokens; misses of the broadcast table and of the cache go to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(CACHE_ENTRIES)
        self.encoder, self.frequent = Tokenizer.from_file(path), {}
        self.encoder.no_padding()
        self.encoder.no_truncation()

    def compute(self, piece: str) -> int:
        n = self.frequent.get(piece)
        if n is not None:
            return n
        if simple(piece):
            return len(self.encoder.model.tokenize(byte_level(" " + piece)))
        if piece[-1] in ".," and piece[:-1].isalpha():  # a mark behind letters is a pre-token, and a token, of its own
            return self[piece[:-1]] + 1
        return len(self.encoder.encode(raw(piece), add_special_tokens=False).ids)


def frequent_pieces(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The lengths of the most frequent pieces of a bounded sample of documents."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(p for p in pieces(t) if len(p) <= 64)
            if len(seen) > 4 * entries:
                seen = Counter(dict(seen.most_common(entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    sample = hashed_sample(texts(docs), TABLE_DOCUMENTS, "doc_id").select("text").coalesce(8)
    total = sample.mapInArrow(count, "piece string, n long").groupBy("piece").sum("n").withColumnRenamed("sum(n)", "n")
    top = [r[0] for r in total.where("n > 1").orderBy("n", "piece", ascending=[False, True]).limit(entries).collect()]
    lengths = Lengths(path)
    return {p: lengths[p] for p in top}


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """A row per document; ``path``: the vocabulary file, there on every executor."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(docs, path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        lengths = held(Lengths, path)
        lengths.frequent = table.value
        for b in batches:
            n_bytes = [len(x) for x in utf8(b.column("text"))]
            n_tokens = []
            own = b.column("text").to_pylist()
            for t in own:
                n_tokens.append(sum(map(lengths.__getitem__, pieces(t))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], schema=schema)

    return texts(docs).mapInArrow(run, SCHEMA)
