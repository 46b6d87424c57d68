"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is filled from a bounded sample of blocks of training documents (``FIT_BLOCKS`` blocks of
``BLOCK`` characters of each language, up to ``DICTIONARY_BYTES``; texts of any length are cut in blocks and every block may be
drawn).  Every whole text is cut into blocks of ``BLOCK`` bytes, so that a text's own history does not
drown the dictionary, and each block is compressed with each dictionary; the language whose total is smallest wins.  A relative
margin to the next language below ``MARGIN`` is narrow: such documents are *rejected* (so are texts without a letter).  Every
language with a training document is learned; the driver gets the blocks that fill its dictionary, no more, and workers get the dictionaries
by broadcast.

The prediction sees the text alone.  Null text or text without a letter: ``und``, score 0, rejected.  Ties go to the language
that has more blocks in the sample, then to the first by name, and have margin 0.  No training rows at all: everything is ``und``.  One language only: margin 1.  Repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hashed_sample, let_go, parts, remainder, texts

UNKNOWN = "und"
FIT_BLOCKS, DICTIONARY_BYTES = 200, 112_640
BLOCK, LEVEL, MARGIN = 4096, 5, 0.002
#: Bits of difference count by so much in the score, as sizes are whole bytes and languages share much.
TEMPER = 0.05
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower case letters, anything else as single spaces: capitals and marks say little of a language but cost bytes."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    """A character that is a letter; digits and numbers of any script, such as superscripts and fractions, are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def dictionaries(docs: DataFrame, wanted: int = FIT_BLOCKS) -> dict[str, bytes]:
    """language -> content, from a bounded sample of blocks of documents with a language; languages with more blocks first.

    Of ``wanted`` blocks drawn of each language the driver gets those, in the order of their hashes, that hold twice the dictionary's characters
    (cleaning takes some) and the one that exceeds it.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and length(text) > 0")
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    pieces = labelled.select("doc_id", "lang", F.posexplode(blocks).alias("block", "piece"))
    drawn = hashed_sample(pieces, wanted, "doc_id", "block", "piece", by="lang", groups=None)
    order = Window.partitionBy("lang").orderBy("hash", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sized = drawn.select("lang", "piece", F.xxhash64("doc_id", "block", "piece").alias("hash")).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)))
    sizes = {r[0]: r[1] for r in sized.groupBy("lang").count().collect()}
    found = sized.where(F.col("before") < 2 * DICTIONARY_BYTES).select("lang", "piece", "hash").collect()
    out: dict[str, bytearray] = {}
    for lang, text, _ in sorted(found, key=lambda r: (r[0], r[2], r[1])):
        own = out.setdefault(lang, bytearray())
        if len(own) < DICTIONARY_BYTES:
            own += plain(text) + b"\n"
    return {k: bytes(v[:DICTIONARY_BYTES]) for k, v in sorted(out.items(), key=lambda x: (-sizes[x[0]], x[0]))}


class Compressors:
    """One compressor for each language; sizes() gives the bytes a text takes with each."""

    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.langs = list(contents)
        self.each = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(contents[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.each]

    def predict(self, text: str) -> tuple[str, float, float]:
        """language, score, margin"""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(plain(text))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = [n for i, n in enumerate(sizes) if i != best]
        if not rest:
            return self.langs[best], 1.0, 1.0
        score = 1.0 / (1.0 + sum(math.exp(max(-60.0, -8 * math.log(2) * TEMPER * (n - sizes[best]))) for n in rest))
        return self.langs[best], score, (min(rest) - sizes[best]) / max(1, min(rest))


SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def identify(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """A row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches):
        let_go()
        own = Compressors(shared.value)
        for b in batches:
            found = [own.predict(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[i] for f in found], schema.field(i + 1).type) for i in range(3)), pa.array([f[2] < MARGIN for f in found], pa.bool_())], schema=schema)
        let_go()

    return texts(docs).mapInArrow(run, SCHEMA)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder(F.col("doc_id"), 3) != 1)


def classify_held_out(docs: DataFrame) -> DataFrame:
    """Dictionaries from the documents that are not held out (crc32 of the id modulo 3 is not 1), predictions for all."""
    found = identify(docs, dictionaries(training_rows(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def recognised(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns as they were."""
    contents = dictionaries(training_rows(docs))

    shared = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches):
        let_go()
        own = Compressors(shared.value)
        for b in parts(batches):
            yield b.filter(pa.array([own.predict(x or "")[2] >= MARGIN for x in b.column("text").to_pylist()], pa.bool_()))
        let_go()

    return docs.mapInArrow(run, docs.schema)
