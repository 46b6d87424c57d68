"""Token ids as length-delimited binary records with a separate offset index.

File format, all little-endian.  ``part-NNNNN.rec`` is a sequence of frames: u64 length of the payload, u32 masked crc32 of those eight
bytes, the payload, u32 masked crc32 of the payload.  A payload is i64 doc_id, u8 flags (1: the id is null; 2: ids are u32, else
u16), then the ids.  The mask rotates a crc right by 15 bits and adds 0xa282ead8, so that checksums of data which hold checksums stay
useful.  ``part-NNNNN.idx`` holds a fixed-width entry per record (i64 doc_id, u64 offset of the frame, u64 ids before it in the file, u32
number of ids), and at last a u32 masked crc32 of the entries: a reader that wants shuffled records seeks by it
(``read_record``).  Parts ascend by doc_id and so do the records in them.

Documents are dealt to parts by ranges of (doc_id, hash of the text); each task encodes, writes under a name of its attempt and
renames, so a task that runs again leaves the same file.  White space is dropped by this vocabulary's pre-tokenizer, so words encode
alone as within the text; a bounded worker cache keeps their ids, and the library encodes the misses (words of plain letters by its model
alone, as they are one pre-token each).

Null text counts as empty (the end id alone); null doc_ids come first; repeated doc_ids are all written, ordered by a hash of
the text; an empty table gives no parts and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Generations, byte_level, held, kept, shared_path, simple, texts, trimmed

END_ID = 1
CACHE_ENTRIES = 700_000
_ODD = re.compile("[\x1c-\x1f]")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> bytes | None:
    """The next payload, None at the end; raises on damage."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("record cut off in its head")
    n, crc = struct.unpack("<QI", head)
    if masked(head[:8]) != crc:
        raise ValueError("damaged record length")
    body = stream.read(n + 4)
    if len(body) < n + 4:
        raise ValueError("record cut off")
    payload = body[:n]
    if masked(payload) != int.from_bytes(body[n:], "little"):
        raise ValueError("damaged record")
    return payload


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from("<qB", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


class WordIds(Generations):
    """word -> its ids as bytes; misses go to the library."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__(entries)
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.kind = "<u2" if self.encoder.get_vocab_size() <= 1 << 16 else "<u4"

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.kind == "<u2" else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def compute(self, word: str) -> bytes:
        if simple(word):
            return self._bytes([x.id for x in self.encoder.model.tokenize(byte_level(word.lower()))])
        if word[-1] in ".," and simple(word[:-1]):  # a mark behind letters is a pre-token of its own
            return self[word[:-1]] + self[word[-1]]
        return self._bytes(self.encoder.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        words = text.split(" ") if _ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, filter(None, words)))


def write_records(docs: DataFrame, path: str, to: str, end_id: int = END_ID, cache: int = CACHE_ENTRIES) -> DataFrame:
    """Encode and write all documents under the folder ``to``; returns the manifest, a row per part in order of doc_id."""
    spark = docs.sparkSession
    dealt = texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        trimmed()
        words, task = None, TaskContext.get()
        name, at, n_docs, n_ids = f"part-{task.partitionId():05d}", 0, 0, 0
        place = out = index = store = None
        for b in batches:
            if b.num_rows and out is None:
                words, (store, root) = held(WordIds, path, cache), fs.FileSystem.from_uri(to)
                place = f"{root}/{name}"
                store.create_dir(root, recursive=True)
                mine = f"{place}.try{task.taskAttemptId()}"
                out, index = store.open_output_stream(f"{mine}.rec", buffer_size=1 << 20), bytearray()
                wide = words.kind == "<u4"
                end = np.array([end_id], words.kind).tobytes()
                width = len(end)
            ids, own = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for d, t in zip(ids, own, strict=True):
                x = words.encode(t)
                record = frame(struct.pack("<qB", d or 0, (d is None) + 2 * wide) + x + end)
                n = len(x) // width + 1
                index += struct.pack("<qQQI", d or 0, at, n_ids, n)
                out.write(record)
                at, n_docs, n_ids = at + len(record), n_docs + 1, n_ids + n
        if out is not None:
            out.close()
            with store.open_output_stream(f"{mine}.idx") as f:
                f.write(bytes(index) + struct.pack("<I", masked(bytes(index))))
            for kind in ("idx", "rec"):
                store.move(f"{mine}.{kind}", f"{place}.{kind}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{to}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([at], pa.int64())], ["part", "path", "n_docs", "n_ids", "n_bytes"])
        ids = own = record = x = index = None
        trimmed()

    written = dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long, n_bytes long")
    return kept(written, spark, "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per record, read back from the files with every checksum tested: doc_id, start, n_tokens, ids_crc32, part, offset.

    The manifest has a row per file, so its running sum is computed on the driver.
    """
    parts = sorted(manifest.select("part", "path", "n_ids").collect())
    before, rows = 0, []
    for part, path, n in parts:
        rows.append((part, path, before))
        before += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("offset", pa.int64())])

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for part, path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, place = fs.FileSystem.from_uri(f"{path}.rec")
                cols: list[list] = [[], [], [], [], []]
                with store.open_input_stream(place, buffer_size=1 << 20) as f:
                    at = 0
                    while (payload := unframe(f)) is not None:
                        d, ids = parse(payload)
                        for c, v in zip(cols, (d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), at), strict=True):
                            c.append(v)
                        start += len(ids)
                        at += len(payload) + 16
                        if len(cols[0]) == 10_000:
                            yield _batch(cols, part, schema)
                            cols = [[], [], [], [], []]
                yield _batch(cols, part, schema)

    frame_ = spark.createDataFrame(rows, "part int, path string, start long").repartition(max(1, len(rows)), "part")
    return frame_.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, offset long")


def _batch(cols: list[list], part: int, schema: pa.Schema) -> pa.RecordBatch:
    c = [*cols[:4], [part] * len(cols[0]), cols[4]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(c, schema, strict=True)], schema=schema)


def read_index(path: str) -> list[tuple[int, int, int, int]]:
    """The entries of a part's index (its path without a suffix): doc_id, offset, ids before it in the part, number of ids."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(f"{path}.idx")
    with store.open_input_stream(place) as f:
        data = f.read()
    if masked(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("damaged index")
    return list(struct.iter_unpack("<qQQI", data[:-4]))


def read_record(path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset, for shuffled reads."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(f"{path}.rec")
    with store.open_input_file(place) as f:
        f.seek(offset)
        return parse(unframe(f))


def encode_to_records(docs: DataFrame, path: str, cache: int = CACHE_ENTRIES) -> DataFrame:
    """Write all documents to the shared folder and return what the files hold, a row per document; ``cache``: words that a worker keeps, which
    changes its memory and time alone."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, path, shared_path(spark, "records"), cache=cache))
