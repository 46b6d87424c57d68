"""Byte-level BPE by dynamic programming over prefixes, with exact appends, re-encoding near edits, and decoding.

Merging by ranks leaves two tokens side by side just where merging their bytes alone gives the same two (a *valid* pair), and a sequence whose
neighbours are all valid is the encoding of its bytes.  So each prefix of a pre-token has one last token: of the tokens that end there, the one
that is valid behind the last token of the prefix before it.  ``Prefixes`` stores that last token for each byte.  An append only adds entries.
An edit computes entries from its place on, until as many of them in a row as the longest token has bytes equal the old ones: all later ones
then do.  The tokens that end at each byte come from an automaton, pairs are checked once by plain merging and kept, so the work is linear.

A pre-token that is itself in the vocabulary is that one token, as in the library.  Texts are cut into pieces where a pre-token always ends
(``token_counts.pieces``); workers keep the ids of frequent pieces, pieces are never shuffled.  Null text counts as empty (no ids, the digest of
no bytes); long runs without a place to cut are one piece; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, held, simple, texts
from .token_counts import _CUT, pieces, raw

PIECES, PAIRS = 800_000, 1_000_000


class _Pairs(Generations):
    """(left token << 32 | right token) -> whether merging their bytes leaves these two."""

    def __init__(self, coder: Coder):
        super().__init__(PAIRS)
        self.coder = coder

    def fits(self, key) -> bool:
        return True

    def compute(self, key) -> bool:
        tokens = self.coder.tokens
        return self.coder.merged(tokens[key >> 32], tokens[key & 0xFFFFFFFF]) == 2


class Coder:
    """The ranks of one vocabulary file (a base64 token and its rank a line), and what is looked up in them."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.ends, self.longest = ahocorasick.Automaton(), max(map(len, self.ranks))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.ends.add_word(token.decode("latin-1"), (len(token), rank))
        self.ends.make_automaton()
        self.pairs, self.alone = _Pairs(self), {}

    def merged(self, left: bytes, right: bytes = b"") -> int:
        """How many parts plain merging (lowest rank first, leftmost among equals) leaves of a token's or two tokens' bytes; 0 where it joins bytes
        across the two."""
        ranks, none = self.ranks.get, 1 << 40
        data, cut = left + right, len(left)
        own = [data[i : i + 1] for i in range(len(data))]
        joined = [ranks(a + b, none) for a, b in zip(own, own[1:], strict=False)]
        while joined:
            least = min(joined)
            if least == none:
                break
            i = joined.index(least)
            if i < cut - 1:
                cut -= 1
            elif i == cut - 1 and right:
                return 0
            own[i : i + 2] = [own[i] + own[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = ranks(own[i - 1] + own[i], none)
            if i < len(joined):
                joined[i] = ranks(own[i] + own[i + 1], none)
        return len(own)

    def reachable(self, token: int) -> bool:
        """Whether merging makes the token of its own bytes."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merged(self.tokens[token]) == 1
        return found

    def encode(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self, data).ids()

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """A pre-token's bytes and, for each of its prefixes, the last token of the prefix's encoding."""

    def __init__(self, coder: Coder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [-1]
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        n = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(n, len(self.data))

    def _fill(self, start: int, stop: int) -> None:
        """The entries of the prefixes of start + 1 to stop bytes; those before are there."""
        last, pairs, reachable = self.last, self.coder.pairs, self.coder.reachable
        base = max(0, start + 1 - self.coder.longest)
        for end, (length, token) in self.coder.ends.iter(self.data[base:stop].decode("latin-1")):
            end += base + 1
            if end > start and last[end] < 0:
                begin = end - length
                if pairs[last[begin] << 32 | token] if begin else reachable(token):
                    last[end] = token

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; how many entries had to be computed."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        n, done, same = len(self.data), start, 0
        self.last = old[: start + 1] + [-1] * (n - start)
        step = 2 * self.coder.longest
        while done < n:
            to = min(n, max(done, start + len(new)) + step)
            self._fill(done, to)
            for i in range(max(done, start + len(new)) + 1, to + 1):
                same = same + 1 if self.last[i] == old[i - shift] else 0
                if same >= self.coder.longest:
                    self.last[i + 1 :] = old[i - shift + 1 :]
                    return to - start
            done = to
        return n - start

    def ids(self) -> list[int]:
        whole = self.coder.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.coder.tokens[out[-1]])
        return out[::-1]


class Pieces(Generations):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__(PIECES)
        self.coder, self.split = Coder(path), regex.compile(pattern).findall

    def compute(self, piece: str) -> bytes:
        if simple(piece):
            return packed(self.coder.encode(b" " + piece.encode()))
        if piece[-1] in ".," and simple(piece[:-1]):  # a mark behind letters is a pre-token of its own
            return self[piece[:-1]] + packed(self.coder.encode(piece[-1].encode()))
        return packed([i for w in self.split(raw(piece)) for i in self.coder.encode(w.encode())])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pieces(text)))


def packed(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def unpacked(ids: bytes) -> list[int]:
    import numpy as np

    return np.frombuffer(ids, "<u4").tolist()


def reencoded(own: Pieces, text: str, ids: bytes, start: int, stop: int, new: str) -> tuple[str, bytes]:
    """The text with code points start to stop replaced, and its ids: ids left of the last safe cut before the edit and right of the first one
    behind it stay, the stretch between is encoded anew.  A cut is safe where the three code points that make it are not touched."""
    start, stop = max(0, min(start, len(text))), max(0, min(max(start, stop), len(text)))
    left, right, span = 0, len(text), 512
    while start > 2 and left == 0:
        low = max(0, start - span)
        left = max((m.start() for m in _CUT.finditer(text, low, start) if m.start() + 2 <= start and m.start() > low), default=0)
        if low == 0:
            break
        span *= 8
    found = _CUT.search(text, stop + 1) if stop + 1 < len(text) else None
    if found:
        right = found.start()
    # each cut splits the ids where as many bytes are behind it as the text has there
    def place(code_points: int) -> int:
        want, n = len(text[:code_points].encode()), 0
        lengths = [len(own.coder.tokens[i]) for i in unpacked(ids)]
        for k, length in enumerate(lengths):
            if n == want:
                return k
            n += length
        return len(lengths)

    middle = own.encode(text[left:start] + new + text[stop:right])
    return text[:start] + new + text[stop:], ids[: 4 * place(left)] + middle + ids[4 * place(right) :]


def _mapped(docs: DataFrame, schema: str, columns: pa.Schema, path: str, pattern: str, rows) -> DataFrame:
    """rows(coder, batch) -> columns, for each Arrow batch; pieces stay with the worker from task to task."""

    def run(batches):
        own = held(Pieces, path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays(rows(own, b), schema=columns)

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of each whole text."""
    columns = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def rows(own, b):
        return [b.column("doc_id"), pa.array([unpacked(own.encode(t)) for t in b.column("text").to_pylist()], columns.field("ids").type)]

    return _mapped(texts(docs), "doc_id long, ids array<int>", columns, path, pattern, rows)


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) of each row's ids; null ids are none."""
    columns = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def rows(own, b):
        return [b.column("doc_id"), pa.array([own.coder.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())]

    return _mapped(ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), "doc_id long, data binary", columns, path, pattern, rows)


def edited(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, ids after an edit a row: columns doc_id, text, ids (of that text), start, stop (code points) and new.

    A null text or ``new`` is empty, a null place is the end (an append), places beyond the end are the end.
    """
    columns = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32()))])
    end = F.length("text")
    own_rows = texts(rows, "ids", "start", "stop", "new").select("doc_id", "text", F.col("ids").cast("array<int>").alias("ids"), F.coalesce(F.col("start").cast("int"), end).alias("start"), F.coalesce(F.col("stop").cast("int"), end).alias("stop"), F.coalesce("new", F.lit("")).alias("new"))

    def change(own, b):
        out = [reencoded(own, t, packed(i or []), a, z, n) for t, i, a, z, n in zip(*(b.column(c).to_pylist() for c in ("text", "ids", "start", "stop", "new")), strict=True)]
        return [b.column("doc_id"), pa.array([t for t, _ in out], pa.string()), pa.array([unpacked(i) for _, i in out], columns.field("ids").type)]

    return _mapped(own_rows, "doc_id long, text string, ids array<int>", columns, path, pattern, change)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, the ids decoded, and both digested in the same task."""
    columns = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(own, b):
        n, ids_sha, data_sha = [], [], []
        for t in b.column("text").to_pylist():
            ids = own.encode(t)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            data_sha.append(hashlib.sha256(own.coder.decode(memoryview(ids).cast("I"))).hexdigest())
        return [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]

    return _mapped(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns, path, pattern, rows)
