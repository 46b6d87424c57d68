"""Personal data by exact patterns plus a skip-chain conditional random field.

Base spans come from four patterns (``base_spans``).  The field then labels every *active* token (a run of non-space
characters holding a digit or an ``@``): neighbours share chain potentials, and distant tokens of one document share skip potentials of two
kinds: *repeats* (the same letters and digits, case and punctuation aside) and *similar* ones (``SIMILAR`` letters and digits or more, at most
one of them changed, added or left out).  A token is linked to its last repeat and to the last token that shares a half with it and proves
similar, so links grow linearly with the text.  Loopy sum-product messages run over the links of a whole batch at once, each document
stopping by its own changes, so that a result depends on its document alone; tokens labelled with enough certainty become further spans
where no base span lies.  Tokens without a digit or ``@`` are outside the field (label: none).

The weights are learned by pseudo-likelihood from a bounded sample of documents (``FIT_DOCUMENTS``, and of each a stretch of ``FIT_TOKENS``
active tokens at a place that its hash gives) whose labels are the base spans.  Each such document is learned from twice: as it is, and
with its base spans rewritten in forms that the patterns miss (``FORMS``) under the same labels, which is what lets the field add spans;
a text of ordinary numbers (``PLAIN``) goes with each, labelled none.
All documents are searched, whole.

Null text counts as empty; empty texts, texts without digits and empty tables give rows without spans or no rows; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, let_go, texts

KINDS = ("email", "ip", "card", "phone")
#: Bound on the documents that the weights are learned from, and on active tokens of each in each of its three versions: 240,000 tokens in all.
FIT_DOCUMENTS, FIT_TOKENS = 2000, 40
#: Least marginal of a label for a further span; rounds of messages; share of the old message kept; change at which a document is settled.
CERTAIN, ROUNDS, DAMPING, SETTLED = 0.9, 12, 0.3, 1e-4
#: Fewest letters and digits of tokens that may be linked as similar.
SIMILAR = 8

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGNAL = re.compile(r"[0-9@]")
_ACTIVE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(digits: str) -> bool:
    """ASCII digits of a value up to 255, however many zeros lead."""
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or "0") <= 255


def _emails(text: str):
    """An address is found from its @: what stands left of it cannot hold another, so this is linear in the text."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _AT.match(text, at) if start < at else None
        if found:
            last = found.end()
            yield start, last
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(map(octet, m.groups())):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


N_FEATURES = 41
_RUNS = re.compile(r"[0-9]+")
#: Words that stand before data of a kind.
CUES = (("mail", "email", "e-mail", "contact", "write"), ("ip", "host", "server", "addr", "address"), ("card", "visa", "account", "paid", "payment"), ("call", "tel", "phone", "fax", "mobile", "ring"))


def features(token: str, near: list[str], cue: str = "") -> list[int]:
    """Indexes of the features that are on; ``near``: the runs of digits of this token and its neighbours, ``cue``: the word before them."""
    core = token.strip(".,;:!?\"'()[]{}<>#*$%&|=")
    own = _RUNS.findall(core)
    digits, all_near = "".join(own), "".join(near)
    n, m = len(digits), len(all_near)
    on = [0, 1 + (0 if n == 0 else 1 if n < 4 else 2 if n == 4 else 3 if n < 9 else 4 if n < 12 else 5 if n < 20 else 6)]
    on.append(8 + (0 if m < 9 else 1 if m < 12 else 2 if m < 16 else 3 if m < 20 else 4))
    left, at, right = core.partition("@")
    sizes, sizes_near = [*map(len, own)], [*map(len, near)]
    quad = len(own) == 4 and all(map(octet, own))
    tests = (
        bool(at), bool(at and left), bool(at and "." in right), len(own) == 4, quad and not any(c.isalpha() for c in core),
        "+" in core, token[:1] == "(" or ")" in token, "-" in core, n == len(core) and n > 0, any(c.isalpha() for c in core), 12 <= m <= 19 and luhn(all_near), 12 <= n <= 19 and luhn(digits), n > 0 and any(c.isalpha() for c in core),
        bool(at and "," in right), bool(at and right and "." not in right), sizes == [4, 4, 4, 4], sizes_near == [4, 4, 4, 4], sizes_near[-3:] == [3, 3, 4], sizes[-3:] == [3, 3, 4], sizes[-2:] == [3, 4],
        n > 0 and ("," in core or "[" in core), n > 0 and "." in core, n > 0 and ("/" in core or "_" in core), core[:2] == "00" and n > 8,
    )
    return on + [13 + i for i, yes in enumerate(tests) if yes] + [37 + i for i, words in enumerate(CUES) if cue in words]


def one_apart(a: str, b: str) -> bool:
    """Equal but for one character changed, added or left out."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def lattice(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Places and features of the active tokens, chain links and skip links.  Linear in the text."""
    at = [m.span() for m in _ACTIVE.finditer(text)]
    on, chain, skip = [], [], []
    seen: dict[str, int] = {}
    halves: dict[tuple, tuple[int, str]] = {}
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1][0] - at[j][1] == 1:
            j += 1
        own = [text[s:e] for s, e in at[i : j + 1]]
        before = text[max(0, at[i][0] - 24) : at[i][0]].lower().split()
        cue = before[-1].strip(".,;:!?\"'()") if before else ""
        # A token's surroundings: up to four tokens either side, so that a long run of numbers stays linear.
        near = [_RUNS.findall(t) for t in own]
        for k, t in enumerate(own):
            on.append(features(t, [d for x in near[max(0, k - 4) : k + 5] for d in x], cue))
            if k:
                chain.append((i + k - 1, i + k))
            key = "".join(filter(str.isalnum, t.lower()))
            if len(key) < 4:
                continue
            if key in seen:
                skip.append((seen[key], i + k))
            elif len(key) >= SIMILAR:
                # One character apart, two keys share their first or their last half.
                for h in {(len(key) - 1) // 2, len(key) // 2, (len(key) + 1) // 2}:
                    found = [halves[x] for x in ((h, 0, key[:h]), (h, 1, key[-h:])) if x in halves]
                    if like := [p for p, other in found if one_apart(key, other)]:
                        skip.append((max(like), i + k))
                        break
            seen[key] = i + k
            if len(key) >= SIMILAR:
                h = len(key) // 2
                halves[h, 0, key[:h]] = halves[h, 1, key[-h:]] = (i + k, key)
        i = j + 1
    return at, on, chain, skip


#: Forms of each kind that the patterns miss.
FORMS = (
    (lambda s: s.partition("@")[0] + "@" + s.partition("@")[2].partition(".")[0], lambda s: s.partition("@")[0] + "@" + s.partition("@")[2].replace(".", ",")),
    (lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", "(.)"), lambda s: s.replace(".", ","), lambda s: s.replace(".", "/"), lambda s: s.replace(".", "_")),
    (lambda s: _fours(s, "."), lambda s: _fours(s, "/"), lambda s: _fours(s, "_")),
    (lambda s: s.lstrip("+").partition(" ")[2] or s.lstrip("+"), lambda s: ".".join(_RUNS.findall(s)[1:]) or s.lstrip("+"), lambda s: "00" + "".join(_RUNS.findall(s)), lambda s: " ".join(_RUNS.findall(s)), lambda s: ".".join(_RUNS.findall(s)[-2:])),
)


def _fours(span: str, mark: str) -> str:
    digits = "".join(_RUNS.findall(span))
    return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def altered(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans (those that overlap none before them) in forms that the patterns miss, and where they stand then."""
    parts, out, done, at = [], [], 0, 0
    for s, k, e in spans:
        if s < done:
            continue
        forms = FORMS[k]
        new = forms[zlib.crc32(text[s:e].encode("utf-8", "surrogatepass")) % len(forms)](text[s:e])
        parts += [text[done:s], new]
        at += s - done
        out.append((at, k, at + len(new)))
        at, done = at + len(new), e
    return "".join(parts) + text[done:], out


#: Ordinary numbers, {a} of one or two digits, {b} of three, {c} of four.
PLAIN = ("{a}", "{b}", "{c}", "{a}.{a}", "{a},{b}", "{a},{b},{b}", "{a}:{a}", "{c}-{a}-{a}", "{a}/{a}/{c}", "{a}%", "${a}.99", "v{a}.{a}.{a}", "{a}-{a}", "x{b}", "{a}th", "{c}s", "@name{a}", "({c})", "{b}{b}", "{a} {b} {c}", "{c} {c}", "#{c}{b}", "{b}.{a}{a}")


def plain_numbers(seed: int) -> str:
    """A text of ordinary numbers, none of them personal, so that the field learns to leave such alone."""
    out = []
    for i in range(12):
        seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
        out.append("word " + PLAIN[(seed >> 8) % len(PLAIN)].format(a=1 + (seed >> 4) % 60, b=100 + (seed >> 6) % 900, c=1000 + (seed >> 5) % 9000))
    return " and ".join(out)


def stretch(found: tuple, y: list[int], start: int, most: int) -> tuple:
    """Features, labels and links of ``most`` tokens from a place on."""
    _, on, chain, skip = found
    own = lambda links: [(a - start, b - start) for a, b in links if a >= start and b < start + most]
    return on[start : start + most], y[start : start + most], own(chain), own(skip)


def labels(at: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """0 or 1 + the kind of the base span that covers most of each token; both lists ascend."""
    out, first = [], 0
    for s, e in at:
        while first < len(spans) and spans[first][2] <= s:
            first += 1
        best, label, k = 0, 0, first
        while k < len(spans) and spans[k][0] < e:
            over = min(e, spans[k][2]) - max(s, spans[k][0])
            if over > best:
                best, label = over, 1 + spans[k][1]
            k += 1
        out.append(label)
    return out


def _dense(on: list[list[int]]) -> np.ndarray:
    """A byte for each feature of each token."""
    x = np.zeros((len(on), N_FEATURES), dtype=np.uint8)
    x[np.repeat(np.arange(len(on)), [len(own) for own in on]), [f for own in on for f in own]] = 1
    return x


def fit(documents: list[tuple[list[list[int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]], steps: int = 200) -> dict:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels, by gradient steps with momentum."""
    k = 1 + len(KINDS)
    model = {"unary": np.zeros((N_FEATURES, k)), "chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
    on, y, chain, skip = [], [], [], []
    for own, own_y, c, s in documents:
        base = len(y)
        on += own
        y += own_y
        chain += [(a + base, b + base) for a, b in c]
        skip += [(a + base, b + base) for a, b in s]
    if not y:
        model["unary"][0, 0] = 8.0
        return model
    y = np.array(y)
    hot = np.eye(k)[y]
    c, s = (np.array(e, dtype=np.int64).reshape(-1, 2) for e in (chain, skip))
    before, after, like = np.zeros((len(y), k)), np.zeros((len(y), k)), np.zeros((len(y), k))
    np.add.at(before, c[:, 1], hot[c[:, 0]])
    np.add.at(after, c[:, 0], hot[c[:, 1]])
    np.add.at(like, s[:, 1], hot[s[:, 0]])
    np.add.at(like, s[:, 0], hot[s[:, 1]])
    # tokens that look alike, have one label and neighbours of the same labels are one row with a weight
    bits = np.packbits(_dense(on), axis=1)
    _, first, times = np.unique(np.concatenate([bits, *(m.astype(np.uint8) for m in (before, after, np.minimum(like, 255), y[:, None]))], axis=1), axis=0, return_index=True, return_counts=True)
    weight, total = times[:, None].astype(float), len(y)
    x, hot, before, after, like = np.unpackbits(bits[first], axis=1, count=N_FEATURES).astype(float), hot[first], before[first], after[first], like[first]
    speed = {n: np.zeros_like(v) for n, v in model.items()}
    for _ in range(steps):
        z = x @ model["unary"] + before @ model["chain"] + after @ model["chain"].T + like @ model["skip"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        d = weight * (hot - p) / total
        slope = {"unary": x.T @ d, "chain": before.T @ d + d.T @ after, "skip": (like.T @ d + d.T @ like) / 2}
        for n in model:
            speed[n] = 0.9 * speed[n] + slope[n] - 1e-4 * model[n]
            model[n] = model[n] + 2.0 * speed[n]
    return model


def potentials(on: list[list[int]], model: dict) -> np.ndarray:
    """Log potentials of the tokens: each the sum of its own rows of weights, whatever stands beside it in the batch."""
    if not on:
        return np.zeros((0, 1 + len(KINDS)))
    lengths = np.array([len(x) for x in on])
    return np.add.reduceat(model["unary"][np.concatenate(on)], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)


def marginals(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, model: dict, of: np.ndarray | None = None, restless: set | None = None) -> np.ndarray:
    """Loopy sum-product over all links at once; unary: log potentials, links: pairs of rows, ``of``: the document of each row.

    A document whose messages have settled keeps them, so that it makes no difference which documents it shares a batch with.  Those whose
    messages still move after the last round are put in ``restless``.
    """
    n, k = unary.shape
    links = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2)
    if not len(links):
        return _softmax(unary)
    pots = np.concatenate([np.repeat(np.exp(model["chain"])[None], len(chain), 0), np.repeat(np.exp((model["skip"] + model["skip"].T) / 2)[None], len(skip), 0)])
    src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    pots = np.concatenate([pots, pots.transpose(0, 2, 1)])  # (message, from, to)
    back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
    document = np.zeros(len(src), np.int64) if of is None else of[src]
    moving = np.ones(document.max() + 1, bool)
    msg = np.full((len(src), k), -np.log(k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        out -= out.max(1, keepdims=True)
        new = np.log(np.einsum("mi,mij->mj", np.exp(out), pots) + 1e-300)
        new -= np.log(np.exp(new - new.max(1, keepdims=True)).sum(1, keepdims=True)) + new.max(1, keepdims=True)
        moved = np.zeros(len(moving))
        np.maximum.at(moved, document, np.abs(new - msg).max(1))
        msg = np.where(moving[document][:, None], DAMPING * msg + (1 - DAMPING) * new, msg)
        moving &= moved >= SETTLED
        if not moving.any():
            break
    if restless is not None:
        restless.update(np.intersect1d(moving.nonzero()[0], document).tolist())
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return p / p.sum(1, keepdims=True) if len(z) else z


_TRIM = ".,;:!?\"'[]{}<>#*$%&|="


def further(text: str, at: list[tuple[int, int]], p: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of certain labels that touch no base span; neighbours of one label join."""
    out: list[list[int]] = []
    first = 0
    for (s, e), row in zip(at, p, strict=True):
        k = int(row.argmax())
        if k == 0 or row[k] < CERTAIN:
            continue
        while first < len(base) and base[first][2] <= s:
            first += 1
        if first < len(base) and base[first][0] < e:
            continue
        while s < e and text[s] in _TRIM:
            s += 1
        while e > s and text[e - 1] in _TRIM:
            e -= 1
        if s == e:
            continue
        if out and out[-1][1] == k - 1 and s - out[-1][2] == 1:
            out[-1][2] = e
        else:
            out.append([s, k - 1, e])
    return [tuple(x) for x in out]


def tag(found: list[str], model: dict, restless: set | None = None) -> list[tuple[list, list]]:
    """Base and further spans of each text; one field over all of the batch's documents, with no links between them.  ``restless`` gets the
    numbers of the texts whose messages had not settled in ``ROUNDS`` rounds."""
    base, places, on, chain, skip, starts = [], [], [], [], [], []
    for text in found:
        own = base_spans(text) if _SIGNAL.search(text) else []
        base.append(own)
        starts.append(len(on))
        if not _SIGNAL.search(text):
            places.append([])
            continue
        at, x, c, s = lattice(text)
        places.append(at)
        chain += [(a + len(on), b + len(on)) for a, b in c]
        skip += [(a + len(on), b + len(on)) for a, b in s]
        on += x
    of = np.repeat(np.arange(len(found)), [len(x) for x in places])
    p = marginals(potentials(on, model), np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(skip, dtype=np.int64).reshape(-1, 2), model, of, restless)
    return [(b, further(t, at, p[i : i + len(at)], b)) for t, b, at, i in zip(found, base, places, starts, strict=True)]


def learn(docs: DataFrame, wanted: int = FIT_DOCUMENTS) -> dict:
    """Weights from a bounded sample; executors send packed lattices, no texts."""
    import pickle

    def lattices(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                seed = zlib.crc32(t.encode("utf-8", "surrogatepass"))
                versions = [(t, base), (plain_numbers(seed), [])] + ([altered(t, base)] if base else [])
                for own, spans in versions:
                    found = lattice(own)
                    y = labels(found[0], spans)
                    out.append(pickle.dumps(stretch(found, y, seed % max(1, len(y) - FIT_TOKENS + 1), FIT_TOKENS)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["x"])

    signal = texts(docs).where(F.col("text").rlike("[0-9@]"))
    rows = hashed_sample(signal, wanted, "doc_id", "text").select("text").mapInArrow(lattices, "x binary").collect()
    return fit([pickle.loads(x) for x in sorted(bytes(r[0]) for r in rows)])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, settled boolean"


def find_personal_data(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """A row per document: counts of base spans, their digest, all spans, and whether the messages of its field had settled."""
    known = model if model is not None else learn(docs)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("settled", pa.bool_())])

    def run(batches):
        let_go()
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                cols: list[list] = [part.column("doc_id").to_pylist(), [], [], [], [], [], [], [], []]
                restless: set[int] = set()
                for row, (base, more) in enumerate(tag(part.column("text").to_pylist(), known, restless)):
                    for k in range(4):
                        cols[1 + k].append(sum(x[1] == k for x in base))
                    cols[5].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    cols[6].append(joined(sorted(base + more)))
                    cols[7].append(len(more))
                    cols[8].append(row not in restless)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return texts(docs).mapInArrow(run, SCHEMA)
