"""Mixing to target weights with soft domain membership.

A multinomial logistic classifier over hashed words learns domains from a labelled table (a bounded sample of it, ``FIT_ROWS``) and gives each
document posteriors p over the domains.  With n words in a document, rates r >= 0 (at most ``cap``) minimise

    1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / (m_k S)  +  damp / 2 sum_d n_d (r_d - 1)^2 / S

where T_k are the target totals, m_k the domain's present share and S all words.  A projected gradient step in the metric of n_d is
r <- clip(r - (p . e + damp (r - 1))), e_k = (M_k - T_k) / (m_k S); its Hessian's largest eigenvalue is at most 1 + damp, so a unit step
converges.  As r starts at 1, a document's rate is a function of p and of the residuals so far: each round is one aggregation of K
sums over the written table of (n, p, r), r being the rate after the first rounds; every ``REWRITE`` rounds the table is written anew, so that
a round's work does not grow, and nothing but K numbers is on the driver.  It ends when each domain's total is within ``CLOSE`` of its own
target, when no total moves by ``STILL`` of its target in a round any more (rates may be at their bounds, and posteriors that overlap may make a
target unreachable), or after ``ROUNDS``; ``gap`` and ``converged`` say how it ended.

Null or empty texts have n = 0 and take the rate of their (bias-only) posterior.  Labels without a document, repeated labels (the least
domain counts), documents that share an id (the one whose text hashes lowest is learned from) and null labels are allowed; no usable labels: one domain, rates 1.  Null ids are rated; repeated rows are rated alike;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, hashed_sample, kept, let_go, parts, texts, utf8, written

FIT_ROWS, BITS, STEPS, RIDGE = 3000, 14, 80, 1e-3
ROUNDS, REWRITE, CLOSE, STILL, DAMP = 60, 12, 0.01, 1e-3, 1e-3
#: Production targets: shares of words by (quality, toxic) label.
TARGETS = {"q1t0": 0.90, "q0t0": 0.06, "q1t1": 0.03, "q0t1": 0.01}


def features(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, features that are on, their weights (root counts, of unit length)."""
    own = text.lower().split()
    if not own:
        return 0, np.empty(0, np.int64), np.empty(0, np.float32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    counts = np.bincount((hashes >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    w = np.sqrt(counts[at], dtype=np.float32)
    return len(own), at, w / np.sqrt((w * w).sum())


class Classifier:
    def __init__(self, domains: list[str]):
        self.domains = domains
        self.w, self.b = np.zeros((1 << BITS, len(domains)), np.float32), np.zeros(len(domains), np.float32)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Classifier:
        """rows: (domain, features, weights); gradient steps with momentum on the mean log loss, features scaled up for speed."""
        rows = [r for r in rows if len(r[1])]
        if not rows or len(self.domains) == 1:
            return self
        y = np.array([r[0] for r in rows])
        lengths = np.array([len(r[1]) for r in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at, x = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        doc = np.repeat(np.arange(len(rows)), lengths)
        k = len(self.domains)
        hot = np.eye(k, dtype=np.float32)[y]
        self.b = np.log((hot.sum(0) + 0.5) / (len(y) + 0.5 * k)).astype(np.float32)
        speed_w, speed_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(STEPS):
            z = np.add.reduceat(self.w[at] * x[:, None], starts, axis=0) + self.b
            d = (hot - softmax(z)) / len(y)
            spread = d[doc] * x[:, None]
            slope = np.stack([np.bincount(at, spread[:, c], 1 << BITS) for c in range(k)], 1)
            speed_w = 0.9 * speed_w + slope - RIDGE / len(y) * self.w
            speed_b = 0.9 * speed_b + d.sum(0)
            self.w += (20.0 * speed_w).astype(np.float32)
            self.b += (0.5 * speed_b).astype(np.float32)
        return self

    def posterior(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return softmax((x[:, None] * self.w[at]).sum(0) + self.b)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the quality and toxic marks."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def learn(docs: DataFrame, domains: DataFrame, wanted: int = FIT_ROWS) -> Classifier:
    """domains: doc_id, domain.  The sample of labels is bounded, so it goes by broadcast; executors send features, no texts."""
    sample = hashed_sample(domains.groupBy("doc_id").agg(F.min("domain").alias("domain")), wanted, "doc_id")

    def run(batches):
        for b in batches:
            own = [features(t) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array([a.astype("<u4").tobytes() for _, a, _ in own], pa.binary()), pa.array([w.tobytes() for _, _, w in own], pa.binary())], ["domain", "at", "w"])

    own = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "domain", "text")).alias("m"))
    rows = own.select("m.domain", "m.text").mapInArrow(run, "domain string, at binary, w binary").collect()
    names = sorted({r[0] for r in rows}) or ["all"]
    place = {d: i for i, d in enumerate(names)}
    found = sorted((place[r[0]], bytes(r[1]), bytes(r[2])) for r in rows)
    return Classifier(names).fit([(y, np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(w, np.float32)) for y, a, w in found])


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens, p: one pass, no exchange."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go()
        m = known.value
        for b in parts(batches):
            n_tokens, p = [], []
            for t in utf8(b.column("text")):  # one text's features at a time
                n, at, w = features(t)
                n_tokens.append(n)
                p.append(m.posterior(at, w).astype(np.float64).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])
        let_go()

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rates(p: np.ndarray, residuals: np.ndarray, cap: float, r: np.ndarray | None = None) -> np.ndarray:
    """Rates of rows of posteriors after the steps with these residuals, from r (1) on."""
    r = np.ones(len(p)) if r is None else r
    for e in residuals:
        r = np.clip(r - (p @ e + DAMP * (r - 1)), 0.0, cap)
    return r


def _rows(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column("p").flatten().to_numpy().reshape(b.num_rows, k), b.column("r").to_numpy()


def _totals(members: DataFrame, residuals: np.ndarray, cap: float, k: int) -> np.ndarray:
    """Words of each domain expected at the present rates.  Tasks give whole numbers (of 2^-40 of a word), so their sum has no order."""

    def run(batches):
        sums = np.zeros(k)
        for b in batches:
            if b.num_rows:
                p, r = _rows(b, k)
                sums += (rates(p, residuals, cap, r) * b.column("n_tokens").to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([Decimal(round(float(x) * (1 << 40))) for x in sums], pa.decimal128(38, 0))], ["k", "m"])

    found = members.select("n_tokens", "p", "r").mapInArrow(run, "k int, m decimal(38,0)").groupBy("k").agg(F.sum("m").alias("m")).collect()
    out = np.zeros(k)
    for r in found:
        out[r[0]] = int(r[1]) / (1 << 40)
    return out


def _stepped(members: DataFrame, residuals: np.ndarray, cap: float, k: int) -> DataFrame:
    """The members with their rates after these steps."""

    def run(batches):
        for b in batches:
            p, r = _rows(b, k)
            r = rates(p, residuals, cap, r)
            yield b.set_column(b.schema.get_field_index("r"), "r", pa.array(r, pa.float64()))

    return members.mapInArrow(run, members.schema)


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], cap: float = float("inf"), shrink: bool = False) -> tuple[np.ndarray, float]:
    """The residuals of all rounds, and the largest miss of a domain's total, as a share of its target.  Targets are shares of words, of as many
    words as there are, or, if ``shrink``, of the most words that need no rate above 1 in any domain.  Domains without a target keep their
    present share of the rest."""
    spark, k = members.sparkSession, len(domains)
    members = members.select("n_tokens", "p").withColumn("r", F.lit(1.0))
    past: list[np.ndarray] = []
    now = _totals(members, np.zeros((0, k)), cap, k)
    all_words = now.sum()
    if all_words == 0 or k == 1:
        return np.zeros((0, k)), 0.0
    share = np.maximum(now / all_words, 1e-9)
    named = np.array([d in targets for d in domains])
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    rest = max(0.0, 1.0 - want.sum()) if (~named).any() else 0.0
    want = want + np.where(named, 0.0, rest * share / max(1e-12, share[~named].sum()))
    if want.sum() <= 0:
        return np.zeros((0, k)), 0.0
    want = want / want.sum()
    size = all_words * min([1.0, *(share[i] / want[i] for i in range(k) if want[i] > 0)]) if shrink else all_words
    goal = want * size
    gap = lambda: float((np.abs(now - goal) / np.maximum(goal, 1e-6 * all_words)).max())
    done, path, moved = 0, None, float("inf")
    while gap() > CLOSE and moved > STILL and len(past) < ROUNDS:
        if len(past) - done == REWRITE:
            old = path
            members, path = written(_stepped(members, np.array(past[done:]), cap, k), spark, "rates")
            done = len(past)
            if old:
                drop(spark, old)
        past.append((now - goal) / (share * all_words))
        was, now = now, _totals(members, np.array(past[done:]), cap, k)
        moved = float((np.abs(now - was) / np.maximum(goal, 1e-6 * all_words)).max())
    if path:
        drop(spark, path)
    return np.array(past).reshape(-1, k), gap()


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, domain (the likeliest), posterior of it, rate; and, alike in all rows, the largest miss of a
    target (gap, as a share of it) and whether all were met (converged)."""
    spark = docs.sparkSession
    model = learn(docs, domains)
    members = kept(memberships(docs, model), spark, "members")
    residuals, gap = fit_rates(members, model.domains, targets or TARGETS)
    names, k = model.domains, len(model.domains)

    def run(batches):
        for b in batches:
            p = b.column("p").flatten().to_numpy().reshape(b.num_rows, k)
            best = p.argmax(1) if len(p) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array([names[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(rates(p, residuals, float("inf")))], ["doc_id", "n_tokens", "domain", "posterior", "rate"])

    out = members.mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior double, rate double")
    return out.withColumn("gap", F.lit(gap)).withColumn("converged", F.lit(gap <= CLOSE))


def mixed(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents that stay, with all their columns as they were: each stays with its rate (at most 1) as probability, drawn from a hash
    of its id (of its text where the id is null), so that the draw is the same in every run.  Warns where a target was missed."""
    model = learn(docs, domains)
    members, path = written(memberships(docs, model).select("n_tokens", "p"), docs.sparkSession, "members")
    residuals, gap = fit_rates(members, model.domains, targets or TARGETS, cap=1.0, shrink=True)
    drop(docs.sparkSession, path)
    if gap > CLOSE:
        warnings.warn(f"mixing: a domain misses its target by {gap:.1%} of it after {len(residuals)} rounds", stacklevel=2)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go()
        m = known.value
        for b in parts(batches):
            own = [x or b"" for x in utf8(b.column("text"))]
            p = np.array([m.posterior(*features(t)[1:]) for t in own], np.float64).reshape(len(own), -1)
            draw = np.array([xxhash.xxh64_intdigest(str(d).encode() if d is not None else t, seed=11) / 2.0**64 for d, t in zip(b.column("doc_id").to_pylist(), own, strict=True)])
            yield b.filter(pa.array(draw < rates(p, residuals, 1.0), pa.bool_()))
        let_go()

    return docs.mapInArrow(run, docs.schema)
