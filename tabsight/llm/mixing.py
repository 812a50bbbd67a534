"""Mixing a corpus to target domain weights with soft membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of the
labelled rows, gives every document a posterior over the domains the labels
define (quality x toxicity).  Document i then has n_i * p_i expected tokens
per domain, and nonnegative rates r_i are fitted so that the expected totals
sum_i r_i n_i p_i meet the targets: projected gradient on least squares, with
momentum, starting at rate 1.  Steps are taken in the metric of document
sizes, so long and short documents move alike.

Each step needs one distributed sum of as many numbers as there are domains.
The rate of a document follows from its own posterior and the short history
of gradients, so nothing is joined or shuffled; the state of the iteration is
checkpointed every few steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut_lineage, ships, text_rows

#: Bound on the labelled rows that the classifier is fitted on.
MAX_ROWS = 20_000
BUCKETS = 1 << 14
#: A text speaks with the weight of at most so many words.
EVIDENCE_WORDS = 40
#: Target shares of tokens by domain; domains the labels do not show drop out.
TARGETS = {"q1t0": 0.80, "q1t1": 0.05, "q0t0": 0.12, "q0t1": 0.03}
MAX_STEPS = 80
HISTORY = 10
TOLERANCE = 1e-3


def _word_buckets(texts: pa.Array, buckets: int):
    """Bucket of every word, and the number of words of each text."""
    data, off = B.text_buffers(texts)
    if len(data) == 0:
        return np.empty(0, np.int64), np.zeros(len(off) - 1, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    inside = ~space
    begins = inside & (np.concatenate([[True], space[:-1]]) | edge[:-1])
    ends = inside & (np.concatenate([space[1:], [True]]) | edge[1:])
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(s), dtype=np.uint64)
    step = 1 << 20
    for a in range(0, len(data), step):  # prefix sums by pieces; a word belongs to where it begins
        i, j = np.searchsorted(s, [a, a + step])
        if i < j:
            lo, hi = int(s[i]), int(e[j - 1])
            h[i:j] = B.range_hash(B.prefix(data[lo:hi]), s[i:j] - lo, e[i:j] - lo)
    n = np.diff(np.searchsorted(s, off))
    return (h % np.uint64(buckets)).astype(np.int64), n


def _pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    size = np.diff(B.text_buffers(batch.column("text"))[1])
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(size) else []
    for i, j in zip(cuts, np.append(cuts[1:], len(size)) if len(size) else []):
        yield batch.slice(int(i), int(j - i))


def _count(buckets: int, n_domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_domains * buckets, dtype=np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                word, n = _word_buckets(piece.column("text"), buckets)
                domain = piece.column("domain").to_numpy(zero_copy_only=False)
                total += np.bincount(np.repeat(domain, n) * buckets + word, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})
    return run


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``_id, name``: the domain of each labelled id (rows with a null label
    or id say nothing; of several rows the least name counts)."""
    name = F.concat(F.lit("q"), F.col("quality").cast("int"), F.lit("t"), F.col("toxic").cast("int"))
    return labels.select(F.col("doc_id").cast("long").alias("_id"), name.alias("name")) \
        .filter("_id is not null and name is not null").groupBy("_id").agg(F.min("name").alias("name"))


def fit_classifier(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                   max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domain names, log priors, and log P(bucket | domain)."""
    known = labelled_domains(labels)
    shares = {r.name: r["count"] for r in known.groupBy("name").count().collect()}
    names = sorted(shares)
    if not names:
        return ["all"], np.zeros(1), np.zeros((1, buckets))
    n = sum(shares.values())
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("name")) - 1
    rows = text_rows(docs)
    # at most about max_rows rows of a few bytes, hence the broadcast
    sample = rows.join(F.broadcast(known), rows.doc_id == F.col("_id")).select("text", number.alias("domain"))
    counted = sample.mapInArrow(_count(buckets, len(names)), "i long, n long") \
        .groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = np.full(len(names) * buckets, 0.5)
    for r in counted:
        total[r.i] += r.n
    total = total.reshape(len(names), buckets)
    # shrink towards the corpus, so that a rare domain is not all noise
    overall = total.sum(axis=0) / total.sum()
    theta = (total + 2000.0 * overall) / (total.sum(axis=1, keepdims=True) + 2000.0)
    prior = np.log(np.array([shares[x] for x in names]) / n)
    return names, prior, np.log(theta)


def _posterior(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, theta, words = shared.value
        weight = theta.T.copy()
        for batch in batches:
            for piece in _pieces(batch):
                word, n = _word_buckets(piece.column("text"), len(weight))
                sums = np.zeros((len(n) + 1, weight.shape[1]))
                full = np.flatnonzero(n)
                if len(word):
                    at = (np.cumsum(n) - n)[full]
                    for k in range(weight.shape[1]):
                        sums[full, k] = np.add.reduceat(weight[word, k], at)
                sums = sums[:-1]
                z = prior + sums * np.minimum(1.0, words / np.maximum(n, 1))[:, None]
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                    "posterior": pa.array(p.tolist(), pa.list_(pa.float64())),
                    "rate": pa.array(np.ones(len(n))), "before": pa.array(np.ones(len(n)))})
    return run


def momentum(k: int) -> float:
    return k / (k + 3.0)


def advance(p: np.ndarray, rate: np.ndarray, before: np.ndarray, history: list[tuple[int, np.ndarray]]):
    """Rates after the steps of ``history``: (step number, gradient on the
    posterior) each."""
    for k, g in history:
        y = rate + momentum(k) * (rate - before)
        rate, before = np.maximum(0.0, y - p @ g), rate
    return rate, before


def _columns(batch):
    p = np.array(batch.column("posterior").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
    return (p, batch.column("rate").to_numpy(zero_copy_only=False),
            batch.column("before").to_numpy(zero_copy_only=False))


def _sums(history, k: int):
    """Expected tokens by domain at the point where step ``k`` looks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            p, rate, before = _columns(batch)
            rate, before = advance(p, rate, before, history)
            y = rate + momentum(k) * (rate - before)
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            looked, now = (y * n) @ p, (rate * n) @ p
            d = p.shape[1]
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.arange(d), pa.int32()),
                                              "looked": pa.array(looked), "now": pa.array(now)})
    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        p = _columns(batch)[0]
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        m = (p * n[:, None]).T @ p
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(m.size), pa.int32()), "v": pa.array(m.ravel())})


def _moved(history):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, rate, before = _columns(batch)
            rate, before = advance(p, rate, before, history)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), batch.column("posterior"),
                 pa.array(rate), pa.array(before)], names=["doc_id", "n_tokens", "posterior", "rate", "before"])
    return run


_SCHEMA = "doc_id long, n_tokens long, posterior array<double>, rate double, before double"


def fit_rates(members: DataFrame, targets: np.ndarray, max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE, history_size: int = HISTORY) -> tuple[DataFrame, np.ndarray]:
    """Rates (column ``rate``) and the expected domain totals they give.

    ``targets`` are shares; the token total of the corpus is kept.  Residuals
    are whitened by the domains' second moments sum_i n_i p_i p_i', for which
    1 is the exact Lipschitz bound, and so the step length."""
    d = len(targets)
    rows = members.mapInArrow(_moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return members, np.zeros(d)
    moment = np.zeros(d * d)
    for r in rows:
        moment[r.i] = r.v
    moment = moment.reshape(d, d)
    total = moment.sum()
    if total <= 0:
        return members, np.zeros(d)
    wanted = targets * total
    whiten = np.linalg.pinv(moment, rcond=1e-9, hermitian=True)
    now = members
    history: list[tuple[int, np.ndarray]] = []
    reached = moment.sum(axis=1)
    for k in range(max_steps):
        got = now.mapInArrow(_sums(list(history), k), "d int, looked double, now double") \
            .groupBy("d").agg(F.sum("looked").alias("looked"), F.sum("now").alias("now")).collect()
        looked, reached = np.zeros(d), np.zeros(d)
        for r in got:
            looked[r.d], reached[r.d] = r.looked, r.now
        if np.abs(reached / wanted - 1.0).max() <= tolerance:
            break
        history.append((k, whiten @ (looked - wanted)))
        if len(history) >= history_size:
            now = cut_lineage(now.mapInArrow(_moved(history), _SCHEMA))
            history = []
    if history:
        now = now.mapInArrow(_moved(history), _SCHEMA)
    return now, reached


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
        buckets: int = BUCKETS, max_rows: int = MAX_ROWS, max_steps: int = MAX_STEPS,
        tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate, copies`` for every row of ``docs``.

    ``copies`` rounds the rate up or down by the hash of the id, so that its
    expectation is the rate.  Null, empty and blank texts have no tokens: their
    posterior is the prior, their rate follows it and moves no total.  Null
    ids and repeated rows are rated like others.  Without labelled rows there
    is one domain and every rate is 1.  Empty tables give an empty result;
    other columns are ignored.
    """
    names, prior, theta = fit_classifier(docs, labels, buckets, max_rows)
    sc = docs.sparkSession.sparkContext
    members = cut_lineage(text_rows(docs).mapInArrow(
        _posterior(sc.broadcast((prior, theta, EVIDENCE_WORDS))), _SCHEMA))
    asked = targets or TARGETS
    share = np.array([asked.get(x, 0.0) for x in names])
    share = np.full(len(names), 1.0 / len(names)) if share.sum() <= 0 else np.maximum(share, 1e-6)
    rated, _ = fit_rates(members, share / share.sum(), max_steps, tolerance)
    part = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return rated.select(
        "doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{x}") for i, x in enumerate(names)], "rate",
        (whole + (part < F.col("rate") - whole).cast("long")).alias("copies"))


ships(__name__)
