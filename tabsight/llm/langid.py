"""Language of texts by a byte convolutional network.

Texts are UTF-8 bytes, cut into windows of ``WINDOW`` bytes (the last one
padded); neighbouring windows share ``max(WIDTHS) - 1`` bytes, so every run of
bytes a filter looks at lies whole in one of them.  Per window: filters of
several widths over the one-hot bytes, the maximum of each over the window,
a rectifier and a softmax over the languages.  A document's probabilities are
the softmax of the mean log-probability of all its windows, weighted by their
bytes, so long texts are read whole, in bounded batches.

*Training* looks at the texts with a language outside the held-out share: at
most about ``MAX_TEXTS`` of them, evenly over the languages, and at most about
``MAX_WINDOWS`` of their windows, both chosen by content hash.  That bounded
sample is ordered by its hash and fitted in one task, in numpy (mini-batch
Adam), so the model depends on neither partitions nor row order.  Ids, sources
and the language of a document to be predicted are never looked at.

*Prediction* is one map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import ships

#: Bounds of the training sample (texts, then windows), over all languages.
MAX_TEXTS = 8_000
MAX_WINDOWS = 4_096
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS = 6
BATCH = 64
RATE = 0.01
HELD_OUT_REMAINDER = 2
UNKNOWN = "und"
#: The byte beyond the end of a text.
_PAD = 256
_BYTES = 257
_ROWS = 256


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT_REMAINDER,
                      F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


# ------------------------------------------------------------- windows

def cut(offsets: np.ndarray, window: int, step: int):
    """Text, first byte and bytes of every window of the texts between
    ``offsets``; a text without bytes has none."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - (window - step)) // step)), 0)
    text = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return text, offsets[:-1][text] + begin, np.minimum(size[text] - begin, window)


def padded_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """One row of ``window`` byte numbers per window, ``_PAD`` beyond its end."""
    at = np.arange(window)
    rows = data[np.minimum(start[:, None] + at, max(len(data) - 1, 0))].astype(np.int32)
    rows[at >= size[:, None]] = _PAD
    return rows


# ------------------------------------------------------------- network

def initial(classes: int, widths=WIDTHS, filters: int = FILTERS, seed: int = 13) -> list[np.ndarray]:
    """Filters (width, byte, filter) and biases per width, then the weights and
    biases of the softmax."""
    rng = np.random.default_rng(seed)
    out = []
    for w in widths:
        out += [rng.standard_normal((w, _BYTES, filters)) * 0.3, np.zeros(filters)]
    features = filters * len(widths)
    return [*out, rng.standard_normal((features, classes)) / np.sqrt(features), np.zeros(classes)]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def forward(params: list[np.ndarray], rows: np.ndarray):
    """Pooled features before the rectifier, where each was found, and logits."""
    pooled, where = [], []
    for i in range(0, len(params) - 2, 2):
        table, bias = params[i], params[i + 1]
        places = rows.shape[1] - len(table) + 1
        z = table[0][rows[:, :places]]
        for k in range(1, len(table)):
            z += table[k][rows[:, k:k + places]]
        at = z.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0] + bias)
    h = np.concatenate(pooled, axis=1)
    return h, where, np.maximum(h, 0) @ params[-2] + params[-1]


def gradients(params: list[np.ndarray], rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log-loss of the windows."""
    h, where, logits = forward(params, rows)
    n = len(rows)
    p = softmax(logits)
    p[np.arange(n), target] -= 1.0
    p /= n
    dh = (p @ params[-2].T) * (h > 0)
    out, begin = [], 0
    for i, at in zip(range(0, len(params) - 2, 2), where):
        width, _, filters = params[i].shape
        d = dh[:, begin:begin + filters]
        begin += filters
        cell = np.arange(filters)
        table = np.stack([np.bincount((rows[np.arange(n)[:, None], at + k] * filters + cell).ravel(),
                                      weights=d.ravel(), minlength=_BYTES * filters).reshape(_BYTES, filters)
                          for k in range(width)])
        out += [table, d.sum(axis=0)]
    return [*out, np.maximum(h, 0).T @ p, p.sum(axis=0)]


def fit(rows: np.ndarray, target: np.ndarray, classes: int, epochs: int = EPOCHS, batch: int = BATCH,
        rate: float = RATE, widths=WIDTHS, filters: int = FILTERS) -> list[np.ndarray]:
    """Mini-batch Adam; small samples are passed over more often."""
    params = initial(classes, widths, filters)
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs * max(1, 1024 // max(len(rows), 1))):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for a in range(0, len(rows), batch):
            pick = order[a:a + batch]
            step += 1
            for p, m, v, g in zip(params, first, second, gradients(params, rows[pick], target[pick])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params


class Scorer:
    """The network with the filter tables of two neighbouring bytes added up
    beforehand, so that a filter of width w takes (w + 1) // 2 look-ups."""

    def __init__(self, params: list[np.ndarray]):
        self.params = params
        self.tables = []
        for i in range(0, len(params) - 2, 2):
            t = params[i].astype(np.float32)
            parts = [(k, (t[k][:, None] + t[k + 1][None]).reshape(-1, t.shape[2])) for k in range(0, len(t) - 1, 2)]
            if len(t) % 2:
                parts.append((len(t) - 1, t[-1]))
            self.tables.append((len(t), parts, params[i + 1].astype(np.float32)))

    def log_probability(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1] * _BYTES + rows[:, 1:]
        pooled = []
        for width, parts, bias in self.tables:
            places = rows.shape[1] - width + 1
            z = None
            for k, table in parts:
                index = pairs if len(table) > _BYTES else rows
                got = table.take(index[:, k:k + places], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(axis=1) + bias)
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.params[-2] + self.params[-1]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


# ------------------------------------------------------------ training

def _to_windows(window: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            text, start, size = cut(offsets, window, step)
            for a in range(0, len(text), 4096):
                part = slice(a, a + 4096)
                rows = padded_windows(data, start[part], size[part], window).astype(np.uint16)
                yield pa.RecordBatch.from_pydict({
                    "class": batch.column("class").take(pa.array(text[part])),
                    "codes": pa.array([r.tobytes() for r in rows], pa.binary())})
    return run


def _fit_rows(classes: int, window: int, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, target = [], []
        for batch in batches:
            codes += batch.column("codes").to_pylist()
            target += batch.column("class").to_pylist()
        if codes:
            rows = np.frombuffer(b"".join(codes), np.uint16).reshape(-1, window).astype(np.int32)
            params = fit(rows, np.array(target), classes, **options)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.arange(len(params)), pa.int32()),
                "v": pa.array([p.astype(np.float64).tobytes() for p in params], pa.binary())})
    return run


def _evenly(rows: DataFrame, key: Column, classes: int, most: int) -> DataFrame:
    """About ``most`` of the rows, evenly over ``class``, by the hash of ``key``
    (every row of a class that has no more than its share)."""
    counts = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}
    share = max(1, most // max(classes, 1))
    scale = 1 << 30
    limit = F.create_map(*[F.lit(x) for c in range(classes)
                           for x in (c, int(scale * min(1.0, share / counts.get(c, 1))))])
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < limit[F.col("class")])


def train(docs: DataFrame, max_texts: int = MAX_TEXTS, max_windows: int = MAX_WINDOWS, window: int = WINDOW,
          **options) -> tuple[list[str], list[np.ndarray]]:
    """(languages, parameters).  The languages, at most as many numbers and the
    parameters of the network reach the driver."""
    usable = docs.select(F.col("text"), F.col("lang").cast("string").alias("lang")) \
        .filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    languages = sorted(r.lang for r in usable.select("lang").distinct().collect())
    if not languages:
        return [], []
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    rows = usable.select("text", number[F.col("lang")].alias("class"))
    step = window - max(options.get("widths", WIDTHS)) + 1
    windows = _evenly(rows, F.col("text"), len(languages), max_texts) \
        .mapInArrow(_to_windows(window, step), "class int, codes binary")
    sample = _evenly(windows, F.col("codes"), len(languages), max_windows)
    # about ``max_windows`` rows, whatever the corpus, hence one task
    got = sample.withColumn("key", F.xxhash64("codes")).repartition(1) \
        .sortWithinPartitions("key", "codes", "class") \
        .mapInArrow(_fit_rows(len(languages), window, options), "i int, v binary").collect()
    like = initial(len(languages), options.get("widths", WIDTHS), options.get("filters", FILTERS))
    return languages, [np.frombuffer(r.v, np.float64).reshape(p.shape)
                       for r, p in zip(sorted(got, key=lambda r: r.i), like)]


# ---------------------------------------------------------- prediction

def _predict(shared, window: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        classes = len(shared.value[-1])
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            text, start, size = cut(offsets, window, step)
            total, weight = np.zeros((batch.num_rows, classes)), np.zeros(batch.num_rows)
            for a in range(0, len(text), _ROWS):
                part = slice(a, a + _ROWS)
                got = scorer.log_probability(padded_windows(data, start[part], size[part], window))
                np.add.at(total, text[part], got * size[part][:, None])
                np.add.at(weight, text[part], size[part])
            p = softmax(total / np.maximum(weight, 1)[:, None])
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "letters": batch.column("letters"),
                "best": pa.array(best, pa.int32()), "p": pa.array(p[np.arange(len(p)), best], pa.float64())})
    return run


def identify(docs: DataFrame, languages: list[str], params: list[np.ndarray], window: int = WINDOW) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    A null text and one without a letter are ``und`` with the score 0; so is
    every text when nothing was learned.  Null ids are not held out.  Repeated
    rows are predicted alike, very long texts window by window; an empty table
    gives an empty result and other columns (``lang`` and ``source`` too) are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has_letter(F.col("text")).alias("letters"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if languages:
        widths = [len(p) for p in params[:-2:2]]
        named = F.array(*[F.lit(x) for x in languages])
        scored = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(params), window,
                                          window - max(widths) + 1),
                                 "doc_id long, letters boolean, best int, p double") \
            .withColumn("lang", F.get(named, F.col("best")))
    else:
        scored = rows.select("doc_id", F.lit(False).alias("letters"), F.lit(UNKNOWN).alias("lang"),
                             F.lit(0.0).alias("p"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         F.when(F.col("letters"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
                         F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))


ships(__name__)
