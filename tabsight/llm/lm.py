"""Masked pseudo-likelihood of texts under a bidirectional window network.

Every token is predicted from ``window`` tokens on each side; the summed
conditional log-probabilities score a text.

* *Counts.*  Words of the whole corpus are counted.  Every code of the network
  stands for about one token in ``VOCABULARY`` or more: a word that frequent
  has a code of its own, rarer words share buckets by hash, as many as their
  share of the tokens asks for.  The ``top`` most frequent words are output
  classes of their own; the other codes are dealt to about as many classes as
  a class has codes.  So every word is context and target; inside its bucket a
  rare word takes its share of the bucket's tokens, by its own corpus count.
* *Encoding.*  Each text becomes 16 bits a token; the rarer words of a chunk of
  texts go to hash partitions as packed 64-bit hashes, where all their
  occurrences meet and are counted.
* *Training.*  A one-layer network (embeddings of the words around, a matrix
  for each position; tanh; softmax over classes, then over the codes of the
  class, which starts at their share of its tokens) is trained in numpy.  Texts are dealt by hash to shards of about
  ``SHARD_TOKENS``; every round trains each shard from the same parameters in
  the order of its hashes and averages parameters and step sizes over the
  shards, weighted by examples.  Shards depend on the rows alone, so neither
  partitions nor row order change a score.  The rounds share out the positions
  of all texts, so that each one trains the network.
* *Scoring* reads the encoded table once.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import bytesops as B
from .common import cut_lineage, ships, text_rows

#: A code stands for at least about one token in so many.
VOCABULARY = 3_072
TOP = 48
#: Least number of classes of the other codes.
SHARED = 16
WINDOW = 3
HIDDEN = 16
ROUNDS = 3
#: Each round trains on one step's positions in so many; as many rounds use all.
STRIDE = ROUNDS
#: Tokens of a step; at least ``STEPS`` steps a round where a shard allows it.
BATCH = 8192
STEPS = 16
RATE = 0.08
SHARD_TOKENS = 4 << 20
_TOKENS = 1 << 18
#: Parameters travel in parts of so many.
_PART = 1024
#: Tokens behind one hash partition of the rarer words.
_PART_TOKENS = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def part():
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()).cast(pa.string()),
                                           "n": pa.array(list(seen.values()), pa.int64())})

    for batch in batches:
        column = batch.column("text")
        for i in range(batch.num_rows):
            seen.update(column[i].as_buffer().to_pybytes().split())
            if len(seen) > _TOKENS:
                yield part()
                seen.clear()
    yield part()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count`` over all texts."""
    return text_rows(docs).select("text").mapInArrow(_counted, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("count"))


def shared_class(word: bytes, top: int, shared: int) -> int:
    return top + zlib.crc32(word) % shared


def vocabulary(counts: DataFrame, size: int = VOCABULARY, top: int = TOP, shared: int | None = None) -> dict:
    """Class and log P(word | class) of the frequent words, the tokens of each
    shared class and of its buckets of rarer words, and the count from which a
    word is listed.  At most ``size`` words and about as many buckets are
    collected: no more can make up one token in ``size`` each."""
    n_tokens = counts.agg(F.sum("count")).first()[0] or 0
    listed = F.col("count") * size >= n_tokens
    frequent = counts.filter(listed).collect()
    frequent.sort(key=lambda r: (-r["count"], r.word.encode()))
    rare = n_tokens - sum(r["count"] for r in frequent)
    wanted = -(-rare * size // max(n_tokens, 1))
    if shared is None:
        shared = max(SHARED, round((max(len(frequent) - top, 0) + wanted) ** 0.5))
    buckets = max(1, -(-wanted // shared))
    crc = F.crc32(F.col("word").cast("binary"))
    left = np.zeros((shared, buckets))
    for r in counts.filter(~listed).groupBy(F.pmod(crc, F.lit(shared)).alias("k"),
                                            F.pmod(F.floor(crc / shared), F.lit(buckets)).alias("b")) \
            .agg(F.sum("count").alias("n")).collect():
        left[r.k, r.b] = r.n
    tokens = left.sum(axis=1)
    for r in frequent[top:]:
        tokens[shared_class(r.word.encode(), 0, shared)] += r["count"]
    words = {}
    for i, r in enumerate(frequent):
        raw = r.word.encode()
        k = shared_class(raw, 0, shared)
        words[raw] = (i, 0.0) if i < top else (top + k, float(np.log(r["count"] / tokens[k])))
    return {"words": words, "top": top, "shared": shared, "tokens": tokens.tolist(), "left": left.tolist(),
            "least": -(-n_tokens // size), "n_tokens": n_tokens}


def layout(known: dict) -> dict:
    """Codes of the words: the most frequent ones are their class; the codes of
    a shared class are neighbours, first its buckets of unlisted words and then
    the listed ones.  With the class and the log share of every code (one more:
    a place beyond the text), the log of the tokens of a bucket (0 for other
    codes) and the bounds of the shared classes."""
    top, shared = known["top"], known["shared"]
    left = np.reshape(known["left"], (shared, -1))
    buckets = left.shape[1]
    codes, members = {}, [[] for _ in range(shared)]
    for w, (k, p) in known["words"].items():
        if k < top:
            codes[w] = k
        else:
            members[k - top].append((w, p))
    classes, prior, mass, bounds = list(range(top)), [0.0] * top, [0.0] * top, [top]
    for k in range(shared):
        classes += [top + k] * (buckets + len(members[k]))
        mass += [*np.log(np.maximum(left[k], 1.0)).tolist(), *[0.0] * len(members[k])]
        prior += np.log(np.maximum(left[k], 1e-6) / max(known["tokens"][k], 1e-6)).tolist()
        prior += [p for _, p in members[k]]
        codes.update((w, bounds[k] + buckets + i) for i, (w, _) in enumerate(members[k]))
        bounds.append(len(classes))
    return {"codes": codes, "classes": np.array([*classes, top + shared]), "prior": np.array(prior, np.float32),
            "mass": np.array(mass), "bounds": bounds, "top": top, "shared": shared, "buckets": buckets}


class _Words(dict):
    """Numbers of the words a task meets, with their codes and, for unlisted
    words, their hashes (others: 0)."""

    def __init__(self, known: dict):
        super().__init__()
        self.own, self.bounds = known["codes"].get, known["bounds"]
        self.shared, self.buckets = known["shared"], known["buckets"]
        self.codes, self.hashes = array("H"), array("Q")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.codes)
        code = self.own(word)
        if code is None:
            crc = zlib.crc32(word)
            self.codes.append(self.bounds[crc % self.shared] + crc // self.shared % self.buckets)
            self.hashes.append(xxhash.xxh3_64_intdigest(word) or 1)
        else:
            self.codes.append(code)
            self.hashes.append(0)
        return number


def _planes(values: np.ndarray) -> np.ndarray:
    return values.view(np.uint8).reshape(len(values), -1).T.ravel()


def _from_planes(raw: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_rare(hashes: np.ndarray, text: np.ndarray, bits: int):
    """(hash partition, payload) of the rarer words of a chunk."""
    order = np.argsort(hashes, kind="stable")
    h, t = hashes[order], text[order].astype(np.uint32)
    edge = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    bound = np.concatenate([[0], np.searchsorted(h, edge), [len(h)]])
    for p in np.flatnonzero(np.diff(bound)).tolist():
        part = slice(bound[p], bound[p + 1])
        yield p, B.pack([_planes(np.diff(h[part], prepend=np.uint64(0))), _planes(t[part])])


def _unpack_rare(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    h, t = B.unpack(payload, [np.uint8, np.uint8])
    return np.cumsum(_from_planes(h, np.uint64), dtype=np.uint64), _from_planes(t, np.uint32).astype(np.int64)


def _encode(shared_layout, bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_layout.value
        words = _Words(known)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = batch.column("text")
            a = 0
            while a < batch.num_rows:
                numbers, sizes = array("I"), []
                while a + len(sizes) < batch.num_rows and len(numbers) < size:
                    before = len(numbers)
                    numbers.extend(map(words.__getitem__, column[a + len(sizes)].as_buffer().to_pybytes().split()))
                    sizes.append(len(numbers) - before)
                n = len(sizes)
                at = np.frombuffer(numbers, np.uint32) if numbers else np.zeros(0, np.uint32)
                codes = np.array(words.codes, np.uint16)[at]
                hashes = np.array(words.hashes, np.uint64)[at]
                end = np.cumsum(sizes)
                text = np.repeat(np.arange(n), sizes)
                rare = np.flatnonzero(hashes)
                parts = list(_pack_rare(hashes[rare], text[rare], bits))
                rid = base + np.arange(n)
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(rid, pa.int64()), "doc_id": batch.column("doc_id").slice(a, n),
                    "key": batch.column("key").slice(a, n),
                    "codes": pa.array([codes[e - k:e].tobytes() for e, k in zip(end.tolist(), sizes)], pa.binary()),
                    "part": pa.nulls(n, pa.int32())})
                if parts:
                    m = len(parts)
                    yield pa.RecordBatch.from_pydict({
                        "rid": pa.array([base] * m, pa.int64()), "doc_id": pa.nulls(m, pa.int64()),
                        "key": pa.nulls(m, pa.int64()), "codes": pa.array([c for _, c in parts], pa.binary()),
                        "part": pa.array([p for p, _ in parts], pa.int32())})
                base += n
                a += n
                if len(words) > 4 * size:
                    words = _Words(known)
    return run


def encode(docs: DataFrame, shared_layout, bits: int = 5, size: int = _PART_TOKENS) -> DataFrame:
    """Texts (``part`` null): ``rid, doc_id, key, codes``; and packed rarer words
    of the texts from ``rid`` on, by hash partition.  ``rid`` holds once the
    table is written."""
    return text_rows(docs).withColumn("key", F.xxhash64("doc_id", "text")) \
        .mapInArrow(_encode(shared_layout, bits, size), "rid long, doc_id long, key long, codes binary, part int")


def _count_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the texts with rarer words of the partition and the sum of the
    log counts of these, one hash partition at a time."""
    def done(blocks):
        hashes = np.concatenate([h for _, h, _ in blocks])
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        logs = np.log(counts)[inverse]
        out, at = [], 0
        for _, h, text in blocks:
            total = np.bincount(text, weights=logs[at:at + len(h)])
            seen = np.unique(text)
            out.append(B.pack([seen.astype(np.uint32), total[seen]]))
            at += len(h)
        return pa.RecordBatch.from_pydict({"rid": pa.array([r for r, _, _ in blocks], pa.int64()),
                                           "sums": pa.array(out, pa.binary())})

    now, blocks = None, []
    for batch in batches:
        for rid, part, payload in zip(*[batch.column(c).to_pylist() for c in ("rid", "part", "codes")]):
            if part != now and blocks:
                yield done(blocks)
                blocks = []
            now = part
            blocks.append((rid, *_unpack_rare(payload)))
    if blocks:
        yield done(blocks)


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, np.zeros(0)

    def done():
        return pa.RecordBatch.from_pydict({"rid": pa.array(now + np.arange(len(total)), pa.int64()),
                                           "mass": pa.array(total, pa.float64())})

    for batch in batches:
        for rid, payload in zip(batch.column("rid").to_pylist(), batch.column("sums").to_pylist()):
            if rid != now:
                if now is not None:
                    yield done()
                now, total = rid, np.zeros(0)
            seen, sums = B.unpack(payload, [np.uint32, np.float64])
            if int(seen[-1]) >= len(total):
                total = np.concatenate([total, np.zeros(int(seen[-1]) + 1 - len(total))])
            total[seen] += sums
    if now is not None:
        yield done()


def rare_mass(encoded: DataFrame) -> DataFrame:
    """``rid, mass``: the sum of the log corpus counts of the rarer words of
    every text that has some.  All occurrences of a word meet in its hash
    partition; none of these words is frequent, so no partition is large."""
    return encoded.filter("part is not null").select("rid", "part", "codes") \
        .repartition("part").sortWithinPartitions("part", "rid").mapInArrow(_count_rare, "rid long, sums binary") \
        .repartition("rid").sortWithinPartitions("rid", "sums").mapInArrow(_add_sums, "rid long, mass double")


def initial(known: dict, window: int = WINDOW, hidden: int = HIDDEN, seed: int = 7) -> list[np.ndarray]:
    """Embeddings of the codes (one more: beyond the text), a matrix for each
    position around, their bias, then weights and biases of the classes and of
    the codes in their class.  Untrained, every code has its share of its
    class, whatever stands around it."""
    n, classes = len(known["prior"]), known["top"] + known["shared"]
    rng = np.random.default_rng(seed)
    return [(rng.standard_normal((n + 1, hidden)) * 0.5).astype(np.float32),
            (rng.standard_normal((2 * window, hidden, hidden)) / np.sqrt(2 * window * hidden)).astype(np.float32),
            np.zeros(hidden, np.float32), np.zeros((hidden, classes), np.float32), np.zeros(classes, np.float32),
            np.zeros((n, hidden), np.float32), known["prior"].copy()]


def flatten(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for p in like:
        out.append(np.asarray(flat[at:at + p.size], dtype=np.float32).reshape(p.shape))
        at += p.size
    return out


def _padded(codes: list[bytes], window: int, beyond: int, kind=np.uint16):
    """Codes of several texts in one array, ``window`` paddings (``beyond``)
    before each and after the last; the place of every token and its text."""
    size = np.array([len(c) for c in codes], dtype=np.int64) // np.dtype(kind).itemsize
    pad = np.full(window, beyond, kind).tobytes()
    flat = np.frombuffer(pad + pad.join(codes) + pad, dtype=kind).astype(np.int64)
    begin = np.cumsum(size + window) - size
    text = np.repeat(np.arange(len(codes)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + begin[text]
    return flat, place, text


def _offsets(window: int) -> list[int]:
    return [o for o in range(-window, window + 1) if o]


def _hidden(params, near: np.ndarray, window: int, step: int = 1):
    """Embeddings of ``near`` and the hidden layer of every ``step``-th place
    of it that has ``window`` places on both sides."""
    seen = params[0][near]
    inner = len(near) - window
    z = np.broadcast_to(params[2], (len(range(window, inner, step)), len(params[2]))).copy()
    for k, o in enumerate(_offsets(window)):
        z += seen[window + o:inner + o:step] @ params[1][k]
    return seen, np.tanh(z, out=z)


def _row_sums(q: np.ndarray) -> np.ndarray:
    return q @ np.ones(q.shape[1], q.dtype)


def _column_sums(q: np.ndarray) -> np.ndarray:
    return np.ones(len(q), q.dtype) @ q


def _safe(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no sum of these, with inputs up to 1, can leave the range of exp."""
    return float((np.abs(weights).sum(axis=0) + np.abs(bias)).max(initial=0)) < 60


def _exp(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, safe: bool) -> np.ndarray:
    """exp of the logits, up to a factor for each row."""
    q = h @ weights
    q += bias
    if not safe:
        q -= q.max(axis=1, keepdims=True)
    return np.exp(q, out=q)


def _by_class(target: np.ndarray, known: dict):
    """Rows ordered by target, and (from, to, bounds of the codes) of those of
    each class whose codes have others beside them."""
    order = np.argsort(target.astype(np.uint16), kind="stable")
    at = np.searchsorted(target[order], known["bounds"]).tolist()
    return order, [(at[k], at[k + 1], known["bounds"][k], known["bounds"][k + 1])
                   for k in range(known["shared"]) if at[k] < at[k + 1]]


def log_probability(params, flat, place, window: int, known: dict) -> np.ndarray:
    """log P(code of each token | tokens around it)."""
    _, _, _, w2, b2, u, c = params
    low = int(place[0]) - window
    _, h = _hidden(params, flat[low:int(place[-1]) + window + 1], window)
    h = h[place - place[0]]
    target = flat[place]
    q = _exp(h, w2, b2, _safe(w2, b2))
    out = np.log(q[np.arange(len(place)), known["classes"][target]] / _row_sums(q)).astype(np.float64)
    order, spans = _by_class(target, known)
    hs, ts, safe = h[order], target[order], _safe(u.T, c)
    for x, y, a, b in spans:
        q = _exp(hs[x:y], u[a:b].T, c[a:b], safe)
        out[order[x:y]] += np.log(q[np.arange(y - x), ts[x:y] - a] / _row_sums(q))
    return out


def train_step(params, moments, flat, places: range, window: int, rate: float, known: dict) -> int:
    """One AdaGrad step on the mean log-loss of the tokens at ``places`` (in
    place); paddings among them are no tokens.  Returns how many are."""
    words, mats, _, w2, b2, u, c = params
    low, step = places[0] - window, places.step
    near = flat[low:places[-1] + window + 1]
    inner = len(near) - window
    target = near[window:inner:step]
    real = target < len(c)
    n = int(real.sum())
    if n == 0:
        return 0
    seen, h = _hidden(params, near, window, step)
    q = _exp(h, w2, b2, _safe(w2, b2))
    q *= (real / (n * _row_sums(q)))[:, None].astype(q.dtype)
    mine = np.flatnonzero(real)
    q[mine, known["classes"][target[mine]]] -= 1.0 / n
    dh = q @ w2.T
    grads = [(q.T @ h).T, _column_sums(q)]
    du, dc = np.zeros_like(u), np.zeros_like(c)
    order, spans = _by_class(target, known)  # paddings are beyond the last class
    hs, ts, ds, safe = h[order], target[order], np.zeros_like(h), _safe(u.T, c)
    for x, y, a, b in spans:
        part, weights = hs[x:y], u[a:b]
        q = _exp(part, weights.T, c[a:b], safe)
        q *= (1.0 / (n * _row_sums(q)))[:, None]
        q[np.arange(y - x), ts[x:y] - a] -= 1.0 / n
        ds[x:y] = q @ weights
        du[a:b], dc[a:b] = q.T @ part, _column_sums(q)
    dh[order] += ds
    dz = dh * (1.0 - h * h)
    spread, dmats = np.zeros_like(seen), np.empty_like(mats)
    for k, o in enumerate(_offsets(window)):
        around = slice(window + o, inner + o, step)
        dmats[k] = seen[around].T @ dz
        spread[around] += dz @ mats[k].T
    dwords = np.stack([np.bincount(near, weights=column, minlength=len(words)) for column in spread.T.copy()], axis=1)
    for value, m, g in zip(params, moments, [dwords.astype(words.dtype), dmats, dz.sum(axis=0), *grads, du, dc]):
        m += g * g
        value -= rate * g / (np.sqrt(m) + 1e-6)
    return n


def _groups(batches, window: int, beyond: int, kind=np.uint16):
    for batch in batches:
        column = batch.column("codes")
        rows, held, size = [], [], 0
        for i in range(batch.num_rows):
            c = column[i].as_buffer().to_pybytes()
            if held and size + len(c) > _TOKENS * np.dtype(kind).itemsize:
                yield batch, rows, *_padded(held, window, beyond, kind)
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(c)
            size += len(c)
        if held:
            yield batch, rows, *_padded(held, window, beyond, kind)


def _shard_groups(batches):
    """(shard, codes of some of its texts), in order; where one group of texts
    ends depends on the shard alone, not on how rows are batched."""
    now, held, size = None, [], 0
    for batch in batches:
        column = batch.column("codes")
        for i, shard in enumerate(batch.column("shard").to_pylist()):
            if held and (shard != now or size >= _TOKENS * 2):
                yield now, held
                held, size = [], 0
            now = shard
            held.append(column[i].as_buffer().to_pybytes())
            size += len(held[-1])
    if held:
        yield now, held


def _train(shared_state, round_number: int, window: int, stride: int, rate: float, size: int, shared_layout):
    """Parameters, squared step sizes and examples of every shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_layout.value
        now, seen, block, params, moments = None, 0, 0, [], []

        def done():
            flat = np.concatenate([flatten(params), flatten(moments)]).astype(np.float32)
            parts = [flat[a:a + _PART].tobytes() for a in range(0, len(flat), _PART)]
            return pa.RecordBatch.from_pydict({
                "i": pa.array(np.arange(len(parts)), pa.int32()), "v": pa.array(parts, pa.binary()),
                "n": pa.array(np.full(len(parts), seen), pa.int64())})

        for shard, codes in _shard_groups(batches):
            if shard != now:
                if now is not None:
                    yield done()
                now, seen, block = shard, 0, 0
                params, moments = [[p.copy() for p in x] for x in shared_state.value]
            flat, _, _ = _padded(codes, window, len(known["prior"]))
            for a in range(window, len(flat) - window, size):
                if block % stride == round_number % stride:
                    places = range(a, min(a + size, len(flat) - window))
                    seen += train_step(params, moments, flat, places, window, rate, known)
                block += 1
        if now is not None:
            yield done()
    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the parts of the parameters, weighted by examples."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, int] = {}
    for batch in batches:
        for i, v, n in zip(*[batch.column(c).to_pylist() for c in ("i", "v", "n")]):
            total[i] = total.get(i, 0.0) + np.frombuffer(v, np.float32).astype(np.float64) * max(n, 1)
            weight[i] = weight.get(i, 0) + max(n, 1)
    if total:
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(list(total), pa.int32()),
            "v": pa.array([(total[i] / weight[i]).astype(np.float32).tobytes() for i in total], pa.binary())})


def _score(shared_params, shared_layout, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_layout.value
        params = shared_params.value
        for batch, rows, flat, place, text in _groups(batches, window, len(known["prior"])):
            total = np.zeros(len(rows))
            for a in range(0, len(place), 1 << 15):
                part = place[a:a + (1 << 15)]
                total += np.bincount(text[a:a + (1 << 15)], minlength=len(rows),
                                     weights=log_probability(params, flat, part, window, known)
                                     - known["mass"][flat[part]])
            n = np.bincount(text, minlength=len(rows)) if len(text) else np.zeros(len(rows), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column("rid").slice(rows[0], len(rows)),
                "doc_id": batch.column("doc_id").slice(rows[0], len(rows)),
                "n_tokens": pa.array(n, pa.int64()), "log_likelihood": pa.array(total, pa.float64())})
    return run


def in_shards(encoded: DataFrame, n_tokens: int) -> DataFrame:
    """``shard, key, codes`` of the texts with tokens, by shard and key."""
    shards = max(1, round(n_tokens / SHARD_TOKENS))
    return cut_lineage(encoded.filter("part is null and octet_length(codes) > 0")
                       .select(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).alias("shard"), "key", "codes")
                       .repartition(2 * shards, "shard").sortWithinPartitions("shard", "key", "codes"))


def step_tokens(n_tokens: int, stride: int) -> int:
    """Positions of a step, from the tokens of a shard."""
    shard = n_tokens / max(1, round(n_tokens / SHARD_TOKENS))
    return min(max(int(shard / stride / STEPS), 64), BATCH)


def train(sharded: DataFrame, shared_layout, n_tokens: int, rounds: int = ROUNDS, window: int = WINDOW,
          hidden: int = HIDDEN, stride: int = STRIDE, rate: float = RATE) -> list[np.ndarray]:
    """Parameters after ``rounds`` of steps in every shard and averaging.  The
    driver receives the averaged parameters and moments, 4 bytes each."""
    sc = sharded.sparkSession.sparkContext
    params = initial(shared_layout.value, window, hidden)
    moments = [np.full_like(p, 1e-6) for p in params]
    for r in range(rounds):
        run = _train(sc.broadcast((params, moments)), r, window, stride, rate, step_tokens(n_tokens, stride),
                     shared_layout)
        rows = sharded.mapInArrow(run, "i int, v binary, n long") \
            .repartition("i").mapInArrow(_averaged, "i int, v binary").collect()
        if not rows:
            break
        rows.sort(key=lambda x: x.i)
        both = shaped(np.concatenate([np.frombuffer(x.v, np.float32) for x in rows]), params + moments)
        params, moments = both[:len(params)], both[len(params):]
    return params


def pseudo_likelihood(docs: DataFrame, size: int = VOCABULARY, top: int = TOP, shared: int | None = None,
                      rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` for every row of ``docs``.

    Null, empty and blank texts have no tokens, the log-likelihood 0 and a null
    ``per_token``.  Null ids and repeated rows are scored like others (a
    repeated row counts again in the corpus).  An empty table gives an empty
    result; other columns are ignored.
    """
    if 2 * size + top + (shared or size) >= 1 << 16:
        raise ValueError("codes must fit 16 bits")
    sc = docs.sparkSession.sparkContext
    counts = cut_lineage(word_counts(docs))
    known = vocabulary(counts, size, top, shared)
    n_tokens = known["n_tokens"]
    shared_layout = sc.broadcast(layout(known))
    bits = min(max((n_tokens // _PART_TOKENS).bit_length(), 5), 14)
    encoded = cut_lineage(encode(docs, shared_layout, bits))
    params = train(in_shards(encoded, n_tokens), shared_layout, n_tokens, rounds, stride=stride) if rounds else \
        initial(shared_layout.value)
    scored = encoded.filter("part is null").select("rid", "doc_id", "codes") \
        .mapInArrow(_score(sc.broadcast(params), shared_layout, WINDOW),
                    "rid long, doc_id long, n_tokens long, log_likelihood double")
    rare = rare_mass(encoded).withColumnRenamed("rid", "_rid")
    scored = scored.join(rare, F.col("rid") == F.col("_rid"), "left") \
        .select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("mass", F.lit(0.0))).alias("log_likelihood"))
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


ships(__name__)
