"""Vector codes by product quantisation over metric trees.

Every vector is cut into ``parts`` equal parts of whole numbers
(``floor(scale * x)``); each part position has a codebook of ``entries``
entries, fitted by rounds of nearest assignment and floored means.

* *Trees.*  A task takes its rows in blocks of ``BLOCK`` and builds one metric
  tree per part position by the anchors hierarchy: anchors are added one at a
  time at the point farthest from its anchor and take over the points nearer
  to them, skipping anchors too far away to lose any; the anchors' balls are
  then joined pairwise, smallest ball first (middle-out), and each anchor's
  points are treated alike below.  Every ball keeps its centre, radius, count
  and sum of points.  The blocks are checkpointed once.
* *Rounds.*  The codebooks (bounded: ``entries`` x components) are broadcast
  and the trees walked level by level.  A ball inherits the list of entries
  that may still own one of its points and shortens it: an entry goes when
  another one is nearer for the whole ball.  A ball with one entry left adds
  its cached sum and count; only the points of the leaves that stay shared are
  compared one by one.  Sums and counts meet in one aggregate.
* *Codes.*  A last walk assigns every part.

All sums, means and distances are whole numbers and exact; balls are pruned
with a margin above the rounding of their centres, so ties always reach the
exact comparison (ties go to the lower index).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut_lineage, ships

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors of a block; points of a leaf.
BLOCK = 4096
LEAF = 24
#: Larger whole numbers could leave 64 bits in a sum of squares.
MOST = 1 << 27


# --------------------------------------------------------------- trees

class Tree:
    """Balls of one block and part: ``order`` lists the points, ball i covers
    ``order[begin[i]:end[i]]``; ``left``/``right`` are -1 for a leaf."""

    TYPES = [np.int32, np.int32, np.int32, np.int32, np.int32, np.float64, np.float64, np.int64]

    def __init__(self, order, begin, end, left, right, centre, radius, total):
        self.order, self.begin, self.end, self.left, self.right = order, begin, end, left, right
        self.centre, self.radius, self.total = centre, radius, total

    def arrays(self) -> list[np.ndarray]:
        fields = (self.order, self.begin, self.end, self.left, self.right, self.centre, self.radius, self.total)
        return [np.asarray(f, dtype=t).ravel() for f, t in zip(fields, self.TYPES)]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Tree:
        *head, centre, radius, total = arrays
        n = len(radius)
        return cls(*head, centre.reshape(n, -1), radius, total.reshape(n, -1))


def _distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    d = points - one
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def anchors(points: np.ndarray, idx: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """``idx`` dealt to at most ``count`` anchors: (members, anchor, radius).
    A point belongs to its nearest anchor."""
    held = [idx]
    at = [points[idx[0]]]
    far = [_distance(points[idx], at[0])]
    while len(held) < count:
        radius = np.array([f.max() if len(f) else 0.0 for f in far])
        widest = int(radius.argmax())
        if radius[widest] == 0.0:
            break
        new = points[held[widest][far[widest].argmax()]]
        gap = _distance(np.array(at), new)
        mine, mine_far = [], []
        for j in np.flatnonzero(gap < 2 * radius):  # others are too far away to lose a point
            reach = np.flatnonzero(far[j] * 2 >= gap[j])  # nearer ones stay, by the triangle inequality
            d = _distance(points[held[j][reach]], new)
            won = reach[d < far[j][reach]]
            if len(won):
                mine.append(held[j][won])
                mine_far.append(d[d < far[j][reach]])
                keep = np.ones(len(held[j]), dtype=bool)
                keep[won] = False
                held[j], far[j] = held[j][keep], far[j][keep]
        held.append(np.concatenate(mine))
        far.append(np.concatenate(mine_far))
        at.append(new)
    return [(h, a, float(f.max())) for h, a, f in zip(held, at, far) if len(h)]


def _middle_out(found: list[tuple[np.ndarray, np.ndarray, float]], below: list):
    """Joins the anchors' subtrees pairwise, always the two whose common ball
    is smallest; nested pairs."""
    n = len(found)
    node = list(below)
    centre = np.array([a for _, a, _ in found])
    radius = np.array([r for _, _, r in found])
    size = np.array([len(h) for h, _, _ in found], dtype=np.float64)
    gap = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(axis=2), 0))
    common = (gap + radius[:, None] + radius[None]) / 2
    common = np.maximum(common, np.maximum(radius[:, None], radius[None]))
    np.fill_diagonal(common, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(common.argmin()), n)
        radius[i] = common[i, j]
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        node[i] = (node[i], node[j])
        live = np.isfinite(common[i]) | np.isfinite(common[j])
        live[[i, j]] = False
        common[j] = common[:, j] = np.inf
        row = np.maximum((_distance(centre, centre[i]) + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
        common[i] = common[:, i] = np.where(live, row, np.inf)
        common[i, i] = np.inf
    return node[i] if n > 1 else node[0]


def _nested(points: np.ndarray, idx: np.ndarray, leaf: int):
    if len(idx) <= leaf:
        return idx
    found = anchors(points, idx, int(np.ceil(np.sqrt(len(idx)))))
    if len(found) == 1:  # all points alike
        return idx
    return _middle_out(found, [_nested(points, h, leaf) for h, _, _ in found])


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The metric tree of whole-numbered ``points`` (at least one)."""
    real = points.astype(np.float64)
    order, begin, end, left, right = [], [], [], [], []

    def place(node, at):
        me = len(begin)
        begin.append(at)
        end.append(at)
        left.append(-1)
        right.append(-1)
        if isinstance(node, tuple):
            left[me], at = place(node[0], at)
            right[me], at = place(node[1], at)
        else:
            order.append(node)
            at += len(node)
        end[me] = at
        return me, at

    place(_nested(real, np.arange(len(points)), leaf), 0)
    order = np.concatenate(order)
    begin, end = np.array(begin), np.array(end)
    ordered = points[order]
    pre = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(ordered, axis=0, dtype=np.int64)])
    total = pre[end] - pre[begin]
    centre = total / (end - begin)[:, None]
    radius = np.array([_distance(real[order[a:b]], c).max() for a, b, c in zip(begin, end, centre)])
    return Tree(order, begin, end, np.array(left), np.array(right), centre, radius, total)


# --------------------------------------------------------------- walks

def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    width = max(points.shape[1], 1)
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if int(largest) ** 2 * 4 * width < 1 << 52:  # whole numbers below 2^53 are exact in doubles
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    out = np.empty((len(points), len(entries)), dtype=np.int64)
    for k, e in enumerate(entries):
        d = points - e
        out[:, k] = (d * d).sum(axis=1)
    return out


def walk(tree: Tree, points: np.ndarray, entries: np.ndarray, owned, shared) -> int:
    """Calls ``owned(balls, entry numbers)`` for wholly owned balls and
    ``shared(points, entry numbers)`` for points compared one by one; returns
    how many point-entry distances were computed."""
    real = entries.astype(np.float64)
    apart = np.sqrt(((real[:, None] - real[None]) ** 2).sum(axis=2))
    first = np.array([not (entries[:k] == e).all(axis=1).any() for k, e in enumerate(entries)])
    norm = (real * real).sum(axis=1)
    ball, allowed, computed = np.zeros(1, np.int64), first[None], 0
    while len(ball):
        centre = tree.centre[ball]
        square = (centre * centre).sum(axis=1)[:, None] + norm - 2 * centre @ real.T
        square = np.where(allowed, square, np.inf)
        best = square.argmin(axis=1)
        nearest = square[np.arange(len(ball)), best]
        # for every x of the ball |x-c'|^2 - |x-c|^2 >= difference at the centre - 2 r |c'-c|
        scale = nearest + norm.max() + (centre * centre).sum(axis=1)
        slack = 2 * (tree.radius[ball] * (1 + 1e-9))[:, None] * apart[best] + 1e-9 * scale[:, None] + 1e-6
        allowed = allowed & (square - nearest[:, None] <= slack)
        allowed[np.arange(len(ball)), best] = True
        one = allowed.sum(axis=1) == 1
        if one.any():
            owned(ball[one], best[one])
        leaf = ~one & (tree.left[ball] < 0)
        if leaf.any():
            size = (tree.end - tree.begin)[ball[leaf]]
            at = np.repeat(tree.begin[ball[leaf]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            which = tree.order[at]
            possible = np.repeat(allowed[leaf], size, axis=0)
            d = np.where(possible, squared(points[which], entries), np.iinfo(np.int64).max)
            computed += int(possible.sum())
            shared(which, d.argmin(axis=1))
        deeper = ~one & ~leaf
        ball, allowed = np.concatenate([tree.left[ball[deeper]], tree.right[ball[deeper]]]).astype(np.int64), \
            np.concatenate([allowed[deeper], allowed[deeper]])
    return computed


def totals(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum and count of the points each entry owns, and distances computed."""
    total = np.zeros((len(entries), points.shape[1]), dtype=np.int64)
    count = np.zeros(len(entries), dtype=np.int64)
    size = tree.end - tree.begin

    def owned(ball, entry):
        np.add.at(total, entry, tree.total[ball])
        np.add.at(count, entry, size[ball])

    def shared(which, entry):
        np.add.at(total, entry, points[which])
        np.add.at(count, entry, 1)

    computed = walk(tree, points, entries, owned, shared)
    return total, count, computed


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)

    def owned(ball, entry):
        for b, e in zip(ball.tolist(), entry.tolist()):
            out[tree.order[tree.begin[b]:tree.end[b]]] = e

    def shared(which, entry):
        out[which] = entry

    walk(tree, points, entries, owned, shared)
    return out


# ---------------------------------------------------------- Spark side

def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x``: the rows whose vector is there and has neither null
    nor non-finite components, as whole numbers."""
    v = F.col("embedding")
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                          v.cast("array<double>").alias("v")) \
        .filter(F.col("v").isNotNull() & F.forall("v", finite))
    bounded = F.forall("v", lambda x: F.abs(x) < F.lit(MOST / scale))
    checked = F.when(bounded, F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))) \
        .otherwise(F.raise_error(F.lit(f"a component is beyond {MOST // scale}: its codes would not be exact"))
                   .cast("array<bigint>"))
    return kept.select("vec_id", "label", checked.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; missing trailing components are 0."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _part(x: np.ndarray, p: int, parts: int) -> np.ndarray:
    step = x.shape[1] // parts
    return np.ascontiguousarray(x[:, p * step:(p + 1) * step])


def _to_blocks(width: int, parts: int, block: int, leaf: int):
    def made(ids, x):
        trees = [build(_part(x, p, parts), leaf) for p in range(parts)]
        payload = B.pack([x.ravel(), *[a for t in trees for a in t.arrays()]])
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())),
                                           "payload": pa.array([payload], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.zeros((0, width), np.int64)
        for batch in batches:
            ids += batch.column("key").to_pylist()
            held = np.concatenate([held, _matrix(batch.column("x"), width)])
            while len(ids) >= block:
                yield made(ids[:block], held[:block])
                ids, held = ids[block:], held[block:]
        if ids:
            yield made(ids, held)
    return run


def _blocks(batches, width: int, parts: int):
    for batch in batches:
        for i in range(batch.num_rows):
            arrays = B.unpack(batch.column("payload")[i].as_py(), [np.int64, *Tree.TYPES * parts])
            n = len(Tree.TYPES)
            trees = [Tree.of(arrays[1 + p * n:1 + (p + 1) * n]) for p in range(parts)]
            yield batch.column("ids")[i], arrays[0].reshape(-1, width), trees


def _sums(shared, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for _, x, trees in _blocks(batches, width, parts):
            for p in range(parts):
                t, c, _ = totals(trees[p], _part(x, p, parts), books[p])
                total[p] += t
                count[p] += c
        rows = [(p, k, int(count[p][k]), total[p][k].tolist()) for p in range(parts)
                for k in np.flatnonzero(count[p]).tolist()]
        if rows:
            part, entry, n, sums = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
                "n": pa.array(n, pa.int64()), "sums": pa.array(sums, pa.list_(pa.int64()))})
    return run


def _codes(shared, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for ids, x, trees in _blocks(batches, width, parts):
            error = np.zeros(len(x), np.int64)
            code = np.zeros((len(x), parts), np.uint8)
            for p in range(parts):
                points = _part(x, p, parts)
                code[:, p] = assigned(trees[p], points, books[p])
                d = points - books[p][code[:, p]]
                error += (d * d).sum(axis=1)
            yield pa.RecordBatch.from_pydict({
                "key": ids.values, "code": pa.array([r.tobytes().hex() for r in code], pa.string()),
                "error": pa.array(error, pa.int64())})
    return run


def first_books(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the ``entries`` rows with the smallest ids (null ids last,
    equal ids by their numbers)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    x = np.array([list(r.x) + [0] * (width - len(r.x)) for r in first], dtype=np.int64).reshape(len(first), width)
    return [_part(x, p, parts) for p in range(parts)]


def fit(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assignment and floored means; the sums of
    the entries are all that reaches the driver."""
    sc = blocks.sparkSession.sparkContext
    parts, width = len(books), sum(b.shape[1] for b in books)
    for _ in range(rounds):
        got = blocks.select("payload", "ids") \
            .mapInArrow(_sums(sc.broadcast(books), width, parts), "part int, entry int, n long, sums array<bigint>") \
            .groupBy("part", "entry") \
            .agg(F.sum("n").alias("n"),
                 F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width // parts)]).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in got:
            books[r.part][r.entry] = [s // r.n for s in r.sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every kept row.

    Rows whose vector is null or holds null or non-finite components are
    dropped; an empty vector has none and stays.  Vectors shorter than the
    longest one, and a length that ``parts`` does not divide, are filled with 0
    at the end.  A component beyond 2^27 / ``scale`` stops the job: its code
    could not be exact in 64 bits.  Null ids come last among the first entries;
    with equal ids the smaller numbers come first; repeated rows count again.
    Fewer rows than ``entries`` give shorter codebooks; an empty table gives an
    empty result.  Null labels are one label.  Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: between 1 and 256 entries")
    sc = vectors.sparkSession.sparkContext
    rows = whole_numbers(vectors, scale)
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    width = max(1, -(-longest // parts)) * parts
    books = first_books(rows, width, parts, entries)
    # a row is found again by its place in the checkpointed table
    keyed = cut_lineage(rows.withColumn("key", F.monotonically_increasing_id()))
    blocks = cut_lineage(keyed.select("key", "x").mapInArrow(_to_blocks(width, parts, block, leaf),
                                                             "ids array<bigint>, payload binary"))
    books = fit(blocks, books, rounds)
    coded = blocks.mapInArrow(_codes(sc.broadcast(books), width, parts), "key long, code string, error long")
    coded = cut_lineage(keyed.select("key", "vec_id", "label").join(coded, "key"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))) \
        .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


ships(__name__)
