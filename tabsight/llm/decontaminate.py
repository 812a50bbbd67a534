"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised alike (ASCII lower case, words joined by one
space).  An item of m bytes that occurs in a text with at most k edits shares
at least ``m - q + 1 - q * k`` q-grams with it, all of them on k + 1
neighbouring diagonals (text position less item position).  Diagonals are
dealt into bands that overlap by k, so some band holds them all: bands with
enough shared q-grams are retained and verified by banded alignment, all
candidates of a chunk at a time.

Items are read in blocks of bounded size; each block meets every document
whole, in its own map over the documents, without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import row_key, ships, text_rows, whole_rows

Q = 10
EDIT_RATE = 0.07
#: Longer items are cut into regions of this many bytes, overlapping by half.
REGION = 512
#: Bytes of benchmark text sent to the executors at once.
BLOCK_BYTES = 8 << 20
_CHUNK_BYTES = 4 << 20
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalise(raw: bytes) -> bytes:
    return b" ".join(raw.lower().split())


def edit_budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """The largest number of edits up to ``rate * m`` for which the lemma
    still asks for at least one shared q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


def regions(items: list[tuple], size: int = REGION) -> list[tuple[object, bytes]]:
    """Normalised items, the long ones cut into half-overlapping regions."""
    out = []
    for item, raw in items:
        text = normalise(raw)
        if len(text) <= size:
            if text:
                out.append((item, text))
            continue
        for a in range(0, len(text) - size // 2, size // 2):
            out.append((item, text[a:a + size]))
    return out


class QgramIndex:
    """Sorted q-gram keys of all regions with their (region, position)."""

    def __init__(self, parts: list[tuple[object, bytes]], q: int, rate: float):
        self.q, self.parts = q, parts
        self.size = np.array([len(t) for _, t in parts], dtype=np.int64)
        self.budget = np.array([edit_budget(len(t), q, rate) for _, t in parts], dtype=np.int64)
        # a region shorter than q is looked up whole, at its own length
        self.short = [i for i, (_, t) in enumerate(parts) if len(t) < q]
        self.need = np.maximum(1, self.size - q + 1 - q * self.budget)
        self.band = np.maximum(16, 2 ** np.ceil(np.log2(self.budget + 1)).astype(np.int64))
        data = np.frombuffer(b"\n".join(t for _, t in parts) + b"\n" * (q + 8), dtype=np.uint8)
        begin = np.cumsum(self.size + 1) - self.size - 1
        grams = np.maximum(self.size - q + 1, 0)
        region = np.repeat(np.arange(len(parts)), grams)
        pos = np.arange(len(region)) - np.repeat(np.cumsum(grams) - grams, grams)
        key = self.keys(data)[begin[region] + pos] if len(region) else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.region, self.pos = key[order], region[order], pos[order]
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[self.slot(self.key)] = True

    def keys(self, data: np.ndarray) -> np.ndarray:
        """Hash of the q bytes at every position (q >= 8)."""
        words = B.unaligned_words(data)
        n = len(data) - self.q + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if self.q == 8:
            return words[:n] * np.uint64(1)
        return words[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + words[self.q - 8:self.q - 8 + n]

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * _MULTIPLIER) >> np.uint64(64 - _BITS)

    def hits(self, data: np.ndarray):
        """All (text position, region, item position) with equal q-grams."""
        key = self.keys(data)
        at = np.flatnonzero(self.bitmap[self.slot(key)])
        key = key[at]
        lo = np.searchsorted(self.key, key, side="left")
        found = lo < len(self.key)
        found[found] = self.key[lo[found]] == key[found]
        at, lo, key = at[found], lo[found], key[found]
        n = np.searchsorted(self.key, key, side="right") - lo
        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.region[where], self.pos[where]


def candidates(index: QgramIndex, data: np.ndarray, doc_begin: np.ndarray):
    """(document, region, first diagonal of the band, shared q-grams) of every
    band that holds enough shared q-grams of a region."""
    at, region, pos = index.hits(data)
    doc = np.searchsorted(doc_begin, at, side="right") - 1
    diagonal = at - doc_begin[doc] - pos + index.size[region]  # never negative
    band = diagonal // index.band[region]
    also = (diagonal - band * index.band[region] < index.budget[region]) & (band > 0)
    doc = np.concatenate([doc, doc[also]])
    band = np.concatenate([band, band[also] - 1])
    region = np.concatenate([region, region[also]])
    if len(doc) == 0:
        return doc, region, band, doc
    order = np.lexsort((band, region, doc))
    d, r, b = doc[order], region[order], band[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (b[1:] != b[:-1])))
    count = np.diff(np.append(first, len(d)))
    d, r, b = d[first], r[first], b[first]
    enough = count >= index.need[r]
    d, r, b, count = d[enough], r[enough], b[enough], count[enough]
    return d, r, b * index.band[r] - index.size[r], count


def banded_distance(text: list[bytes], offset: np.ndarray, item: list[bytes], width: int) -> np.ndarray:
    """Fewest edits of each ``item`` against any part of its ``text``, on
    paths that stay on ``width`` diagonals from ``offset`` on."""
    n = len(item)
    m = np.array([len(x) for x in item])
    top = int(m.max())
    a = np.zeros((n, top), dtype=np.uint8)
    t = np.zeros((n, top + width), dtype=np.uint8)  # column c of row i: text byte offset + i + c
    for j in range(n):
        a[j, :m[j]] = np.frombuffer(item[j], dtype=np.uint8)
        lo = max(0, int(offset[j]))
        piece = text[j][lo:int(offset[j]) + top + width]
        s = lo - int(offset[j])
        t[j, s:s + len(piece)] = np.frombuffer(piece, dtype=np.uint8)
    step = np.arange(width)
    cost = np.zeros((n, width), dtype=np.int32)  # free start anywhere in the band
    best = np.zeros(n, dtype=np.int32)
    for i in range(top):
        differ = t[:, i:i + width] != a[:, i:i + 1]
        new = cost + differ  # the next byte of both
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # an item byte that the text lacks
        new = np.minimum.accumulate(new - step, axis=1) + step  # text bytes that the item lacks
        cost = new
        done = m == i + 1
        if done.any():
            best[done] = cost[done].min(axis=1)
    return best


def _verify(index: QgramIndex, texts: list[bytes], doc, region, diagonal, shared):
    """(document, region, start, distance, shared) of verified candidates."""
    out = []
    todo = []
    for j in range(len(doc)):
        text, part = texts[doc[j]], index.parts[region[j]][1]
        k, width = int(index.budget[region[j]]), int(index.band[region[j]])
        lo = max(0, int(diagonal[j]) - k)
        hit = text.find(part, lo, int(diagonal[j]) + width + 2 * k + len(part) + 1)
        if hit >= 0:  # no edit needed on this diagonal
            out.append((doc[j], region[j], hit, 0, shared[j]))
        elif k:
            todo.append(j)
    by_width: dict[int, list[int]] = {}
    for j in todo:
        by_width.setdefault(int(index.band[region[j]] + 3 * index.budget[region[j]] + 1), []).append(j)
    for width, group in by_width.items():
        for g in range(0, len(group), 512):
            some = group[g:g + 512]
            offset = np.array([diagonal[j] - index.budget[region[j]] for j in some])
            best = banded_distance([texts[doc[j]] for j in some], offset,
                                   [index.parts[region[j]][1] for j in some], width)
            for j, e in zip(some, best.tolist()):
                if e <= index.budget[region[j]]:
                    out.append((doc[j], region[j], max(0, int(diagonal[j])), e, shared[j]))
    return out


def _scan(shared_items, q: int, rate: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            if index is None:
                index = QgramIndex(regions(shared_items.value, size), q, rate)
            ids = batch.column("doc_id").to_pylist()
            column = batch.column("text")
            rows, texts, held = [], [], 0
            found: list[tuple] = []

            def flush():
                if not texts:
                    return
                data = np.frombuffer(b"\n".join(texts) + b"\n" * (q + 8), dtype=np.uint8)
                size_of = np.array([len(x) + 1 for x in texts], dtype=np.int64)
                begin = np.cumsum(size_of) - size_of
                hits = _verify(index, texts, *candidates(index, data, begin)) if len(index.key) else []
                for i in index.short:  # too short for q-grams: whole words of the text, no edits
                    part = index.parts[i][1]
                    hits += [(d, i, (b" " + x + b" ").find(b" " + part + b" "), 0, 0)
                             for d, x in enumerate(texts) if b" " + part + b" " in b" " + x + b" "]
                found.extend((ids[rows[d]], index.parts[r][0], int(s), int(s) + int(index.size[r]),
                              int(e), int(c)) for d, r, s, e, c in hits)
                rows.clear()
                texts.clear()

            for i in range(batch.num_rows):
                text = normalise(column[i].as_buffer().to_pybytes())
                rows.append(i)
                texts.append(text)
                held += len(text)
                if held >= _CHUNK_BYTES:
                    flush()
                    held = 0
            flush()
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols],
                    names=["doc_id", "item_id", "start", "end", "distance", "shared"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE,
                 size: int = REGION, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, start, end, distance, shared``: one row for each
    document and item that meet within the edit budget; the occurrence with
    the fewest edits, then the first.  Positions are bytes of the normalised
    text (``end`` is where the item's length ends).

    Null, empty and blank texts and items match nothing.  Rows with a null
    document or item id take part and keep the null.  Repeated rows give one
    result row.  Items shorter than ``q`` bytes match only as whole words.
    Empty tables give an empty result; other columns are ignored.
    """
    if q < 8:
        raise ValueError("q-grams have 8 bytes or more")
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text") \
        .filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-2 * total // block_bytes))
    rows = text_rows(docs)
    out = None
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        collected = [(r.item_id, r.text.encode()) for r in block.collect()]
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(collected), q, rate, size),
                                "doc_id long, item_id long, start long, end long, distance long, shared long")
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("distance", "start", "end", (-F.col("shared")).alias("less"))).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best) \
        .select("doc_id", "item_id", "x.start", "x.end", "x.distance", (-F.col("x.less")).alias("shared"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item."""
    keyed = text_rows(docs).select(row_key().alias("doc_id"), "text")
    bad = contaminated(keyed, benchmark, **options).select(F.col("doc_id").alias("_r")).distinct()
    return whole_rows(docs).join(bad, F.col("key_rid") == F.col("_r"), "left_anti").select("row.*")


ships(__name__)
