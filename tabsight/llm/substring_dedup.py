"""Repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words.  The smallest hashed run of
``minimiser`` words inside a window decides its bucket, so equal windows meet
there.  Consecutive windows with the same minimiser travel as one packed
string (words joined by one space), in compressed blocks.  In its bucket each
packed string is unfolded into windows, which are sorted; equal neighbours
(confirmed on their bytes) are counted exactly, and a window is a repeat if
its sequence also starts in a document with a smaller id.

Word runs that many documents share (found on a bounded sample, and only
used to choose minimisers) are chosen last, so that a frequent phrase gathers
few windows.  Within a map task equal packed strings are settled before the shuffle: those
of a document with a larger id are repeats for certain, and only the ones of
the smallest id travel, so a sequence held by a third of all documents
reaches its bucket once a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import hash_sample, ships, task_count
from .spans import NO_ID, remove_spans
from .suffix_dedup import (BLOCK_SCHEMA, FREQUENT_SHARE, SAMPLE_ROWS, SPAN_SCHEMA, blocks_batch, frequent_hashes,
                           keyed_rows, span_batch)

WIDTH = 13
MINIMISER = 3
_POSITION_BITS = 20
_CHUNK_WORDS = 1 << 17
_FLUSH_BYTES = 32 << 20
_HASH_BYTES = 1 << 20
_TYPES = [np.int64, np.int64, np.int64, np.uint16, np.uint32, np.uint8]
_SPAN_TYPES = [np.int64] * 4
_LAST = np.int64(2**63 - 1)


def _rank(doc: np.ndarray) -> np.ndarray:
    """Order of ids; a missing id comes after all others."""
    return np.where(doc == NO_ID, _LAST, doc)


def run_hashes(word_hash: np.ndarray, minimiser: int) -> np.ndarray:
    """Hash of the ``minimiser`` words from every word on."""
    n = max(0, len(word_hash) - minimiser + 1)
    h = word_hash[:n].copy()
    for j in range(1, minimiser):
        h = B.mix(h * B.BASE + word_hash[j:j + n])
    return h


def super_kmers(word_hash: np.ndarray, valid: np.ndarray, width: int, minimiser: int, frequent: B.HashSet):
    """(first window, number of windows, minimiser hash) of each packed string."""
    h = run_hashes(word_hash, minimiser)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    smallest = B.sliding_min(B.selection_key(h, frequent, low), width - minimiser + 1)
    starts = np.flatnonzero(valid[:len(smallest)])
    if len(starts) == 0:
        return starts, starts, h[:0]
    anchor = (low - (smallest[starts] & low)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(first, len(starts)))
    return starts[first], count, h[anchor[first]]


class _Packer:
    def __init__(self, buckets: int, width: int):
        self.buckets, self.width = buckets, width
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, *arrays):
        self.parts.append(arrays)
        self.size += len(arrays[0])

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.parts:
            return
        raw, length, doc, rid, lo, count, key, digest = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        begin = np.cumsum(length) - length
        rank = _rank(doc)
        order = np.lexsort((rank, digest))  # by content, the smallest id first
        same = np.append(False, digest[order][1:] == digest[order][:-1])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        pair = np.flatnonzero(same)
        a, b = order[pair], head[pair]
        later = (rank[a] > rank[b]) & (length[a] == length[b])
        a, b = a[later], b[later]
        words = B.unaligned_words(B.padded(raw))
        a = a[B.first_difference(words, begin[a], begin[b], length[a]) == length[a]]
        travels = np.ones(len(length), dtype=bool)
        travels[a] = False
        if len(a):
            to = B.mix(doc[a].view(np.uint64) + rid[a].view(np.uint64)) % np.uint64(self.buckets)
            yield from self._blocks(0, to, a, lambda p: [doc[p], rid[p], lo[p],
                                                         lo[p] + count[p] - 1 + self.width])
        t = np.flatnonzero(travels)
        yield from self._blocks(1, key[t] % np.uint64(self.buckets), t, lambda p: [
            doc[p], rid[p], lo[p], count[p].astype(np.uint16), length[p].astype(np.uint32),
            B.gather(raw, begin[p], length[p])])

    @staticmethod
    def _blocks(kind, bucket, rows, columns):
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
            yield int(bucket[order[i]]), kind, B.pack(columns(rows[order[i:j]]))


def _spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts with words joined by one space, each text closed by one; and
    the number of words of each text."""
    data, off = B.text_buffers(texts)
    parts = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    joined = b"".join(p + b" " for p in parts if p)
    return np.frombuffer(joined, dtype=np.uint8), np.array([p.count(32) + (p != b"") for p in parts], dtype=np.int64)


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of text."""
    size = np.diff(B.text_buffers(batch.column("text"))[1])
    part = (np.cumsum(size) - 1) // most
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(size) else size
    for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(size)).tolist()):
        yield batch.slice(i, j - i)


def _document_groups(n_words: np.ndarray, width: int):
    """Ranges of words of about one chunk; a longer document is cut with an
    overlap of ``width - 1`` words.  Yields lists of (doc, from, to)."""
    first = np.cumsum(n_words) - n_words
    group, size = [], 0
    for doc in np.flatnonzero(n_words >= width).tolist():
        a, b = int(first[doc]), int(first[doc] + n_words[doc])
        while a + width <= b:
            c = min(b, a + _CHUNK_WORDS)
            if group and size + (c - a) > _CHUNK_WORDS:
                yield group
                group, size = [], 0
            group.append((doc, a, c))
            size += c - a
            if c == b:
                break
            a = c - (width - 1)
    if group:
        yield group


def _run_sets(minimiser: int):
    """Distinct hashes of the word runs of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            data, n_words = _spaced(batch.column("text"))
            end = np.flatnonzero(data == 32)
            start = np.append(0, end[:-1] + 1) if len(end) else end
            first = np.cumsum(n_words) - n_words
            for doc in np.flatnonzero(n_words >= minimiser).tolist():
                s, e = start[first[doc]:first[doc] + n_words[doc]], end[first[doc]:first[doc] + n_words[doc]]
                h = run_hashes(B.range_hash(B.prefix(data[s[0]:e[-1]]), s - s[0], e - s[0]), minimiser)
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(h).view(np.int64), pa.int64())})
    return run


def _map(width: int, minimiser: int, buckets: int, hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, width)
        frequent = B.HashSet(np.array(hashes.value, dtype=np.int64).view(np.uint64))
        for batch in (part for whole in batches for part in _slices(whole)):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            data, n_words = _spaced(batch.column("text"))
            end = np.flatnonzero(data == 32)
            start = np.append(0, end[:-1] + 1) if len(end) else end
            doc_first = np.cumsum(n_words) - n_words
            for group in _document_groups(n_words, width):
                doc, a, b = (np.array(x, dtype=np.int64) for x in zip(*group))
                size = b - a
                base = np.cumsum(size) - size
                word = np.repeat(a - base, size) + np.arange(int(size.sum()))
                # words of neighbouring documents lie together, so one slice of bytes holds them
                cut0, cut1 = int(start[word[0]]), int(end[word[-1]])
                pre = B.prefix(data[cut0:cut1])
                ws, we = start[word] - cut0, end[word] - cut0
                valid = np.zeros(len(word) + 1, dtype=np.int32)
                np.add.at(valid, base, 1)
                np.add.at(valid, base + size - width + 1, -1)
                lo, count, key = super_kmers(B.range_hash(pre, ws, we),
                                             np.cumsum(valid[:-1]) > 0, width, minimiser, frequent)
                if len(lo) == 0:
                    continue
                s, e = ws[lo], we[lo + count + width - 2]
                owner = np.searchsorted(base, lo, side="right") - 1
                d = doc[owner]
                packer.add(B.gather(data[cut0:cut1], s, e - s), e - s, ids[d], rids[d],
                           word[lo] - doc_first[d], count, key, B.range_hash(pre, s, e))
                if packer.size >= _FLUSH_BYTES:
                    yield blocks_batch(list(packer.flush()))
        rows = list(packer.flush())
        if rows:
            yield blocks_batch(rows)
    return run


def _sort_bucket(parts, width: int):
    doc, rid, lo, count, size, data = (np.concatenate(x) for x in zip(*parts))
    count, size = count.astype(np.int64), size.astype(np.int64)
    begin = np.cumsum(size) - size
    n_words = count + width - 1
    # word ends: the spaces inside a string and the string's own end
    space = np.flatnonzero(data == 32)
    inner = n_words - 1
    slot = np.arange(len(space)) + np.repeat(np.arange(len(count)), inner)
    w_end = np.empty(int(n_words.sum()), dtype=np.int64)
    w_end[slot] = space
    last = np.cumsum(n_words) - 1
    w_end[last] = begin + size
    w_start = np.empty_like(w_end)
    w_start[1:] = w_end[:-1] + 1
    w_start[last - n_words + 1] = begin
    owner = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (last - n_words + 1)[owner] + step
    s, e = w_start[at], w_end[at + width - 1]
    del w_start, w_end, slot, space
    h = np.empty(len(s), dtype=np.uint64)
    cuts = np.append(np.searchsorted(begin, np.arange(0, len(data), _HASH_BYTES)), len(begin))
    first_window = np.append(np.cumsum(count) - count, len(s))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # prefix sums over some strings at a time
        if i < j:
            a, b = int(begin[i]), int(begin[j - 1] + size[j - 1])
            w = slice(int(first_window[i]), int(first_window[j]))
            h[w] = B.range_hash(B.prefix(data[a:b]), s[w] - a, e[w] - a)
    order = np.argsort(h)
    hs = h[order]
    new = np.append(True, hs[1:] != hs[:-1])
    number = np.cumsum(new) - 1
    seen = np.bincount(number)
    keep = seen[number] > 1
    order, number = order[keep], number[keep]
    if len(order) == 0:
        return None
    words = B.unaligned_words(B.padded(data))
    repeat = np.zeros(len(owner), dtype=bool)
    rank = _rank(doc)
    while len(order):
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        head = order[first][group]
        length = e[order] - s[order]
        equal = length == e[head] - s[head]
        match = np.flatnonzero(equal)
        equal[match] = B.first_difference(words, s[order[match]], s[head[match]],
                                          length[match]) == length[match]
        smallest = np.full(len(first), _LAST)
        np.minimum.at(smallest, group[equal], rank[owner[order[equal]]])
        repeat[order[equal]] = rank[owner[order[equal]]] > smallest[group[equal]]
        order, number = order[~equal], group[~equal]  # windows that only share a hash
    first, last_of = B.runs(repeat, owner, step)
    o = owner[first]
    return doc[o], rid[o], lo[o] + step[first], lo[o] + step[last_of] + width


def _reduce(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[int, list] = {}
        for batch in batches:
            kinds = batch.column("kind").to_pylist()
            buckets = batch.column("bucket").to_pylist()
            payload = batch.column("payload")
            for i, kind in enumerate(kinds):
                raw = payload[i].as_buffer()
                if kind == 0:
                    yield span_batch(*B.unpack(raw, _SPAN_TYPES))
                else:
                    strings.setdefault(buckets[i], []).append(raw.to_pybytes())
        for bucket in list(strings):
            parts = [B.unpack(x, _TYPES) for x in strings.pop(bucket)]
            got = _sort_bucket(parts, width)
            if got is not None and len(got[0]):
                yield span_batch(*got)
    return run


def repeated_word_spans(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER,
                        buckets: int | None = None) -> DataFrame:
    """Word ranges ``(doc_id, rid, s, e)`` covered by windows whose sequence
    also starts in a document with a smaller id."""
    return _repeated_word_spans(keyed_rows(docs), width, minimiser, buckets)


def _repeated_word_spans(rows: DataFrame, width: int, minimiser: int, buckets: int | None) -> DataFrame:
    if not 0 < minimiser <= width:
        raise ValueError("the minimiser has at least one word and fits the window")
    spark = rows.sparkSession
    buckets = buckets or task_count(spark, 6)
    hashes = frequent_hashes(hash_sample(rows, SAMPLE_ROWS, "doc_id"), _run_sets(minimiser), FREQUENT_SHARE)
    shared = spark.sparkContext.broadcast(hashes)
    blocks = rows.mapInArrow(_map(width, minimiser, buckets, shared), BLOCK_SCHEMA)
    return blocks.repartitionById(buckets, F.col("bucket")) \
        .mapInArrow(_reduce(width), SPAN_SCHEMA)


def remove_repeated_windows(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER,
                            buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept_sha256`` for every row.

    Null and empty texts have no words.  Rows with a null id come after all
    ids: they lose what any other document holds and take nothing from others.
    Rows with one id never remove each other's words, so a repeated row stays
    as it is.  An empty table gives an empty result; other columns are
    ignored.  ``with_text`` adds the kept words.
    """
    rows = keyed_rows(docs)
    spans = _repeated_word_spans(rows, width, minimiser, buckets)
    return remove_spans(rows, spans, "word", with_text).withColumnRenamed("size", "n_words")


ships(__name__)
