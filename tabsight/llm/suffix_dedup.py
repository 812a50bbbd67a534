"""Repeated passages by suffix sorting (deep-shallow).

Finds every byte that lies in a string of ``length`` bytes which starts at two
or more places of the corpus.

1. *Map.*  Every document is scanned once.  For each start position the
   smallest hashed ``gram`` inside its ``length`` bytes is its anchor; equal
   strings have equal anchors at equal offsets, so only suffixes under one
   anchor gram need to be compared.  Grams that many documents share (found on
   a bounded sample, and only used to choose anchors, so results do not depend
   on it) are chosen last: text around a line that a third of all documents
   hold is anchored beside the line, and goes to many buckets.  Neighbouring starts with one anchor
   travel as one packed string (their shared bytes once).  Packed strings
   that repeat inside a task are settled there: all are repeats, and one of
   them travels.
2. *Shuffle* by the anchor gram, as compressed blocks.
3. *Sort.*  In each bucket the suffixes of anchors seen more than once are
   ordered by multikey quicksort on five bytes a round, to a shallow depth;
   groups that still share a prefix are ordered by blind tries: each suffix is
   compared with one leaf of its trie, and branches at the first differing
   byte.  A suffix that agrees with another over the whole ``length`` is a
   repeat.
4. Repeats become byte ranges, joined back to their documents and removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import hash_sample, row_key, ships, task_count, text_rows
from .spans import NO_ID, remove_spans

LENGTH = 200
GRAM = 32
SHALLOW_ROUNDS = 2
#: Documents looked at for frequent grams, and the share that makes one.
SAMPLE_ROWS = 2_000
FREQUENT_SHARE = 0.01
_POSITION_BITS = 20
_CHUNK = 1 << _POSITION_BITS
_FLUSH_BYTES = 32 << 20

_STRING_TYPES = [np.int64, np.int64, np.int64, np.uint16, np.uint16, np.uint8]
_SPAN_TYPES = [np.int64, np.int64, np.int64, np.int64]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(document, from, to): documents cut so that no piece exceeds a chunk;
    neighbouring pieces share ``length - 1`` bytes, so each start is in one."""
    for doc in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[doc]), int(offsets[doc + 1])
        while b - a > _CHUNK:
            yield doc, a, a + _CHUNK
            a += _CHUNK - (length - 1)
        yield doc, a, b


def _chunks(offsets: np.ndarray, length: int):
    group, size = [], 0
    for piece in _pieces(offsets, length):
        n = piece[2] - piece[1]
        if group and size + n > _CHUNK:
            yield group
            group, size = [], 0
        group.append(piece)
        size += n
    if group:
        yield group


def anchored_strings(data: np.ndarray, length: int, gram: int, valid: np.ndarray, frequent: B.HashSet):
    """Packed strings of one chunk: first start, number of starts, anchor
    position and anchor hash; and the prefix sums of the chunk."""
    pre = B.prefix(data)
    at = np.arange(len(data) - gram + 1)
    h = B.range_hash(pre, at, at + gram)
    low = np.uint64(_CHUNK - 1)
    smallest = B.sliding_min(B.selection_key(h, frequent, low), length - gram + 1)
    starts = np.flatnonzero(valid[:len(smallest)])
    anchor = (low - (smallest[starts] & low)).astype(np.int64)
    if len(starts) == 0:
        return starts, starts, anchor, h[:0], pre
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    count = np.diff(np.append(first, len(starts)))
    return starts[first], count, anchor[first], h[anchor[first]], pre


class _Packer:
    """Collects packed strings of one task and emits blocks by bucket."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, raw, length, doc, rid, lo, count, offset, key, digest):
        self.parts.append((raw, length, doc, rid, lo, count, offset, key, digest))
        self.size += len(raw)

    def flush(self, extra: int) -> Iterator[tuple[int, int, bytes]]:
        """``extra`` = bytes of a packed string beyond its number of starts."""
        if not self.parts:
            return
        raw, length, doc, rid, lo, count, offset, key, digest = \
            (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        begin = np.cumsum(length) - length
        # equal strings of this task: confirmed on the bytes, one travels
        ident = B.mix(key ^ (digest * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(ident, kind="stable")
        same = np.append(False, ident[order][1:] == ident[order][:-1])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        pair = np.flatnonzero(same)
        words = B.unaligned_words(B.padded(raw))
        a, b = order[pair], head[pair]
        equal = (length[a] == length[b]) & (offset[a] == offset[b])
        a, b = a[equal], b[equal]
        full = B.first_difference(words, begin[a], begin[b], length[a]) == length[a]
        a, b = a[full], b[full]
        known = np.zeros(len(length), dtype=bool)
        known[a] = True
        known[b] = True
        travels = np.ones(len(length), dtype=bool)
        travels[a] = False
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        k = np.flatnonzero(known)
        if len(k):
            yield from self._blocks(0, B.mix(doc[k].view(np.uint64) + rid[k].view(np.uint64)) % np.uint64(self.buckets),
                                    [doc[k], rid[k], lo[k], lo[k] + count[k] - 1 + extra])
        t = np.flatnonzero(travels)
        by = t[np.argsort(bucket[t], kind="stable")]
        cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(by)).tolist()):
            pick = by[i:j]
            yield int(bucket[pick[0]]), 1, B.pack(
                [doc[pick], rid[pick], lo[pick], count[pick].astype(np.uint16),
                 offset[pick].astype(np.uint16), known[pick].astype(np.uint8),
                 B.gather(raw, begin[pick], length[pick])])

    @staticmethod
    def _blocks(kind: int, bucket: np.ndarray, arrays: list[np.ndarray]):
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
            pick = order[i:j]
            yield int(bucket[pick[0]]), kind, B.pack([x[pick] for x in arrays])


def blocks_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, payload = zip(*rows)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()),
                                       "kind": pa.array(kind, pa.int32()),
                                       "payload": pa.array(payload, pa.binary())})


def _gram_sets(gram: int):
    """Distinct gram hashes of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            for _, a, b in _pieces(offsets, gram):
                at = np.arange(b - a - gram + 1)
                h = np.unique(B.range_hash(B.prefix(data[a:b]), at, at + gram))
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64), pa.int64())})
    return run


def frequent_hashes(sample: DataFrame, sets, share: float, least: int = 8) -> list[int]:
    """Hashes that a share of the sampled documents hold (signed longs).  The
    sample bounds their number."""
    n = sample.count()
    found = sample.mapInArrow(sets, "h long").groupBy("h").count() \
        .filter(F.col("count") >= max(least, int(share * n)))
    return sorted(r.h for r in found.select("h").collect())


def _map(length: int, gram: int, buckets: int, hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        frequent = B.HashSet(np.array(hashes.value, dtype=np.int64).view(np.uint64))
        for batch in batches:
            data, offsets = B.text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for group in _chunks(offsets, length):
                doc, a, b = (np.array(x, dtype=np.int64) for x in zip(*group))
                size = b - a
                chunk = data[a[0]:b[0]] if len(group) == 1 else B.gather(data, a, size)
                base = np.cumsum(size) - size
                step = np.zeros(len(chunk) + 1, dtype=np.int8)
                step[base] += 1
                np.add.at(step, base + size - length + 1, -1)
                valid = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
                lo, count, anchor, key, pre = anchored_strings(chunk, length, gram, valid, frequent)
                if len(lo) == 0:
                    continue
                span = count - 1 + length
                owner = np.searchsorted(base, lo, side="right") - 1
                packer.add(B.gather(chunk, lo, span), span, ids[doc[owner]], rids[doc[owner]],
                           lo - base[owner] + a[owner] - offsets[doc[owner]], count, anchor - lo,
                           key, B.range_hash(pre, lo, lo + span))
                if packer.size >= _FLUSH_BYTES:
                    yield blocks_batch(list(packer.flush(length)))
        rows = list(packer.flush(length))
        if rows:
            yield blocks_batch(rows)
    return run


def _split_groups(group: np.ndarray, key: np.ndarray):
    """Order elements by (group, key); new dense groups; singletons dropped.

    ``group`` is sorted.  Returns the kept order and its group numbers."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
    number = np.cumsum(new) - 1
    size = np.bincount(number)
    keep = size[number] > 1
    return order[keep], number[keep]


def _five_bytes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words[at].byteswap() >> np.uint64(24)


def repeated_suffixes(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, length: int,
                      shallow_rounds: int = SHALLOW_ROUNDS) -> np.ndarray:
    """Which of the suffixes at ``start`` agree with another one of the same
    ``bucket`` over ``length`` bytes (each has that many bytes left)."""
    words = B.unaligned_words(B.padded(data))
    found = np.zeros(len(start), dtype=bool)
    live = np.argsort(bucket, kind="stable")
    group = bucket[live]
    depth = 0
    for _ in range(shallow_rounds):  # shallow: multikey quicksort, five bytes a round
        if depth + 5 > length or len(live) == 0:
            break
        pick, group = _split_groups(group, _five_bytes(words, start[live] + depth))
        live = live[pick]
        depth += 5
    while len(live):  # deep: one level of every blind trie at a time
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        head = np.repeat(live[first], size)
        limit = np.full(len(live), length, dtype=np.int64)
        lcp = B.first_difference(words, start[live], start[head], limit, min(depth, length))
        full = lcp >= length
        others = full & (live != head)
        found[live[others]] = True
        found[head[others]] = True
        rest = np.flatnonzero(~full)
        if len(rest) == 0:
            break
        branch = lcp[rest] * 256 + data[start[live[rest]] + lcp[rest]]
        pick, group = _split_groups(group[rest], branch.astype(np.uint64))
        live = live[rest][pick]
    return found


def _sort_bucket(parts: list[list[np.ndarray]], length: int, gram: int):
    doc, rid, lo, count, offset, known, data = (np.concatenate(x) for x in zip(*parts))
    count, offset = count.astype(np.int64), offset.astype(np.int64)
    span = count - 1 + length
    begin = np.cumsum(span) - span
    words = B.unaligned_words(B.padded(data))
    key = np.zeros(len(begin), dtype=np.uint64)
    anchor = begin + offset
    for j in range(0, gram, 8):
        key = B.mix(key * B.BASE + words[anchor + j])
    _, number, seen = np.unique(key, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(seen[number] > 1)
    if len(pick) == 0:
        return None
    n = count[pick]
    owner = np.repeat(pick, n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    bucket = number[owner] * np.int64(length) + (offset[owner] - step + length) % length
    found = repeated_suffixes(data, begin[owner] + step, bucket, length)
    first, last = B.runs(found, owner, step)
    o = owner[first]
    return doc[o], rid[o], lo[o] + step[first], lo[o] + step[last] + length


def _reduce(length: int, gram: int):
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
            parts = [B.unpack(x, [*_STRING_TYPES, np.uint8]) for x in strings.pop(bucket)]
            got = _sort_bucket(parts, length, gram)
            if got is not None and len(got[0]):
                yield span_batch(*got)
    return run


def span_batch(doc, rid, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()),
                                       "rid": pa.array(rid, pa.int64()),
                                       "s": pa.array(s, pa.int64()),
                                       "e": pa.array(e, pa.int64())})


SPAN_SCHEMA = "doc_id long, rid long, s long, e long"
BLOCK_SCHEMA = "bucket int, kind int, payload binary"


def keyed_rows(docs: DataFrame) -> DataFrame:
    """doc_id (a missing one as the least long), rid, text.

    ``rid`` tells rows of one id apart by their content; where all ids differ
    it is 0, which takes no room in what is shuffled."""
    rows = text_rows(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    rid = row_key() if repeated else F.lit(0).cast("long")
    return rows.select("doc_id", rid.alias("rid"), "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   buckets: int | None = None) -> DataFrame:
    """Byte ranges ``(doc_id, rid, s, e)`` covered by strings of ``length``
    bytes that start at two or more places."""
    return _repeated_spans(keyed_rows(docs), length, gram, buckets)


def _repeated_spans(rows: DataFrame, length: int, gram: int, buckets: int | None) -> DataFrame:
    if not 0 < gram <= length or gram % 8:
        raise ValueError("gram must be a multiple of 8, at most the length")
    spark = rows.sparkSession
    buckets = buckets or task_count(spark, 4)
    hashes = frequent_hashes(hash_sample(rows, SAMPLE_ROWS, "doc_id"), _gram_sets(gram), FREQUENT_SHARE)
    shared = spark.sparkContext.broadcast(hashes)
    blocks = rows.mapInArrow(_map(length, gram, buckets, shared), BLOCK_SCHEMA)
    return blocks.repartitionById(buckets, F.col("bucket")) \
        .mapInArrow(_reduce(length, gram), SPAN_SCHEMA)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null texts and empty texts have no bytes and give the digest of nothing.
    Rows with a null id take part like others and keep the null id.  A row
    that is given twice repeats itself: both lose all strings of ``length``
    bytes.  An empty table gives an empty result; other columns of ``docs``
    are ignored.  ``with_text`` adds ``kept_text`` (bytes that no longer form
    a character are replaced).
    """
    rows = keyed_rows(docs)
    spans = _repeated_spans(rows, length, gram, buckets)
    return remove_spans(rows, spans, "byte", with_text).withColumnRenamed("size", "n_bytes")


ships(__name__)
