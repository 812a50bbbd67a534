"""Phrases whose words occur together more often than their parts explain.

Counting every n-gram of a corpus exactly would shuffle nearly as many rows as
it has words, almost all of them seen once or twice.  Here they are found in
two passes:

1. *Summaries.*  Each task numbers the words of a chunk of texts, hashes all
   n-grams of 1 to ``longest`` words and sends, per hash partition, the number
   of n-grams it saw (its mass) and their packed hashes and counts.  The masses
   sort first, so a reducer knows the mass of its partition before it merges a
   single count.  It keeps a Misra-Gries summary of ``mass // least + 1``
   counters, or of ``COUNTERS`` if that is more: whenever more are held, the
   largest value that leaves no more is taken off all of them.  What is taken
   off is below ``mass / capacity``, so below ``least``: every n-gram seen
   ``least`` times or more survives, with at most that error.
2. *Exact counts.*  The survivors' hashes become a bit table of bounded size
   that is broadcast.  A second pass counts the n-grams whose bit (and whose
   shorter parts' bits) are set, by their words, and sends them packed to the
   same hash partitions, where the counts are added up.  A full table only lets
   more n-grams through; the counts are exact.

A task's Python holds one chunk or one hash partition, and works on both in
blocks; the JVM only moves packed rows.  So memory depends neither on the input
nor on how much passes.

Scores compare every phrase with the parts of its weakest cut, in decimals
that hold products beyond 64 bits.
"""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut_lineage, ships

LONGEST = 3
LEAST = 10
INSIDE_PERCENT = 50
TOP = 2000
#: Tokens of a chunk; bytes of a text that are split at a time.
CHUNK = 1 << 20
SLICE = 1 << 20
#: Bytes of text behind one hash partition, and the bounds of their number.
PARTITION_BYTES = 4 << 20
MIN_BITS, MAX_BITS = 5, 16
#: N-grams that are hashed, or rows that are written, at a time.
BLOCK = 1 << 15
#: Bytes of phrases that wait to be added up.
SUM_BYTES = 4 << 20
#: The partition of the numbers of all words.
TOTALS = -1
#: Counters a summary has at least: most partitions hold fewer n-grams.
COUNTERS = 1 << 20
#: The bit table holds at most 2^29 bits (64 MB).
MAX_TABLE_BITS = 29
UNKNOWN = "und"
#: Subsets of a language's phrases that are ranked apart before the last step.
RANK_SPREAD = 32

#: Not a byte of UTF-8: stands for the end of a piece.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _BREAK * 10 + b" ")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


# -------------------------------------------------------------- tokens

def pieces_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of a text, ``_BREAK`` where a piece ends."""
    return raw.lower().translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in slices that end after a separator (whole words)."""
    marked = raw.translate(_TABLE).replace(_BREAK, b" ") if len(raw) > size else b""
    a = 0
    while len(raw) - a > size:
        b = marked.find(b" ", a + size)
        if b < 0:
            break
        yield raw[a:b + 1]
        a = b + 1
    yield raw[a:]


class _Numbers(dict):
    """Numbers of the words of one language in a chunk."""

    def __init__(self, chunk, lang: str):
        super().__init__({_BREAK: 0})
        self.chunk, self.lang = chunk, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.chunk.words)
        self.chunk.words.append(word)
        self.chunk.lang_of.append(self.lang)
        return number


class Chunk:
    """Tokens as numbers (0: the end of a piece or text).  The first ``seen``
    ones were counted with the chunk before and only give context."""

    def __init__(self):
        self.words, self.lang_of = [_BREAK], [""]
        self.numbers: dict[str, _Numbers] = {}
        self.ids, self.seen = array("I"), 0

    def of(self, lang: str) -> _Numbers:
        got = self.numbers.get(lang)
        if got is None:
            got = self.numbers[lang] = _Numbers(self, lang)
        return got

    def following(self, lang: str, longest: int) -> Chunk:
        """An empty chunk that goes on inside the same text."""
        out = Chunk()
        last = self.ids[-(longest - 1):] if longest > 1 else []
        out.ids.extend(out.of(lang)[self.words[i]] for i in last)
        out.seen = len(out.ids)
        return out

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, all numbers, first places) of the n-grams that end here."""
        ids = np.frombuffer(self.ids, np.uint32)
        whole = np.ones(len(ids), dtype=bool)
        for n in range(1, longest + 1):
            if n > len(ids):
                return
            whole = whole[:len(ids) - n + 1] & (ids[n - 1:] != 0)
            place = np.flatnonzero(whole)
            yield n, ids, place[place + n > self.seen]

    def context(self, n: int) -> np.ndarray:
        """First places of the n-grams inside the part that was seen before."""
        return np.array([p for p in range(self.seen - n + 1) if all(self.ids[p:p + n])], np.int64)

    def hashes(self) -> np.ndarray:
        seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in self.numbers}
        out = np.zeros(len(self.words), np.uint64)
        out[1:] = [xxhash.xxh3_64_intdigest(w, seeds[lang]) for w, lang in zip(self.words[1:], self.lang_of[1:])]
        return out


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    for a in range(0, len(x), BLOCK):
        yield x[a:a + BLOCK]


def gram_hash(hashes: np.ndarray, ids: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(place), n, np.uint64)
    for k in range(n):
        h = B.mix(h + hashes[ids[place + k]] * _FACTORS[k % len(_FACTORS)])
    return h


def chunks(batches, longest: int, size: int = CHUNK, part: int = SLICE) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text")
        for i, lang in enumerate(langs):
            for raw in _slices(texts[i].as_buffer().to_pybytes(), part):
                chunk.ids.extend(map(chunk.of(lang).__getitem__, pieces_of(raw)))
                if len(chunk.ids) - chunk.seen >= size:
                    yield chunk
                    chunk = chunk.following(lang, longest)
            chunk.ids.append(0)
    if len(chunk.ids) > chunk.seen:
        yield chunk


def _give_back() -> None:
    """Hand what Arrow and the C library keep for later back to the system:
    between stages a worker waits beside a JVM that has work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# ----------------------------------------------------------- summaries

def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences, byte planes apart, and counts."""
    gaps = keys.astype(np.uint32)
    gaps[1:] -= keys[:-1]
    planes = np.concatenate([gaps.view(np.uint8).reshape(-1, 4).T.ravel(),
                             counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    gaps, counts = (np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel() for x in np.split(raw, 2))
    return np.cumsum(gaps, dtype=np.uint32), counts


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    if c.max() < 1 << 32:  # both in one number
        both = k.astype(np.uint64)
        both <<= np.uint64(32)
        both |= c.astype(np.uint64)
        both.sort()
        k, c = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    else:
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first, dtype=np.int64)


class Summary:
    """Misra-Gries counters for a known mass: of what occurs ``least`` times
    or more nothing is lost, and ``value + error`` bounds every count."""

    def __init__(self, mass: int, least: int, counters: int = 0):
        self.least, self.capacity, self.error = least, max(mass // least + 1, counters), 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        self.keys, self.counts = _added([self.keys, *[k for k, _ in self.waiting]],
                                        [self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        if len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            off = int(np.partition(self.counts, at)[at])
            self.error += off
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.error >= self.least]


def _hashes(chunk: Chunk, longest: int) -> np.ndarray:
    """The hashes of all n-grams that end in a chunk, ascending."""
    hashes = chunk.hashes()
    out, n_out = np.empty(longest * len(chunk.ids), np.uint64), 0
    for n, ids, place in chunk.grams(longest):
        for block in _blocks(place):
            out[n_out:n_out + len(block)] = gram_hash(hashes, ids, block, n)
            n_out += len(block)
    out = out[:n_out]
    out.sort()
    return out


def _summaries(longest: int, bits: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for chunk in chunks(batches, longest, size):
            keys = _hashes(chunk, longest)
            del chunk  # before the next one grows
            bound = np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])
            part = np.flatnonzero(np.diff(bound))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int32()), "mass": pa.array(np.diff(bound)[part], pa.int64()),
                "counts": pa.nulls(len(part), pa.binary())})
            # so many partitions at a time that hold a block of n-grams, or one
            for group in np.split(part, np.flatnonzero(np.diff(bound[part] // BLOCK)) + 1):
                if not len(group):
                    continue
                a = bound[group[0]]
                found = (keys[a:bound[group[-1] + 1]] << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
                new = np.append(True, found[1:] != found[:-1])
                new[bound[group] - a] = True
                first = np.flatnonzero(new)
                counts = np.diff(first, append=len(found))
                found = found[first]
                cut = np.append(np.searchsorted(first, bound[group] - a), len(first)).tolist()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(group, pa.int32()), "mass": pa.nulls(len(group), pa.int64()),
                    "counts": pa.array([pack_counts(found[i:j], counts[i:j]) for i, j in zip(cut, cut[1:])],
                                       pa.binary())})
            del keys
        _give_back()
    return run


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part, summary):
            kept = summary.survivors()
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "n": pa.array([len(kept)], pa.int64()),
                "error": pa.array([summary.error], pa.int64()), "keys": pa.array([kept.tobytes()], pa.binary())})

        now, mass, summary = None, 0, None
        for batch in batches:
            packed = batch.column("counts")
            for i, (p, m) in enumerate(zip(batch.column("part").to_pylist(), batch.column("mass").to_pylist())):
                if p != now:
                    if summary is not None:
                        yield done(now, summary)
                    now, mass, summary = p, 0, None
                if m is not None:
                    mass += m
                else:
                    summary = summary or Summary(mass, least, COUNTERS)
                    summary.add(*unpack_counts(packed[i].as_buffer()))
        if summary is not None:
            yield done(now, summary)
        summary = None
        _give_back()
    return run


def survivors(rows: DataFrame, bits: int, least: int = LEAST, longest: int = LONGEST, size: int = CHUNK) -> DataFrame:
    """``part, n, error, keys``: per hash partition the hashes that may belong
    to an n-gram seen ``least`` times or more, and the error of its summary."""
    return rows.mapInArrow(_summaries(longest, bits, size), "part int, mass long, counts binary") \
        .repartition("part").sortWithinPartitions("part", F.col("mass").asc_nulls_last()) \
        .mapInArrow(_merged(least), "part int, n long, error long, keys binary")


def _table_slices(bits: int, table_bits: int):
    """The bits of one hash partition are neighbours in the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("keys").to_pylist():
                flags = np.zeros(1 << (table_bits - bits), np.uint8)
                flags[np.frombuffer(raw, np.uint32) >> np.uint32(32 - (table_bits - bits))] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "flags": pa.array(out, pa.binary())})
    return run


def bit_table(kept: DataFrame, bits: int) -> np.ndarray:
    """About 16 bits for each survivor, between 8 a partition and 2^29 in all."""
    n = kept.agg(F.sum("n")).first()[0] or 0
    table_bits = min(max((16 * n).bit_length(), bits + 3), max(MAX_TABLE_BITS, bits + 3), bits + 31)
    table = np.zeros(1 << (table_bits - 3), np.uint8)
    wide = 1 << (table_bits - bits - 3)
    for r in kept.mapInArrow(_table_slices(bits, table_bits), "part int, flags binary").toLocalIterator():
        table[r.part * wide:(r.part + 1) * wide] = np.frombuffer(r.flags, np.uint8)
    return table


# -------------------------------------------------------- exact counts

def _known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _planes(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def pack_phrases(lengths: np.ndarray, counts: np.ndarray, data: bytes) -> bytes:
    head = np.array([len(counts)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + _planes(lengths) + _planes(counts) + data)


def unpack_phrases(payload: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n = int(raw[:4].view(np.uint32)[0])
    ends = np.append(0, np.cumsum(_unplaned(raw[4:4 + 4 * n]), dtype=np.int64))
    keys = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[4 + 8 * n:])])
    return keys, _unplaned(raw[4 + 4 * n:4 + 8 * n])


class _Writer:
    """Phrases of a chunk as bytes: the language, ``_BREAK`` and the words."""

    def __init__(self, chunk: Chunk):
        langs = list(chunk.numbers)
        code = {lang: len(chunk.words) + i for i, lang in enumerate(langs)}
        self.lang = np.fromiter((code.get(x, 0) for x in chunk.lang_of), np.int64, len(chunk.lang_of))
        entries = [w + b" " for w in chunk.words] + [x.encode() + _BREAK for x in langs]
        self.length = np.fromiter(map(len, entries), np.int64, len(entries))
        self.start = np.cumsum(self.length) - self.length
        self.text = np.frombuffer(b"".join(entries), np.uint8)

    def totals(self, ids: np.ndarray) -> bytes:
        """The number of words of every language, packed."""
        total = np.bincount(self.lang[ids])
        lang = np.flatnonzero(total)
        return pack_phrases(self.length[lang], total[lang],
                            B.gather(self.text, self.start[lang], self.length[lang]).tobytes())

    def written(self, ids: np.ndarray, place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and their number for every phrase."""
        ends = np.cumsum(words + 1)
        start = ends - words - 1
        entry = np.empty(ends[-1], np.int64)
        entry[start] = self.lang[ids[place]]
        for k in range(1, words.max() + 1):
            of = np.flatnonzero(words >= k)
            entry[start[of] + k] = ids[place[of] + k - 1]
        length = self.length[entry]
        length[ends - 1] -= 1
        return B.gather(self.text, self.start[entry], length), np.add.reduceat(length, start)


def _found(chunk: Chunk, hashes: np.ndarray, table: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first places, counts) of the n-grams that pass the table."""
    number = None
    for n, ids, place in chunk.grams(longest):
        # what was seen before is not counted here, but a part of what is
        place = np.concatenate([chunk.context(n), place])
        if n > 1:
            place = place[(number[place] >= 0) & (number[place + 1] >= 0)]  # its parts passed
        known = [_known(table, gram_hash(hashes, ids, block, n)) for block in _blocks(place)]
        place = place[np.concatenate(known)] if known else place
        # the n-grams of the places, numbered by their words
        if n == 1:
            numbers, first = ids[place], np.zeros(len(hashes), np.int64)
            first[numbers] = place
        else:
            key = number[place] * np.int64(len(hashes)) + ids[place + n - 1]
            _, first, numbers = np.unique(key, return_index=True, return_inverse=True)
            first = place[first]
            del key
        counts = np.bincount(numbers[place + n > chunk.seen])
        number = np.full(len(ids) + 1, -1, np.int64)
        number[place] = numbers
        del numbers
        here = np.flatnonzero(counts)
        yield n, first[here], counts[here]


def _counted(chunk: Chunk, table: np.ndarray, longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    def batch(parts, payloads):
        return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "counts": pa.array(payloads, pa.binary())})

    hashes, writer, ids = chunk.hashes(), _Writer(chunk), np.frombuffer(chunk.ids, np.uint32)
    new = ids[chunk.seen:]
    if new.any():
        yield batch([TOTALS], [writer.totals(new[new != 0])])
    part, place, words, counts = [], [], [], []
    for n, at, c in _found(chunk, hashes, table, longest):
        part += [(gram_hash(hashes, ids, block, n) >> np.uint64(64 - bits)).astype(np.uint32) for block in _blocks(at)]
        place.append(at.astype(np.uint32))
        words.append(np.full(len(at), n, np.uint16))
        counts.append(c.astype(np.uint32))
    if not part:
        return
    part, place, words, counts = map(np.concatenate, (part, place, words, counts))
    order = np.argsort(part, kind="stable").astype(np.uint32)
    bound = np.searchsorted(part[order], np.arange((1 << bits) + 1))
    del part, hashes
    parts = np.flatnonzero(np.diff(bound))
    for group in np.split(parts, np.flatnonzero(np.diff(bound[parts] // BLOCK)) + 1):
        a, b = bound[group[0]], bound[group[-1] + 1]
        of = order[a:b]
        data, length = writer.written(ids, place[of].astype(np.int64), words[of].astype(np.int64))
        end = np.append(0, np.cumsum(length))
        cut = np.append(bound[group], b) - a
        c = counts[of]
        yield batch(group, [pack_phrases(length[i:j], c[i:j], data[end[i]:end[j]].tobytes())
                            for i, j in zip(cut.tolist(), cut[1:].tolist())])


def _exact(shared, longest: int, size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for chunk in chunks(batches, longest, size):
            yield from _counted(chunk, table, longest, bits)
            del chunk  # before the next one grows
        _give_back()
    return run


class Sums:
    """Counts of phrases, added up whenever ``SUM_BYTES`` are waiting, or as
    many as are held."""

    def __init__(self):
        self.keys, self.counts = pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        self.waiting: list[tuple[pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, keys: pa.Array, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += keys.nbytes
        if self.size > max(SUM_BYTES, self.keys.nbytes):
            self.merge()

    def merge(self) -> None:
        keys = pa.concat_arrays([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        self.waiting, self.size = [], 0
        coded = keys.dictionary_encode()
        at = coded.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        self.keys = coded.dictionary
        self.counts = np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else self.counts

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        """The phrases counted ``least`` times or more."""
        self.merge()
        for block in _blocks(np.flatnonzero(self.counts >= least)):
            lang, _, phrase = zip(*[k.partition(_BREAK) for k in self.keys.take(pa.array(block)).to_pylist()])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(lang, pa.binary()).cast(pa.string()),
                "phrase": pa.array(phrase, pa.binary()).cast(pa.string()),
                "words": pa.array([p.count(b" ") + 1 if p else 0 for p in phrase], pa.int32()),
                "a": pa.array(self.counts[block], pa.int64())})


def _summed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            packed = batch.column("counts")
            for i, p in enumerate(batch.column("part").to_pylist()):
                if p != now:
                    if sums is not None:
                        yield from sums.rows(0 if now == TOTALS else least)
                    now, sums = p, Sums()
                sums.add(*unpack_phrases(packed[i].as_buffer()))
        if sums is not None:
            yield from sums.rows(0 if now == TOTALS else least)
        sums = None
        _give_back()
    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = CHUNK) -> DataFrame:
    """``lang, phrase, words, a``: every n-gram of 1 to ``longest`` words seen
    ``least`` times or more, with its exact count; the number of all words of a
    language stands beside the empty phrase (``words`` 0).  Checkpointed."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((n_bytes // PARTITION_BYTES).bit_length(), MIN_BITS), MAX_BITS)
    kept = cut_lineage(survivors(rows, bits, least, longest, size))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(kept, bits))
    counted = rows.mapInArrow(_exact(shared, longest, size, bits), "part int, counts binary") \
        .repartition("part").sortWithinPartitions("part") \
        .mapInArrow(_summed(least), "lang string, phrase string, words int, a long")
    return cut_lineage(counted)


# -------------------------------------------------------------- scores

def _exactly(count: str) -> Column:
    return F.col(count).cast("decimal(15,0)")


def weakest_cuts(grams: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` of the lowest-scoring cut of every
    phrase of two or more words (ties: the earliest)."""
    word = F.split("phrase", " ")
    cuts = grams.filter("words >= 2") \
        .select("lang", "phrase", "words", "a", word.alias("w"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")) \
        .select("lang", "phrase", "words", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
                F.array_join(F.expr("slice(w, k + 1, words)"), " ").alias("rest"))
    side = lambda key, count: grams.select(F.col("lang").alias(f"_{key}_lang"), F.col("phrase").alias(f"_{key}"),
                                           F.col("a").alias(count))
    parted = cuts
    for key, count in (("first", "l"), ("rest", "r")):
        parted = parted.join(side(key, count), (F.col("lang") == F.col(f"_{key}_lang")) & (F.col(key) == F.col(f"_{key}")))
    scored = parted.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (_exactly("a") * _exactly("a"))) \
        .withColumn("bottom", _exactly("l") * _exactly("r")) \
        .withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def covered(grams: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """``lang, phrase, most``: phrases inside a longer one, with the highest
    count of such a longer one."""
    word = F.split("phrase", " ")
    inside = F.expr("flatten(transform(sequence(2, words - 1), t -> transform(sequence(1, words - t + 1), "
                    "s -> array_join(slice(w, s, t), ' '))))")
    return grams.filter("words >= 3").select("lang", "words", "a", word.alias("w")) \
        .select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = INSIDE_PERCENT,
                 top: int = TOP, size: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every
    language.

    Null texts and blank ones hold no words, a null ``lang`` is ``und``;
    repeated rows count again; very long texts are read in slices; an empty
    table gives an empty result; ids and other columns are ignored.  Ties of
    score go by count, then by the phrase's bytes.
    """
    counts = frequent_phrases(docs, least, longest, size)
    grams = counts.filter("words > 0")
    inner = covered(grams).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "most")
    scored = weakest_cuts(grams).join(inner, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")),
                                      "left") \
        .filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SPREAD))
    near = scored.withColumn("part", spread) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))) \
        .filter(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))) \
        .filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select(F.col("lang").alias("_in"), F.col("a").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("_in")) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ships(__name__)
