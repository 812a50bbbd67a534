"""Removal of byte or word ranges from texts: the last step of both
repeated-passage operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, ships

def merge(starts, ends) -> list[tuple[int, int]]:
    """Union of ranges as maximal runs (touching ranges become one)."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut_bytes(raw: bytes, ranges: list[tuple[int, int]]):
    kept, at = [], 0
    for s, e in ranges:
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return len(raw), b"".join(kept)


def _cut_words(raw: bytes, ranges: list[tuple[int, int]]):
    words = raw.split()
    n = len(words)
    if ranges:
        kept, at = [], 0
        for s, e in ranges:
            kept += words[at:s]
            at = e
        words = kept + words[at:]
    return n, b" ".join(words)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: what is shuffled to meet the spans."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch.column("text")
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "rid": batch.column("rid"),
            "packed": pa.array([pack(texts[i].as_buffer()) for i in range(len(texts))], pa.binary())})


def _apply(cut: Callable, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = batch.column("packed")
            spans = batch.column("spans")
            size, removed, count, digest, out = [], [], [], [], []
            for i in range(batch.num_rows):
                got = spans[i].as_py()
                ranges = merge([x["s"] for x in got], [x["e"] for x in got]) if got else []
                n, rest = cut(unpack(texts[i].as_buffer()), ranges)
                size.append(n)
                removed.append(sum(e - s for s, e in ranges))
                count.append(len(ranges))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    out.append(rest.decode("utf-8", "replace"))
            cols = {"doc_id": batch.column("doc_id"), "size": pa.array(size, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(count, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                cols["kept_text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_pydict(cols)
    return run


def remove_spans(rows: DataFrame, spans: DataFrame, unit: str, with_text: bool = False) -> DataFrame:
    """Cut ``spans`` (doc_id, rid, s, e) out of ``rows`` (doc_id, rid, text).

    ``unit`` is "byte" or "word".  A row without spans keeps its text.  The
    list of spans of one document is bounded by the document's own length.
    The id that stands for a missing one becomes missing again.
    """
    per_doc = spans.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("s", "e")).alias("spans")) \
        .select(F.col("rid").alias("_rid"), F.col("doc_id").alias("_doc"), "spans")
    packed = rows.mapInArrow(_compress, "doc_id long, rid long, packed binary")
    joined = packed.join(per_doc, (F.col("doc_id") == F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left") \
        .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "packed", "spans")
    schema = "doc_id long, size long, n_removed long, n_spans long, kept_sha256 string" + \
        (", kept_text string" if with_text else "")
    return joined.mapInArrow(_apply(_cut_bytes if unit == "byte" else _cut_words, with_text), schema)


ships(__name__)
