"""Date formats found in text columns instead of listed.

Every value is reduced to its shape: digits become ``9``, month names ``A``
(short) or ``F`` (full) and a day-half mark ``P``, the rest stays.  Only shapes
that a date can have are kept (a finite set, see ``SHAPE``; all other text is
one group), so the histogram of shapes is small whatever the table.  One pass
over all text columns counts shapes and keeps the extremes of the first two
fields, which decide whether the day or the month comes first.  Tasks count
Arrow batches: digits are masked in the bytes of a whole batch, and month names
and shapes are looked for once for each masked text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_DATE_FORMATS, TEXT, family_of, parse_with, ref

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Month names and the shapes of dates and times of day.
MONTHS_FULL = ("January|February|March|April|June|July|August|September|October|November|December")
MONTHS_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SEPARATORS = "-/."
DATE_SHAPES = [*(f"9999[{s}]99?[{s}]99?" for s in SEPARATORS), *(f"99?[{s}]99?[{s}]9999" for s in SEPARATORS),
               "99999999", "[AF][.]? 99?,? 9999", "99? [AF],? 9999", "99?-[AF]-9999"]
TIME_SHAPE = r"([ T]99?:99(:99([.]9{1,6})?)?( ?P)?Z?)?"
SHAPE = f"^({'|'.join(DATE_SHAPES)}){TIME_SHAPE}$"
SHORTEST, LONGEST = 8, 44

HISTOGRAM = ("column string, ordinal int, shape string, rows bigint, chars bigint, max_first int, max_second int, "
             "high_first bigint, high_second bigint")


#: Byte by byte: digits become 9.
_MASK = np.array([ord("9") if 48 <= b <= 57 else b for b in range(256)], np.uint8)
#: Masked texts whose shape a task remembers at once.
_KNOWN = 50_000


def _shape_of(masked: str) -> tuple | None:
    """(shape, byte spans of the first two fields, None where one is no number)
    of a text with its digits masked; None if no date has that shape."""
    if "9" not in masked:
        return None
    shape = masked
    if re.search("[A-Za-z]", masked):
        # letters A, F and P of the text itself are no marks
        if re.search("[AFP]", masked) and not re.search("[A-Za-z]{2}", masked):
            return None
        marks = re.ASCII | re.IGNORECASE
        shape = re.sub(rf"\b({MONTHS_FULL})\b", "F", masked, flags=marks)
        shape = re.sub(rf"\b({MONTHS_SHORT})\b", "A", shape, flags=marks)
        shape = re.sub("(9 ?)[ap]m", r"\1P", shape, flags=marks)
    # a carriage return may be left at the end of a line
    if not re.fullmatch(f"(?:{SHAPE[1:-1]})[\r\x85\u2028\u2029]?", shape):
        return None
    fields = [m.span() if set(m.group()) == {"9"} else None for m in re.finditer("[0-9A-Za-z]+", masked)][:2]
    return shape, fields + [None] * (2 - len(fields))


def _count_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histogram of one task's rows; columns are pairs of short text and length."""
    tally: dict[tuple, list] = {}
    known: dict[str, tuple | None] = {}

    def add(key, rows, chars, most=(None, None), high=(0, 0)):
        have = tally.setdefault(key, [0, 0, None, None, 0, 0])
        have[0] += rows
        have[1] += chars
        for k in range(2):
            have[2 + k] = max((x for x in (have[2 + k], most[k]) if x is not None), default=None)
            have[4 + k] += high[k]

    for batch in batches:
        for i in range(0, batch.num_columns, 2):
            lengths = batch.column(i + 1).drop_null()
            rows, chars = len(lengths), pc.sum(lengths).as_py() or 0
            texts = pa.concat_arrays([batch.column(i).cast(pa.string()).drop_null()])
            if len(texts):
                _, ends, data = texts.buffers()
                starts = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts)]
                raw = np.frombuffer(data, np.uint8)
                masked = pa.Array.from_buffers(pa.string(), len(texts), [None, ends, pa.py_buffer(_MASK[raw])],
                                               offset=texts.offset).dictionary_encode()
                codes = masked.indices.to_numpy()
                order, bounds = np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))
                for k, text in enumerate(masked.dictionary.to_pylist()):
                    if text not in known:
                        if len(known) >= _KNOWN:
                            known.clear()
                        known[text] = _shape_of(text)
                    if known[text] is None:
                        continue
                    shape, fields = known[text]
                    at = starts[order[bounds[k - 1] if k else 0:bounds[k]]]
                    most, high = [None, None], [0, 0]
                    for f, span in enumerate(fields):
                        if span:
                            value = np.zeros(len(at), np.int64)
                            for p in range(*span):
                                value = value * 10 + raw[at + p] - 48
                            most[f], high[f] = int(value.max()), int((value > 12).sum())
                    add((i // 2, shape), len(at), len(at) * len(text), most, high)
                    rows, chars = rows - len(at), chars - len(at) * len(text)
            if rows:
                add((i // 2, None), rows, chars)
    if tally:
        names = ("rows", "chars", "max_first", "max_second", "high_first", "high_second")
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pydict(
            {"ordinal": pa.array([c for c, _ in tally], pa.int32()), "shape": pa.array([x for _, x in tally], pa.string())}
            | {n: pa.array([v[k] for v in tally.values()], t) for k, (n, t) in enumerate(zip(names, types))})


def date_shapes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Histogram of date shapes of all text columns, one pass.

    (column, ordinal, shape, rows, chars, max_first, max_second, high_first,
    high_second): ``chars`` is the length of the texts, ``max_*`` the largest
    value of the first and second field, ``high_*`` how many of them are above
    12.  Present text of no date shape has a NULL shape; NULL is not counted.
    """
    cols = [c for c in (df.columns if cols is None else cols)
            if c in df.columns and family_of(df.schema[c].dataType) == TEXT]
    if not cols:
        return df.sparkSession.createDataFrame([], HISTOGRAM)
    pairs = []
    for i, c in enumerate(cols):
        text = ref(c).cast("string")
        # long texts do not come along
        pairs += [F.when(F.length(text).between(SHORTEST, LONGEST), text).alias(f"t{i}"),
                  F.length(text).alias(f"n{i}")]
    counted = df.select(*pairs).mapInArrow(_count_shapes, HISTOGRAM.removeprefix("column string, "))
    return counted.groupBy(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("ordinal") + 1).alias("column"),
                           "ordinal", "shape").agg(
        *[F.sum(x).alias(x) for x in ("rows", "chars")], *[F.max(x).alias(x) for x in ("max_first", "max_second")],
        *[F.sum(x).alias(x) for x in ("high_first", "high_second")])


def _group(shape: str) -> tuple:
    """What formats of one kind share: date family, punctuation, time form."""
    date, time = re.fullmatch(r"(.*?)((?:[ T]99?:.*)?)", shape).groups()
    kind = re.sub("99?(?!9)", "n", date.replace("9999", "y")) if date != "99999999" else date
    return kind, re.sub("[.]9+", ".f", re.sub("^([ T])99?:", r"\1h:", time))


def _format(group: tuple, shapes: Sequence[str], day_first: bool) -> str:
    """The format that reads every shape of one group."""
    kind, time = group
    if kind == "99999999":
        date = "yyyyMMdd"
    else:
        fields = [re.findall("9+|[AF]", re.split("[ T](?=99?:)", s)[0]) for s in shapes]
        narrow = [min(len(f[k]) for f in fields) == 1 for k in range(3)]
        month = "MMM" if "A" in kind else "MMMM" if "F" in kind else None
        if kind.startswith("y"):
            order = ["yyyy", "M" if narrow[1] else "MM", "d" if narrow[2] else "dd"]
        elif month and kind[0] in "AF":
            order = [month, "d" if narrow[1] else "dd", "yyyy"]
        elif month:
            order = ["d" if narrow[0] else "dd", month, "yyyy"]
        else:
            letters = "dM" if day_first else "Md"
            order = [x if narrow[k] else 2 * x for k, x in enumerate(letters)] + ["yyyy"]
        parts = iter(order)
        date = re.sub("[nyAF]", lambda _: next(parts), kind)
    if not time:
        return date
    half = "P" in time
    single = any(re.search("[ T]9:", s) for s in shapes)
    hour = ("h" if half else "H") * (1 if single else 2)
    digits = max((len(m.group(1)) for s in shapes if (m := re.search(r":99[.](9+)", s))), default=0)
    tail = time[2:].replace(":99", ":mm", 1).replace(":99", ":ss").replace(".f", "." + "S" * digits)
    lead = "'T'" if time[0] == "T" else " "
    return f"{date}{lead}{hour}{tail.replace('P', 'a').replace('Z', chr(39) + 'Z' + chr(39))}"


def formats_of_shapes(rows: Sequence[Mapping]) -> list[dict]:
    """Formats of one column from its histogram rows, most rows first.

    Each is ``format, rows, order_known, both_high``.  In numbers with the year
    last, a first field above 12 means the day comes first, a second one above
    12 the month; the order is decided over all shapes with that separator.
    Where both occur, the order that fits more rows is taken.  Where neither
    does, dots mean the day first and other separators the month.
    """
    groups, highs = {}, {}
    for r in rows:
        if r["shape"] is None:
            continue
        group = _group(r["shape"])
        groups.setdefault(group, []).append(r)
        high = highs.setdefault(group[0], [0, 0])
        high[0] += r["high_first"]
        high[1] += r["high_second"]
    out = []
    for group, members in groups.items():
        first, second = highs[group[0]]
        free = re.fullmatch("n[-/.]n[-/.]y", group[0]) is not None
        day_first = first > second or (first == second and "." in group[0])
        out.append({"format": _format(group, [m["shape"] for m in members], day_first),
                    "rows": sum(m["rows"] for m in members),
                    "order_known": not free or bool(first) != bool(second),
                    "both_high": free and bool(first) and bool(second)})
    return sorted(out, key=lambda f: (-f["rows"], f["format"]))


def found_formats(histogram: DataFrame) -> dict[str, list[dict]]:
    """``formats_of_shapes`` of every column of a histogram (a few rows each)."""
    by_column = {}
    for r in histogram.where(F.col("shape").isNotNull()).collect():
        by_column.setdefault(r["column"], []).append(r)
    return {c: formats_of_shapes(rows) for c, rows in by_column.items()}


def _kind(fmt: str) -> str:
    """Format without field widths and order, to tell what competes."""
    return re.sub("[dM]+", "n", re.sub("S+", "S", fmt)).replace("HH", "H")


def conversion_formats(df: DataFrame, cols: Sequence[str], later: bool = True) -> dict[str, list[str]]:
    """For each text column the formats found, most rows first, then the listed
    ones that do not compete with them (for data that comes ``later``; every
    value of ``df`` itself that a listed format reads has a shape, whose format
    is found)."""
    found = found_formats(date_shapes(df, cols))
    out = {}
    for c in cols:
        mine = [f["format"] for f in found.get(c, [])]
        if not later:
            out[c] = mine
            continue
        taken = {_kind(f) for f in mine}
        out[c] = mine + [f for f in DEFAULT_DATE_FORMATS if _kind(f) not in taken]
    return out


def column_formats(df: DataFrame, rows: Sequence[Mapping]) -> dict[str, str]:
    """The one format that reads every present value of a column, for the
    columns that have one; ``rows`` is the collected histogram.

    Only columns whose values all have date shapes are read a second time, to
    count the values that parse (a 30th of February has the shape of a date).
    """
    odd = {r["column"] for r in rows if r["shape"] is None}
    by_column = {}
    for r in rows:
        if r["column"] not in odd:
            by_column.setdefault(r["column"], []).append(r)
    wanted = [(c, f["format"], sum(r["rows"] for r in rs)) for c, rs in by_column.items()
              for f in formats_of_shapes(rs) if not f["both_high"]]
    if not wanted:
        return {}
    parsed = df.agg(*[F.count(parse_with(ref(c), f)).alias(f"n{i}") for i, (c, f, _) in enumerate(wanted)]).first()
    out = {}
    for i, (c, f, present) in enumerate(wanted):
        if parsed[f"n{i}"] == present:
            out.setdefault(c, f)
    return out
