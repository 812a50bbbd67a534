"""Scalar column expressions shared by the operators.

All of them are built-in Spark expressions, so they stay inside
whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as a number when converted the way the
# reference converts text to numbers (optional sign, decimal or exponent
# notation, or an infinity word; surrounding blanks allowed).  Everything
# else -- '1d', '1_000', '1,000', '0x1A', 'nan', '' -- is not a number.
NUMERIC_TEXT_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"

# Date formats tried, in this order, when text is converted
# to a timestamp.  The first format that parses a value wins.
DEFAULT_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
)

# The text shape each date format can match.  Parsing is only
# attempted on text of that shape (a failed parse is far more costly than a
# regex test), so the guard must accept everything the format parses.
DATE_FORMAT_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd.MM.yyyy": r"^\d{2}\.\d{2}\.\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}

NUMBER, TEXT, DATETIME, BOOLEAN, OTHER = "number", "text", "datetime", "boolean", "other"


def ref(name) -> Column:
    """A column by its exact name: dots and spaces in user column names are
    not read as struct access.  Columns are passed through."""
    if isinstance(name, Column):
        return name
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    """The name as a quoted identifier (for APIs that take names as text)."""
    return "`" + name.replace("`", "``") + "`"


def family_of(dtype: T.DataType) -> str:
    """Map a Spark type onto the reference's dtype families.

    Booleans are kept apart from numbers (the reference profiles them as
    neither a metric nor a dimension).
    """
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def columns_of(df: DataFrame, family: str) -> list[str]:
    """Names of the columns of one family, in schema order (no job runs)."""
    return [f.name for f in df.schema.fields if family_of(f.dataType) == family]


def _is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (pandas ``isna``)."""
    col = ref(name)
    if _is_fractional(df.schema[name].dataType):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL (kept as is for other types)."""
    col = ref(name)
    if _is_fractional(df.schema[name].dataType):
        return F.nanvl(col, F.lit(None).cast(df.schema[name].dataType))
    return col


def is_numeric_text(col: Column) -> Column:
    """True when the text converts to a number (regex guard, see above)."""
    return col.rlike(NUMERIC_TEXT_PATTERN)


def to_numeric(col: Column) -> Column:
    """Text to double, NULL when it is not a number (``errors='coerce'``)."""
    return F.when(is_numeric_text(col), F.trim(col).try_cast("double"))


# The text that each field of a date format reads.
FORMAT_FIELDS = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}",
                 "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}", "H": r"\d{1,2}", "hh": r"\d{2}", "h": r"\d{1,2}",
                 "mm": r"\d{2}", "ss": r"\d{2}", "a": "[AaPp][Mm]"}


def format_pattern(fmt: str) -> str | None:
    """Regular expression of the text a format reads; None where a field of it
    is not in ``FORMAT_FIELDS`` (fractions of seconds are)."""
    out = ""
    for match in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", fmt):
        token = match.group(0)
        if token[0] == "'":
            out += re.escape(token[1:-1])
        elif token[0] == "S":
            out += rf"\d{{1,{len(token)}}}"
        elif token[0].isalpha():
            if token not in FORMAT_FIELDS:
                return None
            out += FORMAT_FIELDS[token]
        else:
            out += re.escape(token)
    return f"^{out}$"


def parse_with(col: Column, fmt: str) -> Column:
    """Parse text with one format; NULL when it does not parse.

    Known formats are tried only on text of their shape (see above); their
    text has a fixed length (the pattern without quotes), which is compared
    first because it is much cheaper than the regex.
    """
    # Read as UTC and kept as wall-clock time, so that no hour of the session's
    # zone (a daylight-saving gap) shifts a value.
    instant = F.try_to_timestamp(F.concat(col, F.lit(" +0000")), F.lit(f"{fmt} Z"))
    parsed = F.timestamp_add("MICROSECOND", F.unix_micros(instant),
                             F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    shape = DATE_FORMAT_SHAPES.get(fmt)
    if not shape:
        guard = format_pattern(fmt)
        return F.when(col.rlike(guard), parsed) if guard else parsed
    length = len(fmt.replace("'", ""))
    return F.when((F.length(col) == length) & col.rlike(shape), parsed)


def parse_datetime(col: Column, formats=DEFAULT_DATE_FORMATS) -> Column:
    """Text (or timestamp/date) to ``timestamp_ntz``; unparseable -> NULL."""
    parsed = [parse_with(col, fmt) for fmt in formats] or [F.lit(None)]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def period_label(ts: Column, freq: str) -> Column:
    """Calendar period a timestamp falls in, labelled like pandas resample.

    Y -> Dec 31 of the year, M -> last day of the month, W -> the Sunday
    ending the week (Sunday included), D -> the day itself.
    """
    freq = freq.upper()
    day = F.to_date(ts)
    if freq == "Y":
        return F.make_date(F.year(ts), F.lit(12), F.lit(31))
    if freq == "M":
        return F.last_day(day)
    if freq == "W":
        # date_trunc('week') goes back to Monday; the week ends six days on.
        return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)
    if freq == "D":
        return day
    raise ValueError(f"unknown frequency {freq!r}")


def floor_days(start: Column, end: Column) -> Column:
    """Whole days between two timestamps, floored (timedelta ``.days``).

    Computed on the wall-clock values (``timestamp_ntz``), so the session
    time zone and its daylight-saving shifts play no part.
    """
    micros = F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(86_400_000_000))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of raising on a zero divisor."""
    return F.try_divide(num, den)
