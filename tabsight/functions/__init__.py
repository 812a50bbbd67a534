"""Column -> Column helpers (scalar and aggregate expressions)."""

from .scalars import (  # noqa: F401
    family_of, columns_of, is_missing, nan_to_null, is_numeric_text,
    to_numeric, parse_datetime, period_label, floor_days, safe_div,
    NUMERIC_TEXT_PATTERN, DEFAULT_DATE_FORMATS,
)
from .aggregates import (  # noqa: F401
    sample_skewness, pairwise_corr, count_missing,
)
