"""Reading and writing: CSV with pandas-style missing tokens, records,
preparation specs, samples and previews."""

from .csv import read_csv, write_csv, PANDAS_NA_TOKENS  # noqa: F401
from .records import to_records, write_records  # noqa: F401
from .spec import save_spec, load_spec  # noqa: F401
from .sampling import sample_rows, sample_fraction, preview, head_tail  # noqa: F401
