"""Sources and sinks: parquet test tables, the canonical line adapter, the
reference-format CSV reader, the data dictionary and result sinks."""

from shipcast.sources.tables import read_table  # noqa: F401
from shipcast.sources.adapter import canonical_lines, lines, orders_frame  # noqa: F401
