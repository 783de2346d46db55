from baroflow.sources.cmi_text import parse_cmi_lines, read_cmi_csv, read_cmi_text, station_records  # noqa: F401
from baroflow.sources.isd_text import (  # noqa: F401
    clean_isd,
    isd_readings,
    isd_rejects,
    read_isd_text,
    station_table,
    unite_time,
)
from baroflow.sources.sinks import write_csv, write_events  # noqa: F401
from baroflow.sources.station_csv import read_station_csv, union_sources  # noqa: F401
