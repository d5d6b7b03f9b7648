"""Sources and sinks for streams of keyed readings."""

from driftwell.streaming.io import drain, folder_stream, rate_readings, rate_regressions, to_console, to_folder
from driftwell.streaming.late import PeriodStream

__all__ = ["PeriodStream", "drain", "folder_stream", "rate_readings", "rate_regressions", "to_console", "to_folder"]
