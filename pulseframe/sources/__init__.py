from pulseframe.sources.activity_log import activity_events, read_activity_log
from pulseframe.sources.canonical import accepted, rejected
from pulseframe.sources.infer import classify_files, classify_uploads, infer_source
from pulseframe.sources.loader import load_events, parse_files, sample_files

__all__ = [
    "accepted",
    "activity_events",
    "classify_files",
    "classify_uploads",
    "infer_source",
    "load_events",
    "parse_files",
    "read_activity_log",
    "rejected",
    "sample_files",
]
