"""Reading and writing."""

from .tables import (
    append_metrics,
    apply_dictionary,
    dictionary,
    encode,
    log_metrics,
    read_csv,
    read_dictionary,
    scan,
    scan_jdbc,
    scan_table,
    stage,
    stage_bucketed,
    write_csv,
)

__all__ = [n for n in dir() if not n.startswith("_")]
