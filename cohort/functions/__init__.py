"""Column expressions: all built in, so they stay inside whole-stage code generation.

Every conditional treats an unknown (null) predicate as "leave the value alone".
"""

from .bins import bucketize, discretize_delay
from .flags import changed_flag, has_value, label, positive_flag, presence_flag, score
from .parse import lenient_int, lenient_number, parse_date, synth_date
from .recode import (
    clamp,
    fill_when,
    group_into,
    normalize_case,
    null_if,
    recode,
    recode_like,
    repair_if,
    rescale_if,
    strip_chars,
)
from .measure import (
    abs_difference,
    day_gap,
    first_present,
    harmonic_mean,
    joined_text,
    month_day,
    year_gap,
)

__all__ = [n for n in dir() if not n.startswith("_")]
