"""DataFrame-in, DataFrame-out operators."""

from .aggregate import (
    distinct_values,
    duplicated_keys,
    entropy,
    freq,
    group_totals,
    missing_ratio,
    prior,
    profile,
    row_count,
    summary,
)
from .check import DuplicateKeyError, assert_unique, naming_duplicates, unique_rows
from .identify import deidentify, number_rows, replace_ids, surrogate_ids
from .impute import (
    coalesce_from,
    fill_blank,
    fill_const,
    fill_group_stat,
    fill_median,
    fill_mode,
)
from .joins import assemble, before, exclude, inner, lookup, restrict_to
from .pick import argmax, dedup_prefer, latest, pick_one
from .quantiles import exact_quantiles
from .sample import bootstrap, fold_id, left_out, poisson_copies, sample_exact, sample_stratified, split, split_label
from .scale import minmax
from .shape import (
    align,
    append_rows,
    apply_rules,
    collapse_rare,
    complete_cases,
    delete_keys,
    drop_values,
    project,
    recode_by_table,
    union_distinct,
)

__all__ = [n for n in dir() if not n.startswith("_")]
