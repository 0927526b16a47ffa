"""One record per key, without windows.

A window over a key puts the whole key into one task. Here every pick is an aggregate, which first
reduces each key inside each input split, so a key holding a third of all rows costs no more than others.
Orders are lists of names; a leading ``-`` means descending. Nulls sort lowest, as in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _parse(order_by: Sequence[str]) -> list[tuple[str, bool]]:
    return [(o[1:], True) if o.startswith("-") else (o, False) for o in order_by]


def _reversed(df: DataFrame, name: str) -> list[Column]:
    """Expressions whose descending order is the ascending order of the column."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        # Complemented hex digits; the closing "~" puts a longer text after its own prefix.
        flipped = F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    elif isinstance(kind, T.DateType):
        flipped = -F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        flipped = -F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.BooleanType):
        flipped = ~c
    elif isinstance(kind, T.IntegralType):
        flipped = -c.cast("decimal(20,0)")
    else:
        flipped = -c
    return [c.isNull(), flipped]


def _best_row(df: DataFrame, keys: list[str], order_by: Sequence[str], only: Column | None = None) -> Column:
    """Aggregate giving the first row's other columns as a struct; ``only`` limits the candidates."""
    order = _parse(order_by)
    named = [name for name, _ in order if name not in keys]
    rest = [c for c in df.columns if c not in keys and c not in named]
    directions = {desc for _, desc in order} or {False}

    def limited(row: Column) -> Column:
        return row if only is None else F.when(only, row)

    if len(directions) == 1:
        best = F.max if directions == {True} else F.min
        return best(limited(F.struct(*named, *rest)))
    rank: list[Column] = []
    for name, desc in order:
        rank += [F.col(name)] if desc else _reversed(df, name)
    ranked = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *[F.col(c) for c in rest])
    return F.max_by(F.struct(*named, *rest), limited(ranked))


def _unpack(df: DataFrame, keys: list[str], picked: DataFrame) -> DataFrame:
    return picked.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def pick_one(df: DataFrame, keys: Sequence[str] | str, order_by: Sequence[str] = ()) -> DataFrame:
    """First row per key in the given order; remaining columns break ties, so the pick is total."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _unpack(df, keys, df.groupBy(*keys).agg(_best_row(df, keys, order_by).alias("__row")))


def latest(df: DataFrame, keys: Sequence[str] | str, by: Sequence[str] | str, ties: bool = False) -> DataFrame:
    """Rows with the greatest ``by`` per key.

    ``ties=True`` keeps all rows equal on the (single) column and drops keys that only have nulls;
    ``False`` keeps exactly one row per key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = [by] if isinstance(by, str) else list(by)
    if not ties:
        return pick_one(df, keys, [f"-{c}" for c in by])
    if len(by) != 1:
        raise ValueError("ties are kept on a single column")
    top = df.groupBy(*keys).agg(F.max(by[0]).alias(by[0]))
    return df.join(top, on=[*keys, by[0]], how="left_semi")


def argmax(df: DataFrame, by: Sequence[str] | str, then: Sequence[str] = ()) -> DataFrame:
    """The single best row; ``then`` (ascending) settles ties."""
    by = [by] if isinstance(by, str) else list(by)
    return df.orderBy(*[F.col(c).desc() for c in by], *[F.col(c).asc() for c in then]).limit(1)


def dedup_prefer(
    df: DataFrame,
    keys: Sequence[str] | str,
    col: str,
    bad,
    keep_if_all_bad: bool = False,
    order_by: Sequence[str] = (),
    case_insensitive: bool = False,
) -> DataFrame:
    """Where a key has several rows, delete those with ``col == bad``.

    By default a key whose rows are all bad disappears when it has more than one;
    ``keep_if_all_bad`` keeps one of them (first by ``order_by``).
    A surviving bad row comes out of the count per key itself, and the other rows pass through
    without a shuffle, so nothing is joined.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    same = F.lower(col) == F.lit(bad.lower()) if case_insensitive else F.col(col) == F.lit(bad)
    is_bad = F.coalesce(same, F.lit(False))
    tally = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(F.when(is_bad, 1)).alias("__bad"),
        _best_row(df, keys, order_by, only=is_bad).alias("__row"),
    )
    all_bad = F.col("__bad") == F.col("__n")
    survives = all_bad if keep_if_all_bad else all_bad & (F.col("__n") == 1)
    return df.filter(~is_bad).unionByName(_unpack(df, keys, tally.filter(survives)))
