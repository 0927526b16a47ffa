"""Loops of fits: screening, greedy selection, tuning, cross-validation, experiment grids.

The driver only chooses what to fit next; every fit and every score is a Spark job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from fractions import Fraction
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import exclude
from ..operators.sample import bootstrap, cuts_of_parts, exact_part, fold_id, order_hash, stratum_ends, stratum_texts
from ..sizing import checkpoint, small_or_plain
from .classify import counts_suffice, fit, on_counts
from .encoding import WEIGHT, compress, counted, is_text
from .metrics import binary_metrics

DIGITS = 3  # of the digest prefixes a grid's test rows are counted by
NEAR = 1 / 16  # how far from its likely place a cut is looked for first
METRICS = ["accuracy", "ppv", "npv", "sensitivity", "specificity"]


def _scores(train, test, label, features, name, seed, positive, compressed, params, weight=None) -> dict:
    """Metrics of one fit; ``weight`` names the counts that both tables already hold."""
    fitted = fit(train, label, features, name, seed, compressed=compressed, weight=weight, **params)
    if compressed and not weight:
        test, weight = compress(test, [label, *features]), WEIGHT
    row = binary_metrics(fitted.predict(test), "predicted", label, positive, weight=weight).first()
    return row.asDict()


def _on_rows(name: str, params: Mapping) -> bool:
    """Whether a model is fitted on rows: a forest, which draws them by their place, and nets without ``decay``."""
    return name == "rforest" or (name == "nnet" and "decay" not in params)


@contextmanager
def _kept(*dfs: DataFrame):
    """Hold DataFrames in memory and on disk for the length of a loop."""
    held = [df.persist() for df in dfs]
    try:
        yield held
    finally:
        for df in held:
            df.unpersist()


def _in_parallel(tasks: list, run, parallelism: int) -> list:
    if parallelism <= 1:
        return [run(t) for t in tasks]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(run, tasks))


def _counts_per_column(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Counts per (column, value, label) of all columns in one pass, values as text."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    long = df.select(F.col(label).cast("string").alias("label"), F.inline(F.array(*pairs)))
    return counted(long, ["column", "value", "label"])


def screen_columns(
    train: DataFrame,
    test: DataFrame,
    label: str,
    cols: Sequence[str],
    models: Sequence[str] = ("glm", "rforest", "svm"),
    seed: int = 1,
    yes: str = "YES",
    positive: str = "NO",
    params: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """A model on every single column: ``(column, model, accuracy, prior, kept)``.

    A column is kept if any model is at least as accurate as always answering ``yes`` is on the
    training rows. Fits and scores use counts per (value, label), so the loop over columns and
    models reads small tables.
    """
    params = params or {}
    share = train.agg(F.avg(F.when(F.col(label) == yes, 1.0).otherwise(0.0))).first()[0] or 0.0
    rows = []
    with _kept(*[_counts_per_column(df, label, cols) for df in (train, test)]) as (counted_train, counted_test):
        for c in cols:
            kind = "string" if is_text(train, c) else train.schema[c].dataType
            pick = [F.col("value").cast(kind).alias(c), F.col("label").alias(label), F.col(WEIGHT)]
            small_train = counted_train.filter(F.col("column") == c).select(*pick)
            small_test = counted_test.filter(F.col("column") == c).select(*pick)
            got = []
            for name in models:
                extra = dict(params.get(name, {}))
                if name == "nnet":
                    fitted = fit(train, label, [c], name, seed, **extra)
                else:
                    fitted = fit(small_train, label, [c], name, seed, weight=WEIGHT, **extra)
                scored = fitted.predict(small_test)
                value = binary_metrics(scored, "predicted", label, positive, weight=WEIGHT).first()["accuracy"]
                got.append((c, name, value))
            kept = any(v is not None and v >= share for _, _, v in got)
            rows += [(*g, share, kept) for g in got]
    return train.sparkSession.createDataFrame(
        rows, "column string, model string, accuracy double, prior double, kept boolean"
    )


def forward_select(
    train: DataFrame,
    test: DataFrame,
    label: str,
    start: Sequence[str],
    candidates: Sequence[str],
    name: str = "svm",
    seed: int = 1,
    positive: str = "NO",
    **params,
) -> DataFrame:
    """Greedy forward selection: rows ``(step, column, accuracy, kept)`` in the order tried.

    A candidate stays if accuracy does not fall; after one stays, the remaining candidates are tried
    again from the first. Only training rows are fitted.
    """
    wanted = [label, *start, *candidates]
    with _kept(train.select(*wanted), test.select(*wanted)) as (train, test):
        chosen, left, best, log = list(start), list(candidates), 0.0, []
        if chosen:
            best = _scores(train, test, label, chosen, name, seed, positive, True, params)["accuracy"] or 0.0
        i = 0
        while i < len(left):
            trial = _scores(train, test, label, [*chosen, left[i]], name, seed, positive, True, params)["accuracy"]
            kept = trial is not None and trial >= best
            log.append((len(log) + 1, left[i], trial, kept))
            if kept:
                best = trial
                chosen.append(left.pop(i))
                i = 0
            else:
                i += 1
    return train.sparkSession.createDataFrame(log, "step int, column string, accuracy double, kept boolean")


def _grid(values: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def _table(spark, rows: list[dict], lead: str) -> DataFrame:
    schema = lead + ", " + ", ".join(f"{m} double" for m in METRICS)
    names = [f.split()[0] for f in lead.split(", ")] + METRICS
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def tune(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    name: str,
    grid: Mapping[str, Sequence],
    cv: DataFrame | None = None,
    id_col: str | None = None,
    seed: int = 1,
    positive: str = "NO",
    parallelism: int = 2,
    compressed: bool = False,
) -> DataFrame:
    """Score every parameter combination: ``(model, params, accuracy, ...)``.

    Validates on ``cv``; without one, fits on a bootstrap resample and validates on the rows it
    left out. The best row is ``argmax(result, "accuracy", ["params"])``. ``compressed`` counts the distinct
    combinations of both once, and all fits and scores read these.
    """
    wanted = [label, *features]
    if cv is None:
        drawn = bootstrap(train, id_col, seed)
        cv = exclude(train, drawn, id_col)
        train = drawn
    both = [counted(df, wanted) if compressed else df.select(*wanted) for df in (train, cv)]
    weight = WEIGHT if compressed else None
    with _kept(*both) as (train, cv):

        def run(params: dict) -> dict:
            row = _scores(train, cv, label, features, name, seed, positive, False, params, weight)
            text = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
            return {"model": name, "params": text, **row}

        rows = _in_parallel(_grid(grid), run, parallelism)
    return _table(train.sparkSession, rows, "model string, params string")


def cross_validate(
    df: DataFrame,
    id_col: str,
    label: str,
    features: Sequence[str],
    name: str,
    k: int = 5,
    seed: int = 1,
    positive: str = "NO",
    parallelism: int = 2,
    **params,
) -> DataFrame:
    """k-fold cross-validation: one row of metrics per fold.

    Models with weights are fitted on the counts of the distinct combinations per fold.
    """
    folded = fold_id(df, id_col, k, seed, out="__fold").select(label, *features, "__fold")
    weight = None if _on_rows(name, params) else WEIGHT
    with _kept(counted(folded, folded.columns) if weight else folded) as (folded,):

        def run(i: int) -> dict:
            rest, held = folded.filter(F.col("__fold") != i), folded.filter(F.col("__fold") == i)
            got = _scores(rest, held, label, features, name, seed, positive, False, params, weight)
            return {"model": name, "fold": i, **got}

        rows = _in_parallel(list(range(k)), run, parallelism)
    return _table(df.sparkSession, rows, "model string, fold int")


def _count_stratified(
    hashed: DataFrame, id_col: str, wanted: list[str], names: list[str], cells: list[tuple], inside, drawn_by, test_size
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and test rows of all cells of a grid, counted, in two passes over the rows for all cells together.

    ``hashed`` holds the strata ``names`` and the digests that ``inside`` (whether a row lies in a cell's share) and
    ``drawn_by`` (the digest its test rows are drawn by) name. The first pass counts prefixes of the latter. The second
    counts the combinations below and above the prefixes in which the strata's cuts lie, and keeps digest and id of
    the few rows between: these settle the cuts, and which ids are drawn in one stratum and left in another.

    Gives ``(*wanted, __cell, __held, __weight)``, the cuts ``(__cell, *names, __cut)``, and the ids in no training row
    ``(__cell, __id)``.
    """
    seeds, limits = list(dict.fromkeys(s for _, s in cells)), sorted({limit for limit, _ in cells})
    keys = ["__cell", *names]

    def by_seed(more) -> list[Column]:
        """Per seed, the first share that holds the row: it lies in all larger ones too."""
        held_by = {s: F.coalesce(*[F.when(inside((limit, s)), F.lit(k)) for k, limit in enumerate(limits)]) for s in seeds}
        return F.inline(F.array(*[F.struct(F.lit(j).alias("__seed"), held_by[s].alias("__share"), *more(j, s)) for j, s in enumerate(seeds)]))

    def by_cell(df: DataFrame) -> DataFrame:
        """Rows per seed and first share dealt to the cells."""
        marks = [
            F.struct(F.lit(i).alias("__cell"), ((F.col("__seed") == seeds.index(s)) & (F.col("__share") <= limits.index(limit))).alias("__in"))
            for i, (limit, s) in enumerate(cells)
        ]
        return df.select(*df.columns, F.inline(F.array(*marks))).filter("__in").drop("__in", "__seed", "__share")

    def prefix(h: Column) -> Column:
        return F.substring(h, 1, DIGITS)

    near = [f"{min(max(int((float(test_size) + d) * 16**DIGITS), 0), 16**DIGITS - 1):0{DIGITS}x}" for d in (-NEAR, NEAR)]

    def close(p: Column) -> Column:
        """Prefixes far from where a cut is likely count together: few counts are added up faster than many."""
        return F.when(p < near[0], "").when(p > near[1], "~").otherwise(p)

    def ends_by(shown) -> DataFrame:
        rows = hashed.select(*names, by_seed(lambda _, s: [shown(prefix(drawn_by((None, s)))).alias("__end")]))
        rows = rows.filter("__share IS NOT NULL").groupBy(*names, "__seed", "__share", "__end")
        per_cell = by_cell(rows.agg(F.count(F.lit(1)).alias("__n"))).groupBy(*keys, "__end").agg(F.sum("__n").alias("__n"))
        return checkpoint(stratum_ends(per_cell.withColumn("__left", F.lit(None).cast("long")), keys, test_size))

    ends = ends_by(close)
    if not ends.filter("__left > 0 AND __end IN ('', '~')").isEmpty():  # small strata, or one id in many rows
        ends = ends_by(lambda p: p)
    bound = F.when(F.col("__left") > 0, F.coalesce("__end", F.lit(""))).otherwise("")
    spans = {i: (low, high) for i, low, high in ends.groupBy("__cell").agg(F.min(bound), F.max(bound)).collect()}

    def place(j: int, seed) -> list[Column]:
        found = [spans[i] for i, (_, s) in enumerate(cells) if s == seed and i in spans] or [("", "")]
        low, high, h = min(f[0] for f in found), max(f[1] for f in found), drawn_by((None, seed))
        between = (prefix(h) >= low) & (prefix(h) <= high)
        told = {"__h": h, "__id": F.col(id_col), **{n: F.col(n) for n in names}}
        below = F.coalesce(prefix(h) < low, F.lit(False)).alias("__held")
        return [below, *[F.when(between, value).alias(name) for name, value in told.items()]]

    rows = hashed.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(wanted)], by_seed(place)).filter("__share IS NOT NULL")
    parted = by_cell(counted(rows, rows.columns))
    parted = parted.withColumnsRenamed({f"__w{i}": c for i, c in enumerate(wanted)})

    between = parted.filter(F.col("__h").isNotNull()).drop("__held")
    last = between.join(ends.select(*keys, "__end", "__left"), on=keys).filter(prefix(F.col("__h")) == F.col("__end"))
    last = last.groupBy(*keys, "__left", "__h").agg(F.sum(WEIGHT).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = last.withColumn("__upto", upto).filter((F.col("__left") > 0) & (F.col("__upto") >= F.col("__left")))
    reached = reached.groupBy(*keys).agg(F.min("__h").alias("__cut"))
    cuts = checkpoint(ends.select(*keys).join(reached, on=keys, how="left").withColumn("__cut", F.coalesce("__cut", F.lit(""))))

    told = checkpoint(between.join(cuts, on=keys).withColumn("__held", F.col("__h") <= F.col("__cut")).drop("__cut", "__h", *names))
    seen = told.groupBy("__cell", "__id").agg(F.max("__held").alias("some"), F.min("__held").alias("all"))
    removed = checkpoint(seen.filter(F.col("some") & ~F.col("all")).select("__cell", "__id"))
    left = told.join(removed.withColumn("__held", F.lit(False)), on=["__cell", "__id", "__held"], how="left_anti").drop("__id")
    every = parted.filter(F.col("__h").isNull()).drop("__h", "__id", *names).unionByName(left)
    return checkpoint(every.groupBy(*wanted, "__cell", "__held").agg(F.sum(WEIGHT).alias(WEIGHT))), cuts, removed


#: What the reference's runs set, where they set anything.
GRID_MODELS = {"svm": {"kernel": "radial"}, "rforest": {}, "nnet": {"size": 5, "repeats": 10, "decay": 0.001}}


def run_grid(
    df: DataFrame,
    id_col: str,
    label: str,
    features: Sequence[str],
    limits: Sequence[float] = (0.2, 0.5, 1.0),
    seeds: Sequence[int] = (10, 300, 5000, 700),
    models: Mapping[str, Mapping] | Sequence[str] = tuple(GRID_MODELS),
    test_size: float = 0.2,
    strata: Sequence[str] | None = None,
    positive: str = "NO",
    parallelism: int = 3,
) -> DataFrame:
    """Experiment grid over sample share, seed and model: tidy rows of metrics.

    The test rows are drawn at random, or per stratum when ``strata`` is given; an id that is drawn is in no training
    row. The rows are written once; the cuts of all shares and seeds are found together, and the distinct combinations
    of training and test rows are counted for all shares and seeds in one pass; the models differ by these counts
    alone. Models without weights (a forest, nets without ``decay``) are fitted on the rows, unless these are so many
    that ``fit`` would count them. A few shares and seeds run side by side.
    """
    models = models if isinstance(models, Mapping) else {m: GRID_MODELS.get(m, {}) for m in models}
    wanted = list(dict.fromkeys([label, *features]))
    kept = checkpoint(df.select(id_col, *dict.fromkeys([*wanted, *(strata or [])])))

    cells = list(product(limits, seeds))
    shares = [(limit, seed) for limit, seed in cells if limit != 1]
    drawn = cuts_of_parts(kept, id_col, [(None, str(seed), lambda n, f=limit: exact_part(n, f)) for limit, seed in shares])
    within = {at: (str(at[1]), cut) for at, cut in zip(shares, drawn)}
    hashes = {f"__h{s}": order_hash(id_col, s) for s in dict.fromkeys([*seeds, *(f"{s}t" for s in seeds)])}
    hashed = kept.withColumns({**hashes, **stratum_texts(strata or [])})

    def inside(at: tuple[float, int]) -> Column:
        return F.col(f"__h{at[1]}") <= within[at][1] if at in within else F.lit(True)

    def drawn_by(at: tuple[float, int]) -> Column:
        return F.col(f"__h{at[1]}t")

    if not strata:
        parts = [(within.get(at), f"{at[1]}t", lambda n: int(n * (1 - Fraction(str(round(1 - test_size, 9)))))) for at in cells]
        held = [F.coalesce(drawn_by(at) <= cut, F.lit(False)) for at, cut in zip(cells, cuts_of_parts(kept, id_col, parts))]
        marks = [
            F.struct(F.lit(i).alias("__cell"), inside(at).alias("__in"), held[i].alias("__held")) for i, at in enumerate(cells)
        ]
        dealt = hashed.select(*wanted, F.inline(F.array(*marks))).filter("__in")
        every = counted(dealt, [*wanted, "__cell", "__held"])
    else:
        names = list(stratum_texts(strata))
        every, cuts, removed = _count_stratified(hashed, id_col, wanted, names, cells, inside, drawn_by, test_size)

    by_rows = {name for name, params in models.items() if _on_rows(name, params)}
    suffice = {i for i, enough in counts_suffice(every.filter(~F.col("__held")), label, features, ["__cell"]).collect() if enough} if by_rows else set()

    def training_rows(i: int) -> DataFrame:
        """The rows of a cell that were not drawn."""
        at = cells[i]
        rows = hashed.filter(inside(at))
        if not strata:
            return rows.filter(~held[i]).select(*wanted)
        here = cuts.filter(F.col("__cell") == i).drop("__cell")
        rows = rows.join(small_or_plain(here), on=names, how="left").filter(~F.coalesce(drawn_by(at) <= F.col("__cut"), F.lit(False)))
        gone = removed.filter(F.col("__cell") == i).select(F.col("__id").alias(id_col))
        return checkpoint(rows.join(small_or_plain(gone), on=id_col, how="left_anti").select(*wanted))

    def cell(i: int) -> list[dict]:
        limit, seed = cells[i]
        here = every.filter(F.col("__cell") == i)
        both = [here.filter(test).select(*wanted, WEIGHT) for test in (~F.col("__held"), F.col("__held"))]
        counting = {name for name, params in models.items() if name not in by_rows or (i in suffice and params.get("bootstrap", True))}
        train = training_rows(i) if len(counting) < len(models) else None
        with _kept(*both) as (few, test):
            rows = []
            for name, params in models.items():
                source, weight = (few, WEIGHT) if name in counting else (train, None)
                how = on_counts(name, params) if name in by_rows and weight else params
                fitted = fit(source, label, features, name, seed, weight=weight, **how)
                got = binary_metrics(fitted.predict(test), "predicted", label, positive, weight=WEIGHT).first()
                rows.append({"share": float(limit), "seed": int(seed), "model": name, **got.asDict()})
        return rows

    found = _in_parallel(range(len(cells)), cell, parallelism)
    return _table(df.sparkSession, [r for rows in found for r in rows], "share double, seed int, model string")
