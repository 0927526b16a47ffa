"""Seeded sampling and splitting that do not depend on how the data is partitioned.

Rows are ordered by ``md5(seed|id)``. A sample of exact size is everything up to one digest, and
that digest is found by counting digest prefixes (4096 counts per round), so nothing is sorted and
only the id column is read. ``id`` must be unique and not null.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import exp, factorial, pi

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sizing import checkpoint, small_or_plain

_DIGITS = 3
_FETCH = 5_000
RANK_ROWS = 200_000


def order_hash(id_col: str | Column, seed) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def exact_part(n: int, fraction) -> int:
    """``floor(n * fraction)`` with the fraction read as the decimal it was written as."""
    return int(n * Fraction(str(fraction)))


def _cuts(df: DataFrame, id_col: str, seed, sizes, fetch: int = _FETCH) -> tuple[int, list[str]]:
    """Row count, and for each size the digest up to which that many rows lie.

    ``sizes`` maps the row count to the wanted sizes. A size of 0 gives ``""``.
    """
    hashed = df.select(order_hash(id_col, seed).alias("h"))
    counts = {"": sorted(tuple(r) for r in hashed.groupBy(F.substring("h", 1, _DIGITS).alias("p")).count().collect())}
    total = sum(n for _, n in counts[""])
    cuts = []
    for size in sizes(total):
        if size <= 0:
            cuts.append("")
            continue
        prefix, left = "", size
        while True:
            if prefix not in counts:
                inside = hashed.filter(F.col("h").startswith(prefix))
                step = F.substring("h", 1, len(prefix) + _DIGITS).alias("p")
                counts[prefix] = sorted(tuple(r) for r in inside.groupBy(step).count().collect())
            for p, n in counts[prefix]:
                if left <= n:
                    break
                left -= n
            prefix = p
            if n <= fetch or len(prefix) >= 32:
                break
        # Few digests, or one repeated digest if ids are not unique after all.
        near = hashed.filter(F.col("h").startswith(prefix)).groupBy("h").count().collect()
        for cut, n in sorted(tuple(r) for r in near):
            if left <= n:
                break
            left -= n
        cuts.append(cut)
    return total, cuts


def cuts_of_parts(df: DataFrame, id_col: str, parts: Sequence[tuple], fetch: int = _FETCH) -> list[str]:
    """Digest cuts of many parts of the same rows, in two passes over them for all parts together.

    A part is ``(within, seed, size)``: the rows up to the cut of another digest, given as ``(seed, cut)``, or all
    if None; ``size`` gives from their number how many of them lie up to the cut looked for. The first pass counts
    digest prefixes, the second keeps the digests of the prefixes in which cuts lie.
    """
    if not parts:
        return []
    seeds = list(dict.fromkeys(s for within, seed, _ in parts for s in (seed, *([within[0]] if within else []))))
    at = {s: f"__h{i}" for i, s in enumerate(seeds)}
    hashed = df.select(*[order_hash(id_col, s).alias(h) for s, h in at.items()])
    sources = list(dict.fromkeys((within, seed) for within, seed, _ in parts))
    source = [sources.index((within, seed)) for within, seed, _ in parts]

    def digests(prefixes: dict[int, set[str]]) -> DataFrame:
        """``(s, h)``: the digests of each source that start with one of the prefixes."""
        cells = []
        for k, wanted in prefixes.items():
            within, seed = sources[k]
            test = F.col(at[within[0]]) <= within[1] if within else F.lit(True)
            starts = F.substring(at[seed], 1, _DIGITS).isin(sorted(wanted)) if wanted != {""} else F.lit(True)
            cells.append(F.struct(F.lit(k).alias("s"), (test & starts).alias("here"), F.col(at[seed]).alias("h")))
        return hashed.select(F.inline(F.array(*cells))).filter("here").select("s", "h")

    found: dict[int, list[tuple]] = {k: [] for k in range(len(sources))}
    for k, p, n in digests({k: {""} for k in found}).groupBy("s", F.substring("h", 1, _DIGITS)).count().collect():
        found[k].append((p, n))
    found = {k: sorted(f) for k, f in found.items()}

    cuts, left, prefixes, length = [""] * len(parts), {}, dict.fromkeys(range(len(parts)), ""), _DIGITS
    fine: dict[int, str] = {}
    near = None

    def counts(wanted: dict[int, str], length: int | None) -> dict[int, list[tuple]]:
        cells = [
            F.struct(F.lit(i).alias("i"), ((F.col("s") == source[i]) & F.col("h").startswith(p)).alias("here"), "h", "n")
            for i, p in wanted.items()
        ]
        rows = near.select(F.inline(F.array(*cells))).filter("here")
        step = F.substring("h", 1, length) if length else F.col("h")
        steps: dict[int, list[tuple]] = {i: [] for i in wanted}
        for i, p, n in rows.groupBy("i", step.alias("p")).agg(F.sum("n")).collect():
            steps[i].append((p, n))
        return {i: sorted(f) for i, f in steps.items()}

    while prefixes:
        for i, steps in (counts(prefixes, length) if near else {i: found[source[i]] for i in prefixes}).items():
            if i not in left:
                left[i] = parts[i][2](sum(n for _, n in steps))
                if left[i] <= 0:
                    del prefixes[i]
                    continue
            for p, n in steps:
                if left[i] <= n:
                    break
                left[i] -= n
            prefixes[i] = p
            if n <= fetch or length >= 32:
                fine[i] = prefixes.pop(i)
        if not near and (prefixes or fine):
            ends: dict[int, set[str]] = {}
            for i, p in [*prefixes.items(), *fine.items()]:
                ends.setdefault(source[i], set()).add(p)
            near = checkpoint(digests(ends).groupBy("s", "h").agg(F.count(F.lit(1)).alias("n")))
        length += _DIGITS
    if fine:
        for i, steps in counts(fine, None).items():
            for cut, n in steps:
                if left[i] <= n:
                    break
                left[i] -= n
            cuts[i] = cut
    return cuts


def sample_exact(df: DataFrame, id_col: str, fraction, seed) -> DataFrame:
    """Simple random sample without replacement of exactly ``floor(n * fraction)`` rows."""
    _, (cut,) = _cuts(df, id_col, seed, lambda n: [exact_part(n, fraction)])
    return df.filter(order_hash(id_col, seed) <= cut)


def split_label(
    df: DataFrame, id_col: str, fractions: Sequence, seed, names: Sequence[str] = (), out: str = "part"
) -> DataFrame:
    """Name the part each row falls into.

    The held-out rows number ``floor(n * (1 - first))`` and are divided among the later parts by
    their shares, rounded down, the last part taking the rest; all other rows form the first part.
    """
    parts = [Fraction(str(f)) for f in fractions]
    if sum(parts) != 1:
        raise ValueError("fractions must add up to 1")
    names = list(names) or {2: ["train", "test"], 3: ["train", "cv", "test"]}[len(parts)]

    def sizes(n: int) -> list[int]:
        held = int(n * (1 - parts[0]))
        taken, out = 0, []
        for f in parts[1:-1]:
            taken += int(held * f / (1 - parts[0]))
            out.append(taken)
        return [*out, held]

    _, cuts = _cuts(df, id_col, seed, sizes)
    h = order_hash(id_col, seed)
    chain = None
    for cut, name in zip(cuts, names[1:]):
        chain = F.when(h <= cut, name) if chain is None else chain.when(h <= cut, name)
    return df.withColumn(out, chain.otherwise(names[0]))


def split(df: DataFrame, id_col: str, fractions: Sequence, seed) -> list[DataFrame]:
    """The parts as DataFrames; each is a filter, so they are disjoint and complete."""
    names = [f"p{i}" for i in range(len(fractions))]
    labelled = split_label(df, id_col, fractions, seed, names, out="__part")
    return [labelled.filter(F.col("__part") == n).drop("__part") for n in names]


def stratum_texts(strata: Sequence[str]) -> dict[str, Column]:
    """The strata under private names, as texts without null: null is a stratum of its own."""
    return {f"__s{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(strata)}


def stratum_ends(counted: DataFrame, names: Sequence[str], fraction) -> DataFrame:
    """Per stratum, the digest prefix in which a sample of ``floor(n * fraction)`` rows ends: ``(*names, __end, __left, __n)``.

    ``counted`` holds the rows ``__n`` per stratum and prefix ``__end``, and the ``__left`` wanted if it is known.
    ``__left`` tells the row wanted, from the prefix's start, ``__n`` the rows of the prefix. Strata of which no row is
    wanted have their first prefix and a ``__left`` of 0.
    """
    share, by_stratum = Fraction(str(fraction)), Window.partitionBy(*names)
    upto = F.sum("__n").over(by_stratum.orderBy("__end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.sum("__n").over(by_stratum)
    wanted = F.coalesce("__left", F.floor(size * F.lit(share.numerator) / F.lit(share.denominator)))
    under = F.col("__upto") - F.col("__n")
    found = counted.withColumns({"__upto": upto, "__wanted": wanted})
    none = (F.col("__wanted") <= 0) & (under == 0)
    found = found.filter(((under < F.col("__wanted")) & (F.col("__wanted") <= F.col("__upto"))) | none)
    return found.select(*names, "__end", (F.col("__wanted") - under).alias("__left"), "__n")


def sample_stratified(
    df: DataFrame, id_col: str, strata: Sequence[str], fraction, seed, rank_rows: int = RANK_ROWS, digits: int = _DIGITS
) -> DataFrame:
    """Exactly ``floor(n * fraction)`` rows of every stratum; no strata is a simple sample.

    Per stratum, digest prefixes are counted and the prefix in which the sample ends is looked up, again with
    longer prefixes as long as more than ``rank_rows`` rows share it. Only the rows of that prefix are ranked;
    the digest found is where the stratum is cut, and all rows are taken or left by comparison.
    """
    if not strata:
        return sample_exact(df, id_col, fraction, seed)
    texts = stratum_texts(strata)
    names = list(texts)
    keyed = df.withColumns({**texts, "__h": order_hash(id_col, seed)})
    by_stratum = Window.partitionBy(*names)

    def ends_of(rows: DataFrame, length: int) -> DataFrame:
        counted = rows.groupBy(*names, "__left", F.substring("__h", 1, length).alias("__end")).agg(F.count(F.lit(1)).alias("__n"))
        return checkpoint(stratum_ends(counted, names, fraction).filter(F.col("__left") > 0))

    def inside(ends: DataFrame) -> DataFrame:
        found = keyed.select(*names, "__h").join(small_or_plain(ends.select(*names, "__end", "__left")), on=names)
        return found.filter(F.startswith("__h", F.col("__end")))

    length = digits
    ends = ends_of(keyed.select(*names, "__h", F.lit(None).cast("long").alias("__left")), length)
    while length < 32:
        deep = ends.filter(F.col("__n") > rank_rows)
        if deep.isEmpty():
            break
        length += digits
        ends = checkpoint(ends.filter(F.col("__n") <= rank_rows).unionByName(ends_of(inside(deep), length)))
    ranked = inside(ends).withColumn("__r", F.row_number().over(by_stratum.orderBy("__h")))
    cuts = ranked.filter(F.col("__r") == F.col("__left")).select(*names, F.col("__h").alias("__cut"))
    return keyed.join(small_or_plain(cuts), on=names).filter(F.col("__h") <= F.col("__cut")).select(*df.columns)


def _uniform(id_col: str | Column, seed) -> Column:
    """A number in [0, 1) per row from 48 bits of the digest."""
    return F.conv(F.substring(order_hash(id_col, seed), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def poisson_steps() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count: P(X <= 0), P(X <= 1), ...

    They go on until what is left lies below 2**-48, the resolution of the draw, so no draw is cut.
    """
    out, total, k = [], 0.0, 0
    while 1 - total >= 2.0**-48:
        total += exp(-1) / factorial(k)
        out.append(total)
        k += 1
    return out


def _once_drawn(u: Column) -> Column:
    """A Poisson(1) count by the number ``u`` in [0, 1)."""
    chain, steps = None, poisson_steps()
    for k, step in enumerate(steps):
        chain = F.when(u < step, k) if chain is None else chain.when(u < step, k)
    return chain.otherwise(len(steps))


def poisson_copies(key: str | Column, weight: Column, seed) -> Column:
    """How often a row that stands for ``weight`` equal ones is drawn with replacement: a Poisson(weight) count.

    The count follows from the digest of seed and key. Up to a weight of 32 it is looked up in the cumulative
    probabilities; above, where no exact table would fit, it is the rounded normal of the same mean and variance.
    """
    u = _uniform(key, seed)
    w = weight.cast("double")
    # probability of k, cumulative probability, k; beyond k = 200 less than 2**-53 is left
    start = F.struct(F.exp(-w).alias("p"), F.exp(-w).alias("upto"), F.lit(0).alias("k"))

    def step(at: Column, i: Column) -> Column:
        p = at["p"] * w / i
        more = F.struct(p.alias("p"), (at["upto"] + p).alias("upto"), i.alias("k"))
        return F.when(u < at["upto"], at).otherwise(more)

    few = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step)["k"].cast("double")
    angle = F.cos(2 * pi * _uniform(key, f"{seed}z"))
    many = F.greatest(F.floor(w + F.sqrt(w) * F.sqrt(-2 * F.log(1 - u)) * angle + 0.5).cast("double"), F.lit(0.0))
    return F.when(w == 1, _once_drawn(u).cast("double")).when(w <= 32, few).otherwise(many)


def left_out(key: str | Column, seed) -> Column:
    """Whether ``poisson_copies`` draws a single row not at all."""
    return _uniform(key, seed) < poisson_steps()[0]


def bootstrap(df: DataFrame, id_col: str, seed) -> DataFrame:
    """Resample with replacement: every row is drawn a Poisson(1) number of times.

    The count comes from the row's own digest, so a lost task redraws the same copies.
    """
    drawn = df.withColumn("__copies", _once_drawn(_uniform(id_col, seed))).filter(F.col("__copies") > 0)
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")


def fold_id(df: DataFrame, id_col: str, k: int, seed, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row for cross-validation."""
    number = F.conv(F.substring(order_hash(id_col, seed), 1, 12), 16, 10).cast("long")
    return df.withColumn(out, F.pmod(number, F.lit(k)).cast("int"))
