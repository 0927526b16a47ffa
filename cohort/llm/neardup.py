"""Near-duplicates: SuperMinHash signatures, bands, exact verification and grouping."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohort.llm.graph import components
from cohort.llm.textops import U64, mix, release, shingle_set
from cohort.sizing import checkpoint, checkpoint_in_few, small_or_plain

BANDS, ROWS = 32, 4
#: Rounds in which so many open members of a group become centres of a star, before the rest is compared in blocks.
ROUNDS, CENTRES = 6, 4
BLOCK = 128


def superminhash(values: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of a set of distinct 64-bit numbers.

    Each element has its own random permutation of the ``m`` places. At level j it offers j plus a fraction
    to its j-th place, so an element competes with a different rank at every place, and these ranks are
    negatively correlated. A place that has an offer of a level can't be improved by later ones, hence the
    levels stop as soon as every place is filled: after two or three for a text, at ``m`` at the latest.
    The permutations are shuffled step by step, only as far as the levels go.
    """
    out = np.full(m, np.iinfo(np.uint64).max, U64)
    if not len(values):
        return out
    row = np.arange(len(values))
    places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(values), 1))
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mix(values + U64(j + 1) * U64(0x9E3779B97F4A7C15))
        k = j + ((draw & U64(0xFFFFFFFF)) * U64(m - j) >> U64(32)).astype(np.int64)
        place = places[row, k]
        places[row, k] = places[:, j]
        places[:, j] = place
        np.minimum.at(out, place, U64(j) << U64(32) | draw >> U64(32))
        if out.max() >> U64(32) <= U64(j):
            break
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places: an estimate of the Jaccard similarity."""
    return float(np.mean(a == b))


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A number for each band of ``rows`` places."""
    with np.errstate(over="ignore"):
        block = mix(signature.reshape(n_bands, rows) + np.arange(1, rows + 1, dtype=U64)) * np.arange(1, 2 * rows, 2, dtype=U64)
        return mix(block.sum(1) + mix(np.arange(n_bands, dtype=U64)))


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


_SKETCH = ["doc_id", "n_shingles", "d1", "d2", "bands"]


def sketch(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, the digest (d1, d2) of the shingle set, and its bands (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text)
                keys = _signed(bands(superminhash(found, n_bands * rows), n_bands, rows)) if len(found) else None
                out.append((len(found), *_digest(found), keys))
            n, d1, d2, keys = zip(*out) if out else [()] * 4
            columns = [pa.array(x, pa.int64()) for x in (n, d1, d2)] + [pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], _SKETCH)
        release()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    )


def _digest(found: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        return _signed(np.array([found.sum(), mix(found + U64(12345)).sum()], U64))


def _class_of() -> Column:
    """A number for each different shingle set."""
    return F.xxhash64("n_shingles", "d1", "d2")


def _sets(docs: DataFrame) -> DataFrame:
    """rep (the number of the set), shingles of the documents given, each set once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                found = [shingle_set(t) for t in batch["text"].iloc[at : at + 500]]
                d1, d2 = zip(*map(_digest, found))
                yield pd.DataFrame({"n_shingles": [len(f) for f in found], "d1": d1, "d2": d2, "shingles": list(map(_signed, found))})

    made = docs.select("text").mapInPandas(run, "n_shingles long, d1 long, d2 long, shingles array<long>")
    return made.select(_class_of().alias("rep"), "shingles").groupBy("rep").agg(F.first("shingles").alias("shingles"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with enough in common, on their full sets; other columns are kept."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("_i", shared)
        .filter(F.lit(100) * F.col("_i") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("_i")))
        .select(*pairs.columns)
    )


def _blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups (bucket, rep, component, open) that stars have left open, a block pair at a time.

    Only the open members still have to be compared, each with all members of its group. Both are cut into
    blocks of about ``BLOCK``, and each pair of an open and a member block is one small task's group; it skips
    what is linked already and hands on a spanning forest, never all pairs. A member is sent once for each
    open block, of which most groups have one.
    """
    size = rest.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"), F.ceil(F.count_if("open") / BLOCK).cast("int").alias("o")
    )
    sized = rest.join(size, "bucket")
    block = lambda count: F.pmod(F.xxhash64("rep", "bucket"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asking = sized.filter("open").select("bucket", "rep", "component", block("o").alias("i"), every("n").alias("j"), F.lit(True).alias("asks"))
    asked = sized.select("bucket", "rep", "component", every("o").alias("i"), block("n").alias("j"), F.lit(False).alias("asks"))
    dealt = asking.union(asked).join(sets, "rep")

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        links, parent = [], {c: c for c in group["component"].tolist()}

        def find(c):
            while parent[c] != c:
                c = parent[c]
            return c

        rows = [
            (rep, home, np.asarray(found), asks)
            for rep, home, found, asks in zip(group["rep"].tolist(), group["component"].tolist(), group["shingles"], group["asks"])
        ]
        for x, home, mine, _ in (r for r in rows if r[3]):
            for y, other, theirs, _ in (r for r in rows if not r[3]):
                a, b = find(home), find(other)
                low, high = sorted((len(mine), len(theirs)))
                if a == b or 100 * low < percent * high:
                    continue
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(theirs) - both):
                    links.append((x, y))
                    parent[max(a, b)] = min(a, b)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long")


def links_between(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between classes (rep, doc_id, bands) whose sets are similar enough, as few as keep their components.

    Each bucket is first a star around its smallest member: as many candidates as members. Buckets that the
    confirmed links leave in several components are open. Open buckets with members in common form a group, in
    which a member counts once however many buckets it shares; there a few members outside the main component
    become centres, in up to ``ROUNDS`` rounds, and what is then still open is compared in blocks.
    """
    member = classes.select(F.explode("bands").alias("bucket"), "rep")
    size = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("centre")).filter("n > 1")
    member = checkpoint_in_few(member.join(size, "bucket"), 50_000)
    involved = classes.join(member.select("rep").distinct(), "rep", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    sets = docs.select("doc_id", "text").join(involved, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = checkpoint_in_few(_sets(sets).join(member.select("rep").distinct(), "rep", "left_semi"), 2_000)

    star = member.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    links = checkpoint_in_few(_confirm(star, sets, percent))

    # buckets of two are settled by their one pair
    part = components(links).withColumnRenamed("node", "rep")
    named = member.filter("n > 2").select("bucket", "rep").join(part, "rep", "left")
    named = named.select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("b"))
    rest = checkpoint_in_few(named.join(several.filter("low <> high").select("bucket", "b"), "bucket"))
    tied = components(rest.select(F.col("rep").alias("a"), "b")).select(F.col("node").alias("rep"), F.col("component").alias("bucket"))
    state = rest.select("rep", "component").distinct().join(tied, "rep").withColumn("used", F.lit(False))

    for number in range(ROUNDS):
        state = checkpoint_in_few(_marked(state))
        by = Window.partitionBy("bucket").orderBy(F.xxhash64("rep", F.lit(number)))
        chosen = state.filter("open").withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= CENTRES)
        chosen = checkpoint_in_few(chosen.select("bucket", F.col("rep").alias("c"), F.col("component").alias("own"), F.expr("shiftleft(1, _n - 1)").alias("bit")))
        if chosen.isEmpty():
            return links
        few = small_or_plain(chosen)
        pairs = state.join(few, "bucket").filter("component <> own").select(F.col("rep").alias("a"), F.col("c").alias("b"), "bucket", "component", "bit")
        new = checkpoint_in_few(_confirm(pairs, sets, percent))
        links = links.union(new.select("a", "b"))
        # groups that have nothing open are settled
        state = state.join(few.select("bucket"), "bucket", "left_semi")
        state = state.join(few.select(F.col("c").alias("rep"), F.lit(True).alias("_used")), "rep", "left")
        state = state.join(_merged(new, chosen), ["bucket", "component"], "left")
        state = state.select("bucket", "rep", F.coalesce("_to", "component").alias("component"), (F.col("used") | F.col("_used").isNotNull()).alias("used"))
    marked = checkpoint_in_few(_marked(state))
    rest = checkpoint_in_few(marked.join(marked.filter("open").select("bucket").distinct(), "bucket", "left_semi"))
    return links.union(_blocks(rest.select("bucket", "rep", "component", "open"), sets, percent))


def _merged(new: DataFrame, chosen: DataFrame) -> DataFrame:
    """What the links of a round make one in each group: (bucket, component, _to).

    A group has few centres, so a component's links there are a handful of bits, one a centre, and a group has few
    different masks of them. Centres that a mask has in common belong together, and so on; the least component of
    such centres' own names all that touch them.
    """
    own = chosen.select("bucket", F.col("own").alias("component"), "bit", F.col("bit").alias("mine"))
    met = new.select("bucket", "component", "bit", F.lit(0).alias("mine")).union(own)
    masks = met.groupBy("bucket", "component").agg(F.bit_or("bit").alias("mask"), F.bit_or("mine").alias("mine"))
    home = F.when(F.col("mine") != 0, F.struct("mine", "component"))
    groups = masks.groupBy("bucket").agg(F.collect_set("mask").alias("masks"), F.collect_set(home).alias("homes"))
    whole = F.col("mask")
    for _ in range(CENTRES):
        whole = F.aggregate("masks", whole, lambda have, m: F.when(have.bitwiseAND(m) != 0, have.bitwiseOR(m)).otherwise(have))
    named = masks.select("bucket", "component", "mask").join(groups, "bucket").withColumn("whole", whole)
    homes = F.filter("homes", lambda h: h["mine"].bitwiseAND(F.col("whole")) != 0)
    return named.select("bucket", "component", F.array_min(F.transform(homes, lambda h: h["component"])).alias("_to"))


def _marked(state: DataFrame) -> DataFrame:
    """Marks the members of groups as open or not: outside the largest component, and no centre yet."""
    sizes = state.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    marked = state.select("bucket", "rep", "component", "used").join(main, "bucket")
    return marked.withColumn("open", (F.col("component") != F.col("main")) & ~F.col("used")).drop("main")


def grouped(docs: DataFrame, percent: int = 75, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: doc_id, n_shingles, d1, d2 (the digest of its set), and ``home``, its group's number.

    Documents without shingles have no group. Groups go by sets, so rows that share a doc_id may be in different ones.
    """
    found = checkpoint(sketch(docs, n_bands, rows))
    digest = ["n_shingles", "d1", "d2"]
    classes = found.filter("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = checkpoint_in_few(classes.withColumn("rep", _class_of()))
    part = components(links_between(classes, docs, percent))
    named = classes.select(*digest, "rep").join(part.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*digest, F.coalesce("component", "rep").alias("home"))
    return found.drop("bands").join(named, digest, "left")


def near_duplicates(docs: DataFrame, percent: int = 75, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of near-duplicates: a row per document with doc_id, n_shingles, component_id and kept.

    Two documents are linked if their sets of 5-word shingles have ``percent`` per cent of their union in
    common; a group is all that links connect, named by its smallest doc_id, which is the one kept.
    Documents with the same set are one class from the start, so copies cost one row each. Candidates come
    from 32 bands of 4 places of a SuperMinHash signature: a pair at the threshold is missed with a
    probability of 5e-6. Candidates are confirmed on full sets.

    Null and empty texts have no shingles and are linked with nothing. A text of fewer than five words is one
    shingle. A repeated doc_id gives a row for each of its rows, all in one group. Other columns are left out; an empty table
    gives no rows.
    """
    found = checkpoint(grouped(docs, percent, n_bands, rows))
    least = found.filter("home is not null").groupBy("home").agg(F.min("doc_id").alias("_least"))
    return (
        found.join(least, "home", "left")
        .select("doc_id", "n_shingles", F.when(F.col("home").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents with one row of each group of near-duplicates left, all columns as they are.

    The row with the smallest doc_id stays, one without an id only if its group has no other. Each row is judged by
    its own text: rows that repeat a doc_id with another text are judged apart, and of rows with the same id and
    the same shingles one stays. Rows without shingles (null and empty texts) are linked with nothing and all stay.
    An empty table stays empty; columns of any name are kept.
    """
    digest = ["n_shingles", "d1", "d2"]
    found = checkpoint(grouped(docs, percent))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *digest)
    first = found.filter("home is not null").groupBy("home").agg(F.min(order).alias("_first"))
    judged = found.join(first, "home", "left").withColumn("_stays", F.col("home").isNull() | order.eqNullSafe(F.col("_first")))
    # an id that stands for one row decides for it; the few others are looked at by id and shingles
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = checkpoint(rows.filter("_n > 1 or doc_id is null").select(F.col("doc_id").alias("_near_id")))
    gone = judged.filter("not _stays").select(F.col("doc_id").alias("_near_id")).union(repeated).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_near_id"))
    plain = docs.join(gone, same, "left_anti")
    several = docs.join(repeated, same, "left_semi")
    schema, at = several.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(at).to_pylist()]
            d1, d2 = zip(*map(_digest, sets)) if sets else ((), ())
            key = [pa.array(x, pa.int64()) for x in ([len(x) for x in sets], d1, d2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *key], [*batch.schema.names, *(f"_near_{c}" for c in digest)])

    keys = [f"_near_{c}" for c in digest]
    named = several.mapInArrow(run, T.StructType([*schema.fields, *(T.StructField(k, T.LongType()) for k in keys)]))
    stay = judged.filter("_stays and home is not null").select(F.col("doc_id").alias("_near_id"), *[F.col(c).alias(f"_near_{c}") for c in digest])
    row = F.struct(*docs.columns)
    one = named.filter("_near_n_shingles > 0").groupBy("doc_id", *keys).agg(F.first(row).alias("_near_row"))
    stay = stay.distinct().withColumnsRenamed({k: f"{k}_" for k in keys})
    one = one.join(stay, same & reduce(and_, (F.col(k) == F.col(f"{k}_") for k in keys)), "left_semi")
    bare = named.filter("_near_n_shingles = 0").select(docs.columns)
    return plain.unionByName(one.select("_near_row.*")).unionByName(bare)
