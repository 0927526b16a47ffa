"""Shards by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import bisect
import json
import zlib

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

NODES = 128


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. A shard's positions don't depend on other shards."""
    points = {zlib.crc32(f"{s}/{v}/{s * nodes + v}".encode()): s for s in range(shards) for v in range(nodes)}
    return sorted(points.items())


def capacities(rows: int, shards: int) -> list[int]:
    """Bounds of the loads: all equal, but the first ``rows % shards`` shards hold one row more."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def spill_clockwise(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Where the rows of each arc go: (arc, first rank, number, shard).

    ``counts``: rows by arc (index of the virtual node that ends it). Each arc first fills its own shard;
    what finds the shard full continues clockwise to the next node whose shard has room. Works on one
    number per arc, so it is as small as the ring whatever the number of rows. ``room`` must sum to the rows.
    """
    room, n, out = list(room), len(owners), []
    #: (arc, first rank not yet placed, how many, the node it waits at)
    waiting = [(arc, 0, counts[arc], arc) for arc in sorted(counts) if counts[arc]]
    open_nodes = [i for i in range(n) if room[owners[i]]]
    while waiting:
        left = []
        for arc, rank, many, node in waiting:
            take = min(many, room[owners[node]])
            if take:
                room[owners[node]] -= take
                out.append((arc, rank, take, owners[node]))
            if many > take:
                left.append((arc, rank + take, many - take, node))
        open_nodes = [i for i in open_nodes if room[owners[i]]]
        waiting = [(a, r, m, open_nodes[bisect.bisect(open_nodes, node) % len(open_nodes)]) for a, r, m, node in left]
    return out


def _arc(position: Column, points: list[int]) -> Column:
    """Index of the first virtual node at or after a position, around the ring: a binary search in 14 steps."""
    steps = F.array(*[F.lit(1 << b) for b in range((len(points) - 1).bit_length(), -1, -1)])
    at = F.from_json(F.lit(json.dumps(points)), "array<bigint>")
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(points)) & (F.try_element_at(at, (low + step).cast("int")) < position), low + step
        ).otherwise(low),
    )
    return F.pmod(below, F.lit(len(points)))


def bounded_ring(df: DataFrame, key: str, shards: int, nodes: int = NODES) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in its shard) so that shard sizes differ by one row at most.

    A row's key is hashed onto a ring of ``shards * nodes`` virtual nodes and belongs to the next node
    clockwise; keys that find its shard full go on clockwise. With bounds this tight the balance is exact;
    a further shard takes its arcs from the others, and only overflow moves besides.

    Null keys have one place on the ring like any other key. Repeated keys lie in one arc and are told apart
    by their order in it, so a key with a third of all rows just overflows clockwise. Columns named ``shard``
    or ``slot`` are replaced. An empty table gives no rows. One aggregate of ring size reaches the driver.
    """
    points = ring(shards, nodes)
    owners = [s for _, s in points]
    df = df.drop("shard", "slot")
    # unsigned 32 bits, as the ring's positions; within an arc the order is that of a second hash, then of the key
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = (
        df.withColumn("_place", F.crc32(F.concat(text, F.lit("#"), text)))
        .withColumn("_order", F.xxhash64(F.col(key)))
        .withColumn("_arc", _arc(F.col("_place"), [p for p, _ in points]))
    )
    # A row number inside each arc would put a hot key into one task: number small parts of an arc, then add
    # what lies in the parts before. The part of repeated keys follows the whole row.
    placed = placed.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(7)), F.lit(PARTS)))
    sizes = placed.groupBy("_arc", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_arc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_arc", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    counts = {r[0]: r[1] for r in placed.groupBy("_arc").agg(F.count(F.lit(1))).collect()}
    runs = spill_clockwise(counts, owners, capacities(sum(counts.values()), shards))
    filled, plan = [0] * shards, {}
    for arc, rank, many, shard in runs:
        plan.setdefault(arc, []).append((rank, rank + many, shard, filled[shard] - rank))
        filled[shard] += many
    rows = [{"_arc": a, "_runs": [dict(zip(("f", "t", "s", "d"), r)) for r in v]} for a, v in plan.items()]
    table = df.sparkSession.range(1).select(
        F.inline(
            F.from_json(
                F.lit(json.dumps(rows)), "array<struct<_arc:int,_runs:array<struct<f:bigint,t:bigint,s:int,d:bigint>>>>"
            )
        )
    )
    order = Window.partitionBy("_arc", "_part").orderBy("_order", F.col(key))
    ranked = (
        placed.withColumn("_rank", F.row_number().over(order) - 1)
        .join(starts, ["_arc", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    )
    # at most one row per virtual node: bounded by the ring
    run = F.filter("_runs", lambda r: (r["f"] <= F.col("_rank")) & (F.col("_rank") < r["t"]))[0]
    return (
        ranked.join(F.broadcast(table), "_arc")
        .withColumn("_run", run)
        .select(*df.columns, F.col("_run.s").alias("shard"), (F.col("_rank") + F.col("_run.d")).alias("slot"))
    )


#: Parts that an arc's rows are numbered in.
PARTS = 64


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shards of documents with sizes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16; a null text has none. The law kept is ``rows``.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    small = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    return bounded_ring(small, "doc_id", shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
