"""Merkle manifest of a table by time-forward processing.

Every group of rows (a language) is a tree of fan-out 8 over its leaves in key order, and the groups' subroots
are the leaves of one more tree. Nodes are labelled by level and place. Digests travel forward, from children
to parents, through a priority queue ordered by label; then the sweep is reversed and proof suffixes travel
from parents to leaves. The queue is external: what goes from one block of 4,096 neighbouring nodes to the next
higher block is a row that Spark shuffles to its receiver and spills if need be; only messages inside a block
lie in a heap in memory. A group of any size is many blocks, so no task holds more than one of them.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.sizing import checkpoint, small_or_plain

FANOUT = 8
#: Levels that a block spans.
LEVELS = 4
HEX = 64


def leaf_digest(*columns: str | Column) -> Column:
    """sha256 of a row: each column ``-`` if null, else its byte count, a colon and its value."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(c: str | Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def forward(digests: list[str], levels: int) -> tuple[dict[tuple[int, int], list[str]], str]:
    """Climb ``levels`` levels: the digests that each inner label receives, and the digest of the last one."""
    queue = [(1, i // FANOUT, i % FANOUT, d) for i, d in enumerate(digests)] if levels else []
    received, own = {}, digests[0]
    while queue:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heappop(queue)[3])
        received[level, place], own = run, _digest(run)
        if level < levels:
            heappush(queue, (level + 1, place // FANOUT, place % FANOUT, own))
    return received, own


def backward(received: dict, levels: int, proof: str, steps: bytes) -> list[tuple[str, bytes]]:
    """The reversed sweep: for each leaf of a block its proof, the suffix of which is the block's.

    A step is ``slot * 8 + number of siblings``; the siblings stand in the proof in order.
    """
    queue, out = [(-levels, 0, proof, steps)], []
    while queue:
        level, place, proof, steps = heappop(queue)
        if level == 0:
            out.append((proof, steps))
            continue
        run = received[-level, -place]
        for slot in range(len(run)):
            siblings = "".join(run[:slot] + run[slot + 1 :])
            step = bytes([slot * FANOUT + len(run) - 1])
            heappush(queue, (level + 1, place * FANOUT - slot, siblings + proof, step + steps))
    return out[::-1]


def fold(digest: str, proof: str, steps: bytes) -> str:
    """The root that a leaf's digest and its proof lead to."""
    at = 0
    for step in steps:
        slot, others = divmod(step, FANOUT)
        siblings = proof[at : at + HEX * others]
        digest = _digest([siblings[: HEX * slot], digest, siblings[HEX * slot :]])
        at += HEX * others
    return digest


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their place (from 0) in their group's order and the group's size ``n``.

    Rows are dealt by ranges of group and order, ties by where they were read, so groups of any size and equal
    rows are split; the ranges' sizes give the place where each begins.
    """
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    dealt = dealt.withColumn("_row", F.monotonically_increasing_id())
    dealt = checkpoint(dealt.withColumn("_part", F.shiftright("_row", 33)))
    sizes = dealt.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    every = Window.partitionBy(group)
    upto = F.sum("_size").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = sizes.select(
        group, "_part", (upto - F.col("_size") - F.col("_first")).alias("_shift"), F.sum("_size").over(every).alias("n")
    )
    out = dealt.join(small_or_plain(sizes), [group, "_part"])
    return out.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _block(levels: int = LEVELS) -> Column:
    return F.floor(F.col("place") / FANOUT**levels).cast("long")


def _climb(n: int) -> int:
    return min(LEVELS, levels_of(n))


def rise(leaves: DataFrame) -> list[DataFrame]:
    """The forward sweep over all groups: tables of nodes (group, place, n, digest), each four levels above the last.

    The last table holds one node for each group.
    """

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("place")
        n = order.column("n")[0].as_py()
        levels = _climb(n)
        _, top = forward(order.column("digest").to_pylist(), levels)
        place, left = order.column("place")[0].as_py() // FANOUT**LEVELS, n
        for _ in range(levels):
            left = -(-left // FANOUT)
        return pa.table({"group": order.column("group").slice(0, 1), "place": [place], "n": [left], "digest": [top]})

    tables = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        nodes = tables[-1].select("group", "place", "n", "digest", _block().alias("block"))
        up = nodes.groupBy("group", "block").applyInArrow(run, "group string, place long, n long, digest string")
        tables.append(checkpoint(up))
        largest = -(-largest // FANOUT**LEVELS)
    return tables


#: What a block hears from above: the proof suffix of its topmost node, and the roots over it.
MESSAGE = "group string, place long, proof string, steps binary, subroot string, root string"


def fall(tables: list[DataFrame], messages: DataFrame, keep: str = "") -> DataFrame:
    """The reversed sweep: ``messages`` to the topmost nodes become one for each leaf, with the columns ``keep``.

    ``keep`` is a schema of further columns of the leaves.
    """
    names = [part.split()[0] for part in keep.split(", ")] if keep else []

    def sweep(extra: list[str]):
        def run(nodes: pa.Table, heard: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("place")
            levels = _climb(nodes.column("n")[0].as_py())
            received, _ = forward(nodes.column("digest").to_pylist(), levels)
            said = heard.to_pylist()[0]
            proofs, steps = zip(*backward(received, levels, said["proof"], said["steps"]))
            roots = {k: pa.repeat(pa.scalar(said[k], pa.string()), len(nodes)) for k in ("subroot", "root")}
            columns = {"group": nodes.column("group"), "place": nodes.column("place"), "proof": list(proofs), "steps": list(steps)}
            return pa.table(columns | roots | {k: nodes.column(k) for k in extra})

        return run

    for i, table in reversed(list(enumerate(tables[:-1]))):
        extra = names if i == 0 else []
        nodes = table.select("group", "place", "n", "digest", *[c for c in extra if c != "digest"], _block().alias("block"))
        said = messages.withColumnRenamed("place", "block")
        both = nodes.groupBy("group", "block").cogroup(said.groupBy("group", "block"))
        schema = MESSAGE + (f", {keep}" if extra else "")
        messages = both.applyInArrow(sweep(extra), schema)
    if len(tables) == 1 and names:  # every group is a single leaf
        messages = messages.join(tables[0].select("group", "place", *names), ["group", "place"])
    return messages


def proofs(rows: DataFrame, group: str, key: str, leaf: str, keep: str = "") -> DataFrame:
    """A manifest: one row for each row of ``rows``, with its place, proof, steps, subroot and root.

    ``leaf`` names the digest of the row; leaves of a group follow ``key`` (null first), equal keys the digest.
    ``keep`` is a schema of the columns that go along. A null group is a group, the first. An empty table gives
    no rows. Fully equal rows are leaves of their own. Columns of other names are left out.
    """
    names = [part.split()[0] for part in keep.split(", ")] if keep else []
    # never null, ordered as the groups are
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group")
    nodes = rows.select(named, F.col(key).alias("_key"), F.col(leaf).alias("digest"), *[F.col(c) for c in names])
    # digests are made once; ranges are drawn from them
    tables = rise(checkpoint(placed(checkpoint(nodes), "group", "_key", "digest")))
    subroots = tables[-1].select(F.lit("").alias("group"), F.col("group").alias("_group"), "digest")
    upper = rise(checkpoint(placed(subroots, "group", "_group").select("group", "place", "n", "digest", "_group")))
    top = upper[-1].select("group", "place", F.lit("").alias("proof"), F.lit(b"").alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    found = fall(upper, top, "_group string, digest string")
    heard = found.select(
        F.col("_group").alias("group"), F.lit(0).cast("long").alias("place"), "proof", "steps", F.col("digest").alias("subroot"), "root"
    )
    return fall(tables, checkpoint(heard), ", ".join(["digest string", keep] if keep else ["digest string"]))


def manifest(docs: DataFrame) -> DataFrame:
    """Every document's place in the manifest, and whether a tampered copy would be noticed.

    Returns doc_id, leaf, subroot, root, proof, steps, changed (the digest of the copy) and folded_root. Copies
    are tampered with where 3 divides the crc32 of the doc_id; a null doc_id has none and stays, null and empty
    texts stay as they are. Repeated rows are leaves of their own. Columns besides those of documents are left out.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = leaf_digest(*fields, "text")
    rows = docs.select(
        "doc_id",
        "lang",
        leaf.alias("leaf"),
        F.when(hit, leaf_digest(*fields, lower_ascii("text"))).alias("changed"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    proved = proofs(rows, "lang", "doc_id", "leaf", f"doc_id {kind}, changed string")

    def run(batches):
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            given = zip(*(column[c].to_pylist() for c in ("changed", "leaf", "proof", "steps")))
            folded = [fold(changed or leaf, proof, steps) for changed, leaf, proof, steps in given]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], [*batch.schema.names, "folded_root"])

    wanted = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", "steps", "changed")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof string, steps binary, changed string, folded_root string"
    return wanted.mapInArrow(run, schema)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's digests: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    return manifest(docs).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
