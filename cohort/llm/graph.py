"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohort.sizing import checkpoint_in_few

#: Up to so many links left over by the partitions, one task ends them; more go through the rounds.
FEW = 200_000


def _forest(links: DataFrame) -> DataFrame:
    """Union-find inside each partition: its links become (node, smallest node reached)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                parent.setdefault(a, a), parent.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # hand on what is known and start anew
                yield pd.DataFrame([(x, find(x)) for x in parent if find(x) != x], columns=["a", "b"])
                parent.clear()
        yield pd.DataFrame([(x, find(x)) for x in parent if find(x) != x], columns=["a", "b"], dtype="int64")

    return links.mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Union-find inside each partition shortens the list first. What that leaves is ended by one more task if it is
    no more than ``FEW`` links; else large-star and small-star rounds alternate until nothing changes, each a
    minimum per node and a join on it. A node with very many links is only ever the key of a minimum, or of a join
    whose other side has one row a key. Each round is cut with a reliable checkpoint. Null and self links are ignored.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = checkpoint_in_few(_forest(links), 50_000)
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    before = edges.agg(*digest).first()
    few = before[0] <= FEW
    if few:
        edges = checkpoint_in_few(_forest(edges.coalesce(1)), FEW)
    while not few:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, go to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
            .select("col.*")
            .filter("a <> b")
            .distinct()
        )
        edges = checkpoint_in_few(small, 50_000)
        after = edges.agg(*digest).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
