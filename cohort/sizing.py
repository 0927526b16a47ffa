"""Size checks for broadcasts, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

BROADCAST_ROWS = 10_000


def small_or_plain(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Return ``df`` as a broadcast side if it has at most ``max_rows`` rows, else unchanged.

    Meant for already aggregated sides (group statistics, category counts). At most
    ``max_rows + 1`` rows are looked at by the driver. A larger side stays distributed and the
    join is left to a shuffle, whose hot keys adaptive execution splits.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    One is chosen here only for a master of a single process with none set, as in tests; it goes with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="cohort-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return (named or sc.getCheckpointDir()).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_in_few(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``checkpoint``, read again by a task for every ``rows`` rows, whose shuffle files go once it is written.

    For chains of many small steps: else each step reads as many tasks as the shuffles and skewed joins before it
    made, and the files of all steps stay until the driver happens to collect its garbage. Not for use in threads,
    as the setting is the session's.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    seen = Observation()
    conf.set(name, "true")
    try:
        kept = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("n")))
    finally:
        conf.set(name, before)
    return kept.coalesce(max(1, -(-seen.get["n"] // rows)))


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written out in code (value maps, dictionaries, metrics)."""
    return spark.createDataFrame(rows, schema=schema)
