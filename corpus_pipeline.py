"""A corpus in five stages: toxicity, near-duplicates, benchmark, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import decontaminate, neardup, packing, pii, toxicity
from cohort.sizing import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network finds toxic go. It is fitted on the labelled ones outside the held-out fifth.

    Each row is judged by its text: null and empty texts and those without words stay, repeated rows share their
    fate, an empty table stays empty. Columns of any name are kept.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest doc_id; see ``neardup.keep_one``."""
    return neardup.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go.

    Each row is judged by its text: null and empty texts stay, repeated rows share their fate, an empty table stays
    empty, an empty benchmark removes nothing. Columns of any name are kept.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay.

    Null texts stay null, empty ones empty; repeated rows are redacted alike; an empty table stays empty. Columns of
    any name are kept, ``n_chars`` is set anew.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens: a row per piece, see ``packing.pack``.

    Null and empty texts are their end mark alone; repeated rows are packed like any other; an empty table gives no
    rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaked),
    ("pii", redact),
    ("packing", pack),
]

#: No SQL for trained networks, alignments and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between them is written to the shared folder.

    A stage's documents are removed once the next one's are written, so that no unredacted copy of the corpus stays
    behind; those of the last but one, which the result is read from, stay.
    """
    folder = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = f"{folder}/{number}-{name}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            if last:
                _remove(spark, last)
            last = path
    return docs
