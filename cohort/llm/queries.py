"""One query for each operator, over its whole table, and the SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohort.llm import (
    decontaminate,
    html,
    language,
    merkle,
    neardup,
    packing,
    pii,
    search,
    secrets,
    sharding,
    spotsigs,
    toxicity,
    urlfilter,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """SpotSigs fingerprints of all documents and of their edited texts."""
    return spotsigs.edited_fingerprints(_documents(spark, folder))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_documents(spark, folder))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents, learned from those that aren't held out."""
    return language.identify(_documents(spark, folder)).select("doc_id", "held_out", "lang_pred", "score")


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.near_duplicates(_documents(spark, folder))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds, whole, edited or paraphrased."""
    return decontaminate.matches(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shards 0 to 39 by the bounded ring."""
    return sharding.shard_documents(_documents(spark, folder))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents, by a network fitted on rows outside the held-out fifth."""
    docs = _documents(spark, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxicity.score(docs, model)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of all documents."""
    return pii.find(_documents(spark, folder))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL against the stated rules."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.rank(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and which tampered copies they notice."""
    return merkle.verified(_documents(spark, folder))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.find(_documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_minhash": op4_minhash,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_url_filter": op9_url_filter,
    "op10_html_extraction": op10_html_extraction,
    "op11_search": op11_search,
    "op12_manifest": op12_manifest,
    "op13_secrets": op13_secrets,
}


def _tree_sql(nodes: str, prefix: str, levels: int) -> tuple[str, str]:
    """CTEs that climb ``levels`` levels from ``nodes`` (g, p, n, digest), every one with its siblings; the last one's name."""
    ctes, name = [], nodes
    for k in range(levels):
        ctes.append(f"""
        {prefix}s{k} AS (
            SELECT g, p, n,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
            FROM {name}),
        {prefix}{k + 1} AS (
            SELECT g, p // 8 AS p, (max(n) + 7) // 8 AS n,
                   CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY p)) END AS digest
            FROM {name} GROUP BY g, p // 8)""")
        name = f"{prefix}{k + 1}"
    return ",".join(ctes), name


def _fold_sql(rows: str, prefix: str, levels: int, out: str) -> str:
    """CTEs that lead ``rows`` (id, g, p, cur, proof) through the siblings of every level."""
    ctes, name = [], rows
    for k in range(levels):
        ctes.append(f"""
        {out}{k + 1} AS (
            SELECT id, g, p // 8 AS p, CASE WHEN n = 1 THEN cur ELSE sha256(lft || cur || rgt) END AS cur, proof || lft || rgt AS proof
            FROM {name} JOIN {prefix}s{k} USING (g, p))""")
        name = f"{out}{k + 1}"
    return ",".join(ctes)


def _manifest_sql(leaf_levels: int = 8, lang_levels: int = 4) -> str:
    """For up to 8**8 documents of a language and 8**4 languages."""
    fields = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32, bit by bit
    crc = """xor(list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
    langs, subroots = _tree_sql("a0", "a", leaf_levels)
    top, root = _tree_sql("b0", "b", lang_levels)
    return f"""
        WITH hashed AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({fields} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN {crc} % 3 = 0 THEN sha256({fields} || coalesce(strlen(text) || ':' || {lower}, '-')) END AS changed
            FROM documents),
        leaves AS (
            SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS id,
                   row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
            FROM hashed),
        a0 AS (SELECT g, p, n, leaf AS digest FROM leaves),
        f0 AS (SELECT id, g, p, coalesce(changed, leaf) AS cur, '' AS proof FROM leaves),
        {langs}, {_fold_sql("f0", "a", leaf_levels, "f")},
        subs AS (SELECT g AS lang, digest, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM {subroots}),
        b0 AS (SELECT '' AS g, p, n, digest FROM subs),
        h0 AS (SELECT id, '' AS g, s.p, cur, proof FROM f{leaf_levels} f JOIN subs s ON f.g = s.lang),
        {top}, {_fold_sql("h0", "b", lang_levels, "h")}
        SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.digest AS verified
        FROM leaves l JOIN h{lang_levels} h USING (id) JOIN subs s ON l.g = s.lang CROSS JOIN {root} r"""


_TERMS = """unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"""

SQL: dict[str, str] = {
    "op9_url_filter": """
        WITH split AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM split
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN host LIKE 'ads.%' OR host LIKE '%.ads.%' OR host LIKE 'adserver.%' OR host LIKE 'tracker.%'
              OR path LIKE '/login%' OR path LIKE '/cgi-bin/%' OR path LIKE '%/wp-admin/%' THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
    "op11_search": f"""
        WITH words AS (SELECT rowid_ AS d, doc_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)),
        postings AS (SELECT d, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        lengths AS (SELECT d, sum(tf)::BIGINT AS n FROM postings GROUP BY 1),
        corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM postings CROSS JOIN corpus GROUP BY term),
        items AS (SELECT item_id, text, row_number() OVER () AS i FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, {_TERMS} AS term FROM items) GROUP BY ALL),
        scored AS (
            SELECT i, item_id, d, doc_id,
                   sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (d) CROSS JOIN corpus GROUP BY ALL),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS "rank" FROM scored WHERE score > 0)
        SELECT item_id, "rank", doc_id, score FROM ranked WHERE "rank" <= 20""",
    "op12_manifest": _manifest_sql(),
}
