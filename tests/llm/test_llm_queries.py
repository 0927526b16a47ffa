"""The registered queries on the small tables, and the pipeline stage by stage against brute force."""

import math
import re

import pytest

import corpus_pipeline
from cohort.llm import packing, pii
from cohort.llm.queries import QUERIES, SQL
from compare import differences

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_minhash": "doc_id n_shingles component_id kept",
    "op5_decontamination": "doc_id item_id score",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_url_filter": "page_id host path rule verdict",
    "op10_html_extraction": "page_id url text n_chars",
    "op11_search": "item_id rank doc_id score",
    "op12_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    table = "pages" if "page_id" in df.columns else "documents"
    if name == "op5_decontamination":
        docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
        items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
        exact = {(d, i) for d, text in docs for i, item in items if item in text}
        assert exact <= {(r.doc_id, r.item_id) for r in rows}
    elif name not in ("op2_packing", "op11_search"):
        key = df.columns[0]
        assert sorted(r[key] for r in rows) == [r[0] for r in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) is None


def test_main_text_is_the_article(spark):
    """The pages' articles, cut out by hand."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extraction"](spark, SMALL).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>)", pages[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else "", body)
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_packing_is_tight(spark):
    rows = QUERIES["op2_packing"](spark, SMALL).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= math.ceil(total / packing.CAPACITY) + 1


def test_pipeline_stage_by_stage(spark, tmp_path):
    from test_llm_operators import reference_groups

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r.doc_id: r.text for r in after["toxicity"]}
    judged = [toxic[i] == (i not in left) for i in toxic]
    assert sum(judged) >= 0.95 * len(judged)
    groups = reference_groups(list(left.items()))
    one = {r.doc_id: r.text for r in after["near_duplicates"]}
    assert set(one) == set(groups.values()) and all(left[i] == one[i] for i in one)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id: r.text for r in after["decontamination"]}
    assert not any(item in text for item in items for text in clean.values())
    assert set(one) - set(clean) <= {i for i, t in one.items() if any(x.lower() in t.lower() for x in items)}
    hidden = {r.doc_id: r for r in after["pii"]}
    assert set(hidden) == set(clean)
    for i, r in hidden.items():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
        assert pii.base_spans(clean[i]) or r.text == clean[i]
    assert {r.doc_id for r in after["packing"]} == set(hidden)


def test_whole_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_stages_of_odd_rows_and_empty_tables(spark):
    """Null, empty and repeated rows, and columns whose names the operators use."""
    same = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None), (1, None), (2, ""), (3, same), (3, same), (4, same + " more"), (None, same), (None, "mail me at a.b@example.com today")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, _n int, key string, home int"
    docs = spark.createDataFrame([(i, t, "en", None, 5, "s", 1, 2, "k", 3) for i, t in rows], schema)
    left = {"toxicity": 8, "near_duplicates": 5, "decontamination": 8, "pii": 8}
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, SMALL), stage(spark, docs.limit(0), SMALL)
        assert none.count() == 0
        if name == "packing":
            assert got.count() == 8
            continue
        assert got.columns == none.columns == docs.columns and got.count() == left[name]
        if name == "near_duplicates":
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([rows[0], rows[0], rows[2], rows[3], rows[7]], key=repr)


def test_only_the_last_intermediate_corpus_stays(spark):
    from pathlib import Path

    from cohort.sizing import shared_folder

    def folders():
        return {p for run in Path(shared_folder(spark).removeprefix("file:")).glob("pipeline-*") for p in run.iterdir()}

    before = folders()
    corpus_pipeline.run(spark, SMALL).count()
    assert [p.name for p in folders() - before] == ["3-pii"]
