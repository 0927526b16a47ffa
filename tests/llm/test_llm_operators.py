"""The training-data operators against brute force, and odd rows: nulls, empty and long texts, ties, empty tables."""

import hashlib
import json
import random
import re
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cohort import sizing
from cohort.llm import (
    decontaminate,
    graph,
    html,
    language,
    neardup,
    packing,
    pii,
    sharding,
    spotsigs,
    textops,
    toxicity,
    urlfilter,
)

#: Extra columns whose names the operators use inside or give back.
CLASH = "shard string, score string, kept int, bucket int, rep int, _part int, _key string, added int, spans string, n int"
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a"),
    (4, "a"),
    (5, "x" * 150_000),
    (6, "the word is long and so it goes on " * 2_000),
    (7, "!!! ... ???"),
    (8, "One two three four five six seven eight nine ten eleven twelve."),
    (9, "one TWO three four five six seven eight nine ten eleven twelve."),
    (None, "a text without an id, of the usual kind and with words in it"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns of clashing names."""
    rows = [(i, t, *([None] * 10)) for i, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, {CLASH}")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# ---- words and shingles


def test_words_and_shingles_count_like_sets():
    random.seed(1)
    for _ in range(200):
        text = "".join(random.choice("ab AB\n\té\u00a0") for _ in range(random.randrange(60)))
        assert len(textops.words_of(text)) == len(words(text))
        assert len(set(textops.words_of(text).tolist())) == len(set(words(text)))
        assert len(textops.shingle_set(text)) == len(shingles(text))
    assert len(textops.words_of(None)) == 0
    assert textops.words_of("a " * 700_000).tolist() == [int(textops.words_of("A")[0])] * 700_000  # over several blocks


# ---- 1 fingerprints


def reference_signatures(text):
    w = [x for x in re.split(r"[^\w]|_", (text or "").lower()) if x]
    content = [x for x in w if x not in spotsigs.ANCHORS]
    spots, seen = set(), 0
    for x in w:
        if x in spotsigs.ANCHORS:
            if seen < len(content):
                spots.add((x, *content[seen : seen + spotsigs.CHAIN]))
        else:
            seen += 1
    return w, content, spots


def test_signatures_are_chains_after_anchors(spark):
    from pyspark.sql import functions as F

    text = "At a rally to kick off a weeklong campaign, the candidate spoke of change"
    _, _, spots = reference_signatures(text)
    assert ("the", "candidate", "spoke") in spots and ("of", "change") in spots
    hashes = {
        r[0]
        for s in spots
        for r in spark.range(1).select(F.hash(F.lit(s[0]), F.array(*map(F.lit, s[1:])))).collect()
    }
    got = set(spark.createDataFrame([(text,)], "t string").select(spotsigs.signatures(F.col("t"))).first()[0])
    spare = got - hashes
    assert hashes <= got and len(spare) <= len(text.split())  # the rest start at content words


def test_edited_fingerprints_follow_the_next_document(spark, odd, empty):
    assert spotsigs.edited_fingerprints(empty).collect() == []
    random.seed(2)
    some = [(i * 7, " ".join(random.choice("the of and cat dog bird tree sky".split()) for _ in range(40))) for i in range(1500)]
    for rows in (ODD, some, [(3, "the only one of its kind")]):
        frame = odd if rows is ODD else spark.createDataFrame(rows, "doc_id long, text string")
        got = spotsigs.edited_fingerprints(frame).collect()
        order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = Counter()
        for k, (i, t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            half = len(t) // 2
            want[(i, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        texts = dict(order)
        prints = {(texts[r.doc_id], r.fingerprint) for r in got if r.doc_id is not None}
        assert len(prints) == len({t for t, _ in prints})  # equal texts, equal fingerprints
    assert got[0].near_next == 1.0  # the only document follows itself


def test_similar_pairs_against_all_pairs(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)] + "the of and in".split() * 5
    rows = []
    for i in range(40):
        base = [random.choice(vocabulary) for _ in range(60)]
        rows.append((3 * i, " ".join(base)))
        for k in (1, 2):
            for _ in range(k * 3):
                base[random.randrange(60)] = random.choice(vocabulary)
            rows.append((3 * i + k, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    sets = {r[0]: frozenset(r[1]) for r in frame.select("doc_id", spotsigs.signatures(F.col("text"))).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    ids = sorted(first.values())
    want = {
        (a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])
    }
    assert want and {(r.a, r.b) for r in spotsigs.similar_pairs(frame).collect()} == want


# ---- 2 packing


def test_best_fit_decreasing_is_that_of_single_pieces():
    random.seed(4)
    for capacity in (7, 16, 100, 2048):
        for _ in range(20):
            lengths = [random.randint(1, capacity) for _ in range(random.randrange(200))]
            lengths += [random.randint(1, max(1, capacity // 9)) for _ in range(random.randrange(80))]
            rooms = []
            for n in sorted(lengths, reverse=True):
                fitting = [(r, i) for i, r in enumerate(rooms) if r >= n]
                if fitting:
                    rooms[min(fitting)[1]] -= n
                else:
                    rooms.append(capacity - n)
            bins = {}
            for n, _, many, first, each, offset in packing.best_fit_decreasing(Counter(lengths), capacity):
                for i in range(many):
                    bins.setdefault(first + i // each, []).append((offset + i % each * n, n))
            for pieces in bins.values():
                end = 0
                for offset, n in sorted(pieces):
                    assert offset == end
                    end += n
                assert end <= capacity
            assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == sorted(rooms)


def test_room_tree_finds_the_tightest():
    tree = packing.RoomTree(20)
    assert tree.tightest(1) is None
    tree.add(7, 2)
    tree.add(20, 1)
    assert [tree.tightest(n) for n in (1, 7, 8, 20)] == [7, 7, 20, 20]
    tree.add(7, -2)
    assert tree.tightest(1) == 20


def test_ids_by_words_are_those_of_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = packing.WordIds(None, limit=500)
    random.seed(5)
    signs = "aA.,!'|éÉ\u0301  \n\t3<>ßİΣσẞÅ漢字।ा"
    texts = ["".join(random.choice(signs) for _ in range(random.randrange(30))) for _ in range(1500)]
    texts += ["it's <|endoftext|> don't.", "a|b. c,", "", "| |", None]
    for at in range(0, len(texts), 50):
        block = texts[at : at + 50]
        for text, ids in zip(block, encode(pa.array(block, pa.string()))):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_ids_by_words_with_signs_and_digits_after_letters():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encode = packing.WordIds(None)
    random.seed(6)
    signs = [chr(i) for i in [*range(32, 127), *range(160, 256)]] + list("abcdeßéöÿ" * 12) + list(" \u0301ΣİЖ漢")
    texts = ["".join(random.choice(signs) for _ in range(random.randrange(60))) for _ in range(3000)]
    texts += ["a.Σ a.b's don't it'll x'r we've", "a<|endoftext|>b a<|b", "one.two,three 4five6 ok!!! ok?!", "ÀÉ é.É ﬁ.a", "w" * 5000]
    for at in range(0, len(texts), 500):
        block = texts[at : at + 500]
        for text, ids in zip(block, encode(pa.array(block, pa.string()))):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_a_word_is_learned_once_whatever_follows_it():
    encode = packing.WordIds(None)
    encode(pa.array(["word Word, word. größe größe! word!!! word?\nword7 word's größe;"]))
    assert len(encode.known) == len(["word", "größe", ",", ".", "!", "!!!", "?", "7", "'s", ";"])


def test_words_of_small_letters_go_to_the_model_alone():
    text = "Seven größere words"
    encode = packing.WordIds(None)
    whole = encode.tokenizer
    encode.tokenizer = types.SimpleNamespace(model=whole.model)
    assert encode(pa.array([text]))[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_places_every_piece_once(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    assert packing.pack(empty).collect() == []
    got = packing.pack(odd, capacity=64).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in ODD:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[(doc, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 64


# ---- 3 languages


def test_language_mixtures_and_held_out_accuracy(spark, empty):
    assert language.identify(empty).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.9 * len(tested)
    model = language.fit(docs.filter(~language.held_out()))
    by = {}
    for r in docs.filter("n_chars > 800").select("text", "lang").collect():
        by.setdefault(r.lang, r.text[:800])
    mixed = by["en"] + " " + by["de"]
    share = dict(zip(model.langs, language.proportions(model, [mixed, by["es"], "", "12 !"])[0]))
    assert share["en"] > 0.25 and share["de"] > 0.25 and share["en"] + share["de"] > 0.85
    assert (language.proportions(model, ["", None, "12 !"]) == 0).all()


def test_language_odd_rows(odd):
    from pyspark.sql import functions as F

    rows = language.predict(odd, language.Model([])).collect()
    assert {r.lang_pred for r in rows} == {"und"} and {r.score for r in rows} == {0.0}
    got = language.predict(odd, language.fit(odd.withColumn("lang", F.lit("en")))).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 7)} == {1: "und", 2: "und", 3: "und", 7: "und"}
    assert all(r.lang_pred == "en" and r.score > 0 for r in got if r.doc_id not in (1, 2, 3, 7))


# ---- 4 near-duplicates


def reference_groups(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in parent}


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = values[:200], values[50:250]
    sa, sb = neardup.superminhash(a, 1024), neardup.superminhash(b, 1024)
    assert abs(neardup.similarity(sa, sb) - 0.6) < 0.06
    assert (neardup.superminhash(a[::-1], 128) == neardup.superminhash(a, 128)).all()
    assert len(set(neardup.superminhash(a[:1], 64) >> np.uint64(32))) == 64  # one element has every rank once


def test_near_duplicates_against_all_pairs(spark, odd, empty):
    assert neardup.near_duplicates(empty).collect() == []
    random.seed(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [random.choice(vocabulary) for _ in range(80)]
    for i in range(160):  # one large family in which not every pair is similar, and others
        if i % 40 == 0:
            base = [random.choice(vocabulary) for _ in range(80)]
        text = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4])):
            text[random.randrange(80)] = random.choice(vocabulary)
        rows.append((1000 - i, " ".join(text)))
    rows += [(5, None), (6, ""), (7, "a b"), (8, "A b"), (9, "a b c")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = reference_groups(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    many = neardup.near_duplicates(odd).collect()
    assert len(many) == len(ODD) and sum(r.doc_id == 4 for r in many) == 2
    assert {r.component_id for r in many if r.doc_id in (8, 9)} == {8}


def test_blocks_find_what_stars_leave_open(spark):
    """A chain of sets in one bucket: neighbours are similar, the centre only to its own neighbours."""
    texts = {i: " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60)) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    named = neardup.sketch(docs).selectExpr("doc_id", "xxhash64(n_shingles, d1, d2) AS rep", "array(1L) AS bands").collect()
    classes = spark.createDataFrame(named, "doc_id long, rep long, bands array<long>")
    links = neardup.links_between(classes, docs, 75)
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {r.rep: min(x.rep for x in named) for r in named}


def test_open_members_are_sent_about_once(spark, monkeypatch):
    """Near copies that share many buckets: sets shipped to blocks stay a small multiple of the members, and no link is lost."""
    random.seed(9)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(300):
        text = list(base)
        for _ in range(3):
            text[random.randrange(60)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    shipped = []
    whole = neardup._blocks
    monkeypatch.setattr(neardup, "_blocks", lambda rest, sets, percent: shipped.append(rest.count()) or whole(rest, sets, percent))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == reference_groups(rows)
    assert sum(shipped) <= 300


NEAR = " ".join(f"n{i}" for i in range(60))
OTHER_TEXT = " ".join(f"o{i}" for i in range(60))


def test_one_row_of_each_group_stays(spark):
    """Rows are judged by their own text, whatever ids repeat."""
    rows = [(1, NEAR), (1, NEAR), (None, NEAR), (2, NEAR + " and"), (2, OTHER_TEXT), (None, "alone in the world without any id"), (None, None), (None, None), (3, ""), (3, ""), (4, OTHER_TEXT)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, kept string, bucket int, rep int, _n int")
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert left == sorted([(1, NEAR), (2, OTHER_TEXT), (None, rows[5][1]), (None, None), (None, None), (3, ""), (3, "")], key=repr)
    assert neardup.keep_one(docs.limit(0)).count() == 0
    same = neardup.near_duplicates(docs.filter("doc_id is not null")).collect()
    assert len(same) == 7 and {(r.doc_id, r.component_id) for r in same} == {(1, 1), (2, 1), (2, 2), (4, 2), (3, 3)}


def test_components(spark):
    random.seed(8)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3), (7, None)]
    links += [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_more_links_than_one_task_ends(spark, monkeypatch):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    monkeypatch.setattr(graph, "FEW", 5)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}


def test_centres_that_members_have_in_common_are_merged(spark):
    chosen = spark.createDataFrame([(1, 10, 10, 1), (1, 20, 20, 2), (1, 30, 30, 4), (1, 40, 40, 8), (2, 50, 50, 1)], "bucket long, c long, own long, bit int")
    links = [(0, 10, 1, 5, 1), (0, 20, 1, 5, 2), (0, 20, 1, 6, 2), (0, 30, 1, 6, 4), (0, 40, 1, 7, 8), (0, 50, 2, 5, 1)]
    new = spark.createDataFrame(links, "a long, b long, bucket long, component long, bit int")
    got = {(r.bucket, r.component): r["_to"] for r in neardup._merged(new, chosen).collect()}
    assert got == {(1, c): 10 for c in (5, 6, 10, 20, 30)} | {(1, 7): 40, (1, 40): 40, (2, 5): 50, (2, 50): 50}


def test_small_steps_of_near_duplicates_take_few_tasks(spark):
    """A step reads as many tasks as its rows need, however many partitions the shuffles before it had."""
    random.seed(4)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(80):
        text = list(base)
        for _ in range(3):
            text[random.randrange(60)] = f"x{random.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("near-tasks", "")
        got = neardup.near_duplicates(docs).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 80
    stages = {s for j in tracker.getJobIdsForGroup("near-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(found.numTasks for found in map(tracker.getStageInfo, stages) if found and found.numCompletedTasks)
    assert tasks < 3000, tasks


def test_checkpoints_in_few_tasks_keep_rows_and_settings(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    kept = sizing.checkpoint_in_few(spark.range(1000).repartition(50), 300)
    assert kept.rdd.getNumPartitions() == 4 and sorted(r.id for r in kept.collect()) == list(range(1000))
    assert spark.conf.get(name, "false") == before
    empty = sizing.checkpoint_in_few(spark.range(0), 300)
    assert empty.count() == 0 and empty.rdd.getNumPartitions() <= 1


def test_near_duplicates_take_few_jobs(spark):
    """Each job leaves plans and code in the driver: joining the parts of small graphs takes one task, not rounds."""
    chain = {i: " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60)) for i in range(40)}
    docs = spark.createDataFrame(list(chain.items()), "doc_id long, text string")
    spark.sparkContext.setJobGroup("near", "")
    try:
        got = neardup.near_duplicates(docs).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    assert {r.component_id for r in got} == {0}
    assert jobs <= 60, jobs


# ---- 5 decontamination


def reference_alignment(query, text):
    best = 0
    row = [0] * (len(text) + 1)
    for q in query:
        new = [0]
        for j, t in enumerate(text):
            new.append(max(0, row[j] + (2 if q == t else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_is_smith_waterman():
    random.seed(9)
    for _ in range(100):
        q = [random.randrange(5) for _ in range(random.randint(1, 12))]
        t = [random.randrange(5) for _ in range(random.randrange(15))]
        score, end = decontaminate.align(np.array(q), np.array(t, int))
        assert score == reference_alignment(q, t) and 0 <= end <= len(t)


def test_matches_of_whole_edited_and_hot_passages(spark, odd, empty):
    random.seed(10)
    vocabulary = [f"v{i}" for i in range(500)]
    item = [random.choice(vocabulary) for _ in range(36)]
    edited = list(item)
    for k in range(3, 36, 6):
        edited[k] = "changed"
    del edited[10], edited[20]
    noise = lambda n: [random.choice(vocabulary) for _ in range(n)]
    docs = [
        (1, " ".join(noise(50) + item + noise(50))),
        (2, " ".join(noise(50) + edited + noise(50)).upper()),
        (3, " ".join(noise(20) + item[:9] + noise(100))),
        (4, " ".join(noise(300))),
        (5, None),
        (6, ""),
    ] + [(100 + i, " ".join(noise(5) + item + noise(5))) for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "v1, never!")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.matches(frame, bench).collect()
    assert {r.doc_id for r in got} == {1, 2, *range(100, 160)} and {r.item_id for r in got} == {1}
    whole = next(r for r in got if r.doc_id == 1)
    assert whole.score == 1.0 and (whole.first_word, whole.end_word) == (50, 86)
    assert 0.5 <= next(r for r in got if r.doc_id == 2).score < 1
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.matches(empty, bench).collect() == []
    assert decontaminate.matches(frame, bench.limit(0)).collect() == []
    assert decontaminate.clean(odd, bench).count() == len(ODD)
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "some words before " + t + " and after") for i, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == {(i, i) for i, _ in items}
    assert decontaminate.clean(docs, bench).collect() == []


def _edited(item, every, how):
    """Copies with a word replaced, dropped or put in at every so many words."""
    if how == "in":
        return [w for k, word in enumerate(item) for w in ([word, f"in{k}"] if k % every == 0 else [word])]
    return [w for k, word in enumerate(item) for w in ([word] if k % every != 1 else [] if how == "out" else [f"new{k}"])]


def test_heavily_edited_copies_without_other_copies(spark):
    random.seed(31)
    items, docs = [], []
    for size in (20, 36, 59):
        for every, how in [(3, "new"), (4, "new"), (5, "new"), (3, "out"), (1, "in"), (2, "in")]:
            i = len(items)
            item = [f"w{i}x{k}" for k in range(size)]
            text = _edited(item, every, how)
            assert reference_alignment(item, text) >= size  # half of the item's own score
            items.append((i, " ".join(item)))
            docs.append((i, " ".join(["before"] * 9 + text + ["after"] * 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench).collect()} == {(i, i) for i, _ in items}
    assert decontaminate.clean(frame, bench).collect() == []
    # many copies of one edited leak beside exact copies
    many = [(i, docs[7][1]) for i in range(40)] + [(i, items[7][1]) for i in range(40, 43)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(frame, bench).collect()} == set(range(43))


def test_no_alignment_is_lost_by_seeds(spark):
    random.seed(32)
    vocabulary = [f"v{i}" for i in range(40)]
    items = {i: [random.choice(vocabulary) for _ in range(random.randint(16, 40))] for i in range(12)}
    docs = {}
    for d in range(150):
        text = list(items[d % 12])
        for _ in range(random.randint(0, len(text))):
            k = random.randrange(len(text))
            text[k : k + random.randint(0, 1)] = [random.choice(vocabulary)] * random.randint(0, 1)
            text = text or ["v0"]
        docs[d] = [random.choice(vocabulary) for _ in range(10)] + text + [random.choice(vocabulary) for _ in range(10)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    want = {(d, i): s for d, t in docs.items() for i, w in items.items() if (s := reference_alignment(w, t) / (2 * len(w))) >= 0.5}
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.matches(frame, bench).collect()} == want


def test_one_phrase_is_no_copy_of_a_short_item(spark):
    items = {1: "what is the capital of france", 2: "name the capital of peru", 3: "define entropy", 4: "who wrote the long novel about the white whale in those days"}
    clean = {1: "he said that the capital of the firm is small", 2: "what is the capital of spain", 3: "please define the entropy", 4: "a dog about the white whale in a book"}
    leaked = {11: "q: What is the capital of France?", 12: "name, if you can, the capital of Peru", 13: "now define entropy!", 14: "and who wrote the long book about the white whale in my day"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    frame = spark.createDataFrame([*clean.items(), *leaked.items()], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench).collect()} == {(10 + i, i) for i in items}
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == set(clean)


def test_alignments_of_so_many_words():
    random.seed(33)
    for _ in range(200):
        q, t = (np.array([random.randrange(5) for _ in range(random.randint(1, 9))]) for _ in range(2))
        assert decontaminate.align_words(q, t, 0)[0] == decontaminate.align(q, t)[0]
        scores = [decontaminate.align_words(q, t, k)[0] for k in range(10)]
        assert scores == sorted(scores, reverse=True) and not any(scores[len(q) + 1 :])
    assert decontaminate.align_words(np.array([1, 2, 3, 4]), np.array([1, 2, 3, 9, 9, 9, 9, 4]), 4) == (4, 8)


# ---- 6 sharding


def test_bounded_ring(spark, odd, empty):
    ids = spark.range(1003).withColumnRenamed("id", "key")
    got = sharding.bounded_ring(ids, "key", 40).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) == 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    before = {r.key: r.shard for r in got}
    after = {r.key: r.shard for r in sharding.bounded_ring(ids, "key", 41).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.25 * len(before)  # limited movement
    hot = spark.createDataFrame([(1,)] * 400 + [(i,) for i in range(2, 200)], "key long")
    sizes = Counter(r.shard for r in sharding.bounded_ring(hot, "key", 7).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 598
    assert sharding.shard_documents(empty).collect() == []
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD
    )


def test_ring_arcs_overflow_clockwise():
    runs = sharding.spill_clockwise({0: 10, 1: 0, 2: 1}, [0, 1, 2], [4, 4, 3])
    assert runs == [(0, 0, 4, 0), (2, 0, 1, 2), (0, 4, 4, 1), (0, 8, 2, 2)]


# ---- 7 toxicity


def toxic_sample(n, seed):
    rng = random.Random(seed)
    mild = [a + b for a in "ba re no ti lu".split() for b in "ko ma si den lor".split()]
    rows = []
    for i in range(n):
        text = [rng.choice(mild) for _ in range(rng.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            text[rng.randrange(len(text))] = "grubble" + rng.choice(["o", "ing", "ed", ""])
        rows.append((" ".join(text), int(bad)))
    return rows


def test_network_learns_and_finds_a_word_anywhere():
    sample = toxic_sample(500, 1)
    model = toxicity.train([t for t, _ in sample], [y for _, y in sample], epochs=4)
    test = toxic_sample(200, 2)
    got = toxicity.score_texts(model, [t for t, _ in test])
    assert np.mean((got >= 0.5) == [y for _, y in test]) >= 0.97
    long = " ".join("bako rema" for _ in range(5000))
    scores = toxicity.score_texts(model, [long, long + " grubbleing", None, "", "?!"])
    assert scores[0] < 0.5 <= scores[1] and (scores[2:] == 0).all()


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    words = toxicity.Words(["ab cd ef gh ij " * 8, "kl ab mn"])
    windows, _ = words.windows()
    target = (np.arange(len(windows)) % 2).astype(float)
    p = {k: v.astype(np.float64) for k, v in toxicity._parameters(rng).items()}
    g = toxicity._step(p, words, windows, target)

    def loss():
        x = toxicity.logits(p, words, windows).astype(float)
        return np.mean(np.log1p(np.exp(x)) - target * x)

    for k in ("into", "back", "focus", "out", "base", "bias"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = p[k][at]
        p[k][at] = keep + 1e-2
        up = loss()
        p[k][at] = keep - 1e-2
        down = loss()
        p[k][at] = keep
        assert abs((up - down) / 2e-2 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4, k


def test_windows_cover_every_word():
    words = toxicity.Words([None, "a", " ".join("abcdefghijklmnopqrstuvwxyz" * 3), ""])
    windows, text = words.windows()
    assert set(text.tolist()) == {1, 2}
    for t in (1, 2):
        seen = [w for row in windows[text == t] for w in row if w >= 0]
        assert set(seen) == set(words.word[words.first[t] : words.first[t + 1]].tolist())


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.fit(empty, labels) == 0.0
    rows = toxicity.score(odd, toxicity.fit(odd, labels, epochs=1)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3, 7)} == {0.0}
    assert toxicity.score(empty, 0.0).collect() == []
    assert toxicity.keep_clean(odd, 0.0).count() == len(ODD)


# ---- 8 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def reference_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            if (
                kind == "email"
                or kind == "ip"
                and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card"
                and 13 <= len(digits) <= 19
                and pii.luhn(digits)
                or kind == "phone"
                and 9 <= len(digits) <= 15
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_those_of_the_patterns():
    random.seed(11)
    for _ in range(4000):
        text = "".join(random.choice("12 0.-+@a()é") for _ in range(random.randrange(40)))
        assert pii.joined(pii.base_spans(text)) == ",".join(reference_spans(text)), text
    cards = "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (555) 123-4567 1.2.3.4.5.6.7.8 256.1.1.1 a@b@c.d.e"
    assert pii.joined(pii.base_spans(cards)) == ",".join(reference_spans(cards))
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []  # in linear time


def test_bootstrapping_finds_unseen_identifiers(spark, odd, empty):
    rows = [(i, f"please call phone: +1 (555) 010-{1000 + i} today or write to user{i}@mail.example.com soon") for i in range(8)]
    rows += [(20, "please call phone: 555-0199-77 today"), (21, "version 3.0 of 2024 and 12345678 things"), (22, None), (23, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert got[20].spans == "phone:19:30" and got[20].added == 1 and got[20].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[21].spans == "" and got[22].spans == "" and got[23].n_email == 0
    for i, text in rows[:8]:
        base = reference_spans(text)
        assert got[i].spans == ",".join(base) and got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_phone) == (1, 1)
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    assert clean[20] == "please call phone: [PHONE] today" and clean[21] == rows[9][1] and clean[22] is None
    assert clean[0] == "please call phone: [PHONE] today or write to [EMAIL] soon"
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []
    assert pii.find(odd).count() == len(ODD)
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)


def test_bootstrapping_finds_identifiers_over_several_tokens(spark):
    rows = [(i, f"office phone: +1 (555) 010-{1000 + i} today; mail to user{i}@mail.example.com soon") for i in range(20)]
    bad = "4111 1111 1111 1112"
    assert not pii.luhn(bad.replace(" ", ""))
    cards = [n for n in range(4000000000000000, 4000000000000400) if pii.luhn(str(n))][:20]
    rows += [(100 + i, f"paid by card {str(n)[:4]} {str(n)[4:8]} {str(n)[8:12]} {str(n)[12:]} yesterday") for i, n in enumerate(cards)]
    split = {
        50: ("office phone: ", "(030) 555 0199", " today", "phone"),
        51: ("office phone: ", "(017) 555-7713", ", thanks", "phone"),
        52: ("the mail to ", "jane (at) example.com", " soon", "email"),
        53: ("the mail to ", "joe[AT]example [dot] org", " soon", "email"),
        54: ("paid by card ", bad, " yesterday", "card"),
    }
    rows += [(k, a + x + b) for k, (a, x, b, _) in split.items()] + [(60, "in 2019 and 2020 2021 2022 we met (at) noon")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    for k, (a, x, b, kind) in split.items():
        assert got[k].spans == f"{kind}:{len(a)}:{len(a) + len(x)}" and got[k].added == 1
        assert clean[k] == f"{a}[{kind.upper()}]{b}"
    assert got[60].spans == "" and all(got[i].added == 0 for i in (*range(20), *range(100, 120)))


# ---- 9 URL rules


def glob_fits(rule, host, path):
    one = lambda g, star: re.compile("".join(star if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
    hosts = [rule.host, "*." + rule.host] if rule.subdomains else [rule.host]
    return any(one(h, ".*").fullmatch(host) for h in hosts) and bool(one(rule.path, ".*").match(path))


def test_automaton_is_that_of_the_globs():
    random.seed(12)
    rules = [
        urlfilter.Rule("block", "".join(random.choice("ab.*?") for _ in range(random.randint(1, 4))), random.choice(["/", "/a*b", "", "*?/b"]), random.random() < 0.5)
        for _ in range(60)  # several words of bits
    ]
    automaton = urlfilter.compile_rules(rules)
    assert len(automaton.start) > 3
    urls = [("".join(random.choice("ab.") for _ in range(random.randrange(7))), "".join(random.choice("/ab") for _ in range(random.randrange(6)))) for _ in range(400)]
    hit = urlfilter.fits(automaton, [f"{h}\0{p}".encode() for h, p in urls], len(rules))
    for (h, p), row in zip(urls, hit):
        assert row.tolist() == [glob_fits(r, h, p) for r in rules], (h, p)


def test_judging_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.example.NET/en/x?q#f", "https://net/", "http://net", "http://notnet/", "x://example.com/de/",
        "http://org/fr/a", "http://a.b.org/fr/", "http://a.org/en", "http://a.com/x.net/", "http://ads.b.com/", "a://b://c.net/",
        "http://example.net/EN/", "http://[::1]:80/en/", "http://é.example.net/en/é", "http://x.net?/", "http://" + "a" * 50_000 + ".net/",
    ]
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: r for r in urlfilter.judge(frame).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (got[i].host, got[i].path) == (host, path)
        fit = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        assert got[i].rule == (best.name if best else None)
        assert got[i].verdict == (best.verdict if best else "block" if host.startswith("ads.") else "allow")
    assert urlfilter.judge(frame.limit(0)).collect() == []


# ---- 10 HTML


ARTICLE = "<p>Long prose that says something at length, without any links, so that its density is high.</p>" * 3


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body><nav><a href=/>Home</a><a href=/x>More</a></nav><article><h1>T &amp; t</h1><p>One\n two.<p>Three<br>four <b>bo</b>ld</article><footer>f</footer>", "T & t One two. Three four bold"),
        ("<div id=menu><ul><li><a href=a>a</a></ul></div><div class=main>" + ARTICLE + "</div><div class='sidebar'>s</div>", " ".join(re.findall("<p>(.*?)</p>", ARTICLE))),
        ("<article><p>Text of it.</p><form><input value=x><p>Sign up</p></form><script>var t='</p>'</script><div class=comments><p>Nice!</p></div><style>p{}</style><!-- <p>no</p> --></article>", "Text of it."),
        ("<p>a &lt;b&gt; &#233;&nbsp;&am c</p>", "a <b> é &am c"),
        ("plain &amp; simple", "plain & simple"),
        ("", ""), (None, ""), ("<", "<"), ("<div><div></p>", ""), ("<a href='x>y'>link</a>", "link"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


PROSE = " ".join(re.findall("<p>(.*?)</p>", ARTICLE))
LINKS = "<div class='nav'><a href=/a>Home</a> <a href=/b>More</a></div>"


@pytest.mark.parametrize(
    "page,want",
    [
        *((f"<body>{LINKS}<div class='{names}'>{ARTICLE}</div><div class='sidebar'>s</div>", PROSE) for names in ("main-content no-sidebar", "page has-sidebar", "layout-header-fixed", "sidebar", "post hidden")),
        *((f"<body>{LINKS}<{tag} class=comments role=search>{ARTICLE}</{tag}><footer>f</footer>", PROSE) for tag in ("form", "article", "main")),
        (f"<body><form action=/>{LINKS}<div>{ARTICLE}</div><div class=cookie-notice>c</div></form>", PROSE),
        (f"<article><div class='post-header'><h1>Title</h1></div>{ARTICLE}<div class='ad'>buy</div></article>", "Title " + PROSE),
        *((f"<article>{ARTICLE}<h2 id='{slug}'>Head</h2><section id='{slug}'><p>Part.</p></section></article>", PROSE + " Head Part.") for slug in ("side-effects", "discussion", "search", "notice-of-changes")),
        (f"<article>{ARTICLE}<h2><span id=Search>Search</span></h2></article>", PROSE + " Search"),
        (f"<article><p>{chr(0x130) * 40}</p><script>a</script>{ARTICLE}<SCRIPT>b</ScRiPt ><p>End.</p></article>", chr(0x130) * 40 + " " + PROSE + " End."),
        (f"<body><article><p>Short text.</p></article><footer>{PROSE}</footer>", "Short text."),
        (f"<body><aside><article>A.</article></aside><form><main><p>Intro.</p><form>{ARTICLE}</form></main></form>", "Intro. " + PROSE),
        (f"<article>{ARTICLE}<script>'</scripts>'; '</ſcript>'</script></article>", PROSE),
    ],
)
def test_names_do_not_take_the_article_away(page, want):
    assert html.main_text(page) == want


def test_density_prefers_prose_over_links():
    root = html.parse("<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div>" + ARTICLE + "</div></body>")
    best = html.main_node(root)
    assert best.link_chars == 0 and best.chars > 200
    assert len(html.main_text("<div>" * 5000 + "deep")) == 4


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 9), (1, "u", "<p>x</p>", 9), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    rows = html.extract(pages).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in rows) == Counter({(1, "x", 1): 2, (None, "", 0): 1})
    assert html.extract(pages.limit(0)).collect() == []


def test_items_with_repeated_or_no_ids_are_all_matched(spark):
    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcd"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")
    got = decontaminate.matches(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == [(0, 1), (1, 1), (2, None)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 9]


ARTICLE = "The story goes on for quite a while, with many words and few links. " * 8


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><meta charset=utf-8><body><nav>menu one</nav><article><p>{a}</p></article><footer>foot</footer></body></html>",
    "<head><script>var x</script><nav>menu</nav><article><p>{a}</p></article><footer>foot</footer>",
    "<body><article><p>{a}</p><div class='ad-slot'>buy now</div><ins class='adsbygoogle'>x</ins><div class='comment-section'>first!</div></article></body>",
    "<body><article><p>{a}</p><section id='comments'><p>first!</p></section></article></body>",
    "<body><div id='gdpr-consent-box'>we use cookies</div><div class='post'><p>{a}</p></div><div id='comments-area'><p>first!</p></div></body>",
])
def test_parts_beside_the_article_are_left_out(spark, page):
    rows = spark.createDataFrame([(1, "u", page.format(a=ARTICLE))], "page_id long, url string, html string")
    assert html.extract(rows).first().text == ARTICLE.strip()


def test_names_that_only_look_alike_stay(spark):
    page = f"<body><article><h2 id='discussion'>Talk</h2><section id='side-effects'><p>{ARTICLE}</p></section><div class='text-section'><p>End.</p></div></article></body>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html.extract(rows).first().text == f"Talk {ARTICLE.strip()} End."
