"""Ranked search, Merkle manifest and secret scans against brute force, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohort.llm import merkle, search, secrets
from cohort.llm.queries import QUERIES
from test_llm_operators import ODD

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASH = "group string, place string, n int, digest string, term string, score int, item int, block int, spans string, _tie int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None, k, *["x"] * 2, 1, "x", "x", 1, 1, 1, "x", 1) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {CLASH}")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- search


def terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))


def ranked_by_hand(docs, items, k=20):
    docs = [(i, terms(t)) for i, t in docs]
    held = [sum(c.values()) for _, c in docs if c]
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * len(held) // sum(held) if held else 0
            total = 0
            for w, times in terms(text).items():
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1)))
                    total += times * weight * (10**9 * c[w] // (1000 * c[w] + 12 * m))
            if total > 0:
                scores.append((-total, i is not None, i, total))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores)[:k])]
    return out


def random_texts(n, seed, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Über", "naïve", "x_y", "42"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1, 3_000, 10_000_000])
def test_search_against_all_documents(spark, shard_bytes):
    docs = list(enumerate(random_texts(900, 1)))
    items = [(7, "w3 w50 w50 Über"), (8, "W1 w2, w59"), (8, "another text of item 8: w10"), (None, "naïve 42"), (9, "nowhere"), (10, ""), (11, None)]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), shard_bytes)
    found = search.search(index, spark.createDataFrame(items, "item_id long, text string"), queries=2)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(ranked_by_hand(docs, items), key=repr)


def test_search_of_odd_rows(spark, odd):
    items = [(1, "word one a x text"), (1, "word one a x text"), (2, "seven")]
    found = search.rank(odd, spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank int"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(ranked_by_hand(ODD, items[1:]), key=repr)


def test_search_of_empty_tables(spark, odd):
    none, items = odd.limit(0), spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.rank(none, items).count() == 0
    assert search.rank(odd, items.limit(0)).count() == 0
    assert search.rank(odd.filter("text is null"), items).count() == 0


def test_ties_follow_the_id_across_shards(spark):
    docs = [(i, "same text here") for i in random.Random(3).sample(range(-50, 50), 60)] + [(None, "same text here"), (99, "else"), (98, "or")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = search.rank(frame, spark.createDataFrame([(1, "text")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [None, *sorted(i for i, t in docs if i is not None and t.startswith("same"))[:19]]


def test_postings_round_trip():
    values = np.array([0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**35, 5], np.int64)
    data, size = search.varints(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 3, 6, 1] and search.values_of(data).tolist() == values.tolist()


def test_blocks_of_common_terms_stay_closed(spark):
    """A rare term leads; of the common term's blocks only those with candidates are decompressed."""
    docs = [(i, "common " * (1 + i % 3) + ("rare " * 5 if i < 40 or i == 5_000 else "")) for i in range(6_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = search.build(frame).collect()
    own = next(r for r in rows if r.term is None)
    by_df = sorted((r for r in rows if r.term is not None), key=lambda r: r.df)
    lists = search.Postings(*[[np.array(r[c]) for r in by_df] for c in ("last", "cut", "most")], [r.data for r in by_df], np.array(own.m))
    weight, top = np.array([5_000, 1]), np.array([r.top for r in by_df])
    found, scores = search.best(lists, np.array([0, 1]), weight, top, np.arange(6_000))
    assert len(found) == 20 and set(found) <= {*range(40), 5_000}
    blocks = {b for i, b in lists.blocks if i == 1}
    assert len(by_df[1].last) == 47 and len(blocks) <= 4
    shares = [dict(zip(*lists.span(i, 0, 6_000))) for i in range(2)]
    every = [sum(w * shares[i].get(d, 0) for i, w in enumerate(weight)) for d in range(6_000)]
    assert sorted(scores.tolist(), reverse=True) == sorted(every, reverse=True)[:20]


# --- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i // 8 * 8
            yield i - a, level[a:i] + level[i + 1 : a + 8]
            i //= 8

    groups = {}
    for r in rows:
        changed = r[:4] + (r[4] and lowered(r[4]),)
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        leaf = sha(*map(field, r))
        groups.setdefault(r[2], []).append((r[0] is not None, r[0], leaf, sha(*map(field, changed)) if hit else leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, doc_id, leaf, now) in enumerate(sorted(groups[g])):
            steps = [*path(trees[g], i), *path(top, k)]
            for slot, others in steps:
                now = sha(*others[:slot], now, *others[slot:])
            proof = sha(*(s for _, others in steps for s in others))
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [64, 3, 4097], [1] * 30])
def test_manifest_against_plain_trees(spark, sizes):
    rows = [(i * 7, "s", f"g{g}", i, f"Text É {i}") for g, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, FIELDS).repartition(5)
    assert sorted(map(tuple, merkle.verified(frame).collect()), key=repr) == manifest_by_hand(rows)


def test_manifest_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    rows += rows[:3]
    both = odd.unionByName(odd.filter("n_chars < 3"))
    assert sorted(map(tuple, merkle.verified(both).collect()), key=repr) == manifest_by_hand(rows)
    assert merkle.verified(odd.limit(0)).count() == 0


def test_a_hot_key_is_split(spark):
    """Rows that are equal in all fields are dealt over several ranges."""
    rows = spark.range(0, 20_000, 1, 6).selectExpr("'g' AS `group`", "1 AS _key", "'d' AS digest")
    placed = merkle.placed(rows, "group", "_key", "digest")
    assert [r.place for r in placed.orderBy("place").collect()] == list(range(20_000))
    parts = placed.groupBy("n").count().collect()
    assert parts[0].n == 20_000 and len(parts) == 1


def test_sweeps_deliver_by_label():
    digests = [sha(str(i)) for i in range(8**3 + 5)]
    levels = merkle.levels_of(len(digests))
    received, root = merkle.forward(digests, levels)
    assert levels == 4 and len(received) == 65 + 9 + 2 + 1
    for digest, (proof, steps) in zip(digests, merkle.backward(received, levels, "", b"")):
        assert len(steps) == 4 and merkle.fold(digest, proof, steps) == root
        assert merkle.fold(sha("other"), proof, steps) != root


# --- secrets


def base_by_hand(text):
    patterns = [
        (re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 8),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(patterns) for m in p.finditer(text or "") if fits(m))


def test_base_patterns():
    rng = random.Random(5)
    parts = ["token", "Api_Key", "apikey", "PASSWORD", "ſecret", "secret", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH1234", "AKIAAKIA", "é",
             "0123456789abcdef", "deadbeef", "abc.def-ghi", "==", "\n", "x", "12345678", "K"]
    for _ in range(3_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert secrets.base_spans(text) == base_by_hand(text), text
    assert secrets.base_spans(None) == secrets.base_spans("") == []


def test_secrets_query_against_base(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_secrets"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_by_hand(texts[r.doc_id])
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == sha(text) and [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_secrets_of_odd_rows(spark, odd):
    rows = secrets.find(odd).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" and r.base_sha256 == sha("") for r in rows)
    assert secrets.find(odd.limit(0)).count() == 0
    both = spark.createDataFrame([(1, 'é token: "abcdefgh"'), (1, 'é token: "abcdefgh"'), (None, "AKIA0123456789AB")], "doc_id long, text string")
    assert sorted(r.spans for r in secrets.find(both).collect()) == ["access:0:16", "assign:2:18", "assign:2:18"]


def _key(rng):
    return "ghx_" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))


def test_learned_formats_are_found_without_their_context(spark):
    """Credentials whose format is learned after ``token =`` are found bare; prose, paths, hosts and numbers aren't."""
    rng = random.Random(11)
    words = ["internationalisation", "counterrevolutionary", "/usr/share/dictionary/words", "www.some-host.example.com", "4761598977407687", "2024-01-01T00.00.00", "understanding", "of"]
    prose = [(i, " ".join(rng.choices(words, k=30))) for i in range(300)]
    labelled = [(1000 + i, f"set token = {_key(rng)} now") for i in range(60)]
    bare = [(2000 + i, f"{rng.choice(words)} {_key(rng)}. {rng.choice(words)}") for i in range(60)]
    rows = secrets.find(spark.createDataFrame(prose + labelled + bare, "doc_id long, text string")).collect()
    texts = dict(bare)
    hits = {r.doc_id: r.spans for r in rows if r.added}
    assert set(hits) <= set(texts) and len(hits) >= 0.95 * len(bare)
    for i, spans in hits.items():
        kind, a, b = spans.split(":")
        assert kind == "like_assign" and re.fullmatch(r"ghx_\w{36}", texts[i][int(a) : int(b)])


def test_the_automaton_keeps_a_fixed_length_and_merges_a_loop():
    rng = random.Random(2)
    fixed = secrets.infer(["".join(rng.choices("0123456789abcdef", k=12)) for _ in range(200)])
    assert len(fixed["states"]) == 13 and [s[0] for s in fixed["states"]].count(1.0) == 1
    loop = ["a" * (1 + int(rng.expovariate(0.15))) for _ in range(1_000)]
    assert len(secrets.infer(loop)["states"]) <= 2


def test_likelihoods_sum_to_one():
    """Without what is kept for the unseen, the automaton is a distribution over strings."""
    model = secrets.infer(["01", "0", "011", "0111", "1", "10"] * 20)
    total, front = 0.0, [(0, 1.0)]
    for _ in range(200):
        after = []
        for q, p in front:
            ends, moves = model["states"][q]
            assert ends + sum(m[1] for m in moves.values()) == pytest.approx(1)
            assert all(sum(m[2].values()) == pytest.approx(1) for m in moves.values())
            total += p * ends
            after += [(m[0], p * m[1]) for m in moves.values()]
        merged = {}
        for q, p in after:
            merged[q] = merged.get(q, 0) + p
        front = list(merged.items())
    assert total == pytest.approx(1, abs=1e-6)
