import hashlib
from fractions import Fraction

import pytest
from conftest import bag
from pyspark.sql import functions as F

from cohort import operators as op
from cohort.operators.sample import _cuts, exact_part


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1003).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, "x").alias("h")).cache()


def ordered(seed, ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())


@pytest.mark.parametrize("fraction", [0, 0.001, 0.2, 0.5, 1])
def test_exact_size_and_same_rows(people, fraction):
    got = {r["id"] for r in op.sample_exact(people, "id", fraction, 10).collect()}
    assert got == set(ordered(10, range(1003))[: int(1003 * Fraction(str(fraction)))])
    assert got == {r["id"] for r in op.sample_exact(people.repartition(5), "id", fraction, 10).collect()}


@pytest.mark.parametrize("fetch", [0, 1, 3])
def test_cut_is_found_at_any_depth(people, fetch):
    digests = sorted(hashlib.md5(f"1|{i}".encode()).hexdigest() for i in range(1003))
    total, cuts = _cuts(people, "id", 1, lambda n: [1, 17, 500, n], fetch=fetch)
    assert total == 1003 and cuts == [digests[0], digests[16], digests[499], digests[-1]]


def test_decimal_fractions_do_not_drift():
    assert exact_part(10, 0.3) == 3 and exact_part(100, 0.29) == 29 and exact_part(7, 0.5) == 3


@pytest.mark.parametrize("strata", [["g"], ["g", "h"], []])
@pytest.mark.parametrize("rank_rows", [0, 270, 10_000])
def test_stratified_counts(people, strata, rank_rows):
    """All strata large, some large, none large: the same rows."""
    got = op.sample_stratified(people, "id", strata, 0.3, 7, rank_rows=rank_rows)
    assert bag(got) == bag(op.sample_stratified(people, "id", strata, 0.3, 7))
    if not strata:
        assert got.count() == 300
        return
    sizes = {tuple(r)[:-1]: r["count"] for r in people.groupBy(*strata).count().collect()}
    drawn = {tuple(r)[:-1]: r["count"] for r in got.groupBy(*strata).count().collect()}
    assert drawn == {k: n * 3 // 10 for k, n in sizes.items()}
    assert got.columns == people.columns and got.distinct().count() == got.count()


def test_stratified_without_broadcast(people, monkeypatch):
    want = bag(op.sample_stratified(people, "id", ["g"], 0.3, 7, rank_rows=0))
    monkeypatch.setattr("cohort.operators.sample.small_or_plain", lambda d: d)
    assert bag(op.sample_stratified(people, "id", ["g"], 0.3, 7, rank_rows=0)) == want


def test_splits_are_disjoint_and_complete(people):
    for fractions, sizes in [([0.8, 0.2], [803, 200]), ([0.6, 0.2, 0.2], [602, 200, 201])]:
        parts = op.split(people, "id", fractions, 300)
        assert [p.count() for p in parts] == sizes
        together = [r["id"] for p in parts for r in p.collect()]
        assert sorted(together) == list(range(1003))
    with pytest.raises(ValueError):
        op.split(people, "id", [0.5, 0.4], 1)


def test_bootstrap_and_folds(people):
    drawn = op.bootstrap(people, "id", 9)
    assert 800 < drawn.count() < 1200
    assert bag(drawn) == bag(op.bootstrap(people.repartition(3), "id", 9))
    left_out = 1003 - drawn.select("id").distinct().count()
    assert 300 < left_out < 440
    folds = [r["count"] for r in op.fold_id(people, "id", 5, 9).groupBy("fold").count().collect()]
    assert len(folds) == 5 and min(folds) > 140
