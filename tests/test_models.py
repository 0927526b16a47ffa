import pytest
from pyspark.sql import functions as F

from cohort import models as ml
from cohort import operators as op


@pytest.fixture(scope="module")
def data(spark):
    """``y`` follows ``a`` with some noise; ``b`` is noise; ``x`` is numeric and informative."""
    h = lambda salt: F.abs(F.xxhash64("id", F.lit(salt)))
    return (
        spark.range(600)
        .select("id", (h(1) % 4).alias("a"), (h(2) % 3).cast("string").alias("b"), (h(3) % 100).alias("noise"))
        .select(
            "id",
            F.concat(F.lit("v"), "a").alias("a"),
            "b",
            (F.col("a") + F.col("noise") / 200).alias("x"),
            F.when((F.col("a") >= 2) != (F.col("noise") < 5), "YES").otherwise("NO").alias("y"),
        )
        .cache()
    )


@pytest.mark.parametrize(
    "tp, fn, fp, tn, want",
    [
        (85, 76, 31, 243, [0.7540230, 0.7327586, 0.5279503, 0.8868613]),
        (130, 31, 9, 265, [0.9080460, 0.9352518, 0.8074534, 0.9671533]),
    ],
)
def test_recorded_metrics(frame, tp, fn, fp, tn, want):
    rows = [("NO", "NO", tp), ("YES", "NO", fn), ("NO", "YES", fp), ("YES", "YES", tn)]
    counted = frame(rows, "p string, t string, n int")
    each = counted.select("p", "t", F.explode(F.sequence(F.lit(1), "n")))
    for df, weight in ((each, None), (counted, "n")):
        r = ml.binary_metrics(df, "p", "t", weight=weight).first()
        assert [r["tp"], r["fn"], r["fp"], r["tn"]] == [tp, fn, fp, tn]
        got = [r["accuracy"], r["ppv"], r["sensitivity"], r["specificity"]]
        assert got == pytest.approx(want, abs=1e-7)


def test_metrics_without_positives_are_null(frame):
    r = ml.binary_metrics(frame([("YES", "YES"), (None, "NO")], "p string, t string"), "p", "t").first()
    assert r["accuracy"] == 1.0 and r["ppv"] is None and r["sensitivity"] is None and r["tn"] == 1


@pytest.mark.parametrize("name, params", [("glm", {}), ("rforest", {"ntree": 10}), ("svm", {"cost": 1.0}), ("rpart", {}), ("nnet", {"repeats": 2, "max_iter": 60})])
def test_models_beat_the_prior(data, name, params):
    train, test = op.split(data, "id", [0.8, 0.2], 300)
    fitted = ml.fit(train, "y", ["a", "b", "x"], name, 1, **params)
    scored = fitted.predict(test)
    assert scored.columns == [*data.columns, "predicted"]
    assert ml.binary_metrics(scored, "predicted", "y").first()["accuracy"] > 0.85


@pytest.mark.parametrize("name", ["glm", "rpart", "svm"])
def test_compressed_fit_predicts_alike(data, name):
    full = ml.fit(data, "y", ["a", "b"], name).predict(data, "p")
    small = ml.fit(data, "y", ["a", "b"], name, compressed=True).predict(full, "q")
    assert small.filter("p != q").count() == 0


def test_unseen_and_missing_features(data, frame):
    fitted = ml.fit(data, "y", ["a", "x"], "rpart")
    new = frame([("never seen", 3.2), (None, 0.1), ("v0", None)], "a string, x double")
    got = [r["predicted"] for r in fitted.predict(new).collect()]
    assert got[0] in ("YES", "NO") and got[1] in ("YES", "NO") and got[2] is None


def test_fill_by_model_fills_every_hole_and_touches_nothing_else(data):
    holed = data.withColumn("y", F.when(F.col("id") % 6 != 0, F.col("y"))).withColumn("truth", F.col("y"))
    out = ml.fill_by_model(holed, "y", ["a", "b"])
    assert out.count() == 600 and out.filter("y is null").count() == 0
    assert out.filter("truth is not null and truth != y").count() == 0
    assert out.join(data.select("id", F.col("y").alias("real")), "id").filter("id % 6 = 0 and y = real").count() > 80


def test_fill_by_model_replaces_the_implausible_in_type(frame):
    rows = [("m", 1.0)] * 9 + [("f", 4.0)] * 9 + [("m", 50.0), ("f", None)]
    out = ml.fill_by_model(frame(rows, "g string, d double"), "d", ["g"], bad=F.col("d") > 20)
    assert dict(op.freq(out.select(F.struct("g", "d").alias("s")), "s").collect()) == {("m", 1.0): 10, ("f", 4.0): 10}


def test_fill_by_model_with_one_or_no_class(frame):
    one = ml.fill_by_model(frame([("a", "k"), ("b", None)], "g string, t string"), "t", ["g"])
    assert one.filter("t = 'k'").count() == 2
    none = ml.fill_by_model(frame([("a", None)], "g string, t string"), "t", ["g"])
    assert none.first()["t"] is None


def test_screening_keeps_what_beats_the_prior(data):
    train, test = op.split(data, "id", [0.8, 0.2], 10)
    out = ml.screen_columns(train, test, "y", ["a", "b", "x"], models=["glm", "rpart"])
    kept = {r["column"]: r["kept"] for r in out.collect()}
    assert kept["a"] and kept["x"] and out.count() == 6


def test_forward_selection_takes_the_informative_column(data):
    train, test = op.split(data, "id", [0.8, 0.2], 10)
    log = ml.forward_select(train, test, "y", ["b"], ["a"], name="rpart").collect()
    assert [(r["column"], r["kept"]) for r in log] == [("a", True)]


def test_tuning_cross_validation_and_grid(data):
    tuned = ml.tune(data, "y", ["a", "b"], "rpart", {"depth": [1, 3]}, id_col="id")
    assert op.argmax(tuned, "accuracy", ["params"]).count() == 1 and tuned.count() == 2
    folds = ml.cross_validate(data, "id", "y", ["a"], "rpart", k=3)
    assert folds.count() == 3 and folds.agg(F.min("accuracy")).first()[0] > 0.8
    grid = ml.run_grid(data, "id", "y", ["a"], [0.5, 1], [10], ["rpart"], strata=["y"])
    assert grid.count() == 2 and set(grid.columns) >= {"share", "seed", "model", "accuracy", "ppv"}


def test_importance_analyze_and_kmeans(data, frame):
    fitted = ml.fit(data, "y", ["a", "b"], "rforest", ntree=5)
    assert ml.importance(fitted)[0][0] == "a"
    train, test = op.split(data, "id", [0.8, 0.2], 10)
    assert ml.analyze(train, test, "y", ["a"], "rpart") > 85
    points = frame([(float(v),) for v in [1, 1, 2, 50, 51, 99, 100]], "v double")
    assert ml.kmeans_1d(points, "v", 3) == pytest.approx([4 / 3, 50.5, 99.5])
