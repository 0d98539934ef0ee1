import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from helpers import row_set, rows
from opslens.operators import forest, model
from opslens.plans import queries
from opslens.plans.bindings import TestTables


def test_auc_extremes(frame):
    tied = frame("y int, s double", [(0, 0.5), (1, 0.5), (0, 0.5)])
    assert rows(model.roc_auc(tied, "y", "s")) == [(0.5,)]
    perfect = frame("y int, s double", [(0, 0.1), (0, 0.2), (1, 0.3)])
    assert rows(model.roc_auc(perfect, "y", "s")) == [(1.0,)]
    assert rows(model.roc_auc(perfect.withColumn("s", -F.col("s")), "y", "s")) == [(0.0,)]
    assert rows(model.roc_auc(perfect.where("y = 0"), "y", "s")) == [(None,)]


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 40, 400) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double").repartition(6)
    pos, neg = s[y == 1], s[y == 0]
    expected = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert rows(model.roc_auc(df, "y", "s"))[0][0] == pytest.approx(expected, abs=1e-6)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="label", numBins=0)
    assert evaluator.evaluate(df.withColumn("label", F.col("y").cast("double"))) == pytest.approx(expected, abs=1e-6)


def test_roc_points(frame):
    df = frame("y int, s double", [(1, 0.9), (0, 0.6), (1, 0.6), (0, 0.1)])
    got = sorted(rows(model.roc_points(df, "y", "s")), key=lambda r: -r[2])
    assert got == [(0.0, 0.0, float("inf")), (0.0, 0.5, 0.9), (0.5, 1.0, 0.6), (1.0, 1.0, 0.1)]


def test_report(frame):
    df = frame("y int, p int", [(1, 1), (1, 0), (0, 0), (0, 0)])
    got = {r["row"]: tuple(r)[1:] for r in model.classification_report(df, "y", "p").collect()}
    assert got["1"] == (1.0, 0.5, 0.666667, 2) and got["0"] == (0.666667, 1.0, 0.8, 2)
    assert got["accuracy"] == (0.75, 0.75, 0.75, 4) and got["macro avg"][1] == 0.75
    never = {r["row"]: tuple(r)[1:] for r in model.classification_report(df.withColumn("p", F.lit(0)), "y", "p").collect()}
    assert never["1"] == (0.0, 0.0, 0.0, 2)


def test_class_weights(frame):
    df = frame("y int", [(0,)] * 6 + [(1,)] * 2)
    assert row_set(model.class_weights(df, "y")) == {(0, 6, 0.66666667), (1, 2, 2.0)}


def test_forest_learns_and_names_its_features(spark):
    base = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c"),
        ((F.col("id") * 7919) % 1000 / 1000).alias("x"),
        ((F.col("id") * 104729) % 997 / 997).alias("noise"),
    )
    df = base.withColumn("y", ((F.col("x") > 0.6) & (F.col("c") == "even")).cast("int"))
    inputs = (["c"], ["x", "noise"], "y")
    train = model.model_frame(df, *inputs)
    fitted = model.train_forest(train, *inputs, trees=20, depth=4, min_leaf=5)
    unseen = train.union(train.limit(1).withColumn("c", F.lit("new")))
    scored = model.score(fitted, unseen)
    assert scored.count() == 3001 and rows(model.roc_auc(scored, "y", "score"))[0][0] > 0.95
    found = rows(model.importances(fitted, train, top=3))
    assert {"x"} <= {r[0] for r in found} and len(found) == 3
    everything = rows(model.importances(fitted, train, top=50))
    assert sum(r[1] for r in everything) == pytest.approx(1.0)
    assert {"c_vec_even", "c_vec_odd", "x", "noise"} <= {r[0] for r in everything}


def test_nodes_are_remembered_while_they_are_few(spark, monkeypatch):
    """The rows' tree nodes are kept from level to level up to a bound, and the forest is the same either way."""
    df = spark.range(2000).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("c"), ((F.col("id") * 7919) % 1000 / 1000).alias("x"),
        ((F.col("id") * 31) % 7 > 2).cast("int").alias("y"),
    )
    inputs = (["c"], ["x"], "y")
    train, seen = model.model_frame(df, *inputs).repartition(3, "x"), []
    monkeypatch.setattr(model, "forest_pipeline", lambda *a, own=model.forest_pipeline, **k: seen.append(own(*a, **k)) or seen[-1])
    forests = []
    for most in (12 * 9 * 2000, 12 * 9 * 2000 - 1):
        monkeypatch.setattr(model, "NODE_ID_BYTES", most)
        forests.append(model.train_forest(train, *inputs, trees=9, depth=4, min_leaf=5).stages[-1].toDebugString.split("\n")[1:])
    assert [p.getStages()[-1].getCacheNodeIds() for p in seen] == [True, False]
    assert forests[0] == forests[1] and len(forests[0]) > 30


def test_registered_figures_of_the_forest(spark):
    """One fit serves all queries; report and area are those of its scores, and shares add up."""
    folder = "/root/testdata/sf0.001"
    report = {r.row: r for r in queries.m4_report(TestTables(spark, folder)).collect()}
    fitted, _, scored = queries._fitted(TestTables(spark, folder))
    pairs = [(int(r.readmitted), r.predicted, r.score) for r in scored.collect()]
    hits, called, wanted = sum(a and b for a, b, _ in pairs), sum(b for _, b, _ in pairs), sum(a for a, _, _ in pairs)
    assert report["1"].support == wanted and abs(report["1"].precision - hits / called) < 1e-5 and abs(report["1"].recall - hits / wanted) < 1e-5
    above = sum((x > y) + 0.5 * (x == y) for a, _, x in pairs if a for b, _, y in pairs if not b)
    (auc,) = rows(queries.m4_auc(TestTables(spark, folder)))[0]
    assert abs(auc - above / wanted / (len(pairs) - wanted)) < 1e-5
    shares = rows(queries.m10_shares(TestTables(spark, folder)))
    assert abs(sum(s for _, s in shares) - 1) < 1e-4 and queries._fitted(TestTables(spark, folder))[0] is fitted


# --- the forest grown by blocks of rows --------------------------------------------------------------------


@pytest.fixture(scope="module")
def visits(spark):
    """Two categories, a number of few values and two of many; both classes are as frequent, so that all weights are 1."""
    number = lambda salt, n: F.pmod(F.hash("id", F.lit(salt)), F.lit(n)).cast("double")
    y = (F.col("id") % 2).cast("double")
    df = spark.range(3000).select(
        F.concat(F.lit("c"), F.pmod(F.hash("id"), F.lit(5)).cast("string")).alias("c"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("d"),
        (number(3, 1000) / 1000 + 0.2 * y).alias("x"), F.when((F.pmod(F.hash("id"), F.lit(5)) == 1) & (y == 1), 20.0).otherwise(number(4, 9)).alias("z"), number(5, 10**5).alias("v"), y.alias("y"),
    )
    return model.model_frame(df, ["c", "d"], ["x", "z", "v"], "y").repartition(4, "x").localCheckpoint()


VISITS = (["c", "d"], ["x", "z", "v"], "y")


@pytest.mark.parametrize(("depth", "least"), [(1, 5), (7, 25), (8, 3)])
def test_grown_forest_is_that_of_spark(spark, visits, monkeypatch, depth, least):
    """Without random numbers every node, threshold and importance is the same, whatever the blocks are."""
    pipeline = model.forest_pipeline(*VISITS, trees=2, depth=depth, min_leaf=least)
    pipeline.getStages()[-1].setFeatureSubsetStrategy("all").setBootstrap(False)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 500)
    wanted = pipeline.fit(model.with_class_weights(visits, "y")).stages[-1]
    grown = forest.fit(pipeline, visits, {0.0: 1.0, 1.0: 1.0}).stages[-1]
    assert grown.toDebugString.split("\n")[1:] == wanted.toDebugString.split("\n")[1:] and grown.numFeatures == wanted.numFeatures
    assert list(grown.featureImportances.toArray()) == list(wanted.featureImportances.toArray()) and (depth == 1 or grown.totalNumNodes > 30)


def test_large_fit_is_grown_by_blocks(spark, visits, monkeypatch):
    """Beyond the limit Spark ML does not fit the forest; trees are of the same size, the fit repeats itself, and weights count."""
    params = dict(trees=60, depth=6, min_leaf=10)
    uneven = visits.where("y = 1 or v < 40000")
    by_spark = model.train_forest(uneven, *VISITS, **params)
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: fit(self, df) if not isinstance(self.getStages()[-1], RandomForestClassifier) else pytest.fail("fitted by Spark ML"))
    monkeypatch.setattr(model, "SPARK_ROW_TREES", 0)
    grown, again = (model.train_forest(uneven, *VISITS, **params) for _ in range(2))
    assert grown.stages[-1].toDebugString.split("\n")[1:] == again.stages[-1].toDebugString.split("\n")[1:]
    assert len({t.toDebugString.split("\n", 1)[1] for t in grown.stages[-1].trees}) > 50
    nodes = [np.array([t.numNodes for t in m.stages[-1].trees]) for m in (by_spark, grown)]
    assert abs(nodes[0].mean() - nodes[1].mean()) < 5 * np.sqrt(sum(n.var() for n in nodes) / 60)
    assert np.abs(by_spark.stages[-1].featureImportances.toArray() - grown.stages[-1].featureImportances.toArray()).max() < 0.05
    auc = [rows(model.roc_auc(model.score(m, uneven), "y", "score"))[0][0] for m in (by_spark, grown)]
    assert abs(auc[0] - auc[1]) < 0.02 and auc[0] > 0.7
    assert {r[0] for r in rows(model.importances(grown, uneven))} == {r[0] for r in rows(model.importances(by_spark, uneven))}


def test_scores_are_those_of_spark(spark, visits):
    """The same bits, also for unseen categories, unknown numbers and rows that come twice."""
    fitted = model.train_forest(visits, *VISITS, trees=30, depth=8, min_leaf=3)
    odd = visits.union(visits.limit(40).withColumn("c", F.lit("new"))).union(visits.limit(40).withColumn("x", F.lit(None).cast("double")))
    odd = odd.withColumn("k", F.monotonically_increasing_id()).localCheckpoint()
    wanted = {r.k: r.s for r in fitted.transform(odd).select("k", vector_to_array("probability")[1].alias("s")).collect()}
    got = model.score(fitted, odd)
    assert got.columns == [*odd.columns, "score", "predicted"] and wanted == {r.k: r.score for r in got.collect()}
    assert model.score(fitted, odd.where("false")).count() == 0


def test_bins_follow_all_values():
    """Exact counts while values are few, ranks right to a few parts in 4,096 beyond."""
    few = np.repeat([3.0, 1.0, 2.0], [5, 1, 4])
    values, weights = forest._merged([(few[:4], np.ones(4)), (few[4:], np.full(6, 2.0))])
    assert values.tolist() == [1.0, 2.0, 3.0] and weights.tolist() == [2.0, 8.0, 6.0] and forest._bins(values, weights, 32).tolist() == [1.5, 2.5]
    x = np.random.default_rng(4).normal(size=200_000)
    part = forest._merged([(x[:100_000], np.ones(100_000))])
    cuts = forest._bins(*forest._merged([part, (x[100_000:], np.ones(100_000))]), 32)
    assert len(part[0]) <= forest.VALUES and len(cuts) == 31
    assert np.abs(np.searchsorted(np.sort(x), cuts) / len(x) - np.arange(1, 32) / 32).max() < 2e-3


@pytest.mark.parametrize("column", ["y", "v"])
def test_unknown_labels_and_numbers_end_a_large_fit(spark, visits, monkeypatch, column):
    """As in Spark ML."""
    monkeypatch.setattr(model, "SPARK_ROW_TREES", 0)
    odd = visits.union(visits.limit(1).withColumn(column, F.lit(None).cast("double")))
    with pytest.raises(Exception, match="must not be null"):
        model.train_forest(odd, *VISITS, trees=2, depth=2)
