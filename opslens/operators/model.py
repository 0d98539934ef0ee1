"""Risk model on Spark ML, and its evaluation as DataFrame jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.scalar import half_up, ratio
from opslens.operators import forest
from opslens.operators.joins import join_lookup, settle
from opslens.operators.running import running_totals
from opslens.session import drop_at_end, run_path

# Model inputs. Costs and margin are left out, as they are not known at discharge.
CATEGORICAL = ["department", "admission_type", "age_group"]
NUMERIC = [
    "severity_score", "length_of_stay_days", "wait_minutes", "discharge_efficiency", "patient_age",
    "is_weekend_admission", "is_flu_season", "treatment_count",
]
#: Most bytes of the remembered tree nodes of all rows (three generations of 4 bytes for each row and tree).
NODE_ID_BYTES = 2 * 1024**3
#: Rows times trees up to which Spark ML fits the forest; beyond, it is grown by blocks of rows.
SPARK_ROW_TREES = 1 << 26


def model_frame(features: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str) -> DataFrame:
    """Inputs and target only: numbers and flags as doubles, a missing category as its own value."""
    return features.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias(c) for c in categorical],
        *[F.col(c).cast("double").alias(c) for c in numeric],
        F.col(label).cast("double").alias(label),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights per class: all rows / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("t")).scalar()
    weight = ratio(totals["rows"], totals["classes"] * F.col("n"))
    return counts.withColumn("weight", half_up(weight, 8))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    return join_lookup(df, settle(class_weights(df, label).select(label, "weight")), label)


def forest_pipeline(
    categorical: Sequence[str], numeric: Sequence[str], label: str,
    trees: int = 300, depth: int = 8, min_leaf: int = 25, seed: int = 42, cache_nodes: bool = False,
) -> Pipeline:
    """One-hot encoding (an unseen category encodes to its own slot) and a weighted random forest.

    With ``cache_nodes`` each row's node in every tree is kept from level to level instead of being found from the root
    again. The forest is the same.
    """
    indexed = [f"{c}_index" for c in categorical]
    encoded = [f"{c}_vec" for c in categorical]
    stages = []
    if categorical:
        stages = [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False, handleInvalid="keep"),
        ]
    assembler = VectorAssembler(inputCols=[*encoded, *numeric], outputCol="features", handleInvalid="keep")
    trained = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=cache_nodes,
    )
    return Pipeline(stages=[*stages, assembler, trained])


def train_forest(
    train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], label: str, trees: int = 300, **params: int
) -> PipelineModel:
    """The fitted pipeline, as saved in the checkpoint folder and loaded again: without the summary of its training, which
    holds on to the session and would travel with every task that scores.

    Spark ML fits up to ``SPARK_ROW_TREES`` rows times trees, and remembers tree nodes while that takes at most
    ``NODE_ID_BYTES``. Beyond, the forest of the same parameters is grown by blocks of rows, with other random numbers.
    """
    rows = train.count()
    cache = 12 * trees * rows <= NODE_ID_BYTES
    pipeline, fitted = forest_pipeline(categorical, numeric, label, trees=trees, cache_nodes=cache, **params), None
    if trees * rows > SPARK_ROW_TREES:
        weights = {float(r[label]): r["weight"] for r in class_weights(train, label).collect()}
        fitted = forest.fit(pipeline, train, weights) if forest.can_grow(pipeline, weights) else None
    if fitted is None:
        fitted = pipeline.fit(with_class_weights(train, label))
    path = f"{run_path(train.sparkSession)}/model-{uuid.uuid4().hex}"
    fitted.save(path)
    drop_at_end(train.sparkSession)
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add the positive-class probability ``score`` and the 0/1 ``predicted``."""
    if forest.can_score(model):
        scored = forest.scored(model, df)
    else:
        scored = model.transform(df).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def category_indices(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """The index of each category as the encoder numbers them: by falling count, then by name; (field, category, n, index)."""
    counts = None
    for name in categorical:
        value = F.coalesce(F.col(name).cast("string"), F.lit("(missing)")).alias("category")
        one = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("field"), "category", "n")
        counts = one if counts is None else counts.unionByName(one)
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "category"))
    return counts.withColumn("index", place - 1)


def threshold_counts(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows called positive at each threshold, and those of them that are positive, from one pass."""
    called = {t: F.col(score) >= t for t in thresholds}
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(c).alias("called"), F.count_if(c & (F.col(label) == 1)).alias("hits")) for t, c in called.items()])
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def importances(model: PipelineModel, sample: DataFrame, top: int | None = None) -> DataFrame:
    """Feature importances with names, highest first; all of them, or the ``top`` ones. ``sample`` may be any frame with
    the model's inputs.

    Names come from the attribute metadata of the assembled vector, which is part of the schema; the number of
    rows is the number of encoded features.
    """
    attributes = model.transform(sample).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    values = model.stages[-1].featureImportances.toArray()
    spark = sample.sparkSession
    rows = [(names[i], float(v)) for i, v in enumerate(values)]
    found = spark.createDataFrame(rows, "feature string, importance double")
    ordered = found.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


# --- evaluation -------------------------------------------------------------------------------------------


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def roc_points(df: DataFrame, label: str, score: str, digits: int = 6) -> DataFrame:
    """One (fpr, tpr, threshold) per distinct score, from the origin at an infinite threshold on."""
    spark = df.sparkSession
    ranked = running_totals(score_groups(df, label, score), F.desc("threshold"), {"tp": "pos", "fp": "neg"})
    totals = ranked.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("t")).scalar()
    points = ranked.select(
        half_up(ratio(F.col("fp"), totals["neg"]), digits).alias("fpr"),
        half_up(ratio(F.col("tp"), totals["pos"]), digits).alias("tpr"),
        F.col("threshold").cast("double"),
    )
    origin = spark.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return origin.unionByName(points)


def roc_auc(df: DataFrame, label: str, score: str, digits: int = 6) -> DataFrame:
    """Area under the ROC curve as the share of (positive, negative) pairs in order, ties counting half."""
    ranked = running_totals(score_groups(df, label, score), F.asc("threshold"), {"upto": "neg"})
    # Twice the pairs in order, in whole numbers: 2 per positive above a negative, 1 per tie.
    ordered = F.col("pos").cast("decimal(19,0)") * (2 * F.col("upto") - F.col("neg")).cast("decimal(19,0)")
    possible = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(half_up(ratio(F.sum(ordered), 2 * possible), digits).alias("auc"))


def classification_report(df: DataFrame, label: str, predicted: str, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, and accuracy, macro and weighted means.

    An undefined precision, recall or F1 is 0. The work is a count per (label, predicted); the rest runs on
    one row per class.
    """
    cells = settle(
        df.groupBy(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")).agg(
            F.count(F.lit(1)).alias("n")
        )
    )
    classes = cells.select(F.explode(F.array("label", "predicted")).alias("class")).distinct()
    actual = cells.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))).alias("hits")
    )
    called = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    known = classes.join(actual, "class", "left").join(called, "class", "left").fillna(0)
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("hits"), F.col("called")), zero)
    recall = F.coalesce(ratio(F.col("hits"), F.col("support")), zero)
    per_class = known.select("class", "support", "hits", precision.alias("precision"), recall.alias("recall"))
    f1 = F.coalesce(
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero
    )
    per_class = per_class.withColumn("f1", f1)
    scores = ["precision", "recall", "f1"]
    rows = F.sum("support")
    accuracy = ratio(F.sum("hits"), rows)
    lines = [
        per_class.select(F.col("class").cast("string").alias("row"), *scores, "support"),
        per_class.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), rows.alias("support"))
        .select(F.lit("accuracy").alias("row"), *scores, "support"),
        per_class.agg(*[F.avg(c).alias(c) for c in scores], rows.alias("support"))
        .select(F.lit("macro avg").alias("row"), *scores, "support"),
        per_class.agg(*[ratio(F.sum(F.col(c) * F.col("support")), rows).alias(c) for c in scores], rows.alias("support"))
        .select(F.lit("weighted avg").alias("row"), *scores, "support"),
    ]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out.select("row", *[half_up(F.col(c), digits).alias(c) for c in scores], "support")
