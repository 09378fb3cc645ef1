"""Models over feature tables with MLlib: forests, comparisons, permutation importance, leave-one-out."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.operators.evaluation import auc
from pagesieve.runtime import materialize


def feature_frame(df: DataFrame, numeric: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """Numbers with nulls as 0, and a 0/1 column for each listed value of a category ('<missing>' too); columns by name."""
    columns = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numeric}
    for c, values in categories.items():
        v = F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<missing>"))
        columns |= {f"{c}={x}": (v == x).cast("double") for x in [*values, "<missing>"]}
    return df.select(*[c for c in df.columns if c not in (*numeric, *categories)], *[columns[k].alias(k) for k in sorted(columns)])


def _weighted(df: DataFrame, label: str) -> DataFrame:
    w = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = Window.partitionBy()
    w = w.select(F.col(label).alias("_l"), (F.sum("_n").over(total) / (F.count("*").over(total) * F.col("_n"))).alias("_w"))
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")


def forest(df: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 10, seed: int = 42):
    """Random forest with balanced weights; the model and (feature, importance)."""
    stages = [VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep"), RandomForestClassifier(featuresCol="_v", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed)]
    model = Pipeline(stages=stages).fit(_weighted(df, label))
    found = model.stages[-1].featureImportances.toArray()
    return model, df.sparkSession.createDataFrame([(f, round(float(x), 6)) for f, x in zip(features, found)], "feature string, importance double")


def _auc(scored: DataFrame, label: str) -> float:
    s = scored.withColumn("_s", vector_to_array("probability")[1])
    return auc(s, F.col(label) == 1, "_s").first()["roc_auc"] or 0.0


def permutation_importance(model, df: DataFrame, features: list[str], label: str, ident: str, repeats: int = 8, seed: int = 42) -> DataFrame:
    """(feature, loss, deviation): mean loss of ROC-AUC over ``repeats`` when a feature's values are dealt anew, by joins of two seeded orders in hash blocks.

    A repeat is one join; every row then stands once for each feature, with its value or that of the row it was dealt, and all areas are taken together.
    """
    order = lambda k: F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(k), ident), ident))
    blocks = df.select(ident, label, *features).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(64)))
    dealt = [blocks.withColumns({"_r": F.lit(-1), "_f": F.lit("")}).drop("_b")]
    for r in range(repeats):
        other = blocks.select("_b", order(2 * r + 1).alias("_i"), *[F.col(f).alias(f"_{f}") for f in features])
        both = blocks.withColumn("_i", order(2 * r)).join(other, ["_b", "_i"]).withColumn("_f", F.explode(F.array(*[F.lit(f) for f in features])))
        dealt.append(both.select(ident, label, *[F.when(F.col("_f") == f, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in features], F.lit(r).alias("_r"), "_f"))
    scored = model.transform(reduce(DataFrame.unionByName, dealt)).withColumn("_s", vector_to_array("probability")[1])
    areas = auc(scored, F.col(label) == 1, "_s", ["_f", "_r"]).select("_f", "_r", "roc_auc")
    base = areas.where("_r = -1").select(F.col("roc_auc").alias("_base"))
    loss = areas.where("_r >= 0").crossJoin(base).withColumn("loss", F.col("_base") - F.col("roc_auc"))  # one row beside a row a feature and repeat
    return loss.groupBy(F.col("_f").alias("feature")).agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.stddev_pop("loss"), 6).alias("deviation"))


def compare(train: DataFrame, test: DataFrame, features: list[str], label: str, seed: int = 42) -> DataFrame:
    """Logistic regression, forest and boosted trees by F1, then accuracy."""
    vector = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep")
    models = {
        "logistic": [vector, StandardScaler(inputCol="_v", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol=label, maxIter=50)],
        "forest": [vector, RandomForestClassifier(featuresCol="_v", labelCol=label, numTrees=30, maxDepth=8, seed=seed)],
        "boosted": [vector, GBTClassifier(featuresCol="_v", labelCol=label, maxIter=10, seed=seed)],
    }
    rows = []
    for name, stages in models.items():
        p = Pipeline(stages=stages).fit(train).transform(test)
        c = p.agg(*[F.sum(((F.col(label) == a) & (F.col("prediction") == b)).cast("int")).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)]).first()
        total = sum(c) or 1
        f1 = 2 * c["c11"] / max(1, 2 * c["c11"] + c["c01"] + c["c10"])
        rows.append((name, round(f1, 6), round((c["c00"] + c["c11"]) / total, 6)))
    return train.sparkSession.createDataFrame(sorted(rows, key=lambda r: (-r[1], -r[2])), "model string, f1 double, accuracy double")


def leave_one_out(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Change of ROC-AUC of a small forest without each feature. Train and test rows are written once."""
    train, test = materialize(train, "models"), materialize(test, "models")

    def of(names: list[str]) -> float:
        return _auc(forest(train, names, label, trees=10, depth=6)[0].transform(test), label)

    base = of(features)
    return train.sparkSession.createDataFrame([(f, round(base - of([g for g in features if g != f]), 6)) for f in features], "feature string, loss double")
