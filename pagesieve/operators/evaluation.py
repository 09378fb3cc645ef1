"""Scores of predictions and of their explanations."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import running_sums


def confusion(df: DataFrame, truth: str, said: str, classes: list[str]) -> DataFrame:
    """Rows by true class and column by answer; anything else is 'other'."""
    other = ~F.col(said).isin(classes) | F.col(said).isNull()
    return df.groupBy(truth).agg(*[F.sum((F.coalesce(F.col(said) == c, F.lit(False))).cast("int")).alias(f"said_{c}") for c in classes], F.sum(other.cast("int")).alias("said_other"))


def scores(df: DataFrame, truth: str, said: str, classes: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    hit = lambda a, b: F.sum((F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))).cast("int"))
    one = df.agg(*[x for c in classes for x in (hit(F.col(truth) == c, F.col(said) == c).alias(f"tp_{c}"), hit(F.col(said) == c, F.lit(True)).alias(f"p_{c}"), hit(F.col(truth) == c, F.lit(True)).alias(f"n_{c}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"tp_{c}").alias("tp"), F.col(f"p_{c}").alias("p"), F.col(f"n_{c}").alias("n")) for c in classes]))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    r = one.select(rows.alias("r")).select("r.*").withColumns({"pr": div(F.col("tp"), F.col("p")), "re": div(F.col("tp"), F.col("n"))})
    f1 = F.coalesce(2 * F.col("pr") * F.col("re") / F.nullif(F.col("pr") + F.col("re"), F.lit(0.0)), F.lit(0.0))
    return r.select("class", F.round("pr", 6).alias("precision"), F.round("re", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("n").alias("support"))


def summary(df: DataFrame, truth: str, said: str, classes: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall) and mean F1 of the classes; rows without a true class are left out, answers outside the classes are wrong."""
    known = df.where(F.col(truth).isin(classes))
    right = F.coalesce(F.col(said) == F.col(truth), F.lit(False))
    by_class = scores(known, truth, said, classes).where("support > 0").agg(F.round(F.avg("recall"), 4).alias("balanced_accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"))
    return known.agg(F.count("*").alias("rows"), F.round(F.avg(right.cast("int")), 6).alias("accuracy")).crossJoin(by_class)  # one row beside one


def opposite_if_unparsed(truth: Column, said: Column, classes: tuple[str, str]) -> Column:
    """The answer, or the wrong class where there is none."""
    a, b = classes
    return F.when(said.isin(a, b), said).when(truth == a, F.lit(b)).otherwise(F.lit(a))


def auc(df: DataFrame, positive: Column, score: str, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve by ranks with ties averaged, and average precision, of each group of ``keys``; by counts per score, so ties cost nothing."""
    keys = list(keys)
    c = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(positive.cast("int")).alias("p"), F.sum((~positive).cast("int")).alias("n"))
    c = running_sums(c, keys, "s", ["p", "n"])
    # negatives below a score, and positives and all rows from it upwards
    c = c.withColumns({"below": F.col("n_upto") - F.col("n"), "tp": F.col("p_all") - F.col("p_upto") + F.col("p")})
    c = c.withColumn("all", F.col("tp") + F.col("n_all") - F.col("below"))
    a = c.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"))
    return a.select(*keys, F.round(F.col("u") / F.nullif(F.col("np") * F.col("nn"), F.lit(0)), 6).alias("roc_auc"), F.round(F.col("ap") / F.nullif("np", F.lit(0)), 6).alias("average_precision"), F.col("np").alias("positives"), F.col("nn").alias("negatives"))


def set_scores(cited: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall, F1 and the missed and extra members of a set against another."""
    c, g = F.array_distinct(F.coalesce(cited, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(gold, F.array().cast("array<string>")))
    m = F.size(F.array_intersect(c, g))
    p, r = F.coalesce(m / F.nullif(F.size(c), F.lit(0)), F.lit(0.0)), F.coalesce(m / F.nullif(F.size(g), F.lit(0)), F.lit(0.0))
    return {"matched": m, "missed": F.size(F.array_except(g, c)), "extra": F.size(F.array_except(c, g)), "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6)}


def faithfulness(cited: Column, text: Column) -> Column:
    """Share of cited ids that the text holds: whole, with blanks for signs, or by a part of five letters or more; 1 if none is cited."""
    low = F.lower(F.coalesce(text, F.lit("")))
    anchored = lambda f: F.contains(low, F.lower(f)) | F.contains(low, F.regexp_replace(F.lower(f), "[._]", " ")) | F.exists(F.filter(F.split(F.lower(f), "[._]"), lambda p: F.length(p) >= 5), lambda p: F.contains(low, p))
    c = F.coalesce(cited, F.array().cast("array<string>"))
    return F.when(F.size(c) == 0, 1.0).otherwise(F.round(F.size(F.filter(c, anchored)) / F.size(c), 6))


def rouge_l(a: str, b: str) -> float:
    """F1 of the longest common subsequence of tokens."""
    x, y = (re.findall(r"[a-z0-9_.]+", (s or "").lower()) for s in (a, b))
    if not x or not y:
        return 0.0
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for w in y:
        if u := v & places.get(w, 0):
            v = ((v + u) | (v - u)) & full
    n = len(x) - v.bit_count()
    return 2 * n / (len(x) + len(y)) if n else 0.0


def bleu(candidate: str, reference: str, most: int = 4) -> float:
    """Geometric mean of add-one n-gram precisions with a brevity penalty."""
    import math

    c, r = (re.findall(r"[a-z0-9_.]+", (s or "").lower()) for s in (candidate, reference))
    if not c or not r:
        return 0.0
    log = 0.0
    for n in range(1, most + 1):
        gc, gr = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (c, r))
        log += math.log((sum((gc & gr).values()) + 1) / (sum(gc.values()) + 1)) / most
    return math.exp(log) * min(1.0, math.exp(1 - len(r) / len(c)))


def text_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """``rouge_l`` and ``bleu`` of two text columns."""
    import pandas as pd

    def both(x, y):
        return pd.DataFrame({"rouge_l": [round(rouge_l(p, q), 6) for p, q in zip(x, y)], "bleu": [round(bleu(p, q), 6) for p, q in zip(x, y)]})

    both.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(both, "rouge_l double, bleu double")
    return df.withColumn("_o", udf(a, b)).select(*df.columns, "_o.rouge_l", "_o.bleu")


def majority_vote(df: DataFrame, key: str, verdict: str, classes: tuple[str, str]) -> DataFrame:
    """Verdict of most completed answers; 'unknown' on a tie or without any."""
    a, b = (F.sum(F.coalesce(F.col(verdict) == c, F.lit(False)).cast("int")) for c in classes)
    v = df.groupBy(key).agg(a.alias("a"), b.alias("b"))
    return v.select(key, F.when(F.col("a") > F.col("b"), classes[0]).when(F.col("b") > F.col("a"), classes[1]).otherwise("unknown").alias("verdict"), "a", "b")


def infer_verdict(text: Column) -> Column:
    """The last verdict a text states."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"verdict\W{0,6}(phishing|benign|legitimate|safe|malicious|suspicious|uncertain)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last.isin("phishing", "malicious", "suspicious"), "phishing").when(last.isin("benign", "legitimate", "safe"), "benign").when(last == "uncertain", "uncertain")


def section_items(text: Column, header: str) -> Column:
    """Bullet items of a section of a structured answer; '- none' is none."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is){header}\s*:?\s*\n((?:\s*[-*•][^\n]*\n?)*)", 1)
    items = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]\s*", "")))
    return F.filter(items, lambda x: (x != "") & (F.lower(x) != "none"))


def without_thoughts(text: Column) -> Column:
    """Text without a model's thinking blocks."""
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?(?:</think>|$)", ""))
