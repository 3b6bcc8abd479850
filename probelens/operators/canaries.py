"""Canaries: what a probe must not be able to read, learnt on one part of a corpus and tried on another."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelens.functions.draws import meet, placed
from probelens.functions.stage import staged
from probelens.functions.text import count_features
from probelens.operators.assembled import logistic_probe
from probelens.operators.gates import canary, composition_canary


def split(rows: DataFrame, share: float, seed, key: str = "item_id", by: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(first floor(share n) rows of each group in seeded order, the rest)."""
    ranked = placed(rows, seed, key, by)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    both = meet(ranked, sizes, by).select(*rows.columns, (F.col("_r") <= F.floor(F.lit(share) * F.col("_n"))).alias("_first"))
    return both.where("_first").drop("_first"), both.where("not _first").drop("_first")


def _held(rows: DataFrame, label: str, seed) -> DataFrame:
    """Rows of the last fifth with the score of a logistic probe for label that has learnt from the rest."""
    named = rows.select("item_id", F.col(label).cast("boolean").alias("truth"), "vec").dropna()
    return logistic_probe(*split(named, 0.8, seed))


def edit_canary(acts: DataFrame, n_boot: int = 1000, seed=0) -> DataFrame:
    """Gate on acts(item_id, edited, vec): activations must not tell which texts were edited."""
    return canary(_held(acts, "edited", seed), "edit_canary", "truth", n_boot, seed)


def fragmentation_canary(items: DataFrame, text: str = "text", entity: str = "entity", n_boot: int = 1000, seed=0) -> DataFrame:
    """Gate on items(item_id, truth, text, entity): how a text falls into pieces must not tell truth."""
    features = F.array(*[c.cast("double") for c in count_features(F.col(text), F.col(entity)).values()])
    return canary(_held(items.withColumn("vec", features), "truth", seed), "fragmentation_canary", "truth", n_boot, seed)


def _grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words, each with a space on either side."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[cut(w, n) for n in range(low, high + 1)]))))


def text_visible(items: DataFrame, field: str, text: str = "text", threshold: float = 0.65, seed=0, key: str = "item_id") -> dict:
    """Can the value of field be told from the text? {visible, accuracy, majority}; visible None with too few rows of a value.

    Logistic regression on weighted character n-grams, learnt on seven tenths of every value's rows: its accuracy on the
    rest must be above the threshold and 0.05 above that of the commonest value.
    """
    rows = items.select(key, F.col(field).cast("string").alias("value"), _grams(F.col(text)).alias("grams")).where("value is not null")
    sizes = rows.groupBy("value").agg(F.count("*").alias("n")).collect()  # a row for each value of a categorical field
    if len(sizes) < 2 or min(r["n"] for r in sizes) < 2:
        return {"visible": None, "accuracy": None, "majority": None}
    train, rest = (staged(part, "grams") for part in split(rows, 0.7, seed, key, ("value",)))  # every stage reads them
    stages = []
    for stage in (StringIndexer(inputCol="value", outputCol="label"), CountVectorizer(inputCol="grams", outputCol="counts", minDF=2, vocabSize=20_000), IDF(inputCol="counts", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features")):
        stages.append(stage.fit(train) if hasattr(stage, "fit") else stage)
        train = stages[-1].transform(train)
    n = train.count()
    stages.append(LogisticRegression(maxIter=200, regParam=1 / max(1, n), standardization=False).fit(train))
    for stage in stages:
        rest = stage.transform(rest)
    got = rest.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]
    top = rest.groupBy("value").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("m")).first()["m"]
    return {"visible": got > max(threshold, top + 0.05), "accuracy": got, "majority": top}


def composition(items: DataFrame, fields: list[str], text: str = "text", n_boot: int = 1000, seed=0) -> DataFrame:
    """composition_canary() of fields, each tried for visibility in the text."""
    return composition_canary(items, {f: text_visible(items, f, text, seed=seed)["visible"] for f in fields}, n_boot, seed)
