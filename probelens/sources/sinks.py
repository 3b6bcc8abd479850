"""Writers: gated corpora named by content, artifacts that never overwrite others, resumed layers, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.functions.stage import shared_folder  # noqa: F401  (part of this module's interface)


class GateError(ValueError):
    """A corpus that has not passed its gates."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def content_hash(rows: DataFrame, n: int = 12) -> str:
    """Hash of the rows as a multiset: sums of row hashes, so neither order nor partitions enter and nothing is sorted."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    got = rows.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(8)]), 256).alias("h"))
    return got.first()["h"][:n]


def write_gated(items: DataFrame, gates: DataFrame, path: str, signoff: str | None = None) -> str:
    """Write items as JSON to <path>_v<hash> and the gates beside it as .report; return the corpus's path.

    gates(name, pass): refused unless every pass is true (null is not) and somebody has signed. The same content is
    written once.
    """
    failed = [r["name"] for r in gates.where(~F.coalesce(F.col("pass"), F.lit(False))).select("name").collect()]  # a row for each gate
    if failed or not signoff:
        raise GateError("gates not passed: " + ", ".join(failed or ["sign-off"]))
    spark, out = items.sparkSession, f"{path}_v{content_hash(items)}"
    if not _exists(spark, f"{out}.jsonl/_SUCCESS"):
        items.write.mode("overwrite").json(f"{out}.jsonl")
        gates.withColumn("signoff", F.lit(signoff)).coalesce(1).write.mode("overwrite").json(f"{out}.report")
    return f"{out}.jsonl"


def write_once(rows: DataFrame, path: str) -> str:
    """Write rows as Parquet to path; if other rows are there, to <path>__<hash>. The same rows are not written again."""
    spark, mine = rows.sparkSession, content_hash(rows, 8)
    for at in (path, f"{path}__{mine}"):
        if not _exists(spark, f"{at}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(at)
            return at
        if content_hash(spark.read.parquet(at), 8) == mine:
            return at
    raise FileExistsError(path)


def pending(keys: DataFrame, done: DataFrame, by: tuple = ("model", "topic", "layer")) -> DataFrame:
    """The keys that have no finished result: what a resumed sweep has left to do."""
    return keys.join(done.select(*by).distinct(), list(by), "left_anti")


def done_layers(spark: SparkSession, path: str, by: tuple = ("model", "topic", "layer")) -> DataFrame | None:
    """The keys that have results under path; None where nothing has been written."""
    return spark.read.parquet(path).select(*by).distinct() if _exists(spark, path) else None


def checkpoint_layers(results: DataFrame, path: str, by: tuple = ("model", "topic", "layer")) -> str:
    """Write results under path, a folder for each of by: those keys' earlier results are replaced, others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


def resumed(keys: DataFrame, path: str, work, by: tuple = ("model", "topic", "layer")) -> DataFrame:
    """All results of keys under path: work(keys that have none) is run and written first."""
    spark, done = keys.sparkSession, done_layers(keys.sparkSession, path, by)
    left = keys if done is None else pending(keys, done, by)
    if not left.isEmpty():
        checkpoint_layers(work(left), path, by)
    return spark.read.parquet(path)


def markdown_row(*cells: Column) -> Column:
    """A line of a Markdown table; nulls show as a dash."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("—")) for c in cells]), F.lit(" |"))


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A report's rows, in their order, as one Markdown table; for reports, whose rows fit a page."""
    head = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(head + [r[0] for r in rows.select(markdown_row(*map(F.col, columns))).collect()])
