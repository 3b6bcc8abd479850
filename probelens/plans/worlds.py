"""The driver's tables as audit inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelens.operators import cells, probes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status F or O as items; the customer's number of orders is the entity frequency."""
    orders = table(spark, sf_dir, "orders")
    items = orders.where(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") == "F").alias("truth"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("domain"), (F.month("o_orderdate") % 2 == 1).alias("edited"), F.col("o_totalprice").alias("score"))
    return cells.with_frequency(items, cells.entity_frequency(orders, "o_custkey"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.with_cells(cells.terciles(order_items(spark, sf_dir), by=("domain",)))


def vector_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as activations of 8 layers of 8 dimensions."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("label") % 2 == 1).alias("truth"), (F.col("label") < 5).alias("typical"), F.col("label").cast("string").alias("topic"), F.col("embedding").alias("vec"))
    return probes.layers(cells.with_cells(v), "vec", 8)


def statement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about parts as items with their negations; the part's number of orders is the entity frequency."""
    from probelens.functions import text
    from probelens.plans.registry import statements

    rows = statements(spark, sf_dir).where("topic is not null")
    said = text.instantiate(F.col("topic"), F.col("p_name"), F.col("p_type"))
    items = rows.select(F.col("p_partkey").alias("item_id"), (F.col("label") == 1).alias("truth"), F.col("p_partkey").alias("entity"), F.col("topic").alias("domain"), "topic", (F.col("p_partkey") % 4 == 1).alias("edited"), F.col("p_name").alias("subject"), said.alias("text"), text.negate(said).alias("negated"))
    items = cells.with_frequency(items, cells.entity_frequency(table(spark, sf_dir, "lineitem"), "l_partkey"))
    return cells.with_cells(cells.terciles(items, by=("domain",)))
