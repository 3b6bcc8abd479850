"""Readers of corpora, statement files, lookup maps and run artifacts. Schemas are given, so no file is read twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "item_id string, text string, truth boolean, cell string, edited boolean, entity string, entities array<string>, domain string, typicality struct<freq_log10:double,ref_ppl:double>, provenance struct<source:string>"
STATEMENTS = "statement string, label string"


def read_items(spark: SparkSession, path: str, schema: str = ITEMS) -> DataFrame:
    """A corpus of one JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_harvested(spark: SparkSession, path: str, schema: str = ITEMS) -> DataFrame:
    """Harvested items: edited is false where it is not stated."""
    return read_items(spark, path, schema).withColumn("edited", F.coalesce("edited", F.lit(False)))


def read_statements(spark: SparkSession, folder: str, topics: list[str]) -> DataFrame:
    """(topic, topic_idx, statement, label) of <folder>/<topic>.csv with a header, with or without a byte order mark.

    A topic without a file is an error. Rows whose label is not 0 or 1 or whose statement is empty go.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    paths = [f"{folder.rstrip('/')}/{t}.csv" for t in topics]
    absent = [p for p in paths if not hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p))]
    if absent:
        raise FileNotFoundError(", ".join(absent))
    rows = spark.read.option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).schema(STATEMENTS).csv(paths)
    topic = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    got = rows.select(topic.alias("topic"), F.array_position(F.lit(topics), topic).alias("_p"), F.trim("statement").alias("statement"), F.trim("label").alias("_l"))
    return got.where("_l in ('0', '1') and statement <> ''").select("topic", (F.col("_p") - 1).cast("int").alias("topic_idx"), "statement", F.col("_l").cast("int").alias("label"))


def read_topics(spark: SparkSession, pattern: str, whitelist: tuple = (), skip: str = "neg_") -> DataFrame:
    """(topic, statement, label) of all statement files that match pattern but those whose name begins with skip; with a
    whitelist, of its topics only. Labels other than 0 and 1 and empty statements go."""
    rows = spark.read.option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).schema(STATEMENTS).csv(pattern)
    topic = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    got = rows.select(topic.alias("topic"), F.trim("statement").alias("statement"), F.trim("label").alias("label")).where(~F.startswith("topic", F.lit(skip)))
    got = got.where(F.col("topic").isin(*whitelist)) if whitelist else got
    return got.where("label in ('0', '1') and statement <> ''").withColumn("label", F.col("label").cast("int"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML configuration, read through Spark's file systems."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}


def verified_files(spark: SparkSession, pattern: str, manifest: DataFrame) -> DataFrame:
    """manifest(name, sha256) against the files that match pattern: (name, sha256, found, status), status ok, drifted, missing or unlisted."""
    files = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.sha2("content", 256).alias("found"))
    both = manifest.join(files, F.col("name") == F.col("_name"), "full_outer")
    status = F.when(F.col("_name").isNull(), "missing").when(F.col("name").isNull(), "unlisted").when(F.lower("sha256") == F.col("found"), "ok").otherwise("drifted")
    return both.select(F.coalesce("name", "_name").alias("name"), "sha256", "found", status.alias("status"))


def field_or_raise(rows: DataFrame, path: str, out: str) -> DataFrame:
    """rows with out: the nested field at path; a row that has none is an error that names the path."""
    return rows.withColumn(out, F.coalesce(F.col(path), F.raise_error(F.lit(f"no {path}")).cast(rows.select(path).schema[0].dataType)))


def json_map(rows: DataFrame, column: str, value: str = "double", keep: tuple = ()) -> DataFrame:
    """(keep, key, value): the entries of a column of JSON maps; what is no map gives none."""
    return rows.select(*keep, F.explode(F.from_json(column, f"map<string,{value}>")).alias("key", "value"))


def read_json_map(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """(key, value) of files that hold one JSON map each, such as frequency caches and gazetteers."""
    return json_map(spark.read.text(path, wholetext=True), "value", value)


def read_artifacts(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """The JSON artifacts that match pattern with file, run_date (of ..._yyyymmdd.json) and problem: true where a file
    can't be read as one, which is a row of its own and no failure."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(pattern)
    name: Column = F.col("_metadata.file_name")
    date = F.try_to_timestamp(F.regexp_extract(name, r"_(\d{8})\.json$", 1), F.lit("yyyyMMdd")).cast("date")
    return rows.select("*", name.alias("file"), date.alias("run_date"), F.col("_broken").isNotNull().alias("problem")).drop("_broken")


def stale_tensors(acts: DataFrame, n_items: int, by: tuple = ("model", "layer")) -> DataFrame:
    """(by, n): stored activations whose number of rows is not that of the corpus."""
    return acts.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") != n_items)
