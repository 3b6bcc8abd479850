import json

import pytest
from pyspark.sql import functions as F

from probelens.sources import readers, sinks
from probelens.streaming import gates


def test_items_and_harvested(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"item_id": "a", "text": "x", "truth": true}\n\n{"item_id": "b", "truth": false, "edited": true}\n')
    got = {r["item_id"]: r["edited"] for r in readers.read_harvested(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"a": False, "b": True}


def test_statements_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes('﻿statement,label\n"A, b.",1\nC.,0\nD.,x\n,1\n'.encode())
    (tmp_path / "two.csv").write_text("statement,label\nE.,1\n")
    got = {tuple(r) for r in readers.read_statements(spark, str(tmp_path), ["two", "one"]).collect()}
    assert got == {("one", 1, "A, b.", 1), ("one", 1, "C.", 0), ("two", 0, "E.", 1)}
    with pytest.raises(FileNotFoundError):
        readers.read_statements(spark, str(tmp_path), ["one", "three"])


def test_json_map(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"a": 1, "b": None}))
    assert {tuple(r) for r in readers.read_json_map(spark, str(tmp_path / "f.json")).collect()} == {("a", 1.0), ("b", None)}


def test_broken_artifacts_are_rows(spark, tmp_path):
    (tmp_path / "run_20260101.json").write_text('{"detector": "p"}')
    (tmp_path / "bad.json").write_text("{")
    got = {r["file"]: (r["detector"], r["problem"], str(r["run_date"])) for r in readers.read_artifacts(spark, str(tmp_path / "*.json"), "detector string").collect()}
    assert got == {"run_20260101.json": ("p", False, "2026-01-01"), "bad.json": (None, True, "None")}


def test_gated_write(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    gate = spark.createDataFrame([("x", True), ("y", None)], "name string, pass boolean")
    with pytest.raises(sinks.GateError, match="y"):
        sinks.write_gated(items, gate, str(tmp_path / "c"), "me")
    with pytest.raises(sinks.GateError, match="sign-off"):
        sinks.write_gated(items, gate.where("pass"), str(tmp_path / "c"))
    path = sinks.write_gated(items, gate.where("pass"), str(tmp_path / "c"), "me")
    assert path == sinks.write_gated(items.orderBy(F.desc("id")), gate.where("pass"), str(tmp_path / "c"), "me")
    assert spark.read.json(path).count() == 2


def test_write_once_and_pending(spark, tmp_path):
    a, b = spark.range(3), spark.range(4)
    path = str(tmp_path / "r")
    assert sinks.write_once(a, path) == path == sinks.write_once(a, path)
    other = sinks.write_once(b, path)
    assert other.startswith(path + "__") and sinks.write_once(b, path) == other and spark.read.parquet(path).count() == 3
    assert [r[0] for r in sinks.pending(b, a, ("id",)).collect()] == [3]


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "m string, v double")
    assert sinks.markdown_table(df, ["m", "v"]) == "| m | v |\n|-|-|\n| a | 1.5 |\n| b | — |"


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([(f"2026-01-0{d} 10:00:00", d % 2 == 0) for d in (1, 1, 2, 5)], "ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = gates.drained(gates.window_counts(stream, "ts", ("ok",)), str(tmp_path / "out"))
    assert sorted((r["start"].day, r["n"]) for r in got.collect()) == [(1, 2), (2, 1)]  # the 5th is still open
    gate = gates.drained(gates.share_gate(stream, "ts", "ok"), str(tmp_path / "gate"))
    assert sorted((r["start"].day, r["pass"]) for r in gate.collect()) == [(1, False), (2, True)]
