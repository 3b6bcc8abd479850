"""Stored activations: a Spark data source for blocks of floats of one shape [items, layers, dimensions].

A store is a folder of .npy blocks, as numpy writes them, and a manifest of their rows. ``spark.read.format("tensors")`` gives (row,
layer, vec), a partition for each range of rows; a filter on layer, or the option ``layers``, reads only those layers'
bytes. A store that doesn't hold the rows it should, or a block of another shape than its manifest says, is an error.
Files are opened by Arrow, so a path may be in any store that Arrow reads and all executors reach.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

MANIFEST = "manifest.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, dtype, place of the first number) of an open .npy file."""
    head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran:
        raise ValueError("blocks are stored row by row")
    return shape, dtype, head.tell()


class Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, stop: int, shape: tuple):
        super().__init__(path)
        self.path, self.first, self.start, self.stop, self.shape = path, first, start, stop, shape


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.rows = int(options["rows"]) if "rows" in options else None
        self.layers = {int(x) for x in options["layers"].split(",")} if options.get("layers") else None
        self.most = int(options.get("rowspertask", 65_536))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("layer",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.layers = wanted if self.layers is None else self.layers & wanted
            else:
                yield f

    def _blocks(self) -> list[tuple[str, int, tuple]]:
        store, path = _opened(self.path)
        if path.endswith(".npy"):
            with store.open_input_file(path) as f:
                return [(self.path, 0, _header(f)[0])]
        with store.open_input_file(f"{path}/{MANIFEST}") as f:
            listed = json.loads(f.read())
        return [(f"{self.path}/{b['file']}", b["first"], (b["rows"], listed["layers"], listed["dimensions"])) for b in listed["blocks"]]

    def partitions(self) -> list[Range]:
        blocks = self._blocks()
        total = sum(shape[0] for _, _, shape in blocks)
        if self.rows is not None and total != self.rows:
            raise ValueError(f"{self.path} holds {total} rows, not {self.rows}: it belongs to another set of items")
        return [Range(path, first, a, min(a + self.most, shape[0]), shape) for path, first, shape in blocks for a in range(0, shape[0], self.most)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = _opened(partition.path)
        n, layers, d = partition.shape
        with store.open_input_file(path) as f:
            shape, dtype, at = _header(f)
            if tuple(shape) != tuple(partition.shape):
                raise ValueError(f"{path} is {tuple(shape)}, its manifest says {tuple(partition.shape)}")
            wanted = sorted(x for x in (self.layers if self.layers is not None else range(layers)) if 0 <= x < layers)
            whole = len(wanted) == layers
            step = max(1, (8 << 20) // max(1, d * dtype.itemsize * (layers if whole else 1)))
            for a in range(partition.start, partition.stop, step):
                b = min(a + step, partition.stop)
                if whole:
                    f.seek(at + a * layers * d * dtype.itemsize)
                    block = np.frombuffer(f.read((b - a) * layers * d * dtype.itemsize), dtype).reshape(b - a, layers, d)
                    yield from (self._batch(block[:, x], partition.first + a, x) for x in wanted)
                    continue
                for x in wanted:
                    rows = []
                    for i in range(a, b):
                        f.seek(at + (i * layers + x) * d * dtype.itemsize)
                        rows.append(np.frombuffer(f.read(d * dtype.itemsize), dtype))
                    yield self._batch(np.stack(rows), partition.first + a, x)

    @staticmethod
    def _batch(block: np.ndarray, first: int, layer: int) -> pa.RecordBatch:
        n, d = block.shape
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(np.ascontiguousarray(block, np.float32).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(np.full(n, layer, np.int32)), vec], names=["row", "layer", "vec"])


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "row long, layer int, vec array<float>"

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)


def read(spark: SparkSession, path: str, rows: int | None = None, layers: tuple | None = None, rows_per_task: int = 65_536) -> DataFrame:
    """(row, layer, vec) of a store or of one .npy file; rows: how many items there must be."""
    spark.dataSource.register(TensorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"rowspertask": str(rows_per_task)} | ({"rows": str(rows)} if rows is not None else {}) | ({"layers": ",".join(map(str, layers))} if layers else {})
    return spark.read.format("tensors").options(**options).load(path)


def store(acts: DataFrame, path: str, dtype: str = "<f2", rows_per_block: int = 16_384, row: str = "row") -> int:
    """Write acts(row, layer, vec) to a folder; rows are 0, 1, ... without a gap, each with all layers. The rows written.

    A block is one task's; the driver sees a name and a count for each block. A gap, a missing layer or an odd width is an error.
    """
    base = path.rstrip("/")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([row, "layer"])
        first, n, layers = int(pdf[row].iloc[0]), pdf[row].nunique(), pdf["layer"].nunique()
        if len(pdf) != n * layers or int(pdf[row].iloc[-1]) != first + n - 1 or (pdf["layer"].to_numpy().reshape(n, layers) != np.arange(layers)).any():
            raise ValueError(f"rows from {first} on have a gap, or lack a layer")
        block = np.stack(pdf["vec"].to_numpy()).astype(dtype).reshape(n, layers, -1)
        store_, at = _opened(base)
        name, out = f"block-{first:012d}.npy", io.BytesIO()
        np.lib.format.write_array(out, block, allow_pickle=False)
        with store_.open_output_stream(f"{at}/{name}") as f:
            f.write(out.getvalue())
        return pd.DataFrame([(name, first, n, layers, block.shape[2])], columns=["file", "first", "rows", "layers", "dimensions"])

    system, at = _opened(base)
    system.create_dir(at, recursive=True)
    keyed = acts.select(F.col(row).cast("long").alias(row), "layer", "vec").withColumn("_b", F.floor(F.col(row) / rows_per_block))
    got = keyed.groupBy("_b").applyInPandas(write, "file string, first long, rows long, layers int, dimensions int").orderBy("first").collect()
    total = sum(r["rows"] for r in got)
    if [r["first"] for r in got] != [sum(x["rows"] for x in got[:i]) for i in range(len(got))] or len({(r["layers"], r["dimensions"]) for r in got}) > 1:
        raise ValueError("blocks have a gap between them, or are of several shapes")
    listed = {"layers": got[0]["layers"] if got else 0, "dimensions": got[0]["dimensions"] if got else 0, "blocks": [{"file": r["file"], "first": r["first"], "rows": r["rows"]} for r in got]}
    with system.open_output_stream(f"{at}/{MANIFEST}") as f:
        f.write(json.dumps(listed).encode())
    return total
