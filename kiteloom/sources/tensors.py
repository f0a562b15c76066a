"""Tensor files as a Spark data source: the header is read once, slices of the tensors by many tasks."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names of the tensor file format's number types.
NUMBERS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "|i1", "U8": "|u1"}
#: Values of a slice: a row holds so many at most, and digests are of slices of this size.
SLICE = 1 << 18


def _opened(path: str) -> tuple[Any, str]:
    """The file system and the path in it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The tensor files of a folder by name, or the one file."""
    from pyarrow import fs

    system, own = _opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name.endswith(".safetensors"))


def read_header(path: str) -> tuple[int, dict[str, Any]]:
    """Where a file's data begins, and each tensor's number type, shape and place in it: an 8-byte size, then JSON of that size."""
    system, own = _opened(path)
    with system.open_input_file(own) as file:
        size = struct.unpack("<Q", file.read(8))[0]
        header = json.loads(file.read(size))
    header.pop("__metadata__", None)
    return 8 + size, header


def as_doubles(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":  # the upper half of a 32-bit float
        return (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4").astype(float)
    if dtype not in NUMBERS:
        raise ValueError(f"a number type that isn't supported: {dtype}")
    return np.frombuffer(raw, NUMBERS[dtype]).astype(float)


def width_of(dtype: str) -> int:
    if dtype != "BF16" and dtype not in NUMBERS:
        raise ValueError(f"a number type that isn't supported: {dtype}")
    return 2 if dtype == "BF16" else np.dtype(NUMBERS[dtype]).itemsize


@dataclass
class Slices(InputPartition):
    """Some slices of one file: (tensor, type, shape, first value, number of values, place in the file)."""

    path: str
    slices: list[tuple[str, str, list[int], int, int, int]]


class TensorReader(DataSourceReader):
    def __init__(self, path: str, split: int, size: int) -> None:
        self.path, self.split, self.size = path, split, size

    def partitions(self) -> list[Slices]:
        """Slices in the order they are stored, some ``split`` bytes of them to a task; tensors without values have one of none."""
        out: list[Slices] = []
        for path in files_of(self.path):
            begin, header = read_header(path)
            held, total = [], 0
            for name, at in sorted(header.items(), key=lambda x: (x[1]["data_offsets"], x[0])):
                width, (lo, hi) = width_of(at["dtype"]), at["data_offsets"]
                count = (hi - lo) // width
                if (hi - lo) % width or count != int(np.prod(at["shape"], dtype=object)):
                    raise ValueError(f"{path}: the place of {name} doesn't hold its shape")
                for first in range(0, max(count, 1), self.size):
                    n = min(self.size, count - first)
                    held.append((name, at["dtype"], at["shape"], first, n, begin + lo + first * width))
                    total += n * width
                    if total >= self.split:
                        out.append(Slices(path, held))
                        held, total = [], 0
            if held:
                out.append(Slices(path, held))
        return out

    def read(self, partition: Slices | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        system, own = _opened(partition.path)
        with system.open_input_file(own) as file:
            for name, dtype, shape, first, n, at in partition.slices:
                raw = file.read_at(n * width_of(dtype), at) if n else b""
                if len(raw) != n * width_of(dtype):
                    raise ValueError(f"{partition.path} ends inside {name}")
                values = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(as_doubles(raw, dtype)))
                columns = [pa.array([partition.path]), pa.array([name]), pa.array([dtype]), pa.array([shape], pa.list_(pa.int64())), pa.array([first], pa.int64()), values]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "tensor", "dtype", "shape", "first", "values"])


class TensorSource(DataSource):
    """``spark.read.format("tensors")`` of a file or a folder; options ``split`` (bytes to a task) and ``slice`` (values to a row)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "file string, tensor string, dtype string, shape array<bigint>, first bigint, values array<double>"

    def reader(self, schema: Any) -> TensorReader:
        return TensorReader(self.options["path"], int(self.options.get("split", 32 << 20)), int(self.options.get("slice", SLICE)))


def read_slices(spark: SparkSession, path: str, split: int = 32 << 20, size: int = SLICE) -> DataFrame:
    """(file, tensor, dtype, shape, first, values): all values as doubles, in rows of ``size`` values, ``first`` being the place of a row's first one.

    Only headers are read on the driver. A task reads ``split`` bytes, a row at
    a time. A missing path raises ``FileNotFoundError``, a place that doesn't
    fit its shape and an unknown number type ``ValueError``.
    """
    files_of(path)
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensors").option("split", str(split)).option("slice", str(size)).load(path)


def tensor_summary(slices: DataFrame) -> DataFrame:
    """(tensor, values, finite, nonzero, norm) of each tensor, over all files that hold it."""
    x = F.col("values")
    each = slices.select(
        "tensor",
        F.size(x).cast("long").alias("n"),
        F.size(F.filter(x, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))).cast("long").alias("finite"),
        F.size(F.filter(x, lambda v: v != 0)).cast("long").alias("nonzero"),
        F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v).alias("square"),
    )
    return each.groupBy("tensor").agg(F.sum("n").alias("values"), F.sum("finite").alias("finite"), F.sum("nonzero").alias("nonzero"), F.sqrt(F.sum("square")).alias("norm"))


def slice_digests(slices: DataFrame) -> DataFrame:
    """(file, tensor, first, digest): SHA-256 of each slice's values as 32-bit floats."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.r_[0, np.cumsum(batch.column(3).value_lengths().to_numpy())]
            values = batch.column(3).flatten().to_numpy()
            digests = [hashlib.sha256(values[a:b].astype("<f4").tobytes()).hexdigest() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(digests, pa.string())], names=["file", "tensor", "first", "digest"])

    return slices.select("file", "tensor", "first", "values").mapInArrow(run, "file string, tensor string, first long, digest string")


def tree_digest(spark: SparkSession, path: str) -> str:
    """A digest of all tensors of a file by slices of 2^18 values: of each tensor's digests in order, then of the tensors by name.

    No task and not the driver sees more than a slice's values or a tensor's
    digests. The same values under the same names give the same digest, however
    they lie in the file. No tensors raise ``ValueError``.
    """
    whole = slice_digests(read_slices(spark, path))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "digest"))), lambda s: s["digest"]), "")
    tensors = whole.groupBy("tensor").agg(F.sha2(ordered, 256).alias("digest"))
    lines = F.array_sort(F.collect_list(F.concat_ws("\n", "tensor", "digest")))
    found = tensors.agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest")).first()
    if not found.n:
        raise ValueError(f"no tensors to digest: {path}")
    return found.digest


def streamed_digest(path: str, size: int = SLICE) -> str:
    """SHA-256 over all tensors of a file in the order of their names: each name, then its values as 32-bit floats, a slice at a time."""
    begin, header = read_header(path)
    if not header:
        raise ValueError(f"no tensors to digest: {path}")
    digest = hashlib.sha256()
    system, own = _opened(path)
    with system.open_input_file(own) as file:
        for name in sorted(header):
            at, width = header[name], width_of(header[name]["dtype"])
            digest.update(name.encode())
            lo, hi = at["data_offsets"]
            for place in range(lo, hi, size * width):
                raw = file.read_at(min(size * width, hi - place), begin + place)
                digest.update(as_doubles(raw, at["dtype"]).astype("<f4").tobytes())
    return digest.hexdigest()


def write_tensors(df: DataFrame, folder: str, name_col: str, values_col: str) -> None:
    """Writes rows (name, vector) as tensor files of 32-bit floats, one a task: the vectors of a name stacked in one tensor, rows by vector.

    Vectors of one name must be equally long within a task and hold no null. A
    task that runs again writes its file anew; files take their place when
    whole. Tasks hold the vectors of their partition. A task without rows, so an
    empty table, writes none.
    """
    _opened(folder)[0].create_dir(_opened(folder)[1], recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values
                if values is None or values.null_count or (name in held and len(values) != len(held[name][0])):
                    raise ValueError(f"vectors of {name} are null, hold nulls or differ in length")
                held.setdefault(name, []).append(values.to_numpy().astype("<f4"))
        if held:
            header, at = {}, 0
            for name, vectors in held.items():
                size = 4 * len(vectors) * len(vectors[0])
                header[name] = {"dtype": "F32", "shape": [len(vectors), len(vectors[0])], "data_offsets": [at, at + size]}
                at += size
            head = json.dumps(header).encode()
            system, own = _opened(folder)
            part = f"{own.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.safetensors"
            with system.open_output_stream(draft := f"{part}.{uuid.uuid4().hex}") as file:
                file.write(struct.pack("<Q", len(head)) + head)
                for vectors in held.values():
                    file.write(np.concatenate(vectors).tobytes())
            system.move(draft, part)
            yield pa.RecordBatch.from_arrays([pa.array([part])], names=["part"])

    df.select(F.col(name_col).cast("string"), F.col(values_col).cast("array<float>")).mapInArrow(run, "part string").count()
