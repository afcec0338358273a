"""Tensor files in the safetensors format as a Spark source and sink, and checks of weight files.

``tensors`` reads the headers of a file or folder as rows, ``tensor_rows`` the values, by parts of ``PART`` bytes, so that a large
matrix is read by many tasks. ``save_vectors`` writes a table of vectors. Paths go through Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that a task reads and rows of a file that is written, unless told otherwise; bytes that a header may have.
PART, ROWS, HEADER = 64 << 20, 65_536, 100 << 20
# Number types of the format that numpy has, and prefixes that checkpoints put before the names of a backbone.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1"}
PREFIXES = ("bert.", "roberta.", "mpnet.", "model.", "0.auto_model.", "auto_model.")


class WeightFileError(ValueError):
    """A file that is no readable weight file; the message says of what kind it is."""


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def check_weight_file(path: str, min_bytes: int = 1 << 20) -> None:
    """Raises ``WeightFileError`` for a missing or unknown file, a stored pointer in place of weights, one of fewer than ``min_bytes``, and pickles."""
    fs, name = _fs(path)
    info = fs.get_file_info(name)
    if info.type != pafs.FileType.File:
        raise WeightFileError(f"{path} is no file")
    with fs.open_input_file(name) as f:
        start = f.read(200)
    if info.size < max(min_bytes, 200) and b"git-lfs.github.com" in start:
        raise WeightFileError(f"{path} is a Git LFS pointer, not the weights themselves; download it again")
    if info.size < min_bytes:
        raise WeightFileError(f"{path} is too small ({info.size} bytes); it may be cut off or an error page")
    kind = name.lower().rsplit(".", 1)[-1]
    if kind in ("bin", "pth", "pt"):
        old = "the legacy pickle format" if start[:1] == b"\x80" else "a pickle"
        raise WeightFileError(f"{path} is in {old}; convert it to safetensors first")
    if kind != "safetensors":
        raise WeightFileError(f"{path} has an unknown format; expected .safetensors, .bin, .pth or .pt")


def header(f: pa.NativeFile, size: int, path: str) -> list[tuple[str, str, list[int], int, int]]:
    """(name, type, shape, start, end) of each tensor in the order of their bytes, places from the file's beginning."""
    n = int.from_bytes(f.read_at(8, 0), "little") if size >= 8 else -1
    if not 0 <= n <= min(size - 8, HEADER):
        raise WeightFileError(f"{path} has no header of its size ({n} of {size} bytes)")
    try:
        entries = json.loads(f.read_at(n, 8))
        out = [(k, v["dtype"], [int(s) for s in v["shape"]], 8 + n + v["data_offsets"][0], 8 + n + v["data_offsets"][1]) for k, v in entries.items() if k != "__metadata__"]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise WeightFileError(f"{path} has a header that can't be read: {e}") from e
    for name, kind, shape, start, end in out:
        if end > size or start > end or start < 8 + n:
            raise WeightFileError(f"{path} is short: tensor {name} ends at {end} of {size} bytes")
        if kind in TYPES and end - start != np.dtype(TYPES[kind]).itemsize * int(np.prod(shape, dtype=np.int64)):
            raise WeightFileError(f"{path}: tensor {name} has not the bytes of its shape")
    return sorted(out, key=lambda t: (t[3], t[0]))


@dataclass
class _Part(InputPartition):
    path: str
    size: int
    part: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, values: bool):
        self.path, self.values, self.least = options["path"], values, int(options.get("minBytes", 0))
        self.part = int(options.get("partBytes", PART))

    def partitions(self) -> list[_Part]:
        fs, name = _fs(self.path)
        info = fs.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise WeightFileError(f"{self.path} is no file")
        many = info.type == pafs.FileType.Directory
        files = sorted((i.path, i.size) for i in fs.get_file_info(pafs.FileSelector(name)) if i.type == pafs.FileType.File and i.base_name[:1] not in "._") if many else [(info.path, info.size)]
        # Arrow's paths have no scheme; the given one goes before them again.
        front = self.path[: len(self.path) - len(name)] if self.path.rstrip("/").endswith(name.rstrip("/")) else ""
        return [_Part(front + p, s, i) for p, s in files for i in range(max(1, -(-s // self.part)) if self.values else 1)]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        check_weight_file(partition.path, self.least)
        fs, name = _fs(partition.path)
        with fs.open_input_file(name) as f:
            tensors = header(f, partition.size, partition.path)
            if not self.values:
                columns = [[partition.path] * len(tensors), *map(list, zip(*tensors, strict=True))] if tensors else [[]] * 6
                types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "name", "dtype", "shape", "start", "end"])
                return
            low, high = partition.part * self.part, (partition.part + 1) * self.part
            for tensor, kind, shape, start, end in tensors:
                if kind not in TYPES:
                    raise WeightFileError(f"{partition.path}: values of type {kind} are not read")
                if end == start:
                    continue
                dtype = np.dtype(TYPES[kind])
                width = int(np.prod(shape[1:], dtype=np.int64))
                step = width * dtype.itemsize
                # Rows that begin in this task's bytes.
                row, last = (max(0, -(-(at - start) // step)) for at in (low, high))
                last = min(last, (end - start) // step)
                while row < last:
                    few = min(last - row, max(1, (4 << 20) // step))
                    x = np.frombuffer(f.read_at(few * step, start + row * step), dtype).astype(np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(few + 1, dtype=np.int32) * width), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * few), pa.array([tensor] * few), pa.array(np.arange(row, row + few)), lists], ["file", "name", "row", "value"])
                    row += few


@dataclass
class _Files(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    """Files of ``rows`` rows, under names of their own below ``_temporary`` until the job is done, so that a task may be run again."""

    def __init__(self, path: str, overwrite: bool, rows: int):
        self.path, self.overwrite, self.rows = path.rstrip("/"), overwrite, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        fs, folder = _fs(self.path)
        fs.create_dir(f"{folder}/_temporary", recursive=True)
        made, waiting, n = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids, vectors = table.column("id").combine_chunks(), table.column("vector").combine_chunks()
            wide = pa.types.is_float64(vectors.type.value_type)
            x = vectors.flatten().to_numpy(zero_copy_only=False)
            if ids.null_count or vectors.null_count or len(x) % max(table.num_rows, 1) or len(set(np.diff(vectors.offsets.to_numpy()))) > 1 or np.isnan(x).any():
                raise WeightFileError("ids and vectors may not be null, and vectors have one length")
            parts = {"ids": ids.to_numpy().astype("<i8"), "vectors": x.astype("<f8" if wide else "<f4").reshape(table.num_rows, -1)}
            head, at = {}, 0
            for name, values in parts.items():
                head[name] = {"dtype": {"i": "I64", "f": "F64" if wide else "F32"}[values.dtype.kind], "shape": list(values.shape), "data_offsets": [at, at + values.nbytes]}
                at += values.nbytes
            text = json.dumps(head).encode()
            text += b" " * (-len(text) % 8)
            made.append(f"{folder}/_temporary/{uuid.uuid4().hex}.safetensors")
            with fs.open_output_stream(made[-1]) as f:
                for piece in (len(text).to_bytes(8, "little"), text, *(np.ascontiguousarray(v).tobytes() for v in parts.values())):
                    f.write(piece)
            waiting.clear()

        for batch in iterator:
            while n + batch.num_rows >= self.rows:
                waiting.append(batch.slice(0, self.rows - n))
                batch, n = batch.slice(self.rows - n), 0
                flush()
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
        if waiting:
            flush()
        return _Files(made)

    def commit(self, messages: list[_Files | None]) -> None:
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        new = [p for m in messages if m for p in m.paths]
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(folder)):
                if old.type == pafs.FileType.File and old.extension == "safetensors":
                    fs.delete_file(old.path)
        for path in new:
            fs.move(path, f"{folder}/{path.rsplit('/', 1)[-1]}")

    def abort(self, messages: list[_Files | None]) -> None:
        fs, _ = _fs(self.path)
        for path in (p for m in messages if m for p in m.paths):
            fs.delete_file(path)


class TensorHeaders(DataSource):
    """Format ``tensor_headers``: a row for each tensor."""

    values = False

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return "file string, name string, dtype string, shape array<long>, start long, end long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self.values)


class TensorRows(TensorHeaders):
    """Format ``tensor_rows``: a row for each row of each tensor; writing takes (id, vector)."""

    values = True

    @classmethod
    def name(cls) -> str:
        return "tensor_rows"

    def schema(self) -> str:
        return "file string, name string, row long, value array<double>"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, int(self.options.get("fileRows", ROWS)))


def tensors(spark: SparkSession, path: str, min_bytes: int = 0) -> DataFrame:
    """(file, name, dtype, shape, start, end) of the tensors of a .safetensors file or a folder of them; other files raise ``WeightFileError`` when read."""
    spark.dataSource.register(TensorHeaders)
    return spark.read.format("tensor_headers").option("minBytes", min_bytes).load(path)


def tensor_rows(spark: SparkSession, path: str, part_bytes: int = PART) -> DataFrame:
    """(file, name, row, value): the rows of all tensors as doubles, a task for each ``part_bytes`` of a file; those of no dimension and of one have values of one number."""
    spark.dataSource.register(TensorRows)
    return spark.read.format("tensor_rows").option("partBytes", part_bytes).load(path)


def save_vectors(df: DataFrame, path: str, id_col: str = "doc_id", vector: str = "embedding", overwrite: bool = False, file_rows: int = ROWS) -> None:
    """Vectors of one length as files with the tensors ``ids`` and ``vectors``, floats or doubles as they are. Nulls raise."""
    df.sparkSession.dataSource.register(TensorRows)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows.write.format("tensor_rows").option("fileRows", file_rows).mode("overwrite" if overwrite else "append").save(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, embedding) of ``save_vectors``; ids meet their vectors by file and row."""
    rows = tensor_rows(spark, path)
    ids = rows.where("name = 'ids'").select("file", "row", F.col("value")[0].cast("long").alias("doc_id"))
    return ids.join(rows.where("name = 'vectors'").select("file", "row", F.col("value").alias("embedding")), ["file", "row"]).select("doc_id", "embedding")


def parameter_name(name):
    """A column of a checkpoint's names without the prefixes of a backbone, and with today's names of a norm's parameters."""
    out = F.col(name) if isinstance(name, str) else name
    for prefix in PREFIXES:
        out = F.when(F.startswith(out, F.lit(prefix)), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    return F.replace(F.replace(out, F.lit("LayerNorm.gamma"), F.lit("LayerNorm.weight")), F.lit("LayerNorm.beta"), F.lit("LayerNorm.bias"))


def match_parameters(found: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """(name, status): ``loaded``, ``missing`` or ``extra``, of tensors (name, ...) against the model's (name); ``strict`` raises where one is missing."""
    a = found.select(parameter_name("name").alias("name"), F.lit(True).alias("found")).distinct()
    b = expected.select("name", F.lit(True).alias("wanted")).distinct()
    status = F.when(F.col("found") & F.col("wanted"), "loaded").when(F.col("wanted"), "missing").otherwise("extra")
    out = a.join(b, "name", "full").select("name", status.alias("status"))
    if strict and (n := out.where("status = 'missing'").count()):
        raise WeightFileError(f"{n} expected parameters are missing")
    return out
