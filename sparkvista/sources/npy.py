"""`.npy` files of vectors as a Spark source and sink: `spark.read.format("npy")`, after `register(spark)`.

A table is a folder of `.npy` files or one such file. Rows are `position` (from 0, over the files in the order of
their names) and `embedding`. Reading is dealt in ranges of rows: a task reads the bytes of its own range and nothing
else. Writing takes both columns; a run of consecutive positions becomes files of at most `PART` bytes, named by
their first position, so that reading them by name gives the order back. The driver sees a name and a count for each
file, and commits them by one move of a manifest; what failed tasks left isn't named there and isn't read. The
manifest says where the rows of each file are, so that no header is read again; those of other folders are read by
several threads. Options `partBytes` and `rangeBytes` set the size of files and of the ranges that tasks read.

Null vectors, vectors of another length than the rest, positions with a gap or twice, arrays that aren't of two
dimensions in row order, and files shorter or longer than their header says are a ValueError. NaN and infinity are
kept. A folder without files, or no rows, is an empty table. Files of float64 give doubles, any other number floats.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a written file, of the range of rows that one task reads, and of one batch.
PART, RANGE, BATCH = 64 << 20, 64 << 20, 4 << 20
MANIFEST = "_manifest.json"
#: Bytes that a header may have, and threads that read headers.
HEADER, THREADS = 1 << 16, 16


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.rstrip("/")


@dataclass
class NpyFile:
    """What a file's header says: its rows from `start` of the file on, `dim` numbers of type `dtype` each."""

    name: str
    start: int
    rows: int
    dim: int
    dtype: str


def _header(fs: pafs.FileSystem, name: str, size: int) -> NpyFile:
    with fs.open_input_file(name) as f:
        head = io.BytesIO(f.read(HEADER))
    try:
        version = np.lib.format.read_magic(head)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    except ValueError as e:
        raise ValueError(f"{name} is no .npy file: {e}") from e
    if len(shape) != 2 or (fortran and min(shape) > 1) or dtype.kind not in "fiu":
        raise ValueError(f"{name} holds {dtype} of shape {shape}, not rows of numbers")
    if head.tell() + shape[0] * shape[1] * dtype.itemsize != size:
        raise ValueError(f"{name} has {size} bytes, not those of {shape[0]} rows of {shape[1]} numbers")
    return NpyFile(name, head.tell(), shape[0], shape[1], dtype.str)


def files(path: str) -> list[NpyFile]:
    """The table's files, in order: those of its manifest, or all `.npy` files of a folder without one, or the one file."""
    fs, root = _at(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        chosen = [info]
    elif (manifest := _manifest(fs, root)) is not None:
        return [NpyFile(f"{root}/{p['file']}", p["start"], p["rows"], p["dim"], manifest["dtype"]) for p in manifest["files"]]
    else:
        inside = fs.get_file_info(pafs.FileSelector(root))
        chosen = sorted((i for i in inside if i.type == pafs.FileType.File and i.path.endswith(".npy")), key=lambda i: i.path)
    with ThreadPoolExecutor(THREADS) as pool:
        found = list(pool.map(lambda i: _header(fs, i.path, i.size), chosen))
    if len({(f.dim, f.dtype) for f in found if f.rows}) > 1:
        raise ValueError(f"{path} has vectors of several lengths or types: {sorted({(f.dim, f.dtype) for f in found})}")
    return found


def _manifest(fs: pafs.FileSystem, root: str) -> dict | None:
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Rows(InputPartition):
    """Rows [low, high) of a file, whose first row has the position `first`."""

    file: NpyFile
    first: int
    low: int
    high: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, double: bool, size: int) -> None:
        self.path, self.double, self.size = path, double, size

    def partitions(self) -> list[Rows]:
        parts, first = [], 0
        for f in files(self.path):
            step = max(1, self.size // max(1, f.dim * np.dtype(f.dtype).itemsize))
            parts += [Rows(f, first, k, min(k + step, f.rows)) for k in range(0, f.rows, step)]
            first += f.rows
        return parts or [Rows(NpyFile("", 0, 0, 0, "<f4"), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        f, kind = partition.file, np.dtype(partition.file.dtype)
        if partition.low == partition.high:
            return
        width, out = f.dim * kind.itemsize, np.float64 if self.double else np.float32
        step = max(1, BATCH // max(1, width))
        fs, _ = _at(self.path)
        with fs.open_input_file(f.name) as file:
            for k in range(partition.low, partition.high, step):
                n = min(step, partition.high - k)
                data = file.read_at(n * width, f.start + k * width)
                if len(data) != n * width:
                    raise ValueError(f"{f.name} ends before row {k + n} of {f.rows}")
                values = np.frombuffer(data, kind).astype(out)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * f.dim)
                at = pa.array(np.arange(partition.first + k, partition.first + k + n))
                yield pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(ends, pa.array(values))], ["position", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """A task's files, each with its first position and what the manifest says of it."""

    parts: list[tuple[int, dict]]


class NpyWriter(DataSourceArrowWriter):
    """Files of one write lie in a folder of their own; the manifest that names them is moved into place last."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, size: int) -> None:
        kinds = {f.name: f.dataType for f in schema}
        numbers = kinds.get("embedding")
        if set(kinds) != {"position", "embedding"} or not isinstance(kinds["position"], T.LongType) or not isinstance(numbers, T.ArrayType):
            raise ValueError("write position (long) and embedding (array of float or double)")
        if not isinstance(numbers.elementType, (T.FloatType, T.DoubleType)):
            raise ValueError("write position (long) and embedding (array of float or double)")
        self.path, self.overwrite, self.size, self.run = path, overwrite, size, f"data-{uuid.uuid4().hex}"
        self.kind = np.float64 if isinstance(numbers.elementType, T.DoubleType) else np.float32

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/{self.run}")
        parts, held, first, rows, dim = [], [], 0, 0, -1

        def close() -> None:
            nonlocal held, rows
            if rows:
                name = f"{self.run}/part-{first:015d}-{uuid.uuid4().hex[:8]}.npy"
                head = io.BytesIO()
                np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(self.kind).str, "fortran_order": False, "shape": (rows, dim)})
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(head.getvalue())
                    for values in held:
                        out.write(values.tobytes())
                parts.append((first, {"file": name, "start": head.tell(), "rows": rows, "dim": dim}))
            held, rows = [], 0

        for batch in iterator:
            at, vectors = batch.column("position"), batch.column("embedding")
            values = vectors.flatten()
            if at.null_count or vectors.null_count or values.null_count:
                raise ValueError("a position, a vector or a number in one is null")
            if not batch.num_rows:
                continue
            at = at.to_numpy(zero_copy_only=False)
            dims = np.unique(np.diff(vectors.offsets.to_numpy()))
            if len(dims) > 1 or dim not in (-1, dims[0]):
                raise ValueError(f"vectors have several lengths, such as {sorted({*dims.tolist(), dim} - {-1})}")
            dim = int(dims[0])
            table = values.to_numpy(zero_copy_only=False).astype(self.kind).reshape(len(at), dim)
            most = max(1, self.size // max(1, dim * table.itemsize))
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
            for low, high in zip(cuts, cuts[1:]):
                if rows and at[low] != first + rows:
                    close()
                while low < high:
                    if not rows:
                        first = int(at[low])
                    n = min(high - low, most - rows)
                    held.append(table[low : low + n])
                    rows, low = rows + n, low + n
                    if rows == most:
                        close()
        close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        fs.create_dir(root)
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p[0])
        old, dtype = _manifest(fs, root), np.dtype(self.kind).str
        if old is None and any(i.path.endswith(".npy") for i in fs.get_file_info(pafs.FileSelector(root))):
            raise ValueError(f"{self.path} has files that no manifest names: write elsewhere")
        if old and not self.overwrite and old["files"] and old["dtype"] != dtype:
            raise ValueError(f"{self.path} holds {old['dtype']}, not {dtype}")
        kept = [] if self.overwrite or old is None else old["files"]
        start = sum(p["rows"] for p in kept)
        for first, p in parts:
            if first != start:
                raise ValueError(f"positions go on at {first}, not at {start}: a row is missing, or there twice")
            start += p["rows"]
        named = [*kept, *(p for _, p in parts)]
        if len(dims := {p["dim"] for p in named}) > 1:
            raise ValueError(f"vectors have several lengths: {sorted(dims)}")
        draft = f"{root}/_draft-{self.run}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"dtype": dtype, "files": named}).encode())
        fs.move(draft, f"{root}/{MANIFEST}")
        for p in old["files"] if old and self.overwrite else ():
            fs.delete_file(f"{root}/{p['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.run}")


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        double = any(np.dtype(f.dtype) == np.float64 for f in files(self.options["path"]))
        return T.StructType([T.StructField("position", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType() if double else T.FloatType()))])

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(self.options["path"], isinstance(schema["embedding"].dataType.elementType, T.DoubleType), int(self.options.get("rangeBytes", RANGE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, overwrite, int(self.options.get("partBytes", PART)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def read_npy(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """position and embedding of a `.npy` file, a folder of them, or a table written by write_npy."""
    register(spark)
    files(path)  # the driver checks names and headers first, so that what is wrong there is a plain error
    return spark.read.format("npy").options(**options).load(path)


def write_npy(df: DataFrame, path: str, mode: str = "overwrite", **options: int) -> None:
    """Writes position and embedding; `append` goes on at the position after the last one."""
    register(df.sparkSession)
    df.select("position", "embedding").sortWithinPartitions("position").write.format("npy").mode(mode).options(**options).save(path)
