"""Sources and sinks: Parquet cells, stacks of .npy files, Zarr directories (versions 2 and 3), stored targets. HDF5 and TileDB need their own libraries."""

from __future__ import annotations

import io
import itertools
import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cellgrid.core import Array, active, from_cells
from cellgrid.operators.blocks import block_frame, fill, normalize_chunks, rechunk, schema_of, spread, starts_of


def _fs(path: str):
    spark = active()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(path: str, text: str) -> None:
    fs, where = _fs(path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(path: str) -> str:
    fs, where = _fs(path)  # Spark's readers skip names that start with '_' or '.'
    stream = fs.open(where)
    try:
        return active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# -- Parquet cells -------------------------------------------------------------------------------------------------------------------------------------------
def to_parquet(x: Array, path: str, mode: str = "errorifexists") -> None:
    """Cells sorted by position within files, so that a slice of a later reading skips row groups; shape and dtype beside them."""
    x = x.compute_chunk_sizes()
    cells = x.cells()
    if x.ndim:
        cells = cells.repartitionByRange("i0").sortWithinPartitions(*[f"i{k}" for k in range(x.ndim)])
    cells.write.mode(mode).parquet(path)
    write_text(f"{path}/_array.json", json.dumps({"shape": x.shape_or_none, "dtype": x.dtype.str}))


def from_parquet(path: str) -> Array:
    meta = json.loads(read_text(f"{path}/_array.json"))
    return from_cells(active().read.parquet(path), meta["shape"], np.dtype(meta["dtype"]))


def store(sources, targets, lock=True, regions=None, compute: bool = True, return_stored: bool = False):
    """Writes arrays to Parquet paths, or into local NumPy-like targets through the driver, block by block."""
    sources = [sources] if isinstance(sources, Array) else list(sources)
    targets = [targets] if isinstance(targets, str) or not isinstance(targets, (list, tuple)) else list(targets)
    regions = [regions] * len(sources) if not isinstance(regions, list) else regions
    for x, target, region in zip(sources, targets, regions, strict=True):
        if isinstance(target, str):
            to_parquet(x, target, "overwrite")
            continue
        for slices in block_slices(x.chunks):
            at = tuple(slices)
            place = at if region is None else tuple(slice((r.start or 0) + s.start, (r.start or 0) + s.stop) for r, s in zip(region if isinstance(region, tuple) else (region,), at, strict=True))
            target[place] = x[at].compute()
    if return_stored:
        out = tuple(from_parquet(t) if isinstance(t, str) else x for x, t in zip(sources, targets, strict=True))
        return out[0] if len(out) == 1 else out
    return None


def block_slices(chunks):
    starts = starts_of(chunks)
    return (tuple(slice(s[b], s[b] + c[b]) for s, c, b in zip(starts, chunks, at, strict=True)) for at in itertools.product(*[range(len(c)) for c in chunks]))


# -- stacks of .npy files --------------------------------------------------------------------------------------------------------------------------------------
def to_npy_stack(dirname: str, x: Array, axis: int = 0) -> None:
    """One .npy file for each block along an axis, written by the tasks, and a description as JSON."""
    sizes = tuple(c if k == axis else (sum(c),) for k, c in enumerate(x.chunks))
    origins, dtype, ndim = starts_of(sizes), x.dtype, x.ndim

    def kernel(key, table):
        block = [k.as_py() for k in key]
        data = fill(table, [f"i{k}" for k in range(ndim)], [o[b] for o, b in zip(origins, block, strict=True)], tuple(c[b] for c, b in zip(sizes, block, strict=True)), dtype)
        buffer = io.BytesIO()
        np.save(buffer, data)
        return pa.table({"name": [f"{block[axis]}.npy"], "content": pa.array([buffer.getvalue()], pa.binary())})

    files = block_frame(x, sizes).groupBy(*[f"b{k}" for k in range(ndim)]).applyInArrow(kernel, "name string, content binary")
    write_files(files, dirname)
    write_text(f"{dirname}/info.json", json.dumps({"chunks": sizes, "dtype": dtype.str, "axis": axis}))


def write_files(files, dirname: str) -> None:
    """Each row (name, content) becomes a file of the folder. Local folders are written by the tasks; other stores through the driver's file system, row by row."""
    import os

    local = dirname.startswith("file:") or "://" not in dirname
    if local and active().sparkContext.master.startswith("local"):
        base = dirname.removeprefix("file://")
        os.makedirs(base, exist_ok=True)

        def save(batches):
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    path = os.path.join(base, name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path + ".part", "wb") as f:
                        f.write(content)
                    os.replace(path + ".part", path)
                yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

        files.mapInArrow(save, "name string").count()
        return
    for row in files.toLocalIterator():
        fs, where = _fs(f"{dirname}/{row['name']}")
        out = fs.create(where, True)
        out.write(bytearray(row["content"]))
        out.close()


def from_npy_stack(dirname: str, mmap_mode: str = "r") -> Array:
    info = json.loads(read_text(f"{dirname}/info.json"))
    sizes, axis, dtype = tuple(map(tuple, info["chunks"])), info["axis"], np.dtype(info["dtype"])
    starts = starts_of(sizes)[axis]
    return _from_files(f"{dirname}/*.npy", sizes, dtype, lambda path, data: (np.load(io.BytesIO(data)), [starts[int(path.rsplit('/', 1)[1][:-4])] if k == axis else 0 for k in range(len(sizes))]))


def _from_files(pattern: str, sizes: tuple, dtype: np.dtype, read) -> Array:
    files = active().read.format("binaryFile").load(pattern).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, start = read(path, content)
                yield from spread(block, start, dtype).to_batches(max_chunksize=1 << 16)

    return from_cells(files.mapInArrow(run, schema_of(len(sizes), dtype)), [sum(c) for c in sizes], dtype, sizes)


# -- Zarr, versions 2 and 3 ------------------------------------------------------------------------------------------------------------------------------------
def _codec(config) -> tuple:
    """Encoder and decoder of a compressor {id, level}; None compresses nothing."""
    if config is None:
        return (lambda b: b), (lambda b: b)
    level = config.get("level")
    if config["id"] in ("zlib", "gzip"):

        def deflate(data: bytes) -> bytes:
            made = zlib.compressobj(1 if level is None else level, zlib.DEFLATED, 31 if config["id"] == "gzip" else 15)
            return made.compress(data) + made.flush()

        return deflate, (lambda b: zlib.decompress(b, 47))
    if config["id"] == "zstd":
        import zstandard

        return (lambda b: zstandard.ZstdCompressor(level=3 if level is None else level).compress(b)), (lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b))
    raise NotImplementedError(f"compressor {config['id']}")


@dataclass(frozen=True)
class _Layout:
    """What either version's metadata say of an array and of its chunk files."""

    shape: tuple
    side: tuple
    dtype: np.dtype
    fill: object
    order: tuple
    codecs: list
    prefix: str
    separator: str

    @property
    def pattern(self) -> str:
        """Glob of the chunk files below the array's folder."""
        lead = f"c{self.separator}" if self.prefix else ""
        return lead + ("/".join(["[0-9]*"] * len(self.shape)) if self.separator == "/" else "[0-9]*")

    def start(self, path: str) -> list[int]:
        """First position of the chunk in a file."""
        depth = len(self.shape) if self.separator == "/" else 1
        numbers = "/".join(path.rsplit("/", depth)[1:]).removeprefix(f"c{self.separator}" if self.prefix else "")
        return [int(b) * c for b, c in zip(numbers.split(self.separator), self.side, strict=True)]

    def block(self, data: bytes) -> np.ndarray:
        for config in reversed(self.codecs):
            data = _codec(config)[1](data)
        stored = np.frombuffer(data, self.dtype).reshape([self.side[k] for k in self.order])
        return stored.transpose(np.argsort(self.order))


def _fill_value(value, dtype: np.dtype):
    if isinstance(value, (list, tuple)):
        return complex(*[float(str(v).replace("Infinity", "inf")) for v in value])
    if isinstance(value, str):
        return float(value.replace("Infinity", "inf"))
    return dtype.type(0 if value is None else value).item()


def _layout(url: str) -> _Layout:
    fs, _ = _fs(url)
    if fs.exists(_fs(f"{url}/zarr.json")[1]):
        meta = json.loads(read_text(f"{url}/zarr.json"))
        if meta["zarr_format"] != 3 or meta["node_type"] != "array" or meta["chunk_grid"]["name"] != "regular" or meta.get("storage_transformers"):
            raise NotImplementedError("a Zarr array of version 3 on a regular grid")
        dtype, ndim = np.dtype(meta["data_type"]), len(meta["shape"])
        order, codecs = tuple(range(ndim)), []
        for codec in meta["codecs"]:
            name, settings = codec["name"], codec.get("configuration", {})
            if name == "transpose":
                order = tuple(order[k] for k in settings["order"])
            elif name == "bytes":
                dtype = dtype.newbyteorder(">" if settings.get("endian") == "big" else "<")
            else:
                codecs.append({"id": name, **settings})
        keys = meta.get("chunk_key_encoding", {"name": "default"})
        default = keys["name"] == "default"
        separator = keys.get("configuration", {}).get("separator", "/" if default else ".")
        layout = _Layout(tuple(meta["shape"]), tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), dtype, _fill_value(meta["fill_value"], dtype), order, codecs, "c" if default else "", separator)
    else:
        meta = json.loads(read_text(f"{url}/.zarray"))
        if meta["zarr_format"] != 2 or meta.get("filters"):
            raise NotImplementedError("Zarr version 2 with filters")
        dtype, ndim = np.dtype(meta["dtype"]), len(meta["shape"])
        order = tuple(range(ndim)) if meta.get("order", "C") == "C" else tuple(range(ndim))[::-1]
        codecs = [meta["compressor"]] if meta["compressor"] else []
        layout = _Layout(tuple(meta["shape"]), tuple(meta["chunks"]), dtype, _fill_value(meta["fill_value"], dtype), order, codecs, "", meta.get("dimension_separator", "."))
    for config in layout.codecs:
        _codec(config)
    return layout


def to_zarr(x: Array, url: str, component: str | None = None, compressor=("zstd", 3), overwrite: bool = False, zarr_format: int = 2, **kwargs) -> None:
    """A Zarr directory (version 2 or 3) with equal chunks; chunks at the end are filled up."""
    url = url if component is None else f"{url}/{component}"
    if any(len(set(c[:-1])) > 1 or c[-1] > c[0] for c in x.chunks):
        raise ValueError("Zarr needs equal chunks; call rechunk")
    if zarr_format not in (2, 3):
        raise ValueError(f"Zarr version {zarr_format}")
    if zarr_format == 3 and compressor and compressor[0] == "zlib":
        compressor = ("gzip", compressor[1])
    side = tuple(max(1, c[0]) for c in x.chunks)
    config = {"id": compressor[0], "level": compressor[1]} if compressor else None
    encode, _ = _codec(config)
    sizes, origins, dtype, ndim = x.chunks, starts_of(x.chunks), x.dtype, x.ndim
    lead, separator = ("c/", "/") if zarr_format == 3 else ("", ".")

    def kernel(key, table):
        block = [k.as_py() for k in key]
        data = fill(table, [f"i{k}" for k in range(ndim)], [o[b] for o, b in zip(origins, block, strict=True)], side, dtype)
        return pa.table({"name": [lead + separator.join(map(str, block))], "content": pa.array([encode(data.tobytes())], pa.binary())})

    write_files(block_frame(x, sizes).groupBy(*[f"b{k}" for k in range(ndim)]).applyInArrow(kernel, "name string, content binary"), url)
    if zarr_format == 2:
        write_text(f"{url}/.zarray", json.dumps({"zarr_format": 2, "shape": x.shape_or_none, "chunks": side, "dtype": dtype.str, "compressor": config, "fill_value": 0, "order": "C", "filters": None}))
        return
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if config:
        codecs.append({"name": config["id"], "configuration": {"level": config["level"], **({"checksum": False} if config["id"] == "zstd" else {})}})
    fill_value = False if dtype.kind == "b" else [0.0, 0.0] if dtype.kind == "c" else 0
    grid = {"name": "regular", "configuration": {"chunk_shape": side}}
    keys = {"name": "default", "configuration": {"separator": "/"}}
    write_text(f"{url}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "array", "shape": x.shape_or_none, "data_type": dtype.name, "chunk_grid": grid, "chunk_key_encoding": keys, "fill_value": fill_value, "codecs": codecs, "attributes": {}}))


def from_zarr(url: str, component: str | None = None, chunks=None, **kwargs) -> Array:
    """A Zarr array of version 2 (no filters) or 3 (no sharding). Chunk files become tasks; chunks that are not there hold the fill value."""
    from cellgrid.sources.creation import full

    url = url if component is None else f"{url}/{component}"
    layout = _layout(url)
    shape, native = layout.shape, layout.dtype.newbyteorder("=")

    def read(path: str, data: bytes):
        start = layout.start(path)
        return layout.block(data)[tuple(slice(0, n - s) for n, s in zip(shape, start, strict=True))].astype(native), start

    sizes = normalize_chunks(layout.side, shape)
    fs, where = _fs(f"{url}/{layout.pattern}")
    there = len(fs.globStatus(where) or [])
    out = _from_files(f"{url}/{layout.pattern}", sizes, native, read) if there else full(shape, layout.fill, native)
    if 0 < there < math.prod(map(len, sizes)):
        base = full(shape, layout.fill, native).cells()
        keys = [f"i{k}" for k in range(len(shape))]
        joined = base.withColumnRenamed("v", "w").join(out.cells(), keys, "left").select(*keys, F.coalesce("v", "w").alias("v"))
        out = from_cells(joined, shape, native, sizes)
    return rechunk(out, chunks) if chunks is not None else out


def _needs(name: str):
    def missing(*args, **kwargs):
        try:
            __import__(name)
        except ImportError as e:
            raise ImportError(f"this needs the package {name}") from e
        raise NotImplementedError(f"no {name} support without the package at hand")

    return missing


from_tiledb, to_tiledb = _needs("tiledb"), _needs("tiledb")


def to_hdf5(filename: str, *args, chunks=True, **kwargs) -> None:
    """Datasets of one local HDF5 file, a block at a time."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("this needs the package h5py") from e
    data = {args[0]: args[1]} if len(args) == 2 else dict(args[0])
    with h5py.File(filename, "a") as f:
        for name, x in data.items():
            store(x, f.require_dataset(name, shape=x.shape_or_none, dtype=x.dtype, **kwargs))


# -- from functions --------------------------------------------------------------------------------------------------------------------------------------------
def from_map(func, values, chunks=None, dtype=None, **kwargs) -> Array:
    """One block for each cell of a grid of Python objects: func(value). chunks: the blocks' sizes along each axis (by default one cell a block)."""
    values = np.asarray(values, object)
    dtype = np.dtype(dtype or float)
    first = np.asarray(func(values.flat[0], **kwargs)) if chunks is None else None
    sizes = tuple(map(tuple, chunks)) if chunks is not None else tuple((n,) * m for n, m in zip(first.shape, (*values.shape, *[1] * first.ndim), strict=False))
    import pickle

    rows = [(at, pickle.dumps(v)) for at, v in np.ndenumerate(values)]
    origins = starts_of(sizes)
    df = active().createDataFrame([(list(map(int, at)) + [0] * (len(sizes) - len(at)), data) for at, data in rows], "at array<int>, value binary").repartition(max(1, min(len(rows), 200)))

    def run(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from spread(np.asarray(func(pickle.loads(data), **kwargs)), [o[b] for o, b in zip(origins, at, strict=True)], dtype).to_batches(max_chunksize=1 << 16)

    return from_cells(df.mapInArrow(run, schema_of(len(sizes), dtype)), [sum(c) for c in sizes], dtype, sizes)


def from_delayed(value, shape, dtype=None, meta=None, name=None) -> Array:
    """One block from a function without arguments, called by the task that needs it."""
    call = value if callable(value) else (lambda: value)
    return from_map(lambda _: call(), [0] if len(shape) == 1 else np.zeros((1,) * len(shape), object), chunks=tuple((n,) for n in shape), dtype=dtype or (meta.dtype if meta is not None else float))


def from_graph(df, shape, dtype=None) -> Array:
    """An array over a persisted frame of cells."""
    return from_cells(df, shape, dtype)


def to_delayed(x: Array) -> np.ndarray:
    """An object array with, for each block, the lazy array of its cells."""
    out = np.empty(x.numblocks, object)
    for at, slices in zip(np.ndindex(*x.numblocks), block_slices(x.chunks), strict=True):
        out[at] = x[slices]
    return out
