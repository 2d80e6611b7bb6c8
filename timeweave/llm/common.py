"""Shared helpers: the shared folder, text batches as byte arrays, a vectorised word tokenizer."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on. A longer document is one step of its own.
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where that is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="timeweave-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/timeweave-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: their lineage is cut there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *parts: bytes) -> None:
    """Whole files only: a repeated or speculative task writes the same content and moves it into place."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    store.move(temp, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """A memory-mapped array, whose file is closed again: a worker may map more files than it may hold open. Where the folder is not a mounted one, its file is first copied to a deleted local file."""
    store, path = filesystem(uri)
    if isinstance(store, pafs.LocalFileSystem):
        return _map(path, dtype)
    with store.open_input_stream(path) as src, tempfile.NamedTemporaryFile() as own:
        while block := src.read(8 << 20):
            own.write(block)
        own.flush()
        return _map(own.name, dtype)


def _map(path: str, dtype) -> np.ndarray:
    if not os.path.getsize(path):
        return np.empty(0, dtype)
    # numpy's own maps hold a file handle each
    with pa.memory_map(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


# ---------------------------------------------------------------- memory of workers


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which frees by itself
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow: what its task held of the worker's memory goes back to the system before and after it, as a reused worker else keeps the most that any task took."""

    def wrapped(batches: Iterator) -> Iterator:
        _give_back()
        yield from run(batches)
        _give_back()

    return wrapped


# ---------------------------------------------------------------- text as byte arrays


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls (null: empty), in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 row offsets of a string array, without copying the bytes."""
    large = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most `most` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if base not in _kept or len(_kept[base]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _kept[base] = np.cumprod(p)
    return _kept[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of each word [^\\x20\\x09-\\x0D]+, or run of bytes that are no `space`. None crosses a row's end."""
    inside = ~space[data]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed with its length. lower: A-Z count as a-z."""
    code, out, k = (_CODE_LOWER if lower else _CODE), np.empty(len(start), np.uint64), 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(end, start[k] + SLICE_BYTES, "right")))
        lo, hi = start[k], end[to - 1]
        n = int(hi - lo)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code[data[lo:hi]] * _powers(_BASE, n)[:n], out=total[1:])
        s, e = start[k:to] - lo, end[k:to] - lo
        h = (total[e] - total[s]) * _powers(_BASE_INVERSE, n)[s]
        out[k:to] = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = to
    return out


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row's bytes."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
