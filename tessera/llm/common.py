"""Shared helpers of the training-data operators: the shared folder, tables in
it, and a vectorised hash of whitespace-separated words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import remove, shared_dir, written  # noqa: F401  used by the operators

#: Documents are processed in slices of about this many bytes.
SLICE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> str:
    """The path for memory-mapping of a shared path that every node mounts."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"spark.checkpoint.dir must be a mounted file: folder for memory-mapped files, not {uri}")
    return uri


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a shared path, mounted or an object store, and
    the path in it."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), local_path(uri)


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, in 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of a binary
    column with about `limit` bytes; a longer row comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _piece_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a piece and where its words start; no word crosses a cut."""
    n = len(data)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[cuts] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _grown(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mixed(h), starts


def word_hashes(data: np.ndarray, offs: np.ndarray, piece: int = 2 * SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of a
    slice, and where each row's words begin (with the end). Long texts are read
    in pieces that end at white space. Memory: 16 bytes a word, and some 40 for
    each byte of a piece."""
    n = len(data)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < n:
        end = min(at + piece, n)
        while end < n:
            space = np.flatnonzero(_SPACE[data[end : end + 4096]])
            if len(space):
                end += int(space[0])
                break
            end = min(end + 4096, n)
        inside = offs[np.searchsorted(offs, at) : np.searchsorted(offs, end, side="right")] - at
        h, s = _piece_hashes(data[at:end], inside)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs)


def tree_sum(vectors: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of int64, one a row as bytes, merged in a tree."""
    rows = vectors.rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return rows.treeReduce(lambda a, b: a + b) if rows.getNumPartitions() else np.zeros(size, np.int64)


def crc32_mod(column: str, k: int):
    """crc32 of the id as text, mod k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % k
