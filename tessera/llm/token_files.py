"""Token ids of a corpus in files of coded blocks, and reading them back.

Writing: documents are dealt by ranges of doc_id, so file after file holds them
in ascending order; each task encodes its whole texts, appends END_ID to each,
and writes blocks as it goes. Every block is coded from a fresh state (id_coder)
and carries the CRC-32 of its ids, so a damaged block is found and hurts no
other. The file ends with a table of its documents and a trailer. A file is
written under a name of its task attempt and renamed when it is whole. The
number of files grows with the bytes of the texts.

Layout, little-endian: MAGIC; blocks (bytes u32, crc32 of the ids u32, the coded
block); 0 u32; the document table, zstandard over (doc_id i64 or MIN for null,
ids u64); trailer (bytes of the table u32, documents u64, ids u64, MAGIC).

Defined results: a null or empty text is its end id alone. Rows that repeat an
id follow each other in the order of a hash of their texts, so that an id with
very many rows is dealt over files too. A null id comes first. A very long text
goes over as many blocks as it needs. An empty table has no files and no rows.
Columns other than id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import id_coder
from .common import shared_dir, store, table, text_bytes, written
from .tokens import default_path, worker_encoder

END_ID = 0
#: Bytes of texts of a file, about.
FILE_BYTES = 256 << 20
MAGIC = b"TSRAIDS3"
_NULL_ID = -(1 << 63)
_BLOCK, _TRAILER = struct.Struct("<II"), struct.Struct("<IQQ8s")


class Writer:
    """Writes documents to an open file, blocks as soon as they are full."""

    def __init__(self, f):
        self.f, self.held, self.size = f, [], 0
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_docs = self.total = 0
        f.write(MAGIC)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents' numbers, their numbers of ids, and all ids end to end."""
        self.docs.append((doc_ids.astype("<i8"), sizes.astype("<u8")))
        self.n_docs += len(doc_ids)
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 2 * id_coder.BLOCK_IDS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        """Whole blocks, but for what is less than two of them. At the end that is
        one block, or two halves if over one and a half: a short block costs more an id."""
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        size = id_coder.BLOCK_IDS
        cuts = [size * i for i in range(max(1, len(ids) // size))]
        if last:
            rest = len(ids) - cuts[-1]
            cuts += [cuts[-1] + rest // 2, len(ids)] if 2 * rest > 3 * size else [len(ids)] if rest else []
        end = cuts[-1]
        for at, to in zip(cuts, cuts[1:], strict=False):
            part = ids[at:to]
            coded = id_coder.encode(part)
            self.f.write(_BLOCK.pack(len(coded), zlib.crc32(part.astype("<u4", copy=False))) + coded)
        self.held, self.size = [ids[end:].copy()], len(ids) - end

    def close(self) -> None:
        self.flush(True)
        self.f.write(struct.pack("<I", 0))
        columns = [np.concatenate(c).tobytes() for c in zip(*self.docs, strict=True)] if self.docs else []
        docs = zstd.compress(b"".join(columns), 3)
        self.f.write(docs)
        self.f.write(_TRAILER.pack(len(docs), self.n_docs, self.total, MAGIC))


def blocks(f, path: str) -> Iterator[np.ndarray]:
    """The ids of each block of an open file, checked."""
    f.seek(len(MAGIC))
    while size := struct.unpack("<I", f.read(4))[0]:
        (crc,) = struct.unpack("<I", f.read(4))
        try:
            ids = id_coder.decode(f.read(size))
        except Exception as e:
            raise ValueError(f"{path}: a block is damaged") from e
        if zlib.crc32(ids.astype("<u4", copy=False)) != crc:
            raise ValueError(f"{path}: a block is damaged")
        yield ids


def read_file(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, in order."""
    files, at = store(path)
    with files.open_input_file(at) as f:
        end = f.size() - _TRAILER.size
        f.seek(end)
        size, n, _, magic = _TRAILER.unpack(f.read())
        f.seek(0)
        if magic != MAGIC or f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        f.seek(end - size)
        raw = zstd.decompress(f.read(size)) if n else b""
        doc_ids, sizes = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n)
        more = blocks(f, path)
        held, pos = np.zeros(0, np.uint32), 0
        for doc_id, k in zip(doc_ids.tolist(), sizes.tolist(), strict=True):
            if len(held) - pos < k:
                parts, have = [held[pos:]], len(held) - pos
                while have < k:
                    if (part := next(more, None)) is None:
                        raise ValueError(f"{path} ends before its documents do")
                    parts.append(part)
                    have += len(part)
                held, pos = np.concatenate(parts), 0
            yield None if doc_id == _NULL_ID else doc_id, held[pos : pos + k]
            pos += k


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write docs to folder; a table (file, path, n_docs, n_ids)."""
    vocabulary = vocabulary or default_path()
    spark = docs.sparkSession
    files, to = store(folder)
    files.create_dir(to, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), text_bytes(text_col).alias("t"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), "h"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "t").select("doc_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        k = task.partitionId()
        files, to = store(folder)
        name = f"ids-{k:06d}.bin"
        tmp = f"{to}/{name}.{task.taskAttemptId()}.tmp"
        encode = worker_encoder(vocabulary)
        out = None
        for b in batches:
            if out is None and b.num_rows:
                out = Writer(files.open_output_stream(tmp))
            doc_ids = b.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            for i, ids, ends in encode.texts(b.column(1)):
                own = doc_ids[i : i + len(ends) - 1]
                out.add(own, np.diff(ends) + 1, np.insert(ids, ends[1:], np.uint32(end_id)))
        if out is None:
            return
        out.close()
        out.f.close()
        files.move(tmp, f"{to}/{name}")
        yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int64()), "path": [f"{folder}/{name}"], "n_docs": pa.array([out.n_docs], pa.int64()), "n_ids": pa.array([out.total], pa.int64())})

    return written(rows.mapInArrow(run, "file long, path string, n_docs long, n_ids long"), "ids-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files.
    Files begin where those before them end: a sum over one row a file."""
    n = max(1, manifest.count())
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in read_file(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    placed = manifest.select("path", before.alias("start"))
    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), shared_dir(spark, "token-ids")))
