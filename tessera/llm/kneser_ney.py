"""Interpolated modified Kneser-Ney model over words, counted in Spark, stored as
sorted hash arrays and memory-mapped by the workers that score.

Counting (order 3): each task hashes the tokens of its texts, numbers the distinct
words of a run of RUN_TOKENS and counts its triples (u, v, w); a run leaves as one
compressed blob with its own dictionary for each shard, so a frequent triple is
one entry a run. Shards go by the middle word v, so both levels meet there:
triples with their contexts (u, v), and pairs (v, w) with the number of distinct u
before them. The words that a sample finds so frequent that their triples would
overfill a shard are dealt by (u, v) instead, and their pairs meet in one more
step, as many as there are words at most; the sample decides where rows go, never
what is counted. Each word's number of distinct v goes on to the shard of the
word. The number of shards grows with the text; what the driver collects is a few
sums a shard and the frequent words. Beyond ONE_LEVEL shards runs go to the root of
their number of groups first, where many runs are merged before they are dealt to
shards, so that blobs don't grow with the square of the text. A task that runs again writes the same
files: each is renamed into place whole.

    P(w|uv) = max(c(uvw) - D(c), 0) / c(uv) + (D1 n1 + D2 n2 + D3 n3)(uv) / c(uv) * P(w|v)
    P(w|v)  = max(k(vw) - D'(k), 0) / K(v) + (D1' m1 + D2' m2 + D3' m3)(v) / K(v) * P(w)
    P(w)    = max(k(w) - D''(k), 0) / K + (D1'' l1 + D2'' l2 + D3'' l3) / K / (V + 1)

c counts, k(vw) is the number of distinct u before vw, K(v) their sum, k(w) the
number of distinct v before w, K their sum, V the types; one unknown word shares
the V + 1. A context that was not seen leaves the next lower level. Texts begin
with two marks of their own. Order 2 has no triples, and c(vw) in place of k(vw).
Discounts are Chen and Goodman's; where counts of counts are missing (a tiny
corpus) they are k / 2 for a count of k. Words are hashed to 48 bits. A table is a
sorted array of 32-bit prints under an index by the first bits of the 64-bit key.

Defined results: a null text is the empty text, whose only token is its end.
Without training documents every token has the probability 1. Rows that repeat
an id are each learned and scored; a null id hashes as the empty text. Columns
other than id and text are not read. A very long text is hashed in pieces and
held as 8 bytes a word.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, local_path, mixed, shared_dir, slices, table, text_bytes, word_hashes

ORDER = 3
RUN_TOKENS = 3_000_000
#: Bytes of text of a shard, about; share of the texts in which frequent words are looked for.
SHARD_BYTES, SAMPLE = 64 << 20, 0.02
#: Up to so many shards runs are dealt to them at once; arrays that a worker keeps mapped.
ONE_LEVEL, MAPS = 512, 16_384
BEGIN, END = np.uint64(1), np.uint64(2)
_BITS = np.uint64(16)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first token of each text) of a slice; an end after each text."""
    h, bounds = word_hashes(data, offs)
    h = np.maximum(h >> _BITS, np.uint64(3))
    return np.insert(h, bounds[1:], END), bounds[:-1] + np.arange(len(bounds) - 1)


def before(words: np.ndarray, first: np.ndarray, begin) -> np.ndarray:
    """The word before each; begin before the first of a text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[first] = begin
    return out


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + w)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _planes(a: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def pack_columns(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers as compressed byte planes."""
    head = np.array([x for a, w in columns for x in (len(a), w)], "<u8").tobytes()
    return zstd.compress(bytes([len(columns)]) + head + b"".join(_planes(a, w) for a, w in columns), 1)


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    raw = zstd.decompress(blob)
    k = raw[0]
    head, at, out = np.frombuffer(raw, "<u8", 2 * k, 1), 1 + 16 * k, []
    for n, w in head.reshape(k, 2).tolist():
        out.append(_unplaned(raw[at : at + n * w], n, w))
        at += n * w
    return out


def summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns in order, with the sums of counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


_BLOBS = "shard int, kind int, blob binary, stats array<long>"
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _row(shard: int, kind: int, blob: bytes | None, stats: list[int] | None) -> pa.RecordBatch:
    """kind 0: triples, 1: pairs of frequent words, 2: words, or sums."""
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), pa.array([stats], pa.list_(pa.int64()))], schema=_SCHEMA)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    tmp = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(tmp, array)
    os.replace(tmp, f"{folder}/{name}.npy")


def _dealt(names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, n: int, groups: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted triples of places in `names`, sorted by v, as a blob for each shard
    (groups 0), or for each of so many groups of neighbouring shards. Time and
    memory follow the triples, not the number of shards."""
    shards = shard_of(names, n)[v]  # in order, as names are
    if len(own := np.flatnonzero(np.isin(names, hot)[v])):
        shards[own] = shard_of(pair_keys(names[u[own]], names[v[own]]) >> _BITS, n)
        go = np.argsort(shards, kind="stable")
        shards, v, u, w, c = shards[go], v[go], u[go], w[go], c[go]
    to = shards if not groups else shards.astype(np.int64) * groups // n
    begins = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    used = np.zeros(len(names), bool) if len(begins) * len(names) <= 8 * len(v) else None  # few blobs: flags are cheaper than sorts
    for i, j in zip(begins, np.append(begins[1:], len(to)), strict=True):
        if used is None:
            own, place = np.unique(np.concatenate((u[i:j], v[i:j], w[i:j])), return_inverse=True)
            place = place.reshape(3, j - i)
        else:
            used[:] = False
            for x in (u, v, w):
                used[x[i:j]] = True
            own, at = np.flatnonzero(used), np.cumsum(used) - 1
            place = at[u[i:j]], at[v[i:j]], at[w[i:j]]
        at = np.flatnonzero(np.append(True, v[i + 1 : j] != v[i : j - 1]))
        columns = (names[own], 6), (place[1][at], 4), (np.diff(np.append(at, j - i)), 4), (place[0], 4), (place[2], 4), (c[i:j], 4)
        yield _row(int(to[i]), 0, pack_columns(*columns), None)


def _runs(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray, order: int, groups: int = 0) -> Iterator[pa.RecordBatch]:
    """The counted triples of runs of tokens, dealt to shards or groups of them."""
    held, firsts, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        names, ids = np.unique(np.append(np.concatenate(held), BEGIN), return_inverse=True)
        w, b, first = ids[:-1], ids[-1], np.concatenate(firsts)
        v = before(w, first, b)
        u = before(v, first, b) if order == 3 else np.full(len(w), b)
        k = max(1, int(len(names) - 1).bit_length())
        if 3 * k <= 63:
            key = (v << 2 * k) | (u << k) | w
            key.sort()
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            c = np.diff(np.append(at, len(key)))
            key, mask = key[at], (1 << k) - 1
            v, u, w = key >> 2 * k, (key >> k) & mask, key & mask
        else:
            (v, u, w), c = summed([v, u, w], np.ones(len(w), np.int64))
        yield from _dealt(names, u, v, w, c, n, groups, hot)

    for b in batches:
        for _, _, data, offs in slices(b.column(0)):
            words, first = tokens(data, offs)
            held.append(words)
            firsts.append(first + size)
            size += len(words)
            if size >= RUN_TOKENS:
                yield from flush()
                held, firsts, size = [], [], 0
    if size:
        yield from flush()


def _columns_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The names u, v, w of a blob's triples and their counts."""
    names, vs, many, u, w, c = unpack_columns(blob)
    at = lambda x: x.astype(np.int64)
    return names[at(u)], np.repeat(names[at(vs)], at(many)), names[at(w)], at(c)


def _regrouped(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The triples of groups of shards, merged from many runs at a time and dealt to
    their shards. A task may have several groups."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        u, v, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
        names, ids = np.unique(np.concatenate((u, v, w)), return_inverse=True)
        u, v, w = ids.reshape(3, -1)
        (v, u, w), c = summed([v, u, w], c)
        yield from _dealt(names, u, v, w, c, n, 0, hot)

    for b in batches:
        for blob in b.column("blob"):
            held.append(_columns_of(blob.as_py()))
            size += len(held[-1][0])
            if size >= RUN_TOKENS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[dict[tuple[int, int], list[bytes]], list[list[int]]]:
    """Blobs by (kind, shard), and the sums."""
    blobs: dict[tuple[int, int], list[bytes]] = {}
    stats = []
    for b in batches:
        for shard, kind, blob, st in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if blob is not None:
                blobs.setdefault((kind, shard), []).append(blob)
            if st is not None:
                stats.append(st)
    return blobs, stats


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _save_table(folder: str, name: str, keys: np.ndarray, *rows: np.ndarray) -> None:
    """Sorted distinct 64-bit keys with columns of counts; those of 255 or more
    are in a list of their own."""
    bits = max(0, int(len(keys) // 8).bit_length())
    edges = np.searchsorted(keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64), np.arange((1 << bits) + 1))
    if not bits:
        edges = np.array([0, len(keys)])
    _save(folder, f"{name}-index", edges.astype(np.uint32))
    _save(folder, f"{name}-print", (keys >> np.uint64(32 - bits)).astype(np.uint32))
    counts = np.stack(rows)
    big = np.flatnonzero((counts >= 255).any(axis=0))
    _save(folder, f"{name}-count", np.minimum(counts, 255).astype(np.uint8))
    _save(folder, f"{name}-large", np.concatenate((big[None], counts[:, big])))


def _classes(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys and where each distinct one begins in it."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    return order, np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))


def _three(c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each group how many counts are 1, 2, and 3 or more."""
    return [np.add.reduceat(m.astype(np.int64), at) for m in (c == 1, c == 2, c >= 3)]


def _pairs(folder: str, tag: str, n: int, v: np.ndarray, w: np.ndarray, k: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Write distinct pairs with their counts k, and the contexts v; pass the
    words on. raw: how often the pairs occur."""
    keys = pair_keys(v, w)
    order = np.argsort(keys)
    _save_table(folder, f"pair-{tag}", keys[order], k[order])
    order, at = _grouped(v)
    k_v = k[order]
    _save(folder, f"middle-{tag}", v[order][at])
    _save(folder, f"middle-raw-{tag}", _small(np.add.reduceat(raw[order], at)))
    _save(folder, f"middle-total-{tag}", _small(np.add.reduceat(k_v, at)))
    _save(folder, f"middle-types-{tag}", _small(np.stack(_three(k_v, at))))
    yield _row(0, 2, None, [1, len(k), int(raw.sum()), 0, *_classes(k)])
    (w,), c = summed([w], np.ones(len(w), np.int64))
    cuts = np.searchsorted(shard_of(w, n), np.arange(n + 1))
    for s in range(n):
        i, j = cuts[s], cuts[s + 1]
        if i < j:
            yield _row(s, 2, pack_columns((w[i:j], 6), (c[i:j], 4)), None)


def _triples(batches: Iterator[pa.RecordBatch], n: int, folder: str, hot: np.ndarray, order: int) -> Iterator[pa.RecordBatch]:
    """Merge the triples of a shard; write them and their contexts."""
    blobs, _ = _gathered(batches)
    for _, shard in list(blobs):
        cols = [unpack_columns(x) for x in blobs.pop((0, shard))]
        whole = lambda k: np.concatenate([x[0][x[k].astype(np.int64)] for x in cols])  # noqa: E731, B023
        v = np.concatenate([np.repeat(x[0][x[1].astype(np.int64)], x[2].astype(np.int64)) for x in cols])
        u, w = whole(3), whole(4)
        c = np.concatenate([x[5] for x in cols]).astype(np.int64)
        del cols
        contexts = pair_keys(u, v)
        keys = pair_keys(contexts, w)
        del u
        go, at = _grouped(keys)
        c, first = np.add.reduceat(c[go], at), go[at]
        keys, contexts, v, w = keys[first], contexts[first], v[first], w[first]
        if order == 3:
            _save_table(folder, f"triple-{shard}", keys, c)
            yield _row(0, 2, None, [0, len(c), int(c.sum()), 0, *_classes(c)])
            go, at = _grouped(contexts)
            total, kinds = np.add.reduceat(c[go], at), _three(c[go], at)
            keep = total > 1  # a context seen once is known from its pair
            _save_table(folder, f"context-{shard}", contexts[go][at][keep], total[keep], *[x[keep] for x in kinds])
            del keys, contexts
            go, at = _grouped(pair_keys(v, w))
            k, raw = np.diff(np.append(at, len(go))), np.add.reduceat(c[go], at)
            v, w = v[go][at], w[go][at]
        else:
            k = raw = c
        apart = np.isin(v, hot)
        if apart.any():
            cuts = shard_of(v[apart], n)
            for s in np.unique(cuts):
                own = cuts == s
                yield _row(int(s), 1, pack_columns((v[apart][own], 6), (w[apart][own], 6), (k[apart][own], 8), (raw[apart][own], 8)), None)
            v, w, k, raw = v[~apart], w[~apart], k[~apart], raw[~apart]
        if len(v):
            yield from _pairs(folder, str(shard), n, v, w, k, raw)


def _frequent(batches: Iterator[pa.RecordBatch], n: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Merge the pairs of the words that were dealt over shards; all else passes."""
    blobs, stats = _gathered(batches)
    for st in stats:
        yield _row(0, 2, None, st)
    for kind, shard in list(blobs):
        held = blobs.pop((kind, shard))
        if kind != 1:
            for blob in held:
                yield _row(shard, kind, blob, None)
            continue
        v, w, k, raw = (np.concatenate(x) for x in zip(*map(unpack_columns, held), strict=True))
        go, at = _grouped(pair_keys(v, w))
        k, raw = (np.add.reduceat(x.astype(np.int64)[go], at) for x in (k, raw))
        yield from _pairs(folder, f"hot-{shard}", n, v[go][at], w[go][at], k, raw)


def _words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    blobs, stats = _gathered(batches)
    for st in stats:
        yield _row(0, 2, None, st)
    for _, shard in list(blobs):
        cols = [unpack_columns(x) for x in blobs.pop((2, shard))]
        (w,), k = summed([np.concatenate([x[0] for x in cols])], np.concatenate([x[1] for x in cols]).astype(np.int64))
        _save(folder, f"word-{shard}", w)
        _save(folder, f"word-contexts-{shard}", _small(k))
        yield _row(0, 2, None, [2, len(w), int(k.sum()), 0, *_classes(k)])


def _sampled(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """(word, count) of the words of a task that have that share of its tokens."""
    for b in batches:
        for _, _, data, offs in slices(b.column(0)):
            w, c = np.unique(tokens(data, offs)[0], return_counts=True)
            often = c >= share * c.sum()
            yield pa.RecordBatch.from_pydict({"w": pa.array(np.append(w[often], 0).astype(np.int64)), "c": pa.array(np.append(c[often], c.sum()))})


def frequent_words(texts: DataFrame, n: int) -> list[int]:
    """Words of more than an eighth of a shard's share of the tokens, by a sample:
    at most 8 n. Word 0 stands for all."""
    rows = texts.sample(SAMPLE, seed=5).mapInArrow(lambda b: _sampled(b, 1 / (16 * n)), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    total = rows.where("w = 0").select(F.col("c").alias("total"))
    found = rows.where("w <> 0").join(F.broadcast(total)).where(F.col("c") * (8 * n) >= F.col("total")).select("w")
    return [r["w"] for r in found.collect()]


def discounts(classes: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = classes
    if min(n1, n2, n3, n4) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.0), k) for x, k in zip(d, (1, 2, 3), strict=True))])


def train(texts: DataFrame, order: int = ORDER, hot: list[int] | None = None) -> dict:
    """Count texts(t binary); returns the model's folder and its few sums. hot:
    words to deal over shards; found by a sample if not given."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = local_path(shared_dir(spark, "kneser-ney"))
    os.makedirs(folder, exist_ok=True)
    if hot is None:
        hot = frequent_words(texts, n) if order == 3 else []
    often = np.array(sorted(hot), np.uint64)
    groups = math.isqrt(n - 1) + 1 if n > ONE_LEVEL else 0
    rows = texts.mapInArrow(lambda b: _runs(b, n, often, order, groups), _BLOBS)
    if groups:  # a blob for each run and group, then one for each many runs of a group and shard
        rows = rows.repartition(groups, "shard").mapInArrow(lambda b: _regrouped(b, n, often), _BLOBS)
    rows = rows.repartition(n, "shard")
    rows = rows.mapInArrow(lambda b: _triples(b, n, folder, often, order), _BLOBS).repartition(n, "shard")
    if hot:
        rows = rows.mapInArrow(lambda b: _frequent(b, n, folder), _BLOBS).repartition(n, "shard")
    sums = rows.mapInArrow(lambda b: _words(b, folder), _BLOBS).where("stats IS NOT NULL").select("stats").collect()  # a few rows a shard
    level = [np.sum(np.array([r["stats"] for r in sums if r["stats"][0] == k], dtype=object).reshape(-1, 8), axis=0) if any(r["stats"][0] == k for r in sums) else np.zeros(8, object) for k in (0, 1, 2)]
    return {
        "folder": folder,
        "shards": n,
        "order": order,
        "hot": [int(x) for x in often],
        "tokens": int(level[1][2]),
        "types": int(level[2][1]),
        "pairs": int(level[2][2]),
        "classes": [[int(x) for x in a[4:]] for a in level],
    }


class Model:
    """A trained model whose arrays are memory-mapped."""

    def __init__(self, about: dict):
        self.about, self.n = about, about["shards"]
        self.files: OrderedDict[str, np.ndarray | None] = OrderedDict()
        self.hot = np.array(about["hot"], np.uint64)
        self.d3, self.d2, self.d1 = (discounts(c) for c in about["classes"])
        m1, m2 = about["classes"][2][:2]
        self.k = max(1, about["pairs"])
        above = about["types"] - m1 - m2
        self.rest = float(self.d1[1] * m1 + self.d1[2] * m2 + self.d1[3] * above) / self.k / (about["types"] + 1)
        self.begin_total = int(self.middle(np.array([BEGIN]))[0][0])

    def array(self, name: str) -> np.ndarray | None:
        if name not in self.files:
            path = f"{self.about['folder']}/{name}.npy"
            self.files[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
            if len(self.files) > MAPS:  # a process has some 65,000 maps at most
                self.files.popitem(last=False)
        self.files.move_to_end(name)
        return self.files[name]

    @staticmethod
    def spread(tags: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each shard."""
        order = np.argsort(tags, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, tags[order][1:] != tags[order][:-1])), len(order)) if len(order) else [0]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield int(tags[order[i]]), order[i:j]

    def name(self, tag: int) -> str:
        """Shards of the words that were dealt come after all others."""
        return f"hot-{tag - self.n}" if tag >= self.n else str(tag)

    def look(self, table: str, tags: np.ndarray, keys: np.ndarray, columns: int) -> np.ndarray:
        """Columns of counts for keys, 0 where a table does not have them."""
        out = np.zeros((columns, len(keys)), np.int64)
        for tag, rows in self.spread(tags):
            name = f"{table}-{self.name(tag)}"
            index, prints = self.array(f"{name}-index"), self.array(f"{name}-print")
            if prints is None or not len(prints):
                continue
            bits = int(len(index) - 1).bit_length() - 1
            rows = rows[np.argsort(keys[rows])]
            own = keys[rows]
            part = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            want = (own >> np.uint64(32 - bits)).astype(np.uint32)
            lo, end = index[part].astype(np.int64), index[part + 1].astype(np.int64)
            hi = end.copy()
            for _ in range(int((end - lo).max()).bit_length()):
                at = (lo + hi) >> 1
                less = (prints[np.minimum(at, len(prints) - 1)] < want) & (lo < hi)
                lo, hi = np.where(less, at + 1, lo), np.where(less, hi, np.minimum(at, hi))
            hit = np.flatnonzero(lo < end)
            hit = hit[prints[lo[hit]] == want[hit]]
            at, to = lo[hit], rows[hit]
            found = self.array(f"{name}-count")[:, at].astype(np.int64)
            if (big := np.flatnonzero((found == 255).any(axis=0))).size:
                large = self.array(f"{name}-large")
                found[:, big] = large[1:, np.searchsorted(large[0], at[big])]
            out[:, to] = found
        return out

    def middle_tags(self, v: np.ndarray) -> np.ndarray:
        return shard_of(v, self.n) + self.n * np.isin(v, self.hot)

    def middle(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences, totals and weighted numbers of types of contexts v."""
        raw, total, weight = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h))
        for tag, rows in self.spread(self.middle_tags(h)):
            own = self.array(f"middle-{self.name(tag)}")
            if own is None:
                continue
            at = np.minimum(np.searchsorted(own, h[rows]), len(own) - 1)
            hit = own[at] == h[rows]
            at, to = at[hit], rows[hit]
            raw[to] = self.array(f"middle-raw-{self.name(tag)}")[at]
            total[to] = self.array(f"middle-total-{self.name(tag)}")[at]
            weight[to] = self.d2[1:] @ self.array(f"middle-types-{self.name(tag)}")[:, at]
        return raw, total, weight

    def word(self, h: np.ndarray) -> np.ndarray:
        """P(w)."""
        k = np.zeros(len(h), np.int64)
        for tag, rows in self.spread(shard_of(h, self.n)):
            own = self.array(f"word-{tag}")
            if own is None:
                continue
            at = np.minimum(np.searchsorted(own, h[rows]), len(own) - 1)
            hit = own[at] == h[rows]
            k[rows[hit]] = self.array(f"word-contexts-{tag}")[at[hit]]
        return np.maximum(k - self.d1[np.minimum(k, 3)], 0) / self.k + self.rest

    def score(self, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        n_tokens = np.diff(np.append(first, len(w)))
        if not self.about["tokens"]:
            zero = np.zeros(len(first))
            return n_tokens, zero.astype(np.int64), zero, zero
        types, ids = np.unique(np.append(w, BEGIN), return_inverse=True)
        w_id, v_id = ids[:-1], before(ids[:-1], first, ids[-1])
        v = types[v_id]
        raw, total, weight = self.middle(types)
        count = np.where(types == END, self.begin_total, np.where(types == BEGIN, 0, raw))
        base = np.log10((count + 0.5) / (self.about["tokens"] + 0.5 * (self.about["types"] + 1)))
        low = self.word(types)[w_id]
        k = self.look("pair", self.middle_tags(types)[v_id], pair_keys(v, w), 1)[0]
        t = total[v_id]
        p = np.where(t > 0, (np.maximum(k - self.d2[np.minimum(k, 3)], 0) + weight[v_id] * low) / np.maximum(t, 1), low)
        if self.about["order"] == 3:
            u = before(v, first, BEGIN)
            contexts = pair_keys(u, v)
            tags = np.where(np.isin(v, self.hot), shard_of(contexts >> _BITS, self.n), shard_of(v, self.n))
            c = self.look("triple", tags, pair_keys(contexts, w), 1)[0]
            t, n1, n2, n3 = self.look("context", tags, contexts, 4)
            once = (t == 0) & (before(k, first, 0) > 0)  # a context seen once has no row; the pair (u, v) tells
            t, n1 = t + once, n1 + once
            gamma = self.d3[1] * n1 + self.d3[2] * n2 + self.d3[3] * n3
            p = np.where(t > 0, (np.maximum(c - self.d3[np.minimum(c, 3)], 0) + gamma * p) / np.maximum(t, 1), p)
        sums = lambda x: np.add.reduceat(x, first)
        return n_tokens, sums((count[w_id] > 0).astype(np.int64)), sums(base[w_id]), sums(np.log10(p))


def score(docs: DataFrame, about: dict) -> DataFrame:
    """docs(doc_id, held_out, t binary) -> the columns of the contract."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(about)
        for b in batches:
            for i, j, data, offs in slices(b.column(2)):
                n, known, base, full = model.score(*tokens(data, offs))
                train_tokens = pa.array(np.full(j - i, about["tokens"], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(known), train_tokens, pa.array(base), pa.array(full)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc32_mod("doc_id", 5) == 1).alias("held_out"), text_bytes().alias("t"))
    return score(docs, train(docs.where("NOT held_out").select("t")))
