"""Token ids of whole texts, with the vocabularies of public tokenizers.

A text is cut before each single space between two characters that are not
white space; with the byte-level pattern also after a letter before an ASCII
character that is none, and before a letter after a single line feed. The
tokenizers' own pattern always starts a piece there, so the parts encode on
their own to the ids of the whole. A slice of texts is cut with array operations
and its parts are made a dictionary by Arrow, so that each distinct part of a
slice is looked up once, and encoded once for each worker while it is
remembered. What is remembered is an Arrow array too, and a slice's dictionary
is looked up in it at once.

Defined results: a null or empty text has no ids. A text without a place to cut
is one part, however long. Repeated rows get the same ids each. Only the named
columns are read.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

#: Parts that a worker remembers (beyond that it keeps those of the slice at hand),
#: and bytes of texts that it cuts at once: for ids, and for lengths alone.
CACHE_PARTS, CUT_BYTES = 1_000_000, 20 << 20
LENGTH_PARTS, LENGTH_BYTES = 200_000, 4 << 20
#: Parts that are encoded as one text, and parts whose ids are put together at once.
GROUP, RUN_PARTS = 200, 1 << 18
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that white space can begin with.
_MAYBE = _WHITE.copy()
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def part_starts(data: np.ndarray, offs: np.ndarray, fine: bool = False) -> np.ndarray:
    """Where the parts of a slice of UTF-8 texts begin; fine: with the cuts that
    hold for the byte-level pattern. Beside a character that may be white space
    beyond ASCII nothing is cut."""
    at = np.flatnonzero(data[1:-1] == 32) + 1
    at = at[~(_MAYBE.take(data.take(at + 1)) | _WHITE.take(data.take(at - 1)) | (data.take(np.maximum(at - 2, 0)) == 0xC2))]
    third = data.take(np.maximum(at - 3, 0))
    first = np.zeros(len(data), bool)
    first[at[(third < 0xE1) | (third > 0xE3)]] = True
    if fine and len(data) > 1:
        letter = ((data | 32) - np.uint8(97)) < 26
        # ASCII that ends a run of letters; a space is left to its own rule.
        ends = (((data - np.uint8(9)) < 5) | ((data - np.uint8(33)) < 95)) & ~letter
        # Of two bytes, C0 to FF in Unicode but the signs of times and division.
        two = np.flatnonzero(data[:-1] == 0xC3)
        second = data[two + 1]
        two = two[(second >= 0x80) & (second < 0xC0) & (second != 0x97) & (second != 0xB7)]
        letter[two] = letter[two + 1] = True
        first[1:] |= letter[:-1] & ends[1:]
        feed = np.flatnonzero((data[1:-1] == 10) & letter[2:]) + 1
        before = data[feed - 1]
        first[feed[((before > 32) & (before < 128)) | letter[feed - 1]] + 1] = True
    first[offs[:-1][offs[:-1] < len(data)]] = True
    return np.flatnonzero(first)


def hf_encoder(path: str) -> tuple[Callable[[list[str]], list], np.ndarray | None]:
    """Ids by the tokenizers library, special tokens' strings as ordinary text;
    and the bytes that each id stands for, if ids stand for bytes of the text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    sizes = None
    cut = about.get("pre_tokenizer") or {}
    if cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not about.get("normalizer"):
        words = about["model"]["vocab"]  # one character of the vocabulary is one byte
        sizes = np.zeros(max(words.values()) + 1, np.int64)
        sizes[list(words.values())] = list(map(len, words))
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)], sizes


def rank_encoder(path: str) -> tuple[Callable[[list[str]], list], np.ndarray]:
    """Ids by tiktoken from a file of ranks, and the bytes that each stands for."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = list(map(len, ranks))
    return lambda texts: [one(t) for t in texts], sizes


def encoder(path: str) -> tuple[Callable[[list[str]], list], np.ndarray | None]:
    return rank_encoder(path) if path.endswith(".tiktoken") else hf_encoder(path)


def _bytes_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array and where its rows begin in them."""
    _, offs, data = parts.buffers()
    offs = np.frombuffer(offs, np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Encoder:
    """Encodes slices of texts by parts and remembers what the parts gave."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS, cut_bytes: int = CUT_BYTES):
        self.encode, self.sizes = encoder(path)
        self.cache_parts, self.cut_bytes = cache_parts, cut_bytes
        self.known = pa.array([], pa.large_binary())  # the parts, by their numbers
        self.start = self.count = np.zeros(0, np.int64)  # of its ids
        self.ids = np.zeros(0, np.uint32)

    def learn(self, parts: pa.Array) -> None:
        """Encode parts that are not known. Those that begin with a space are
        encoded end to end, GROUP in one text, and told apart by their bytes.
        Bytes that are no UTF-8 count as the replacement character."""
        data, offs = _bytes_of(parts)
        spaced = data[offs[:-1]] == 32 if self.sizes is not None else np.zeros(len(parts), bool)
        joined, at = _bytes_of(parts.filter(pa.array(spaced)))
        cuts = at[np.append(np.arange(0, len(at) - 1, GROUP), len(at) - 1)].tolist()
        try:
            texts = [joined[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        except UnicodeDecodeError:  # broken text: its replacement has other bytes
            spaced, texts = np.zeros(len(parts), bool), []
        flat = np.fromiter(chain.from_iterable(self.encode(texts)), np.uint32)
        counts = np.zeros(len(parts), np.int64)
        if texts:
            counts[spaced] = np.diff(np.searchsorted(np.cumsum(self.sizes[flat]), at[1:]) + 1, prepend=0)
        found = self.encode([p.decode("utf-8", "replace") for p in parts.filter(pa.array(~spaced)).to_pylist()])
        counts[~spaced] = np.fromiter(map(len, found), np.int64)
        start = np.zeros(len(parts), np.int64)
        begin = len(self.ids)
        for own in (spaced, ~spaced):
            start[own] = begin + np.cumsum(counts[own]) - counts[own]
            begin += int(counts[own].sum())
        self.known = pa.concat_arrays([self.known, parts])
        self.start = np.concatenate((self.start, start))
        self.count = np.concatenate((self.count, counts))
        self.ids = np.concatenate((self.ids, flat, np.fromiter(chain.from_iterable(found), np.uint32)))

    def find(self, parts: pa.Array) -> pa.Array:
        """The number of each part, or null."""
        return pc.index_in(parts, value_set=self.known)

    def forget(self, keep: pa.Array | list) -> None:
        """Remember only some known parts, numbered in their order."""
        keep = pa.array(keep, pa.large_binary()) if isinstance(keep, list) else keep
        at = self.find(keep).to_numpy(zero_copy_only=False).astype(np.int64)
        start, counts = self.start[at], self.count[at]
        ends = np.cumsum(counts)
        take = np.repeat(start - ends + counts, counts) + np.arange(int(counts.sum()))
        self.known, self.start, self.count, self.ids = keep, ends - counts, counts, self.ids[take]

    def places(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each part of a slice, and where rows begin."""
        first = part_starts(data, offs, self.sizes is not None)
        wide = len(data) >= 1 << 31
        at = pa.py_buffer(np.append(first, len(data)).astype(np.int64 if wide else np.int32))
        parts = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(first), [None, at, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        keys = parts.dictionary.cast(pa.large_binary())
        found = self.find(keys)
        number = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            old = number >= 0
            if len(self.known) + found.null_count > self.cache_parts:
                self.forget(keys.filter(pa.array(old)))
                number[old] = np.arange(len(self.known))
            number[~old] = len(self.known) + np.arange(found.null_count)
            self.learn(keys.filter(pa.array(~old)))
        return number.take(parts.indices.to_numpy()), np.searchsorted(first, offs)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Numbers of ids of a binary column of texts."""
        out = np.zeros(len(column), np.int64)
        for i, j, data, offs in slices(column, self.cut_bytes):
            if not len(data):
                continue
            at, rows = self.places(data, offs)
            out[i:j] = np.diff(np.append(0, np.cumsum(self.count[at]))[rows])
        return out

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids end to end, where rows begin) of runs of rows."""
        for i, j, data, offs in slices(column, self.cut_bytes):
            if not len(data):
                yield i, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            at, rows = self.places(data, offs)
            a = 0
            while a < j - i:
                b = max(a + 1, int(np.searchsorted(rows, rows[a] + RUN_PARTS, side="right")) - 1)
                own = at[rows[a] : rows[b]]
                counts = self.count.take(own)
                ends = np.append(0, np.cumsum(counts))
                take = np.repeat(self.start.take(own) - ends[:-1], counts)
                take += np.arange(len(take))
                yield i + a, self.ids.take(take), ends[rows[a : b + 1] - rows[a]]
                a = b


_workers: dict[tuple, Encoder] = {}


def worker_encoder(path: str, *how: int) -> Encoder:
    """The encoder of this worker; it outlives the task."""
    if (path, how) not in _workers:
        _workers[path, how] = Encoder(path, *how)
    return _workers[path, how]


def token_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null is empty and has 0 tokens."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(path, LENGTH_PARTS, LENGTH_BYTES)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode.lengths(b.column(1)))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens long")
