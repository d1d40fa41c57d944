"""Trie of the shared prefixes of conversations.

1. Each conversation becomes one array of turns, a 16-byte digest a turn (role
   and text), and the arrays are sorted globally by range, ties by conv_id.
   Equal conversations are spread by their id, so a group of copies with a third
   of all rows is many tasks' work.
2. Each partition is swept in order with a stack. The longest common prefix
   (LCP) of an array with the one before says which LCP intervals end: nodes
   deeper than it are closed and give what their subtree holds to their parent.
   A node that was opened and closed inside the partition is complete.
3. Nodes on the path of a partition's first or last array may go on in its
   neighbours: they are handed on, one row a partition. A second sweep over these
   rows in order stitches the open stacks: its state is one path.
4. A node's name is the digest of its path, so a child finds its parent, whose
   smallest member is known only when it closes, by one join.

The ids that end at a node are hashed as they stream by. Only a group that a
partition boundary may cut is hashed later, from its pieces (the ids of one
partition, as text) in order: SHA-256 has no merge, so the id list of such a
group passes through one task, as a stream.

Memory: a task holds one path (some 200 bytes a turn) and the id list of one
group within its partition. A conversation's digests meet in one row, some 40
bytes a turn.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), ties by digest; repeated rows are turns of their own. Rows without
conv_id belong to no conversation and are left out. Without conversations there
is no node, not even the root. Columns other than these four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

WIDTH = 16
ROOT = hashlib.md5(b"").digest()
_NONE = hashlib.sha256(b"").hexdigest()

#: Kinds of rows that a sweep gives out: whole nodes, nodes on the partition's
#: first or last path, and the ids that end at a node which a boundary may cut.
WHOLE, EDGE, IDS = 0, 1, 2
_FIELDS = [("kind", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64())]
_FIELDS += [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("n_bytes", pa.int64()), ("begun", pa.bool_()), ("open", pa.bool_()), ("ids", pa.binary())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = (
    "kind int, part int, seq long, node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, n_bytes long, begun boolean, open boolean, ids binary"
)


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: array of (digest as hex, bytes of text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.octet_length(text).alias("n"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).selectExpr("conv_id", "transform(t, x -> struct(x.d AS d, x.n AS n)) AS turns")


class _Node:
    """A node on the stack, with what its closed children have given it."""

    __slots__ = ("begun", "children", "count", "ends", "least", "leaves", "n_bytes", "name", "saved")

    def __init__(self, name: bytes, n_bytes: int, begun: bool):
        self.name, self.n_bytes = name, n_bytes
        self.begun = begun  # certainly begun here, not in a partition before
        self.least: int | None = None
        self.count = self.children = self.leaves = self.saved = 0
        self.ends: str | None = _NONE  # None: hashed later, from pieces

    def add(self, least: int | None, count: int) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.count += count

    def close(self, parent: _Node | None) -> None:
        """Settles leaves and savings, and hands them to the parent."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.count - 1) * self.n_bytes
        if parent is not None:
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved
            parent.add(self.least, self.count)

    def row(self, kind: int, part: int, seq: int, depth: int, parent: bytes | None, open_: bool = False) -> tuple:
        return (kind, part, seq, self.name, parent, depth, self.least, self.count, self.children, self.leaves, self.saved, self.ends, self.n_bytes, self.begun, open_, None)


def _pop(stack: list[_Node], part: int, seq: int) -> tuple:
    node = stack.pop()
    above = stack[-1] if stack else None
    node.close(above)
    return node.row(WHOLE, part, seq, len(stack), above.name if above else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], schema=_SCHEMA)


def _lcp(a: bytes, b: bytes) -> int:
    """Turns that two arrays share from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays of a partition in order -> whole nodes, and what its neighbours
    must settle. Edge rows come in the order that _stitch() reads: the first path
    from the root on, then what is open at the end below it."""
    out: list[tuple] = []
    stack: list[_Node] = []
    first_path: list[_Node] = []
    last: bytes | None = None
    part = 0
    ids: list[bytes] = []  # ids of the running group of equal arrays

    def ended(cut: bool) -> None:
        """The running group is over; `cut`: it may go on beyond a boundary."""
        node, text = stack[-1], b",".join(ids)
        if cut:
            node.ends = None
            out.append((IDS, part, 0 if not node.begun else 1, node.name, *[None] * 11, text))
        else:
            node.ends = hashlib.sha256(text).hexdigest()

    for b in batches:
        for key, conv, sizes, at in zip(b.column("key"), b.column("conv_id").to_pylist(), b.column("sizes").to_pylist(), b.column("part").to_pylist(), strict=True):
            key = key.as_py()
            if key != last:
                if last is not None:
                    ended(cut=not stack[-1].begun)
                    shared = _lcp(key, last)
                    while len(stack) - 1 > shared:
                        if stack[-1].begun:
                            out.append(_pop(stack, part, 0))
                        else:
                            stack.pop()  # of the first path: settled in _stitch()
                ids = []
                for d in range(len(stack), len(sizes) + 1):
                    name = hashlib.md5(stack[-1].name + key[(d - 1) * WIDTH : d * WIDTH]).digest() if d else ROOT
                    stack.append(_Node(name, sizes[d - 1] if d else 0, last is not None))
                if last is None:
                    part, first_path = at, list(stack)
                last = key
            stack[-1].add(conv, 1)
            ids.append(b"%d" % conv)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
    if last is None:
        return
    ended(cut=True)
    kept = sum(not n.begun for n in stack)
    paths = [*((d, n, d < kept) for d, n in enumerate(first_path)), *((d, n, True) for d, n in enumerate(stack) if d >= kept)]
    out += [n.row(EDGE, part, i, d, None, open_) for i, (d, n, open_) in enumerate(paths)]
    yield _batch(out)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge rows of all partitions in order -> the nodes on them. The stack holds
    the path that is open at the end of the partition before."""
    stack: list[_Node] = []
    out: list[tuple] = []
    now, below, settled, same = None, 0, False, True

    def closed(down_to: int) -> None:
        while len(stack) > down_to:
            out.append(_pop(stack, -1, 0))

    for b in batches:
        for r in b.to_pylist():
            d = r["depth"]
            if r["part"] != now:
                now, settled = r["part"], False
            if r["begun"] and not settled:
                closed(below)  # the first path is read; what the partition itself closed of it ends here
                settled = True
            if not r["begun"]:
                if d == 0:
                    below, same = 0, True
                same = same and d < len(stack) and stack[d].name == r["node"]
                if not same and d < len(stack):
                    closed(d)
                below += r["open"]
            if r["begun"] or not same:
                node = _Node(r["node"], r["n_bytes"], True)
                stack.append(node)
            else:
                node = stack[d]
            node.add(r["conv_id"], r["n_convs"])
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            if r["ends_sha256"] != _NONE:
                node.ends = r["ends_sha256"]
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    closed(0)
    yield _batch(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, in order of (node, part, seq) -> SHA-256 of each list."""
    now, running = None, None
    for b in batches:
        done = []
        for node, ids in zip(b.column("node").to_pylist(), b.column("ids"), strict=True):
            if node != now:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["at", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["at", "sha"])


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, turns) as turn_arrays() makes them:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. conv_id is unique in `arrays`."""
    flat = arrays.selectExpr("unhex(array_join(transform(turns, x -> x.d), '')) AS key", "conv_id", "transform(turns, x -> x.n) AS sizes")
    ranged = flat.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    swept = written(ranged.mapInArrow(_sweep, _DDL), "trie-swept")
    edges = swept.where(f"kind = {EDGE}").repartition(1).sortWithinPartitions("part", "seq")  # one path or two a partition
    pieces = swept.where(f"kind = {IDS}").select("node", "part", "seq", "ids").repartition("node").sortWithinPartitions("node", "part", "seq")
    cut = pieces.mapInArrow(_digests, "at binary, sha string")  # two nodes a partition at most
    nodes = written(swept.where(f"kind = {WHOLE}").unionByName(edges.mapInArrow(_stitch, _DDL)).drop("kind", "part", "seq", "ids", "open", "begun", "n_bytes"), "trie-nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left").join(F.broadcast(cut), F.col("node") == F.col("at"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", "sha").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text)."""
    return prefix_trie(turn_arrays(conversations))


def rebuilt(arrays: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % group,
    h = crc32(c) % most, and goes on with its own after its first h."""
    base = arrays.select(F.col("conv_id").alias("b"), F.slice("turns", 1, most).alias("start"))
    both = arrays.withColumns({"b": F.expr(f"conv_id - conv_id % {group}"), "h": F.expr(f"int(crc32(cast(conv_id AS string)) % {most})")}).join(base, "b", "left")
    return both.selectExpr("conv_id", "concat(slice(coalesce(start, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, size(turns))) AS turns")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_arrays(table(spark, sf_dir, "conversations"))))
