"""Resampling, the conversation trie and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tessera.llm import prefix_trie, resampling, set_join

from .test_llm import DOCS, EDGES, WORD, docs_of

_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture
def many_parts(spark):
    """Every range is its own partition, however few rows it has."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


# Resampling


def brute_features(text, n):
    w = _TOKEN.findall(lowered(text))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute_resampled(data, target, n, percent=10, min_words=20):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, x in data:
        np.add.at(s, brute_features(x, n)[0], 1)
    for x in target:
        np.add.at(t, brute_features(x, n)[0], 1)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.sum() + 10_000) / ((s[k] + 1) * (t.sum() + 10_000)))) for k in range(10_000)]
    rows = []
    for i, x in data:
        f, words = brute_features(x, n)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    drawn = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling(spark, sf_dir, many_parts, n):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    data = [*texts, *((None if i is None else i + 10_000, t) for i, t in EDGES)]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [None, ""]
    got = resampling.resampled(docs_of(spark, data, True), spark.createDataFrame([(t,) for t in target], "text string"), n, percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resampled(data, target, n, 30)


def test_resampling_pieces_and_empty(spark):
    text = ("Größe 12 x-y foo " * 50).encode()
    for n in (1, 2, 3):
        whole = [np.concatenate([f for _, f in resampling._features(text, n, piece)]) for piece in (7, 64, 1 << 20)]
        want = sorted(brute_features(text.decode(), n)[0])
        assert all(sorted(w.tolist()) == want for w in whole)
    empty, few = docs_of(spark, []), docs_of(spark, [(1, "a b c"), (2, None)])
    assert resampling.resampled(empty, empty).count() == 0
    assert {r["rank"] for r in resampling.resampled(few, empty).collect()} == {None}
    alike = docs_of(spark, [(7, "one two " * 20)] * 3 + [(8, "one two " * 20)])
    assert sorted(r["rank"] for r in resampling.resampled(alike, empty, percent=100).collect()) == [1, 2, 3, 4]


# Conversation trie


def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    rows = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below = [rows[k] for k in kids[p]]
        leaves = sum(r[5] for r in below) if below else 1
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        rows[p] = (min(members[p]), len(p), parent, len(members[p]), len(below), leaves, own + sum(r[6] for r in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(rows.values(), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def conversations_of(spark, convs):
    rows = [(c, i, role, text, "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent string")


@pytest.mark.parametrize("seed", range(4))
def test_trie(spark, many_parts, seed):
    rng = random.Random(seed)
    convs = {}
    for c in range(-3, 160):
        like = list(rng.choice(list(convs.values()))) if convs and rng.random() < 0.7 else []
        cut = rng.randrange(len(like) + 1) if rng.random() < 0.6 else len(like)
        grown = [(rng.choice("ua"), rng.choice(["", "x", "yé", "zz"])) for _ in range(rng.randrange(4))]
        convs[c] = (like[:cut] + grown) or [("u", "only")]
    hot = [("u", "hot"), ("a", "answer")]
    convs |= {c: hot for c in range(1000, 1100)} | {5000: [("u", str(i % 2)) for i in range(300)], 5001: [("u", str(i % 2)) for i in range(299)]}
    assert rows_of(prefix_trie.conversation_trie(conversations_of(spark, convs))) == brute_trie(convs)


def test_trie_rebuilt(spark, many_parts):
    rng = random.Random(9)
    rows = [(c, rng.choice([None, *range(4)]), rng.choice([None, "u"]), rng.choice([None, "a", "b"])) for c in [*range(1, 60), 61] for _ in range(rng.randrange(1, 12))] + [(None, 1, "u", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    want = {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + x[h:] for c, x in own.items()}
    assert any(not x for x in want.values())  # turnless ones are members of the root
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(df)))
    assert rows_of(got) == brute_trie(want)
    assert rows_of(prefix_trie.conversation_trie(df.limit(0))) == []


# N-gram join


def brute_components(data, width, percent):
    sets = {}
    for i, t in data:
        w = WORD.findall(lowered(t))
        k = min(width, len(w))
        sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    found = {i: i for i in sets}

    def top(i):
        while found[i] != i:
            i = found[i]
        return i

    ids = [i for i in sets if i is not None]
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = top(x), top(y)
                found[max(a, b)] = min(a, b)
    return {i: None if i is None else top(i) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (2, 80), (1, 60)])
def test_join(spark, width, percent):
    rng = random.Random(width * percent)
    words = [f"w{i}" for i in range(40 if width == 1 else 400)]
    texts = [[rng.choice(words) for _ in range(rng.choice([1, 3, 8, 30, 60]))] for _ in range(25)]
    for _ in range(150):
        w = list(rng.choice(texts))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w[: rng.randrange(max(1, len(w) - 6), len(w) + 1)] + [rng.choice(words) for _ in range(rng.randrange(3))])
    data = [*((i, " ".join(w).title()) for i, w in enumerate(texts, 100)), *EDGES]
    got = set_join.jaccard_components(docs_of(spark, data, True), width, percent).collect()
    want = brute_components(data, width, percent)
    assert len(got) == len(data)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    sizes = {r["doc_id"]: r["n_shingles"] for r in got}
    assert (sizes[1], sizes[2], sizes[3], sizes[4]) == (0, 0, 0, 1)


def test_join_at_the_threshold(spark):
    """4 of 5 shingles in common link, one less in the union's place doesn't."""
    base = [f"a{i}" for i in range(12)]  # 8 shingles of five words
    near = base[:-1] + ["x"]  # 7 in common, 9 in either
    far = base[:-1] + ["x", "y"]  # 7 in common, 10 in either
    data = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    got = {r["doc_id"]: r["component_id"] for r in set_join.jaccard_components(docs_of(spark, data), 5, 77).collect()}
    assert got == brute_components(data, 5, 77)
    assert got == {1: 1, 2: 1, 3: 1}  # 2 and 3 share 8 of 9
    lone = set_join.jaccard_components(docs_of(spark, [data[0], data[2]]), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in lone} == {1: 1, 3: 3}
    assert set_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_join_large_group(spark):
    """A large group of near copies beside strangers that share their lists."""
    rng = random.Random(1)
    core = [f"c{i}" for i in range(100)]
    data = []
    for i in range(300):
        w = list(core)
        for _ in range(2):
            w[rng.randrange(100)] = f"n{i}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, " ".join(core[:60] + [f"s{i}.{j}" for j in range(30)])) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in set_join.jaccard_components(docs_of(spark, data)).collect()}
    assert got == brute_components(data, 5, 80)
