"""The training-data operators against brute force on small tables."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard as zstd
from pyspark.sql import functions as F
from tessera.llm import decontaminate, html_text, id_coder, kneser_ney, language_id, near_dup, packing, quality, token_counts, token_files, tokens, warc
from tessera.llm.common import shared_dir, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 AS t", "'x' AS rid", "2 AS n", "3 AS words") if extra else df


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "one two three"), (7, "A b. A b. A b. A b. A b. A b."), (7, "A b. A b. A b. A b. A b. A b."), (8, "word " * 20_000)]


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality(spark, sample):
    data = [*sample[:150], *EDGES]
    got = quality.quality(docs_of(spark, data, True)).collect()
    assert len(got) == len(data)
    want = Counter((i, *brute_quality(t)) for i, t in data)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert quality.quality(docs_of(spark, [])).count() == 0


def test_quality_stage(spark, sample):
    df = docs_of(spark, [*sample[:100], (None, None)])
    kept = quality.stage(spark, df, "")
    assert kept.columns == df.columns
    verdict = {r["doc_id"] for r in quality.quality(df).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == verdict


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dicts = language_id.fit(docs, docs["doc_id"] % 4 != 2)
    assert all(len(d) <= language_id.DICT_BYTES for d in dicts.values())
    got = {r["doc_id"]: r for r in language_id.predict(docs, dicts).where("doc_id % 4 = 2").collect()}
    right = sum(r["lang"] == r["lang_pred"] for r in got.values())
    assert right >= 0.93 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = language_id.predict(docs_of(spark, [(1, None), (2, "12 34 !!"), (3, "")]), dicts).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in odd} == {("und", 0.0, True)}
    assert {r["lang_pred"] for r in language_id.predict(docs_of(spark, [(1, "abc")]), {}).collect()} == {"und"}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(data, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in data]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            common = len(s & t)
            if common and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies():
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 400, 60)]
    out = []
    for i in range(40):
        w = list(base)
        for j in rng.choice(60, int(rng.integers(0, 9)), replace=False):
            w[j] = f"x{rng.integers(0, 10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, sample, width):
    data = [*sample[:120], *near_copies(), (5001, None), (5002, ""), (5003, "solo"), (5004, "Solo "), (5005, "a b"), (5006, "A  b")]
    want = brute_components(data, width)
    got = near_dup.near_duplicates(docs_of(spark, data, True), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def families():
    """Texts of several lengths that share a passage: buckets with a large
    component and strangers, links across components, sizes at the limit."""
    rng = np.random.default_rng(11)
    shared = [f"s{i}" for i in range(70)]
    out = []
    for f in range(6):
        own = [f"f{f}x{i}" for i in range(12 + 2 * f)]
        for i in range(24 if f == 0 else 5):
            w = shared + own
            for j in rng.choice(len(w), int(rng.integers(0, 6)), replace=False):
                w[j] = f"y{rng.integers(0, 10**6)}"
            out.append((2000 + 7 * len(out) % 331, " ".join(w)))
    return [*out, *((3000 + n, " ".join(shared[:n])) for n in range(40, 71, 3))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_open_buckets(spark, width):
    data = families()
    want = brute_components(data, width)
    assert 5 < len({c for _, c in want.values()}) < len(want)
    got = near_dup.near_duplicates(docs_of(spark, data, True), width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_edges(spark):
    got = near_dup.near_duplicates(docs_of(spark, [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, "a b c d")]), 2).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_stage(spark):
    """Distinct texts under one id stay, copies without an id go, extra columns stay."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, "another text of some other words"), (None, text), (None, text + " more"), (None, "alone"), (9, text), (2, text + " x"), (5, None), (6, ""), (6, "")]
    docs = docs_of(spark, rows, True).withColumn("_dedup_row", F.lit(1)).withColumn("component_id", F.lit("c"))
    kept = near_dup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, rows[1][1]), (None, "alone"), (2, rows[6][1]), (5, None), (6, ""), (6, "")])
    assert near_dup.stage(spark, docs.limit(0), "").count() == 0


def test_language_stage(spark, sf_dir):
    """Columns with the names of results, repeated rows, long text, no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    own = docs.withColumns({"rejected": F.lit("r"), "score": F.lit(1), "lang_pred": F.lit("p"), "row": F.lit(2)})
    kept = language_id.stage(spark, own.unionByName(own), "")
    assert kept.columns == own.columns and set(kept.select("rejected", "score", "lang_pred", "row").distinct().collect()) == {("r", 1, "p", 2)}
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert len(ids) > 100 and set(ids.values()) == {2}
    assert language_id.stage(spark, own.limit(0), "").count() == 0
    dicts = language_id.fit(docs, docs["doc_id"] >= 0)
    long = docs.orderBy(F.length("text").desc()).first()
    twice = language_id.predict(docs_of(spark, [(1, long["text"] * (1 + 1_000_000 // len(long["text"]))), (2, long["text"])], True), dicts).collect()
    assert {r["lang_pred"] for r in twice} == {long["lang"]}


def test_language_brute(spark, sf_dir):
    """The whole query against the compression of each text on its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.op5_language_id(spark, sf_dir).collect()
    dicts = language_id.fit(docs, ~F.col("doc_id").isin([r["doc_id"] for r in rows if r["held_out"]]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        t = " ".join(re.sub(r"[\W\d_]+", " ", (texts[r["doc_id"]] or "").lower()).split())
        if not re.search(r"[^\W\d_]", t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        size = {}
        for lang, raw in dicts.items():
            how = zstd.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.BLOCK_CHARS, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            size[lang] = sum(len(zstd.ZstdCompressor(compression_params=how, dict_data=d).compress(t[i : i + language_id.BLOCK_CHARS].encode())) for i in range(0, len(t), language_id.BLOCK_CHARS))
        best, second = sorted(size.values())[:2]
        assert size[r["lang_pred"]] == best and r["score"] == pytest.approx(1 - best / second)


def test_decontaminate_rows(spark):
    """Hits by row: a null id, and different texts under one id."""
    item = "a train leaves with 30 km per hour and after 30 minutes it meets another of 45 km"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, [(None, f"so {item} on"), (None, "quiet"), (4, f"and {item}"), (4, "clean text"), (4, item.replace("30 km", "70 km")), (5, None), (6, "long words " * 100_000 + item)], True)
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"] or -1, r["exact"]) for r in got) == [(-1, True), (4, True), (6, True)]
    hits = decontaminate.contaminated_rows(docs, items, "doc_id", "text", "item_id", "text", 8, 5).select("row.id").collect()
    assert sorted(r[0] or -1 for r in hits) == [-1, 4, 6]


def test_decontaminate(spark, sf_dir, sample):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, sample), bench).collect()}
    want = {(i, r["item_id"]) for i, t in sample for r in bench.collect() if r["text"] in (t or "")}
    assert got == want


def test_decontaminate_templates(spark):
    items = spark.createDataFrame([(1, "a train leaves with 30 km per hour and after 30 minutes it meets another of 45 km"), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    docs = [
        (1, "so a train leaves with 70 km per hour and after 70 minutes it meets another of 12 km away"),
        (2, "so a train leaves with 70 km per hour and after 80 minutes it meets another of 12 km away"),
        (3, "a quiet text about trains that leaves nothing with anyone and after all meets nobody"),
        (4, None),
        (5, ""),
    ]
    got = [(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminated(docs_of(spark, docs, True), items).collect()]
    assert got == [(1, 1, False)]  # 2 puts two values for one
    assert decontaminate.contaminated(docs_of(spark, docs), items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), items).count() == 0


def test_decontaminate_values(spark):
    """An exact copy is a hit whatever quantities and names stand before it."""
    item = "a train leaves with 30 km per hour and after 30 minutes it meets another of 45 km"
    before = ["the ticket costs $5 and then", "a film on YouTube says that", "it was €1,000,5 or 7 % or 3 kg of", "the state ⟨a b c⟩ and ⟨q·5⟩ then", "near McDonald in New YouTube"]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, [(i, f"{x} {item} away") for i, x in enumerate(before)])
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["exact"]) for r in got) == [(i, 1, True) for i in range(len(before))]
    sizes = docs.selectExpr(f"size({decontaminate.tokens('text', False)}) AS a", f"size({decontaminate.tokens('text', True)}) AS b").collect()
    assert all(r["a"] == r["b"] for r in sizes)


def test_decontaminate_short(spark):
    """Short items are found inside a sentence, with other values too."""
    ask = ["Explain why the {0} rises", "Find how many apples cost {0} at this shop", "New York sells the old bridge to {0} buyers and then buys it back"]
    items = spark.createDataFrame([(i, a.format(30)) for i, a in enumerate(ask)], "item_id long, text string")
    before = ["please ", "he said, ", "we asked Peter ", "", "All done. "]
    docs = [(100 * n + 10 * k + i, f"{x}{a.format(n)} and so on") for n in (30, 41) for k, x in enumerate(before) for i, a in enumerate(ask)]
    got = sorted((r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminated(docs_of(spark, docs), items).collect())
    assert got == sorted((d, d % 10, d < 4000) for d, _ in docs)


def test_decontaminate_exact(spark):
    """Exact copies of items that have no template, or one that a neighbour changes."""
    ask = ["What is 12 * 7 + 5?", "你知道法国的首都是什么吗？", "Who won?", "12 + 30", "Add the apples to 5", "Is 3 more than 4 or is it 3", "Is 3 more than 4 or is it 9", "ประเทศไทย"]
    items = spark.createDataFrame([*enumerate(ask), (98, " "), (99, None)], "item_id long, text string")
    docs = [(10 * k + i, f"{x}{a}{y}") for k, (x, y) in enumerate([("", ""), ("please tell me ", " in the end"), ("Peter asked, ", "\n")]) for i, a in enumerate(ask)]
    docs += [(1001, "What is 12 * 7 - 5?"), (1002, "112 + 30 and 12 + 301"), (1003, None), (1004, "who won the race?"), (1005, "法国的首都是什么")]
    docs += [(1010, "今天你知道法国的首都是什么吗？我不知道")]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, docs), items).where("exact").collect())
    assert got == sorted([(d, d % 10) for d, _ in docs if d < 100] + [(1010, 1)])
    numbers = spark.createDataFrame([(7, "12 + 30")], "item_id long, text string")  # no templates at all
    got = decontaminate.contaminated(docs_of(spark, docs), numbers).collect()
    assert sorted((r["doc_id"], r["item_id"], r["exact"]) for r in got) == [(k, 7, True) for k in (3, 13, 23)]


def brute_padding(hist, k):
    import itertools

    lens = sorted(hist)
    best = math.inf
    for r in range(1, min(k, len(lens)) + 1):
        for inner in itertools.combinations(lens[:-1], r - 1):
            bounds = [*inner, lens[-1]]
            best = min(best, sum(c * (next(b for b in bounds if b >= n) - n) for n, c in hist.items()))
    return best


def test_packing_plan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        hist = {int(n): int(c) for n, c in zip(rng.choice(60, 9, replace=False) + 1, rng.integers(1, 9, 9), strict=True)}
        k = int(rng.integers(1, 5))
        plan = packing.optimal_buckets(hist, k)
        pad = sum(c * (next(b for b in plan.bounds if b >= n) - n) for n, c in hist.items())
        assert pad == plan.padding == brute_padding(hist, k) and len(plan.bounds) <= k
    assert packing.optimal_buckets({}, 3).bounds == []


def test_packing(spark):
    lengths = spark.createDataFrame([(i, int(n)) for i, n in enumerate(np.random.default_rng(2).integers(0, 90, 300))] + [(7, 25), (None, 31)], "doc_id long, n_tokens long")
    rows = packing.pack(lengths, max_len=32, n_buckets=3, batch_tokens=100).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(r["n_tokens"] for r in lengths.collect())
    assert all(0 < r["n_tokens"] <= r["bucket_len"] <= 32 and r["padding"] == r["bucket_len"] - r["n_tokens"] for r in rows)
    slots = Counter((r["bucket_len"], r["batch"], r["slot"]) for r in rows)
    assert set(slots.values()) == {1}
    per_batch = Counter((r["bucket_len"], r["batch"]) for r in rows)
    assert all(n * b <= 100 for (b, _), n in per_batch.items())
    for b in {r["bucket_len"] for r in rows}:
        n = sum(1 for r in rows if r["bucket_len"] == b)
        assert sum(1 for x in per_batch if x[0] == b) == -(-n // (100 // b))
    assert packing.pack(lengths.limit(0)).count() == 0


def test_token_parts(sample):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_path())
    model.encode_special_tokens = True
    hard = ["a  b   c", "x\n \n y", " lead", "trail ", "\t\ta <|endoftext|> b", "é  ü   z", "1\n\n2 3's don't", "", "a b   c"]
    hard += ["a 　 b c", "日本 語 です   x", " ", "  ", "x \u0085 y", "a\u3000 b", "« a »", "\U0001f600 a \U0001f600", " tail\n", "word " * 50_000, "語" * 3000]
    texts = hard + [t or "" for _, t in sample[:60]]
    column = pa.array([t.encode() for t in texts], pa.binary())
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        own = tokens.Encoder(tokens.default_path(name))
        for _ in range(2):
            got = [ids[a:b].tolist() for _, ids, ends in own.texts(column) for a, b in zip(ends, ends[1:], strict=False)]
            assert got == want and own.lengths(column).tolist() == [len(w) for w in want]
        own.forget(list(own.known)[5:40])
        assert own.lengths(column).tolist() == [len(w) for w in want]


def test_token_runs(monkeypatch):
    """Rows come in runs of bounded parts, each row once and in order."""
    monkeypatch.setattr(tokens, "RUN_PARTS", 5)
    texts = ["", "a b c", "d e", "", "f " * 40, "g", "", "h i j k l", "", ""]
    runs = list(tokens.Encoder(tokens.default_path()).texts(pa.array([t.encode() for t in texts], pa.binary())))
    assert [i for i, _, _ in runs] == [0, 4, 5, 7] and sum(len(ends) - 1 for _, _, ends in runs) == len(texts)
    whole = tokens.Encoder(tokens.default_path())
    want = [whole.encode([t])[0] for t in texts]
    assert [ids[a:b].tolist() for _, ids, ends in runs for a, b in zip(ends, ends[1:], strict=False)] == want


def test_token_parts_fine():
    """Words apart from signs and line ends share one part, and parts still give
    the ids of whole texts, over characters that meet in every way."""
    from tokenizers import Tokenizer

    cut = lambda t: np.split(np.frombuffer(t.encode(), np.uint8), tokens.part_starts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), True)[1:])
    assert [p.tobytes().decode() for p in cut("the cat, été.\nThe cat\nÉté! don't")] == ["the", " cat", ",", " été", ".\n", "The", " cat", "\n", "Été", "!", " don", "'t"]
    rng = np.random.default_rng(11)
    atoms = [*"abTs.,'\n \t\r\x0b\x1c1!_", "\n", " ", "é", "É", "×", "÷", "ÿ", "\u0301", "\u00a0", "\u0085", "\u2003", "語", "'s", "'ll", "²", "ß", "\x00", "\x7f", "\U0001f600"]
    texts = ["".join(rng.choice(atoms, rng.integers(1, 24))) for _ in range(4000)]
    model = Tokenizer.from_file(tokens.default_path())
    model.encode_special_tokens = True
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    column = pa.array([t.encode() for t in texts], pa.binary())
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        own = tokens.Encoder(tokens.default_path(name), 500, 4000)  # forgets often
        got = [ids[a:b].tolist() for _, ids, ends in own.texts(column) for a, b in zip(ends, ends[1:], strict=False)]
        assert got == want


def test_token_lengths(spark):
    """Null, empty, repeated rows, clashing columns, no rows."""
    got = tokens.token_lengths(docs_of(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")], True), tokens.default_path()).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert tokens.token_lengths(docs_of(spark, []), tokens.default_path()).count() == 0


def test_token_counts(spark):
    lens = [0, 3, 3, 5, 5000, 9000, 9000]
    sums = token_counts.suffix_sums(token_counts.histogram(spark.createDataFrame([(x,) for x in lens], "n_tokens long")))
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["docs_ge"] == sum(x >= n for x in lens) and r["tokens_ge"] == sum(x for x in lens if x >= n)
        assert r["kept_tokens"] == sum(min(x, n) for x in lens) and r["total_tokens"] == sum(lens)
        assert r["quantile"] == pytest.approx(sum(x <= n for x in lens) / len(lens))
    got = {r["context_limit"]: (r["kept_tokens"], r["cut_docs"]) for r in token_counts.answers(sums, [1, 4, 6000, 10000]).collect()}
    assert got == {c: (sum(min(x, c) for x in lens), sum(x > c for x in lens)) for c in (1, 4, 6000, 10000)}


def test_id_coder():
    rng = np.random.default_rng(5)
    for k in range(30):
        ids = rng.integers(0, rng.choice([1, 2, 300, 65_537, 1 << 32]), rng.choice([0, 1, 2, 511, 512, 513, 700, 3000])).astype(np.uint32)
        assert np.array_equal(id_coder.decode(id_coder.encode(ids)), ids), k
    skewed = np.minimum(rng.geometric(0.001, 50_000), 60_000).astype(np.uint32)
    sure = np.where(rng.random(50_000) < 0.0005, 7, 3).astype(np.uint32)  # long runs of narrow ranges: carries
    for ids in (skewed, sure, np.full(5000, (1 << 32) - 1, np.uint32)):
        assert np.array_equal(id_coder.decode(id_coder.encode(ids)), ids)
    same = np.tile(np.arange(50, dtype=np.uint32), 2000)
    assert len(id_coder.encode(same)) * 8 < 0.5 * len(same)


def test_id_coder_blocks(monkeypatch):
    """A file has no short block after whole ones, and its blocks give its ids back."""
    monkeypatch.setattr(id_coder, "BLOCK_IDS", 1000)
    rng = np.random.default_rng(8)
    for n, want in ((0, []), (1, [1]), (1500, [1500]), (1501, [750, 751]), (2000, [1000, 1000]), (2100, [1000, 1100]), (5600, [1000] * 4 + [800, 800])):
        ids, f = rng.integers(0, 300, n).astype(np.uint32), io.BytesIO()
        out = token_files.Writer(f)
        for part in np.array_split(ids, 7):
            out.add(np.arange(1), np.array([len(part)]), part)
        out.close()
        got = list(token_files.blocks(f, "memory"))
        assert [len(b) for b in got] == want and np.array_equal(np.concatenate([np.zeros(0, np.uint32), *got]), ids), n


def test_id_coder_size(spark, sample):
    """Fewer bits than the order-0 entropy of the ids and than zstandard on 16-bit ids."""
    encode = tokens.Encoder(tokens.default_path())
    ids = np.concatenate([x for _, x, _ in encode.texts(pa.array([(t or "").encode() for _, t in sample], pa.binary()))])
    bits = 8 * len(id_coder.encode(ids)) / len(ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert bits < -(share * np.log2(share)).sum()
    assert bits < 8 * len(zstd.compress(ids.astype("<u2").tobytes(), 3)) / len(ids)


def test_token_files(spark, sample, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(id_coder, "BLOCK_IDS", 5000)  # in this process; a long text goes over blocks in any case
    data = [*sample[:60], (900001, None), (900002, ""), (900003, "x  y"), (None, "null id"), (900002, "again"), (900004, "ab " * 1_000_000), (900005, "x"), (900005, "x")]
    model = Tokenizer.from_file(tokens.default_path())
    manifest = token_files.write(docs_of(spark, data, True), shared_dir(spark, "t"))
    got = token_files.read(manifest).collect()
    hashed = lambda t: 42 if t is None else ((xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64) - 2**63
    want, at = [], 0
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, hashed(x[1]))):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda x: (x[0] is not None, x)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    path = max(manifest.collect(), key=lambda r: r["n_ids"])["path"]
    raw = bytearray(open(path.removeprefix("file://"), "rb").read())
    raw[len(raw) // 2] ^= 255
    open("/tmp/tessera-damaged.bin", "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_files.read_file("/tmp/tessera-damaged.bin"))
    assert token_files.read(token_files.write(docs_of(spark, []), shared_dir(spark, "t"))).count() == 0


def test_op9_query(spark, sf_dir):
    """The registered query over the whole table."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.default_path())
    model.encode_special_tokens = True
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for (i, _), e in zip(docs, model.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.op9_token_files(spark, sf_dir).collect()) == want


def test_html_marks():
    """Attributes that only look like a mark, and wrappers of the article, drop nothing."""
    body = "".join(f"<p>Sentence {i} of the article, which tells what happened then and there.</p>" for i in range(8))
    want = " ".join(f"Sentence {i} of the article, which tells what happened then and there." for i in range(8))
    side = "<ul><li><a href=x>More</a></li></ul>"
    for attrs in ('style="overflow: hidden"', 'data-id="ad-12"', "class=has-sidebar", 'class="page no-sidebar"', 'class="side-by-side"', "class='social-science'", 'title="a hidden role=banner"', 'class="withSidebar"'):
        assert html_text.extract(f"<body><div {attrs}>{body}</div></body>") == want, attrs
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f'<div class="content">{body}</div>'):
        for aside in (f'<div class="sidebar">{side}</div>', f"<aside>{side}</aside>"):
            assert html_text.extract(f'<body><div class="content-sidebar-wrap">{inner}{aside}</div></body>') == want
    long = "<p>A remark of a reader that goes on for a while, and for longer than the article.</p>" * 12
    for attrs in ("hidden", 'class="sidebar"', 'id="comments"', "aria-hidden=true", 'class="ad-wrapper"', "role=navigation", 'class="social-links"', 'class=x hidden=""'):
        assert html_text.extract(f"<body><div>{body}</div><div {attrs}>{long}</div></body>") == want, attrs
    assert html_text.extract(f'<body><div>{body}</div><div class="comments"><article>{long}</article></div></body>') == want


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "z" * 30_000, "é" * 9000, "<p>b</p>"]
    pages = spark.createDataFrame([(10 - i, f"http://x/{i}", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, sha int")
    got = {r["page_id"]: r for r in warc.read(warc.write(pages, shared_dir(spark, "w"), segment_bytes=1000)).collect()}
    for i, h in enumerate(html):
        b = (h or "").encode()
        first = min(10 - j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = got[10 - i]
        assert r["payload_bytes"] == len(b) and r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == 10 - i else ("revisit", first))
        assert r["payload"] is None or bytes(r["payload"]) == b
    assert warc.read(warc.write(pages.limit(0), shared_dir(spark, "w"))).count() == 0
    assert warc.dechunked(warc.chunked(b"x" * 10_001)) == b"x" * 10_001
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabcdXX0\r\n\r\n")


def test_warc_repeated_ids(spark):
    """Rows that share an id or have none, in different tasks, and a payload of 2 MB."""
    texts = [c * 30_000 for c in "abcdabcd"] + [c * 30_000 for c in "efgefg"] + ["x", "x", "long " * 400_000]
    rows = [(7 if i < 8 else None if i < 14 else i, "u", t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = warc.read(warc.write(pages, shared_dir(spark, "w"))).collect()
    want = Counter((i, len(t), "revisit" if i == 15 else "response", 14 if i == 15 else None) for i, _, t in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == want


def test_warc_missing_segment(spark):
    rows = [(1, "u", "r", "response", "D", None, 1, None, None, b"ab"), (None, "u", "r", "continuation", None, None, 3, 6, None, b"ef")]
    segs = spark.createDataFrame(rows, warc._ROW)
    with pytest.raises(Exception, match="missing"):
        warc.reassembled(segs).collect()


def test_html():
    page = (
        '<html><body><header><a href="/">Home</a></header><div id="main-menu"><a>x</a></div><div class="sidebar"><p>Side</p></div><div id="content"><h1>Title</h1>'
        '<div class="post"><p>First &amp; some <b>bold</b>text, quite long to be dense enough.<p>Second<br>line.<ul><li>one<li>two</ul></div>'
        '<div class="comments"><p>I like this</p></div></div><form><label>Search</label></form><script>var a="<p>no</p>";</script><div class="cookie-notice">ok</div><footer>c</footer></body></html>'
    )
    assert html_text.extract(page) == "Title First & some boldtext, quite long to be dense enough. Second line. one two"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x</script>") == ""
    assert html_text.extract("plain &lt;t&gt;  only") == "plain <t> only"
    assert html_text.extract("<p>a<p>b") == "a b"
    assert html_text.extract("<div " * 3000) is not None
    links = "<p><a href=a>One source</a>, <a href=b>another source</a> and <a href=c>a third one</a>.</p>"
    assert html_text.extract(f"<article><p>{'A sentence of the article. ' * 9}</p>{links}<p>Its end.</p></article>").endswith("One source, another source and a third one. Its end.")
    body = "A sentence that the article has. " * 8
    for attrs in ('style="overflow:hidden"', 'class="layout with-sidebar"', 'class="post no-comments"', 'data-id="ad-7"', 'title="class=menu"'):
        assert html_text.extract(f"<html><body><div {attrs}><p>{body}</p></div></body></html>") == body.strip()


def test_html_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = html_text.main_text(pages.selectExpr("*", "1 AS text")).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in got)
    for r in got:
        assert "track(" not in r["text"] and "&amp;" not in r["text"]


def brute_kneser_ney(toks, order):
    """P(word, history) by plain counting over the training texts, and the counts."""
    grams, uni = Counter(), Counter()
    for w in toks:
        uni.update(w)
        x = ["<s>", "<s>", *w]
        grams.update((x[i] if order == 3 else "", x[i + 1], x[i + 2]) for i in range(len(w)))
    count = lambda c: [sum(x == k for x in c) for k in (1, 2, 3, 4)]
    pairs = Counter()
    for (_, v, w), c in grams.items():
        pairs[v, w] += 1 if order == 3 else c
    cont = Counter(w for _, w in pairs)
    d3, d2, d1 = (kneser_ney.discounts(count(c.values())) for c in (grams, pairs, cont))
    t3, g3, t2, g2 = Counter(), Counter(), Counter(), Counter()
    for (u, v, _), c in grams.items():
        t3[u, v] += c
        g3[u, v] += d3[min(c, 3)]
    for (v, _), c in pairs.items():
        t2[v] += c
        g2[v] += d2[min(c, 3)]
    rest = sum(d1[min(c, 3)] for c in cont.values()) / len(pairs) / (len(uni) + 1)

    def prob(u, v, w):
        p = max(cont[w] - d1[min(cont[w], 3)], 0) / len(pairs) + rest
        if t2[v]:
            p = max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / t2[v] + g2[v] / t2[v] * p
        if order == 3 and t3[u, v]:
            p = max(grams[u, v, w] - d3[min(grams[u, v, w], 3)], 0) / t3[u, v] + g3[u, v] / t3[u, v] * p
        return p

    return prob, uni


@pytest.mark.parametrize(("order", "dealt"), [(2, False), (3, False), (3, True)])
def test_kneser_ney(spark, sample, order, dealt):
    """Against brute force; also with frequent words dealt over the shards."""
    data = [*sample[:80], (70001, None), (70002, ""), (70003, "The the THE"), (70003, "The the THE"), (None, "a b"), (70009, "na " * 3000)]
    df = docs_of(spark, data, True).selectExpr("doc_id", "coalesce(doc_id % 5 = 1, false) AS held_out", "cast(coalesce(text, '') AS binary) AS t")
    toks = [(i, [*(t or "").encode().lower().split(), b"</s>"]) for i, t in data]
    train = [w for i, w in toks if i is None or i % 5 != 1]
    hot = None
    if dealt:
        often = [w for w, _ in Counter(x for w in train for x in w).most_common(40)]
        raw = np.frombuffer(b" ".join(w for w in often if w != b"</s>"), np.uint8)
        hot = [1, *{int(x) for x in kneser_ney.tokens(raw, np.array([0, len(raw)]))[0]} - {2}]
    rows = kneser_ney.score(df, kneser_ney.train(df.where("NOT held_out").select("t"), order, hot)).collect()
    prob, uni = brute_kneser_ney(train, order)
    n, v = sum(uni.values()), len(uni)
    want = []
    for i, w in toks:
        x = ["<s>", "<s>", *w]
        score = sum(math.log10(prob(x[k] if order == 3 else "", x[k + 1], x[k + 2])) for k in range(len(w)))
        want.append((i or -1, len(w), sum(uni[x] > 0 for x in w), score, sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["score"], r["base_score"]) for r in rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    assert {r["train_tokens"] for r in rows} == {n}
    for history in ((b"the", b"the"), ("<s>", b"a"), (b"?", b"?")):
        assert sum(prob(*history, w) for w in [*uni, b"?"]) == pytest.approx(1)


def test_kneser_ney_frequent(spark):
    """The sample names a word that fills the texts."""
    texts = docs_of(spark, [(i, "same " * 40 + f"w{i}") for i in range(2000)]).selectExpr("cast(text AS binary) AS t")
    raw = np.frombuffer(b"same", np.uint8)
    assert int(kneser_ney.tokens(raw, np.array([0, 4]))[0][0]) in kneser_ney.frequent_words(texts, 4)


def test_kneser_ney_untrained(spark):
    df = docs_of(spark, [(1, "a b")]).selectExpr("doc_id", "true AS held_out", "cast(text AS binary) AS t")
    r = kneser_ney.score(df, kneser_ney.train(df.limit(0).select("t"))).first()
    assert (r["n_tokens"], r["n_known"], r["score"]) == (3, 0, 0.0)


def test_word_hashes():
    texts = [b"", b" a\x0bB a", b"b\x1cc", "é É".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    h, bounds = word_hashes(data, offs)
    words = [w for t in texts for w in t.lower().split()]
    assert len(h) == len(words) and np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    assert len(set(h.tolist())) == len(set(words))
    for piece in (1, 3, 4):  # long texts are read in pieces
        again, cuts = word_hashes(data, offs, piece)
        assert again.tolist() == h.tolist() and cuts.tolist() == bounds.tolist()
    long = np.frombuffer(b"ab cde " * 1_000_000 + b"x" * 5_000_000, np.uint8)
    h, bounds = word_hashes(long, np.array([0, len(long)]))
    assert bounds.tolist() == [0, 2_000_001] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("name", ["op2_warc", "op8_minhash_near_dup", "op10_quality_rules", "op11_importance_resampling", "op12_prefix_trie", "op13_ngram_jaccard_join"])
def test_sql(spark, sf_dir, name):
    """The registered queries against their SQL."""
    import duckdb
    from tessera.llm import registry

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in docs[i] for i in kept for b in bench)
    sets = brute_components([(i, docs[i]) for i in sorted(kept)], 5)
    assert all(i == c for i, (_, c) in sets.items())
