"""Benchmark decontamination by templates, in DataFrame operations only.

A text becomes a template: numbers (with a unit or currency, if any) and
capitalised names inside a sentence become typed placeholders, the rest
lower-case words. Documents whose windows of WINDOW template tokens equal
windows of a benchmark item, on one diagonal (same distance between the two
places), are hits: all windows of the item or at least MIN_WINDOWS. A question
asked again with other numbers or names has the same template; its hit counts
if the substitution is consistent: on the diagonal every value of the item
always stands for one value of the document, and different names for different
ones. An item is searched as it stands at the start of a sentence and inside one.

Scale: the item windows are broadcast while there are at most BROADCAST_WINDOWS
(24 bytes each) and shuffled otherwise; documents are read and cut into tokens
once for windows of all lengths, windows are made and probed inside the scan's
stage, and only hits are shuffled, after a partial aggregation. Items with equal templates and values are probed once. A
document is read again only if a hit window has placeholders.

Templates have at least MIN_TOKENS tokens and windows of MIN_WORDS words. Items
of which they may miss an exact copy (short or mostly numeric ones, scripts
without spaces) are also searched whole by their exact words, numbers and signs,
from least_exact of them on: shorter ones would mark every text that has the word.
If there are such items, the documents are read once more. uncovered() lists the
items that are too short for either search.

Defined results: null and empty texts have no window and no hit. An item with
fewer than WINDOW tokens is searched as one window of its own length. Repeated
rows of an item each get their hits; rows that repeat a doc_id and its text are
one document, different texts under one doc_id are judged apart and a null doc_id
is an id. Columns besides the named ones are not read. A very long text is one
row of token arrays, some 30 bytes for each byte of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

WINDOW, MIN_WINDOWS, MIN_TOKENS, MIN_WORDS, MIN_EXACT = 8, 5, 4, 3, 3
BROADCAST_WINDOWS = 2_000_000

#: Units of measure that belong to the number before them.
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|s|sec|min|h|hr|hours|minutes|seconds|days|weeks|months|years|miles|feet|ft|inches|in|percent|%|dollars|euros|pounds|usd|eur|gbp|°c|°f|mph|kmh|kw|w|v|hz|mb|gb"
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
#: A capitalised word with a small letter in it; O'Brien and Anna-Maria are one, the ending 's is none of it.
_CAPITAL = r"\p{Lu}(?=[\p{Lu}'’-]*+\p{Ll})[\p{L}\p{M}]*+(?:(?:-|['’](?!s\b))[\p{L}\p{M}]++)*+"
#: What a token can be, the first that fits; only a name begins with a space. Repeats are possessive: no backtracking, no recursion.
KINDS = (
    rf"\$ ?{_NUMBER}",
    rf"\b{_NUMBER} ?(?:(?i:{UNITS})\b|%)",
    rf"\b{_NUMBER}\b",
    rf"(?<=[\p{{Ll}},;]) {_CAPITAL}(?: {_CAPITAL})*+",
    r"[\p{L}\p{M}]++",
)


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens(text: str, values: bool) -> str:
    """SQL for the array of template tokens of a text column; with values, a
    placeholder carries what it stands for (numbers without units). Both arrays
    come from the same pieces, so they have the same places."""
    pieces = f"regexp_extract_all(translate(coalesce({text}, ''), '€£', '$$'), {_sql('|'.join(KINDS))}, 0)"
    number = "CASE WHEN startswith(x, '$') OR NOT x rlike '[0-9]$' THEN '⟨q{0}⟩' ELSE '⟨n{0}⟩' END"
    if values:
        name = "concat('⟨p·', lower(ltrim(x)), '⟩')"
        number = f"replace({number.format('·')}, '·', concat('·', regexp_extract(x, {_sql(_NUMBER)}, 0)))"
    else:
        name, number = "'⟨p⟩'", number.format("")
    # Letters come after ':' in byte order, digits, '$' and the space before it.
    return f"transform({pieces}, x -> CASE WHEN x >= ':' THEN lower(x) WHEN startswith(x, ' ') THEN {name} ELSE {number} END)"


_WORDS = "size(filter(slice(tok, i + 1, {n}), x -> NOT startswith(x, '⟨')))"


#: Scripts without spaces between words: a token is one character.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"


def exact_tokens(text: str) -> str:
    """SQL for the array of lower-case words, numbers and single signs of a text
    column: the same for a passage whatever stands around it."""
    word = rf"[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]++|\p{{N}}++|[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]"
    return f"regexp_extract_all(lower(coalesce({text}, '')), {_sql(word)}, 0)"


def _hashes(n: int) -> str:
    """SQL for the hashes of all windows of n tokens of tok."""
    parts = ", ".join(f"h[i + {k}]" for k in range(n))
    return f"CASE WHEN size(h) >= {n} THEN transform(sequence(0, size(h) - {n}), i -> xxhash64({parts})) ELSE array() END"


def windows_of(texts: DataFrame, sizes: list) -> DataFrame:
    """(id, n, at, w) of the windows of each size n of texts(id, tok), in one
    pass. The outer form of explode keeps the planner from adding a filter that
    repeats the whole expression of the array."""
    hashed = texts.selectExpr("id", "transform(tok, x -> xxhash64(x)) AS h")
    if len(sizes) == 1:
        return hashed.selectExpr("id", f"posexplode_outer({_hashes(sizes[0])}) AS (at, w)").withColumn("n", F.lit(sizes[0]))
    # Window hashes of all sizes one after another; the place in the row tells size and position.
    rows = hashed.selectExpr("id", "size(h) AS len", f"posexplode_outer(concat({', '.join(_hashes(n) for n in sizes)})) AS (at, w)")
    size, at, before = "CASE", "CASE", "0"
    for n in sizes:
        end = f"{before} + greatest(len - {n - 1}, 0)"
        size, at, before = f"{size} WHEN at < {end} THEN {n}", f"{at} WHEN at < {end} THEN at - ({before})", end
    return rows.selectExpr("id", f"{size} END AS n", f"{at} END AS at", "w")


def _exact(docs: DataFrame, items: DataFrame, window: int, least_exact: int) -> DataFrame | None:
    """(doc_id, item, n_windows, item_windows, exact) of the whole copies of items(item,
    t) in docs(id, t), by all windows of their exact tokens; None without items."""
    own = items.selectExpr("item", f"{exact_tokens('t')} AS tok").where(f"size(tok) >= {max(1, least_exact)}")
    own = written(own.selectExpr("item", "tok", f"least(size(tok), {window}) AS n", "xxhash64(tok) AS tid"), "bench-exact")
    sizes = sorted(r[0] for r in own.select("n").distinct().collect())  # at most `window` numbers
    if not sizes:
        return None
    kinds = own.select("tid", "n", "tok").distinct()
    keys = [windows_of(kinds.where(F.col("n") == n).selectExpr("tid AS id", "tok"), [n]) for n in sizes]
    for k in keys[1:]:
        keys[0] = keys[0].unionByName(k)
    keys = written(keys[0].selectExpr("id AS tid", "n", "at AS ipos", "w"), "bench-exact-windows")
    few = keys.count() <= BROADCAST_WINDOWS
    total = keys.groupBy("tid").agg(F.count("*").alias("item_windows"))
    keys = keys.join(total, "tid")
    found = windows_of(docs.selectExpr("id", f"{exact_tokens('t')} AS tok"), sizes).join(F.broadcast(keys) if few else keys, ["n", "w"])
    # All places of an item of one window are one hit.
    found = found.selectExpr("id AS doc_id", "tid", "IF(item_windows = 1, 0, at - ipos) AS diagonal", "ipos", "item_windows")
    runs = found.groupBy("doc_id", "tid", "diagonal", "item_windows").agg(F.count_distinct("ipos").alias("n_windows")).where("n_windows = item_windows")
    return runs.select("doc_id", "tid", "n_windows", "item_windows").distinct().join(own.select("tid", "item"), "tid").drop("tid").withColumn("exact", F.lit(True))


def _rows(hits: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item of hits(doc_id, item, ...)."""
    best = hits.groupBy("doc_id", "item").agg(F.max(F.struct("n_windows", "item_windows")).alias("n"), F.bool_or("exact").alias("exact"))
    return best.join(items.select("item", "item_id"), "item").select(F.col("doc_id").alias("row"), "item_id", "n.*", "exact")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_windows: int = MIN_WINDOWS,
    least_exact: int = MIN_EXACT,
) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, exact) of each hit; exact: the
    document has the item's own values everywhere on the diagonal."""
    found = contaminated_rows(docs, benchmark, id_col, text_col, item_col, item_text_col, window, min_windows, least_exact)
    best = found.groupBy("row.id", "item_id").agg(F.max(F.struct("n_windows", "item_windows")).alias("n"), F.bool_or("exact").alias("exact"))
    return best.select(F.col("id").alias("doc_id"), "item_id", "n.*", "exact")


def row_key(id_col: str, text_col: str):
    """What tells documents apart: the id and a hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = WINDOW, min_windows: int = MIN_WINDOWS, least_exact: int = MIN_EXACT) -> DataFrame:
    """(row, item_id, n_windows, item_windows, exact), row: the row_key."""
    docs = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("t"))
    id_col, text_col = "row", "t"
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t"))
    items = written(items, "bench-items")
    # Inside a sentence the capitalised words an item begins with are a name: a second form.
    forms = items.select("item", F.posexplode(F.array("t", F.expr("concat(', ', ltrim(t))"))).alias("inside", "t"))
    forms = forms.selectExpr("item", "inside", f"{tokens('t', False)} AS tok", f"{tokens('t', True)} AS iv").where(f"size(tok) >= {MIN_TOKENS}")
    forms = forms.groupBy("item", "tok", "iv").agg(F.max("inside").alias("inside"))
    forms = written(forms.selectExpr("item", "inside", "tok", "iv", "xxhash64(iv) AS tid"), "bench-forms")
    # Templates with equal values are probed once: with other values, other substitutions are consistent.
    kinds = forms.select("tid", "tok", "iv").distinct().selectExpr("tid AS id", "tok", "iv")
    sizes = sorted(r[0] for r in kinds.select(F.least(F.size("tok"), F.lit(window))).distinct().collect())  # at most `window` numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).selectExpr("id", f"{tokens('t', False)} AS tok")

    hits, probes, inner = None, None, None
    if sizes:
        keys = None
        for n in sizes:
            own = kinds.where(F.least(F.size("tok"), F.lit(window)) == n)
            one = own.selectExpr("id", "tok", "transform(tok, x -> xxhash64(x)) AS h").selectExpr("id", "tok", f"posexplode_outer({_hashes(n)}) AS (i, w)")
            one = one.selectExpr("id AS tid", f"{n} AS n", "i AS ipos", "w", f"{_WORDS.format(n=n)} AS words", f"exists(slice(tok, i + 1, {n}), x -> startswith(x, '⟨')) AS slots", f"i > 0 AND i + {n} < size(tok) AS free")
            one = one.where(f"w IS NOT NULL AND words >= {min(n, MIN_WORDS)}").drop("words")
            keys = one if keys is None else keys.unionByName(one)
        keys = written(keys, "bench-windows")
        few = keys.count() <= BROADCAST_WINDOWS
        probe = keys.drop("free")
        found = windows_of(texts, sizes).join(F.broadcast(probe) if few else probe, ["n", "w"])
        hits = found.selectExpr("id AS doc_id", "tid", "at - ipos AS diagonal", "ipos", "slots", "n")
        # free: windows without the tokens that a neighbour of the item can change.
        probes = keys.groupBy("tid").agg(F.count("*").alias("item_windows"))
        inner = keys.where("free").groupBy("tid").agg(F.count("*").alias("free"))

    # Items of which the template may miss an exact copy are searched by their exact tokens too.
    left = items.select("item", "t")
    if hits is not None:
        sure = forms.where("inside = 1").join(inner.where(f"free >= {min_windows}"), "tid")
        left = left.join(sure, "item", "left_anti")
    copies = _exact(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), left, window, least_exact)
    if hits is None and copies is not None:
        return _rows(copies, items)
    if hits is None:
        return docs.sparkSession.createDataFrame([], f"row {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}, n_windows long, item_windows long, exact boolean")

    runs = hits.groupBy("doc_id", "tid", "diagonal", "n").agg(F.count_distinct("ipos").alias("n_windows"), F.collect_set(F.when(F.col("slots"), F.col("ipos"))).alias("slots"))
    runs = written(runs.join(probes, "tid").where(f"n_windows >= least(item_windows, {min_windows})"), "bench-hits")

    # Values of the placeholders, for hits that have any.
    asked = runs.where("size(slots) > 0").select("doc_id", "tid", "diagonal", "n", F.explode("slots").alias("ipos"))
    theirs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(asked.select("doc_id").distinct(), "doc_id", "left_semi").selectExpr("doc_id", f"{tokens('t', True)} AS dv")
    ours = kinds.selectExpr("id AS tid", "iv")
    cells = asked.selectExpr("doc_id", "tid", "diagonal", "explode(sequence(ipos, ipos + n - 1)) AS i").distinct()
    cells = cells.groupBy("doc_id", "tid", "diagonal").agg(F.collect_list("i").alias("at")).join(ours, "tid").join(theirs, "doc_id")
    pairs = cells.selectExpr("doc_id", "tid", "diagonal", "explode_outer(filter(transform(at, i -> struct(iv[i] AS iv, get(dv, i + diagonal) AS dv, i = 0 AS first, i = size(iv) - 1 AS last)), p -> startswith(p.iv, '⟨'))) AS p").where("p IS NOT NULL")
    # A name at an edge of the item may have run into a name beside it.
    pairs = pairs.withColumn("p", F.expr("struct(p.iv, IF(p.first AND endswith(p.dv, concat(' ', substr(p.iv, 4))) OR p.last AND startswith(p.dv, concat(rtrim('⟩', p.iv), ' ')), p.iv, p.dv) AS dv)"))
    slots = pairs.groupBy("doc_id", "tid", "diagonal", "p.iv").agg(F.count_distinct("p.dv").alias("c"), F.bool_and(F.expr("p.iv <=> p.dv")).alias("same"))
    # Names are told apart: two of the item's don't stand for one of the document's.
    names = pairs.where("startswith(p.iv, '⟨p·') AND p.dv IS NOT NULL").groupBy("doc_id", "tid", "diagonal", "p.dv").agg(F.count_distinct("p.iv").alias("c"))
    slots = slots.drop("iv").unionByName(names.select("doc_id", "tid", "diagonal", "c", F.lit(True).alias("same")))
    slots = slots.groupBy("doc_id", "tid", "diagonal").agg(F.max("c").alias("c"), F.bool_and("same").alias("same"))

    good = runs.join(slots, ["doc_id", "tid", "diagonal"], "left").where("c IS NULL OR c = 1")
    best = good.groupBy("doc_id", "tid").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.bool_or(F.coalesce("same", F.lit(True))).alias("exact"))
    best = best.join(forms.select("tid", "item"), "tid").drop("tid")
    return _rows(best if copies is None else best.unionByName(copies), items)


def uncovered(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_exact: int = MIN_EXACT) -> DataFrame:
    """(item_id, text) of the items that neither search covers."""
    x = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    return x.where(f"size({tokens('text', False)}) < {MIN_TOKENS} AND size({exact_tokens('text')}) < {max(1, least_exact)}")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without a hit."""
    found = contaminated_rows(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    at = "_hit_row"
    while at in docs.columns:
        at += "_"
    return docs.withColumn(at, row_key("doc_id", "text")).join(found.select(F.col("row").alias(at)).distinct(), at, "left_anti").select(*docs.columns)
