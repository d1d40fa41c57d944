"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one row, so there is no shuffle and
no user function; a hot source or very long text changes nothing in the plan.

Defined results: a null text is the empty text; a text without words has zeros
everywhere and fails `base`. Repeated rows are judged each on their own. Only
`id_col` and `text_col` are read, so other columns may have any name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German, Spanish,
#: Italian, Portuguese, Dutch, Swedish, Polish and Russian. A text without any is
#: in none of these languages, and is left to the language stage.
STOP_WORDS = (
    "the and of to in is that for with was it this are from "
    "le la les des et que qui dans pour sur une du "
    "der die das und ist von mit nicht den ein eine zu "
    "el los las de y en un por con para del se "
    "il di che non per una sono della nel gli "
    "os não uma com mais dos como foi ao "
    "het een van niet dat op te zijn voor met "
    "och att det som på är av för inte "
    "nie się na jest że to do jak "
    "не на что как это по но из он"
).split()


class Rule(NamedTuple):
    """A document of at least min_words words passes if low <= measure <= high, or
    if the measure is 0 and `or_none`."""

    name: str
    measure: str
    low: float | None
    high: float | None
    min_words: int = 0
    or_none: bool = False


#: The production table. Measures are SQL over the columns made by measures().
RULES = (
    Rule("words", "n_words", 10, None),
    Rule("repeated_windows", "n_repeat_words / n_words", None, 0.20),
    Rule("mean_word_chars", "word_chars / n_words", 2, 25),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("shouts_per_word", "n_shouts / n_words", None, 0.30),
    Rule("stop_words", "n_stop / n_words", 0.01, None, 60, True),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.50),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.50),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.90),
)

_WS = r"\\x20\\x09-\\x0D"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """id and the measures that rules can name."""
    stops = ", ".join(f"'{w}'" for w in stop_words)
    one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    two = one.selectExpr(
        "doc_id",
        f"filter(split(t, '[{_WS}]+'), w -> w != '') AS words",
        f"filter(split(t, '\\n'), x -> x rlike '[^{_WS}]') AS lines",
        "length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) AS n_symbols",
        "length(t) - length(replace(t, '!', '')) AS n_shouts",
    )
    three = two.selectExpr("*", "transform(words, w -> xxhash64(w)) AS h")
    four = three.selectExpr(
        "*",
        "CASE WHEN size(h) > 5 THEN transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])) ELSE array() END AS win",
    )
    # The sorted array of (window hash, place) brings equal windows together; only texts that repeat one get that far.
    five = four.selectExpr(
        "*",
        "CASE WHEN size(win) > size(array_distinct(win)) THEN array_sort(transform(win, (x, i) -> struct(x AS x, i AS i))) END AS s",
    )
    six = five.selectExpr(
        "*",
        "CASE WHEN s IS NOT NULL THEN sort_array(transform(filter(s, (v, k) -> (k > 0 AND s[k - 1].x = v.x) OR (k + 1 < size(s) AND s[k + 1].x = v.x)), v -> v.i)) END AS p",
    )
    return six.selectExpr(
        "doc_id",
        "CAST(size(words) AS BIGINT) AS n_words",
        "CAST(length(array_join(words, '')) AS BIGINT) AS word_chars",
        "CAST(n_symbols AS BIGINT) AS n_symbols",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        "CASE WHEN p IS NULL THEN 0L ELSE aggregate(p, named_struct('n', 0L, 'e', 0), (a, i) -> named_struct('n', a.n + i + 5 - greatest(a.e, i), 'e', i + 5), a -> a.n) END AS n_repeat_words",
        "CAST(n_shouts AS BIGINT) AS n_shouts",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        f"CAST(size(filter(words, w -> rtrim('.,;:?', lower(w)) IN ({stops}))) AS BIGINT) AS n_stop",
        "CAST(size(filter(lines, x -> endswith(x, '...') OR endswith(x, '…'))) AS BIGINT) AS n_ellipsis_lines",
        "CAST(size(filter(lines, x -> x rlike '^ *[-*•]')) AS BIGINT) AS n_bullet_lines",
    )


def passes(rule: Rule) -> str:
    """A rule as SQL that is never null: a measure without value (0 / 0) passes."""
    num, _, den = rule.measure.partition(" / ")
    bounds = []
    for sign, bound in ((">=", rule.low), ("<=", rule.high)):
        if bound is not None:
            bounds.append(f"{num} {sign} {bound}" + (f" * {den}" if den else ""))
    test = " AND ".join(bounds) or "true"
    if rule.or_none:
        test += f" OR {num} = 0"
    return f"(n_words < {rule.min_words} OR ({test}))" if rule.min_words else f"({test})"


def quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures, base_failed, kept, and the names of the rules that failed.

    A filter on the verdict that were pushed below the projections would repeat
    their expressions many times over; the outer explode of one row stops it."""
    failed = "filter(array(" + ", ".join(f"CASE WHEN NOT {passes(r)} THEN '{r.name}' END" for r in rules) + "), x -> x IS NOT NULL) AS failed"
    judged = (
        measures(docs, id_col, text_col)
        .selectExpr("*", "n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed", failed)
        .selectExpr("*", "NOT base_failed AND size(failed) = 0 AS kept")
    )
    return judged.selectExpr("explode_outer(array(struct(*))) AS r").select("r.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with the columns of documents.

    The verdict is an expression over the row itself, so nothing is joined back."""
    return quality(docs.withColumn("doc_id", F.struct(*docs.columns))).where("kept").select("doc_id.*")
