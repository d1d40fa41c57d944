"""Language identification by compression: a text belongs to the language whose
zstandard raw-content dictionary encodes it in the fewest bytes.

Fit: the dictionary of a language is made of at most SAMPLE_DOCS of its labelled
texts, those with the smallest text hash in each of SAMPLE_DOCS hash buckets,
and at most DICT_BYTES; this bound is the documented sample of the classifier.
The selection is one partial aggregation, so a language with most of the rows
costs no skew. Prediction reads every whole text, in blocks of BLOCK_CHARS so
that a long text does not become its own dictionary.

Defined results: a null text, and one without a letter, is `und` with score 0
and rejected; so is every text if nothing is labelled. Equal sizes go to the
language first in order. Repeated rows each get their row. Columns of docs that
are called lang_pred, score or rejected give way to the results; the stage keeps
them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, table

SAMPLE_DOCS = 64
DICT_BYTES = 112_000
BLOCK_CHARS = 4_000
#: Effort of the compression, for texts of every length.
LEVEL = 11
#: Narrower margins between the best and the second language are rejected.
MIN_MARGIN = 0.02
#: More languages than this need a larger bound on what the driver sends out.
MAX_LANGS = 400

_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower-case letters, everything else as single spaces."""
    return _OTHER.sub(" ", text.lower()).strip()


def fit(docs: DataFrame, labelled, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionaries by language, from rows where `labelled` holds."""
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")
    )
    picked = rows.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bucket")).agg(F.min("h").alias("h"))
    picked = picked.where(F.col("lang").isNotNull()).select("lang", "h").collect()  # at most sample_docs a language
    langs = sorted({r["lang"] for r in picked})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages; raise MAX_LANGS after checking the driver's memory")
    if not langs:
        return {}
    each = max(200, DICT_BYTES // sample_docs)
    chosen = rows.where(F.col("h").isin([r["h"] for r in picked])).groupBy("lang", "h").agg(F.min(F.substring("text", 1, 8 * each)).alias("text"))
    wanted = {(r["lang"], r["h"]) for r in picked}
    parts: dict[str, list[tuple[int, str]]] = {k: [] for k in langs}
    for r in chosen.collect():
        if (r["lang"], r["h"]) in wanted:
            parts[r["lang"]].append((r["h"], normalised(r["text"])))
    dicts = {}
    for lang, found in parts.items():
        # Short samples leave room that the long ones fill, up to the bound.
        found.sort()
        size = each
        while sum(min(len(t), size) for _, t in found) < DICT_BYTES and size < 8 * each:
            size *= 2
        dicts[lang] = " ".join(t[:size] for _, t in found).encode()[:DICT_BYTES]
    return dicts


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        self.langs = sorted(dicts)
        self.plain = zstd.ZstdCompressor(level=LEVEL)
        self.coders = [self.coder(dicts[k], LEVEL) for k in self.langs]

    @staticmethod
    def coder(raw: bytes, level: int) -> zstd.ZstdCompressor:
        how = zstd.ZstdCompressionParameters.from_level(level, source_size=BLOCK_CHARS, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0)
        content = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=how)
        return zstd.ZstdCompressor(compression_params=how, dict_data=content)

    def sizes(self, text: str) -> list[int]:
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        t = normalised(text or "")
        if not self.langs or not any(map(str.isalpha, t)):
            return "und", 0.0
        sizes = self.sizes(t)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = sizes[:best] + sizes[best + 1 :] or [len(self.plain.compress(t.encode()))]
        return self.langs[best], max(0.0, 1 - sizes[best] / max(1, min(rest)))


def predict(docs: DataFrame, dicts: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected. The dictionaries are at most
    MAX_LANGS x DICT_BYTES and travel as one broadcast variable."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")])
    sent = docs.sparkSession.sparkContext.broadcast(dicts)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for b in batches:
            found = [model.predict(x) for x in b.column(at).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == "und" or f[1] < min_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = fit(docs, crc32_mod("doc_id", 4) != 2)
    seen = docs.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return predict(seen, dicts).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is clear."""
    dicts = fit(docs, crc32_mod("doc_id", 4) != 2)
    return predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), dicts).where("NOT rejected").select("row.*")
