"""Parquet, CSV and configuration sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import keep_one
from ..tables import remove

BAR = T.StructType([T.StructField(n, T.LongType() if n == "ts" else T.DoubleType()) for n in ("ts", "open", "high", "low", "close", "volume")])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, in any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars with ts as a timestamp; no rows where nothing is stored. The symbol
    is a partition column, or taken from names like SYMBOL_INTERVAL.parquet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ts timestamp, open double, high double, low double, close double, volume double, symbol string")
    df = spark.read.parquet(path)
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)_[^_/]+\.parquet$", 1))
    return df.withColumn("ts", F.timestamp_millis("ts")) if dict(df.dtypes)["ts"] == "bigint" else df


def save_bars(df: DataFrame, path: str) -> None:
    df.write.partitionBy("symbol").mode("overwrite").parquet(path)


def bar_name(symbol: str, interval: str) -> str:
    return f"{symbol}_{interval}.parquet"


def any_timestamp(column: str):
    """Text or epoch milliseconds as a timestamp; NULL if neither."""
    text = F.col(column).cast("string")
    return F.coalesce(F.timestamp_millis(text.try_cast("bigint")), F.try_to_timestamp(text))


def load_open_interest(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Daily files SYMBOL-metrics-DATE.csv: (symbol, ts, open_interest), dates by name."""
    df = spark.read.option("header", True).csv(f"{folder}/*-metrics-*.csv")
    name = F.input_file_name()
    df = df.withColumns({"symbol": F.regexp_extract(name, r"([^/]+)-metrics-", 1), "_day": F.regexp_extract(name, r"-metrics-(\d{4}-\d{2}-\d{2})", 1)})
    if first:
        df = df.where(F.col("_day") >= first)
    if last:
        df = df.where(F.col("_day") <= last)
    out = df.select("symbol", any_timestamp("create_time").alias("ts"), F.col("sum_open_interest").try_cast("double").alias("open_interest"))
    return keep_one(out, ["symbol", "ts"], [F.col("open_interest")])


def load_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Files SYMBOL_metrics_*.csv: (symbol, ts, open_interest, ls_ratio); a file
    without ls_ratio has 1.0; the first of doubled rows by file name stays."""
    df = spark.read.option("header", True).csv(f"{folder}/*_metrics_*.csv")
    ratio = F.col("ls_ratio").try_cast("double") if "ls_ratio" in df.columns else F.lit(None).cast("double")
    out = df.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)_metrics_", 1).alias("symbol"), any_timestamp("ts").alias("ts"), F.col("open_interest").try_cast("double").alias("open_interest"), F.coalesce(ratio, F.lit(1.0)).alias("ls_ratio"), F.input_file_name().alias("_f")
    )
    return keep_one(out, ["symbol", "ts"], ["_f"]).drop("_f")


def merge_metrics(history: DataFrame, recent: DataFrame, first: str, last: str, column: str) -> DataFrame:
    """Both stores within [first, last]; where both have a row the recent one wins."""
    both = history.withColumn("_src", F.lit(0)).unionByName(recent.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    both = both.where(F.col("ts").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))
    return keep_one(both, ["symbol", "ts"], ["_src"], last=True).where(F.col(column).isNotNull()).select("symbol", "ts", column)


def discover_symbols(spark: SparkSession, folder: str, mark: str = "-metrics-") -> DataFrame:
    """Sorted distinct symbols of file names; only names are read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.select(F.split(F.element_at(F.split("path", "/"), -1), mark)[0].alias("symbol")).distinct().orderBy("symbol")


def save_panel(panel: DataFrame, path: str, epochs: DataFrame) -> None:
    """One partition per snapshot, with full history of its symbols, and a manifest.
    Both go to a version of their own; one rename of a small file publishes them
    together, so that a reader sees the old panel or the new one."""
    spark = panel.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    members = epochs.select("snapshot_date", "symbol").distinct()
    panel.join(members, "symbol").write.partitionBy("snapshot_date").parquet(f"{path}/{version}/panel")
    manifest = epochs.groupBy("snapshot_date", "epoch_start", "epoch_end").agg(F.count_distinct("symbol").alias("n_symbols"))
    manifest.write.parquet(f"{path}/{version}/manifest")
    old = _published(spark, path)
    _publish(spark, path, version)
    if old:  # the one before stays for readers that hold it
        for name in _versions(spark, path):
            if name not in (old, version):
                remove(spark, f"{path}/{name}")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    _, at, fs = _fs(spark, path)
    return [n for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("v-")]


def _published(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers see."""
    if not exists(spark, f"{path}/current"):
        return None
    return spark.read.text(f"{path}/current").first()[0]


def _publish(spark: SparkSession, path: str, version: str) -> None:
    jvm, at, fs = _fs(spark, f"{path}/current.{version}")
    out = fs.create(at, True)
    out.write(bytearray(version.encode()))
    out.close()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = fs.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(whole, fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/current")), modes)


def _current(spark: SparkSession, path: str) -> str:
    version = _published(spark, path)
    return f"{path}/{version}" if version else path


def load_panel(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """A saved panel, or a single parquet file; one snapshot reads one partition."""
    path = _current(spark, path)
    root = f"{path}/panel" if exists(spark, f"{path}/manifest") else path
    df = spark.read.parquet(root)
    return df if snapshot is None else df.where(F.col("snapshot_date") == F.lit(snapshot).cast("date"))


def epoch_for(spark: SparkSession, path: str, date: str):
    """The manifest row whose days hold the date, or None."""
    d = F.lit(date).cast("date")
    return spark.read.parquet(f"{_current(spark, path)}/manifest").where(d.between(F.col("epoch_start"), F.col("epoch_end"))).first()


def save_weights(full: DataFrame, traded: DataFrame, path: str, strategy: str) -> None:
    """The weights of a strategy take the place of those saved before; other
    strategies stay."""
    both = full.withColumn("variant", F.lit("unmasked")).unionByName(traded.withColumn("variant", F.lit("traded")))
    both = both.withColumn("strategy", F.lit(strategy))
    both.write.partitionBy("strategy", "variant").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def load_weights(spark: SparkSession, path: str, variant: str = "traded", without: tuple[str, ...] = ()) -> DataFrame:
    """Weights of all strategies but those named, partitions pruned."""
    df = spark.read.parquet(path).where(F.col("variant") == variant)
    return df.where(~F.col("strategy").isin(*without)) if without else df


def discover_weights(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Files NAME.parquet of wide weights (ts and a column a symbol) as (strategy,
    ts, symbol, weight) on the union of their dates and symbols, 0 where one has
    none. Optimised portfolios and raw predictions are no strategies."""
    from ..operators.calendar import to_long
    from ..operators.joins import aligned

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path")  # names only
    files = {r["path"].rsplit("/", 1)[1].removesuffix(".parquet"): r["path"] for r in found.collect()}
    own = {n: p for n, p in sorted(files.items()) if not n.startswith("optimized_weights_") and n != "ebm_predictions" and (names is None or n in names)}
    if not own:
        raise ValueError(f"no strategies in {folder}")
    return aligned({n: to_long(spark.read.parquet(p), "weight") for n, p in own.items()})


def save_models(found: DataFrame, path: str) -> None:
    """The tables of ml.training.trained (shapes, importance), a partition a fold."""
    found.where("kind IN ('shape', 'importance')").write.partitionBy("fold").mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Saved models, at most `most` folds spread over all; partitions pruned."""
    df = spark.read.parquet(path)
    return df if most is None else thinned_folds(df, most)


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of save_table; CSV files need their schema."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).csv(path)


def save_table(df: DataFrame, path: str, as_csv: bool = False) -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if as_csv else w.parquet(path)


def load_config(text: str) -> dict:
    """Nested settings from JSON, or from the `key: value` subset of YAML."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        root: dict = {}
        stack = [(-1, root)]
        for line in text.splitlines():
            body = line.split("#")[0].rstrip()
            if not body.strip() or ":" not in body:
                continue
            depth = len(body) - len(body.lstrip())
            key, _, value = body.strip().partition(":")
            while stack[-1][0] >= depth:
                stack.pop()
            if value.strip():
                try:
                    stack[-1][1][key] = json.loads(value)
                except ValueError:
                    stack[-1][1][key] = value.strip().strip("'\"")
            else:
                stack[-1][1][key] = {}
                stack.append((depth, stack[-1][1][key]))
        return root


def thinned_folds(models: DataFrame, most: int) -> DataFrame:
    """At most `most` folds, evenly spread over their order."""
    from pyspark.sql import Window as W

    n = models.select("fold").distinct().count()
    if n <= most:
        return models
    keep = {round(i * (n - 1) / max(1, most - 1)) for i in range(most)}
    order = models.select("fold").distinct().withColumn("_i", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("fold")) - 1)
    return models.join(F.broadcast(order.where(F.col("_i").isin(*keep))), "fold", "left_semi")
