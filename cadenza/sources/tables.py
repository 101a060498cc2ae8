"""Readers that turn tables into long series (series_id, t, v), and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_series(df: DataFrame, series: str, order: str | list[str], value: str, *also: str) -> DataFrame:
    """Long series: series_id, t (0, 1, ... in the given order), v, and further columns."""
    by = Window.partitionBy(series).orderBy(*([order] if isinstance(order, str) else order))
    return df.select(F.col(series).alias("series_id"), (F.row_number().over(by) - 1).alias("t"), F.col(value).cast("double").alias("v"), *also)


def events_series(spark: SparkSession, folder: str) -> DataFrame:
    """One series for each user of events, with the event type as grp."""
    return scan_series(table(spark, folder, "events").withColumn("grp", F.col("event_type")), "user_id", "ts", "value", "grp")


def vectors_long(spark: SparkSession, folder: str) -> DataFrame:
    """Channels of embeddings in long form: series_id (label), t, vec_id, ch, v."""
    rows = table(spark, folder, "embeddings")
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = rows.select(F.col("label").alias("series_id"), (F.row_number().over(by) - 1).alias("t"), "vec_id", "embedding")
    rows = rows.select("series_id", "t", "vec_id", F.posexplode("embedding").alias("ch", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


def union_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """Rows of several corpora, each tagged with its name in `corpus`."""
    out = None
    for name, df in groups.items():
        tagged = df.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "val") -> DataFrame:
    """Wide scores in long form."""
    return df.unpivot(ids, columns, name, value)


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Long scores as a matrix: a row for each `row`, a column for each of `columns`. Naming them saves
    a pass over the data."""
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "append") -> None:
    """Append rows to a result table, partitioned by columns if named."""
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; below a temporary folder only where that is unset and the session
    is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read back: what a loop goes on from, so that its plan doesn't grow with the rounds and no executor's loss costs
    more than the last one."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that the result table does not hold yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def lcg(ident: Column, seed: int | Column) -> Column:
    """A 31-bit integer hash of an integer id."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return (ident.cast("long") * 1103515245 + seed * 12345) % 2147483648


def uniform(ident: Column, seed: int | Column) -> Column:
    """A number in [0, 1) from an id and a seed: two rounds of lcg()."""
    return lcg(lcg(ident, seed) + 7919, seed) / F.lit(2147483648.0)


def split(df: DataFrame, ident: str = "series_id", share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with part = 'train' or 'val'; whole series stay together."""
    return df.withColumn("part", F.when(uniform(F.col(ident), seed) < share, "train").otherwise("val"))


def overlapping_slices(series: DataFrame, length: int, phases: int = 4) -> DataFrame:
    """Frames of slices of that length that begin at 0, 1/4, 2/4 and 3/4 of it; the last slice of
    each phase is left out, full or not. offset is the slice's first frame, t_rel the place in it."""
    starts = F.explode(F.array(*[F.lit(p * length // phases) for p in range(phases)]))
    rows = series.withColumn("_start", starts).where("t >= _start").withColumn("_k", F.floor((F.col("t") - F.col("_start")) / length))
    last = F.max("_k").over(Window.partitionBy("series_id", "_start"))
    rows = rows.withColumn("_last", last).where("_k < _last")
    return rows.withColumn("offset", (F.col("_start") + F.col("_k") * length).cast("int")).withColumn("t_rel", (F.col("t") - F.col("offset")).cast("int")).drop("_start", "_k", "_last")


def chunks(series: DataFrame, length: int) -> DataFrame:
    """Frames of slices one after the other, without the last."""
    return overlapping_slices(series, length, phases=1)


def sliding_windows(series: DataFrame, width: int, step: int = 1) -> DataFrame:
    """Frames of every full window; `start` is its first frame. Each frame goes to width/step rows."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - width + 1) / step).cast("int"))
    last = F.least(F.floor(F.col("t") / step).cast("int"), F.floor((F.col("_n") - width) / step).cast("int"))
    rows = series.withColumn("_n", n).where(F.col("_n") >= width).withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    return rows.withColumn("_k", F.explode(F.sequence("_a", "_b"))).withColumn("start", F.col("_k") * step).withColumn("t_rel", F.col("t") - F.col("start")).drop("_n", "_a", "_b", "_k")


def train_stats(df: DataFrame, *by: str) -> DataFrame:
    """Mean and population standard deviation of v for each channel."""
    return df.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def zscore(df: DataFrame, stats: DataFrame, *by: str) -> DataFrame:
    """df with z, by stored statistics. There is a row of statistics for each channel, a number fixed by
    the schema; Spark broadcasts them by their size."""
    return df.join(stats, list(by)).withColumn("z", F.try_divide(F.col("v") - F.col("mean"), F.col("std"))).drop("mean", "std")


def profile(df: DataFrame, *by: str) -> DataFrame:
    """min, median, mean, max and count of v."""
    return df.groupBy(*by).agg(F.min("v").alias("low"), F.median("v").alias("mid"), F.avg("v").alias("mean"), F.max("v").alias("high"), F.count("v").alias("n"))


def random_crop(series: DataFrame, length: int, seed: int) -> DataFrame:
    """One window of that length from each series that is long enough, at a place drawn by its id."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    rows = series.withColumn("_n", n).where(F.col("_n") >= length)
    start = F.floor(uniform(F.col("series_id"), seed) * (F.col("_n") - length + 1))
    return rows.withColumn("offset", start.cast("int")).where((F.col("t") >= F.col("offset")) & (F.col("t") < F.col("offset") + length)).drop("_n")


def shuffle_order(df: DataFrame, ident: str, seed: int) -> DataFrame:
    """df with `place`, its rank in a random order of all rows by range partitions (a global sort)."""
    return df.withColumn("place", uniform(F.col(ident), seed)).orderBy("place", ident)


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check, and those that fail it or make it null."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def pad_to_grid(series: DataFrame, rate: int) -> DataFrame:
    """Each series filled with zeros up to a whole number of `rate` frames."""
    ends = series.groupBy("series_id").agg(F.max("t").alias("_last"))
    grid = ends.select("series_id", F.explode(F.sequence(F.lit(0), (F.ceil((F.col("_last") + 1) / rate) * rate - 1).cast("int"))).alias("t"))
    return grid.join(series.select("series_id", "t", "v"), ["series_id", "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def truncate_to_common(series: DataFrame, least: int = 1) -> DataFrame:
    """All series cut to the length of the shortest that has at least `least` frames."""
    lengths = series.groupBy("series_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    shortest = lengths.agg(F.min("_n").alias("_least"))  # one row
    return series.join(lengths, "series_id").crossJoin(F.broadcast(shortest)).where("t < _least").drop("_n", "_least")


def config_json(config: DataFrame) -> DataFrame:
    """A row of settings as JSON in `config`, with its key columns kept."""
    return config.select("series_id", F.to_json(F.struct(*[c for c in config.columns if c != "series_id"])).alias("config"))


def config_rows(stored: DataFrame, schema: str) -> DataFrame:
    """Settings read back from JSON."""
    return stored.select("series_id", F.from_json("config", schema).alias("_c")).select("series_id", "_c.*")
