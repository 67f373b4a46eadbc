"""Series: DataFrames of (series_id, idx, value); idx counts from 0 in each series.

Missing values are NULL, NaN or infinite; every operator treats the three alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.runtime import cut


#: Rows of a series that one task numbers.
SHORT = 1 << 16


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Rows with their number from 0 within ``keys`` in the order of ``order``, in a column ``name``.

    Where no key has more than ``SHORT`` rows, one window a key numbers them. Else rows are dealt by ranges of (keys, order) and counted range by range; a row's number is its place in its range
    plus the counts of the ranges before it. So one long series is as many tasks as there are ranges.
    """
    spark = df.sparkSession
    ordered = [F.col(o).asc() if isinstance(o, str) else o for o in order]
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= SHORT:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered)) - 1).cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, since the ranges are sampled: what counts them and what numbers them has to see the same ones
    ranged = cut(df.repartitionByRange(n, *[F.col(k) for k in keys], *ordered).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", *keys).orderBy(*ordered)
    placed = ranged.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    return placed.join(offsets, ["_range", *keys]).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def to_series(df: DataFrame, order: Sequence[str] | str, value: str, keys: Sequence[str] = (), name: str = "series", short: bool = False) -> DataFrame:
    """Rows of a table as series: one per combination of ``keys``, in the order of ``order``.

    Ids are the keys joined by ``|``. Ties in ``order`` are broken by the value, so the result is deterministic. Rows are
    numbered by ranges (``numbered``); with ``short`` by one window a series, for series that fit a task.
    """
    order = [order] if isinstance(order, str) else list(order)
    sid = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit(name)
    rows = df.select(sid.alias("series_id"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).cast("double").alias("value"))
    by = [*[f"_o{i}" for i in range(len(order))], "value"]
    if short:
        w = Window.partitionBy("series_id").orderBy(*by)
        return rows.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "value")
    return numbered(rows, ["series_id"], by, "idx").select("series_id", "idx", "value")


def totals(df: DataFrame, by: str | Column, value: str, keys: Sequence[str] = (), name: str = "series", short: bool = True) -> DataFrame:
    """A series of sums of ``value`` by ``by``: aggregated first, so only the totals are ordered.

    ``short``: totals by day or hour are few, and one window a series numbers them; set it to False for finer steps.
    """
    by = F.col(by) if isinstance(by, str) else by
    summed = df.groupBy(*keys, by.alias("_by")).agg(F.sum(value).alias("_total"))
    return to_series(summed, "_by", "_total", keys, name, short)


def wide_to_dims(df: DataFrame, order: str, columns: Sequence[str], series_id: str = "series") -> DataFrame:
    """Columns of a table as the dimensions (series_id, dim, idx, value) of one series."""
    wide = numbered(df.select(F.lit(series_id).alias("series_id"), F.col(order).alias("_o"), *[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)]), ["series_id"], ["_o"], "idx")
    long = wide.select("idx", *[F.col(str(i)) for i in range(len(columns))]).unpivot(["idx"], [str(i) for i in range(len(columns))], "dim", "value")
    return long.select(F.lit(series_id).alias("series_id"), F.col("dim").cast("int").alias("dim"), "idx", "value")


def arrays_to_series(df: DataFrame, key: str, array: str) -> DataFrame:
    """Array rows as series."""
    return df.select(F.col(key).cast("string").alias("series_id"), F.posexplode(array).alias("idx", "value")).select("series_id", F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"))


def from_values(spark: SparkSession, values: Sequence[float | None] | dict[str, Sequence[float | None]], name: str = "series") -> DataFrame:
    """Small in-memory series (tests, queries)."""
    by_id = values if isinstance(values, dict) else {name: values}
    rows = [(s, i, None if v is None else float(v)) for s, vs in by_id.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, idx long, value double")


def read_series(spark: SparkSession, path: str, order: Sequence[str] | str, value: str, keys: Sequence[str] = (), form: str = "parquet", **options) -> DataFrame:
    """Series from files of any format that Spark reads."""
    return to_series(spark.read.format(form).options(**options).load(path), order, value, keys)


def write_result(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """A profile or any other result to files of any format that Spark writes."""
    writer = df.write.format(form).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


# Series of the driver's tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_read(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", name="quantity")


def daily_quantity_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_read(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", ["l_returnflag"])


def daily_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", name="price")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_read(spark, sf_dir, "events"), F.date_trunc("hour", "ts"), "value", name="hourly")


def hourly_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, dim, idx, value): a dimension per event type, hours without events 0."""
    hours = _read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).pivot("event_type").sum("value").fillna(0.0)
    return wide_to_dims(hours, "h", sorted(c for c in hours.columns if c != "h"), "events")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(_read(spark, sf_dir, "events"), ["ts", "event_id"], "value", name="events")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_series(_read(spark, sf_dir, "events"), ["ts", "event_id"], "value", ["user_id"])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays_to_series(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
