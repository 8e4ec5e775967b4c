"""Helpers shared by the training-data operators.

Nothing here collects rows: what reaches the driver is bounded by a parameter
(range bounds) or by the number of partitions.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir.

    A temporary folder stands in for it only where the setting is absent, as
    in local tests.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        _roots[app] = f"{base.rstrip('/')}/tessera-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort at exit; the session may be gone by then."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys are broadcast up to this number (about 16 MB); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def join_few(table: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a table that may be small: it is counted, and broadcast where its number of rows allows."""
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return table.join(F.broadcast(keys) if small else keys, on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside one expression.

    Catalyst may inline a projected array into the lambda that reads it, and
    so compute it again for each element; a one-element transform can't be
    taken apart that way.
    """
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Words of a text by the word rule; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


# ---------------------------------------------------------------- range buckets

_LOW = -(1 << 63)


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, each a value of the column, the last its maximum.

    One aggregate over one narrow column.  Nulls count as the lowest value.
    The bounds are all that the driver sees.
    """
    key = F.coalesce(F.col(column).cast("long"), F.lit(_LOW))
    shares = [i / buckets for i in range(1, buckets)] or [1.0]
    row = df.agg(
        F.percentile_approx(key, F.array(*map(F.lit, shares)), max(10_000, 10 * buckets)).alias("q"),
        F.max(key).alias("top"),
    ).head()
    if row is None or row["top"] is None:
        return [0]
    return sorted({*row["q"], row["top"]})


def bucket_of(column: str, bounds: list[int]) -> Column:
    """The number of the first bound that isn't below the value: a binary search in the JVM."""
    key = F.coalesce(F.col(column).cast("long"), F.lit(_LOW))
    steps = max(1, len(bounds).bit_length())
    table = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    last = len(bounds) - 1

    def narrow(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        mid = F.floor((low + high) / 2).cast("int")
        below = F.get(table, mid) < state["key"]
        return F.when(low >= high, state).otherwise(
            F.struct(F.when(below, mid + 1).otherwise(low).alias("low"), F.when(below, high).otherwise(mid).alias("high"), state["key"].alias("key"))
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(last).alias("high"), key.alias("key"))
    return F.aggregate(F.array_repeat(F.lit(0), steps), start, narrow, lambda s: s["low"])


# ---------------------------------------------------------------- ranks without one task

def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, salts: int | None = None) -> DataFrame:
    """Add ``rank``: 0, 1, 2 ... within each group, in an order of no meaning.

    A group may hold most of the rows, so each is dealt into salts, counted by
    salt, and a row's rank is its place within its salt plus the rows of the
    salts before.  No task gets more than one salt's rows of a group.
    """
    spark = df.sparkSession
    n = salts or 4 * shuffle_partitions(spark)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn(
        "_before",
        F.sum("_rows").over(Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)),
    ).select(*group, "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order)) - 1
    return (
        salted.withColumn("_place", place)
        .join(before, [*group, "_salt"])
        .withColumn(rank, (F.col("_before") + F.col("_place")).cast("long"))
        .drop("_salt", "_before", "_place")
    )
