"""Sections: tables written by part, with hashes of their contents and a root over them."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sections and whether they must be there.
SECTIONS = {"core": True, "text": True, "articles": False, "commentary": False, "lexicon": False}
SCHEMA_VERSION = 27


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one only in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write(df: DataFrame, path: str, order: tuple[str, ...] = ("id",)) -> str:
    """Write a table with a folder for each section, rows sorted within files; again is the same."""
    df.repartition("section", *order).sortWithinPartitions("section", *order).write.mode("overwrite").partitionBy("section").parquet(path)
    return path


def reload(spark: SparkSession, path: str, sections: tuple[str, ...] = ()) -> DataFrame:
    """Read sections back; only those asked for are scanned."""
    df = spark.read.parquet(path)
    return df.where(F.col("section").isin(*sections)) if sections else df


def dump(parts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """``section, line``: each row as its table's name and canonical JSON, keys in order."""
    lines = [
        df.select(F.lit(section).alias("section"), F.concat(F.lit(f"{name}\t"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("line"))
        for (section, name), df in parts.items()
    ]
    return reduce(DataFrame.unionByName, lines)


def section_hashes(parts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """``section, n_rows, hash``, whatever the order of rows.

    Each line's SHA-256 is cut into four numbers of 60 bits, which are summed:
    a plain aggregate with map-side combine, however many rows a section has.
    The section's hash is that of its count and sums.
    """
    hashed = dump(parts).select("section", F.sha2("line", 256).alias("x"))
    number = lambda k: F.conv(F.substring("x", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    sums = hashed.groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(number(k)).alias(f"s{k}") for k in range(4)])
    return sums.select("section", "n_rows", F.sha2(F.concat_ws(",", "n_rows", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("hash"))


def root_hash(hashes: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """One hash over all sections: ``name|hash|version|required`` lines in order."""
    required = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in SECTIONS.items() for x in item]), F.col("section")), F.lit(False))
    line = F.concat_ws("|", "section", "hash", F.lit(str(version)), required.cast("string"))
    return hashes.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("root"))


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, problem`` of two file lists ``path, hash, bytes, link``: Missing, Extra, LinkAdded, LinkRemoved, Truncated, Changed."""
    a, b = expected.alias("a"), actual.alias("b")
    problem = (
        F.when(F.col("b.hash").isNull(), "Missing")
        .when(F.col("a.hash").isNull(), "Extra")
        .when(F.col("b.link") & ~F.col("a.link"), "LinkAdded")
        .when(F.col("a.link") & ~F.col("b.link"), "LinkRemoved")
        .when(F.col("a.hash") == F.col("b.hash"), F.lit(None))
        .when(F.col("b.bytes") < F.col("a.bytes"), "Truncated")
        .otherwise("Changed")
    )
    met = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    return met.select(F.coalesce("a.path", "b.path").alias("path"), problem.alias("problem")).where("problem is not null")


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``section, status``: ok, mismatch, missing (a required one) or absent."""
    required = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in SECTIONS.items() for x in item]), F.col("section")), F.lit(True))
    met = expected.select("section", "hash").join(actual.select("section", F.col("hash").alias("found")), "section", "left")
    status = F.when(F.col("found").isNull() & required, "missing").when(F.col("found").isNull(), "absent").when(F.col("hash") == F.col("found"), "ok").otherwise("mismatch")
    return met.select("section", status.alias("status"))
