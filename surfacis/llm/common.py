"""Helpers shared by the training-data operators: the shared folder, staged tables, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that separates words, for regular expressions.
SPACE = r"\x20\x09-\x0D"
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, with a local master (tests), one of our own; on a cluster nothing stands in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = _own_dir.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="surfacis-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/surfacis/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df has not, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind value once and use it many times in body: a lambda variable is evaluated once, a repeated column is not. (element_at() works out its type once, an index in brackets for every row.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df staged in ranges of order, with __pid the number of the range. Staging fixes the bounds, which Spark samples anew in every run of a plan."""
    n = shuffle_parts(df.sparkSession)
    return stage(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), name)


def running_sum(ranged: DataFrame, order: list[Column], value: str, out: str, by: str | None = None) -> DataFrame:
    """Add out: the sum of value over the rows before each row, in order, within by if given.

    ranged comes from in_ranges() with an order that starts with by. Each range is summed on its own and
    the totals of the ranges (a row for each range and group at most) are carried over, so that neither
    the whole table nor a hot group meets in one task. The order must leave no ties.
    """
    keys = ["__pid", *([by] if by else [])]
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*([by] if by else [])).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    totals = totals.select(F.col("__pid").alias("__p"), *([F.col(by).alias("__b")] if by else []), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    on = F.col("__pid") == F.col("__p")
    if by:
        on = on & F.col(by).eqNullSafe(F.col("__b"))
    summed = ranged.withColumn("__own", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return summed.join(totals, on).withColumn(out, F.col("__base") + F.col("__own")).drop("__p", "__b", "__base", "__own")
