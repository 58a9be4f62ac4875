"""Copies of the smallest test tables: empty, and with null rows, repeated rows and columns of clashing names."""

from pathlib import Path

from pyspark.sql import functions as F

SMALL = Path("/root/testdata/sf0.001")


def write(spark, folder, names):
    """Writes the copies below a folder; returns both places."""
    for t in names:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{folder}/empty/{t}.parquet")
        nulls = df.limit(3).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
        more = df.unionByName(nulls).unionByName(nulls).unionByName(df.limit(5))
        more.withColumns({"key": F.lit("clash"), "d": F.lit(1), "form": F.lit("x"), "_k": F.lit(2)}).write.parquet(f"{folder}/dirty/{t}.parquet")
    return f"{folder}/empty", f"{folder}/dirty"
