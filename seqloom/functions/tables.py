"""Small tables beside large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.storage import stored


def beside(df: DataFrame, table: DataFrame, most: int = 100_000) -> DataFrame:
    """Every row of ``df`` with every row of ``table``, a vocabulary: counted, and broadcast up to ``most`` rows; a longer one meets ``df`` partition by partition."""
    few = table.limit(most + 1).count() <= most
    return df.crossJoin(F.broadcast(table) if few else table)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... over all rows in this order, which must be total.

    Rows are dealt by range and numbered within their partition; only one row a partition is summed in one place.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    at = [f"_o{i}" for i in range(len(keys))]
    dealt = stored(df.withColumns(dict(zip(at, keys, strict=True))).repartitionByRange(*at).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_p").agg(F.count("*").alias("_rows")).select("_p", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*at)) - 1
    return dealt.withColumn("_local", local).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_local")).drop("_p", "_local", "_before", *at)  # one row a partition
