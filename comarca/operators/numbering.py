"""Numbers over a sorted table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from comarca.operators.lineage import cut


def numbered(rows: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """``rows`` with ``name``, their place by the column ``order`` (different values), from ``start``.

    Rows are dealt over ranges of the column and numbered within each; the sizes of the
    ranges before, one number per range, are added.
    """
    dealt = cut(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = (dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
             .agg(F.collect_list(F.struct("_range", "n")).alias("sizes")).scalar())
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    before = F.aggregate(F.filter("_sizes", lambda s: s["_range"] < F.col("_range")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    return (dealt.withColumns({"_at": within, "_sizes": sizes})
            .withColumn(name, (before + F.col("_at") - 1 + start).cast("bigint")).drop("_range", "_at", "_sizes"))
