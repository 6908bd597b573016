"""Helpers of all operators: cut lineage, running totals, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where lineage is cut if the session names no folder and runs on one machine (tests, a laptop).
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/comarca"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only on one machine where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or DEFAULT_CHECKPOINT_DIR)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from the shared folder, without their lineage (narrow rows)."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared folder (wide rows)."""
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the keys come once, from the left."""
    keys = list(keys)
    names = {k: f"__right_{k}" for k in keys}
    renamed = right.select([F.col(c).alias(names.get(c, c)) for c in right.columns])
    condition = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[names[k]])
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*names.values())


def running_total(frame: DataFrame, values: dict[str, str], key: str, by: str | None = None,
                  buckets: int = 256) -> DataFrame:
    """Add, per column of ``values`` (new name: summed column), the sum over all rows before.

    ``key`` is unique.  Rows are dealt by its hash over ``buckets`` windows and the bucket
    totals (``buckets`` rows per value of ``by``) shift each window, so no task holds all
    rows.  The order of the totals is by bucket, then by key, each value of ``by`` alone.
    """
    by_ = [by] if by else []
    dealt = frame.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    totals = dealt.groupBy(*by_, "__bucket").agg(*[F.sum(v).alias(f"__{o}") for o, v in values.items()])
    earlier = Window.partitionBy(*by_).orderBy("__bucket")
    shifts = totals.select(*by_, "__bucket", *[(F.sum(f"__{o}").over(earlier) - F.col(f"__{o}")).alias(f"__{o}")
                                               for o in values])
    within = Window.partitionBy(*by_, "__bucket").orderBy(key)
    summed = dealt.select("*", *[(F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(v)).alias(o)
                                 for o, v in values.items()])
    return (summed.join(F.broadcast(shifts), [*by_, "__bucket"])
            .withColumns({o: F.col(o) + F.col(f"__{o}") for o in values})
            .drop("__bucket", *[f"__{o}" for o in values]))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (node, root), root the smallest node reachable.

    ``edges`` has the columns a and b (numbers); nodes without an edge do not come back.
    Large-star and small-star steps in turn until no edge changes.  Both keep a star's
    links as one row per node, so a huge component costs no more than its nodes.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # neighbours by node; every neighbour on the chosen side is linked to the smallest
        sides = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = sides.join(low, "a")
        if large:
            linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            linked = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .union(low.select("a", F.col("m").alias("b"))))
        return linked.where("a <> b").distinct()

    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        current = cut(star(star(current, large=True), large=False))
        # equal edge sets have equal order-free sums
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


#: Rows that a Python worker holds as Python objects at a time.
SLICE_ROWS = 500


def map_slices(frame: DataFrame, inputs: list[str], schema: str, start) -> DataFrame:
    """``mapInArrow`` over slices: ``start()`` makes, once per task, a function from the
    columns ``inputs`` (Arrow arrays) to the new columns of ``schema``.  The other columns pass
    through, but for those of a new column's name; ``inputs`` do not come back, so long
    texts are not sent to and fro.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType, _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]
    through = [c for c in frame.columns if c not in inputs and c not in names]

    def run(batches):
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in through), *make(*(part.column(c) for c in inputs))],
                                                 [*through, *names])

    return frame.select(*through, *inputs).mapInArrow(
        run, StructType([*frame.select(*through).schema.fields, *_parse_datatype_string(schema).fields]))
