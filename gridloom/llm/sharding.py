"""Two-pass external shuffle of a corpus into shards of equal row counts.

Pass one scatters the records uniformly, by a seeded hash of id and text, into buckets that fit in
a task's memory. A row repeated beyond a bucket's share is scattered by its place in the files as well. Pass two gives each bucket a Fisher-Yates permutation (Spark's ``shuffle`` of the
bucket's positions, seeded) and writes the buckets one after the other: record number ``p`` of the
``n`` records goes to shard ``floor(p * shards / n)``, so the shards' counts differ by one at most.

Only DataFrame functions run here. The records cross one exchange; what meets them there is one
small row per bucket. Buckets that one task holds lie side by side, so a shard is a few files that
follow each other by name, in slot order. The bucket count follows the corpus's bytes, so that buckets stay the same
size at any scale. A copy of a text has an id of its own and so a bucket of its own; no source,
length or group of copies gathers in a bucket.

Defined results: a null text has no bytes (size 1, checksum 0) and stays null; a null id is hashed
like any value; repeated rows stay, each in a slot of its own; very long texts are one record; an
empty table gives no rows; other
columns go along, and names that clash with the operator's own are replaced by its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, shared_dir

OWN = ("size", "shard", "slot", "_bucket", "_key", "_rank", "_first", "_order", "_pos", "_n")


def text_size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def external_shuffle(df: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Adds size, shard and slot (long, from 0 without gaps in a shard) to ``df`` (doc_id, text, ...)."""
    df = df.drop(*OWN).withColumn("size", text_size())
    total, n = df.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-total // bucket_bytes), parts)
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    spread = df.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))

    # one row per bucket: how many records lie in earlier buckets, and a permutation of its positions
    counts = materialize(spread.groupBy("_bucket").agg(F.count("*").alias("_n")))
    full = 4 * n // buckets + 1000
    if counts.where(F.col("_n") > full).count():
        spread = materialize(_scattered(spread, buckets, full))
        counts = materialize(spread.groupBy("_bucket").agg(F.count("*").alias("_n")))
    task = F.pmod(F.hash("_bucket"), F.lit(parts))  # where an exchange by the bucket sends it
    first = F.coalesce(F.sum("_n").over(Window.orderBy(task, "_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    orders = (
        counts.withColumn("_first", first)
        .repartition(parts, "_bucket")  # dealt as the records are, so that the join moves neither
        .sortWithinPartitions("_bucket")
        .select("_bucket", "_first", F.shuffle(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), seed).alias("_order"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "doc_id")) - 1
    placed = (
        spread.repartition(parts, "_bucket")
        .withColumn("_rank", rank)
        .join(orders.hint("merge"), "_bucket")
        .withColumn("_pos", F.col("_first") + F.get("_order", F.col("_rank")))
    )
    shard = F.expr(f"cast(_pos * {shards} div {max(n, 1)} as int)")
    start = F.expr(f"(shard * {max(n, 1)} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("_pos") - start).cast("long")).drop(*OWN[3:])


def _scattered(spread: DataFrame, buckets: int, full: int) -> DataFrame:
    """``spread`` with rows that are repeated over ``full`` times in buckets of their own choice. To be written before it is read twice."""
    hot = materialize(spread.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > full).select("_key", F.lit(True).alias("_hot")))
    own = F.pmod(F.xxhash64("_key", F.monotonically_increasing_id()), F.lit(buckets))
    marked = spread.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "_key", "left")
    return marked.withColumn("_bucket", F.when(F.col("_hot"), own).otherwise(F.col("_bucket"))).drop("_hot")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffles ``df`` and writes it as Parquet under ``path``, a folder for each shard, rows in slot order within a file."""
    out = external_shuffle(df, **options)
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_dir(spark)
    write_shards(docs, path, shards=8)
    written = spark.read.schema("doc_id long, text string, size long, slot long, shard int").parquet(path)
    return written.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
