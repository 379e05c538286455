"""Length buckets with the least padding, and token-budget batches inside them.

The global histogram of lengths is one small aggregate: a row for each length that occurs, however
long (texts of T tokens in all have fewer than sqrt(2 T) lengths). Dynamic programming over it picks
the bucket bounds for which padding every sequence up to its bucket's bound costs least, exactly, in
time linear in buckets times lengths. A batch holds as many sequences of its bucket as the token
budget admits at the bucket's bound; a sequence longer than the budget is whole and alone.

Places in a bucket are numbered without gathering it: a bucket is dealt out by a hash of the row's
key and length into chunks of about ``CHUNK`` rows, chunks are counted, and a row's place is its
chunk's start plus its rank in the chunk. A bucket or length with a third of all rows is many
chunks. Rows that repeat key and length have one hash: where they fill a chunk beyond four times its
share, the chunk's rows are dealt anew to parts of a share each, and the parts stand one after the other.

Defined results: a null length counts as 0; a null key is hashed like any value; an empty table
gives no rows; rows with equal values each have a place of their own; very long texts are one
sequence; other columns go along (clashing names are replaced).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, words

CHUNK = 250_000
OWN = ("bucket", "bucket_length", "batch", "slot", "padding")


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` length buckets with the least padding over (length, count) pairs."""
    histogram = sorted(histogram)
    n = len(histogram)
    rows, tokens = [0], [0]
    for length, count in histogram:
        rows.append(rows[-1] + count)
        tokens.append(tokens[-1] + length * count)
    # cost[j]: padding of the first j cells with the buckets so far. One more bucket over cells i+1..j
    # of bound L pads L * (rows[j] - rows[i]) - (tokens[j] - tokens[i]): in L, a line for each i.
    cost: list = [0, *[None] * n]
    back: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new, chosen, lines = [cost[0] if cost[0] == 0 else None, *[None] * n], [0] * (n + 1), deque()
        new[0] = 0
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                line = (rows[j - 1], cost[j - 1] + tokens[j - 1], j - 1)
                while len(lines) > 1 and (line[1] - lines[-2][1]) * (lines[-1][0] - lines[-2][0]) <= (lines[-1][1] - lines[-2][1]) * (line[0] - lines[-2][0]):
                    lines.pop()
                lines.append(line)
            at = histogram[j - 1][0]
            while len(lines) > 1 and lines[1][1] - at * lines[1][0] <= lines[0][1] - at * lines[0][0]:
                lines.popleft()
            new[j], chosen[j] = at * rows[j] - tokens[j] + lines[0][1] - at * lines[0][0], lines[0][2]
        cost = new
        back.append(chosen)
    bounds, j = [], n
    for chosen in reversed(back):
        if j:
            bounds.append(histogram[j - 1][0])
            j = chosen[j]
    return bounds[::-1]


def length_histogram(df: DataFrame, length: str) -> list[tuple[int, int]]:
    """(length, rows) of the whole table."""
    counted = df.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n")).agg(F.count("*").alias("k")).toArrow()
    return list(zip(counted["n"].to_pylist(), counted["k"].to_pylist(), strict=True))


def pack(df: DataFrame, length: str, key: str, buckets: int = 12, token_budget: int = 32768, seed: int = 23) -> DataFrame:
    """Adds bucket (int, from 0), bucket_length, batch (from 0 in a bucket), slot (in a batch) and padding (long).

    ``df`` is read three times, twice for ``length`` and ``key`` alone: write it first where lengths are dear to make.
    """
    df = df.drop(*OWN, "_n", "_chunk", "_part", "_hash")
    histogram = length_histogram(df, length)
    bounds = best_bounds(histogram, buckets) or [0]
    chunks = max(64, -(-sum(k for _, k in histogram) // CHUNK))
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(n <= bounds[i], i).otherwise(bucket)
    bound = F.element_at(F.array(*[F.lit(x).cast("long") for x in bounds]), F.col("bucket") + 1)
    own = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(length).cast("string")))
    rows = df.withColumns({"_hash": own, "_n": n, "bucket": bucket})
    chunk = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") % chunks
    rows = rows.withColumns({"bucket_length": bound, "_chunk": chunk.cast("int"), "_part": F.lit(0)})
    place = ["bucket", "_chunk", "_part"]
    counts = materialize(rows.groupBy(*place).agg(F.count("*").alias("_k")))  # a row a chunk
    share = max(1, sum(k for _, k in histogram) // chunks)
    hot = counts.where(F.col("_k") > 4 * share).select("bucket", "_chunk", F.ceil(F.col("_k") / share).alias("_parts"))
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1))).cast("int")
        rows = materialize(rows.join(F.broadcast(hot), ["bucket", "_chunk"], "left").withColumn("_part", own).drop("_parts"))  # at most chunks / 4 rows are hot
        counts = materialize(rows.groupBy(*place).agg(F.count("*").alias("_k")))
    before = F.sum("_k").over(Window.partitionBy("bucket").orderBy("_chunk", "_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*place, F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("_hash", key, length)) - 1
    placed = rows.withColumn("_rank", rank).join(starts.hint("merge"), place)
    held = F.greatest(F.lit(1).cast("long"), F.expr(f"{token_budget}L div greatest(bucket_length, 1L)"))
    placed = placed.withColumn("_place", (F.col("_start") + F.col("_rank")).cast("long")).withColumn("_held", held)
    return placed.select(*df.columns, "bucket", "bucket_length", F.expr("_place div _held").alias("batch"), F.expr("_place % _held").alias("slot"), (F.col("bucket_length") - F.col("_n")).alias("padding"))


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    return pack(materialize(docs), "n_tokens", "doc_id")


#: The same by brute dynamic programming over all pairs of lengths (for at most 64 chunks of CHUNK rows).
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents),
c AS (SELECT n, row_number() OVER (ORDER BY n) AS i, CAST(sum(count(*)) OVER (ORDER BY n) AS BIGINT) AS r, CAST(sum(n * count(*)) OVER (ORDER BY n) AS BIGINT) AS t FROM d GROUP BY n),
p AS (SELECT 0 AS i, 0 AS r, 0 AS t UNION ALL SELECT i, r, t FROM c),
dp AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS cost, CAST([] AS BIGINT[]) AS bounds
    UNION ALL
    SELECT any_value(level) + 1, c.i, min(cost + c.n * (c.r - p.r) - (c.t - p.t)), arg_min(list_append(bounds, c.n), cost + c.n * (c.r - p.r) - (c.t - p.t))
    FROM dp JOIN p ON dp.j = p.i JOIN c ON c.i > p.i WHERE level < 12 GROUP BY c.i),
best AS (SELECT arg_min(bounds, cost) AS b FROM dp WHERE j = (SELECT max(i) FROM c)),
placed AS (SELECT doc_id, n, CAST(list_position(b, list_filter(b, lambda x: x >= n)[1]) - 1 AS INT) AS bucket, list_filter(b, lambda x: x >= n)[1] AS bucket_length,
    md5('23:' || coalesce(doc_id || ':', '') || n) AS h FROM d, best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64, h, doc_id, n) - 1 AS place, greatest(1, 32768 // greatest(bucket_length, 1)) AS held FROM placed)
SELECT doc_id, n AS n_tokens, bucket, bucket_length, CAST(place // held AS BIGINT) AS batch, CAST(place % held AS BIGINT) AS slot, bucket_length - n AS padding FROM ranked
"""
