"""Line removal by how often a line occurs on the pages of its site.

For each host: pages that contain a line, divided by all pages of the host. A line whose share
exceeds the boilerplate ratio, and that stands on ``min_count`` of its pages or more, is dropped from
the host's pages, wherever it stands.

Only DataFrame functions run here. A page gives each of its lines once, so counting pages is a
count that Spark combines before the exchange, and a line on a third of all rows costs a row a task.
What is kept of a host is bounded: at most (mean lines a page / ratio) of its lines can exceed the
ratio. That list joins the pages on host and a salt by row, so that a host with a third of all pages,
copies of one page among them, is dealt out over ``SALTS`` parts, or more where these would hold over ``PART`` pages
each; texts cross one exchange.

Defined results: lines are parted at \\n and compared after trimming blanks; blank lines stay and
are not counted; a null text stays null; rows with a null host, and hosts with fewer than
``min_pages`` pages, stay as they are; very long texts are read whole; an empty table gives no rows; rows count as pages, so repeated rows count repeatedly; other
columns go along (clashing names are replaced). A page whose lines all go keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Parts of a host at least, and pages of a part at most, about. A table of so many hosts may be broadcast.
SALTS, PART, SMALL = 32, 100_000, 1_000_000


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def host_pages(df: DataFrame, host: str, min_pages: int = 5) -> DataFrame:
    """(_host, _pages, _parts) of hosts with ``min_pages`` or more: how many pages, and the parts that a host is dealt to."""
    counted = df.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    return counted.withColumn("_parts", F.greatest(F.lit(SALTS), F.ceil(F.col("_pages") / PART)).cast("int"))


def boilerplate(df: DataFrame, totals: DataFrame, host: str, text: str = "text", ratio: float = 0.2, min_pages: int = 5, min_count: int = 1) -> DataFrame:
    """(_host, _parts, _drop): for each host of ``totals`` with any, the hashes of its boilerplate lines."""
    pages = df.where(F.col(host).isNotNull()).select(F.col(host).alias("_host"), F.split(text, "\n").alias("_l"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform("_l", _bare), lambda x: x != ""), lambda x: F.xxhash64(x)))
    seen = pages.select("_host", F.explode(hashes).alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_n"))
    seen = seen.where((F.col("_n") > ratio * min_pages) & (F.col("_n") >= min_count))  # below that no host with enough pages can exceed the ratio
    return seen.join(totals, "_host").where(F.col("_n") > ratio * F.col("_pages")).groupBy("_host").agg(F.first("_parts").alias("_parts"), F.collect_list("_h").alias("_drop"))


def line_dedup(df: DataFrame, host: str, text: str = "text", ratio: float = 0.2, min_pages: int = 5, min_count: int = 1) -> DataFrame:
    """``df`` with boilerplate lines taken out of ``text``, and n_lines, n_dropped (long)."""
    df = df.drop("n_lines", "n_dropped", "_host", "_pages", "_parts", "_salt", "_drop", "_l", "_kept")
    totals = materialize(host_pages(df, host, min_pages))
    lists = boilerplate(df, totals, host, text, ratio, min_pages, min_count)
    lists = lists.select("_host", "_drop", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"))
    large = totals.where(F.col("_parts") > SALTS).select("_host", "_parts")
    n_large = large.count()
    salted, parts = df.withColumn("_host", F.col(host)), F.lit(SALTS)
    if n_large:  # only then do pages have to know their host's parts
        salted = salted.join(F.broadcast(large) if n_large <= SMALL else large, "_host", "left")
        parts = F.coalesce("_parts", parts)
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))  # by row: copies of a page, too, are dealt out
    joined = salted.join(lists, ["_host", "_salt"], "left").withColumn("_l", F.split(text, "\n"))
    stays = lambda x: (_bare(x) == "") | ~F.array_contains("_drop", F.xxhash64(_bare(x)))
    joined = joined.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_l")).otherwise(F.filter("_l", stays)))
    return joined.select(
        *[F.array_join("_kept", "\n").alias(text) if c == text else F.col(c) for c in df.columns],
        F.coalesce(F.size("_l"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_l") - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: Patterns that turn a page's markup into lines: what holds no text goes, block tags end lines, other tags go.
HIDDEN, BLOCK, TAG = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", r"</?(p|div|br|li|ul|nav|h[1-6]|article|footer|title|head|body|html|tr|table)( [^>]*)?>", r"<[^>]*>"


def page_lines(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")
    return F.regexp_replace(text, r"\n[ \t\r\n]*", "\n")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), page_lines(F.col("html")).alias("text"))
    return line_dedup(pages, "host", ratio=0.2, min_pages=5)
