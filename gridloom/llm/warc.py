"""Deterministic sharded WARC writer and reader.

The records are dealt into ranges of (key, digest) with equal bytes. Bytes are added up by key and
digest first; running sums over that slim table, in key order, give each range's first (key,
digest) exactly, so the cut depends on the table alone and a rerun writes the same files. Those
first entries, ``MAX_RANGES`` at most, are sent to all tasks. Keys far apart, null keys and one key
on many rows are cut like any other; a payload repeated under one key beyond a range's bytes is
dealt over as many ranges as it fills. A range is a task: it sorts its rows by key and writes them as
files that roll over once ``roll_bytes`` compressed bytes are reached, one gzip member a record,
with headers and digests made anew from the payload.

Commit: a task writes under attempt-unique temporary names and returns a row for each file. Those
rows, from the attempts that succeeded, are the staged manifest; a second job moves the listed
files to their final names (again and again if need be) and the final manifest is written last. A
reader opens only files that the manifest lists, so what lost executors left is never read.

Equal payloads: the record with the largest key is a response, the others revisit it. Which do so
is found on (key, digest) rows; they meet the payloads as marker rows in the one exchange that the
range sort needs, so payloads move once and a payload on a third of all rows gathers nowhere.

Defined results: a null payload is empty; a null url gives no target header and reads back as null;
records with a null key are responses and come first; repeated rows of the largest key are all
responses (of such rows beyond a range's bytes, the files' layout decides which range holds which);
very long payloads are whole, each alone in memory; an empty table gives an empty manifest; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_arrow, forget, materialize, read, shared_dir

MAX_RANGES = 1 << 16
NO_KEY = -(1 << 63)
FILES = "part int, roll int, temp string, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _rid(key: int | None) -> str:
    return f"urn:page:{'' if key is None else key}"


def page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or, given ``refers_to``, a revisit record that keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))]
    headers += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return _record("response", _rid(key), headers, http + payload)
    return _record("revisit", _rid(key), [*headers, ("WARC-Refers-To", f"<{_rid(refers_to)}>"), ("WARC-Profile", PROFILE)], http)


def gz(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """The files of one range, rolled by compressed size."""

    def __init__(self, path: str, part: int, roll_bytes: int):
        self.fs, self.base = _fs(path)
        self.part, self.most, self.roll, self.out, self.done = part, roll_bytes, -1, None, []

    def add(self, record: bytes) -> None:
        data = gz(record)
        if self.out and self.bytes + len(data) > self.most:
            self.close()
        if not self.out:
            self.roll += 1
            self.name = f"range-{self.part:06d}-{self.roll:04d}.warc.gz"
            self.temp = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out, self.bytes, self.records, self.sha = self.fs.open_output_stream(f"{self.base}/{self.temp}", compression=None), 0, 0, hashlib.sha256()
            self._put(gz(_record("warcinfo", f"urn:file:{self.name}", [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
        self._put(data)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.part, self.roll, self.temp, self.name, self.records, self.bytes, self.sha.hexdigest()))
            self.out = None


def _writer(path: str, roll_bytes: int):
    schema = pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("temp", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, mark = None, [], (None, None, None)
        for batch in batches:
            for part, key, digest, refers_to, url, body in zip(*(batch.column(c) for c in ("part", "key", "digest", "refers_to", "url", "body")), strict=True):
                part, key, digest = part.as_py(), key.as_py(), digest.as_py()
                if refers_to.is_valid:  # a marker stands before the record it is about
                    mark = (key, digest, refers_to.as_py())
                    continue
                if files is None or files.part != part:
                    if files:
                        files.close()
                        done += files.done
                    files = _Files(path, part, roll_bytes)
                files.add(page_record(key, url.as_py(), body.as_py(), mark[2] if key is not None and mark[:2] == (key, digest) else None))
        if files:
            files.close()
            done += files.done
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 7, schema.types, strict=True)], schema=schema)

    return write


def _mover(path: str):
    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(path)
        for frame in frames:
            for temp, file in zip(frame["temp"], frame["file"], strict=True):
                if fs.get_file_info(f"{base}/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{temp}", f"{base}/{file}")
                elif fs.get_file_info(f"{base}/{file}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(file)
            yield frame

    return move


def _cuts(slim: DataFrame, range_bytes: int) -> tuple[int, list]:
    """The number of ranges of a table (k, digest, b) in order, and for each the (k, digest) that holds its first byte."""
    spark = slim.sparkSession
    total = slim.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    size = max(range_bytes, -(-total // MAX_RANGES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # any cut into partitions gives the same sums; only their order counts
    ordered = materialize(slim.repartitionByRange(parts, "k", "digest").withColumn("p", F.spark_partition_id()))
    earlier = F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ordered.groupBy("p").agg(F.sum("b").alias("s")).select("p", earlier.alias("before"))
    own = F.sum("b").over(Window.partitionBy("p").orderBy("k", "digest").rowsBetween(Window.unboundedPreceding, 0))
    placed = ordered.withColumn("own", own).join(F.broadcast(starts), "p").select("k", "digest", (F.col("before") + F.col("own") - F.col("b")).alias("start"), (F.col("before") + F.col("own")).alias("end"))
    crossing = placed.where(F.expr(f"start = 0 OR (start - 1) div {size} <> (end - 1) div {size}"))
    found = [(r.k, r.digest, r.end) for r in crossing.orderBy("start").toLocalIterator()]
    forget(ordered)
    firsts = []
    for k, digest, end in found:
        firsts += [(k, digest)] * ((end - 1) // size + 1 - len(firsts))
    return max(len(firsts), 1), firsts


def _part_of(firsts: list):
    """A column function from (key, digest) to the first range that may hold it and how many may."""
    keys, entries = np.array([k for k, _ in firsts], np.int64), firsts

    def find(k: pd.Series, digest: pd.Series) -> pd.DataFrame:
        low, high = np.searchsorted(keys, k.to_numpy(), "left"), np.searchsorted(keys, k.to_numpy(), "right")
        first, span = np.maximum(high - 1, 0), np.ones(len(k), np.int64)
        for i in np.flatnonzero(high > low).tolist():  # ranges that begin inside this key
            entry = (int(k.iat[i]), digest.iat[i])
            a, b = bisect.bisect_left(entries, entry, int(low[i]), int(high[i])), bisect.bisect_right(entries, entry, int(low[i]), int(high[i]))
            first[i], span[i] = (a, b - a) if b > a else (max(a - 1, 0), 1)
        return pd.DataFrame({"first": first, "span": span})

    return F.pandas_udf(find, "first int, span int")


def write_warc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", range_bytes: int = 16 << 20, roll_bytes: int = 8 << 20) -> DataFrame:
    """Writes ``df`` as WARC files under ``path`` (a folder that all executors reach) and returns the manifest."""
    spark = df.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = bounded_arrow(df).select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("body")).withColumns({"digest": F.sha1("body"), "k": F.coalesce("key", F.lit(NO_KEY))})
    # a record's header counts too, so that records without a payload fill ranges as well
    slim = materialize(rows.groupBy("k", "key", "digest").agg(F.sum(F.octet_length("body") + 600).cast("long").alias("b"), F.count("*").alias("c")))
    ranges, firsts = _cuts(slim.groupBy("k", "digest").agg(F.sum("b").alias("b")), range_bytes)
    place = _part_of(firsts)
    copied = slim.groupBy("digest").agg(F.max("key").alias("refers_to"), F.sum("c").alias("n")).where("n > 1").drop("n")
    marks = slim.select("k", "key", "digest").join(copied, "digest").where("key < refers_to").withColumn("at", place("k", "digest"))
    marks = marks.select(F.explode(F.sequence("at.first", F.expr("at.first + at.span - 1"))).alias("part"), "key", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"))
    dealt = rows.withColumn("at", place("k", "digest"))
    spread = F.when(F.col("at.span") == 1, 0).otherwise(F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.col("at.span"))).cast("int")
    both = dealt.select((F.col("at.first") + spread).alias("part"), "key", "digest", F.lit(None).cast("long").alias("refers_to"), "url", "body").unionByName(marks)
    placed = both.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key", "digest", F.col("refers_to").desc_nulls_last(), "url")
    staged = materialize(placed.mapInArrow(_writer(path, roll_bytes), FILES))
    staged.repartition(min(ranges, 64), "file").mapInPandas(_mover(path), FILES).drop("temp").write.mode("overwrite").parquet(f"{path}/manifest.parquet")
    forget(slim, staged)
    fs, base = _fs(path)
    if fs.get_file_info(f"{base}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(FILES.replace("temp string, ", "")).parquet(f"{path}/manifest.parquet")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other, read in pieces."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(1 << 20):
        rest = b""
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            rest, z, out = z.unused_data, zlib.decompressobj(31), []
    if out:
        raise ValueError("a gzip member is cut off")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block, its length and digest checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"not a sound record: {headers.get('warc-record-id')}")
    return headers, block


def _page_id(rid: str | None) -> int | None:
    digits = (rid or "").strip("<>").removeprefix("urn:page:")
    return int(digits) if digits else None


def _page_row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    response = headers["warc-type"] == "response"
    if response and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload and digest differ: {headers['warc-record-id']}")
    url = headers.get("warc-target-uri")
    url = url and re.sub(r"%(\d[0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), url)
    return _page_id(headers["warc-record-id"]), url, headers["warc-type"], _page_id(headers.get("warc-refers-to")), digest, length, payload if response and with_payload else None


def read_warc(manifest: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The page records of the files that a manifest lists: RECORDS. A revisit's payload is null; it is that of ``refers_to``."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(path)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        frame = lambda out: pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        for files in frames:
            for file in files["file"]:
                out, held = [], 0
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for member in members(stream):
                        headers, block = parse(member)
                        if headers["warc-type"] != "warcinfo":
                            out.append(_page_row(headers, block, with_payload))
                            held += len(out[-1][-1] or b"") + 300
                        if held > 8 << 20:
                            yield frame(out)
                            out, held = [], 0
                yield frame(out)

    files = manifest.select("file")
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.repartition(n, "file").mapInPandas(rows, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    manifest = write_warc(read(spark, sf_dir, "pages"), path)
    return read_warc(manifest, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to, d AS payload_digest
FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
        (strpos('0123456789abcdef', substr(h, 5 * k.k // 4 + 1, 1)) - 1) * 16
        + coalesce(nullif(strpos('0123456789abcdef', substr(h || '0', 5 * k.k // 4 + 2, 1)), 0), 1) - 1)
        // CAST(pow(2, 3 - 5 * k.k % 4) AS BIGINT) % 32 + 1 AS BIGINT), 1), '' ORDER BY k.k)
     FROM range(32) AS k(k)) AS d
    FROM (SELECT *, sha1(coalesce(html, '')) AS h FROM pages))
"""
