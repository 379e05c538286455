"""Near-duplicate documents by banded MinHash and sequential Bayesian verification.

1. Each text becomes a set of word shingles, hashed to 64 bits; its MinHash signature, band keys and
   the 128-bit digest of the whole set are written to the shared folder.
2. Texts with equal sets form a class; only the class's smallest id goes on, so copies cost nothing.
3. Ids that share a band key are candidates. First, each bucket's ids are compared with its smallest
   id. Then what that left apart: the ids of a bucket outside its most frequent component with all
   others of another component, in blocks of about ``BLOCK`` rows or ``BLOCK_BYTES`` of text on either side, inside tasks, by
   signatures of ``DEEP`` hashes made for these ids alone. A pair is compared in the first band it
   shares only. A block tries its likely links, likeliest first, and skips those whose ends it has
   joined already, so it gives fewer links than it has rows. Pairs are never rows of their own, and
   no candidate pair that could join two components is left out.
4. Signatures are compared batch of hashes by batch: with a uniform prior and m of n hashes equal,
   the posterior chance of reaching the threshold is a binomial tail, and a pair is dropped once
   that is below ``MISS``. Survivors are verified on their full sets.
5. Links, and the links of copies to their class, give the connected components.

With 28 bands of 4 rows a pair at the threshold of 0.80 shares no band with probability 4e-7, at
0.85 with 1e-9. Tables of ids join by broadcast only after a count shows that they are small.

Defined results: a text without words has an empty set and is linked with nothing; a shorter text
than a shingle is one shingle; a null id is linked with nothing, its component is null and it is
kept; rows that repeat an id are one document, linked by any of its texts, and share its result;
very long texts are compared whole; an empty table gives no rows; ``drop_near_duplicates`` keeps all
other columns, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, forget, materialize, read, small_batches
from .graph import components

BANDS, ROWS = 28, 4
#: The chance, at each look, that a pair at the threshold is dropped.
MISS = 1e-7
#: Hashes compared by the end of each look.
LOOKS = (16, 32, 64, BANDS * ROWS)
#: Hashes of the signatures that blocks compare, the looks at them, and rows and bytes of a block's side, by which buckets are parted.
DEEP, DEEP_LOOKS, BLOCK, BLOCK_BYTES = 512, (16, 64, 128, 256, 512), 512, 4 << 20
#: A table of ids and hashes with at most so many rows (24 MB) may be broadcast.
SMALL = 1_000_000

_M = np.uint64
_random = np.random.Generator(np.random.PCG64(20240501))
_ODD = _random.integers(1 << 62, 1 << 63, 40, dtype=np.uint64) * _M(2) + _M(1)
_A = _random.integers(1 << 62, 1 << 63, DEEP, dtype=np.uint64) * _M(2) + _M(1)
_B = _random.integers(0, 1 << 63, DEEP, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(33))) * _M(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _M(33))) * _M(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _M(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_word = _Words()


def shingles(raw: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of a UTF-8 text, hashed. Letters A-Z are lower-cased; words part at ASCII white space."""
    found = (raw or b"").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word.__getitem__, found), np.uint64, n)
    if n < width:  # the whole sequence; its length is part of the hash
        return _mix((h * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _ODD[39])
    s = h[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        s = s + h[k : n - width + 1 + k] * _ODD[k]
    return np.unique(_mix(s))


def signature(shingle_set: np.ndarray, hashes: int = BANDS * ROWS) -> np.ndarray:
    """The MinHash values (32 bits each) of a set."""
    low = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_set), 2048):
        part = shingle_set[at : at + 2048]
        low = np.minimum(low, (part[None, :] * _A[:hashes, None] + _B[:hashes, None]).min(axis=1))
    return low >> _M(32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = (sig.reshape(BANDS, ROWS) * _ODD[None, :ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[38]
    return _mix(keys).view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "raw"):
                n, high, low, bands, sigs = [], [], [], [], []
                texts = batch.column("raw").to_pylist()
                for raw in texts:
                    found = shingles(raw, width)
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    sig = signature(found)
                    a, b = struct.unpack("<qq", digest)
                    n.append(len(found))
                    high.append(a)
                    low.append(b)
                    bands.append(band_keys(sig))
                    sigs.append((sig & _M(255)).astype(np.uint8).tobytes())
                keys = pa.ListArray.from_arrays(np.arange(0, len(n) * BANDS + 1, BANDS, dtype=np.int32), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), keys, pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "size", "high", "low", "bands", "sig"])

    return run


def _sign_deep(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deep = []
            for raw in batch.column("raw").to_pylist():
                sig = signature(shingles(raw, width), DEEP)
                deep.append(band_keys(sig[: BANDS * ROWS]).astype(np.uint32).tobytes() + (sig & _M(255)).astype(np.uint8).tobytes())
            yield batch.append_column("sig", pa.array(deep, pa.binary()))

    return run


@cache
def least_matches(percent: int, looks: tuple = LOOKS) -> dict[int, int]:
    """For each look's count of hashes, the fewest equal ones with which a pair goes on.

    Eight bits of each hash are kept, so hashes of different shingles agree by chance once in 256.
    The posterior chance of a similarity over the threshold, uniform prior, is P(Bin(n + 1, p) <= m).
    """
    p = percent / 100 + (1 - percent / 100) / 256
    found = {}
    for n in looks:
        tail, m = 0.0, 0
        while (tail := tail + comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)) < MISS:
            m += 1
        found[n] = m
    return found


def _prune(percent: int):
    bounds = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            alive, same, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n in LOOKS:
                same = same + (x[alive, at:n] == y[alive, at:n]).sum(axis=1)
                go_on = same >= bounds[n]
                alive, same, at = alive[go_on], same[go_on], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


class _Forest(dict):
    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def block_links(ids: list, sizes: list, parts: list, sides: list, bands: list, sigs: list, raws: list, width: int, percent: int) -> list[tuple[int, int]]:
    """Verified links between the rows of a block that lie in different parts: enough to join all that belong together.

    ``sides``: rows of side 0 are compared with those of side 1, rows of side 2 with all others.
    ``bands``: the band of the bucket; pairs that share an earlier band are compared there.
    """
    bounds = least_matches(percent, DEEP_LOOKS)
    packed = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1)
    keys = np.ascontiguousarray(packed[:, : 4 * BANDS]).view(np.uint32)[:, : bands[0]]
    cuts = [0, *DEEP_LOOKS]
    looks = [(to, np.ascontiguousarray(packed[:, 4 * BANDS + at : 4 * BANDS + to])) for at, to in zip(cuts, cuts[1:], strict=False)]
    n, part, side, found = np.array(sizes), np.array(parts), np.array(sides), []
    for i in np.flatnonzero(side != 1).tolist():
        same = (looks[0][1] == looks[0][1][i]).sum(axis=1)
        apart = (same >= bounds[looks[0][0]]) & (part != part[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if side[i] == 0:
            apart &= side == 1
        else:
            apart[: i + 1] = False
        alive = np.flatnonzero(apart)
        if len(alive):
            alive = alive[~(keys[alive] == keys[i]).any(axis=1)]
        same = same[alive]
        for to, x in looks[1:]:
            if not len(alive):
                break
            same = same + (x[alive] == x[i]).sum(axis=1)
            go_on = same >= bounds[to]
            alive, same = alive[go_on], same[go_on]
        found += [(-int(m), i, int(j)) for j, m in zip(alive, same, strict=True)]
    joined, sets, out = _Forest(), {}, []

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(raws[i], width)
        return sets[i]

    for _, i, j in sorted(found):
        a, b = joined.root(parts[i]), joined.root(parts[j])
        if a != b and similar(of(i), of(j), percent):
            joined[a] = b
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _blocks(width: int, percent: int):
    columns = ("doc_id", "n", "part", "side", "band", "sig", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {c: [] for c in columns}, None  # the rows of the block that is being read
        links = lambda: block_links(*held.values(), width, percent) if len(held["n"]) > 1 else []
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        for batch in batches:
            out, block = [], np.asarray(batch.column("block"))
            rows = {c: batch.column(c).to_pylist() for c in columns}
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if block[a] != now:
                        out += links()
                        held, now = {c: [] for c in columns}, block[a]
                    for c in columns:
                        held[c] += rows[c][a:b]
            yield as_batch(out)
        yield as_batch(links())

    return run


def block_rows(mixed: DataFrame) -> DataFrame:
    """Deals the rows of buckets (key, band, doc_id, n, size, part, main) out to blocks: those outside the main part meet all, those in it only the others."""
    rest = F.col("part") != F.col("main")
    blocks = lambda side: F.ceil(F.greatest(F.count_if(side) / BLOCK, F.sum(F.when(side, F.col("size")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    sizes = materialize(mixed.groupBy("key").agg(blocks(~rest).alias("ins"), blocks(rest).alias("outs")))
    rows = mixed.join(_small(sizes), "key")
    own = F.pmod(F.xxhash64("doc_id"), F.when(rest, F.col("outs")).otherwise(F.col("ins"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda x, kind, y, side: F.struct(x.alias("x"), F.lit(kind).alias("kind"), y.alias("y"), side.cast("int").alias("side"))
    me = F.col("own")
    others = F.transform(upto("outs"), lambda s: place(F.least(me, s), "r", F.greatest(me, s), F.when(me == s, 2).when(me < s, 0).otherwise(1)))
    mains = F.transform(upto("ins"), lambda s: place(me, "m", s, F.lit(0)))
    rests = F.transform(upto("outs"), lambda s: place(s, "m", me, F.lit(1)))
    rows = rows.withColumn("at", F.explode(F.when(rest, F.concat(others, mains)).otherwise(rests)))
    return rows.select(F.xxhash64("key", "at.x", "at.kind", "at.y").alias("block"), "doc_id", "n", "part", "band", F.col("at.side").alias("side"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = {}, 0

        def of(raw: bytes) -> np.ndarray:
            nonlocal held
            found = kept.get(raw)
            if found is None:
                if held > 32 << 20:
                    kept.clear()
                    held = 0
                found = kept[raw] = shingles(raw, width)
                held += len(raw) + found.nbytes
            return found

        for batch in batches:
            a, b, x, y = (batch.column(c) for c in ("a", "b", "raw_a", "raw_b"))
            good = [i for i, (p, q) in enumerate(zip(x.to_pylist(), y.to_pylist(), strict=True)) if similar(of(p), of(q), percent)]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(good, pa.int64())), b.take(pa.array(good, pa.int64()))], ["a", "b"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a written table), marked for broadcast if its count proves it small; else Spark joins by sorting."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _on(pairs: DataFrame, table: DataFrame, side: str, column: str) -> DataFrame:
    return pairs.join(table.select(F.col("doc_id").alias(side), F.col(column).alias(f"{column}_{side}")), side)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    raw = bounded_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    signed = materialize(raw.mapInArrow(_sign(width), "doc_id long, n_shingles long, size long, high long, low long, bands array<long>, sig binary"))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    tagged = full.join(_small(classes), ["high", "low"], "left")
    copies = tagged.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = tagged.where("rep IS NULL OR rep = doc_id")

    banded = reps.select("doc_id", F.col("n_shingles").alias("n"), "size", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.max("doc_id").alias("last")).where("pivot.doc_id < last").drop("last")
    # one row a bucket: small ones go to the rows; of large ones Spark splits the partitions of hot keys
    shared = materialize(shared)
    buckets = materialize(banded.join(_small(shared), "key").select("key", "band", "doc_id", "n", "size", "pivot"))
    fair = f"100 * least(n, {{0}}) >= {percent} * greatest(n, {{0}})"
    stars = materialize(buckets.where("doc_id <> pivot.doc_id").where(fair.format("pivot.n")).select(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    ids = materialize(buckets.select("doc_id").distinct())
    texts = materialize(raw.join(_small(ids), "doc_id", "left_semi"))
    sigs = materialize(reps.join(_small(ids), "doc_id", "left_semi").select("doc_id", "sig"))

    def confirmed(close: DataFrame) -> DataFrame:
        whole = _on(_on(close, texts, "b", "raw"), texts, "a", "raw")
        return materialize(whole.mapInArrow(_confirm(width, percent), "a long, b long").distinct())

    close = materialize(_on(_on(stars, sigs, "a", "sig"), sigs, "b", "sig").mapInArrow(_prune(percent), "a long, b long"))
    links = confirmed(close)

    # the rows of buckets that hold several components, with their component and the bucket's most frequent one
    found = components(links).select(F.col("id").alias("doc_id"), "component")
    parted = buckets.drop("pivot").join(found, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    parted = materialize(parted)
    sizes = parted.groupBy("key", "part").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mains = materialize(mixed)
    mixed = materialize(parted.join(_small(mains), "key"))
    apart = materialize(mixed.select("doc_id").distinct())
    deep = materialize(texts.join(_small(apart), "doc_id", "left_semi").mapInArrow(_sign_deep(width), "doc_id long, raw binary, sig binary"))
    dealt = block_rows(mixed).join(deep, "doc_id").repartition("block").sortWithinPartitions("block")
    more = materialize(dealt.mapInArrow(_blocks(width, percent), "a long, b long").distinct())
    links = links.unionByName(more)

    found = materialize(components(links.unionByName(copies)))
    forget(classes, shared, buckets, stars, ids, texts, sigs, close, parted, mains, mixed, apart, deep, more)
    rows = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those with a smaller id in their component."""
    gone = materialize(near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct())
    return docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)


#: All pairs that share a shingle, by their whole sets; then what each document reaches.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[u.i : u.i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) u WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
    GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
r AS (SELECT a AS doc_id, a AS r FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.r),
c AS (SELECT doc_id, min(r) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
