"""Collocations: phrases of up to four words that occur more often together than their parts let expect, for each language.

Depth by depth, each task counts its texts' phrases in a trie (words numbered, a level a sorted array of parent and
word), and hands it on as a sorted run when it holds ``ENTRIES`` entries or ``BYTES`` of words. Spark deals the runs by
prefix range, phrases as keys, and merges equal ones. Only phrases whose first and last words but one are frequent get
a level more: frequent phrases set bits of a filter of at most ``MOST_BITS`` bits, which is sent to the next depth's
tasks. A bit too many costs a count and changes no result, since counts decide; a full filter would let all through.

In the merged trie a walk in sorted order gives each phrase's left parts (its ancestors; those that lie in the range
before are looked up, three a range at most), and suffix links, one join a depth, give its right parts.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count again; very long
texts and pieces are read whole; a phrase never crosses a separator; ties are ordered by phrase; other columns are not
read; an empty table gives no rows. Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_arrow, forget, materialize, read, small_batches

#: Words of a phrase at most, occurrences at least, phrases reported a language, and the share of a longer phrase that makes one part of it.
DEPTH, OFTEN, TOP, SHARE = 4, 30, 2000, 80
#: A-Z in lower case, what ends a piece as a line feed, what ends a word as a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: A trie is handed on at so many entries, positions not yet counted in, or bytes of words.
ENTRIES, POSITIONS, BYTES = 1_500_000, 2_000_000, 32 << 20
#: Bits of a filter for each phrase in it, at least and at most in all. A block of bits is made in one group.
BITS, LEAST_BITS, MOST_BITS, BLOCK = 64, 1 << 16, 1 << 27, 1 << 15
#: Rows that one window of the report sorts, about.
WINDOW = 100_000

_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (before + word) * _K
    return h ^ (h >> np.uint64(29))


def word_hashes(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word that starts at ``starts`` in ``flat`` (bytes), all at once: a polynomial of its bytes, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(int(sizes.max()), 0x100000001B3, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    ends = np.cumsum(sizes)
    within = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    terms = (flat[within + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)) * powers[within]
    return _mixed(np.add.reduceat(terms, ends - sizes), sizes.astype(np.uint64))


def hashes_of(words: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return word_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def _words(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of words whose bytes stand one after the other."""
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it another key begins."""
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]])


class Filter:
    """A set of phrases as bits; a phrase that was put in is always found."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(11)) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class CountTrie:
    """Counts of one language's phrases of ``depth`` words in a task's texts."""

    def __init__(self, lang: str, depth: int, known: list[Filter]):
        self.depth, self.known, self.start = depth, known, lang_hash(lang)
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.words: list[bytes] = []
        self.bytes = self.waiting = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.grams: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(self.depth))
        self.counts = np.zeros(0, np.int64)

    def add(self, texts: list[bytes]) -> None:
        low = b"\n".join(texts).translate(TABLE)
        flat = np.frombuffer(low, np.uint8)
        inside = (flat != 32) & (flat != 10)
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(flat) else np.zeros(0, np.int64)
        stops = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1 if len(flat) else starts
        words = _words(flat[inside], stops - starts)
        if self.depth == 1:
            self._counted((self._numbered(words),))
            return
        n = len(starts) - self.depth + 1
        if n <= 0:
            return
        hashes = word_hashes(flat, starts, stops - starts)
        h = _mixed(np.full(len(hashes), self.start), hashes)
        for k in range(1, self.depth - 1):
            h = _mixed(h[: len(hashes) - k], hashes[k:])
        fits = self.known[-1].has(h)  # the beginning less a word, and below the end less a word
        piece = np.cumsum(flat == 10, dtype=np.int32)[starts]
        at = np.flatnonzero((piece[:n] == piece[self.depth - 1 :]) & fits[:n] & fits[1 : n + 1])
        used = np.zeros(len(starts), bool)
        for k in range(self.depth):
            used[at + k] = True
        places = np.flatnonzero(used)  # only words of phrases that can be frequent are looked up
        ids = np.full(len(starts), -1, np.int64)
        ids[places] = self._numbered(words.take(pa.array(places)))
        self._counted(tuple(ids[at + k] for k in range(self.depth)))

    def _numbered(self, words: pa.Array) -> np.ndarray:
        """The number of each word; Arrow finds the distinct ones."""
        numbers, first = self.numbers, len(self.numbers)
        coded = words.dictionary_encode()
        own = np.fromiter(map(numbers.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if len(numbers) > first:
            new = list(islice(numbers, first, None))
            self.words += new
            self.bytes += sum(map(len, new))
        return own[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)

    def _counted(self, columns: tuple[np.ndarray, ...]) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.waiting += len(columns[0])
        if self.waiting > POSITIONS:
            self._merge()

    def _merge(self) -> None:
        """Counts what waits into the trie: level by level, (parent, word) sorted, equal ones joined."""
        columns = [np.concatenate([self.grams[k], *(p[k] for p in self.parts)]) for k in range(self.depth)]
        weight = np.concatenate([self.counts, np.ones(self.waiting, np.int64)])
        self.parts, self.waiting = [], 0
        node = columns[0]
        for k in range(1, self.depth - 1):
            order, new = _sorted((node << 32) | columns[k])
            node = np.empty(len(order), np.int64)
            node[order] = np.cumsum(new) - 1
        order, new = _sorted((node << 32) | columns[-1] if self.depth > 1 else node)
        first = np.flatnonzero(new)
        self.counts = np.add.reduceat(weight[order], first) if len(first) else weight
        self.grams = tuple(c[order[first]] for c in columns)

    def run(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """The trie's phrases of full depth, sorted word by word, with their counts; then it is empty."""
        self._merge()
        rank = np.empty(len(self.words), np.int64)
        rank[np.array(sorted(range(len(self.words)), key=self.words.__getitem__), dtype=np.int64)] = np.arange(len(self.words))
        order = np.lexsort([rank[c] for c in self.grams[::-1]]) if len(self.counts) else np.zeros(0, np.int64)
        words = pa.array(self.words, pa.large_binary()).cast(pa.large_string())
        for a in range(0, len(order), 50_000):
            some = order[a : a + 50_000]
            columns = [words.take(pa.array(c[some])) for c in self.grams]
            phrases = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if self.depth > 1 else columns[0]
            yield phrases.cast(pa.string()), self.counts[some]
        self.clear()


def _counting(depth: int, filters: list) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Filter(np.frombuffer(b.value, np.uint8)) for b in filters]
        tries: dict[str, CountTrie] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, trie in sorted(tries.items()):
                for phrases, counts in trie.run():
                    names = pa.array([lang] * len(phrases), pa.string())
                    yield pa.RecordBatch.from_arrays([names, phrases, pa.array(counts)], ["lang", "phrase", "n"])
            tries.clear()

        for whole in batches:
            for batch in small_batches(whole, "text"):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if text:
                        texts.setdefault(lang, []).append(text)
                for lang, some in texts.items():
                    if lang not in tries:
                        tries[lang] = CountTrie(lang, depth, known)
                    tries[lang].add(some)
                if sum(len(t.counts) for t in tries.values()) > ENTRIES or sum(t.bytes for t in tries.values()) > BYTES or sum(t.waiting for t in tries.values()) > 2 * POSITIONS:
                    yield from handed()
        yield from handed()

    return run


def runs(docs: DataFrame, depth: int, filters: list) -> DataFrame:
    """(lang, phrase, n): sorted runs of the tasks' tries of ``docs`` (lang, text binary). ``filters``: broadcast bits of the depths before."""
    return docs.mapInArrow(_counting(depth, filters), "lang string, phrase string, n long")


def merged(run: DataFrame) -> DataFrame:
    """Runs merged by prefix range: (lang, phrase, n), n over all."""
    return run.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _hashes_of(langs: list[str], phrases: list[str]) -> np.ndarray:
    """The hash of each phrase; all have equally many words."""
    split = [p.encode().split(b" ") for p in phrases]
    known = {x: lang_hash(x) for x in set(langs)}
    h = np.fromiter(map(known.__getitem__, langs), np.uint64, len(langs))
    for words in zip(*split, strict=True):
        h = _mixed(h, hashes_of(list(words)))
    return h


def filter_bits(frequent: DataFrame) -> bytes:
    """The bits of the phrases of ``frequent`` (lang, phrase; written): at most ``MOST_BITS``, made in blocks by the tasks."""
    bits = LEAST_BITS
    count = frequent.count()
    while bits < MOST_BITS and bits < count * BITS:
        bits *= 2
    mask = np.uint64(bits - 1)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = ((_hashes_of(rows["lang"].tolist(), rows["phrase"].tolist()) >> np.uint64(11)) & mask).astype(np.int64)
            yield pd.DataFrame({"block": at // BLOCK, "place": at % BLOCK})

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(BLOCK, np.uint8)
        held[rows["place"].to_numpy()] = 1
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    size = BLOCK // 8
    made = frequent.select("lang", "phrase").mapInPandas(places, "block long, place long").distinct()
    for r in made.groupBy("block").applyInPandas(block, "block long, bits binary").toLocalIterator():  # a row a block of the filter
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = DEPTH, often: int = OFTEN) -> tuple[list[DataFrame], DataFrame]:
    """Written tables (lang, phrase, n) of the phrases of 1 to ``depth`` words that occur ``often`` or more, and (lang, n): all words."""
    rows = bounded_arrow(docs).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.make_valid_utf8(F.col(text).cast("string")).cast("binary").alias("text")
    )
    tables: list[DataFrame] = []
    filters: list = []
    for d in range(1, depth + 1):
        run = materialize(runs(rows, d, filters[-1:]), codec="lz4")
        if d == 1:
            total = materialize(run.groupBy("lang").agg(F.sum("n").alias("n")))
        tables.append(materialize(merged(run).where(F.col("n") >= often)))
        forget(run)
        if d < depth:
            filters.append(docs.sparkSession.sparkContext.broadcast(filter_bits(tables[-1])))
    return tables, total


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted (lang, path, n) the counts of each path's beginnings; null where one lies before this range."""
    held: list[tuple[str, int]] = []
    now = None
    for batch in batches:
        left = []
        for lang, path, n in zip(batch.column("lang").to_pylist(), batch.column("path").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if lang != now:
                held, now = [], lang
            same = 0
            while same < min(len(held), len(path) - 1) and held[same][0] == path[same]:
                same += 1
            held = held[:same]
            held += [(w, None) for w in path[same:-1]]
            left.append([c for _, c in held])
            held.append((path[-1], n))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int64()))], [*batch.schema.names, "left_n"])


def with_left_parts(nodes: DataFrame) -> DataFrame:
    """``nodes`` (lang, path, n; written, all beginnings among them) with left_n: counts of the first 1, 2, ... words."""
    walked = materialize(nodes.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(_walk, "lang string, path array<string>, n long, left_n array<long>"))
    gaps = walked.where(F.exists("left_n", lambda x: x.isNull()))
    asked = gaps.select("lang", F.explode(F.filter(F.transform("left_n", lambda x, k: F.when(x.isNull(), F.slice("path", 1, k + 1))), lambda p: p.isNotNull())).alias("path")).distinct()
    lost = materialize(asked.join(nodes, ["lang", "path"]))  # at most three a range
    out = walked
    for k in range(1, DEPTH):
        own = F.broadcast(lost.where(F.size("path") == k).select("lang", F.col("path").alias("_start"), F.col("n").alias(f"_{k}")))
        out = out.withColumn("_start", F.when(F.expr(f"get(left_n, {k - 1}) IS NULL") & (F.size("left_n") >= k), F.slice("path", 1, k))).join(own, ["lang", "_start"], "left").drop("_start")
    filled = F.transform("left_n", lambda x, i: F.coalesce(x, F.array(*[f"_{k}" for k in range(1, DEPTH)])[i]))
    return out.withColumn("left_n", filled).drop(*[f"_{k}" for k in range(1, DEPTH)])


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", often: int = OFTEN, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to 4 words by their weakest cut.

    A cut's score is floor(2000000 a / (l + r)), a the phrase's occurrences, l and r those of its parts. A phrase goes
    that lies in a longer one of at least ``SHARE`` percent of its occurrences.
    """
    tables, total = frequent_phrases(docs, lang, text, DEPTH, often)
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    nodes = materialize(every.select("lang", F.split("phrase", " ", -1).alias("path"), "n"))
    left = with_left_parts(nodes).where(F.size("path") > 1).select("lang", F.array_join("path", " ").alias("phrase"), "left_n")
    after = lambda p: F.expr(f"substring({p}, instr({p}, ' ') + 1)")  # noqa: E731 - the phrase without its first word
    before = lambda p: F.expr(f"substring_index({p}, ' ', size(split({p}, ' ', -1)) - 1)")  # noqa: E731 - without its last word
    linked = tables[0].withColumn("right_n", F.array().cast("array<long>"))
    rights = []
    for t in tables[1:]:  # a suffix link leads to the phrase without its first word, whose own right parts follow
        to = linked.select("lang", F.col("phrase").alias("_link"), F.concat(F.array("n"), "right_n").alias("right_n"))
        linked = t.withColumn("_link", after("phrase")).join(to, ["lang", "_link"]).drop("_link")
        rights.append(linked)
    right = rights[0]
    for t in rights[1:]:
        right = right.unionByName(t)
    longer = every.where(F.expr("size(split(phrase, ' ', -1)) > 2")).select("lang", F.explode(F.array(after("phrase"), before("phrase"))).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    cuts = F.transform(
        F.sequence(F.lit(0), F.size("left_n") - 1),
        lambda k: F.struct(F.call_function("div", 2000000 * F.col("n").cast("decimal(20,0)"), F.col("left_n")[k].cast("decimal(20,0)") + F.col("right_n")[k].cast("decimal(20,0)")).alias("score"), k.alias("k"), F.col("left_n")[k].alias("l"), F.col("right_n")[k].alias("r")),
    )
    scored = right.join(left, ["lang", "phrase"]).join(longer, ["lang", "phrase"], "left")
    kept = scored.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < SHARE * F.col("n").cast("decimal(20,0)")))
    kept = materialize(kept.withColumn("cut", F.array_min(cuts)).select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"))
    best = most(kept, top)
    out = best.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def most(rows: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` rows with their ``rank``: first within salted parts, so that no window holds a whole language."""
    parts = rows.count() // WINDOW + 1
    order = [F.desc("score"), F.desc("a"), "phrase"]
    while parts > 1:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= top).drop("_k")
        parts = parts * top // WINDOW + 1 if parts * top > WINDOW else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


#: The same from all phrases of all pieces.
ORACLE_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(u.piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p, LATERAL (SELECT unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]+')) AS piece) u),
g AS (SELECT lang, k.k, array_to_string(w[u.i : u.i + k.k - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) AS k(k), unnest(range(1, greatest(len(w) - k.k + 2, 1))) AS u(i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30),
often AS MATERIALIZED (SELECT lang, phrase, n FROM f WHERE n >= 30),
parts AS MATERIALIZED (SELECT lang, phrase, a, j.j, array_to_string(w[1 : j.j], ' ') AS x, array_to_string(w[j.j + 1 : k], ' ') AS y FROM c, (VALUES (1), (2), (3)) AS j(j) WHERE j.j < k),
cut AS (SELECT parts.lang, parts.phrase, a, j, l.n AS l, r.n AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.n AS HUGEINT) + r.n) AS BIGINT) AS score
    FROM parts JOIN often l ON l.lang = parts.lang AND l.phrase = x JOIN often r ON r.lang = parts.lang AND r.phrase = y),
b AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(w[u.i : u.i + m.m - 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (2), (3)) AS m(m), unnest(range(1, greatest(k - m.m + 2, 1))) AS u(i) WHERE m.m < k GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE longer IS NULL OR 100 * longer < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score FROM ranked JOIN t ON ranked.lang = t.lang WHERE rank <= 2000
"""
