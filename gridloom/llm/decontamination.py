"""Test items found in training texts by a generalised suffix automaton of their words, and what leaks taken out.

Items are normalised to words and cut into chunks that overlap by a window less one word, so that each window lies in
one chunk, however long an item is. Chunks are dealt to shards of about ``SHARD`` words by a hash; a task builds each
shard's automaton, which is the only thing sent to the tasks that read texts (its size is bounded by the shard's; more
items make more shards, each another pass over the texts, with a written table between).

A text is streamed through the automaton once: at each word the longest match that ends there is kept by following
suffix links. A match of ``length`` words or more holds a window, and so hits its words. Only stretches whose trigrams
all occur among the items' are streamed; no window can lie outside these.

Defined results: null and empty texts have no words and no hits; an item without words has no windows, and a null item
id is never listed, though its windows hit; repeated items count once, repeated texts each for itself; very long texts
and items are read whole; other columns go along (clashing names are replaced); empty tables give no rows or no hits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, forget, materialize, read, small_batches

#: Words of a window; an item of fewer words is one window.
LENGTH = 10
#: Words of items in one automaton, about, and in one chunk of an item, at most.
SHARD, CHUNK = 1 << 18, 1 << 15
#: What a byte becomes: A-Z in lower case, separators a space; bytes of other letters stay.
TABLE = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Trigrams are looked up in a table of so many places.
PLACES = 1 << 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class Automaton:
    """All substrings of several word sequences; sequences are (item, words, whole), item an id or None.

    ``whole`` sequences of fewer than ``length`` words are windows by themselves.
    """

    def __init__(self, sequences: list[tuple[str | None, list[bytes], bool]], length: int = LENGTH):
        self.length, self.vocabulary = length, {}
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in words], whole) for item, words, whole in sequences]
        self.width = max(1, len(self.vocabulary))
        self.next, self.link, self.size = {}, [-1], [0]  # state * width + word -> state; suffix links; longest substrings
        following: list[list[int]] = [[]]  # the words that lead on from a state
        for _, ids, _ in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w, following)
        self._windows(coded)

    def _extend(self, last: int, w: int, following: list[list[int]]) -> int:
        nxt, link, size, width = self.next, self.link, self.size, self.width
        known = nxt.get(last * width + w)
        if known is not None and size[known] == size[last] + 1:
            return known
        cur = None
        if known is None:
            cur = self._state(size[last] + 1, following)
        p = last
        while p >= 0 and p * width + w not in nxt:
            nxt[p * width + w] = cur
            following[p].append(w)
            p = link[p]
        if p < 0:
            link[cur] = 0
            return cur
        q = nxt[p * width + w]
        if size[q] != size[p] + 1:  # q also stands for longer substrings: part it
            part = self._state(size[p] + 1, following)
            link[part], link[q] = link[q], part
            following[part] = list(following[q])
            for x in following[q]:
                nxt[part * width + x] = nxt[q * width + x]
            while p >= 0 and nxt.get(p * width + w) == q:
                nxt[p * width + w] = part
                p = link[p]
            q = part
        if cur is None:
            return q
        link[cur] = q
        return cur

    def _state(self, size: int, following: list[list[int]]) -> int:
        self.size.append(size)
        self.link.append(0)
        following.append([])
        return len(self.size) - 1

    def _windows(self, coded) -> None:
        """Which state stands for each window, which items have it, and the trigrams that a window can be found by."""
        n, link, size, width = self.length, self.link, self.size, self.width
        order = np.argsort(np.array(size), kind="stable").tolist()
        self.window = [0] * len(size)  # the state of a match's last ``length`` words
        for s in order:
            if size[s] >= n:
                self.window[s] = s if size[link[s]] < n else self.window[link[s]]
        items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str | None]]] = {}
        self.shortest = n
        for item, ids, whole in coded:
            s = 0
            for k, w in enumerate(ids):
                s = self.next[s * width + w]
                if k + 1 >= n and item is not None:
                    items.setdefault(self.window[s], set()).add(item)
            if whole and 0 < len(ids) < n:
                self.shortest = min(self.shortest, len(ids))
                if (len(ids), item) not in short.setdefault(s, []):
                    short[s].append((len(ids), item))
        self.items = {s: sorted(x) for s, x in items.items()}
        self.short, self.near = short, [0] * len(size)  # near: the first state up the suffix links, itself included, with whole short items
        for s in order[1:]:
            self.near[s] = s if s in short else self.near[link[s]]
        self.gram = min(3, self.shortest)
        self.places = np.zeros(PLACES, dtype=bool)
        for _, ids, _ in coded:
            if len(ids) >= self.gram:
                self.places[self._grams(np.array(ids, dtype=np.int64))] = True

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        key = np.zeros(len(ids) - self.gram + 1, dtype=np.uint64)
        for k in range(self.gram):
            key = (key + ids[k : k + len(key)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(20)).astype(np.int64) % PLACES

    def stretches(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, stop) of the stretches of ``ids`` that can hold a window; texts end at ``ends``."""
        g = self.gram
        if len(ids) < g:
            return np.zeros((0, 2), dtype=np.int64)
        known = ids >= 0
        good = self.places[self._grams(ids)]
        for k in range(g):
            good &= known[k : k + len(good)]
        for k in range(1, g):
            cut = ends - k
            good[cut[(cut >= 0) & (cut < len(good))]] = False
        edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stops - starts >= self.shortest - g + 1
        inside = np.stack([starts[long], stops[long] + g - 1], axis=1)
        if g > 1 or not len(inside):
            return inside
        out = []  # single words: a stretch may reach over the end of a text
        for a, b in inside.tolist():
            cuts = [a, *ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left")].tolist(), b]
            out += [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
        return np.array(out, dtype=np.int64)

    def stream(self, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """(runs of hit words, items) of a sequence of word numbers (-1: a word of no item)."""
        nxt, link, size, width, n = self.next, self.link, self.size, self.width, self.length
        window, near, short = self.window, self.near, self.short
        runs: list[tuple[int, int]] = []
        seen: set[int] = set()
        found: set[str] = set()
        state = matched = 0
        for i, w in enumerate(ids):
            to = nxt.get(state * width + w) if w >= 0 else None
            while to is None and state:
                state = link[state] if w >= 0 else 0
                matched = size[state]
                to = nxt.get(state * width + w) if w >= 0 else None
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            back = 0
            if matched >= n:
                back = n
                seen.add(window[state])
            a = near[state]
            while a:
                for m, item in short[a]:
                    if m <= matched:
                        back = max(back, m)
                        if item is not None:
                            found.add(item)
                a = near[link[a]]
            if back:
                start = i + 1 - back
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, i + 1))
        for s in seen:
            found.update(self.items.get(s, ()))
        return runs, found

    def scan(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """(words, runs of hit words, items) of each text."""
        parts = [words_of(t) for t in texts]
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        ends = np.cumsum(counts)
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(parts), repeat(-1)), np.int64, int(counts.sum()))
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for a, b in self.stretches(ids, ends).tolist():
            k = int(np.searchsorted(ends, a, "right"))
            first = a - int(ends[k] - counts[k])
            got, found = self.stream(ids[a:b].tolist())
            runs[k] += [(first + x, first + y) for x, y in got]
            items[k] |= found
        return counts, runs, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without its words ``runs`` and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in runs:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def item_chunks(items: DataFrame, item: str = "item_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(item string, n, whole, words binary): an item's words, joined by spaces, in chunks that overlap by ``length - 1`` words; each chunk once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist(), strict=True):
                words = words_of(body)
                for a in range(0, max(1, len(words) - length + 1), CHUNK):
                    some = words[a : a + CHUNK + length - 1]
                    if some:
                        rows.append((name, len(some), len(words) < length, b" ".join(some)))
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "n", "whole", "words"), r, strict=True)) for r in rows], pa.schema([("item", pa.string()), ("n", pa.int64()), ("whole", pa.bool_()), ("words", pa.binary())]))

    rows = bounded_arrow(items).select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(cut, "item string, n long, whole boolean, words binary").distinct()


def automata(items: DataFrame, item: str = "item_id", text: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(shard, automaton): a written table of pickled automata, each of about ``shard`` words."""
    chunks = materialize(item_chunks(items, item, text, length))
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    dealt = chunks.withColumn("shard", F.pmod(F.xxhash64("words", "item"), F.lit(shards)).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        sequences = sorted(((i, bytes(w), bool(k)) for i, w, k in zip(rows["item"], rows["words"], rows["whole"], strict=True)), key=lambda r: (r[1], r[0] or ""))
        made = Automaton([(i, w.split(), k) for i, w, k in sequences], length)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "automaton": [pickle.dumps(made, protocol=5)]})

    out = materialize(dealt.groupBy("shard").applyInPandas(build, "shard int, automaton binary"))
    forget(chunks)
    return out


def find_leaks(docs: DataFrame, built: DataFrame, text: str = "text", clean: str | None = None, coverage: float = 0.5) -> DataFrame:
    """``docs`` with n_words, hits (array of start and stop words) and items (ids with a window in the text, sorted as strings).

    ``built``: a table of ``automata``. With ``clean``, a column of that name holds the text without its hit spans; null
    where more than ``coverage`` of its words are hit.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "hits", "items", clean, "_body")]
    out = bounded_arrow(docs).select(*columns, F.col(text).cast("string").cast("binary").alias("_body"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("_runs"), F.array().cast("array<string>").alias("items"))
    shards = [r[0] for r in built.select("shard").orderBy("shard").collect()]  # a row a shard
    tables = []
    for place, shard in enumerate(shards or [None]):
        if tables:
            out = materialize(out)
        tables.append(out)
        automaton = pickle.dumps(Automaton([])) if shard is None else built.where(F.col("shard") == shard).first()["automaton"]
        out = _pass(out, automaton, clean if place >= len(shards) - 1 else None, coverage)
    for old in tables[1:-1]:
        forget(old)
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(_runs) div 2") - 1), lambda k: F.struct(F.col("_runs")[2 * k].alias("start"), F.col("_runs")[2 * k + 1].alias("stop")))
    hits = F.when(F.size("_runs") > 0, pairs).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    return out.select(*columns, "n_words", hits.alias("hits"), F.array_sort("items").alias("items"), *([clean] if clean else []))


def _pass(df: DataFrame, automaton: bytes, clean: str | None, coverage: float) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(automaton)
    held: dict[int, Automaton] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held[0] = pickle.loads(sent.value)
        for whole in batches:
            for batch in small_batches(whole, "_body"):
                texts = batch.column("_body").to_pylist()
                counts, runs, items = held[0].scan(texts)
                for k, (old, known) in enumerate(zip(batch.column("_runs").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    if old:
                        runs[k] += list(zip(old[::2], old[1::2], strict=True))
                    runs[k] = merged(runs[k])
                    items[k] |= set(known)
                flat = pa.array([[x for r in found for x in r] for found in runs], pa.list_(pa.int32()))
                new = {"n_words": pa.array(counts), "_runs": flat, "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
                if clean:
                    gone = [sum(b - a for a, b in r) > coverage * n for r, n in zip(runs, counts.tolist(), strict=True)]
                    new[clean] = pa.array([None if t is None or g else without(t, r).decode(errors="replace") if r else t.decode(errors="replace") for t, r, g in zip(texts, runs, gone, strict=True)], pa.string())
                names = [*batch.schema.names, *(n for n in new if n not in batch.schema.names)]
                yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + (f", `{clean}` string" if clean else "")
    return df.mapInArrow(run, schema)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, automata(read(spark, sf_dir, "benchmark")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["stop"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


#: The same from all windows of items and of texts.
ORACLE_SQL = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[u.k : u.k + least(len(w), 10) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(k) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT doc_id, l.m, u.k, array_to_string(w[u.k : u.k + l.m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM iw) AS l, unnest(range(1, len(w) - l.m + 2)) AS u(k)),
found AS (SELECT doc_id, dw.m, k, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT k + j.j) AS n FROM found, unnest(range(0, m)) AS j(j) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
