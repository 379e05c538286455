"""Groups spelling variants: which words differ by one code point, and which of them is the usual form.

Words and their counts come from whole texts, counted in each task first. Words of which one has ``r`` code points and
the other ``r`` or one more differ by one error only if they share their first or their last ``r // 2`` code points, so
each word is sent to a group for either half (four rows a word, however many are alike). Groups are dealt to buckets of
about ``BUCKET`` rows. A bucket's task builds two minimal acyclic automata with perfect-hash word numbers, one of its
words read forward and one of them read backward; each word matches its half exactly in either direction and completes
the rest with one error. A pair that both directions could meet counts in the forward one only, so nothing is counted
twice and no pair becomes a row: a word takes away its number of near words and the most frequent of them.

A half that more than ``LIMIT`` rows share is parted anew: its words go on without that half, under the same rule, so
their groups shrink until at most two code points are left. So every group is bounded by ``LIMIT``, and no pair is lost.

Defined results: null and empty texts hold no words; a null id is an empty text before the colon; repeated rows count
again, each as its own occurrences; very long texts and runs are read whole; other columns are not read; an empty table
gives no rows. Bytes that are not UTF-8 are read as U+FFFD, which is no letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, forget, materialize, read, small_batches

#: A run of letters once A-Z are lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One run in so many loses a code point.
EVERY = 97
#: Words have at least so many code points, and occur so often.
LEAST, OFTEN = 5, 3
#: What a task counts before it hands on: entries, and code points in them.
ENTRIES, POINTS = 400_000, 16 << 20
#: Rows of a bucket, about, and rows that a half may be shared by.
BUCKET, LIMIT = 40_000, 20_000
#: A table of keys of at most so many rows is broadcast.
SMALL = 1_000_000


def damaged(run: str, crc: int) -> str:
    """``run`` without the code point at ``crc % length`` where 97 divides ``crc``."""
    if crc % EVERY:
        return run
    k = crc % len(run)
    return run[:k] + run[k + 1 :]


def _count(doc_id: str, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0
        crc, get = zlib.crc32, held.get
        for whole in batches:
            for batch in small_batches(whole, text):
                for name, body in zip(batch.column(doc_id).to_pylist(), batch.column(text).to_pylist(), strict=True):
                    if not body:
                        continue
                    start = crc(f"{name or ''}:".encode())
                    for word, n in Counter(RUN.findall(body.lower().decode())).items():
                        if len(word) >= LEAST:
                            code = crc(word.encode(), start)
                            if not code % EVERY:
                                word = damaged(word, code)
                                if len(word) < LEAST:
                                    continue
                            known = get(word)
                            if known is None:
                                held[word] = n
                                size += len(word)
                            else:
                                held[word] = known + n
                    if len(held) > ENTRIES or size > POINTS:
                        yield from _handed(held)
                        held.clear()
                        size = 0
        yield from _handed(held)

    return run


def _handed(held: dict[str, int], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    words, counts = list(held), list(held.values())
    for a in range(0, len(words), rows):
        yield pa.RecordBatch.from_arrays([pa.array(words[a : a + rows], pa.string()), pa.array(counts[a : a + rows], pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", often: int = OFTEN) -> DataFrame:
    """(word, n): words that occur ``often`` times or more over all texts."""
    rows = bounded_arrow(docs).select(F.col(doc_id).cast("string").alias("_id"), F.make_valid_utf8(F.col(text).cast("string")).cast("binary").alias("_text"))
    return rows.mapInArrow(_count("_id", "_text"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


class WordNumbers:
    """A minimal acyclic automaton of sorted distinct words; ``steps[node][char]`` is (node, words that come before it there)."""

    def __init__(self, words: list[str]):
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.final = [False]
        self.count = [0]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # of the last word: parent, character, node
        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                same += 1
            self._settle(path, same, known)
            node = path[-1][2] if path else 0
            for char in word[same:]:
                child = self._node()
                path.append((node, char, child))
                node = child
            self.final[node] = True
            last = word
        self._settle(path, 0, known)
        self._finish(0)

    def _node(self) -> int:
        self.steps.append({})
        self.final.append(False)
        self.count.append(0)
        return len(self.steps) - 1

    def _finish(self, node: int) -> None:
        """Words that each step skips, and the words below."""
        seen, steps = int(self.final[node]), self.steps[node]
        for char, (child, _) in steps.items():  # characters came in order
            steps[char] = (child, seen)
            seen += self.count[child]
        self.count[node] = seen

    def _settle(self, path: list[tuple[int, str, int]], keep: int, known: dict[tuple, int]) -> None:
        """Nodes below the first ``keep`` of the path are complete: each is replaced by one that is alike, if there is one."""
        while len(path) > keep:
            parent, char, node = path.pop()
            self._finish(node)
            kind = (self.final[node], tuple(self.steps[node].items()))
            same = known.setdefault(kind, node)
            if same != node and node == len(self.steps) - 1:
                self.steps.pop(), self.final.pop(), self.count.pop()
            self.steps[parent][char] = (same, 0)

    def number(self, word: str, at: tuple[int, int] | None = (0, 0)) -> tuple[int, int] | None:
        """(node, words before) after ``word`` from a place; None where no step leads on."""
        if at is None:
            return None
        node, before = at
        steps = self.steps
        for char in word:
            to = steps[node].get(char)
            if to is None:
                return None
            node, before = to[0], before + to[1]
        return node, before

    def with_one_error(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that begin with the first ``exact`` characters of ``word`` and differ from it by one replaced or one inserted character."""
        out: list[int] = []
        at = self.number(word[:exact])
        if at is None:
            return out
        steps, final = self.steps, self.final
        node, before = at
        for k in range(exact, len(word) + 1):
            here = word[k] if k < len(word) else None
            for char, (to, skipped) in steps[node].items():
                if char != here:
                    for rest in (k, k + 1) if here is not None else (k,):  # inserted, replaced
                        end, n = to, before + skipped
                        for c in word[rest:]:
                            step = steps[end].get(c)
                            if step is None:
                                break
                            end, n = step[0], n + step[1]
                        else:
                            if final[end]:
                                out.append(n)
            step = steps[node].get(here) if here is not None else None
            if step is None:
                break
            node, before = step[0], before + step[1]
        return out


def common_start(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def near_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best): what each word of a bucket has near; best is (-n, word) of the most frequent."""
    found: dict[str, list] = {}

    def met(word: str, n: int, other: str) -> None:
        mine = found.get(word)
        if mine is None:
            found[word] = [1, -n, other]
        else:
            mine[0] += 1
            if (-n, other) < (mine[1], mine[2]):
                mine[1], mine[2] = -n, other

    codes: dict[str, str] = {}  # a context to a character that no word has
    for side in ("f", "b"):
        mine = rows[rows["side"] == side]
        members: dict[str, tuple[str, int, str]] = {}
        asked: list[tuple[str, int, int]] = []
        for context, r, cap, rest, word, n in zip(mine["context"], mine["r"], mine["cap"], mine["rest"], mine["word"], mine["n"], strict=True):
            code = codes.setdefault(context, chr(0x10000 + len(codes)))
            key = code + (rest if side == "f" else rest[::-1])
            members[key] = (word, n, rest)
            if len(rest) == r:
                asked.append((key, r, cap))
        keys = sorted(members)
        automaton = WordNumbers(keys)
        for key, r, cap in asked:
            word, n, rest = members[key]
            least = cap if side == "f" else min(cap, r // 2)
            for number in automaton.with_one_error(key, 1 + r // 2):
                other, m, theirs = members[keys[number]]
                if common_start(rest, theirs) < least:
                    met(word, m, other)
                    if len(theirs) > len(rest):
                        met(other, n, word)
    return pd.DataFrame({"word": list(found), "n_near": [x[0] for x in found.values()], "best_n": [-x[1] for x in found.values()], "best": [x[2] for x in found.values()]})


_NEVER = 1 << 30  # a cap that no common start reaches


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (context, r, cap, rest, word, n) once for each side's half; what can't count in a side is left out."""
    half, lasting = F.expr("r div 2").cast("int"), F.col("cap")
    forward = rows.select(F.lit("f").alias("side"), "*", F.expr("substring(rest, 1, r div 2)").alias("half")).where(lasting > half)
    backward = rows.where("r >= 2").select(F.lit("b").alias("side"), "*", F.expr("right(rest, r div 2)").alias("half"))
    return forward.unionByName(backward)


def near_words(words: DataFrame, bucket: int = BUCKET, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best_n, best) of ``words`` (word, n; written), for words that have any within one error."""
    size = F.char_length("word")
    rows = words.select(F.lit("").alias("context"), F.explode(F.array(size, size - 1)).alias("r"), F.lit(_NEVER).alias("cap"), F.col("word").alias("rest"), "word", "n").where("r >= 0")
    parts, left, key = [], [], ["context", "side", "r", "half"]
    while True:
        members = materialize(_halves(rows))
        counts = members.groupBy(*key).agg(F.count("*").alias("_m"))
        hot = materialize(counts.where(F.col("_m") > limit).drop("_m"))
        n_hot = hot.count()
        held = F.broadcast(hot) if n_hot <= SMALL else hot
        small = members.join(held, key, "left_anti") if n_hot else members
        buckets = max(1, -(-members.count() // bucket))
        dealt = small.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"), "side", "context", "r", "cap", "rest", "word", "n")
        parts.append(materialize(dealt.groupBy("bucket").applyInPandas(near_in_bucket_rows, "word string, n_near long, best_n long, best string")))
        forget(*left)
        left = [members, hot]
        if not n_hot:
            break
        cut = F.expr("r div 2").cast("int")
        rest = F.when(F.col("side") == "f", F.expr("substring(rest, r div 2 + 1)")).otherwise(F.expr("left(rest, char_length(rest) - r div 2)"))
        cap = F.when(F.col("side") == "f", F.when(F.col("cap") == _NEVER, _NEVER).otherwise(F.col("cap") - cut)).otherwise(F.least("cap", cut))
        name = F.sha2(F.concat_ws("\u0001", *key), 256)
        rows = members.join(held, key).select(name.alias("context"), (F.col("r") - cut).alias("r"), cap.cast("int").alias("cap"), rest.alias("rest"), "word", "n")
    forget(*left)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def near_in_bucket_rows(rows: pd.DataFrame) -> pd.DataFrame:
    return near_in_bucket(rows)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form; written): where the chain of forms that starts at a word ends. Steps double, so rounds are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        then = materialize(now.join(further, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")))
        moved = then.where("_moved").limit(1).count()
        forget(now)
        path, now = then.table_path, then.drop("_moved")
        now.table_path = path
        if not moved:
            return now


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): the near word of largest n is the form where that is ``factor`` times the word's."""
    words = materialize(words)
    usual: Column = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near_words(words), "word", "left")
    seen = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")))
    ends = roots(seen.where("form IS NOT NULL").select("word", "form"))
    return seen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(read(spark, sf_dir, "documents")))


#: The same: checksums byte by byte from a table, near words by what is left of them without one code point.
ORACLE_SQL = """
WITH RECURSIVE table_ AS (SELECT list(list_reduce(range(9), lambda a, x: CASE WHEN x = 0 THEN a WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS w FROM documents),
c AS (SELECT id, w, count(*) AS c, hex(encode(id || ':' || w)) AS x FROM o GROUP BY id, w),
h AS (SELECT w, c, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS BIGINT) AS h FROM c, table_),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS (SELECT word, n, u.k, left(word, u.k) || substr(word, u.k + 2) AS g FROM words, unnest(range(0, length(word))) AS u(k)),
near AS (SELECT a.word, b.word AS other, b.n FROM del a JOIN del b ON a.g = b.g AND a.k = b.k AND a.word <> b.word
    UNION SELECT del.word, w.word, w.n FROM del JOIN words w ON del.g = w.word UNION SELECT w.word, del.word, del.n FROM del JOIN words w ON del.g = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, row(-n, other)) AS other, max(n) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS root, form AS upward FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON walk.upward = f.word)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.upward IS NULL
"""
