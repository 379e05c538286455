"""Spelling variants, collocations and leaked test items against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import collocations as co
from gridloom.llm import decontamination as de
from gridloom.llm import spelling as sp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- leaked test items
def leak_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_leaks(docs, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        w = leak_words(text)
        if w:
            for k in range(max(1, len(w) - length + 1)):
                windows[tuple(w[k : k + length])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = leak_words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), ids))
    return sorted(out, key=str)


def leak_tables(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "Ç", "été", "x1", "Q"])  # noqa: E731 - few words, so that windows share much
    prose = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(k, prose(r.choice([3, 9, 10, 11, 25, 60]))) for k in range(30)] + [(30, None), (31, ""), (32, "... !"), (33, "Only two"), (None, prose(14)), (5, prose(12)), (7, "b a b")]
    items += items[:2]
    docs = [(k, prose(r.randrange(60)) + " " + (r.choice(items)[1] or "") + " " + prose(r.randrange(9))) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "---"), (None, items[3][1]), (63, "only TWO"), (64, " ".join(["z"] * 70_000) + " " + items[4][1]), *docs[:3]]
    return docs, items


@pytest.mark.parametrize("seed,shard", [(1, 1 << 18), (2, 120)])
def test_leaks_equal_brute_force(spark, seed, shard):
    docs, items = leak_tables(seed)
    built = de.automata(spark.createDataFrame(items, "item_id long, text string"), shard=shard)
    assert (built.count() > 3) == (shard == 120)
    got = de.find_leaks(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_words int, items string"), built)
    rows = sorted(((r.doc_id, r.n_words, sum(h.stop - h.start for h in r.hits), r["items"]) for r in got.collect()), key=str)
    assert rows == brute_leaks(docs, items)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(de, "CHUNK", 16)
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(40)}" for _ in range(500))
    words = text.split()
    docs = [(k, "x " + " ".join(words[k : k + 10 + k % 5]) + " y") for k in range(0, 480, 7)] + [(1000, " ".join(words[3:12]))]
    built = de.automata(spark.createDataFrame([(1, text)], "item_id long, text string"))
    got = {r.doc_id: r.hits for r in de.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), built).collect()}
    assert not got.pop(1000) and all(got.values())


def test_leaks_are_taken_out(spark):
    leak = " ".join(f"t{k}" for k in range(12))
    built = de.automata(spark.createDataFrame([("i", leak)], "item_id string, text string"))
    docs = spark.createDataFrame([(1, f"Vorher: {'w ' * 40}(«{leak.upper().replace(' ', ', ')}») nachher."), (2, f"kurz {leak}"), (3, "rein"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.clean for r in de.find_leaks(docs, built, clean="clean", coverage=0.5).collect()}
    assert {k: got[k] for k in (2, 3, 4)} == {2: None, 3: "rein", 4: None}
    assert got[1].startswith("Vorher: w ") and "T3" not in got[1] and got[1].endswith("nachher.")
    none = de.automata(spark.createDataFrame([], "item_id string, text string"))
    assert [(r.doc_id, r.n_words, len(r.hits), r.clean) for r in de.find_leaks(docs.where("doc_id > 2"), none, clean="clean").collect()] == [(3, 1, 0, "rein"), (4, 0, 0, None)]
    assert de.find_leaks(docs.where("false"), built).count() == 0


def test_op13_rows(spark, tmp_path):
    docs, items = leak_tables(4)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in de.op13_decontamination(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute_leaks(docs, items)), key=str)


# --- spelling variants
def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    out, form = {}, {}
    for w in n:
        near = sorted((-n[v], v) for v in n if is_near(w, v))
        if near and -near[0][0] >= 2 * n[w]:
            form[w] = near[0][1]
        out[w] = len(near)
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n[w], out[w], n[form[w]] if w in form else None) for w in n)


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def spelled(seed, docs=80):
    r = random.Random(seed)
    stems = ["maison", "straße", "größer", "wÖrter", "aaaaaa", "aaaaab", "banana", "langesWort" * 3]
    def word():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randrange(len(w) + 1)
            w[k : k + r.choice([0, 1])] = r.choice(["", "a", "é", "Z"])
        return "".join(w)
    return [(k, " ".join(word() + r.choice(["", "×", ".", "1"]) for _ in range(60))) for k in range(docs)] + [(None, "maison maison Maison"), (900, None), (901, ""), (902, "ab " * 9), (903, "q" * 50_000 + " " + "kleines " * 20_000)]


def test_word_counts_equal_brute_force(spark, monkeypatch):
    docs = spelled(1)
    docs += docs[:2]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, word int, n string")
    assert {r.word: r.n for r in sp.word_counts(table).collect()} == brute_words(docs)
    monkeypatch.setattr(sp, "ENTRIES", 50)
    assert {r.word: r.n for r in sp.word_counts(table.repartition(3)).collect()} == brute_words(docs)
    assert sp.word_counts(table.where("false")).count() == 0


@pytest.mark.parametrize("bucket,limit", [(40_000, 20_000), (200, 25)])
def test_variants_equal_brute_force(spark, bucket, limit):
    r = random.Random(5)
    n = dict(brute_words(spelled(2)))
    n |= {"".join(r.choice("ab") for _ in range(r.randrange(5, 9))): r.choice([3, 3, 4, 9, 40]) for _ in range(250)}  # dense: halves are shared by many
    n |= {"gleich" + x: 7 for x in "abcdé"} | {"z" * k: 3 + 10 * k for k in range(5, 9)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    if limit == 25:
        from gridloom.llm.common import materialize

        near = {x.word: (x.n_near, x.best_n, x.best) for x in sp.near_words(materialize(words), bucket, limit).collect()}
        for w in n:
            own = sorted((-n[v], v) for v in n if is_near(w, v))
            assert near.get(w) == ((len(own), -own[0][0], own[0][1]) if own else None), w
    else:
        assert variant_rows(sp.spelling_variants(words)) == brute_variants(n)
        assert sp.spelling_variants(words.where("false")).count() == 0


def test_op11_rows(spark, tmp_path):
    docs = spelled(3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert variant_rows(sp.op11_spelling_variants(spark, str(tmp_path))) == brute_variants(brute_words(docs))


# --- collocations
def brute_collocations(docs, often, top):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for d in range(1, 5):
                for k in range(len(w) - d + 1):
                    f[lang][tuple(w[k : k + d])] += 1
    out = []
    for lang, n in f.items():
        some = {p: a for p, a in n.items() if len(p) > 1 and a >= often}
        inside = lambda p, q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in some.items()):
                continue
            score, k = min((2_000_000 * a // (n[p[:k]] + n[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), n[p[:k]], n[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, total[lang], -s))
    return sorted(out)


def phrased(seed, docs=60):
    r = random.Random(seed)
    fixed = ["New York City", "im großen und ganzen", "a a a a a", "de la", "x\x01 y", "Été à", "zu"]
    text = lambda: "".join(r.choice([*fixed, *"abcdef"]) + r.choice([" ", " ", " \t", ". ", "\n", ";"]) for _ in range(r.randrange(120)))
    rows = [(r.choice(["en", "de", None, "und"]), text()) for _ in range(docs)]
    return rows + [("en", None), ("en", ""), ("fr", " . "), ("en", "new york city " * 8_000), *rows[:3]]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    docs, top = phrased(1 + small), 2000
    if small:  # runs, windows and filters of a few entries
        monkeypatch.setattr(co, "ENTRIES", 40), monkeypatch.setattr(co, "POSITIONS", 30), monkeypatch.setattr(co, "WINDOW", 20), monkeypatch.setattr(co, "LEAST_BITS", 1 << 15)
        top = 5
    table = spark.createDataFrame([(*d, 1, "q") for d in docs], "lang string, text string, n int, phrase string").repartition(5)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(table, often=12, top=top).collect())
    assert got == brute_collocations(docs, 12, top)
    assert len(got) > 5 and {r[0] for r in got} >= {"en", "de", "und"}


def test_collocations_of_odd_tables(spark):
    table = spark.createDataFrame([("en", None), ("en", ""), (None, "one two")], "lang string, text string")
    assert co.collocations(table).count() == 0 == co.collocations(table.where("false")).count()


def test_walk_finds_parts_across_ranges(spark):
    paths = {("a",): 90, ("a", "b"): 80, ("a", "b", "c"): 70, ("a\x01",): 60, **{("a", "b", "c", f"w{k}"): 40 + k for k in range(200)}}
    rows = [("en", list(p), n) for p, n in paths.items()] + [("de", list(p), n + 1) for p, n in paths.items()]
    from gridloom.llm.common import materialize

    nodes = materialize(spark.createDataFrame(rows, "lang string, path array<string>, n long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = co.with_left_parts(nodes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for r in got:
        assert r.left_n == [paths[tuple(r.path[:k])] + (r.lang == "de") for k in range(1, len(r.path))]


def test_op12_rows(spark, tmp_path):
    docs = phrased(7)
    spark.createDataFrame(docs, "lang string, text string").withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.op12_collocations(spark, str(tmp_path)).collect())
    assert got == brute_collocations(docs, 30, 2000)
