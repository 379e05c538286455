"""Each operator against a brute-force version, a round trip or held-out accuracy, on small tables."""

import base64
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import attention_lm as lm
from gridloom.llm import bpe, graph, line_crf, line_dedup, media, minhash, packing, quality_rules, sharding, warc
from gridloom.llm.common import crc_mod, shared_dir

DOCS = "doc_id long, text string"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


# --- near duplicates
def brute_components(texts, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(t or "").translate(lower).split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set() for w in split]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, seed, edits):
    r, found = random.Random(seed), text.split()
    for _ in range(edits):
        found[r.randrange(len(found))] = f"e{r.randrange(9999)}"
    return " ".join(found)


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_minhash_components_equal_brute_force(spark, width, percent):
    base, other = prose(1, 150), prose(2, 90)
    texts = [base, base.upper(), *[edited(base, k, k % 9) for k in range(60)], other, *[edited(other, k, 1 + k % 4) for k in range(20)], *[prose(k, 60) for k in range(40, 60)]]
    texts += [None, "", " \n", "one", "one", "One two", "one two", "one two three", "é É"]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs_of(spark, texts), width, percent).collect()}
    want, sizes = brute_components(texts, width, percent)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))
    left = minhash.drop_near_duplicates(docs_of(spark, texts).withColumn("sig", F.lit(1)), width, percent)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want)) and "sig" in left.columns


def test_minhash_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "x y z u v w"), (2, "x y z u v w")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 2, 1, False), (False, 3, 1, False), (True, 0, None, True)]


def test_posterior_bound_spares_true_pairs():
    for n, least in minhash.least_matches(85).items():
        assert 0 < least < 0.85 * n
        draws = np.random.default_rng(0).binomial(n, 0.85, 200_000)
        assert (draws < least).mean() < 1e-4


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (139, 200)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in [*range(100, 140), 200])


# --- media
def png(body=b"\0\xff"):
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\0" + b"\x3b"


def bmp():
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\x00\x08\1\1\0\0\x3f\0ab\xff\xd9"


def zipped():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("a", "hello")
    return out.getvalue()


KINDS = [("image/png", png()), ("image/gif", gif()), ("image/bmp", bmp()), ("image/jpeg", jpeg()), ("audio/wav", media.wav(b"abcd")), ("video/mp4", b"\0\0\0\x10ftypisom\0\0\0\0\0\0\0\x0cmoovabcd"), ("application/zip", zipped()), ("application/pdf", b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"), ("application/gzip", warc.gz(b"hello"))]


def test_sniffing_types_and_carves(spark):
    rows = [(k, "text/plain", kind, blob) for k, (kind, blob) in enumerate(KINDS)]
    rows += [(20, "image/gif", "image/gif", b"junk BM GIF8 RIFF"), (21, "a", "a", b""), (22, "a", None, None), (23, "x/y", "x/y", png()[:-1]), (24, "x/y", "x/y", b"head" + png() + b"mid" + jpeg() + b"BMtail")]
    df = spark.createDataFrame(rows, "id int, declared string, want string, media binary")
    out = media.media_types(df)
    assert all(r.media_type == r.want for r in out.collect())
    parts = media.carve(out).where("id = 24").orderBy("item.offset").collect()
    assert [(r.item.type, bytes(r.carved)) for r in parts] == [("image/png", png()), ("image/jpeg", jpeg())]


def test_texts_survive_as_samples(spark):
    texts = ["", "a" * 64, "é" * 33, None, "BM RIFF\0x", prose(1, 3000)]
    df = media.carve(media.media_types(media.texts_to_wav(docs_of(spark, texts).withColumn("items", F.lit(1)))), body=True).where("item.offset = 0")
    got = {r.doc_id: (bytes(r.carved), r.n_bytes, r.corrected) for r in df.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert got[i] == (pad, len(raw), True)


def test_marks_are_found_once_a_blob():
    import time

    began = time.time()
    assert media.sniff(b"%PDF-1.4 " * 200_000) == [] and media.sniff(b"GIF89a!,abcdefgh;" * 100_000) == []
    assert time.time() - began < 8


def test_op2_rows(spark, tmp_path):
    texts = ["", "a" * 64, "é" * 33, None, "BM RIFF\0x", prose(1, 3000), "PK\3\4 ftyp GIF89a"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in media.op2_media_sniffing(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        pay = raw + bytes((-len(raw)) % 64 if raw else 64)
        blob = media.wav(pay)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(pay), zlib.crc32(pay[-64:]), len(blob))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(pay).hexdigest(), hashlib.sha256(blob).hexdigest())
    docs_of(spark, texts).where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op2_media_sniffing(spark, f"{tmp_path}/none").count() == 0


# --- line CRF
def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    sizes, trans = np.array([1, 3, 4, 2]), r.normal(size=(2, 2))
    emit = r.normal(size=(sizes.sum(), 2))
    got, pairs = line_crf.forward_backward(emit, sizes, trans, pairs=True)
    at, want = 0, np.zeros((2, 2))
    for n in sizes:
        w = {p: np.exp(sum(emit[at + i, p[i]] for i in range(n)) + sum(trans[p[i], p[i + 1]] for i in range(n - 1))) for p in itertools.product((0, 1), repeat=int(n))}
        z = sum(w.values())
        assert got[at : at + n] == pytest.approx([sum(x for p, x in w.items() if p[i]) / z for i in range(n)])
        for p, x in w.items():
            for i in range(n - 1):
                want[p[i], p[i + 1]] += x / z
        at += n
    assert pairs == pytest.approx(want)


def test_quality_is_learnt_and_held_out(spark):
    r = random.Random(5)
    good = [prose(k, 40) + "\n" + prose(k + 1000, 30) for k in range(90)]
    bad = ["\n".join(" ".join(f"w{r.randrange(99)}{r.choice('#$%')}" for _ in range(30)) for _ in range(3)) for _ in range(90)]
    docs = docs_of(spark, good + bad + [None, "", "\n\n", good[0]])
    labels = spark.createDataFrame([(i, int(i < 90), 0) for i in range(180)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in line_crf.line_quality(docs, labels).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 90) for i in held]) > 0.95
    assert all(0 <= v <= 1 for v in got.values()) and got[180] == got[181] == got[182] and got[183] == got[0]
    none = line_crf.line_quality(docs, labels.where("false")).collect()
    assert {x.score for x in none} == {0.5}


# --- language model
def ranks():
    import public_tokenizers as P

    return open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN


def lm_tables(size=200):
    r = np.random.default_rng(0)
    heads = np.append(np.arange(size) % 3 == 0, [False, True])
    kinds = np.append(r.integers(2, lm.CLASSES, size), [lm.BEGIN, lm.END])
    return lm.Tables(r.normal(size=(size + 2, lm.EMBEDDED)), kinds, np.where(heads, 0, r.integers(1, lm.TAILS, size + 2)), heads, r.normal(size=(size, lm.TAILS)))


def test_attention_gradients():
    r, t = np.random.default_rng(0), lm_tables()
    w = {k: r.normal(size=s) * 0.4 for k, s in lm.PARTS}
    sizes = np.array([70, 1, 20])
    stream = r.integers(0, 200, sizes.sum())
    stream[np.cumsum(sizes) - sizes] = 3
    stream[np.cumsum(sizes) - 1] = 201
    x, last, at = lm.windows(stream, sizes, t)
    live = (at >= 0) & (r.random(at.shape) < 0.8)
    g, _ = lm.gradients(w, t, x, last, live)
    assert set(g) == set(w)
    for k in w:
        for _ in range(3):
            i = tuple(r.integers(0, n) for n in w[k].shape)
            w[k][i] += 1e-5
            a = lm.gradients(w, t, x, last, live)[1]
            w[k][i] -= 2e-5
            assert g[k][i] == pytest.approx((a - lm.gradients(w, t, x, last, live)[1]) / 2e-5, abs=1e-6)
            w[k][i] += 1e-5


def test_attention_steps_run_over_whole_arrays():
    """Exponentials stay undivided, attention too, and a step of all weights is one of one array."""
    r = np.random.default_rng(3)
    h, out, known = r.normal(size=(50, lm.WIDTH)), r.normal(size=(lm.WIDTH, lm.CLASSES)), r.normal(size=(50, lm.CLASSES)) * 40
    p, sums = lm.weights_of_classes(h, out, known)
    plain = np.exp(np.minimum(h @ out + known, 60))
    assert p == pytest.approx(plain) and sums == pytest.approx(plain.sum(axis=1)) and lm.chances(h, out, known) == pytest.approx(plain / plain.sum(axis=1)[:, None])
    w = {k: (r.normal(size=s) * 0.4).astype(np.float32) for k, s in lm.PARTS}
    q, k, v = (r.normal(size=(5, n, lm.WIDTH)).astype(np.float32) for n in (lm.NEW, lm.WINDOW - 1, lm.WINDOW - 1))
    gathered, _, _, a, total = lm.attend(w, q, k, v)
    plain = np.exp((q + w["pq"]) @ (k + w["pk"]).transpose(0, 2, 1) / lm.WIDTH**0.5 + lm.MASK)
    assert a == pytest.approx(plain, rel=1e-4) and total[..., 0] == pytest.approx(plain.sum(axis=2), rel=1e-4)
    assert gathered == pytest.approx(plain / plain.sum(axis=2, keepdims=True) @ v, rel=1e-3, abs=1e-5)
    first, step = {k: x.copy() for k, x in w.items()}, lm.Adam(w, 0.1)
    m, n = ({k: np.zeros(x.shape) for k, x in w.items()} for _ in range(2))
    for t in range(1, 4):
        g = {k: r.normal(size=x.shape).astype(np.float32) for k, x in w.items()}
        step.step(dict(reversed(g.items())))
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            n[k] = 0.99 * n[k] + 0.01 * x * x
            first[k] = first[k] + 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(n[k] / (1 - 0.99**t)) + 1e-8)
    assert all(step.w[k] is w[k] and np.shares_memory(w[k], step.all) and w[k] == pytest.approx(first[k], abs=1e-4) for k in w)


def test_windows_show_each_id_once():
    sizes, t = np.array([1, 24, 25, 100]), lm_tables()
    stream = np.arange(sizes.sum()) % 60 + 2
    stream[np.cumsum(sizes) - sizes] = 0
    x, last, at = lm.windows(stream, sizes, t)
    assert sorted(at[at >= 0].tolist()) == list(range(sizes.sum())) and x.shape[1] == lm.WINDOW == last.shape[1]
    for row, kind, places in zip(x, last, at, strict=True):
        for p in range(lm.NEW):
            if places[p] >= 0:
                before = [k for k in range(places[p] + 1) if t.heads[stream[k]]][-1]
                assert kind[lm.CONTEXT + p] == t.kinds[stream[before]] and row[lm.CONTEXT + p] == stream[places[p]]


def lm_texts():
    return [prose(k % 70, 30, 300) for k in range(120)] + [None, "", "W1 w1\tÉ zzzq", prose(3, 400), prose(7, 50, 300), " ".join(f"qx{k}zv" for k in range(50))]


def training_of(spark, texts):
    rows = docs_of(spark, texts).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.where(crc_mod(F.col("doc_id"), 7) != 2)


def test_lm_counts_and_base(spark):
    texts = lm_texts()
    got = {r.doc_id: r for r in lm.lm_scores(docs_of(spark, texts), *ranks()).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = [(t or "").encode().lower().split() for t in texts]
    c = {}
    for i, found in enumerate(split):
        for x in [*found, None] if not held(i) else []:
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, found in enumerate(split):
        base = sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in [*found, None])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(found) + 1, sum(x in c for x in [*found, None]), n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    assert got[120].score == got[121].score
    assert got[124].score > got[125].score  # as many words, seen and unseen


def plain_score(model, counts, text):
    """A text's score word by word, with attention over all ids as loops."""
    w, size, found = model.weights, model.subwords.size, (text or "").encode().lower().split()
    ids = [*(model.subwords.ids(x) for x in found), [size + 1]]
    flat = [i for x in ids for i in x]
    head_of = [x[0] for x in ids for _ in x]
    after = np.zeros((size, lm.TAILS))
    after.ravel()[model.followed[0]] = model.followed[1]
    every = (after.sum(axis=0) + 0.1) / (after.sum(axis=0) + 0.1).sum()

    def both(t):
        """Chances at place t: of head classes, and of what follows the id before inside its word."""
        first = t // lm.NEW * lm.NEW - lm.CONTEXT
        before = [flat[p] if p >= 0 else size for p in range(first, t)]
        e = model.embedded[before]
        q = (e[-1] @ w["q"] + w["pq"][t - first - lm.CONTEXT]) / lm.WIDTH**0.5
        a = np.exp([q @ (y @ w["k"] + w["pk"][p]) for p, y in enumerate(e)])
        h = (a / a.sum()) @ (e @ w["v"])
        heads = np.exp(h @ w["out"] + w["bias"][model.kinds[head_of[t - 1] if t else size]])
        inner = None
        if t:
            x = flat[t - 1]
            inner = np.exp(h @ w["tail"]) * (after[x] + lm.BACK * every) / (after[x].sum() + lm.BACK)
            inner /= inner.sum()
        return heads / heads.sum(), inner

    total, t = 0.0, 0
    for n, own in enumerate(ids):
        k = model.kinds[own[0]]
        total += np.log10(both(t)[0][k])
        if n == len(found):
            break
        spelling = np.log10(model.head_share[own[0]])
        for place, y in enumerate([*own[1:], None], t + 1):
            g = 0 if y is None else model.tail_kinds[y]
            spelling += np.log10(both(place)[1][g] * (1 if y is None else model.tail_share[y]))
        c, have = counts.get(found[n], 0), model.tokens[k]
        total += np.log10((max(c - model.discount, 0) + model.discount * model.distinct[k] * 10**spelling) / have if have else 10**spelling)
        t += len(own)
    return total


def test_lm_scores_equal_plain_loops(spark, monkeypatch):
    texts = lm_texts()
    model, words, *_ = lm.fit(training_of(spark, texts), *ranks())
    counts = {bytes(r.word): r.c for r in words.select("word", "c").collect()}
    want = {i: plain_score(model, counts, texts[i]) for i in (0, 5, 120, 122, 123, 125)}
    for hot in (lm.HOT, 20):  # words that tasks know, and words that are joined
        monkeypatch.setattr(lm, "HOT", hot)
        monkeypatch.setattr(lm.frequent, "__defaults__", (hot,))
        got = {r.doc_id: r.score for r in lm.lm_scores(docs_of(spark, texts), *ranks()).collect()}
        assert {i: got[i] for i in want} == pytest.approx(want, abs=2e-3)


def test_lm_chances_sum_to_one(spark):
    model, words, *_ = lm.fit(training_of(spark, lm_texts()), *ranks())
    size, t, w = model.subwords.size, model.known, model.weights
    h = np.random.default_rng(1).normal(size=(40, lm.WIDTH)).astype(np.float32)
    p = lm.chances(h, w["out"], w["bias"][np.arange(40) % lm.CLASSES])
    kinds = model.kinds[:size]
    assert p.sum(axis=1) == pytest.approx(1, abs=1e-5) and p[:, [k for k in range(lm.CLASSES) if k != lm.END and k not in kinds]].max() < 1e-9
    assert lm.chances(h, w["tail"], t.after[:40]).sum(axis=1) == pytest.approx(1, abs=1e-5)
    spaced = model.subwords.spaced
    for of, share in ((kinds, model.head_share), (model.tail_kinds, model.tail_share)):
        sums = np.bincount(of, weights=share)
        assert sums[np.unique(of)] == pytest.approx(1)
    assert np.exp(t.after).sum(axis=1) == pytest.approx(1, abs=1e-3)
    assert (t.tail_kinds[:size][spaced] == 0).all() and (model.tail_kinds > 0).all()
    for k in np.flatnonzero(model.tokens):  # counted words and what is left for spelling
        own = [r.c for r in words.collect() if kinds[r.ids[0]] == k]
        assert sum(c - model.discount for c in own) / model.tokens[k] + model.discount * model.distinct[k] / model.tokens[k] == pytest.approx(1)


def test_every_id_enters_attention(spark):
    model, *_ = lm.fit(training_of(spark, lm_texts()), *ranks())
    ids = [model.subwords.ids(x) for x in (b"w117", b"w23", b"w9")]
    ids[0] = [*ids[0][:1], ids[0][1], *ids[0][2:]]
    assert len(ids[0]) > 1
    other = [[ids[0][0], ids[0][1] + 1 if not model.subwords.spaced[ids[0][1] + 1] else ids[0][1] - 1, *ids[0][2:]], *ids[1:]]

    def heads(own):
        flat = np.array([*(i for x in own for i in x), model.subwords.size + 1])
        starts = np.cumsum([0, *map(len, own)])
        return model.scores(flat, np.array([len(flat)]), starts)[0]

    a, b = heads(ids), heads(other)
    assert a[0] == b[0] and a[1] != b[1] and a[2] != b[2]  # the words after see another inner id


def test_words_without_spaces_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "KEPT_BYTES", 1 << 16), monkeypatch.setattr(lm, "SENT_BYTES", 1 << 14)
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("abcdefgh", k=1000)) for _ in range(20)) for _ in range(12)]
    sizes = []

    class Watched(lm.Lexicon):
        def numbers(self, words):
            found = super().numbers(words)
            sizes.append(self.bytes)
            return found

    watched = Watched(lm.Subwords(*ranks()), {})
    for t in texts:
        words = t.encode().split()
        numbers = watched.numbers(words)
        flat, n = watched.ids_of(numbers)
        assert flat.tolist() == [i for w in words for i in watched.subwords.ids(w)] and n.sum() == len(flat)
    assert max(sizes) < (1 << 16) + 20 * 4000
    got = lm.lm_scores(docs_of(spark, texts), *ranks()).collect()
    assert len(got) == 12 and all(x.n_tokens == 21 for x in got)


def test_lm_does_not_depend_on_partitions(spark):
    df, scores = docs_of(spark, lm_texts()), []
    for parts in (1, 4):
        scores.append({r.doc_id: r.score for r in lm.lm_scores(df.repartition(parts), *ranks()).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-5)


def test_lm_learns_from_every_shard(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcdefgh", k=3)) for _ in range(60)) for _ in range(120)]
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    training = training_of(spark, texts)
    subwords = lm.Subwords(*ranks())
    kinds, e = np.arange(subwords.size + 2).astype(np.uint8) % lm.CLASSES, np.random.default_rng(0).normal(size=(subwords.size + 2, lm.EMBEDDED)).astype(np.float32)
    known = lm.Tables(e, kinds, np.where(np.append(subwords.spaced, [False, True]), 0, 1), np.append(subwords.spaced, [False, True]), np.full((subwords.size, lm.TAILS), -np.log(lm.TAILS), np.float32))
    start = lm.new_weights(np.ones((lm.CLASSES, lm.CLASSES)))
    tokens = training.count() * 61
    heads = lm.count_corpus(training.select("raw", F.xxhash64("doc_id", "raw").alias("h")), subwords)[2]
    assert heads.count() == training.count()
    whole = lm.train_shards(heads, tokens, known, start)
    shards = tokens // 2000
    key = F.pmod("h", F.lit(shards))
    for s in range(shards):  # without any one shard the weights are others
        assert not np.allclose(lm.train_shards(heads.where(key != s), tokens, known, start)["bias"], whole["bias"], atol=1e-6) or not heads.where(key == s).count()


def test_attention_lowers_held_out_loss(spark):
    r, texts = random.Random(3), []
    for k in range(160):  # two languages: what stood before tells which words come
        texts.append(" ".join(f"{'ab'[k % 2]}{r.randrange(60)}x" for _ in range(60)))
    df = docs_of(spark, texts)
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = {x.doc_id: x for x in lm.lm_scores(df, *ranks()).collect()}
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held) * 0.97


def test_ids_of_many_words():
    subwords = lm.Subwords(*ranks())
    words = [w.encode() for w in ("the", "a", "\u00a0", "x\u00a0", "\u3000y", "don't", "é'é", "12ab", "!!?", "\x1c", "\u2028z")] * 300
    flat, n = subwords.ids_of(words)
    assert flat.tolist() == [i for w in words for i in subwords.ids(w)] and n.tolist() == [len(subwords.ids(w)) for w in words]


def test_lm_stores_ids_in_two_bytes(spark):
    subwords, texts = lm.Subwords(*ranks()), lm_texts()
    stored = lm.count_corpus(training_of(spark, texts).select("raw", F.xxhash64("doc_id", "raw").alias("h")), subwords)[2]
    raw = pa.array([r.ids for r in stored.collect()], pa.binary())
    flat, n = lm.as_ids(raw, subwords.size)
    assert sum(map(len, raw.to_pylist())) == 2 * len(flat) and (flat[np.cumsum(n) - 1] == subwords.size + 1).all()
    want = sorted([*(i for w in (t or "").encode().lower().split() for i in subwords.ids(w)), subwords.size + 1] for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2)
    assert sorted(x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])) == want
    large = np.array([1, 70_000], "<i4").tobytes()  # a tokenizer whose ids need more
    assert lm.as_ids(pa.array([large]), 69_999)[0].tolist() == [1, 70_000]


def test_events_of_many_windows_take_little_memory():
    t, r = lm_tables(), np.random.default_rng(2)
    x = r.integers(0, 200, (2000, lm.WINDOW))
    found = t.events(x, t.kinds[x], np.ones((2000, lm.NEW), bool))
    assert sum(y.nbytes for y in found) < 2000 * lm.NEW * 50  # no row of logits a place


def test_lexicon_begins_with_frequent_words():
    class Hot(dict):
        def get(self, *_):
            raise AssertionError("a word was looked up among the frequent ones")

    subwords = lm.Subwords(*ranks())
    words = [b"zzqy", b"the", "d\u00e9j\u00e0".encode()]
    lexicon = lm.Lexicon(subwords, Hot({b"the": 7, words[2]: 3}))
    for _ in range(2):
        numbers = lexicon.numbers(words)
        assert np.array(lexicon.count)[numbers].tolist() == [-1, 7, 3] and lexicon.ids_of(numbers)[0].tolist() == [i for w in words for i in subwords.ids(w)]
        lexicon.trim()
        assert sorted(lexicon) == sorted(words[1:]) and lexicon.bytes == 0


def test_lm_odd_tables(spark):
    assert lm.lm_scores(docs_of(spark, ["a"]).where("false"), *ranks()).count() == 0
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (4, "x" * 200_000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("raw", F.lit(1)).selectExpr("doc_id", "text", "score", "raw")
    got = lm.lm_scores(df, *ranks()).collect()
    assert len(got) == 5 and len({x.score for x in got if x.doc_id == 1}) == 1 and all(x.score < 0 for x in got)
    bad = spark.sql("SELECT 9L AS doc_id, string(unhex('61FF20')) AS text UNION ALL SELECT 10L, 'b c'")
    assert lm.lm_scores(bad, *ranks()).count() == 2


def test_lm_long_unseen_words_count(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    r, texts = random.Random(4), [prose(k, 30, 300) for k in range(200)]
    texts[held[0]], texts[held[1]] = prose(3, 30, 300), prose(3, 30, 300) + " " + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5000))
    got = {r.doc_id: r for r in lm.lm_scores(docs_of(spark, texts), *ranks()).collect()}
    assert got[held[1]].n_tokens == got[held[0]].n_tokens + 1 and got[held[1]].score < got[held[0]].score - 1000


# --- sharding
def test_shards_hold_every_record_once(spark):
    texts = [prose(k % 50, 1 + k % 30) for k in range(403)] + [None, ""]
    df = docs_of(spark, texts).unionByName(spark.createDataFrame([(None, "x"), (0, texts[0])], DOCS)).withColumn("shard", F.lit("clash"))
    out = sharding.external_shuffle(df, shards=8, bucket_bytes=4096).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str((r.doc_id, r.text)) for r in df.collect())
    counts = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.external_shuffle(df, shards=8, bucket_bytes=4096).collect() if r.doc_id}
    assert all(again[r.doc_id, r.text] == (r.shard, r.slot) for r in out if r.doc_id)
    assert abs(np.corrcoef([r.doc_id for r in out if r.doc_id], [r.shard * 1000 + r.slot for r in out if r.doc_id])[0, 1]) < 0.2
    assert {r.size for r in out if r.text is None} == {1} and sharding.external_shuffle(df.where("false")).count() == 0


def test_rows_repeated_on_a_third_are_scattered(spark, tmp_path):
    rows = [(7, "same text")] * 6000 + [(k, prose(k, 3)) for k in range(12000)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    out = sharding.external_shuffle(df, shards=8, bucket_bytes=4096)
    got = out.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(2250)) and 500 < sum(r.text == "same text" for r in own) < 1000


def test_written_shards_read_in_slot_order(spark, tmp_path):
    import pathlib

    import pyarrow.parquet as pq

    texts = [prose(k, 5) for k in range(2000)]
    sharding.write_shards(docs_of(spark, texts), str(tmp_path / "out"), shards=4, bucket_bytes=4096)
    for s in range(4):
        files = sorted(pathlib.Path(tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        assert [n for f in files for n in pq.read_table(f)["slot"].to_pylist()] == list(range(500)) and len(files) < 4


def test_op5_rows(spark, tmp_path):
    texts = [prose(k % 9, 5) for k in range(50)] + [None, ""]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in sharding.op5_external_shuffle(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


# --- line dedup
def test_copies_on_a_hot_host(spark):
    rows = [(k, "hot", "menu\nsame" if k % 3 else f"menu\nown {k}") for k in range(3000)] + [(9000, "b", None)]
    df = spark.createDataFrame(rows, "page_id int, host string, text string")
    got = {r.page_id: r.text for r in line_dedup.line_dedup(df, "host", ratio=0.8).collect()}
    assert all(got[k] == t.removeprefix("menu\n") for k, _, t in rows if t) and got[9000] is None


def test_large_hosts_have_more_parts(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"h{k % 30}", f"menu\n{'menu two' if k % 4 else 'own'} \nline {k}") for k in range(600)] + [(600, None, "menu"), (601, "hot", None)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    plain = sorted(map(str, line_dedup.line_dedup(df, "host").collect()))
    monkeypatch.setattr(line_dedup, "PART", 5)
    assert {r._host: r._parts for r in line_dedup.host_pages(df, "host").collect()}["hot"] == 81
    assert sorted(map(str, line_dedup.line_dedup(df, "host").collect())) == plain
    monkeypatch.setattr(line_dedup, "SMALL", 0)
    assert sorted(map(str, line_dedup.line_dedup(df, "host").collect())) == plain


def test_lines_over_the_ratio_go(spark):
    pages = [(k, "a" if k < 10 else "b", f"menu\n body {k}\n\nfoot" if k % 2 else f"menu\nbody {k}") for k in range(20)]
    pages += [(50, None, "menu\nmenu"), (51, "tiny", "menu"), (52, "a", None), (53, "a", ""), (54, "a", "menu"), (54, "a", "menu")]
    df = spark.createDataFrame(pages, "page_id int, host string, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.page_id: r for r in line_dedup.line_dedup(df, "host", ratio=0.4, min_pages=5).collect()}
    seen = {h: [set(x.strip(" \t\r") for x in (t or "").split("\n")) - {""} for _, g, t in pages if g == h] for h in ("a", "b")}
    for page, host, text in pages:
        rows = (text or "").split("\n")
        stays = [x for x in rows if host not in seen or not x.strip(" \t\r") or sum(x.strip(" \t\r") in s for s in seen[host]) <= 0.4 * len(seen[host])]
        assert got[page].text == (None if text is None else "\n".join(stays))
    assert line_dedup.line_dedup(df.where("false"), "host").count() == 0


# --- byte-level BPE
def test_bpe_equals_the_public_encoder(spark):
    import public_tokenizers as P
    import tiktoken

    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, bits = random.Random(1), ["a", "th", "é", "ß", "  ", " ", "\n", "\t", "'s", "12", "中文", "!!", "\r\n", "😀", " x", "http://", "==", "　", "\x1c"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["a" * 5000, "the" * 900 + "x", " " * 700, "", None, "<|endoftext|>"]
    df = docs_of(spark, texts).withColumn("decoded", F.lit(1))
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(df.drop("decoded"), data, P.PATTERN), data).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == public.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    once = {x.doc_id: x for x in bpe.encode(df, data, P.PATTERN, decoded="decoded").collect()}
    assert all(once[i].ids == x.ids and once[i].decoded == x.decoded for i, x in got.items())


def test_op7_rows(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks()[0].splitlines())}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    spark.sql("SELECT 0L AS doc_id, string(unhex('61FF62')) AS text UNION ALL SELECT 1L, 'The end of it' UNION ALL SELECT 2L, NULL").write.parquet(f"{tmp_path}/documents.parquet")
    texts = ["a\ufffdb", "The end of it", ""]
    for r in bpe.op7_byte_bpe(spark, str(tmp_path)).collect():
        ids = public.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(docs_of(spark, ["a"]).where("false"), *ranks()).count() == 0


# --- packing
def test_bounds_pad_least():
    r = random.Random(2)
    for _ in range(200):
        h = [(n, r.randint(1, 9)) for n in r.sample(range(40), r.randint(1, 8))]
        k, lengths = r.randint(1, 4), sorted(n for n, _ in h)
        cost = lambda bs, h=h: sum(c * (min(b for b in bs if b >= n) - n) for n, c in h)
        best = min(cost([*c, lengths[-1]]) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
        got = packing.best_bounds(h, k)
        assert len(got) <= k and cost(got) == best


def test_batches_keep_to_the_budget(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([0, None, 5, 5, 5, 7, 300, 20, 21, 22] * 30)], "id long, n int").withColumn("slot", F.lit("clash"))
    out = packing.pack(df, "n", "id", buckets=4, token_budget=64).collect()
    assert len(out) == 300
    for key, group in itertools.groupby(sorted(out, key=lambda r: (r.bucket, r.batch)), key=lambda r: (r.bucket, r.batch)):
        rows = list(group)
        assert [r.slot for r in sorted(rows, key=lambda r: r.slot)] == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].bucket_length <= 64 or rows[0].bucket_length == 0
        assert all((r.n or 0) + r.padding == r.bucket_length and r.padding >= 0 for r in rows), key
    assert packing.pack(df.where("false"), "n", "id").count() == 0


def test_a_third_of_equal_rows_is_spread(spark, monkeypatch):
    rows = [(None if k % 3 == 0 else k, 7 if k % 3 == 0 else k % 40) for k in range(60_000)]
    seen = []
    whole = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df: seen.append(whole(df)) or seen[-1])
    out = packing.pack(spark.createDataFrame(rows, "id long, n long").repartition(5), "n", "id", buckets=4, token_budget=400).collect()
    counts = sorted(r._k for r in seen[-1].collect())
    assert len(seen) == 3 and counts[-1] <= 6 * 60_000 / 64 and max(r._k for r in seen[0].collect()) >= 20_000
    assert len(out) == 60_000 and len({(r.bucket, r.batch, r.slot) for r in out}) == 60_000
    for b in {r.bucket for r in out}:
        own = sorted((r.batch, r.slot) for r in out if r.bucket == b)
        held = max(1, 400 // max(1, next(r.bucket_length for r in out if r.bucket == b)))
        assert own == [(k // held, k % held) for k in range(len(own))]


def test_one_long_text_leaves_the_other_bounds(spark):
    lengths = [random.Random(k).randrange(1, 300) for k in range(400)] + [100_000, 100_001, 10_000_000]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")
    counts = {n: lengths.count(n) for n in lengths}
    assert dict(packing.length_histogram(df, "n")) == counts
    bounds = packing.best_bounds(list(counts.items()), 6)
    for r in packing.pack(df, "n", "id", buckets=6).collect():
        assert r.bucket_length == min(b for b in bounds if b >= r.n) and r.padding == r.bucket_length - r.n


# --- WARC
def test_ranges_hold_equal_bytes(spark):
    far = [(k, "u", f"page {k} " + "x" * 400) for k in range(300)] + [(1 << 60, "u", "far")]
    null = [(None, "u", f"page {k} " + "x" * 400) for k in range(300)]
    same = [(5, f"u{k}", "same page") for k in range(600)] + [(6, "u", "same page")]
    for rows in (far, null, same):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        path = shared_dir(spark)
        manifest = warc.write_warc(df, path, range_bytes=20_000)
        parts = {r.part: r.n for r in manifest.groupBy("part").agg(F.sum("records").alias("n")).collect()}
        assert sum(parts.values()) == len(rows) and len(parts) >= 10 and max(parts.values()) < 0.25 * len(rows)
        got = warc.read_warc(manifest, path).collect()
        assert sorted(str((r.page_id, r.url)) for r in got) == sorted(str((k, u)) for k, u, _ in rows)
        assert all(r.refers_to == (6 if rows is same and r.page_id == 5 else None) for r in got)


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "", None, "<p>one</p>", "zwei é", "", "x" * 5000, "<p>one</p>"]
    rows = [(k, None if k == 4 else f"http://h/{k} %\n", t) for k, t in enumerate(html)] + [(None, "u", "<p>one</p>"), (60, "u", "again")]
    rows += [(100 + k, "u", hashlib.md5(str(k).encode()).hexdigest() * 40) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("part", F.lit("clash"))
    path = shared_dir(spark)
    manifest = warc.write_warc(df, path, range_bytes=20_000, roll_bytes=3_000)
    got = warc.read_warc(manifest, path).collect()
    assert len(got) == len(rows) and manifest.count() > 4 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    last = {}
    for k, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if k is None else k)
    by = {r.page_id: r for r in got}
    for k, url, t in rows:
        r, body = by[k], (t or "").encode()
        response = k is None or last[t or ""] == k
        assert (r.url, r.record_type, r.refers_to) == (url, "response" if response else "revisit", None if response else last[t or ""])
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.payload is None or bytes(r.payload) == body
    again = shared_dir(spark)
    key = ["file", "sha256", "records"]
    assert sorted(map(tuple, warc.write_warc(df, again, range_bytes=20_000, roll_bytes=3_000).select(key).collect())) == sorted(map(tuple, manifest.select(key).collect()))
    assert warc.write_warc(df.where("false"), shared_dir(spark)).count() == 0


# --- quality rules
def test_ledger_and_policies(spark):
    texts = [prose(1, 80), "a b c a b c x", "#" * 80, None, "", "A\nA\nb c\n\n", ("Same line here\n" * 30), " ".join(["LOUD!!"] * 60), "one | two | " * 40, "éa bß"]
    rows = {r.doc_id: r for r in quality_rules.ledger(docs_of(spark, texts).withColumn("n_words", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert (rows[i].n_symbols, rows[i].n_dup_lines) == (sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
    kept = {r.doc_id for r in quality_rules.quality_rules(docs_of(spark, texts)).collect()}
    assert kept == {0} == {i for i, r in rows.items() if r.failed_bits & quality_rules.mask("v2") == 0}
    table = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs_of(spark, texts)), "v2").collect()}
    for rule in quality_rules.RULES:
        assert table[rule.name].failed == sum(r.failed_bits >> rule.bit & 1 for r in rows.values())
        assert table[rule.name].only_this == sum(r.failed_bits & quality_rules.mask("v2") == 1 << rule.bit for r in rows.values())


def test_crc_of_ids(spark):
    got = spark.createDataFrame([(5,), (None,), (-3,)], "i long").select("i", crc_mod(F.col("i"), 7).alias("m")).collect()
    assert [r.m for r in got] == [crc_mod(r.i, 7) for r in got]
