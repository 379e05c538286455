"""The pipeline's stages on a table that holds copies, junk, boilerplate, nulls and odd texts."""

import random

import corpus_pipeline as c
from gridloom.llm.common import materialize

from .test_operators import prose


def tables(spark, path):
    r, rows, labels = random.Random(1), [], []
    for k in range(300):
        bad = k % 5 == 0
        text = " ".join(f"w{r.randrange(99)}{r.choice('#$%') if bad else ''}" for _ in range(80)) if bad else prose(k, 90, 3000)
        rows.append((k, ("Read more here\n" if k % 3 else "") + text, "en", f"s{k % 2}", len(text)))
        labels.append((k, int(not bad), 0))
    rows += [(400, rows[1][1], "en", "s1", 1), (401, None, None, None, None), (402, "", "en", "s1", 0), (403, prose(9, 20000, 9000), "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows, d = tables(spark, str(tmp_path)), str(tmp_path)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in c.STAGES:
        docs = materialize(stage(spark, docs, d))
        kept.append((name, {r.doc_id: r.text for r in docs.collect()}))
        if name != "packing":
            assert docs.columns == list(c.COLUMNS)
    good = {k for k in range(300) if k % 5}
    assert good <= set(kept[0][1]) and len(set(kept[0][1]) & {k for k in range(300) if k % 5 == 0}) < 6
    assert good <= set(kept[1][1]) and 401 not in kept[1][1] and 402 not in kept[1][1]
    assert all("Read more here" not in t for k, t in kept[2][1].items() if k < 300) and kept[2][1][403] == rows[-1][1]
    assert 1 in kept[3][1] and 400 not in kept[3][1] and good <= set(kept[3][1])
    assert set(kept[4][1]) == set(kept[3][1])
    assert {r.doc_id for r in c.run(spark, d).collect()} == set(kept[4][1])


def test_empty_table(spark, tmp_path):
    d = str(tmp_path)
    tables(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in c.STAGES:
        docs = materialize(stage(spark, docs, d))
        assert docs.count() == 0


def test_lines_of_a_small_share_go(spark):
    rows = [(k, f"{'Share this page' if k % 11 == 0 else 'own'}\n{prose(k, 20, 3000)}\n{'Chorus of four' if k < 4 else 'end'}{k if k > 3 else ''}", "en", "hot", 1) for k in range(400)]
    rows += [(1000 + k, f"Small site menu\n{prose(9000 + k, 20, 3000)}", "en", "small", 1) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text = {r.doc_id: r.text for r in c.lines(spark, docs, "").collect()}
    assert len(text) == 410 and not [k for k, t in text.items() if "Share this page" in t or "Small site menu" in t]
    assert all(prose(k, 20, 3000) in text[k] for k in range(400)) and all("Chorus of four" in text[k] for k in range(4))
