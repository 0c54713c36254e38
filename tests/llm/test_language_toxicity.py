"""Language fusion against the formula by hand; the classifier chain on held-out texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievemill.llm.language_id import LANGUAGES, SMOOTHING, fuse, identify, identify_documents, keep_identified, of_documents, of_pages, text_likelihoods, trigram_cells, trigram_model
from sievemill.llm.toxicity import best_threshold, fit_linear, probability, score, toxicity_categories, train_chain, word_cells


def test_cells():
    cells, owner = trigram_cells(pa.array(["ab", "", None, "1 2", "AB", "é"]))
    assert Counter(owner.tolist()) == {0: 2, 4: 2, 5: 2}
    assert cells[:2].tolist() == cells[2:4].tolist()


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = trigram_model(of_documents(docs.where("doc_id % 2 = 0")))
    got = text_likelihoods(of_documents(docs.where("doc_id % 2 = 1")), model).collect()
    right = sum(LANGUAGES[int(np.argmax(r.ll))] == r.declared for r in got)
    assert right >= 0.99 * len(got)


def test_fusion_by_hand(spark):
    rows = [(i, f"h{i % 3}", "site" if i % 3 else None, "de" if i % 4 else None, [("de", "en")[i % 2], None][i % 5 == 0], 0 if i == 6 else 30, [-10.0 - i % 7, -12.0 - i % 3, -14.0, -13.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "id long, host string, site string, suffix string, declared string, grams long, ll array<double>")
    got = {r.id: r for r in fuse(table).collect()}
    text = {r[0]: int(np.argmax(r[6])) if r[5] else None for r in rows}
    total = Counter(k for k in text.values() if k is not None)
    prior = [(total[k] + 1) / (sum(total.values()) + 4) for k in range(4)]
    counts = defaultdict(lambda: [0.0] * 4)
    for r in rows:
        if text[r[0]] is not None:
            for name, value in (("host", r[1]), ("site", r[2]), ("suffix", r[3]), ("declared", r[4])):
                if value is not None:
                    counts[name, value][text[r[0]]] += 1
    for r in rows:
        if not r[5]:
            assert (got[r[0]].lang, got[r[0]].posterior) == ("und", 0.0)
            continue
        own = [float(k == text[r[0]]) for k in range(4)]
        site = [max(0, a - b) for a, b in zip(counts.get(("site", r[2]), [0.0] * 4), own)]
        host = [max(0, a - b) for a, b in zip(counts.get(("host", r[1]), [0.0] * 4), own)]
        site = [(x + SMOOTHING * p) / (sum(site) + SMOOTHING) for x, p in zip(site, prior)]
        host = [(x + SMOOTHING * p) / (sum(host) + SMOOTHING) for x, p in zip(host, site)]
        s = [ll + math.log(h) for ll, h in zip(r[6], host)]
        for name, value in (("suffix", r[3]), ("declared", r[4])):
            if value is not None:
                tables = [v for (n, _), v in counts.items() if n == name]
                s = [x + math.log((counts[name, value][k] + 1) / (sum(t[k] + 1 for t in tables) + 1)) for k, x in enumerate(s)]
        best = max(range(4), key=lambda k: s[k])
        assert got[r[0]].lang == LANGUAGES[best]
        assert abs(got[r[0]].posterior - 1 / sum(math.exp(x - s[best]) for x in s)) < 1e-9


def test_edges_and_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "en", None, 0), (9003, "12 ... !!", None, "src0", 9), (None, "the of and that with the", None, None, 0), (9005, "der die und nicht " * 30_000, "xx", "", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(odd).withColumn("host", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.doc_id: r for r in identify_documents(both).collect()}
    assert len(got) == both.count()
    assert [got[i].kept for i in (9001, 9002, 9003)] == [False] * 3 and got[9001].lang == "und"
    assert got[None].kept and got[9005].lang == "de"
    left = keep_identified(both)
    assert left.columns == both.columns and left.count() == both.count() - 3
    assert identify_documents(docs.limit(0)).collect() == []


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = identify(of_pages(pages)).collect()
    assert len(got) == pages.count() and sum(r.lang == r.declared for r in got) >= 0.98 * len(got)


def test_linear_model_finds_the_word():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(600):
        bad = i % 5 == 0
        texts.append(" ".join(f"w{k}" for k in rng.integers(0, 500, rng.integers(5, 80))) + (" idiot," if bad else ""))
        y.append(float(bad))
    cells, at = word_cells(pa.array(texts))
    model = fit_linear(cells, at, np.zeros((600, 0)), np.array(y))
    p = probability(model.log_odds(cells, at, np.zeros((600, 0))))
    assert ((p > 0.5) == np.array(y, bool)).all()


def test_threshold():
    assert best_threshold(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0])) == 0.5
    assert best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_chain_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = train_chain(docs, labels.where("doc_id % 3 <> 0"), toxicity_categories(), sample=2500)
    assert [m.earlier.shape for m in chain.models] == [(0,), (1,)]
    held = score(docs, chain).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hits = sum(r.toxic and r.y == 1 for r in held)
    assert hits >= 0.9 * sum(r.y for r in held) and hits >= 0.9 * sum(r.toxic for r in held)


def test_score_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 1), (4, 1, None), (5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int").select(*[F.col(f.name).cast(f.dataType) for f in labels.schema]))
    chain = train_chain(docs, odd, toxicity_categories())
    table = spark.createDataFrame([(1, None), (2, ""), (None, "idiot scum"), (1, None), (3, "idiot " * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS toxic", "2 AS p_toxic")
    got = score(table, chain).collect()
    assert len(got) == 5 and not any(r.toxic for r in got if r.doc_id in (1, 2))
    assert score(table.limit(0), chain).collect() == []
    none = train_chain(docs, labels.limit(0), toxicity_categories())
    assert not any(r.toxic for r in score(docs, none).where("p_toxic > 0.5").collect())
