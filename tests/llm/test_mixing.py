"""Mixing against the water level worked out by hand."""

import hashlib
import re
from collections import defaultdict

from sievemill.llm.mixing import mix, mixed_documents

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        left = budget - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def hold(got, docs):
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sizes = defaultdict(int)
    for n, (_, _, s) in zip(size, docs):
        sizes[s] += n
    target = targets_by_hand(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    by_id = {i: (n, s) for n, (i, _, s) in zip(size, docs)}
    assert len(got) == len(docs)
    for r in got:
        n, s = by_id[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    return taken


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hold(mix(table).collect(), [(r.doc_id, r.text, r.source) for r in table.collect()])


def test_edges(spark):
    docs = [(i, "word " * (i % 37), f"s{i % 5}") for i in range(300)] + [(1000 + i, "a b c", None) for i in range(20)] + [(2000, None, "s1"), (2001, "", "empty"), (2002, "x " * 20_000, "S"), (2003, "z", "é"), (2004, "z y", "\U0001f600")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS h", "2 AS target", "3 AS prefix")
    got = mix(table).collect()
    hold(got, docs)
    again = mix(table.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    assert mix(table.limit(0)).collect() == []
    copies = mixed_documents(table)
    assert copies.columns == table.columns
    times = defaultdict(int)
    for r in copies.collect():
        times[r.doc_id] += 1
    assert {r.doc_id: r.taken // r["size"] for r in got if r.taken} == times


def test_repeated_and_null_ids(spark):
    docs = [(1, "a b c", "s")] * 4 + [(None, "d e", "s")] * 3 + [(i, "f " * 5, "s") for i in range(2, 30)]
    got = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(got) == len(docs)
    assert len({r.taken for r in got if r.doc_id == 1}) == 1 and len({r.taken for r in got if r.doc_id is None}) == 1


def test_nested_budgets(spark, sf_dir):
    """What a smaller budget takes, a larger one takes too."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small, large = ({r.doc_id: r.taken for r in mix(table, budget=b).collect()} for b in (0.4, 1.1))
    assert all(large[k] >= v for k, v in small.items()) and sum(small.values()) < sum(large.values())


def test_hash_is_that_of_any_engine(spark):
    from pyspark.sql import functions as F

    from sievemill.llm.mixing import document_hash

    got = spark.range(5).select(document_hash(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16) for i in range(5)]
