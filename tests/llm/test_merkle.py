"""The manifest against hashes by hand, and the intervals of its nodes."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sievemill.llm.merkle import document_leaves, manifest, ranked, verified_documents

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def ways(leaves):
    """Root and, for each leaf, its siblings by level as (left, right)."""
    found, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 16 * 16
            found[k].append((nodes[run:i], nodes[i + 1 : run + 16]))
            at[k] = i // 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], found


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        leaf = H(*map(field, (doc_id, source, lang, n, text)))
        other = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
            other = H(*map(field, (doc_id, source, lang, n, text.translate(LOW) if text is not None else None)))
        groups[source].append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: ways([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, top = ways([made[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for x, way in zip(sorted(groups[s], key=lambda x: x[:3]), made[s][1]):
            way, cur = way + top[k], x[3]
            for left, right in way:
                cur = H(*left, cur, *right)
            out.append((x[4], x[2], made[s][0], root, H(*[d for left, right in way for d in left + right]), cur, cur == root))
    return sorted(out, key=str)


ROWS = (
    [(k, "hot", "en", 5, f"Text {k}" if k % 7 else f"text {k}") for k in range(700)]
    + [(k, "ünï" if k % 2 else None, None, None, None if k % 3 else "") for k in range(40)]
    + [(None, "hot", "de", 1, "Null"), (None, "hot", "de", 1, "Null"), (None, None, None, None, None), (3, "hot", "en", 5, "Text 3")]
    + [(900 + k, f"one{k}", "fr", k, "Ä" * k) for k in range(20)]
    + [(-5, "Z", "es", -1, "A|b:1-"), (2000, "z", "es", 3, "a" * 300_000)]
)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:17], ROWS[-1:] + ROWS[:16], ROWS[740:743]])
def test_against_hand(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("group", F.lit("clash")).withColumn("leaf", F.lit(1)).withColumn("path", F.lit(2))
    got = sorted([tuple(r) for r in verified_documents(docs).collect()], key=str)
    assert got == by_hand(rows)


def test_empty(spark):
    got = verified_documents(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_ranks_are_exact_across_ranges(spark, monkeypatch):
    monkeypatch.setattr("sievemill.llm.merkle.RANGE_ROWS", 300)
    rows = spark.range(2_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE concat('b', id % 50) END AS g", "(id * 7919) % 2003 AS v", "id")
    got = ranked(rows, "g", ["v", "id"]).collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r.g].append(r)
    for members in by_group.values():
        want = sorted(members, key=lambda r: (r.v, r.id))
        assert [r["rank"] for r in want] == list(range(len(members))) and {r.size for r in members} == {len(members)}


def test_nodes_cover_their_intervals(spark):
    made = manifest(document_leaves(spark.createDataFrame(ROWS, SCHEMA)), ["doc_id"])
    nodes = made.nodes().collect()
    below = {(n.tree, bytes(n.group), n.level, n.lo): n for n in nodes}
    for n in nodes:
        assert n.lo % 16**n.level == 0 and 0 < n.hi - n.lo <= 16**n.level
        if n.level:
            children = [below[n.tree, bytes(n.group), n.level - 1, lo] for lo in range(n.lo, n.hi, 16 ** (n.level - 1))]
            assert children[-1].hi == n.hi and H(*[c.digest for c in children]) == n.digest
    assert sum(n.tree == 1 and n.digest == made.root.hex() and n.lo == 0 for n in nodes) == 1
