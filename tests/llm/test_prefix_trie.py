"""The radix tree against sets of prefixes; the trie of conversations against nested loops."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemill.llm import prefix_trie
from sievemill.llm.prefix_trie import conversation_trie
from sievemill.llm.radix_tree import LAYOUTS, Node, RadixTree, Value, prefix_ids, told


def test_layouts_grow():
    rng = random.Random(1)
    labels = rng.sample(range(256), 256)
    node, seen = Node(b""), []
    for k, label in enumerate(labels):
        child = Node(bytes([label]))
        node.put(label, child)
        seen.append(label)
        assert node.layout == next(x for x in LAYOUTS if k < x)
        assert [x for x, _ in node.children()] == sorted(seen) and node.child(label) is child
        assert node.child(labels[-1]) is None or k == 255
    other = Node(b"x")
    node.put(labels[0], other)
    assert node.child(labels[0]) is other


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([1, 2, 16]), st.integers(0, 10**6))
def test_tree_against_prefixes(width, seed):
    rng = random.Random(seed)
    units = [bytes(rng.randrange(256 if seed % 2 else 3) for _ in range(width)) for _ in range(rng.choice([3, 8, 300]))]
    keys = {b"".join(rng.choice(units) for _ in range(rng.randrange(5))) for _ in range(rng.choice([1, 5, 60]))}
    tree, values = RadixTree(), {}
    for key in rng.sample(sorted(keys), len(keys)):
        values[key] = Value(rng.randrange(1, 4), rng.randrange(1000), [sum(key[: width * (d + 1)]) % 97 for d in range(len(key) // width)])
        tree.insert(key, values[key])
    edge = frozenset(prefix_ids(min(keys), width)) | frozenset(prefix_ids(max(keys), width))
    got = {r.id: r for r in told(tree, width, edge)}
    prefixes = {key[: width * d] for key in keys for d in range(len(key) // width + 1)}
    assert len(got) == len(prefixes)
    members = {p: [v for k, v in values.items() if k.startswith(p)] for p in prefixes}
    kids = {p: [q for q in prefixes if len(q) == len(p) + width and q.startswith(p)] for p in prefixes}

    def leaves(p):
        return sum(map(leaves, kids[p])) if kids[p] else 1

    def saved(p):
        return (sum(v.members for v in members[p]) - 1) * (sum(p) % 97 if p else 0) + sum(map(saved, kids[p]))

    for p in prefixes:
        r, inner = got[prefix_ids(p, width)[-1]], [q for q in kids[p] if prefix_ids(q, width)[-1] not in edge]
        assert (r.depth, r.members, r.least) == (len(p) // width, sum(v.members for v in members[p]), min(v.least for v in members[p]))
        assert (r.children, r.leaves, r.saved) == (len(kids[p]), leaves(p), saved(p))
        assert r.parent == (prefix_ids(p, width)[-2] if p else None) and r.edge == (r.id in edge)
        assert (r.inner_children, r.inner_leaves, r.inner_saved) == (len(inner), sum(map(leaves, inner)), sum(map(saved, inner)))


def by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def leaves(p):
        return sum(map(leaves, kids[p])) if kids.get(p) else 1

    def saved(p):
        return (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(map(saved, kids.get(p, [])))

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves(p), saved(p), sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, n, turns, alphabet):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-250, 1500), n):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(alphabet)) for t in range(rng.randrange(1, turns))]
    return rows


ROWS = some(1, 300, 9, ["a", "bb", "été", "漢字"]) + [(100, 0, None, None), (7, None, "user", "first"), (7, 2, "user", "x"), (7, 2, "user", "x"), (None, 1, "user", "lost"), (9000, 1, "u", "y" * 200_000)]
ROWS += [(5000 + k, t, "user", f"same {t}") for k in range(400) for t in range(8)]


@pytest.mark.parametrize("pieces, tree", [(4_096, 2 << 20), (7, 400)])
def test_against_loops(spark, monkeypatch, pieces, tree):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", pieces)
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", tree)
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(5).withColumn("id", F.lit(1)).withColumn("key", F.lit(2)).withColumn("size", F.lit(3))
    assert sorted([tuple(r) for r in conversation_trie(table).collect()], key=str) == by_hand(ROWS)


def test_deep_conversations_that_share_nearly_all(spark, monkeypatch):
    """The edge between ranges lies hundreds of turns deep."""
    monkeypatch.setattr(prefix_trie, "TREE_BYTES", 8_000)
    rows = [(100 * c, t, "user", f"turn {t}" if t < 290 + c % 20 else f"own {c}") for c in range(12) for t in range(320)]
    got = sorted([tuple(r) for r in conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()], key=str)
    assert got == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(1, None, None, None)], [(-1, 0, "u", "a"), (-100, 0, "u", "a")]])
def test_small_tables(spark, rows):
    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted([tuple(r) for r in got.collect()], key=str) == by_hand(rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
