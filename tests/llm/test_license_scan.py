"""License templates against an exact scan of every place."""

import random
import re

import pyarrow as pa

from sievemill.llm.license_scan import TEMPLATES, Scanner, scan_licenses

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def by_hand(text):
    """Templates with three quarters of their shingles within any run of as many shingles."""
    have, found = shingles(words(text)), set()
    for name, t in TEMPLATES.items():
        want = set(shingles(words(t)))
        if any(len(want & set(have[i : i + len(want)])) >= 0.75 * len(want) for i in range(max(1, len(have) - len(want) + 1))):
            found.add(name)
    return found


def test_templates_changed_and_hidden():
    rng = random.Random(5)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "été"]
    texts = ["", "one", *TEMPLATES.values()]
    for _ in range(300):
        t = rng.choice(list(TEMPLATES.values())).split()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(filler)
        cut = t[rng.randrange(3) : len(t) - rng.randrange(3)]
        texts.append(" ".join(rng.choices(filler, k=rng.randrange(200)) + cut + rng.choices(filler, k=rng.randrange(200))))
    got = Scanner(TEMPLATES).scan(pa.array(texts))
    missed = 0
    for t, found in zip(texts, got):
        names = {n for n, _, _ in found}
        missed += bool(by_hand(t) - names)
        for name, place, share in found:
            want = set(shingles(words(TEMPLATES[name])))
            near = shingles(words(t))[max(0, place - 1) : place + 3 * len(want) + 3]
            assert share >= 0.75 and len(want & set(near)) >= 0.75 * len(want)
            assert shingles(words(t))[place] in want
    assert missed == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in scan_licenses(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == by_hand(r.text)
    assert any(got.values())


def test_edge_rows(spark):
    mit = TEMPLATES["MIT"]
    docs = spark.createDataFrame([(1, None), (2, ""), (None, mit), (3, mit), (3, mit), (4, "x " * 50_000 + mit.upper())], "doc_id long, text string").selectExpr("*", "1 AS licenses")
    got = sorted((str(r.doc_id), r.licenses, r.n_licenses) for r in scan_licenses(docs).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "MIT", 1), ("3", "MIT", 1), ("4", "MIT", 1), ("None", "MIT", 1)]
    assert scan_licenses(docs.limit(0)).collect() == []
