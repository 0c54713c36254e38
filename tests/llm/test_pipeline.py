"""The whole pipeline against the brute-force version of each stage, each on its own input."""

import os
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from sievemill.llm.mixing import mix  # noqa: E402
from sievemill.llm.shared import stored  # noqa: E402
from tests.llm.test_dedup import components_by_hand, low  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 160")
    odd = spark.createDataFrame([(9001, "... 123", "en", "src1", 7), (9002, None, None, None, 0)], docs.schema)
    docs = stored(docs.unionByName(odd), "in")
    names = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], sf_dir), name))
    assert all(d.columns == names for d in seen[:-1])
    rows = [d.collect() for d in seen]
    ids = [sorted(r.doc_id for r in x) for x in rows]
    assert ids[1] == sorted(r.doc_id for r in rows[0] if any(c.isalpha() for c in r.text or ""))
    last = {}
    for r in rows[1]:
        last[low(r.text)] = max(last.get(low(r.text), -1), r.doc_id)
    assert ids[2] == sorted(last.values())
    component, _ = components_by_hand({r.doc_id: r.text for r in rows[2]})
    assert ids[3] == sorted(k for k, v in component.items() if k == v)
    want = Counter({r.doc_id: r.taken // r["size"] for r in mix(seen[3]).collect() if r.taken})
    assert Counter(ids[4]) == want and max(want.values()) <= 2
    library, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in rows[0]}
    pieces = Counter()
    for r in rows[5]:
        part = (library.encode(text[r.doc_id], add_special_tokens=False).ids + [1])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id] += r.length
    assert pieces == Counter({k: n * (len(library.encode(text[k], add_special_tokens=False).ids) + 1) for k, n in want.items()})
