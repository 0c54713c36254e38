"""Stored tables: where they go, and that they can be taken away again."""

import os
from types import SimpleNamespace

import pytest

from sievemill import storage


def test_a_cluster_needs_a_shared_folder():
    nothing = SimpleNamespace(get=lambda key, other=None: other)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing))
    with pytest.raises(RuntimeError):
        storage.shared_dir(cluster)


def test_stored_alone_leaves_one_table(spark):
    before = set(os.listdir(storage.shared_dir(spark)))

    def make():
        return storage.stored(spark.range(5), "first").selectExpr("id + 1 AS id")

    kept = storage.stored_alone(spark, make, "second")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4, 5]
    new = set(os.listdir(storage.shared_dir(spark))) - before
    assert len(new) == 1 and new.pop().startswith("second-")
    storage.discard(spark, [p for p in storage._written if "/second-" in p])
    assert set(os.listdir(storage.shared_dir(spark))) == before
