import os

import numpy as np
import pytest

import sparkrecall
from sparkrecall.operators import models, search
from sparkrecall.operators.graph import Graph
from sparkrecall.operators.vector_index import VectorIndex
from sparkrecall.sources import files

V = "id long, v array<float>"


def test_ragged_null_and_infinite_vectors_are_named(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], V)
    ragged = spark.createDataFrame([(5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0])], V)
    for bad in (ragged, spark.createDataFrame([(6, None)], V)):
        with pytest.raises(Exception, match="id 6"):
            search.top_k(bad.coalesce(1), one, 2).collect()
        with pytest.raises(Exception, match="id 6"):
            search.max_pool(bad.coalesce(1), one).collect()
    with pytest.raises(ValueError, match="query 9"):
        search.top_k(one, spark.createDataFrame([(9, [float("nan"), 0.0, 0.0])], V), 2)
    with pytest.raises(ValueError, match="id 6"):
        search.top_k(one, ragged.coalesce(1), 2)


def test_the_last_of_equal_ids_wins(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 0.0], 1)], V + ", n int")
    with pytest.raises(ValueError, match="1"):
        VectorIndex(2).upsert(rows)
    assert [list(r["codes"]) for r in VectorIndex(2).upsert(rows, "n").rows.orderBy("id").collect()] == [[0, 127], [127, 0]]


def test_search_of_allowed_ids(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], V)
    allowed = spark.createDataFrame([(3,), (4,), (5,), (999,), (3,)], "id long")
    found = VectorIndex(4).upsert(v).search(v.filter("id = 0"), 10, allowed).collect()
    assert sorted(r["id"] for r in found) == [3, 4, 5]


def test_a_path_ends_where_nothing_new_is_found(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "k", 1.0) for i in range(12)], "src string, dst string, kind string, weight double")
    pairs = spark.createDataFrame([("n0", "n12"), ("n12", "n0")], "src string, dst string")
    graph = Graph(edges)
    assert [len(r["path"]) for r in graph.shortest_path(pairs).collect()] == [13]
    assert graph.shortest_path(pairs, 5).count() == 0


def test_a_directory_too_deep_is_a_row(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_DEPTH", 2)
    os.makedirs(tmp_path / "a/b/c/d")
    errors = [(os.path.basename(r[0]), r[4]) for r in files.walk(str(tmp_path)) if r[4]]
    assert len(errors) == 1 and errors[0][0] == "c"
    assert not [r for r in files.walk(str(tmp_path), max_depth=1) if r[4]]


def test_public_names():
    assert all(hasattr(sparkrecall, name) for name in sparkrecall.__all__) and "VectorIndex" in sparkrecall.__all__
    assert models.ep_priority("linux_nvidia")[-1] == "CPU" and sparkrecall.hash_provider() == "jvm"
    with pytest.raises(ValueError):
        sparkrecall.ep_priority("toaster")
