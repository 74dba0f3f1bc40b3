from pathlib import Path

import numpy as np
import pytest

from sparkrecall.errors import ConfigError, DimensionError, InputTooLong, RecallError
from sparkrecall.functions import control
from sparkrecall.operators.dispatcher import Coalescer, DispatcherConfig, Embedder, bucket_of, coalesce
from sparkrecall.operators.vector_index import VectorIndex
from sparkrecall.settings import Setting, Settings, security_tier
from sparkrecall.streaming import doorbell


def test_coalescer(spark):
    c = Coalescer(DispatcherConfig(window_ms=10, max_batch_tokens=100))
    assert c.push(0.0, 1, 500, None) == []  # the first job never closes its own window
    assert [r[0] for r in c.push(0.005, 2, 10, None)] == [2, 1]  # the cap does; small buckets first
    assert c.push(1.0, 3, 10, 1.005) == [] and c.push(1.001, 4, 20, 2.0) == []
    got = c.push(5.0, 5, 1, None)
    assert [(r[0], r[1], r[5]) for r in got] == [(3, 1, True), (4, 1, False)] and got[0][2] == pytest.approx(1.01)
    jobs = [("a", i, i * 0.001, 60, None) for i in range(5)] + [("b", 9, 0.0, 10, None)]
    df = spark.createDataFrame(jobs, "queue string, seq int, at double, tokens int, deadline double")
    rows = {(r["queue"], r["seq"]): (r["flush"], r["batch"]) for r in coalesce(df, DispatcherConfig(max_batch_tokens=100, window_ms=50)).collect()}
    assert rows == {("a", 0): (0, 0), ("a", 1): (0, 1), ("a", 2): (1, 0), ("a", 3): (1, 1), ("a", 4): (2, 0), ("b", 9): (0, 0)}
    assert [bucket_of(n, (64, 256, 1024, 4096)) for n in (0, 64, 65, 257, 1025, 10**6)] == [0, 0, 1, 2, 3, 3]
    with pytest.raises(ConfigError):
        DispatcherConfig(streams=0)
    assert DispatcherConfig().queue_limit == 32


def test_embedder(spark):
    e = Embedder(context=50)
    assert e.embedding_dim == 64 and e.streams == 8 and e.runtime_backend == "HashingBackend"
    assert np.allclose(np.linalg.norm(e.embed(["a b", "c"]), axis=1), 1)
    with pytest.raises(InputTooLong) as err:
        e.embed(["ok", "x" * 100])
    assert (err.value.tokens, err.value.limit, err.value.index) == (102, 50, 1) and isinstance(err.value, ValueError)
    assert e.token_windows("x" * 100, 42)[0] == (0, 40)
    for bad in (2, 51):
        with pytest.raises(ConfigError):
            e.token_windows("x", bad)
    df = spark.createDataFrame([(1, "a"), (2, "x" * 100)], "id int, t string")
    assert {r["id"]: r["error"] is None for r in e.embed_frame(df, "id", "t").collect()} == {1: True, 2: False}


def test_settings(tmp_path: Path):
    f = tmp_path / "c.toml"
    f.write_text("[a]\nn = 3\nflag = true\nname = 'x'\n[security]\nmode = true\n")
    s = Settings({"a.n": "7"}, f)
    assert s.get(Setting("a.n", int, 1)) == (7, "given") and s.get(Setting("a.flag", bool, False)) == (True, "file")
    assert s.get(Setting("a.other", str, "d")) == ("d", "default") and security_tier(s) == "mode"
    assert security_tier(Settings({"security.strict": "yes"}, f)) == "strict" and security_tier(Settings()) == "off"
    for bad in (Settings({"a.n": "x"}), Settings({}, f)):
        with pytest.raises(ConfigError):
            bad.get(Setting("a.n" if bad.given else "a.name", int))
    assert issubclass(DimensionError, RecallError) and "row 3" in str(DimensionError(2, 3, 3))


def test_index_versions(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    index = VectorIndex(2).upsert(df)
    index.save(str(tmp_path))
    index.remove(df.filter("id = 1"))[0].save(str(tmp_path))
    assert VectorIndex.load(spark, str(tmp_path), 2).count() == 1


def test_request_checks(spark):
    rings = spark.createDataFrame(
        [(1, ["a", ""], "o"), (2, [], None), (3, ["", ""], None), (4, ["a"], ""), (5, ["a"], "x\ty"), (6, ["a"], "é" * 65), (7, ["a", "b"], None), (8, None, None)],
        "id int, recipients array<string>, origin string",
    )
    good, bad = doorbell.checked_rings(rings)
    assert sorted((r["id"], r["recipient"]) for r in good.collect()) == [(1, "a"), (7, "a"), (7, "b")]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3, 4, 5, 6, 8]
    waits = spark.createDataFrame([(1, ["a"], None), (2, ["a"], 9999.0), (3, [""], 1.0), (4, ["a"], -1.0), (5, ["a"], float("nan"))], "id int, readers array<string>, timeout_s double")
    good, bad = doorbell.checked_waits(waits)
    assert {r["id"]: r["timeout_s"] for r in good.collect()} == {1: 300.0, 2: 3600.0} and sorted(r["id"] for r in bad.collect()) == [3, 4, 5]


def test_streaming_breaker(spark, tmp_path):
    schema = "key string, seq int, at double, ok boolean"
    rows = [("a", 1, 0.0, False), ("a", 2, 1.0, False), ("a", 3, 2.0, True), ("a", 4, 20.0, True)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = control.stream_breaker(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 10.0)
    q = q.writeStream.outputMode("append").format("memory").queryName("breaker").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["seq"], r["admitted"], r["state"]) for r in spark.table("breaker").orderBy("seq").collect()] == [
        (1, True, "closed"), (2, True, "open"), (3, False, "open"), (4, True, "closed"),
    ]
