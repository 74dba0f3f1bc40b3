from sparkrecall import catalog


def test_embed_hash_embeds_a_very_long_text_whole(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 130_000), (2, "short text")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r for r in catalog.QUERIES["embed_hash"](spark, str(tmp_path)).collect()}
    assert all(r["error"] is None and r["dim"] == 32 and r["norm"] == 1 for r in got.values()) and len(got) == 2


def test_doorbell_wakes_cover_every_hour_and_reader(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{k:02d}", "click", 50) for k in range(3)] + [(9, "2024-02-10 05:30:00", "click", 51)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, user_id long")
    df.withColumn("ts", df["ts"].cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["doorbell_wakes"](spark, str(tmp_path)).collect()
    first = min(r["since"] for r in got)
    for key in ("click", "click@50"):
        hours = [(r["since"] - first) / 3600 for r in got if r["key"] == key]
        # a reader that still waits (two hours at most) does not begin another wait
        assert max(hours) >= 40 * 24 + 3 and max(b - a for a, b in zip(sorted(hours), sorted(hours)[1:])) <= 3
