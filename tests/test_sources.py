"""Spools, object folders and versioned pairs."""

from emberlog.sources import objects, spool


def test_spool(spark, tmp_path):
    path, check, seen = str(tmp_path / "spool"), str(tmp_path / "check"), []
    spool.send(spark.createDataFrame([("a", 1, "x", 5), ("b", 2, None, 6)], spool.MESSAGE), path)

    def run():
        query = spool.receive(spark, path).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run()
    assert sorted((r["queue"], r["id"], r["body"]) for r in seen) == [("a", 1, "x"), ("b", 2, None)]
    spool.send(spark.createDataFrame([("a", 3, "y\nz", 7)], spool.MESSAGE), path)
    run()
    assert len(seen) == 3 and seen[-1]["body"] == "y\nz"
    results = spark.createDataFrame([("a", 1, False), ("a", 1, True), ("b", 2, False), ("b", 2, False)], "queue string, id long, acked boolean")
    out = {r["id"]: (r["outcome"], r["tries"]) for r in spool.settled(spool.read(spark, path), results, retries=1).collect()}
    assert out == {1: ("acked", 2), 2: ("dead", 2), 3: ("pending", 0)}


def test_batches_are_bounded(spark):
    rows = spool.batched(spark.range(0, 1050, 1, 4), 100).groupBy("batch").count().collect()
    assert sum(r["count"] for r in rows) == 1050 and max(r["count"] for r in rows) == 100


def test_objects(spark, tmp_path):
    for name in ("a/1.txt", "a/b/2 x.txt", "c+d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = objects.stat(spark, str(tmp_path))
    assert {r["key"]: r["size"] for r in found.collect()} == {"a/1.txt": 7, "a/b/2 x.txt": 11, "c+d.txt": 7}
    assert [r["key"] for r in objects.listed(found, "a/", limit=1).collect()] == ["a/1.txt"]
    assert {r["prefix"]: r["objects"] for r in objects.folders(objects.listed(found, "a/"), "a/", "/").collect()} == {"a/1.txt": 1, "a/b/": 1}


def test_live_pairs(spark):
    schema = "key string, seq long, value string, metadata string, deleted boolean, expires_at long"
    rows = [("k", 1, "old", None, False, None), ("k", 2, "new", "m", None, 100), ("gone", 1, "v", None, False, None), ("gone", 2, None, None, True, None), ("over", 1, "v", None, False, 50)]
    versions = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in objects.live_pairs(versions, 50).collect()] == [("k", "new", "m")]
    assert objects.live_pairs(versions, 100).isEmpty() and objects.live_pairs(versions.limit(0), 0).isEmpty()
