"""The streaming state machine, stopped and started again on one checkpoint, against the batch fold."""

import random

from emberlog.streaming import machine

KINDS = ["step.started", "attempt.started", "step.completed", "attempt.errored", "workflow.completed"]
SCHEMA = "instance_id long, id long, kind string"


def test_stream_matches_fold(spark, tmp_path):
    random.seed(5)
    rows = [(random.randrange(6), i, random.choices(KINDS, [3, 4, 4, 2, 0.3])[0]) for i in range(300)]
    source, check, out = str(tmp_path / "in"), str(tmp_path / "check"), {}

    def keep(batch, _):
        out.update({r["instance_id"]: tuple(r) for r in batch.collect()})

    for part in (rows[:120], rows[120:210], rows[100:300]):  # the last one brings old rows again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = machine.run(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.foreachBatch(keep).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    expected = {r["instance_id"]: tuple(r) for r in machine.fold(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == expected
