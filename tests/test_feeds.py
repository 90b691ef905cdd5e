"""Golden cases of public events and of the folds of write commands."""

import pytest
from pyspark.sql import functions as F

from emberlog.functions import kernel as K
from emberlog.operators import events, writes


def test_public_events(spark):
    rows = [
        (1, 7, "instance.scheduled", None, 0), (2, 7, "step.completed", '{"name":"a-1","output":"x","redacted":true}', 0),
        (3, 7, "step.completed", '{"name":"a-1","stream":true,"bytes":9,"output":"x"}', 0), (4, 7, "attempt.errored", "no json", 0),
        (5, 7, "sleep.started", '{"name":"s-1","durationMs":"5"}', 0), (6, 7, "instance.complete", None, 0),
    ]
    out = events.public_events(spark.createDataFrame(rows, "id long, instance_id long, kind string, detail string, created_at long"))
    got = {r["event_id"]: r for r in out.collect()}
    assert sorted(got) == [2, 3, 4, 5, 6]
    assert (got[2]["output"], got[3]["output"], got[3]["bytes"]) == ("[REDACTED]", None, 9.0)
    assert (got[4]["error_name"], got[4]["error_message"], got[4]["step_name"]) == ("Error", "Step attempt errored", None)
    assert (got[5]["step_name"], got[5]["duration_ms"]) == ("s-1", None)
    instances = spark.createDataFrame([(7, "running"), (8, "errored"), (9, "queued")], "id long, status string")
    assert {r["instance_id"]: r["ended_by"] for r in events.ends(out, instances).collect()} == {7: "event", 8: "status", 9: None}


def test_a_replayed_wait_keeps_its_deadline(spark):
    rows = [(1, "a", "wait_on", 10), (2, "a", "wait_on", 20), (1, "b", "wait_on", 10), (2, "b", "put", 30), (3, "b", "wait_on", 40), (1, "c", "put", 5), (2, "c", "delete", None), (1, "d", "delete", None), (2, "d", "wait_on", 8)]
    commands = spark.createDataFrame(rows, "seq long, name string, command string, wake_at long").select("*", F.lit(1).alias("instance_id"), F.lit("sleep").alias("type"), F.lit("sleep").alias("kind"))
    assert {r["name"]: r["wake_at"] for r in writes.timers(commands).collect()} == {"a": 10, "b": 30, "d": 8}


def test_steps(spark):
    rows = [(1, "a", "complete", "early", None, None), (2, "a", "ensure", None, None, None), (3, "a", "fail", None, "e", "s"), (4, "a", "ensure", None, None, None), (5, "b", "ensure", None, None, None), (6, "b", "complete", "v", "x", None)]
    commands = spark.createDataFrame(rows, "seq long, name string, command string, value string, error string, step_error string").select("*", F.lit(1).alias("instance_id"), F.lit("do").alias("type"), F.lit(0).alias("ordinal"))
    assert {r["name"]: (r["state"], r["output"], r["error"]) for r in writes.step_states(commands).collect()} == {"a": ("failed", None, "s"), "b": ("completed", "v", None)}
    assert [(r["seq"], r["kind"]) for r in writes.command_log(commands).orderBy("seq").collect()] == [(2, "step.started"), (3, "step.errored"), (5, "step.started"), (6, "step.completed")]


@pytest.mark.parametrize(("text", "out"), [('{"b":1,"a":{"d":[2,1],"c":null}}', '{"a":{"c":null,"d":[2,1]},"b":1}'), ("[3,1]", "[3,1]"), ("{", None), (None, None)])
def test_canonical_json(spark, text, out):
    assert spark.range(1).select(K.canonical_json(F.lit(text).cast("string")).alias("v")).first()["v"] == out
