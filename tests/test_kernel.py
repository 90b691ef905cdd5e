import hashlib
import re

from pyspark.sql import functions as F

import pytest

from emberlog.functions import kernel as K
from emberlog.operators import coverage, documents, inventory, journal, schedule


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("base", "attempt", "backoff", "expected"),
    [(10_000, 1, "constant", 10_000), (10_000, 3, "linear", 30_000), (10_000, 3, "exponential", 40_000), (-5, 3, "linear", 0), (7, 9, "other", 7), (2_000_000_000, 10_000, "exponential", K.DELAY_CAP_MS)],
)
def test_retry_delay(spark, base, attempt, backoff, expected):
    assert value(spark, K.retry_delay_ms(F.lit(base), F.lit(attempt), F.lit(backoff))) == expected


@pytest.mark.parametrize(("text", "ms"), [("5 seconds", 5000), ("1 hour", 3_600_000), ("5000", 5000), ("1 month", 2_592_000_000), ("2 moons", None), ("", None), ("5 s", None), ("5s", None), ("5 Seconds", 5000), (" 1.5 HOURS ", 5_400_000), ("1 hour x", None)])
def test_duration(spark, text, ms):
    assert value(spark, K.duration_ms(F.lit(text))) == ms


@pytest.mark.parametrize(("text", "ms"), [("1 year", 31_557_600_000.0), ("2 days", 172_800_000.0), ("1.5 hours", 5_400_000.0), ("40", 40.0), ("5 ms", 5.0), ("5 moons", 5.0), ("5s", None), ("", None), ("0", None), ("-1 day", None), ("x day", None), ("1e999", None), (None, None)])
def test_batch_retention(spark, text, ms):
    assert value(spark, K.batch_retention_ms(F.lit(text).cast("string"))) == ms


def test_batch_create(spark):
    rows = [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "old"), ("a", 3, None), ("a", 4, None), ("b", 0, "y"), ("b", 1, "-bad"), ("c", 0, "batch"), ("d", 0, "x")]
    rows += [("e", k, None) for k in range(101)]
    requests = spark.createDataFrame(rows, "batch string, index int, public_id string")
    out = {(r["batch"], r["index"]): r["outcome"] for r in journal.batch_created(requests, spark.createDataFrame([("old",), ("old",)], "public_id string")).collect()}
    assert [out["a", k] for k in range(5)] == ["created", "10415", "10405", "created", "created"]
    assert out["b", 0] == out["b", 1] == out["c", 0] == out["e", 100] == "refused"
    assert out["d", 0] == "created"
    assert len(out) == len(rows)


def test_identity_and_hash(spark):
    assert value(spark, K.step_key(F.lit("abc"), F.lit("do"), F.lit("process"), F.lit(2))) == "abc/do/process/2"
    assert value(spark, K.fnv1a(F.lit("abc"))) == "1a47e90b"
    for text in ("", "a\0b", "é", "x😀y"):
        h = 0x811C9DC5
        units = text.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[k : k + 2], "big")) * 16777619 & 0xFFFFFFFF
        assert value(spark, K.fnv1a(F.lit(text))) == f"{h:08x}"
    assert value(spark, K.percent(F.lit(1), F.lit(0))) is None
    assert value(spark, K.percent(F.lit(1), F.lit(8))) == 12.5
    assert value(spark, K.deadline_ready(F.lit(10), F.lit(10)))


@pytest.mark.parametrize(("rule", "fires"), [("30 5 * * *", True), ("31 5 * * *", False), ("30 5 * * SAT", True), ("30 5 * SEP MON-FRI", False), ("30 5 1 * 7", True), ("*/30 5/2 * * *", True), ("30 5 1 * */2", True)])
def test_cron(spark, rule, fires):
    assert value(spark, schedule.matches(schedule.parse_cron(rule), F.lit("2026-09-26 05:30:00").cast("timestamp"))) == fires


@pytest.mark.parametrize("rule", ["* * * *", "60 * * * *", "* * * * 0", "* * * FOO *", "5-1 * * * *", "*/0 * * * *"])
def test_cron_rejects(rule):
    with pytest.raises(ValueError):
        schedule.parse_cron(rule)


@pytest.mark.parametrize(
    ("verdicts", "state"),
    [([], "UNTESTED"), (["VERIFIED", "DIVERGENT"], "DIVERGENT"), (["UNTESTED", "BLOCKED", "VERIFIED"], "BLOCKED"), (["UNTESTED", "STALE", "VERIFIED"], "STALE"), (["VERIFIED", "VERIFIED"], "VERIFIED")],
)
def test_reduction(spark, verdicts, state):
    probes = spark.createDataFrame([("r", v) for v in verdicts], "requirement string, verdict string")
    wanted = spark.createDataFrame([("r",)], "requirement string")
    assert coverage.requirement_states(wanted, probes, ["requirement"]).first()["state"] == state
    assert coverage.requirement_states(wanted, probes, ["requirement"], F.lit(True)).first()["state"] == "UNSUPPORTED"


def test_rollback_stops_at_failure(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "instance_id int, ordinal int, failed boolean")
    assert [(r["ordinal"], r["runs"]) for r in journal.rollback_plan(rows).orderBy("position").collect()] == [(3, True), (2, True), (1, False)]


def test_stream_ends_at_gap(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 3, "z"), ("b", 1, "q")], "stream_id string, seq int, text string")
    assert [tuple(r) for r in journal.reassembled(rows).collect()] == [("a", 2, "xy")]


def test_drift_states(spark):
    rows = spark.createDataFrame([("k", i, p) for i, p in enumerate([False, True, True, False, True])], "key string, t int, here boolean")
    assert [r["state"] for r in inventory.drift_lifecycle(rows, "key", "t", "here").orderBy("t").collect()] == [None, "new", "open", "resolved", "recurred"]


def test_sections_and_changes(spark):
    def page(html):
        return documents.sections(spark.createDataFrame([(1, html)], "page_id long, html string"))

    old = page("<body><h1>Big One</h1>a<script>var t=1</script><h2>Two</h2>b<h2>Two</h2>c</body>")
    new = page("<body><h1>Big One</h1>a<script>var t=2</script><h2>Two</h2>b<h2>Two</h2>d</body>")
    assert [r["slug"] for r in old.orderBy("position").collect()] == ["big-one", "two", "two#2"]
    assert [tuple(r) for r in documents.section_changes(old, new).collect()] == [("1/two#2", "changed")]


def brute_sections(html):
    """One page's sections, a heading at a time."""
    volatile = "script|style|noscript|svg|template|footer|time"
    clean = next((m[0] for tag in ("main", "article", "body") if (m := re.search(rf"<{tag}\b.*</{tag}\s*>", html, re.I | re.S))), html)
    for pattern in (r"<!--.*?-->", rf"<({volatile})\b.*?</\1\s*>", rf"</?({volatile})\b[^>]*>"):
        clean = re.sub(pattern, " ", clean, flags=re.I | re.S)
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

    def entity(m):
        name = m[1]
        if name[0] == "#":
            digits = name[2:] if name[1] == "x" else re.match(r"\d*", name[1:])[0]
            return chr(int(digits, 16 if name[1] == "x" else 10)) if digits else m[0]
        return names.get(name.lower(), m[0])

    plain = lambda x: " ".join(re.sub(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);", entity, re.sub(r"<[^>]*>", " ", x)).split())
    found, seen, out = list(re.finditer(r"<h[1-3]\b[^>]*>.*?</h[1-3]\s*>", clean, re.I | re.S)), {}, []
    for i in range(len(found) + 1):
        head = found[i - 1] if i else None
        body = plain(clean[head.end() if head else 0 : found[i].start() if i < len(found) else len(clean)])
        if head is None and not body:
            continue
        name = "__intro__" if head is None else re.sub("[^a-z0-9]+", "-", plain(head[0]).lower()).strip("-")[:80] or "untitled"
        seen[name] = n = seen.get(name, 0) + (head is not None)
        out.append((name if n < 2 else f"{name}#{n}", hashlib.sha256(((plain(head[0]) + "\n" if head else "") + body).encode()).hexdigest()))
    return out


def test_sections_against_brute_force(spark):
    pages = [
        "<main>only an intro</main><h1>outside</h1>", "no tags", "", "<body> <p> </p></body>", "<article>intro <h2 id=a>One</h2>x</article>",
        "<body><!-- <h1>hidden</h1> -->a<script>'<h2>no</h2>'</script><h1>&amp;lt; R&#38;D &#x41;&nbsp;&bogus; &#1f; &#f;</h1>b<time>1:00</time><footer>f</footer></body>",
        "<h1>???</h1>x<h1></h1>y<h3>untitled</h3>z<svg><text>s</text></svg><noscript>n</noscript>", "<h2>a</h2>1<template><h2>t</h2></template><h2>A</h2>2<h2>open <h3>b</h3>3<header>h</header>",
        "<h1>😀 &#128512; &#x1F600;</h1>&LT;&#160;end", "<main></main><article>left out</article>",
    ]
    frame = spark.createDataFrame([*enumerate(pages), (99, None)], "page_id long, html string")
    found = {}
    for r in documents.sections(frame).orderBy("page_id", "position").collect():
        found.setdefault(r["page_id"], []).append((r["slug"], r["hash"]))
    assert found == {i: x for i, html in enumerate(pages) if (x := brute_sections(html))} and found[0][0][0] == "__intro__"
    odd = spark.createDataFrame([(1, "<h1>&#1114112;&#xD800;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFFFF;&#xFEFF;x</h1>")], "page_id long, html string")
    assert documents.sections(odd).first()["hash"] == hashlib.sha256("&#1114112;\ufffd&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFFFF; x\n".encode()).hexdigest()
    edited = frame.withColumn("html", F.regexp_replace("html", "only an intro", "another"))
    assert [tuple(r) for r in documents.section_changes(documents.sections(frame), documents.sections(edited)).collect()] == [("0/__intro__", "changed")]


def test_versions(spark):
    at_least = lambda a, b: value(spark, inventory.version_at_least(F.lit(a), F.lit(b)))
    assert at_least("10.0.0", "9.9.9") and not at_least("9.9.8", "9.9.9") and at_least(None, "1.0.0")


def test_leases_fold_over_granted_claims(spark):
    """A holds until 100: B is refused twice, and again one before the end; at the end B gets it. A lease without an end is free."""
    claims = [(1, 1, "A", 0, 100), (1, 2, "B", 10, 110), (1, 3, "B", 20, 120), (1, 4, "A", 50, 100), (1, 5, "B", 99, 200), (1, 6, "B", 100, 200), (1, 7, "A", 150, 300), (2, 8, "B", 5, None), (2, 9, "A", 6, 9), (None, 10, "A", 1, 2)]
    frame = spark.createDataFrame(claims, "instance_id long, claim_id long, owner string, claimed_at long, until long")
    out = {r["claim_id"]: r["granted"] for r in journal.lease_outcomes(frame).collect()}
    assert out == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True, 10: True}
    assert journal.lease_outcomes(frame.limit(0)).count() == 0


def test_commits_and_events(spark):
    instances = spark.createDataFrame([(1, "A", 10), (2, "A", None), (3, None, None)], "id long, lease_owner string, lease_expires_at long")
    commits = spark.createDataFrame([(1, 9, "A"), (1, 10, "A"), (2, 99, "A"), (2, 99, "B"), (3, 1, "A"), (4, 1, "A")], "instance_id long, created_at long, owner string")
    out = sorted((r["instance_id"], r["created_at"], r["owner"], r["outcome"]) for r in journal.fenced(commits, instances).collect())
    assert [x[3] for x in out] == ["committed", "lease-lost", "committed", "lease-lost", "lease-lost", "no-instance"]
    outcome = lambda status, kind: value(spark, journal.event_outcome(F.lit(status).cast("string"), F.lit(kind)))
    assert [outcome(None, "a b"), outcome("complete", "a b"), outcome("running", "a b"), outcome("running", "a_b")] == ["not-found", "not-running", "bad-type", "sent"]
