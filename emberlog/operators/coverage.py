"""Verdicts of probes reduced to requirements, cells, rollups and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.functions.kernel import percent

#: The first of these present decides, and VERIFIED needs all.
PRIORITY = ("DIVERGENT", "BLOCKED", "STALE", "UNTESTED", "VERIFIED")
STATES = ("VERIFIED", "DIVERGENT", "UNSUPPORTED", "UNTESTED", "BLOCKED", "STALE")


def probe_verdict(ran: Column, error: Column, differs: Column, stale: Column) -> Column:
    return F.when(~ran, "UNTESTED").when(error.isNotNull(), "BLOCKED").when(differs, "DIVERGENT").when(stale, "STALE").otherwise("VERIFIED")


def rank(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == v, F.lit(i)) for i, v in enumerate(PRIORITY)])


def unrank(place: Column) -> Column:
    return F.coalesce(*[F.when(place == i, F.lit(v)) for i, v in enumerate(PRIORITY)])


def requirement_states(requirements: DataFrame, probes: DataFrame, keys: list[str], unsupported: Column | None = None) -> DataFrame:
    """keys, state: by priority over the probes of each requirement; without any UNTESTED; declared unsupported wins."""
    least = probes.groupBy(*keys).agg(F.min(rank(F.col("verdict"))).alias("_r"))
    state = F.coalesce(unrank(F.col("_r")), F.lit("UNTESTED"))
    if unsupported is not None:
        state = F.when(unsupported, "UNSUPPORTED").otherwise(state)
    return requirements.join(least, keys, "left").withColumn("state", state).drop("_r")


def item_states(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key, state: none UNMAPPED, all unsupported UNSUPPORTED, else the rest by priority."""
    found = links.groupBy(key).agg(F.count("*").alias("_n"), F.min(rank(F.col("verdict"))).alias("_r"))
    state = F.when(F.col("_n").isNull(), "UNMAPPED").when(F.col("_r").isNull(), "UNSUPPORTED").otherwise(unrank(F.col("_r")))
    return items.join(found, key, "left").withColumn("state", state).drop("_n", "_r")


def cells(states: DataFrame, by: str) -> DataFrame:
    """For each group the number of each state, the denominator, and the verified share."""
    counts = [F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES]
    out = states.groupBy(by).agg(*counts, F.count("*").alias("denominator"))
    return out.withColumn("verified_pct", percent(F.col("verified"), F.col("denominator")))


def rollup(states: DataFrame, groups: list[str]) -> DataFrame:
    """One pass for the whole and for each single grouping: grouping, value, total, mapped, verified, shares; a null key is (unknown)."""
    known = states.select(*[F.coalesce(F.col(g), F.lit("(unknown)")).alias(g) for g in groups], "state")
    sets = [[], *[[F.col(g)] for g in groups]]
    out = known.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("total"), F.count_if(F.col("state") != "UNMAPPED").alias("mapped"), F.count_if(F.col("state") == "VERIFIED").alias("verified")
    )
    full = (1 << len(groups)) - 1
    name = F.coalesce(*[F.when(F.col("_g") == full - (1 << (len(groups) - 1 - i)), F.lit(g)) for i, g in enumerate(groups)], F.lit("overall"))
    return out.select(name.alias("grouping"), F.coalesce(*groups, F.lit("")).alias("value"), "total", "mapped", "verified", percent(F.col("mapped"), F.col("total")).alias("mapped_pct"), percent(F.col("verified"), F.col("total")).alias("verified_pct"))


#: What a waiver must name in full.
RECORD = ("kind", "oracle", "profile", "metric", "scope", "before", "after")


def _lost(before: DataFrame, after: DataFrame, keys: list[str], kind: str, metric: str) -> DataFrame:
    """keys, scope, before, after of the groups of ``before`` that have lost an id or members; both: keys, id, distinct."""
    gone = before.join(after, [*keys, "id"], "left_anti").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("scope"))
    count = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    out = count(before, "before").join(count(after, "after"), keys, "left").join(gone, keys, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    out = out.where(F.col("scope").isNotNull() | (F.col("after") < F.col("before"))).withColumn("scope", F.coalesce("scope", F.lit("")))
    return out.withColumns({"kind": F.lit(kind), "metric": F.lit(metric), "before": F.col("before").cast("string"), "after": F.col("after").cast("string")})


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """The records (``RECORD``) of what got worse; states: profile, oracle, id, state, a row for each requirement under each oracle.

    A profile that has lost an id, or is gone (after is 0), has a smaller denominator, whatever its count;
    one that a requirement is no longer verified in, under an oracle that was measured again, has dropped.
    """
    ids = lambda df: df.select("profile", "id").distinct()
    shrunk = _lost(ids(before), ids(after), ["profile"], "denominator-shrink", "denominator").withColumn("oracle", F.lit("*"))
    keys = ["profile", "oracle"]
    verified = lambda df: df.where("state = 'VERIFIED'").select(*keys, "id").distinct()
    measured = after.select(*keys).distinct()
    dropped = _lost(verified(before).join(measured, keys, "left_semi"), verified(after), keys, "metric-drop", "verified-numerator")
    return shrunk.select(*RECORD).unionByName(dropped.select(*RECORD))


def pin_updates(before: DataFrame, after: DataFrame) -> DataFrame:
    """The records of oracles (oracle, candidate) whose candidate is another than before; one that is missing on a side is none."""
    both = before.select("oracle", F.col("candidate").alias("before")).join(after.select("oracle", F.col("candidate").alias("after")), "oracle").where("before <> after")
    return both.withColumns({"kind": F.lit("upstream-pin-update"), "profile": F.lit("*"), "metric": F.lit("candidate"), "scope": F.lit("*")}).select(*RECORD)


def matched_waivers(found: DataFrame, waivers: DataFrame) -> DataFrame:
    """``RECORD``, outcome: each waiver excuses one record that is equal in all of it; what is left over on either side fails."""
    keys = list(RECORD)
    place = lambda df: df.select(*keys).withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*keys)))
    left, right = place(found).withColumn("_f", F.lit(True)), place(waivers).withColumn("_w", F.lit(True))
    both = left.join(right, [*keys, "_k"], "full")
    outcome = F.when(F.col("_f") & F.col("_w"), "waived").when(F.col("_f"), "unwaived").otherwise("unused-waiver")
    return both.select(*keys, outcome.alias("outcome"))


def unmapped_top(states: DataFrame, most: int = 15) -> DataFrame:
    """container, id, size, remainder: the first ``most`` unmapped ids of each container and how many more there are."""
    rows = states.where("state = 'UNMAPPED'").select("container", "id")
    sizes = rows.groupBy("container").agg(F.count("*").alias("size"))
    numbered = rows.withColumn("position", F.row_number().over(W.partitionBy("container").orderBy("id"))).where(F.col("position") <= most)
    return numbered.join(sizes, "container").withColumn("remainder", F.greatest(F.col("size") - most, F.lit(0)))
