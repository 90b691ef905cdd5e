"""Evidence behind verdicts: inputs, runs, receipts, classifications and the checks that bind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def any_in_scope(target: Column) -> Column:
    """An aggregate: in-scope if any of the targets is, else excluded."""
    return F.when(F.bool_or(F.coalesce(target == "in-scope", F.lit(False))), "in-scope").otherwise("excluded")


def stale_bundles(recorded: DataFrame, current: DataFrame, bundle: str, key: str, value: str) -> DataFrame:
    """bundle, stale, differing: whether any input of a bundle differs from the recorded one; an input on one side only differs."""
    left = recorded.select(bundle, key, F.col(value).alias("_was"))
    right = current.select(bundle, key, F.col(value).alias("_is"))
    differs = ~F.col("_was").eqNullSafe(F.col("_is"))
    return left.join(right, [bundle, key], "full").groupBy(bundle).agg(F.bool_or(differs).alias("stale"), F.count_if(differs).alias("differing"))


def bundle_hashes(rows: DataFrame, bundle: str, part: str, value: str) -> DataFrame:
    """bundle, parts, hash: SHA-256 of the sorted hashes of its parts, each the SHA-256 of its sorted values.

    Two levels, so that a task holds the values of one part and never those of a whole bundle.
    """
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = rows.groupBy(bundle, part).agg(digest(F.col(value)).alias("_h"))
    return parts.groupBy(bundle).agg(F.count("*").alias("parts"), digest(F.concat_ws(":", F.col(part), F.col("_h"))).alias("hash"))


def for_each_oracle(probes: DataFrame, oracles: list[str]) -> DataFrame:
    """Each row once for each oracle: the list is a literal, so nothing is joined."""
    return probes.withColumn("oracle", F.explode(F.array(*[F.lit(x) for x in oracles])))


def scenario_state(ran: Column, stale: Column, passed: Column) -> Column:
    return F.when(~ran, "not-run").when(stale, "stale").when(passed, "passed").otherwise("failed")


def unequal(proposed: DataFrame, computed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, side: rows that the two do not share, field by field; no rows mean that they are equal."""
    left, right = (df.select(key, F.struct(*fields).alias(c)) for df, c in ((proposed, "_p"), (computed, "_c")))
    side = F.when(F.col("_p").isNull(), "only-computed").when(F.col("_c").isNull(), "only-proposed").when(~F.col("_p").eqNullSafe(F.col("_c")), "differs")
    return left.join(right, key, "full").select(key, side.alias("side")).where("side is not null")


def reverse_index(direct: DataFrame, requirements: DataFrame, item: str, owner: str, requirement: str) -> DataFrame:
    """item, owner: direct links and those by way of a requirement, each once."""
    by_way = requirements.select(item, requirement).join(direct.where(F.col(requirement).isNotNull()).select(requirement, owner), requirement).select(item, owner)
    return direct.where(F.col(item).isNotNull()).select(item, owner).unionByName(by_way).distinct()


def below_threshold(cells: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """key, least, measured: thresholds not reached; what was not measured counts as 0."""
    found = thresholds.join(cells.select(key, "verified_pct"), key, "left").withColumn("measured", F.coalesce("verified_pct", F.lit(0.0)))
    return found.where(F.col("measured") < F.col("least")).select(key, "least", "measured")


def classification_faults(discovered: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    """key, fault: unclassified ids, rows for ids that are gone, and ids that are classified more than once."""
    rows = classified.groupBy(key).agg(F.count("*").alias("_n"))
    both = discovered.select(key).distinct().withColumn("_d", F.lit(True)).join(rows, key, "full")
    faults = F.array_compact(
        F.array(F.when(F.col("_n").isNull(), F.lit("unclassified")), F.when(F.col("_d").isNull(), F.lit("stale-row")), F.when(F.col("_n") > 1, F.lit("duplicate")))
    )
    return both.select(key, F.explode(faults).alias("fault"))


def compared_sets(expected: DataFrame, actual: DataFrame, group: str, member: str) -> DataFrame:
    """group, missing, unexpected, passed: how the members of each group differ."""
    left, right = (df.select(group, member).distinct().withColumn(c, F.lit(True)) for df, c in ((expected, "_e"), (actual, "_a")))
    out = left.join(right, [group, member], "full").groupBy(group).agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unexpected"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def root_matches(names: DataFrame, globs: list[str], name: str = "name") -> DataFrame:
    """root, matches, shared: names that each glob with one ``*`` (or none) matches, and those that another one matches too.

    The globs are a short literal list: each name is tested against them in one pass.
    """

    def fits(glob: str) -> Column:
        before, star, after = glob.partition("*")
        if not star:
            return F.col(name) == glob
        return F.col(name).startswith(before) & F.col(name).endswith(after) & (F.length(name) >= len(before) + len(after))

    found = F.array_compact(F.array(*[F.when(fits(g), F.lit(g)) for g in globs]))
    each = names.select(found.alias("_g")).select(F.explode("_g").alias("root"), (F.size("_g") > 1).alias("_more"))
    counts = each.groupBy("root").agg(F.count("*").alias("n"), F.count_if("_more").alias("more"))
    roots = names.sparkSession.createDataFrame([(g,) for g in globs], "root string")
    return roots.join(counts, "root", "left").select("root", F.coalesce("n", F.lit(0)).alias("matches"), F.coalesce("more", F.lit(0)).alias("shared"))


def first_versions(tree: DataFrame, name: str, depth: str, order: str, version: str) -> DataFrame:
    """name, version: the one nearest the root; on one level the first."""
    return tree.groupBy(name).agg(F.min_by(version, F.struct(depth, order)).alias(version))


def run_verdicts(results: DataFrame, run: str, candidate: str) -> DataFrame:
    """run, verdict: mixed-candidates if results of a run name more than one, else error, divergent or pass by what is worst."""
    worst = F.when(F.count_distinct(candidate) > 1, "mixed-candidates").when(F.bool_or("failed"), "error").when(F.bool_or("differs"), "divergent").otherwise("pass")
    return results.groupBy(run).agg(worst.alias("verdict"))


def chain_faults(receipts: DataFrame, chain: str, order: str) -> DataFrame:
    """chain, order, fault: receipts whose ``previous`` is not the hash of the one before. The first must name none."""
    before = F.lag("hash").over(W.partitionBy(chain).orderBy(order))
    first = F.row_number().over(W.partitionBy(chain).orderBy(order)) == 1
    fault = F.when(first & F.col("previous").isNotNull(), "names-a-previous").when(~first & ~F.col("previous").eqNullSafe(before), "broken-link")
    return receipts.select(chain, order, fault.alias("fault")).where("fault is not null")


def update_status(current: Column, candidate: Column, passed: Column) -> Column:
    return F.when(candidate.isNull() | candidate.eqNullSafe(current), "no-update").when(passed, "proposed").otherwise("blocked")
