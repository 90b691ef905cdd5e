"""Secrets in whole texts, told apart by who owns copies of them, in DataFrame functions only.

Patterns find candidate spans. The hash of each candidate's value is counted over the corpus by
distinct owners and repositories: a value that many owners have, or a few in many repositories, is a
copied example, and one that is an owner's is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm._store import free_name, let, marked_in, spread_join, written

#: The base patterns with the group that holds the value and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A bare token with letters and digits: a candidate only, added to the result if it is live.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])(?=[0-9+/_.=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_.=-])"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def found(text: Column, pattern: str, kind: int, least: int, value_group: int = 0, prefilter: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches whose value has ``least`` characters, by code points.

    The pieces between matches give the places: each match starts where the pieces and matches before
    it end. Only texts that hold a match at all are cut up.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def spans(m: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            value = F.regexp_extract(x["m"], pattern, value_group) if value_group else x["m"]
            one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.when(F.length(value) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        # the last piece follows the last match
        return let(pieces, lambda p: F.aggregate(F.arrays_zip(F.slice(p, 1, F.size(m)).alias("p"), m.alias("m")), start, step)["out"])

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(prefilter or pattern), let(matches, spans)).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """The spans of each base kind. The prefilters hold for every text with a span, and are quicker to miss."""
    return [
        found(text, ASSIGN, 0, 8, 2),
        found(text, ACCESS, 1, 16, 0, "AKIA[A-Z0-9]{12}"),
        # a run shorter than 32 is dropped, so the runs can be asked for at full length
        found(text, "[0-9a-f]{32,}+", 2, 32, 0),
    ]


def outside(spans: Column, base: Column) -> Column:
    """The spans that touch none of ``base``."""
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def candidate_spans(text: Column) -> Column:
    """A struct of the base spans and of the bare tokens that touch none of them."""
    full = F.coalesce(text, F.lit(""))
    return let(F.concat(*base_spans(full)), lambda b: F.struct(b.alias("base"), outside(found(full, BARE, 3, 20, 0), b).alias("bare")))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """row, doc_id, owner, repository, base spans and other candidate spans of each row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), candidate_spans(F.col(text)).alias("c"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", "c.base", "c.bare")


def each_value(rows: DataFrame) -> DataFrame:
    """row, owner, repository, value_hash, s (the span) for each candidate of ``rows``, as a written table."""
    each = rows.select("row", "owner", "repository", F.explode(F.concat("base", "bare")).alias("s"))
    return written(each.withColumn("value_hash", F.sha2(F.col("s.value"), 256)), "secret_values")


def ownership(each: DataFrame) -> DataFrame:
    """value_hash, owners, repositories: how many of each have the value; a repository is one of an owner's.

    Null owners count as one owner, and null repositories of an owner as one. Counted in steps that each
    combine before they shuffle, so a value in a third of all rows stays small.
    """
    by_repository = each.select("value_hash", "owner", "repository").distinct()
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def is_live(most_owners: int, most_repositories: int) -> Column:
    """One owner's values are live in however many of its repositories; those of a few owners only while they are in few repositories."""
    return (F.col("owners") == 1) | ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", most_owners: int = 2, most_repositories: int = 4) -> DataFrame:
    """row, doc_id, base, spans, n_live, n_copied, most_owners, most_repositories for each row of ``docs``; spans are arrays of structs.

    ``spans`` are the base spans and those bare tokens that are live, which are ``owned``: a value is
    live by ``is_live``. ``n_live`` and ``n_copied`` count the spans by it; the last two columns are the
    largest counts of owners and repositories of a value in the row, 0 without one. A null or empty
    text has no spans; repeated rows each give a row; an empty table gives an empty one.
    """
    rows = written(candidates(docs, doc_id, text, owner, repository), "secret_candidates")
    each = each_value(rows)
    live = spread_join(each, ownership(each), "value_hash", "row").withColumn("live", is_live(most_owners, most_repositories))
    verdict = live.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("owned"),
        F.sum(F.when(F.col("live"), 1).otherwise(0)).alias("n_live"),
        F.sum(F.when(~F.col("live") & (F.col("s.kind") < 3), 1).otherwise(0)).alias("n_copied"),
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.join(verdict, "row", "left")
    spans = F.concat("base", F.coalesce("owned", F.array().cast(f"array<{SPAN}>"))).alias("spans")
    return out.select("row", "doc_id", "base", spans, *[count(c) for c in ("n_live", "n_copied", "most_owners", "most_repositories")])


def counted(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"), "n_live", "n_copied", "most_owners", "most_repositories",
    )


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` in the place of each of ``spans``; of spans that overlap, what an earlier one has taken is not taken again."""

    def cut(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.sort_array(spans), start, cut, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redact(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "lang", most_owners: int = 2, most_repositories: int = 4, mark: str = "<SECRET>", length: str | None = "n_chars"
) -> DataFrame:
    """``docs`` with ``mark`` in the place of each live span; texts without one, and copied examples, stay as they are.

    The spans that ``scan`` calls live are those replaced. ``length``, if it is a column, is set to the
    new number of characters. Null and empty texts stay; repeated rows each give a row; an empty table
    gives an empty one. Columns of ``docs`` may have any names.

    Each text is searched once, and what is found is written without the text. Live spans come back
    to it under its hash: only texts that may have some are shuffled.
    """
    key, maybe, live_spans = free_name(docs, "_text_key"), free_name(docs, "_maybe"), free_name(docs, "_live_spans")
    named = docs.withColumn(key, F.unhex(F.sha2(F.col(text), 256)))
    rows = named.select(F.col(key).alias("text_key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), candidate_spans(F.col(text)).alias("c"))
    rows = rows.select("text_key", "owner", "repository", "c.base", "c.bare").where((F.size("base") > 0) | (F.size("bare") > 0))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "secret_candidates")
    each = each_value(rows)
    live = spread_join(each, ownership(each).where(is_live(most_owners, most_repositories)).select("value_hash"), "value_hash", "row")
    # rows with one text have the same spans and the same verdicts
    live = live.join(rows.select("row", "text_key"), "row").groupBy(F.col("text_key").alias(key)).agg(F.collect_set("s").alias(live_spans))
    live = written(live, "live_spans")
    marked = marked_in(named, [F.col(key)], live, [F.col(key)], maybe)
    some = marked.where(maybe).join(live, key, "left")
    some = some.withColumn(text, F.when(F.col(live_spans).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(live_spans), mark)))
    if length and length in docs.columns:
        new = F.length(text).cast(docs.schema[length].dataType)
        some = some.withColumn(length, F.when(F.col(live_spans).isNull(), F.col(length)).otherwise(new))
    return marked.where(~F.col(maybe)).drop(key, maybe).unionByName(some.drop(key, maybe, live_spans))
