"""Quality rules of documents and of their hosts, in DataFrame functions only.

Each document is measured over its whole text. For each rule, the share of a host's documents that fail
is shrunk towards the corpus by an empirical beta prior, and the hosts of which one shrunk rate is too
high take all their documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm._store import let, written

SPACE = " \t\n\x0b\x0c\r"
#: Shares over which a document fails the rules that count for its host only.
SYMBOL_PERCENT, DUP_LINE_PERCENT = 10, 30
RULES = ("few_words", "repetitive", "symbols", "repeated_lines")
#: A host whose shrunk rate is over this loses all its documents.
MAX_RATE = 0.5
WORDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space; none for a null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))


def covered(places: Column, width: int) -> Column:
    """Words that windows of ``width`` words at the sorted ``places`` cover."""
    last = F.size(places) - 1
    step = lambda k: F.least(F.lit(width), places[k + 1] - places[k])
    return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("long"), lambda acc, k: acc + F.when(k == last, width).otherwise(step(k)))


def repeated_places(hashes: Column) -> Column:
    """Sorted places of the hashes that occur twice or more: equal hashes are neighbours once sorted."""

    def pick(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda k: ((k > 0) & (s[k - 1]["h"] == s[k]["h"])) | ((k < last) & (s[k + 1]["h"] == s[k]["h"]))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: s[k]["i"]))

    return let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), pick)


def repeat_words(w: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows found twice or more. Windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(F.slice(w, i + 1, width)))
    some = let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(repeated_places(h), lambda p: covered(p, width))),
    )
    return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(some)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long) of a whole text."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    return let(
        F.struct(
            let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
            F.length(F.regexp_replace(full, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            counts.alias("lines"),
        ),
        lambda m: F.struct(
            m["w"].alias("w"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["n"].alias("n_lines"),
            (m["lines"]["n"] - m["lines"]["distinct"]).alias("n_dup_lines"),
        ),
    )


def failures(n_words: str, word_chars: str, n_symbols: str, n_dup_lines: str, n_lines: str, n_repeat_words: str) -> dict[str, Column]:
    """Whether a document fails each rule. The first two decide for itself, and each is counted by host."""
    return {
        "few_words": F.col(n_words) < 10,
        "repetitive": 100 * F.col(n_repeat_words) > 20 * F.col(n_words),
        "symbols": 100 * F.col(n_symbols) > SYMBOL_PERCENT * F.col(word_chars),
        "repeated_lines": 100 * F.col(n_dup_lines) > DUP_LINE_PERCENT * F.col(n_lines),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """host, doc_id and a column for each measure and each rule, and ``base_failed``."""
    out = docs.select("doc_id", "host", measures(F.col(text)).alias("m"))
    out = out.select(
        "doc_id", "host", F.col("m.w.n_words").alias("n_words"), F.col("m.word_chars").alias("word_chars"), F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.n_dup_lines").alias("n_dup_lines"), F.col("m.n_lines").alias("n_lines"), F.col("m.w.n_repeat_words").alias("n_repeat_words"),
    )
    out = out.withColumns(failures("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"))
    return out.withColumn("base_failed", F.col("few_words") | F.col("repetitive"))


def prior(docs: int, failed: int, hosts: int, mean: float | None, var: float | None) -> tuple[float, float]:
    """Mean and strength of the beta prior from the moments of the rates of all hosts with enough documents.

    The strength is kept between 2 and 10,000 documents, and is 10 where fewer than two hosts have enough.
    """
    centre = failed / docs if docs else 0.0
    if hosts < 2:
        return centre, 10.0
    return centre, min(max(mean * (1 - mean) / var - 1, 2.0), 10_000.0) if var > 0 else 10_000.0


def failing_hosts(judged: DataFrame, host: str, max_rate: float = MAX_RATE, min_docs: int = 5) -> DataFrame:
    """``host, docs, worst_rate``: the hosts of which the failure rate of some rule, shrunk by the rule's prior, is over ``max_rate``.

    The base rules count as one, as a document that fails either is rejected. Rows with a null host count for no host.
    """
    arms = ("base_failed", *RULES[2:])
    hosts = (
        judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("docs"), *[F.sum(F.col(a).cast("long")).alias(a) for a in arms])
    )
    share = lambda a: F.when(F.col("docs") >= min_docs, F.col(a) / F.col("docs"))
    moments = [F.struct(F.sum(a).alias("failed"), F.count(share(a)).alias("hosts"), F.avg(share(a)).alias("mean"), F.var_samp(share(a)).alias("var")).alias(a) for a in arms]
    seen = hosts.agg(F.sum("docs").alias("docs"), *moments).first()
    rates = []
    for a in arms:
        mean, strength = prior(seen["docs"] or 0, seen[a]["failed"] or 0, seen[a]["hosts"], seen[a]["mean"], seen[a]["var"])
        rates.append((F.col(a) + mean * strength) / (F.col("docs") + strength))
    return hosts.withColumn("worst_rate", F.greatest(*rates)).where(F.col("worst_rate") > max_rate).select("host", "docs", "worst_rate")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE, min_docs: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, host, the measures, base_failed, host_failed, kept.

    A null or empty text has no words and fails; a null host has no verdict of its own; repeated rows
    each give a row; an empty table gives an empty one. Other columns of ``docs`` are not read.
    The measures are written once: only those narrow rows are shuffled to hosts and back.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    rows = written(measured(rows), "quality_measures")
    bad = failing_hosts(rows, "host", max_rate, min_docs).select("host", F.lit(True).alias("host_failed"))
    return rows.join(bad, "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``judge`` keeps.

    Null and empty texts have no words and go; a row with a null host is judged alone; repeated rows
    have one verdict; an empty table gives an empty one. Columns of ``docs`` may have any names.

    Each text is measured once: the rows are written with the rules that they fail, those that go for
    themselves without their columns, and hosts are counted from that table. The failing hosts are
    written before the join, so that Spark knows their size when it plans it.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(host).cast("string").alias("host"), measures(F.col(text)).alias("m"))
    rows = rows.select("doc", "host", *[c.alias(n) for n, c in failures("m.w.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_lines", "m.w.n_repeat_words").items()])
    rows = rows.withColumn("base_failed", F.col("few_words") | F.col("repetitive"))
    rows = written(rows.withColumn("doc", F.when(~F.col("base_failed"), F.col("doc"))), "judged_documents", "zstd")
    bad = written(failing_hosts(rows.drop("doc"), "host", max_rate, min_docs).select("host"), "failing_hosts")
    return rows.where(~F.col("base_failed")).join(bad, "host", "left_anti").select("doc.*")
