"""The registered queries of this subpackage, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import chat, decontamination, near_dedup, packing, quality_rules, secret_scan, sharding, sql, token_frames, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.WORDS, "base_failed", "kept", "host_failed")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=0, window=1024).drop("ids")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("item_shingles").cast("long").alias("item_shingles"), F.col("common").cast("long").alias("common"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.round_trip(table(spark, sf_dir, "documents"), end_id=2)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=0.8)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.with_probe(table(spark, sf_dir, "conversations"), spark)
    return chat.digest(chat.written(chat.format_chats(chats), "formatted_chats"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.counted(secret_scan.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_sharding, op3_url_filters, op4_packing, op5_decontamination, op6_warc, op7_token_frames, op8_near_dedup, op9_chat, op10_secret_scan)
    return {f.__name__: f for f in found}


_ARMS = {"base_failed": "base_failed", "symbols": f"100 * n_symbols > {quality_rules.SYMBOL_PERCENT} * word_chars", "repeated_lines": f"100 * n_dup_lines > {quality_rules.DUP_LINE_PERCENT} * n_lines"}
OP1_SQL = rf"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
win as (select rid, i, array_to_string(ws[i:i + 4], ' ') g from (select rid, ws, unnest(range(1, len(ws) - 3)) i from w)),
dup as (select rid, i from (select *, count(*) over (partition by rid, g) n from win) where n > 1),
cov as (select rid, count(distinct i + j) c from dup, range(5) r(j) group by rid),
m as (select rid, doc_id, source, len(ws) n_words, len(array_to_string(ws, '')) word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
    len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(c, 0) n_repeat_words from w left join cov using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m),
h as ({" union all ".join(f"select '{a}' arm, source, count(*) n, count(*) filter ({c}) f from b where source is not null group by 2" for a, c in _ARMS.items())}),
p as (select arm, sum(f) / sum(n) mean, count(*) filter (n >= 5) hosts, avg(f / n) filter (n >= 5) mu, var_samp(f / n) filter (n >= 5) v from h group by 1),
k as (select arm, mean, case when hosts < 2 then 10.0 when v > 0 then least(greatest(mu * (1 - mu) / v - 1, 2.0), 10000.0) else 10000.0 end strength from p),
bad as (select distinct source from h join k using (arm) where (f + mean * strength) / (n + strength) > {quality_rules.MAX_RATE})
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, base_failed, not base_failed and bad.source is null kept, bad.source is not null host_failed
from b left join bad on b.source = bad.source"""

def _like(pattern: str) -> str:
    """A pattern rule as an RE2 expression, sign by sign."""
    text = pattern.lower()
    start = r"^(?:[^/]*\.)?" if text.startswith("||") else "^" if text.startswith("|") else ""
    end = "$" if text.endswith("|") and len(text) > 1 else ""
    text = text.removeprefix("|").removeprefix("|").removesuffix("|")
    signs = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
    return start + "".join(signs.get(c, c if c.isalnum() else f"[{c}]") for c in text) + end


OP3_SQL = f"""
with p as (select page_id, coalesce(url, '') u from pages),
s as (select page_id, case when contains(u, '://') then substr(u, strpos(u, '://') + 3) else '' end rest from p),
a as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from s),
r as (select rule, v, split_part(rule, '/', 1) rh, substr(rule, strpos(rule, '/')) rp from (values {", ".join(f"('{x}', '{v}')" for x, v in url_filters.HOST_RULES)}) t(rule, v)),
best as (select page_id, arg_max(rule, len(rule)) rule, arg_max(v, len(rule)) v from a join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
x as (select word, expr from (values {", ".join(f"('{w}', '{_like(w)}')" for w in url_filters.SPAM_PATTERNS)}) t(word, expr)),
spam as (select page_id, word from (select page_id, word, row_number() over (partition by page_id order by len(word) desc, word) k
  from a join x on regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), expr) where host || path <> '') where k = 1)
select page_id, host, path, rule, coalesce(v, case when word is not null then 'block' else 'allow' end) verdict, case when rule is null then word end pattern_rule
from a left join best using (page_id) left join spam using (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL, "op3_url_filters": OP3_SQL, "op5_decontamination": sql.OP5_SQL, "op6_warc": sql.OP6_SQL,
        "op8_near_dedup": sql.OP8_SQL, "op9_chat": sql.OP9_SQL, "op10_secret_scan": sql.OP10_SQL,
    }
