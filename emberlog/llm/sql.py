"""DuckDB SQL for the queries that hash no words and run no tokenizer in ways SQL lacks.

Each statement works out its rows in another way than the operator: no sketches, bands, archives,
logs or templates, but joins over all shingles, windows over all payloads and sums over all turns.
"""

OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') ws from documents),
d as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from w where len(ws) > 0)),
v as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') ws from benchmark),
b as (select distinct item_id, array_to_string(ws[i:i + 4], ' ') g from (select item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from v where len(ws) > 0)),
n as (select item_id, count(*) item_shingles from b group by 1)
select doc_id, item_id, cast(item_shingles as bigint) item_shingles, cast(count(*) as bigint) common
from d join b using (g) join n using (item_id) group by doc_id, item_id, item_shingles having 100 * count(*) >= 80 * item_shingles"""

OP6_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) x from pages),
d as (select page_id, n, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(x, 5 * (k // 4) + 1, 5) as int) >> cast(15 - 5 * (k % 4) as int)) & 31) + 1, 1)), '') digest from p),
o as (select *, max(page_id) over (partition by digest) original from d)
select page_id, cast(n as bigint) payload_bytes, digest payload_digest, case when page_id < original then 'revisit' else 'response' end record_type,
  case when page_id < original then original end refers_to from o"""

OP8_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
d as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) i from w where len(ws) > 0)),
s as (select doc_id, count(*) n, md5(string_agg(g, chr(10) order by g)) name from d group by 1),
c as (select name, min(doc_id) rep, any_value(n) n from s group by 1),
g as (select rep, n, hash(g) h from c join d on rep = doc_id),
links as (select x.rep a, y.rep b from g x join g y on x.h = y.h and x.rep < y.rep and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  group by x.rep, y.rep, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(node, root) as (select rep, rep from c union select e.b, r.root from reach r join both_ways e on e.a = r.node where r.root < e.b),
least_root as (select node, min(root) root from reach group by 1)
select w.doc_id, cast(coalesce(s.n, 0) as bigint) n_shingles, coalesce(l.root, w.doc_id) component_id, w.doc_id = coalesce(l.root, w.doc_id) kept
from w left join s on w.doc_id = s.doc_id left join c on s.name = c.name left join least_root l on c.rep = l.node"""

OP9_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, x, case x when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) q(x))
select conv_id, cast(count(*) as bigint) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
  cast(sum(14 + 2 * length(r) - length(translate(r, '\#<:', '')) + 2 * length(t) - length(translate(t, '\#<', ''))) as bigint) formatted_chars
from t group by conv_id"""


def _spans(kind: int, pattern: str, value: str, keep: str) -> str:
    """Rows (rid, s, k, e, value) of the matches of a pattern: each starts where the pieces and matches before it end."""
    quoted = pattern.replace("'", "''")
    return f"""
  select rid, s, {kind} k, s + length(m) e, {value} v from (
    select rid, m, cast(sum(length(piece) + length(m)) over (partition by rid order by i) - length(m) as bigint) s from (
      select rid, unnest(string_split_regex(t, '{quoted}')) piece, unnest(list_concat(regexp_extract_all(t, '{quoted}'), [''])) m, generate_subscripts(string_split_regex(t, '{quoted}'), 1) i
      from d where regexp_matches(t, '{quoted}')))
  where {keep}"""


_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)"""
_WRITTEN = "coalesce(string_agg(['assign', 'access', 'hex', 'owned'][k + 1] || ':' || s || ':' || e, ',' order by s, k){}, '')"
_BARE = "length(m) >= 20 and not contains(m, '.') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"

OP10_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(source, chr(0)) owner, coalesce(lang, chr(0)) repository, coalesce(text, '') t from documents),
base as ({_spans(0, _ASSIGN, _VALUE, f"length({_VALUE}) >= 8")} union all {_spans(1, "AKIA[A-Z0-9]+", "m", "length(m) >= 16")} union all {_spans(2, "[0-9a-f]+", "m", "length(m) >= 32")}),
bare as (select * from ({_spans(3, "[A-Za-z0-9+/_.=-]+", "m", _BARE)}) x where not exists (select 1 from base b where b.rid = x.rid and x.s < b.e and b.s < x.e)),
found as (select * from base union all select * from bare),
seen as (select distinct v, owner, repository from found join d using (rid)),
owners as (select v, count(distinct owner) n, count(*) m from seen group by 1),
judged as (select found.*, n, m, n = 1 or n <= 2 and m <= 4 live from found join owners using (v))
select doc_id, cast(count(*) filter (k = 0) as bigint) n_assign, cast(count(*) filter (k = 1) as bigint) n_access, cast(count(*) filter (k = 2) as bigint) n_hex,
  sha256({_WRITTEN.format(" filter (k < 3)")}) base_sha256, {_WRITTEN.format(" filter (k < 3 or live)")} spans,
  cast(count(*) filter (live) as bigint) n_live, cast(count(*) filter (not live and k < 3) as bigint) n_copied,
  cast(coalesce(max(n), 0) as bigint) most_owners, cast(coalesce(max(m), 0) as bigint) most_repositories
from d left join judged using (rid) group by rid, doc_id"""
