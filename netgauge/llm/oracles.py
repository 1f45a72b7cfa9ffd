"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from netgauge.llm.decontam import END, GAP, NAME, NAME_PATTERN, NUMBER, NUMBER_PATTERN, UNIT, UNIT_WORDS

ORACLES: dict[str, str] = {
    "op8_perspectives": """
with c as (
  select *, (row_number() over (partition by conv_id, block order by turn, role, text) - 1) // 512 as part from (
    select conv_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text, coalesce(cast(floor(turn / 128.0) as bigint), -1) as block from conversations)),
who as (select distinct conv_id, role as speaker from c where role <> 'system'),
seg as (
  select c.conv_id, w.speaker, c.block, c.part, c.turn, c.role, c.text, c.role = w.speaker as own,
         case when c.role = w.speaker then '<|im_start|>assistant' || chr(10) when c.role = 'system' then '<|im_start|>system' || chr(10)
              else '<|im_start|>user name=' || c.role || chr(10) end as head
  from c join who w on c.conv_id is not distinct from w.conv_id),
r as (
  select conv_id, speaker, block, part, count(*) as n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' order by turn, role, text) as body,
         cast(sum(case when own then length(text) + 10 else 0 end) as bigint) as masked_chars, cast(sum(case when own then 1 else 0 end) as bigint) as n_spans
  from seg group by 1, 2, 3, 4)
select conv_id, speaker, block, part, n_turns,
       cast(coalesce(sum(length(body)) over (partition by conv_id, speaker order by block, part rows between unbounded preceding and 1 preceding), 0) as bigint) as first_char,
       cast(length(body) as bigint) as n_chars, masked_chars, n_spans, sha256(body) as text_sha256
from r""",
    "op9_minhash": """
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s
  from d),
keyed as (select min(doc_id) over (partition by s) as rep, doc_id, s from (select doc_id, list_sort(s) as s from sets)),
reps as (select doc_id, s, len(s) as n from keyed where doc_id = rep and len(s) > 0),
x as (select doc_id, n, hash(unnest(s)) as h from reps),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from x a join x b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by 1, 2),
edges as (select a, b from pairs where 100 * c >= 75 * (na + nb - c)),
sym as (select a, b from edges union all select b, a from edges),
reach as (select doc_id as node, doc_id as seen from reps where doc_id in (select a from sym) union select r.node, e.b from reach r join sym e on r.seen = e.a),
comp as (select node, min(seen) as component from reach group by 1)
select k.doc_id, cast(len(k.s) as bigint) as n_shingles,
       case when len(k.s) = 0 then k.doc_id else coalesce(c.component, k.rep) end as component_id,
       k.doc_id = case when len(k.s) = 0 then k.doc_id else coalesce(c.component, k.rep) end as kept
from keyed k left join comp c on c.node = k.rep""",
}
# Base 32 isn't among DuckDB's functions: five bits at a time, from the digest's binary digits.
ORACLES["op7_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select *, max(page_id) over (partition by html) as first_id,
        list_aggregate(list_transform(string_split(regexp_replace(sha1(html), '(.)', '\\1 ', 'g'), ' ')[1:40],
          lambda h: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], 1 + strpos('0123456789abcdef', h) - 1)), 'string_agg', '') as bits from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * cast(substr(bits, 5 * i + 1, 1) as integer) + 8 * cast(substr(bits, 5 * i + 2, 1) as integer) + 4 * cast(substr(bits, 5 * i + 3, 1) as integer)
           + 2 * cast(substr(bits, 5 * i + 4, 1) as integer) + cast(substr(bits, 5 * i + 5, 1) as integer), 1)), 'string_agg', '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from g"""

# The patterns are op4's own; a value stands between its placeholder and an end mark.
VALUED = (
    f"regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{NUMBER}{NAME}{UNIT}{END}', '    '), '{NAME_PATTERN}', ' {NAME}\\0{END} ', 'g'), '{NUMBER_PATTERN}', ' {NUMBER}\\0{END} ', 'g'), "
    f"'({NUMBER}[^{END}]*{END}) {{1,2}}{UNIT_WORDS}', '\\1 {UNIT}\\2{END} \\3', 'g')"
)
WORDS_OF = f"list_filter(string_split_regex(lower(regexp_replace(v, '([{NUMBER}-{UNIT}])[^{END}]*{END}', '\\1', 'g')), '{GAP}'), lambda x: x <> '')"
SLOTS_OF = f"list_transform(regexp_extract_all(v, '[{NUMBER}-{UNIT}]([^{END}]*){END}', 1), lambda x: lower(regexp_replace(x, '[ \\t-\\r]+', ' ', 'g')))"
SLOT = f"in ('{NUMBER}', '{NAME}', '{UNIT}')"
WINDOW_OF = "case when len(w) < 5 then array_to_string(w, ' ') || '|whole' else array_to_string(w[p + 1 : p + 5], ' ') end"
ORACLES["op4_decontamination"] = f"""
with d as (select row_number() over () as d, doc_id, {WORDS_OF} as w, {SLOTS_OF} as s from (select distinct doc_id, text, {VALUED} as v from documents)),
i as (select row_number() over () as i, item_id, {WORDS_OF} as w, {SLOTS_OF} as s from (select distinct item_id, text, {VALUED} as v from benchmark)),
dw as (select d, p, {WINDOW_OF} as win from (select d, w, unnest(range(0, greatest(len(w) - 4, 1))) as p from d where len(w) > 0)),
iw as (select i, p, len(w) as n, {WINDOW_OF} as win from (select i, w, unnest(range(0, greatest(len(w) - 4, 1))) as p from i where len(w) > 0)
  where len(list_filter(w[p + 1 : p + 5], lambda x: x not {SLOT})) > 0),
size as (select i, count(distinct q) as n_words from (select i, unnest(range(p, least(p + 5, n))) as q from iw) group by 1),
hits as (select dw.d, iw.i, dw.p as dp, iw.p as ip, iw.n from dw join iw on dw.win = iw.win),
dt as (select d, q, s[cast(slot as bigint)] as value from (select d, s, q, w[q + 1] {SLOT} as is_slot, sum(cast(w[q + 1] {SLOT} as integer)) over (partition by d order by q) as slot from (select d, w, s, unnest(range(0, len(w))) as q from d where d in (select d from hits))) where is_slot),
it as (select i, q, s[cast(slot as bigint)] as value from (select i, s, q, w[q + 1] {SLOT} as is_slot, sum(cast(w[q + 1] {SLOT} as integer)) over (partition by i order by q) as slot from (select i, w, s, unnest(range(0, len(w))) as q from i)) where is_slot),
places as (select distinct d, i, dp - ip as diagonal, unnest(range(ip, least(ip + 5, n))) as q from hits),
lines as (select p.d, p.i, p.diagonal, coalesce(bool_and(it.value = dt.value), true) as exact, count(distinct (it.value, dt.value)) filter (where it.value is not null) as pairs, count(distinct it.value) as vals
  from places p left join it on it.i = p.i and it.q = p.q left join dt on dt.d = p.d and dt.q = p.q + p.diagonal group by 1, 2, 3),
good as (select * from lines where pairs = vals),
cov as (select p.d, p.i, count(distinct p.q) as n, count(distinct p.q) filter (where g.exact) as same from places p join good g on g.d = p.d and g.i = p.i and g.diagonal = p.diagonal group by 1, 2),
found as (select d.doc_id, i.item_id, round(cov.n / size.n_words, 6) as coverage, cov.same >= 0.75 * size.n_words as exact from cov join size on size.i = cov.i join d on d.d = cov.d join i on i.i = cov.i where cov.n >= 0.75 * size.n_words)
select doc_id, count(distinct item_id) as n_items, max(coverage) as coverage, bool_or(exact) as exact, list_sort(list(distinct item_id)) as item_ids from found group by 1"""
ORACLES["op13_resampling"] = r"""
WITH table_ AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b::BIGINT, [0,1,2,3,4,5,6,7]::BIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
split AS (
  SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM texts),
features AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS b
  FROM (SELECT DISTINCT f FROM features), table_),
bucketed AS (SELECT side, row, b FROM features JOIN hashed USING (f)),
counts AS (SELECT b, sum((side = 0)::BIGINT) AS s, sum((side = 1)::BIGINT) AS t FROM bucketed GROUP BY b),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (SELECT b, floor(1000 * ln((c.t + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS g FROM counts c, totals),
weights AS (SELECT row, count(*) AS n, floor(sum(g) / count(*)) AS w FROM bucketed JOIN gains USING (b) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weights.w, 0)::BIGINT AS weight, len(split.w) >= 20 AS eligible,
    (coalesce(weights.w, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM split LEFT JOIN weights USING (row) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS r, floor(25 * sum(eligible::BIGINT) OVER () / 100) AS wanted FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND r <= wanted THEN r END AS rank FROM ranked"""
