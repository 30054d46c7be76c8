"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""with recursive d as (select doc_id, {_WORDS.format(_LOWER)} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, node) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.node = e.a)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(node) as component_id from r left join n on n.doc_id = r.doc_id group by r.doc_id"""

SHARDING = """with bits as (select list(c order by i) as t from (select i, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as c from (select unnest(range(256))::bigint as i))),
b as (select doc_id, source, coalesce(text, '') as text, coalesce('s' || source, 'n') as st from documents),
e as (select b.*, (strlen(text) + 1)::bigint as size, xor(list_reduce(list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::bigint), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295)::bigint as text_crc32 from b, bits),
c as (select *, md5(concat_ws(':', '17', coalesce(doc_id::varchar, 'null'), text_crc32::varchar, size::varchar)) as o from e),
k as (select *, row_number() over (partition by st order by o, doc_id, text_crc32, size) as rank, count(*) over (partition by st) as total, count(*) over () as n from c),
f as (select *, (rank - (('0x' || substr(md5(st), 1, 8))::bigint::double + 0.5::double) / 4294967296::double) / total as share from k),
g as (select *, row_number() over (order by share, st, o, doc_id, text_crc32, size) - 1 as place from f)
select doc_id, size, text_crc32, 'rows' as law, (place * 16 // n)::int as shard, place - ((place * 16 // n) * n + 15) // 16 as slot, null::int as grown_shard, source as stratum from g"""

SUBSTRING = f"""with d as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
w as (select r, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select r, ws, unnest(range(1, len(ws) - 33)) as i from d where len(ws) >= 35)),
g as (select r, i from w qualify count(*) over (partition by h) > 1),
c as (select distinct r, i + k as i from g, (select unnest(range(35)) as k)),
a as (select d.r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d),
k as (select a.r, string_agg(word, ' ' order by a.i) as kept, count(*) as n from a anti join c on a.r = c.r and a.i = c.i group by a.r)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)"""

WARC = """with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages), f as (select *, min(page_id) over (partition by html) as first_id from p)
select page_id, strlen(html)::bigint as payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, (10 * (i // 8) + 1)::int, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31) + 1]), '') as payload_digest,
 case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from f"""

QUALITY = f"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, {_WORDS.format("coalesce(text, '')")} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
g as (select r, i, ws[i:i + 2] as gram from (select r, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3)),
t as (select r, i from g qualify count(*) over (partition by r, gram) > 1),
c as (select r, count(distinct i + k) as n from t, (select unnest(range(3)) as k) group by r),
m as (select doc_id, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls)::bigint as n_lines, coalesce(c.n, 0)::bigint as n_repeat_words from d left join c using (r)),
x as (select *, n_words < 50 as f1, 100 * n_repeat_words > 50 * n_words as f2, 10 * n_symbols > n_words as f3, 10 * n_dup_lines > 3 * n_lines as f4, word_chars < 2 * n_words or word_chars > 15 * n_words as f5 from m),
y as (select *, f1::int + f2::int + f3::int + f4::int + f5::int as n_failed_rules from x),
h as (select source, count(*) as n, count(*) filter (n_failed_rules > 0) as bad from y group by source),
q as (select least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) as mu, var_samp(bad / n) as v, avg(n) as n from h),
z as (select mu, case when v > 0 then least(greatest(mu * (1 - mu) / v - 1, 1), 1e6) else greatest(n, 1) end as s from q),
b as (select source, (bad + mu * s) / (n + s) > 0.5 as host_bad from h, z)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed, not (f1 or f2) and not host_bad as kept, y.source, n_failed_rules from y join b on y.source is not distinct from b.source"""

ORACLES = {"op1_jaccard_join": JACCARD, "op3_stratified_sharding": SHARDING, "op6_substring_dedup": SUBSTRING, "op9_warc_round_trip": WARC, "op10_quality_rules": QUALITY}
