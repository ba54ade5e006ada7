"""The contracts that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

from . import licenses, mixing, urls

WS = r"'[^\x20\x09-\x0D]+'"

_TEMPLATES = ", ".join(f"({no}, '{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}])" for no, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', [{', '.join(repr(w) for w in text.split())}])" for text, label in licenses.PHRASES.items())
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENSE_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LICENSES = f"""
with d as (select row_number() over () as rid, doc_id, {_ASCII_LOWER.format("coalesce(text, '')")} as t from documents),
w as (select rid, doc_id, t, {_LICENSE_WORDS.format("t")} as ws from d),
tp(no, label, tw) as (values {_TEMPLATES}),
ph(label, pw) as (values {_PHRASES}),
pl as (select rid, label, i from (select rid, ws, unnest(range(1, len(ws) + 1)) as i from w where list_has_any(ws, ['license'])) , ph where ws[i : i + len(pw) - 1] = pw),
base as (select rid, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, list(distinct label) as labels from pl group by rid),
ln as (select rid, {_LICENSE_WORDS.format("l")} as ws from (select rid, unnest(string_split(t, chr(10))) as l from w) union all select rid, ws from w where contains(t, chr(10))),
bl as (select rid, list_distinct(ws[s + 1 : s + {licenses.BLOCK}]) as bw from (select rid, ws, unnest(range(0, greatest(len(ws) - 1, 0) + 1, {licenses.BLOCK // 2})) as s from ln)),
m as (select rid, label, len(list_intersect(bw, tw))::double / len(tw) as score from bl, tp where len(bw) >= ceil({licenses.THRESHOLD} * len(tw) - 1e-9) and len(list_intersect(bw, tw)) >= ceil({licenses.THRESHOLD} * len(tw) - 1e-9)),
mm as (select rid, list(distinct label) as labels, max(score) as score from m group by rid)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(mm.labels, [])))), ','), '') as labels,
  case when base.rid is not null then 1.0 else coalesce(mm.score, 0.0) end::double as score
from w left join base using (rid) left join mm using (rid)
"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, {WS}) as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as x from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (x) where a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, (select count(*) from e where e.a = d.doc_id)::bigint as n_links from d left join n using (doc_id) join (select a as doc_id, min(b) as component_id from r group by a) c using (doc_id)
"""

WINDOWS = f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {WS}) as ws from documents),
x as (select rid, i, array_to_string(ws[i : i + 34], ' ') as x from (select rid, ws, unnest(range(1, len(ws) - 33)) as i from d where len(ws) >= 35)),
a as (select rid, i from (select rid, i, count(*) over (partition by x) as c from x) where c > 1),
g as (select distinct rid, unnest(range(i, i + 35)) as i from a),
l as (select rid, list(i) as gone from g group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(case when gone is null then array_to_string(ws, ' ') else coalesce((select string_agg(ws[i], ' ' order by i) from (select unnest(range(1, len(ws) + 1)) as i) where not list_contains(gone, i)), '') end) as kept_sha256
from d left join l using (rid)
"""

# Bytes are pairs of hexadecimal digits here.
BYTES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
x as (select doc_id, i, substr(h, 2 * i + 1, 200) as x from (select doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - 99, 0))) as i from d)),
a as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) as k from x) where k > 1),
o as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from a),
r as (select doc_id, min(i) as lo, max(i) + 100 as hi from o group by doc_id, run),
t as (select *, case when lo <= max(hi) over (partition by doc_id order by lo rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from r),
u as (select doc_id, min(lo) as lo, max(hi) as hi from (select *, sum(new) over (partition by doc_id order by lo) as no from t) group by doc_id, no),
v as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as from_ from u),
k as (select doc_id, count(*) as n_spans, sum(hi - lo) as n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (lo - from_)), '' order by lo) || substr(any_value(h), 2 * max(hi) + 1) as kept from v join d using (doc_id) group by doc_id)
select doc_id, (strlen(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k using (doc_id)
"""



def _rules() -> tuple[str, str]:
    """Rule and its verdict: the longest that fits."""
    rule = ruled = "null"
    for v, h, x in sorted(urls.RULES, key=lambda r: (len(r[1] + r[2]), r)):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{x}')"
        rule, ruled = f"case when {fits} then '{h + x}' else {rule} end", f"case when {fits} then '{v}' else {ruled} end"
    return rule, ruled


def _rank(name: str, seed: str, src: str, dst: str) -> str:
    """The rounds of one personalised PageRank as common table expressions; the last is {name}."""
    out = f"""{name}_e as materialized (select {src} as src, {dst} as dst, weight / sum(weight) over (partition by {src}) as share from ed),
{name}_h as materialized (select host, coalesce({seed}::double / nullif((select sum({seed}) from ho), 0), 0) as home from ho),
{name}_0 as materialized (select host, home, home as rank from {name}_h)"""
    for i in range(urls.ROUNDS):
        out += f""",
{name}_g{i} as materialized (select r.host, r.home, coalesce(g.got, 0) as got from {name}_{i} r left join (select dst, sum(rank * share) as got from {name}_{i} join {name}_e on src = host group by dst) g on g.dst = r.host),
{name}_{i + 1} as materialized (select host, home, {urls.DAMPING}::double * got + (1 - {urls.DAMPING}::double * (select sum(got) from {name}_g{i})) * home as rank from {name}_g{i})"""
    return out + f", {name} as (select host, rank * (select count(*) from ho) as rank from {name}_{urls.ROUNDS})"


_RULE, _RULED = _rules()
_HOST = _ASCII_LOWER.format("regexp_extract({}, '^[^/?#]*')")
_LINK = urls.LINK.replace("'", "''")
URLS = f"""
with p0 as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
p1 as (select page_id, html, coalesce({_HOST.format("rest")}, '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from p0),
p as materialized (select *, {_RULE} as rule, {_RULED} as ruled from p1),
ho as materialized (select host, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from p where host <> '' group by host),
l0 as (select host as src, unnest(regexp_extract_all(html, '{_LINK}', 1)) as u from p where host <> ''),
l1 as (select src, {_HOST.format("regexp_replace(u, '^([a-zA-Z]*:)?//', '')")} as dst from l0),
up0 as (select host, unnest(range(2, len(string_split(host, '.')) + 1)) as i from ho),
up1 as (select host, i, array_to_string(string_split(host, '.')[i:], '.') as up from up0),
up as (select host, min_by(up, i) as up from up1 where up in (select host from ho) group by host),
e0 as (select src, dst, 1.0::double as weight from l1 where src <> dst and dst <> '' union all select host, up, 1.0 from up union all select up, host, 1.0 from up),
ed as materialized (select src, dst, sum(weight) as weight from e0 where src in (select host from ho) and dst in (select host from ho) group by src, dst),
{_rank("tr", "good", "src", "dst")},
{_rank("di", "bad", "dst", "src")}
select page_id, host, path, rule, coalesce(ruled, case when di.rank > tr.rank and di.rank > {urls.LEAST_DISTRUST} then 'block' else 'allow' end) as verdict,
  round(coalesce(tr.rank, 0), 9) as trust, round(coalesce(di.rank, 0), 9) as distrust
from p left join tr using (host) left join di using (host)
"""

_LOWER, _PLAIN = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
# CRC-32 byte by byte over the distinct words, with a table that is made here by its rule
RESAMPLE = f"""with tbl as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, i)) as crcs),
docs as (select doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) as ws, row_number() over () as no from documents),
bench as (select unnest(regexp_extract_all({_LOWER}, {_PLAIN})) as w from benchmark),
f as (select no, unnest(ws) as w from docs),
words as (select distinct w from (select w from f union all select w from bench)),
hexed as (select w, hex(encode(w)) as h from words),
crc as (select w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::int, 2))::bigint), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket from hexed cross join tbl),
s as (select bucket, count(*) as s from f join crc using (w) group by bucket), t as (select bucket, count(*) as t from bench join crc using (w) group by bucket),
n as (select (select count(*) from f)::double as s, (select count(*) from bench)::double as t),
gain as (select bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::double * (n.s + 10000) / ((coalesce(s.s, 0) + 1)::double * (n.t + 10000))))::bigint as gain from (select distinct bucket from crc) left join s using (bucket) left join t using (bucket) cross join n),
w as (select no, sum(gain)::double as total from f join crc using (w) join gain using (bucket) group by no),
sc as (select doc_id, len(ws)::bigint as n_features, case when len(ws) > 0 then floor(total / len(ws))::bigint else 0 end as weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as noise from docs left join w using (no)),
r as (select *, weight + noise as score, n_features >= 20 as able, row_number() over (partition by n_features >= 20 order by weight + noise desc, doc_id nulls last) as place from sc)
select doc_id, n_features, weight, score, case when able and place <= (select count(*) from r where able) * 10 // 100 then place end as rank from r
"""

ORACLE = {"op1_license_scan": LICENSES, "op2_ngram_jaccard": JACCARD, "op4_substring_dedup": WINDOWS, "op5_suffix_dedup": BYTES, "op6_url_filter": URLS, "op8_mix_sources": mixing.ORACLE_SQL, "op12_target_resample": RESAMPLE}
