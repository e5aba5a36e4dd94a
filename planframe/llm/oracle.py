"""DuckDB SQL of the queries that SQL can express, for the side-by-side check."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _hex(value: str, start: int) -> str:
    return f"('0x' || substr(md5({value}), {start}, 7))::bigint"


def _mix_sql() -> str:
    start = _hex("'1:' || coalesce('s' || source, '')", 1) + " / 268435456.0"
    slots = "greatest(64, ((select count(*) from documents) + 262143) // 262144)"
    crossed = "least(floor(o + pos * part) - floor(o + (pos - 1) * part), 1)"
    return rf"""
with d as (
    select doc_id, source, coalesce(len({_WORDS.format(text="text")}), 0)::bigint as size, md5(coalesce(text, '')) as tie from documents
), based as (
    select *, length(bin(size)) * 8 + case when length(bin(size)) > 3 then (size >> (length(bin(size)) - 4)::int) & 7 else size end as band,
        {_hex("'1:' || coalesce(doc_id::varchar, '') || ':' || size::varchar", 9)} % {slots} as slot
    from d
), s as (
    select source, sum(size)::bigint as source_size from d group by source
), w as (
    select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 3.0::double as cap from s
), r as (
    select *, cap / w as ratio, (sum(source_size) over ())::double as total, sum(w) over () as all_w,
        coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double) as caps,
        coalesce(sum(w) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0.0::double) as before_w
    from w
), l as (
    select *, (total - caps) / (all_w - before_w) as level from r
), t as (
    select source, source_size, least(cap, coalesce((select level from l where ratio >= level order by ratio, source is null, source limit 1) * w, cap)) as target from l
), e as (
    select *, coalesce(target / nullif(source_size::double, 0), 0.0) as per from t
), f as (
    select *, floor(per) as whole, per - floor(per) as part from e
), x as (
    select b.doc_id, b.source, b.size, f.source_size, f.target, f.whole, f.part,
        row_number() over (partition by b.source order by b.band, b.slot, b.size, b.doc_id, b.tie) as pos
    from based b join f on b.source is not distinct from f.source
), offsets as (
    select *, {start} as o from x
)
select doc_id, source, size, source_size, target, (whole + {crossed})::bigint as copies, (whole + {crossed})::bigint * size as taken from offsets"""


def _line_sql() -> str:
    words = _WORDS.format(text=_LOWER.format(text="line"))
    return rf"""
with lines as materialized (
    select doc_id, i - 1 as line_no, parts[i] as line from (select doc_id, string_split(text, chr(10)) as parts from documents), lateral (select unnest(range(1, len(parts) + 1)) as i)
), sets as materialized (
    select row_number() over (order by doc_id, line_no) as id, doc_id, line_no, s, len(s) as n from (select *, list_distinct({words}) as s from lines) where len(s) >= 1
), tokens as materialized (
    select id, n, unnest(s) as token from sets
), df as (
    select token, count(*) as df from tokens group by token
), placed as (
    select id, n, token, row_number() over (partition by id order by df, token) as pos from tokens join df using (token)
), prefix as materialized (
    select * from placed where pos <= n - ((n * 80 + 99) // 100) + 1
), pairs as (
    select distinct a.id as a, b.id as b from prefix a join prefix b on a.token = b.token and a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), gone as (
    select distinct y.doc_id, y.line_no from pairs join sets x on x.id = a join sets y on y.id = b
    where 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), kept as (
    select l.doc_id, coalesce(string_agg(line, chr(10) order by l.line_no) filter (g.line_no is null), '') as text, count(*) as n, count(g.line_no) as n_removed
    from lines l left join gone g on l.doc_id = g.doc_id and l.line_no = g.line_no group by l.doc_id
)
select d.doc_id, k.text, case when length(d.text) = 0 then 0 else k.n end as n_lines, k.n_removed from documents d join kept k using (doc_id)"""


def _ngram_sql() -> str:
    words = _WORDS.format(text=_LOWER.format(text="text"))
    return rf"""
with recursive w as materialized (
    select doc_id, {words} as w from documents
), sets as materialized (
    select doc_id, case when len(w) >= 4 then list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w
), grams as materialized (
    select doc_id, len(s) as n, unnest(s) as g from sets
), links as materialized (
    select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) as (
    select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a
), comp as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select doc_id, len(s)::bigint as n_shingles, component_id from sets join comp using (doc_id)"""


def _url_sql() -> str:
    suffixes = ", ".join(f"'{s}'" for s in ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk"))
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    kappa = lambda t: f"(select 1 / greatest(1e-4, least(0.999, coalesce(sum(n * power(k / n - m, 2) / (m * (1 - m)) - 1) / nullif(sum(n - 1), 0), 1e-4))) - 1 from {t} where n > 0 and m > 0 and m < 1)"
    return rf"""
with pages2 as (
    select page_id, {_LOWER.format(text="coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
), outcomes as (
    select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 when toxic is not null or quality is not null then 0 end) as bad from labels group by doc_id
), h as (
    select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as k from pages2 left join outcomes using (page_id) group by host
), h2 as (
    select *, case when {last(2)} in ({suffixes}) then {last(3)} else {last(2)} end as domain, case when {last(2)} in ({suffixes}) then {last(2)} else {last(1)} end as suffix from h
), s0 as (
    select suffix, sum(n) as n, sum(k) as k, (select coalesce(sum(k) / nullif(sum(n), 0), 0) from h2) as m from h2 group by suffix
), s1 as (
    select suffix, (k + {kappa("s0")} * m) / (n + {kappa("s0")}) as m from s0
), d0 as (
    select domain, suffix, sum(n) as n, sum(k) as k, any_value(m) as m from h2 join s1 using (suffix) group by domain, suffix
), d1 as (
    select domain, (k + {kappa("d0")} * m) / (n + {kappa("d0")}) as m from d0
), h3 as (
    select h2.*, m from h2 join d1 using (domain)
), h4 as (
    select host, k + {kappa("h3")} * m as a, n - k + {kappa("h3")} * (1 - m) as b from h3
), h5 as (
    select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from h4
), rules(verdict, rhost, start) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits as (
    select page_id, arg_max(rhost || start, length(rhost || start)) as rule, arg_max(verdict, length(rhost || start)) as verdict
    from pages2 join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, start) group by page_id
)
select page_id, host, path, rule, coalesce(fits.verdict, case when low > 0.5 then 'block' else 'allow' end) as verdict
from pages2 join h5 using (host) left join fits using (page_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": _mix_sql(),
    "op3_line_dedup": _line_sql(),
    "op6_url_filter": _url_sql(),
    "op7_exact_dedup": """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept, sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))""",
    "op10_ngram_join": _ngram_sql(),
}
