"""DuckDB SQL for the contract queries that SQL can express on whole tables.

Left out: op1 (a fitted classifier), op4 (its hash), op5 and op9 (a tokenizer library), op6 and op7 (verification over
aligned regions), op10 (random draws) and op12 (hashed order of blocks); tests hold these against brute force.
"""

from __future__ import annotations

from . import codebooks, secretscan, urlfilter


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_filters() -> str:
    pattern = ", ".join(f"case when regexp_matches(lower(url), {_text(r.pattern)}) then {_text(r.name)} end" for r in urlfilter.PATTERN_RULES)
    rule, verdict = "", ""
    for r in sorted(urlfilter.BASE_RULES, key=lambda r: (-len(r.name), r.name)):
        at = f"when (host = {_text(r.host)} or ends_with(host, {_text('.' + r.host)})) and starts_with(path, {_text(r.path)})"
        rule, verdict = f"{rule} {at} then {_text(r.name)}", f"{verdict} {at} then {_text(r.verdict)}"
    return f"""with r as (select page_id, url, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
 h as (select page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path, list_min(list_filter([{pattern}], lambda x: x is not null)) as pattern_rule from r)
 select page_id, host, path, case {rule} end as rule, case {verdict} when pattern_rule is not null then 'block' else 'allow' end as verdict, pattern_rule from h"""


_JACCARD = rf"""with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as sh from t),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (sh) where a.doc_id < b.doc_id group by 1, 2),
 l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
 e as (select x, y from l union select y, x from l),
 r as (select x as node, x as c from e union select e.y, r.c from r join e on e.x = r.node)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, d.doc_id) as component_id from documents d left join n using (doc_id) left join (select node, min(c) as c from r group by 1) m on m.node = d.doc_id"""


def _secret_scans() -> str:
    parts = []
    for i, r in enumerate(secretscan.BASE_RULES + secretscan.MORE_RULES):
        p = _text(r.pattern)
        parts.append(
            f"select doc_id, {i} as o, {_text(r.kind)} as kind, list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) as s, length(m[k]) as n from "
            f"(select *, unnest(range(1, len(m) + 1)) as k from (select doc_id, regexp_extract_all(x, {p}, 0) as m, string_split_regex(x, {p}) as b, regexp_extract_all(x, {p}, {r.group}) as t from d where regexp_matches(x, {p}))) where length(t[k]) >= {r.least}"
        )
    line = "kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint)"
    base = ", ".join(f"count(*) filter (o = {i}) as n_{r.kind}" for i, r in enumerate(secretscan.BASE_RULES))
    k = len(secretscan.BASE_RULES)
    return f"""with d as (select doc_id, coalesce(text, '') as x from documents), f as ({' union all '.join(parts)}),
 g as (select doc_id, {base}, string_agg({line}, ',' order by s, o) filter (o < {k}) as b, string_agg({line}, ',' order by s, o) as a from f group by 1)
 select d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in secretscan.BASE_RULES)}, sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans from d left join g using (doc_id)"""


def _filter_audit() -> str:
    """Every order and step by counting documents over the flags, without survivors of subsets."""
    failing = "(case when a then 1 else 0 end + case when b then 2 else 0 end + case when c then 4 else 0 end + case when d then 8 else 0 end + case when e then 16 else 0 end)"
    return rf"""with x as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x from documents), w as (select *, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') as w from x),
 f as (select doc_id, part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x) as c, regexp_matches(x, '[#$%&*|]') as d, doc_id > min(doc_id) over (partition by x) as e from w),
 l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
 m as (select part, {failing} as m, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by 1, 2),
 i as (select unnest(range(5)) as i), o as (select a.i as a, b.i as b, c.i as c, d.i as d, e.i as e from i a, i b, i c, i d, i e where a.i not in (b.i, c.i, d.i, e.i) and b.i not in (c.i, d.i, e.i) and c.i not in (d.i, e.i) and d.i <> e.i),
 s as (select 'ABCDE'[a + 1] || 'ABCDE'[b + 1] || 'ABCDE'[c + 1] || 'ABCDE'[d + 1] || 'ABCDE'[e + 1] as filter_order, k as step, [a, b, c, d, e][k] as f, [0, 1 << a, (1 << a) + (1 << b), (1 << a) + (1 << b) + (1 << c), 31 - (1 << e)][k] as before from o, (select unnest(range(1, 6)) as k)),
 t as (select part, filter_order, step, f, sum(case when m & (before | (1 << f)) = 0 then n else 0 end) as kept, sum(case when m & before = 0 and m & (1 << f) > 0 then n else 0 end) as removed, sum(case when m & before > 0 and m & (1 << f) > 0 then n else 0 end) as redundant,
  sum(case when m = 1 << f then n else 0 end) as unique_fails, sum(case when m & before = 0 and m & (1 << f) > 0 then good else 0 end) as good_lost, sum(case when m & before = 0 and m & (1 << f) > 0 then toxic else 0 end) as toxic_lost from m, s group by 1, 2, 3, 4)
 select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from t"""


def _vector_codes() -> str:
    """The rounds one after the other, a table of entries each."""
    width = "len(v) // 8"
    q = f"""with recursive k as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({codebooks.SCALE} * cast(x as double)) as bigint)) as v, row_number() over () as r from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select r, p, list_slice(v, p * ({width}) + 1, (p + 1) * ({width})) as x from k, (select unnest(range(8)) as p)),
 b0 as (select p, e, x from (select r, row_number() over (order by vec_id nulls last, v) - 1 as e from k) join p using (r) where e < {codebooks.ENTRIES})"""
    near = "select r, p, arg_min(e, d * 256 + e) as e, min(d) as d from (select r, p.p, e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from p join {0} b using (p)) group by 1, 2"
    for i in range(codebooks.ROUNDS):
        q += f""", a{i} as materialized ({near.format(f'b{i}')}), m{i} as (select p, e, i, cast(floor_sum as bigint) as x from (select p, e, i, (s - ((s % n) + n) % n) // n as floor_sum from (select p, e, i, cast(sum(x[i]) as bigint) as s, count(*) as n from a{i} join p using (r, p), (select unnest(range(1, 1 + (select max({width}) // 1 from k))) as i) group by 1, 2, 3))),
 b{i + 1} as materialized (select p, e, coalesce(n.x, b.x) as x from b{i} b left join (select p, e, list(x order by i) as x from m{i} group by 1, 2) n using (p, e))"""
    last = f"b{codebooks.ROUNDS}"
    return f"""{q}, z as ({near.format(last)}), c as (select r, string_agg(printf('%02x', cast(e as int)), '' order by p) as code, cast(sum(d) as bigint) as error from z group by 1),
 h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from {last})
 select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join c using (r), h"""


ORACLES: dict[str, str] = {
    "op2_url_filters": _url_filters(), "op3_ngram_jaccard_join": _JACCARD, "op8_secret_scans": _secret_scans(), "op11_filter_audit": _filter_audit(), "op13_vector_codes": _vector_codes(),
}
