"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

import math

from . import centroids, resampling, urls
from .licenses import PHRASES, SLACK, SPARE, TEMPLATES, tokens_of

ORACLES: dict[str, str] = {}

ORACLES["op3_decontamination"] = r"""
with dw as (
    select doc_id, list_filter(string_split_regex(regexp_replace(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
    from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)
), bw as (
    select item_id, list_filter(string_split_regex(regexp_replace(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') as w
    from (select item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from benchmark)
), windows as (
    select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
    from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from bw where len(w) > 0)
), sizes as (select distinct n from windows),
places as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)
), hits as (select p.doc_id, p.i, p.n, t.item_id from places p join windows t on p.win = t.win and p.n = t.n),
words_hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
    sha256(coalesce(i.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dw d left join words_hit h using (doc_id) left join items i using (doc_id)
"""

ORACLES["op2_near_dedup"] = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
    from words
), shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
    select a.doc_id as a, b.doc_id as b
    from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    group by 1, 2, a.n, b.n
    having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways as (select a, b from links union all select b, a from links),
reach as (
    select doc_id as a, doc_id as b from sets
    union
    select r.a, e.b from reach r join both_ways e on r.b = e.a
), comp as (select a as doc_id, min(b) as component_id from reach group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept from sets s join comp c using (doc_id)
"""


def licenses_sql(threshold: float = 0.9) -> str:
    """Containment of each template by brute force: every window of words against every template whose words a text has."""
    rows = []
    for label, notice in TEMPLATES:
        tokens = sorted({t.decode() for t in tokens_of(notice)})
        need = max(1, math.ceil(len(tokens) * threshold - 1e-9))
        words = len(tokens_of(notice))
        rows.append(f"('{label}', {tokens}, {need}, {words + max(SPARE, math.ceil(words * SLACK))})")
    phrases = ", ".join(f"('{label}', {phrase.split(' ')})" for phrase, label in PHRASES.items())
    return rf"""
with templates(label, tokens, need, width) as (values {", ".join(rows)}), phrases(label, parts) as (values {phrases}),
low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from low),
places as (select doc_id, label, i - 1 as word from (select doc_id, w, label, parts, unnest(range(1, len(w) + 1)) as i from words, phrases where list_has_all(w, parts)) where w[i : i + len(parts) - 1] = parts),
base as (select doc_id, count(*) as n, min(word) as a, max(word) as b, string_agg(distinct label, ',' order by label) as labels from places group by 1),
near as (select doc_id, w, label, tokens, need, width from words, templates where list_has_any(w, tokens) and len(list_intersect(tokens, w)) >= need),
blocks as (select doc_id, label, need, len(tokens) as n, len(list_intersect(tokens, w[i : i + width - 1])) as k from (select *, unnest(range(1, len(w) + 1)) as i from near)),
met as (select doc_id, label, max(k / n) as c from blocks where k >= need group by 1, 2),
best as (select doc_id, max(c) as c from met group by 1),
named as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from met union all select doc_id, label from places) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, b::bigint as last_word, coalesce(base.labels, '') as base_labels, coalesce(named.labels, '') as labels,
    (case when n > 0 then 1.0 else coalesce(c, 0.0) end)::double as score
from words left join base using (doc_id) left join best using (doc_id) left join named using (doc_id)
"""


ORACLES["op6_licenses"] = licenses_sql()


def urls_sql() -> str:
    """Rules, links and all rounds of both propagations written out; the Spark version may stop before the last round."""
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    longest = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{kind}'" for kind, h, p in longest)
    host = r"translate(coalesce(regexp_extract({0}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    after = "case when instr({0}, '://') > 0 then substr({0}, instr({0}, '://') + 3) else '' end"
    link = urls.LINK.replace("'", "''")
    rounds = "".join(
        f"""
s{k} as (select kind, host, sum(got) as score from (
    select kind, host, got from m{k}
    union all select seeds.kind, host, weight * (1 - coalesce(moved, 0)) from seeds left join (select kind, sum(got) as moved from m{k} group by 1) t on seeds.kind = t.kind) group by 1, 2),
m{k + 1} as (select s.kind, dst as host, sum({urls.DAMPING} * score * share) as got from s{k} s join shares e on s.kind = e.kind and s.host = e.src group by 1, 2),"""
        for k in range(1, urls.ROUNDS + 1)
    )
    return rf"""
with a as (select page_id, html, {after.format('url')} as t from pages),
p as (select page_id, html, {host.format('t')} as host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) as path from a),
r as (select *, case {rule} end as rule, case {verdict} end as by_rule from p),
seeds as (select kind, host, n / sum(n) over (partition by kind) as weight from (select by_rule as kind, host, count(*) as n from r where by_rule is not null and host <> '' group by 1, 2)),
u as (select host as src, case when starts_with(x, '//') then 'x:' || x else x end as x from (select host, unnest(list_distinct(list_filter(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda y: regexp_matches(y, '{urls.ABSOLUTE}')))) as x from r)),
l as (select src, {host.format(after.format('x'))} as dst from u),
one_way as (select src, dst, count(*) as n from l where src <> '' and dst <> '' and src <> dst group by 1, 2),
edges as (select 'allow' as kind, src, dst, n from one_way union all select 'block', dst, src, n from one_way),
shares as (select kind, src, dst, n / sum(n) over (partition by kind, src) as share from edges),
m1 as (select s.kind, dst as host, sum({urls.DAMPING} * weight * share) as got from seeds s join shares e on s.kind = e.kind and s.host = e.src group by 1, 2),{rounds}
hosts as (select host as h, coalesce(sum(score) filter (where kind = 'allow'), 0) as trust, coalesce(sum(score) filter (where kind = 'block'), 0) as distrust from s{urls.ROUNDS} group by 1)
select page_id, host, path, rule, coalesce(by_rule, case when coalesce(distrust, 0) > {urls.RATIO} * coalesce(trust, 0) then 'block' else 'allow' end) as verdict
from r left join hosts on host = h
"""


ORACLES["op5_url_filter"] = urls_sql()


def centroids_sql(components: int = centroids.COMPONENTS, scale: int = centroids.SCALE, k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS, salt: str = centroids.SALT) -> str:
    """All distances of all rounds computed anew, in integers."""
    near = """
a{r} as materialized (
    select vec_id, v, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance
    from (select vec_id, i, v, cluster, list_sum(list_transform(range(1, {n} + 1), lambda j: (v[j] - m[j]) * (v[j] - m[j]))) as d from x, c{r}) group by vec_id, i, v
)"""
    move = """,
p{r} as (select cluster, j, sum(v[j]) as s, count(*) as n from (select cluster, v, unnest(range(1, {n} + 1)) as j from a{r}) group by 1, 2),
m{r} as (select cluster, list((s - ((s % n) + n) % n) // n order by j) as m from p{r} group by 1),
c{next} as materialized (select c.cluster, coalesce(m{r}.m, c.m)::bigint[] as m from c{r} c left join m{r} using (cluster)),"""
    steps = "".join(near.format(r=r, n=components) + (move.format(r=r, next=r + 1, n=components) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with x as materialized (
    select vec_id, row_number() over () as i, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as v
    from embeddings where len(embedding) = {components} and len(list_filter(embedding, lambda e: isfinite(e))) = {components}
), f as (select v, row_number() over (order by sha256('{salt}' || coalesce(vec_id::varchar, '')), v) - 1 as cluster from x),
c0 as materialized (select cluster, v as m from f where cluster < {k}),{steps},
t as (select cluster, sum(distance) as own from a{rounds} group by 1)
select vec_id, cluster::int as cluster, distance::bigint as distance, own::bigint as cluster_inertia, (select sum(distance) from a{rounds})::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join t using (cluster) join c{rounds} using (cluster)
"""


ORACLES["op11_centroids"] = centroids_sql()


def resampling_sql(longest: int = resampling.LONGEST, buckets: int = resampling.BUCKETS, least: int = resampling.LEAST_WORDS, percent: int = resampling.PERCENT, salt: str = resampling.SALT) -> str:
    """Every distinct n-gram built and its CRC32 folded byte by byte."""
    codes = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (resampling.POLYNOMIAL if byte & 1 else 0)
        codes.append(byte)
    crc = "xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, codes[xor(c & 255, b) + 1]), 4294967295), 4294967295)"
    low = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    grams = " union all ".join(f"select {{0}}, array_to_string(w[i : i + {m} - 1], ' ') as g from (select {{0}}, w, unnest(range(1, len(w) - {m} + 2)) as i from {{1}} where len(w) >= {m})" for m in range(1, longest + 1))
    return rf"""
with d as materialized (select doc_id, row_number() over () as r, {low} as w from documents),
b as (select {low} as w from benchmark),
dg as materialized ({grams.format('r', 'd')}), bg as materialized ({grams.format('1 as r', 'b')}),
every as (select g, hex(encode(g)) as h from (select g from dg union select g from bg)),
coded as materialized (select g, {crc} % {buckets} as bucket from every, (select {codes}::bigint[] as codes)),
s as (select bucket, count(*) as s from dg join coded using (g) group by 1), t as (select bucket, count(*) as t from bg join coded using (g) group by 1),
gains as (
    select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from dg) + {buckets})::double) / ((s + 1)::double * ((select count(*) from bg) + {buckets})::double)))::bigint as gain
    from s left join t using (bucket)
), sums as (select r, count(*) as n, sum(gain) as total from dg join coded using (g) join gains using (bucket) group by 1),
weights as (
    select doc_id, r, len(w) as n_words, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
        ('0x' || substr(sha256('{salt}' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
    from d left join sums using (r)
), scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from weights),
ranked as (select r, row_number() over (order by score desc, doc_id nulls first, n_features, weight) as place from scored where n_words >= {least})
select doc_id, n_features::bigint as n_features, weight, score::bigint as score, (case when place <= {percent} * (select count(*) from ranked) // 100 then place end)::bigint as rank
from scored left join ranked using (r)
"""


ORACLES["op12_resampling"] = resampling_sql()
