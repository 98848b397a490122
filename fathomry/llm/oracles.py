"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import math

from . import license_scan
from .mixing import BLOCK_TOKENS, ENTROPY, MAX_REPEATS, SEED, STEPS
from .quality_rules import GAMMA, MEASURES, PRIOR

_BENCH_WORDS = """list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

OP5 = f"""
with d as (select doc_id, {_BENCH_WORDS} w from documents),
b as (select item_id, {_BENCH_WORDS} w from benchmark),
bw as (select distinct item_id, array_to_string(w[s + 1:s + 8], ' ') k, least(len(w), 8) n
  from (select item_id, w, unnest(range(0, greatest(len(w) - 8, 0) + 1)) s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') k
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) s from d, sizes where len(w) >= n)),
h as (select doc_id, s, dw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from h) group by doc_id),
i as (select doc_id, count(distinct item_id) n_items,
  sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) items_sha256 from h group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from d left join c on d.doc_id = c.doc_id left join i on d.doc_id = i.doc_id
"""


def _op8() -> str:
    bucket = lambda m: f"ceil(ln({m.value}) / {math.log(GAMMA)!r})::bigint"
    cells = " union all ".join(f"select g_lang, g_source, '{k}' measure, {bucket(m)} bucket from s where not base_failed" for k, m in MEASURES.items())
    fence, test = [], []
    for k, m in MEASURES.items():
        at = f"filter (where measure = '{k}')"
        fence.append(f"max(q3 + {m.reach} * greatest(q3 - q2, {m.least})) {at} hi_{k}")
        test.append(f"coalesce({bucket(m)} > hi_{k}, false)")
        if m.low:
            fence.append(f"max(q1 - {m.reach} * greatest(q2 - q1, {m.least})) {at} lo_{k}")
            test.append(f"coalesce({bucket(m)} < lo_{k}, false)")
    return f"""
with t as (select doc_id, coalesce(lang, chr(1)) g_lang, coalesce(source, chr(1)) g_source, coalesce(text, '') x from documents),
w as (select *, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda a: a <> '') w,
  list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) l from t),
win as (select doc_id, p, array_to_string(w[p + 1:p + 5], ' ') k from (select doc_id, w, unnest(range(0, len(w) - 4)) p from w where len(w) >= 5)),
twice as (select doc_id, unnest(range(p, p + 5)) q from (select doc_id, p, count(*) over (partition by doc_id, k) c from win) where c > 1),
r as (select doc_id, count(distinct q)::bigint n from twice group by doc_id),
s0 as (select w.doc_id, g_lang, g_source, len(w)::bigint n_words, len(l)::bigint n_lines,
  length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars,
  (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')))::bigint n_capitals,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words
  from w left join r on w.doc_id = r.doc_id),
s as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from s0),
k as (select g_lang, g_source, measure, bucket, count(*)::hugeint n from ({cells}) group by all),
z as (select g_lang, measure, sum(n)::hugeint size from k group by all),
v as (select g_lang, g_source, measure, bucket, sum(w) w from (
  select k.g_lang, g_source, k.measure, bucket, n * size w from k join z on k.g_lang = z.g_lang and k.measure = z.measure
  union all select e.g_lang, e.g_source, e.measure, k.bucket, k.n * {PRIOR} from (select distinct g_lang, g_source, measure from k) e
    join k on k.g_lang = e.g_lang and k.measure = e.measure) group by all),
c as (select *, sum(w) over (partition by g_lang, g_source, measure order by bucket) cum,
  sum(w) over (partition by g_lang, g_source, measure) total from v),
q as (select g_lang, g_source, measure, min(bucket) filter (where cum * 4 >= total) q1,
  min(bucket) filter (where cum * 4 >= total * 2) q2, min(bucket) filter (where cum * 4 >= total * 3) q3 from c group by all),
f as (select g_lang, g_source, {", ".join(fence)} from q group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(test)}) kept
from s left join f using (g_lang, g_source)
"""


OP1 = f"""
with recursive d as (select doc_id, source, coalesce(source, chr(1)) g,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n from documents),
per as (select g, sum(n)::bigint tokens, count(*) docs from d group by g),
sh as (select sum(tokens)::bigint total, list(tokens::double / (select sum(tokens) from per) order by g) ps from per where tokens > 0),
bis as (select 0 k, 0.0::double lo, 1.0::double hi, 0.0::double lo2, 1.0::double hi2 from sh
  union all select k + 1,
    case when up then mid else lo end, case when up then hi else mid end,
    case when up2 then mid2 else lo2 end, case when up2 then hi2 else mid2 end
  from (select *, ln(z) - mid * list_sum(list_transform(ps, lambda p: p ** mid * ln(p))) / z >= {ENTROPY} * ln(len(ps)) - 1e-12 up,
      list_max(list_transform(ps, lambda p: p ** (mid2 - 1))) * list_max(list_transform(ps, lambda p: p ** (1 - mid2))) > {MAX_REPEATS} + 1e-9 up2
    from (select *, (lo + hi) / 2 mid, (lo2 + hi2) / 2 mid2, list_sum(list_transform(ps, lambda p: p ** ((lo + hi) / 2))) z
      from bis, sh where k < {STEPS}))),
e as (select greatest(hi, hi2) a from bis where k = {STEPS}),
o as (select a, total, list_sum(list_transform(ps, lambda p: p ** a)) z,
  round(total * (list_max(list_transform(ps, lambda p: p ** (1 - a))) * list_sum(list_transform(ps, lambda p: p ** a))))::bigint budget from e, sh),
pl as (select g, tokens, budget, case when tokens > 0 then (tokens::double / total) ** a / z else 0 end weight,
  case when tokens > 0 then round(budget * ((tokens::double / total) ** a / z))::bigint else 0 end quota from per, o),
x as (select doc_id, source, g, n, tokens, budget, weight, quota,
  unnest(range(0, case when tokens > 0 then ceil(quota / tokens)::bigint else 1 end)) pass from d join pl using (g)),
y as (select *, md5('{SEED}:' || pass || ':' || coalesce(doc_id::varchar, 'null')) h from x),
a as (select *, pass * tokens + sum(n) over (partition by g, pass order by h, n rows unbounded preceding) - n pos from y),
b as (select *, greatest(case when quota = 0 then 0 else least(floor(pos * ceil(budget / {float(BLOCK_TOKENS)}) / quota),
    ceil(budget / {float(BLOCK_TOKENS)}) - 1) end, 0)::bigint block
  from a where pos < quota or (n = 0 and pos <= quota))
select doc_id, source, pass::integer pass, n n_tokens, round(weight, 6) weight, block,
  row_number() over (partition by block order by md5('slot:' || h), h, n)::bigint slot from b
"""

_SETS = """
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents),
sh as (select distinct doc_id, array_to_string(w[s + 1:s + 5], ' ') k from (select doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) s from d where len(w) > 0)),
n as (select doc_id, count(*) n from sh group by doc_id)"""

#: All pairs by shared shingles, then the least doc_id that each reaches.
OP9 = f"""{_SETS},
p as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
m as (select x doc_id, min(y) y from r group by x)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(least(d.doc_id, m.y), d.doc_id) component_id, d.doc_id = coalesce(least(d.doc_id, m.y), d.doc_id) kept
from d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""


def _op6() -> str:
    table = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.known().items())
    rules = license_scan.RULES
    cut = lambda pattern: f"string_split_regex(regexp_replace(coalesce(text, ''), '{license_scan.ABBREVIATION}', '\\1.\\2', 'g'), '{pattern}')"
    sentences = lambda c: f"(select doc_id, s.i, trim(regexp_replace(lower(s.l), '[^a-z0-9]+', ' ', 'g')) s from (select doc_id, unnest({cut(c)}) l, unnest(range(len({cut(c)}))) i from documents) s)"
    ids = lambda c: f"(select doc_id, list(ident order by i) ids from {sentences(c)} x join known k on k.s = x.s group by doc_id)"
    fits = lambda r, more="": f"select doc_id, '{r.license}' l from q where (regexp_matches(sa, '{r.pattern}') or regexp_matches(sb, '{r.pattern}')){more}"
    union = " union all ".join
    plain = union(fits(r) for r in rules if not r.unless)
    rest = union(fits(r, f" and doc_id not in (select doc_id from raw where l = '{r.unless}')") for r in rules if r.unless not in (None, license_scan.ANY))
    last = union(fits(r, " and doc_id not in (select doc_id from most)") for r in rules if r.unless == license_scan.ANY)
    free = ", ".join(f"'{n}'" for k in license_scan.KIND.values() for n in k)
    copyleft = ", ".join(f"'{n}'" for n in license_scan.KIND["copyleft"])
    return f"""
with known as (select * from (values {table}) t(s, ident)), a as {ids(license_scan.LINES)}, b as {ids(license_scan.WRAPPED)},
ab as (select doc_id, coalesce(a.ids, []) x, coalesce(b.ids, []) y from a full join b using (doc_id)),
o as (select doc_id, x, y, case when len(x) >= len(y) then x else y end base, case when len(x) >= len(y) then y else x end other from ab),
q as (select doc_id, base || list_filter(other, lambda e, i: not list_contains(base, e) and list_position(other, e) = i) ids,
  ',' || array_to_string(x, ',') || ',' sa, ',' || array_to_string(y, ',') || ',' sb from o),
raw as ({plain}), most as (select * from raw union all {rest}), al as (select distinct * from (select * from most union all {last})),
g as (select doc_id, string_agg(l, ',' order by l) licenses, case when bool_or(l not in ({free})) then 'restricted' when bool_or(l in ({copyleft})) then 'copyleft' else 'permissive' end kind from al group by doc_id)
select d.doc_id, coalesce(len(ids), 0)::bigint n_sentences, coalesce(array_to_string(ids, ','), '') sentences, coalesce(licenses, '') licenses, coalesce(kind, 'none') kind
from documents d left join q on q.doc_id = d.doc_id left join g on g.doc_id = d.doc_id
"""


ORACLES: dict[str, str] = {"op1_mixing": OP1, "op5_decontamination": OP5, "op6_license_scan": _op6(), "op8_quality_rules": _op8(), "op9_minhash_near_dedup": OP9}
