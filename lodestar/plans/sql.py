"""The same operators as DuckDB SQL over the driver's tables, to hold results against."""

from __future__ import annotations

from lodestar.config import ADDRESS_SHORT_FORMS, LEGAL_SUFFIXES, Blocking, Sweep

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def norm(x: str) -> str:
    plain = rf"regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7F]', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(lower(replace({plain}, '&', ' and ')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def short(x: str) -> str:
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in ADDRESS_SHORT_FORMS.items())
    return f"array_to_string(list_transform({words(x)}, lambda t: case t {cases} else t end), ' ')"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '\w+')"


RECORDS = """rec as (select concat('S', (1 + cast(substr(source, 4) as int) % 3)::varchar, '-', doc_id::varchar) as entity_id,
    concat('S', (1 + cast(substr(source, 4) as int) % 3)::varchar) as source, substr(split_part(text, '.', 1), 1, 60) as business_name,
    substr(split_part(text, chr(10), 2), 1, 80) as business_address, lang as country, text from documents)"""
_PARTS = r"list_filter(list_transform(string_split(coalesce(business_address, ''), ','), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '')"
PREPARED = rf"""{RECORDS},
p0 as (select *, {norm('business_name')} as n0, {norm('business_address')} as a0, {norm('country')} as country_normalized, {_PARTS} as parts from rec),
p1 as (select *, array_to_string(list_filter({words('n0')}, lambda t: not list_contains({_LIST(LEGAL_SUFFIXES)}, t)), ' ') as name_normalized,
    {short('a0')} as address_normalized, array_to_string(case when len(parts) >= 3 then parts[-2:] else parts[-1:] end, ' , ') as tail from p0),
p2 as (select *, {norm('tail')} as t0, {tokens('name_normalized')} as nw, {tokens('address_normalized')} as aw from p1),
p3 as (select *, {short('t0')} as t1, {distinct('nw')} as name_tokens, {distinct('aw')} as address_tokens,
    list_filter(aw, lambda t: regexp_matches(t, '\d')) as address_numeric_tokens,
    list_filter(regexp_extract_all(address_normalized, '[0-9]+'), lambda t: length(t) between 4 and 6) as pw from p2),
prep as (select *, {distinct('pw')} as address_postal_tokens, list_sort({distinct(tokens('t1'))}) as address_locality_tokens from p3)"""


def grams(x: str, n: int = 3) -> str:
    c = f"replace({x}, ' ', '')"
    all_of = f"list_transform(range(1, greatest(length({c}) - {n - 1}, 1) + 1), lambda i: substr({c}, i, {n}))"
    return f"case when {c} = '' then [] when length({c}) <= {n} then [{c}] else list_distinct({all_of}) end"


def keys(methods: tuple[str, ...]) -> str:
    long = lambda x: f"list_filter({x}, lambda t: length(t) >= 2)"
    one = lambda ok, x: f"case when {ok} then [{x}] else [] end"
    of = {
        "normalized_name_exact": one("name_normalized <> ''", "name_normalized"), "name_token": long("name_tokens"), "address_token": long("address_tokens"),
        "postal_token": long("address_postal_tokens"), "locality_token": long("address_locality_tokens"),
        "name_prefix": f"list_transform(list_sort({long('name_tokens')})[1:1], lambda t: left(t, 3))",
        "name_ngram": grams("name_normalized"), "address_ngram": grams("address_normalized"),
        "country_name": one("country_normalized <> '' and name_normalized <> ''", "country_normalized || '|' || name_normalized"),
        "country_address": one("country_normalized <> '' and address_normalized <> ''", "country_normalized || '|' || address_normalized"),
    }
    return " union all ".join(f"select entity_id, source, country_normalized as c, '{m}' as method, unnest({of[m]}) as key from prep" for m in methods)


def pairs(methods: tuple[str, ...] = Blocking().probed, most: int | None = 500) -> str:
    methods = tuple(m for m in methods if m != "name_phonetic")
    cut = f"qualify row_number() over (partition by reference_source, reference_entity_id order by candidate_source, candidate_entity_id) <= {most}" if most else ""
    return f"""{PREPARED},
keys as materialized ({keys(methods)}),
met as (select distinct l.source as reference_source, l.entity_id as reference_entity_id, r.source as candidate_source, r.entity_id as candidate_entity_id, l.method
    from keys l join keys r on l.method = r.method and l.key = r.key where l.source = 'S1' and r.source <> 'S1' and (l.c = '' or r.c = '' or l.c = r.c)),
pairs as materialized (select reference_source, reference_entity_id, candidate_source, candidate_entity_id, string_agg(method, ',' order by method) as blocking_methods
    from met group by 1, 2, 3, 4 {cut})"""


_SIDES = ("name_normalized", "address_normalized", "country_normalized", "name_tokens", "address_tokens", "address_postal_tokens", "address_locality_tokens")
LOOKED = ", ".join(f"l.{f} as l_{f}, r.{f} as r_{f}" for f in _SIDES)
JOINED = f"""looked as (select p.*, {LOOKED} from pairs p join prep l on l.source = p.reference_source and l.entity_id = p.reference_entity_id
    join prep r on r.source = p.candidate_source and r.entity_id = p.candidate_entity_id)"""


def _jaccard(f: str) -> str:
    return f"len(list_intersect(l_{f}, r_{f})) / greatest(1, len(list_distinct(list_concat(l_{f}, r_{f}))))::double"


def _sides(f: str) -> tuple[str, str]:
    return f"l_{f}_normalized", f"r_{f}_normalized"


def _family(f: str) -> dict[str, str]:
    a, b = _sides(f)
    longest = f"greatest(length({a}), length({b}))"

    def prefix(x: str, y: str) -> str:
        return f"case when least(length({x}), length({y})) = 0 then 0.0 else len(list_filter(range(1, least(length({x}), length({y})) + 1), lambda i: left({x}, i) = left({y}, i))) / greatest(length({x}), length({y}))::double end"

    return {
        f"{f}_exact": f"({a} <> '' and {a} = {b})::int::double", f"{f}_token_jaccard": _jaccard(f"{f}_tokens"),
        f"{f}_edit_similarity": f"case when {longest} = 0 then 0.0 else 1 - levenshtein({a}, {b}) / {longest}::double end",
        f"{f}_token_overlap": f"(len(list_intersect(l_{f}_tokens, r_{f}_tokens)) > 0)::int::double",
        f"{f}_length_difference": f"abs(length({a}) - length({b})) / greatest(1, {longest})::double",
        f"{f}_prefix_similarity": prefix(a, b), f"{f}_suffix_similarity": prefix(f"reverse({a})", f"reverse({b})"),
    }


FEATURES = _family("name") | {k: v for k, v in _family("address").items() if "fix" not in k} | {
    "name_token_count_difference": "abs(len(l_name_tokens) - len(r_name_tokens))::double", "name_order_insensitive_similarity": _jaccard("name_tokens"),
    "address_postal_agreement": "(len(list_intersect(l_address_postal_tokens, r_address_postal_tokens)) > 0)::int::double",
    "address_locality_overlap": _jaccard("address_locality_tokens"),
    "country_exact": "(l_country_normalized <> '' and l_country_normalized = r_country_normalized)::int::double",
    "country_compatible": "(l_country_normalized = '' or r_country_normalized = '' or l_country_normalized = r_country_normalized)::int::double",
    "name_address_exact": "(l_name_normalized <> '' and l_name_normalized = r_name_normalized and l_address_normalized <> '' and l_address_normalized = r_address_normalized)::int::double",
    "name_address_similarity": f"({_jaccard('name_tokens')} + {_jaccard('address_tokens')}) / 2",
    **{f"missing_{f}": f"(l_{f}_normalized = '' or r_{f}_normalized = '')::int::double" for f in ("name", "address", "country")},
}
ID = "reference_entity_id, candidate_entity_id"


def features(names: list[str], most: int = 500) -> str:
    return f"with {pairs(most=most)}, {JOINED} select {ID}, " + ", ".join(f"round({FEATURES[f]}, 6) as {f}" for f in names) + " from looked"


LINKS = f"""full_text as (select entity_id, source, country, {norm('text')} as t from rec),
links as (select distinct l.entity_id as reference_entity_id, r.entity_id as candidate_entity_id from full_text l
    join full_text r on l.country = r.country and l.t = r.t where l.source = 'S1' and r.source <> 'S1')"""
SCORED = f"{JOINED}, scored as (select p.*, round(({_jaccard('name_tokens')} + {_jaccard('address_tokens')}) / 2, 6) as score from looked p)"
ENTITIES = """own as (select entity_id as reference_entity_id from rec where source = 'S1')"""


def decided(threshold: float) -> str:
    return f"{pairs()}, {LINKS}, {SCORED}, {ENTITIES}, decided as (select *, score >= {threshold} as predicted_match from scored)"


_F05 = "case when {t} = 0 and {p} = 0 then 1.0 else coalesce(1.25 * prec * rec_ / nullif(0.25 * prec + rec_, 0), 0.0) end"


def metrics_of(counts: str, keys: str) -> str:
    """Entity metrics from a table with keys, p, t and h."""
    f = _F05.format(t="t", p="p")
    return f"""(select {keys}, p, t, h, prec, rec_, {f} as f05, t = 0 as single, t = 0 and p = 0 as single_ok from
    (select *, coalesce(h / nullif(p, 0)::double, 0.0) as prec, case when t > 0 then h / t::double when p = 0 then 1.0 else 0.0 end as rec_ from {counts}))"""


def per_entity(threshold: float) -> str:
    return f"""{decided(threshold)}, yes as (select distinct {ID} from decided where predicted_match),
counts as (select o.reference_entity_id, coalesce(y.p, 0) as p, coalesce(l.t, 0) as t, coalesce(y.h, 0) as h from own o
    left join (select y.reference_entity_id, count(*) as p, count(k.candidate_entity_id) as h from yes y left join links k using ({ID}) group by 1) y using (reference_entity_id)
    left join (select reference_entity_id, count(*) as t from links group by 1) l using (reference_entity_id)),
ent as (select * from {metrics_of('counts', 'reference_entity_id')})"""


def sweep() -> str:
    grid = ", ".join(f"({t!r})" for t in Sweep().grid())
    return f"""with {decided(0.5)}, grid as (select col0::double as threshold from (values {grid})),
yes as (select g.threshold, s.reference_entity_id, count(*) as p, count(k.candidate_entity_id) as h from grid g join scored s on s.score >= g.threshold
    left join links k using ({ID}) group by all),
counts as (select g.threshold, o.reference_entity_id, coalesce(y.p, 0) as p, coalesce(l.t, 0) as t, coalesce(y.h, 0) as h from grid g cross join own o
    left join yes y using (threshold, reference_entity_id) left join (select reference_entity_id, count(*) as t from links group by 1) l using (reference_entity_id))
select round(threshold, 6) as threshold, round(avg(prec), 6) as macro_precision, round(avg(rec_), 6) as macro_recall, round(avg(f05), 6) as macro_f05,
    round(coalesce(sum(p - h) / nullif(sum(p), 0)::double, 0), 6) as false_merge_rate, round(coalesce(sum(single_ok::int) / nullif(sum(single::int), 0)::double, 1), 6) as singleton_accuracy
from {metrics_of('counts', 'threshold')} group by 1"""
