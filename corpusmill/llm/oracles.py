"""DuckDB SQL of the newer operators, made from repeated parts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    digits = f"hex(encode({text}))"
    byte = f"list_transform(range(0, len({digits}), 2), lambda i: ('0x' || substr({digits}, i::int + 1, 2))::bigint)"
    bits = "list_reduce(range(8)::bigint[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b))"
    return f"xor(4294967295, list_reduce({byte}, lambda c, b: {bits}, 4294967295::bigint))"


SPELLING = rf"""
    with recursive runs as (
        select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) as w from documents),
    counted as (select doc_id, w, count(*) as n from runs group by all),
    hashed as (select w, n, {crc32("(coalesce(doc_id::varchar, 'null') || ':' || w)")} as h from counted),
    slipped as (select case when h % 97 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from hashed),
    words as (select word, sum(n)::bigint as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
    cuts as (select distinct word, n, i, left(word, i::int - 1) as a, substr(word, i::int + 1) as b from words, range(1, 100000) r(i) where i <= length(word)),
    pairs as (
        select x.word, y.word as other, y.n as m from cuts x join cuts y on x.i = y.i and x.a = y.a and x.b = y.b where x.word <> y.word
        union select c.word, v.word, v.n from cuts c join words v on v.word = c.a || c.b
        union select v.word, c.word, c.n from cuts c join words v on v.word = c.a || c.b),
    best as (select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as form from pairs group by word),
    judged as (select words.word, n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then form end as form, case when m >= 2 * n then m end as form_n from words left join best using (word)),
    ways as (select word, form as upto from judged where form is not null
        union all select ways.word, judged.form from ways join judged on judged.word = ways.upto where judged.form is not null),
    ends as (select ways.word, upto as root from ways join judged on judged.word = ways.upto where judged.form is null)
    select judged.word, form, coalesce(root, judged.word) as root, n, n_near, form_n from judged left join ends using (word)"""


def tree(name: str, levels: int) -> str:
    """Common table expressions for trees of 8 children over ``<name>0 (tree, place, d)``: ``<name>_l<k> (tree, place, size,
    l, r)`` with the siblings at each level, and ``<name><levels>`` with the tops."""
    out = []
    for k in range(levels):
        span = "partition by tree, place // 8 order by place rows between"
        one = "count(*) over (partition by tree) = 1"
        out.append(
            f"""{name}_l{k} as materialized (select tree, place, d, {one} as single,
                case when {one} then '' else coalesce(string_agg(d, '') over ({span} unbounded preceding and 1 preceding), '') end as l,
                case when {one} then '' else coalesce(string_agg(d, '') over ({span} 1 following and unbounded following), '') end as r from {name}{k}),
            {name}{k + 1} as materialized (select tree, place // 8 as place, case when any_value(single) then any_value(d) else sha256(string_agg(d, '' order by place)) end as d
                from {name}_l{k} group by tree, place // 8)"""
        )
    return ",\n".join(out)


def _folds(name: str, levels: int, source: str, place: str) -> str:
    """Expressions carried up: what a digest becomes, and the siblings met; ``<source>`` has ``folded, met``."""
    out = []
    for k in range(levels):
        out.append(
            f"""{source}{k + 1} as materialized (select s.* exclude (folded, met), met || l || r as met, case when single then folded else sha256(l || folded || r) end as folded
                from {source}{k} s join {name}_l{k} n on n.tree = s.{place}_tree and n.place = s.{place} // {8**k})"""
        )
    return ",\n".join(out)


def merkle(levels: int = 8, top_levels: int = 4) -> str:
    """SQL of the manifest for trees of up to ``8 ** levels`` leaves and ``8 ** top_levels`` languages."""

    def field(x: str) -> str:
        return f"coalesce(strlen({x}::varchar) || ':' || ({x}::varchar), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    changed = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
    with leaves as materialized (select doc_id, coalesce('+' || lang, '') as tree, {leaf("text")} as d,
        case when {crc32("coalesce(doc_id::varchar, '-')")} % 3 = 0 and doc_id is not null then {leaf(changed)} end as other from documents),
    ordered as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as place from leaves),
    t0 as (select tree, place, d from ordered),
    {tree("t", levels)},
    u0 as materialized (select '' as tree, row_number() over (order by tree) - 1 as place, d, tree as lang from t{levels}),
    {tree("u", top_levels)},
    f0 as (select doc_id, d as leaf, tree as low_tree, place as low, '' as met, coalesce(other, d) as folded from ordered),
    {_folds("t", levels, "f", "low")},
    g0 as (select f.*, '' as high_tree, u0.place as high, u0.d as subroot from f{levels} f join u0 on u0.lang = f.low_tree),
    {_folds("u", top_levels, "g", "high")}
    select doc_id, leaf, subroot, r.d as root, sha256(met) as proof_sha256, folded as folded_root, folded = r.d as verified from g{top_levels}, u{top_levels} r"""


ORACLE_SQL = {"op12_spelling": SPELLING, "op13_merkle": merkle()}
