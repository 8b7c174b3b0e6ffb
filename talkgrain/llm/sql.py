"""DuckDB equivalents of the operators that SQL can express, over the whole documents table."""

from __future__ import annotations

from talkgrain.llm.license_texts import BASE, NOTICES, TEXTS
from talkgrain.llm.licenses import BETWEEN, COVER, NEAR, TEXT_COVER, TEXT_WORDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
with recursive split as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from split
), classes as (
  select s, min(doc_id) as rep from sets where len(s) > 0 group by s
), shingles as (
  select rep, len(s) as n, unnest(s) as h from classes
), links as (
  select a.rep as a, b.rep as b from shingles a join shingles b on a.h = b.h and a.rep < b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), both_ways as (
  select a, b from links union all select b, a from links
), reached as (
  select rep as node, rep as seen from classes
  union
  select node, b from reached join both_ways on seen = a
), components as (
  select node, min(seen) as component_id from reached group by node
)
select sets.doc_id, len(sets.s) as n_shingles, coalesce(component_id, sets.doc_id) as component_id, coalesce(component_id, sets.doc_id) = sets.doc_id as kept
from sets left join classes using (s) left join components on rep = node
"""

REMOVED_REPEATS = """
with bytes as (
  select doc_id, hex(encode(coalesce(text, ''))) as b from documents
), places as (
  select doc_id, place, substring(b, 2 * place + 1, 200) as x from (select doc_id, b, unnest(range(0, len(b) // 2 - 99)) as place from bytes)
), often as (
  select x from places group by x having count(*) > 1
), firsts as (
  select doc_id, place, row_number() over (partition by x order by doc_id, place) as nth from places join often using (x)
), repeated as (
  select doc_id, place, case when place > lag(place) over (partition by doc_id order by place) + 100 then 1 else 0 end as apart from firsts where nth > 1
), numbered as (
  select doc_id, place, sum(apart) over (partition by doc_id order by place) as run from repeated
), runs as (
  select doc_id, min(place) as lo, max(place) + 100 as hi from numbered group by doc_id, run
), before as (
  select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as kept_from from runs
), kept as (
  select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans, max(hi) as tail, string_agg(substring(b, 2 * kept_from + 1, 2 * (lo - kept_from)), '' order by lo) as k
  from before join bytes using (doc_id) group by doc_id
)
select doc_id, len(b) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k, '') || substring(b, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from bytes left join kept using (doc_id)
"""


def _templates() -> str:
    rows = [(*x, True, 1.0, 2) for x in BASE] + [(*x, False, COVER, TEXT_WORDS) for x in NOTICES] + [(*x, False, TEXT_COVER, TEXT_WORDS) for x in TEXTS]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(t)}, {quoted(label)}, {base}, {least}::double, {k})" for i, (t, label, base, least, k) in enumerate(rows))


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({_LOWER.format(text)}, '{BETWEEN}'), lambda x: x <> '')"


_GRAMS = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: struct_pack(i := i - 1, g := array_to_string(w[i:i + k - 1], ' ')))) as x"

LICENSES = f"""
with named(template, t, label, is_base, least, k) as (values {_templates()}
), split as (
  select *, {_words("t")} as w from named
), parts as (
  select template, label, is_base, least, len(w) - k + 1 as grams, k, {_GRAMS} from split
), texts as (
  select doc_id, {_words("coalesce(text, '')")} as w from documents
), grams as (
  select doc_id, k, {_GRAMS} from texts cross join (values (2), ({TEXT_WORDS})) as sizes(k)
), votes as (
  select doc_id, template, label, is_base, least, p.grams, g.x.i - p.x.i as diagonal, list(p.x.i) as ats
  from grams g join parts p on g.k = p.k and g.x.g = p.x.g group by all
), places as (
  select doc_id, label, diagonal, 1.0::double as cover, true as is_base from votes where is_base and len(ats) = grams
), apart as (
  select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {NEAR} then 1 else 0 end as new from votes where not is_base
), numbered as (
  select *, sum(new) over (partition by doc_id, template order by diagonal) as span from apart
), spans as (
  select doc_id, label, least, len(list_distinct(flatten(list(ats)))) / grams as cover from numbered group by doc_id, template, label, least, grams, span
), counted as (
  select * from places union all select doc_id, label, null, cover, false from spans where cover >= least
), found as (
  select doc_id, count(*) filter (is_base) as n_base, min(diagonal) as first_word, max(diagonal) as last_word,
    array_to_string(list_sort(list_distinct(list(label) filter (is_base))), ',') as base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') as labels, max(cover) as score
  from counted group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from texts left join found using (doc_id)
"""


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a short text of ASCII characters, bit by bit."""
    codes = f"list_transform(range(length({text})), lambda i: ascii(substring({text}, (i + 1)::int, 1))::bigint)"
    byte = "list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, (x % 2) * 3988292384::bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {byte}), 4294967295::bigint)"


#: a node is the list of its turns' keys; sums over a subtree are added up from its nodes by all their prefixes
PREFIX_TRIE = f"""
with turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null
), placed as (
  select c, role, text, row_number() over (partition by c order by turn nulls first, role, md5(length(role) || ':' || role || text)) as p from turns
), own as (
  select c, list(struct_pack(k := md5(length(role) || ':' || role || text), n := length(text)) order by p) as x from placed group by c
), convs as (
  select c, x, {_crc32("c::varchar")} % 6 as h from own
), built as (
  select a.c, list_concat(coalesce(b.x[1:a.h], []), a.x[a.h + 1:]) as x from convs a left join own b on b.c = a.c - a.c % 100
), prefixes as (
  select c, len(x) as size, unnest(range(len(x) + 1)) as depth, list_transform(x, lambda t: t.k) as ks, list_transform(x, lambda t: t.n) as ns from built
), nodes as (
  select ks[1:depth] as node, depth, min(c) as conv_id, count(*) as n_convs, any_value(case when depth > 0 then ns[depth] else 0 end) as points, list(c order by c) filter (size = depth) as ends
  from prefixes group by all
), kids as (
  select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1
), parts as (
  select n.node, depth, (n_convs - 1) * points as saved, case when k.node is null then 1 else 0 end as leaf from nodes n left join kids k on n.node = k.node
), sums as (
  select node, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from (select node[1:unnest(range(depth + 1))] as node, leaf, saved from parts) group by 1
)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(array_to_string(n.ends, ','), '')) as ends_sha256
from nodes n join sums s on s.node = n.node left join kids k on k.node = n.node left join nodes up on n.depth > 0 and up.node = n.node[1:n.depth - 1] and up.depth = n.depth - 1
"""


def _best(*ways: str) -> str:
    """SQL of the least (cost, audit) of structs, nulls left out."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w is not null))[1]"


def _way(cost: str, edit: str, to: str, test: str = "true") -> str:
    return f"case when {test} then struct_pack(c := {to}.c + {cost}, a := '{edit}' || {to}.a) end"


def _after(q: str, to: str, kept: dict[str, str]) -> str:
    """The best ways of a row in state q: delete, keep by the role's initial, rerole to state `to`."""
    ok, late = "fault in (0, 3)", "case when fault = 3 then 3 else 0 end"
    return _best(_way("4", "D", q), *[_way(late, "K", at, f"{ok} and initial = '{i}'") for i, at in kept.items()], _way(f"3 + {late}", "R", to, ok))


#: shortest paths row by row from the end, with the audits themselves, then the repaired rows edit by edit
REPAIRS = f"""
with recursive given as (
  select coalesce(conv_id::varchar, '') as id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as dice from conversations
), diced as (
  select *, {_crc32("dice")} % 20 as how from given
), kept as (
  select id, turn, case when how = 4 then 'user' else role end as role, case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when how = 3 then 2 else 1 end)) as times from diced where how <> 0
), placed as (
  select id, turn, role, text, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, substring(role, 1, 1) as initial,
    row_number() over (partition by id order by turn nulls first, role, md5(length(role) || ':' || role || text)) as i from kept
), rows as (
  select *, case when bare = '' then 1 when row_number() over (partition by id, role, text order by i) > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault, lag(initial) over (partition by id order by i) as prior from placed
), counts as (
  select id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (prior is not null and prior || initial not in ('su', 'ua', 'au')) as illegal from rows group by id
), best(id, i, b0, b1, b2, b3) as (
  select id, n + 1, {{'c': 0::bigint, 'a': ''}}, {{'c': 6::bigint, 'a': 'II'}}, {{'c': 3::bigint, 'a': 'I'}}, {{'c': 0::bigint, 'a': ''}} from counts
  union all
  select id, i, {_best("a0", _way("3", "I", "a2"), _way("6", "II", "a3"))}, {_best("a1", _way("3", "I", "a2"), _way("6", "II", "a3"))}, {_best("a2", _way("3", "I", "a3"))}, {_best("a3", _way("3", "I", "a2"))}
  from (
    select b.id, b.i - 1 as i, {_after("b0", "b2", {"s": "b1", "u": "b2"})} as a0, {_after("b1", "b2", {"u": "b2"})} as a1, {_after("b2", "b3", {"a": "b3"})} as a2, {_after("b3", "b2", {"u": "b2"})} as a3
    from best b join rows r on r.id = b.id and r.i = b.i - 1
  )
), audits as (
  select id, b0.c as cost, b0.a as audit from best where i = 1
), told(id, audit, p, i, q, lines) as (
  select id, audit, 1, 1::bigint, '', []::varchar[] from audits
  union all
  select id, audit, p + 1, case when e = 'I' then i else i + 1 end, case when e = 'D' then q when e = 'K' then initial else to_initial end,
    case when e = 'D' then lines when e = 'I' then list_append(lines, to_role || ':') when e = 'K' then list_append(lines, role || ':' || text) else list_append(lines, to_role || ':' || text) end
  from (
    select t.*, substring(audit, p, 1) as e, case when q = 'u' then 'a' else 'u' end as to_initial, case when q = 'u' then 'assistant' else 'user' end as to_role, r.role, r.text, r.initial
    from told t left join rows r on r.id = t.id and r.i = t.i where p <= length(audit)
  )
), ended as (
  select id, sha256(array_to_string(lines, chr(10))) as repaired from told where p = length(audit) + 1
)
select case when g.id <> '' then g.id::bigint end as conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired, sha256('')) as repaired_sha256
from (select distinct id from given) g left join counts using (id) left join audits using (id) left join ended using (id)
"""

ORACLE_SQL = {"op1_minhash_near_dedup": NEAR_DUPLICATES, "op3_suffix_dedup": REMOVED_REPEATS, "op5_license_scan": LICENSES, "op12_prefix_trie": PREFIX_TRIE, "op13_conversation_repair": REPAIRS}
