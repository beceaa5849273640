"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import sharding
from .ann import op7_ann
from .bpe import op1_bpe
from .cuckoo import op12_cuckoo
from .langid import op4_langid
from .license import op5_license
from .lm import op2_lm
from .packing import op6_packing
from .quality import BARS, BOILERPLATE, SENTENCE_END, QualityRules, op3_quality
from .repair import op13_repair
from .sharding import op9_sharding
from .simhash import op8_simhash
from .tokencount import op10_tokencount
from .trie import op11_trie

QUERIES = {f.__name__: f for f in (op1_bpe, op2_lm, op3_quality, op4_langid, op5_license, op6_packing, op7_ann, op8_simhash, op9_sharding, op10_tokencount, op11_trie, op12_cuckoo, op13_repair)}

_WHITE = r"[\x20\x09-\x0D]"
_RULES = QualityRules()
_SENTENCE_END = SENTENCE_END.replace("'", "''")


def _count(chars: str) -> str:
    return f"(length(s) - length(regexp_replace(s, '[{chars}]', '', 'g')))"


_OP3 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) as i from d),
g as (select *, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from w window p as (partition by doc_id order by i)),
r as (select *, count(*) over (partition by doc_id, w, w2, w3) as c from g where w3 is not null),
n as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from r where c > 1) group by doc_id),
l as (select doc_id, k, s, len(string_split_regex(s, '{_WHITE}+')) as n, length(regexp_replace(s, '{_WHITE}+', '', 'g')) as chars
  from (select doc_id, k, regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g') as s from (select doc_id, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as k from d))),
v as (select doc_id, sum(chars) filter (s = '' or (
    (regexp_matches(s, '{_SENTENCE_END}') or n < {_RULES.min_words_unpunctuated})
    and not {_count("#*$%&<>~^")} > n * {_RULES.max_symbols_per_word}
    and not length(s) - length(replace(s, '!!', '!')) > n * {_RULES.max_shouts_per_word}
    and not (n >= 4 and {_count(BARS)} > n * {_RULES.max_bars_per_word})
    and not (n <= {_RULES.max_boilerplate_line_words} and regexp_matches(lower(s), '{"|".join(BOILERPLATE)}')))) as kept_chars from l group by doc_id),
f as (select doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as n_words, length(regexp_replace(t, '{_WHITE}+', '', 'g')) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  (select count(*) - count(distinct x) from (select unnest(string_split(t, chr(10))) as x) where regexp_matches(x, '[^\x20\x09-\x0D]')) as n_dup_lines from d),
a as (select doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  n_words < {_RULES.min_words} or 100 * coalesce(n_repeat_words, 0) > {_RULES.max_repeat_percent} * n_words as base_failed,
  coalesce(1 - coalesce(kept_chars, 0) / nullif(word_chars, 0), 0.0) as lost from f left join n using (doc_id) left join v using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost <= {_RULES.max_lost_share} as kept, round(lost, 6) as lost_share from a"""



def _bits(name: str, of: str = "key") -> str:
    return f"('0x' || substr(md5('{sharding.SEED}:{name}:' || {of}), 1, 13))::bigint"


def _winner(node) -> str:
    """The shard below a node of the tree: the child with the smallest draw, and so on."""
    if isinstance(node, tuple):
        return str(node[0])
    draws = [f"-ln(({_bits(name)} + 0.5) / 4503599627370496.0) / {sharding.weight(child)}" for name, child in node.items()]
    below = list(map(_winner, node.values()))
    cases = [f"when {' and '.join(f'{d} <= {e}' for e in draws[i + 1 :])} then {below[i]}" for i, d in enumerate(draws[:-1])]

    return f"case {' '.join(cases)} else {below[-1]} end" if cases else below[0]


def _crc_table() -> str:
    """The 256 remainders of CRC-32 by its rule: eight times, halve, and add the polynomial where a bit falls out."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return f"({out}::bigint[])"


_OP9 = f"""
with t as (select doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, 'null') as key from documents),
c as (select doc_id, key, strlen(text) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
  lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1])), 4294967295::bigint) as text_crc32 from t),
p as (select *, {_winner(sharding.tree(8))} as shard, {_winner(sharding.tree(9))} as grown_shard, {_bits("slot", "key || ':' || size || ':' || text_crc32")} % {sharding.BUCKETS} as bucket from c)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by bucket, doc_id, size, text_crc32) - 1 as slot, grown_shard from p"""

_OP12 = rf"""
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, row_number() over (g order by doc_id) = 1 as kept, text_sha256
from (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WHITE}+', ' ', 'g')) as text_sha256 from documents) window g as (partition by text_sha256)"""

_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, " + _crc_table() + "[(xor(a, b) & 255) + 1])), 4294967295::bigint)"

_OP13 = rf"""
with recursive t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format(of="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate from conversations),
d as (select conv_id, turn, if(fate = 4, 'user', role) as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(if(fate = 3, [0, 1], [0])) as copy from t where fate <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from d),
s as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, regexp_extract(text, '([^\x20\x09-\x0D]){_WHITE}*$', 1) as e, substr(role, 1, 1) as x, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as y from o),
f as (select *, e = '' as blank, e <> '' and again as dup, e <> '' and not again and e not in ('.', '!', '?') as cut from s),
stat as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated, count(*) filter (i > 1 and y || x not in ('su', 'ua', 'au')) as illegal, count(*) as n from f group by conv_id),
r(state, k, led, leads) as (values (0, 0, 0, []::varchar[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']), (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
g(led, x, became) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
e as (select state, k, leads, led as became, 'D' as op, '' as x from r union all select state, k, leads, g.became, 'K', g.x from r join g using (led) union all select state, k, leads, g.became, 'R', g.x from r join g using (led) where g.x <> 's'),
p as (select conv_id, 0::bigint as i, 0 as state, 0 as cost, '' as audit, []::varchar[] as turns from stat
  union all
  (select p.conv_id, f.i, e.became, p.cost + 2 * k + case op when 'D' then 3 when 'R' then 2 + cut::int else cut::int end as c, p.audit || repeat('I', k) || op as a,
    list_concat(p.turns, leads, case op when 'D' then [] when 'K' then [role || ':' || text] else [if(e.x = 'u', 'user:', 'assistant:') || text] end)
  from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1 join e on e.state = p.state and (op = 'D' or not blank and not dup and (op = 'R' or e.x = f.x))
  qualify row_number() over (partition by p.conv_id, e.became order by c, a) = 1)),
z as (select p.conv_id, p.cost + 2 * k as cost, audit || repeat('I', k) as audit, list_concat(turns, leads) as turns from p join stat on stat.conv_id is not distinct from p.conv_id and stat.n = p.i join r using (state) where r.led in (0, 3)
  qualify row_number() over (partition by p.conv_id order by p.cost + 2 * k, audit || repeat('I', k)) = 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stat on stat.conv_id is not distinct from c.conv_id left join z on z.conv_id is not distinct from c.conv_id"""

_OP11 = rf"""
with c as (select conv_id, text, sha256(length(role)::varchar || ':' || role || text) as token, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role)::varchar || ':' || role || text)) as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
k as (select distinct conv_id, conv_id - conv_id % 100 as base, {_CRC.format(of="conv_id::varchar")} % 6 as h from c),
r as (select k.conv_id, pos, token, text from k join c on c.conv_id = base and pos <= h union all select k.conv_id, pos, token, text from k join c using (conv_id) where pos > h),
m as (select conv_id, row_number() over (partition by conv_id order by pos) as depth, sha256(string_agg(token, '') over (partition by conv_id order by pos)) as node, length(text) as points from r union all select conv_id, 0, '', 0 from k),
n as (select node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(points) as points from m group by node),
p as (select n.*, m.node as parent from n left join m on m.conv_id = n.conv_id and m.depth = n.depth - 1),
w as (select parent as node, count(*) as n_children from p group by parent),
e as (select node, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, arg_max(node, depth) as node from m group by conv_id) group by node),
a as (select m.node, count(*) filter (w.node is null) as n_leaves, sum((n.n_convs - 1) * n.points)::bigint as saved_tokens from n left join w on w.node = n.node join m on m.conv_id = n.conv_id and m.depth <= n.depth group by m.node)
select p.conv_id, p.depth, up.conv_id as parent_conv_id, p.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from p left join n up on up.node = p.parent left join w on w.node = p.node left join e on e.node = p.node join a on a.node = p.node"""

ORACLE_SQL: dict[str, str] = {"op3_quality": _OP3, "op9_sharding": _OP9, "op11_trie": _OP11, "op12_cuckoo": _OP12, "op13_repair": _OP13}
