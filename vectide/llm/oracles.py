"""SQL for the queries of this package that DuckDB can express, over whole tables and texts."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD, ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Texts as hexadecimal digits, two for each byte; every 100-byte string after its first place is covered. Hashes only leave out strings that stand once.
OP1 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
places as (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as i from d where len(h) >= 200),
twice as (select k from (select hash(substr(h, 2 * i + 1, 200)) as k from places) group by k having count(*) > 1),
p as (select doc_id, h, i from places where hash(substr(h, 2 * i + 1, 200)) in (select k from twice)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by substr(h, 2 * i + 1, 200) order by doc_id, i) as n from p) where n > 1),
heads as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 100, true) as fresh from again),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as g from heads) group by doc_id, g),
cut as (select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a)::bigint as gone, count(*) as spans from runs group by doc_id)
select d.doc_id, len(h) // 2 as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
    sha256(unhex(case when gone is null then h else array_to_string(list_transform(range(0, len(a) + 1), lambda k:
        substr(h, case when k = 0 then 1 else 2 * b[k] + 1 end, case when k = len(a) then len(h) else 2 * (a[k + 1] - case when k = 0 then 0 else b[k] end) end)), '') end)) as kept_sha256
from d left join cut on d.doc_id = cut.doc_id"""

#: Links by shared shingles, then the least id reached.
OP2 = f"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, {WORD}) as l from documents),
s as (select distinct doc_id, unnest(case when len(l) >= 5 then list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))
    when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id != b.doc_id group by all),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
reach as (select doc_id, doc_id as least from documents union select y, least from reach join links on x = reach.doc_id where y > least)
select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, min(least) as component_id from documents left join n using (doc_id) join reach using (doc_id) group by documents.doc_id, n"""

#: Base counts, then all rules of the cascade, whose order doesn't change the verdict.
OP4 = rf"""with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, {WORD}) as l from d),
k as (select doc_id, i, array_to_string(l[i:i + 7], ' ') as s from (select doc_id, l, unnest(range(1, len(l) - 6)) as i from w where len(l) >= 8)),
rep as (select doc_id, count(distinct p) as n_repeat from (select doc_id, unnest(range(i, i + 8)) as p from (select doc_id, i, count(*) over (partition by doc_id, s) as c from k) where c > 1) group by doc_id),
lines as (select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n_dup from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, {WORD}) group by doc_id),
grams as (select doc_id, n, array_to_string(l[i:i + n - 1], ' ') as g from (select doc_id, l, n, unnest(range(1, len(l) - n + 2)) as i from w, (select unnest([1, 2, 3]) as n) where len(l) >= n)),
top as (select doc_id, max(case when n = 1 then c end) as top1, max(case when n = 2 then c end) as top2, max(case when n = 3 then c end) as top3
    from (select doc_id, n, g, count(*) as c from grams group by all) group by doc_id),
bytes as (select doc_id, sum(c) as size, log2(sum(c)) - sum(c * log2(c)) / sum(c) as entropy from
    (select doc_id, b, count(*) as c from (select doc_id, unnest(list_transform(range(0, len(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) as b from (select doc_id, hex(encode(t)) as h from d)) group by all) group by doc_id),
c as (select w.doc_id, len(l)::bigint as n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words,
    length(t) - length(replace(t, '!', '')) as marks, length(regexp_replace(t, '[^A-Z]', '', 'g')) as upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as letters,
    coalesce(size, 0) as size, length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) as ascii, coalesce(entropy, 0) as entropy, coalesce(n_lines, 0) as n_lines, top1, coalesce(top2, 0) as top2, coalesce(top3, 0) as top3
    from w left join rep using (doc_id) left join lines using (doc_id) left join top using (doc_id) left join bytes using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 14 * n_words
    or 4 * marks > n_words or 2 * upper > greatest(letters, 1) or 2 * (letters + size - ascii) < size or 10 * n_dup_lines > 3 * n_lines
    or 10 * top1 > 3 * n_words or 20 * top2 > 3 * n_words or 30 * top3 > 3 * n_words or entropy < 2.5) as kept from b"""

OP5 = f"""with w as (select doc_id, regexp_extract_all({LOWER}, {ALNUM}) as l from documents),
b as (select item_id, regexp_extract_all({LOWER}, {ALNUM}) as l from benchmark),
size as (select item_id, l, least(10, len(l)) as m from b where len(l) > 0),
item as (select item_id, m, array_to_string(l[i:i + m - 1], ' ') as s from (select *, unnest(range(1, len(l) - m + 2)) as i from size)),
doc as (select doc_id, m, i, array_to_string(l[i:i + m - 1], ' ') as s from (select doc_id, l, m, unnest(range(1, len(l) - m + 2)) as i from w, (select distinct m from item) where len(l) >= m)),
hit as (select distinct doc_id, i, doc.m, item_id from doc join item on doc.s = item.s and doc.m = item.m),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id),
items as (select doc_id, list(distinct cast(item_id as varchar)) as ids from hit group by doc_id)
select w.doc_id, len(l)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
    sha256(coalesce(array_to_string(list_sort(ids), ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words using (doc_id) left join items using (doc_id)"""

OP8 = f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) as l from documents),
k as (select doc_id, i, array_to_string(l[i:i + 34], ' ') as s from (select doc_id, l, unnest(range(1, len(l) - 33)) as i from w where len(l) >= 35)),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as p from (select doc_id, i, count(*) over (partition by s) as c from k) where c > 1),
cut as (select doc_id, list(p) as p, count(*) as n from gone group by doc_id),
x as (select w.doc_id, len(l) as n, unnest(l) as word, unnest(range(1, len(l) + 1)) as i from w join cut using (doc_id)),
kept as (select x.doc_id, string_agg(word, ' ' order by i) as t from x left join gone on gone.doc_id = x.doc_id and p = i where p is null group by x.doc_id)
select w.doc_id, len(l)::bigint as n_words, coalesce(cut.n, 0)::bigint as n_removed,
    sha256(case when cut.n is null then array_to_string(l, ' ') else coalesce(t, '') end) as kept_sha256
from w left join cut using (doc_id) left join kept using (doc_id)"""

_ROLE = r"replace(replace(replace(replace(role, '\', '\\'), '<', '\<'), '|', '\|'), '>', '\>')"
_TEXT = r"replace(replace(text, '\', '\\'), '<|', '<\|')"
#: The characters of a turn beside role and text: <|turn , |>, <|end|> and two line ends.
OP10 = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as t,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
    sum(length({_ROLE}) + length({_TEXT}) + 18) as n from c group by conv_id)
select conv_id, n_turns, sha256(t) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, n::bigint as formatted_chars from g"""

#: Column as byte count, colon and value, or a dash.
_FIELD = "coalesce(strlen(cast({0} as varchar))::varchar || ':' || cast({0} as varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(0, 9 * len(doc_id::varchar)), lambda k: case when k % 9 = 0 then ascii(substr(doc_id::varchar, k // 9 + 1, 1)) + 256 else 0 end)),
    lambda c, x: case when x > 0 then xor(c, x - 256) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) % 7 = 0"""


def _levels(name: str, start: str) -> str:
    """Nodes (g, lvl, i, h) of trees from their lowest level, and steps (g, i, l) of the proofs of their nodes."""
    return f"""{name}(g, lvl, i, h) as ({start} union all
        select g, lvl + 1, i // 2, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by g) as c from {name}) where c > 1 group by g, lvl, i // 2),
    {name}_top as (select g, max(lvl) as top from {name} group by g),
    {name}_steps as (select a.g, a.i, list(case when s.i is null then '0' when s.i % 2 = 0 then 'L' || s.h else 'R' || s.h end order by l.lvl) as l
        from {name} a join {name}_top t on t.g = a.g join (select unnest(range(0, 64)) as lvl) l on l.lvl < t.top
        left join {name} s on s.g = a.g and s.lvl = l.lvl and s.i = xor(a.i >> l.lvl, 1) where a.lvl = 0 group by a.g, a.i)"""


OP11 = f"""with recursive d as (select doc_id, coalesce('+' || lang, '') as g, {_leaf('n_chars')} as leaf, case when {_CRC} then {_leaf('n_chars + 1')} end as other from documents),
    n as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from d),
    {_levels("t", "select g, 0, i, leaf from n")},
    sub as (select t.g, t.h as subroot, row_number() over (order by t.g) - 1 as i from t join t_top on t.g = t_top.g and t.lvl = top),
    {_levels("u", "select '', 0, i, subroot from sub")},
    root as (select h as root from u join u_top on lvl = top),
    p as (select n.*, sub.subroot, root.root, list_concat(coalesce(t_steps.l, []), coalesce(u_steps.l, [])) as steps
        from n join sub on sub.g = n.g cross join root left join t_steps on t_steps.g = n.g and t_steps.i = n.i left join u_steps on u_steps.i = sub.i),
    f as (select *, list_reduce(list_concat([coalesce(other, leaf)], steps), lambda h, s: sha256(case s[1] when 'L' then s[2:] || h else h || s[2:] end)) as folded_root from p)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from f"""

#: The given pages mark the article; what is in it are headings, paragraphs and inline markup. A reading beside the wrappers, by this markup alone.
OP12 = r"""with a as (select page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') as l from pages),
t as (select page_id, url, list_transform(l, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) as l from a),
e as (select page_id, url, list_transform(l, lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')) as l from t),
b as (select page_id, url, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x != '') as l from e)
select page_id, url, array_to_string(l, chr(10) || chr(10)) as text, length(array_to_string(l, chr(10) || chr(10)))::bigint as n_chars from b"""

OP13 = f"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, {WORD}) as l, min(doc_id) over (partition by t) as least from d),
lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(l) < 200)::int + 2 * (100 * len(list_distinct(l)) < 50 * len(l))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > least, false)::int as mask from w left join lab on lab.doc_id = w.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 4, 8, 16]) as bit),
orders as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as gone from orders, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, step, bit, sum(case when mask & (gone | bit) = 0 then n else 0 end) as kept, sum(case when mask & bit > 0 and mask & gone = 0 then n else 0 end) as removed,
    sum(case when mask & bit > 0 and mask & gone > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit > 0 and mask & gone = 0 then good else 0 end) as good_lost, sum(case when mask & bit > 0 and mask & gone = 0 then toxic else 0 end) as toxic_lost from cells, steps group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
    (sum(removed) over (partition by part, bit))::bigint as shapley from r"""

ORACLE_SQL = {"op1_suffix_array_dedup": OP1, "op2_ngram_jaccard_join": OP2, "op4_quality_rules": OP4, "op5_decontamination": OP5, "op8_substring_dedup": OP8, "op10_chat_formatting": OP10, "op11_merkle_manifest": OP11, "op12_html_extraction": OP12, "op13_filter_interaction_audit": OP13}
