"""DuckDB SQL for those opN_<name> queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTROL = r"([\[<])(\\*)(/?(?:s|INST|TURN|TEXT|PART|IMAGE|AUDIO|DOCUMENT)[\]>])"
_ESCAPED_LENGTH = "length(regexp_replace({0}, '" + _CONTROL + r"', '\1\\\2\3', 'g'))"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op2_chat_formatting": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        joined as (
            select conv_id, count(*) as n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
                   coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
                   cast(3 + sum(16 + {_ESCAPED_LENGTH.format("role")} + {_ESCAPED_LENGTH.format("text")}) as bigint) as formatted_chars
            from turns group by conv_id)
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars,
               sha256(loss) as loss_sha256, formatted_chars
        from joined""",
    "op8_exact_dedup": f"""
        with hashed as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
        select doc_id,
               max(doc_id) over (partition by text_sha256) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = max(doc_id) over (partition by text_sha256) as kept,
               text_sha256
        from hashed""",
    # The verdict is that of the base rules: at the oracle's scale (some 330 good documents in all) no
    # stratum has the evidence that a cutoff needs. Cutoffs have tests of their own.
    "op3_quality_rules": f"""
        with split as materialized (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
        places as (select doc_id, words, unnest(generate_series(1, len(words) - 7)) as i from split where len(words) >= 8),
        windows as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i:i + 7], ' ')) as times from places),
        covered as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from windows where times > 1),
        repeats as (select doc_id, sum(least(8, i - coalesce(before, -8))) as n from covered group by 1),
        lines as (
            select doc_id, count(*) - count(distinct line) as n
            from (select doc_id, unnest(string_split(text, chr(10))) as line from split)
            where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
        counts as (
            select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
                   cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
                   cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(repeats.n, 0) as bigint) as n_repeat_words
            from split left join lines using (doc_id) left join repeats using (doc_id))
        select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not base_failed as kept,
               case when base_failed then 'base' end as rejected_by
        from counts""",
    # Hexadecimal digits stand for bytes: a window of 200 bytes is 400 of them.
    "op4_suffix_array_dedup": """
        with texts as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
        windows as (select doc_id, i, md5_number(x[2 * i + 1:2 * i + 400]) as w
                    from (select doc_id, x, unnest(generate_series(0, length(x) // 2 - 200)) as i from texts where length(x) >= 400)),
        again as (select doc_id, i from (select doc_id, i, count(*) over (partition by w) as times from windows) where times > 1),
        starts as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as fresh from again),
        numbered as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from starts),
        runs as (select doc_id, run, min(i) as lo, max(i) + 200 as hi from numbered group by 1, 2),
        kept as (select doc_id, lag(hi, 1, 0) over (partition by doc_id order by lo) as a, lo as b from runs
                 union all select doc_id, max(hi), 1000000000 from runs group by 1),
        pieces as (select doc_id, string_agg(x[2 * a + 1:2 * b], '' order by a) as x from kept join texts using (doc_id) group by 1),
        removed as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from runs group by 1)
        select doc_id, cast(length(texts.x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
               coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(pieces.x, texts.x))) as kept_sha256
        from texts left join pieces using (doc_id) left join removed using (doc_id)""",
    "op7_minhash_near_dedup": f"""
        with recursive split as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
        sets as materialized (
            select doc_id, case when len(words) >= 2 then list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))])
                                when len(words) = 1 then words else [] end as shingles
            from split),
        terms as materialized (select doc_id, unnest(shingles) as shingle from sets),
        common as (
            select x.doc_id as a, y.doc_id as b, count(*) as shared from terms x join terms y on x.shingle = y.shingle and x.doc_id < y.doc_id
            group by 1, 2),
        links as materialized (
            select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b
            where 100 * shared >= 80 * (len(x.shingles) + len(y.shingles) - shared)),
        edges as materialized (select a, b from links union all select b, a from links),
        reach as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
        smallest as (select a as doc_id, min(b) as least_id from reach group by 1)
        select doc_id, cast(len(shingles) as bigint) as n_shingles, least(doc_id, coalesce(least_id, doc_id)) as component_id,
               doc_id = least(doc_id, coalesce(least_id, doc_id)) as kept
        from sets left join smallest using (doc_id)""",
}
