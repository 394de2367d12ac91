"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, rules

_WORD = r"[^\x20\x09-\x0D]"
_CONTROL = chat._CONTROL

CHATS = rf"""
WITH said AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS probe(conv_id, turn, role, text)
), plain AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said
), escaped AS (
    SELECT *, regexp_replace(role, '([\[<])(~*){_CONTROL}', '\1~\2\3', 'g') AS role_e, regexp_replace(text, '([\[<])(~*){_CONTROL}', '\1~\2\3', 'g') AS text_e FROM plain
), placed AS (
    SELECT *, row_number() OVER w AS nth, lag(role_e) OVER w IS DISTINCT FROM role_e AS opens FROM escaped
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role_e, text_e)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(text_e)) + sum(CASE WHEN opens THEN {len(chat.ROLE) + len(chat.TEXT) + len(chat.END)} + length(role_e) ELSE {len(chat.NEXT)} END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

LEAKS = rf"""
WITH texts AS (
    SELECT 'item' AS kind, item_id AS id, row_number() OVER () AS row, coalesce(text, '') AS text FROM benchmark
    UNION ALL SELECT 'doc', doc_id, row_number() OVER (), coalesce(text, '') FROM documents
), split AS (
    SELECT kind, id, row, list_filter(list_transform(regexp_extract_all(text, '{_WORD}+'), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda w: w <> '') AS words FROM texts
), wide AS (
    SELECT item.row, item.id AS item_id, least({decontaminate.WIDTH}, len(words)) AS width, words FROM split AS item WHERE kind = 'item' AND len(words) > 0
), grams AS (
    SELECT DISTINCT row, item_id, width, list_slice(words, i, i + width - 1) AS gram FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM wide)
), sized AS (
    SELECT row, count(*) AS n_item FROM grams GROUP BY row
), widths AS (
    SELECT DISTINCT width FROM wide
), held AS (
    SELECT DISTINCT row, id AS doc_id, width, list_slice(words, i, i + width - 1) AS gram
    FROM (SELECT row, id, width, words, unnest(range(1, len(words) - width + 2)) AS i FROM split, widths WHERE kind = 'doc' AND len(words) >= width)
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM held JOIN grams USING (width, gram) JOIN sized ON sized.row = grams.row
GROUP BY held.row, doc_id, grams.row, item_id, n_item HAVING 100 * count(*) >= {round(100 * decontaminate.LEAST)} * n_item
"""

_MASK = rules.POLICIES["v1"] | rules.BASE

RULES = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT row, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts
), windows AS (
    SELECT row, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), twice AS (
    SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, a, b, c) > 1
), repeated AS (
    SELECT row, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY row
), counted AS (
    SELECT doc_id, len(words) AS n_words, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(replace(text, '!', '')) AS n_exclaim,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
        coalesce(n, 0) AS n_repeat_words
    FROM split LEFT JOIN repeated USING (row)
), judged AS (
    SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {rules.BITS[name]} ELSE 0 END" for name, rule in rules.RULES)} AS failed FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    (failed & {rules.BASE}) <> 0 AS base_failed, (failed & {_MASK}) = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM judged
"""

SQL = {"op1_chat_formatting": CHATS, "op4_decontamination": LEAKS, "op10_quality_rules": RULES}
