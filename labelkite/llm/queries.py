"""The registered queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

from labelkite.llm import alignment, chunk_dedup, html_text, line_rules, ordinal, packing, periodic, phrase_index, piece_sampling, simhash, sketch, token_file, warc

QUERIES = {
    "op1_best_two_fit": packing.op1_best_two_fit,
    "op2_chunk_dedup": chunk_dedup.op2_chunk_dedup,
    "op3_token_blocks": token_file.op3_token_blocks,
    "op4_sketches": sketch.op4_sketches,
    "op9_main_text": html_text.op9_main_text,
    "op10_simhash_anchors": simhash.op10_simhash_anchors,
    "op5_warc": warc.op5_warc,
    "op6_piece_sampling": piece_sampling.op6_piece_sampling,
    "op7_ordinal_quality": ordinal.op7_ordinal_quality,
    "op8_line_rules": line_rules.op8_line_rules,
    "op11_phrase_index": phrase_index.op11_phrase_index,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_token_alignment": alignment.op13_token_alignment,
}

#: The rules of ``line_rules`` over each line, and the base measures over each text.
_LINE_RULES = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts),
triples AS (SELECT doc_id, i, x, lead(x, 1) OVER t AS y, lead(x, 2) OVER t AS z FROM words WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM triples WHERE z IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) t(d) WHERE n > 1 GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
counted AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
shorts AS (SELECT *, regexp_matches(line, 'OPEN_END') AND n BETWEEN 1 AND MENU_WORDS AS short FROM counted),
runs AS (SELECT *, sum((n > 0 AND NOT short)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM shorts),
judged AS (SELECT doc_id, line, n,
                  length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols, len(regexp_extract_all(line, '!{2,}')) AS shouts,
                  length(regexp_replace(line, '[^|»›·•]+', '', 'g')) AS bars, length(regexp_replace(line, '[^A-Za-z]+', '', 'g')) AS letters,
                  length(regexp_replace(line, '[^A-Z]+', '', 'g')) AS capitals, length(lower(line)) - length(regexp_replace(lower(line), 'PHRASES', '', 'g')) AS phrases,
                  regexp_matches(line, 'OPEN_END') AND n <= FRAGMENT_WORDS AS fragment,
                  count(*) FILTER (short) OVER (PARTITION BY doc_id, run) >= RUN AND short AS menu FROM runs),
by_text AS (SELECT doc_id, count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
                   sum(n) FILTER (NOT (regexp_matches(line, '[#*$%&|<>»›·•]|!!') AND NOT (symbols * 4 <= n AND shouts * 5 <= n AND bars < 3))
                                  AND NOT (regexp_matches(line, '[A-Z]{3}') AND letters >= 20 AND capitals * 2 > letters)
                                  AND NOT (phrases > 0 AND phrases * PHRASE_SHARE >= length(lower(line))) AND NOT fragment AND NOT menu) AS good_words
            FROM judged GROUP BY 1),
base AS (SELECT t.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(good_words, 0) AS good_words
         FROM texts t JOIN by_text b ON t.doc_id = b.doc_id LEFT JOIN repeats r ON t.doc_id = r.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 - good_words::DOUBLE / greatest(n_words, 1) <= 0.3::DOUBLE AS kept
FROM base"""
_FIXED = {n: str(getattr(line_rules, n)) for n in ("OPEN_END", "MENU_WORDS", "FRAGMENT_WORDS", "PHRASE_SHARE", "RUN")}
for _name, _value in [("PHRASES", "|".join(line_rules.BOILERPLATE)), *_FIXED.items()]:
    _LINE_RULES = _LINE_RULES.replace(_name, _value)

ORACLES: dict[str, str] = {"op8_line_rules": _LINE_RULES}

#: The windows of the benchmark in each document, by all windows of all documents; proximity by the places of the rarest word.
_PHRASES = r"""
WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'WORD') AS w FROM documents),
bench AS (SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), 'WORD') AS w FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, w, unnest(range(greatest(len(w) - WINDOW, 0) + 1)) AS i FROM bench WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + WINDOW) AS words FROM starts),
phrases AS (SELECT DISTINCT words, len(words) AS size FROM windows),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM phrases),
places AS (SELECT doc, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at FROM texts),
held AS (SELECT p.* FROM places p SEMI JOIN vocabulary v ON p.word = v.word),
counts AS (SELECT word, count(*) AS n FROM held GROUP BY 1),
spread AS (SELECT words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM phrases),
rarest AS (SELECT words, arg_min(s.word, (n, s.word, place)) AS word, arg_min(place, (n, s.word, place)) AS place, len(words) AS size
           FROM spread s JOIN counts c ON s.word = c.word GROUP BY words HAVING count(*) = len(words)),
candidates AS (SELECT h.doc, h.at, r.words, r.size, h.at - r.place AS start, list_slice(t.w, greatest(h.at - REACH, 0) + 1, h.at + REACH + 1) AS around, t.w
               FROM held h JOIN rarest r ON h.word = r.word JOIN texts t ON h.doc = t.doc),
judged AS (SELECT doc, words, size, start, start >= 0 AND list_slice(w, start + 1, start + size) = words AS exact FROM candidates WHERE list_has_all(around, words)),
near AS (SELECT doc, count(DISTINCT words) AS n_near FROM judged GROUP BY 1),
hits AS (SELECT doc, count(DISTINCT p) AS n_hit FROM (SELECT doc, unnest(range(start, start + size)) AS p FROM judged WHERE exact) GROUP BY 1),
found AS (SELECT DISTINCT doc, item_id FROM judged j JOIN windows w ON j.words = w.words WHERE exact),
items AS (SELECT doc, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM texts t LEFT JOIN near n ON t.doc = n.doc LEFT JOIN hits h ON t.doc = h.doc LEFT JOIN items i ON t.doc = i.doc"""
for _name, _value in {
    "UPPER": phrase_index.UPPER,
    "LOWER": phrase_index.LOWER,
    "WORD": phrase_index.SPLIT.replace("[", "[^", 1),
    "WINDOW": str(phrase_index.WINDOW),
    "REACH": str(phrase_index.WINDOW - 1 + phrase_index.SLOP),
}.items():
    _PHRASES = _PHRASES.replace(_name, _value)
ORACLES["op11_phrase_index"] = _PHRASES
