"""SQL of the queries that a second engine can state over whole tables: plain definitions, without the operators' candidate search."""

from __future__ import annotations

from ..plans.sql import WS, nfc
from .lookalike import ARABIC_LETTER, INVISIBLE, LINE_ENDS, SAME_SEQUENCE, SAME_SHAPE, SPACES, EMOJI, compatibility_forms


def words(x: str) -> str:
    """Words as problems 1, 3 and 5 count them."""
    lowered = f"translate(lower({nfc(x)}), '०१२३४५६७८९', '0123456789')"
    spaced = rf"regexp_replace({lowered}, '[\p{{P}}\p{{S}}\p{{Z}}\t-\r\x{{1c}}-\x{{1f}}\x{{85}}]', ' ', 'g')"
    single = rf"regexp_replace({spaced}, '([\x{{3400}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}])', ' \1 ', 'g')"
    return f"list_filter(string_split({single}, ' '), lambda w: w <> '')"


_NEAR = f"""t AS MATERIALIZED (SELECT row_id, id, split, text, summary, {words('text')} AS w FROM processed),
g AS MATERIALIZED (SELECT DISTINCT row_id, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS run FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS MATERIALIZED (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
c AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS m FROM g a JOIN g b ON a.run = b.run AND a.row_id < b.row_id GROUP BY ALL),
near AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.row_id = c.a JOIN n y ON y.row_id = c.b WHERE m / (x.n + y.n - m) >= 0.6
UNION SELECT a.row_id, b.row_id FROM t a JOIN t b ON a.text = b.text AND a.row_id < b.row_id)"""

P1_FOUND = f"WITH {_NEAR} SELECT a AS row_id_a, b AS row_id_b FROM near"

P5_FOUND = f"""WITH {_NEAR}, s AS MATERIALIZED (SELECT row_id, split, regexp_extract(id, '-0*([0-9]+)$', 1) AS number, {words("coalesce(summary, '')")} AS said FROM t),
p AS (SELECT a, b FROM near UNION SELECT a.row_id, b.row_id FROM s a JOIN s b ON a.number = b.number AND a.number <> '' AND a.row_id < b.row_id
UNION SELECT a.row_id, b.row_id FROM s a JOIN s b ON a.said = b.said AND len(a.said) >= 8 AND a.row_id < b.row_id)
SELECT a AS row_id_a, b AS row_id_b FROM p JOIN t x ON x.row_id = a JOIN t y ON y.row_id = b WHERE (x.split = 'train') <> (y.split = 'train')"""

P5_COUNTS = f"""WITH f AS ({P5_FOUND}) SELECT y.split, y.source, count(DISTINCT y.row_id) AS eval_rows, count(DISTINCT x.row_id) AS train_rows, count(*) AS pairs
FROM f JOIN processed x ON x.row_id IN (f.row_id_a, f.row_id_b) AND x.split = 'train' JOIN processed y ON y.row_id IN (f.row_id_a, f.row_id_b) AND y.split <> 'train' GROUP BY y.split, y.source"""

P1_GROUPS = f"""WITH RECURSIVE {_NEAR}, k AS MATERIALIZED (SELECT text, min(row_id) AS class_id, count(*) AS n_copies FROM t WHERE text IS NOT NULL GROUP BY text),
o AS MATERIALIZED (SELECT t.row_id, k.class_id, k.n_copies FROM t JOIN k ON k.text = t.text),
l AS MATERIALIZED (SELECT DISTINCT x.class_id AS u, y.class_id AS v FROM (SELECT a, b FROM near UNION SELECT b, a FROM near) p JOIN o x ON x.row_id = p.a JOIN o y ON y.row_id = p.b WHERE x.class_id <> y.class_id),
reach AS (SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON l.u = reach.v), lowest AS (SELECT u, min(v) AS v FROM reach GROUP BY u), degree AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT o.row_id, o.class_id, o.n_copies, coalesce(d.n, 0) AS n_links, least(o.class_id, coalesce(m.v, o.class_id)) AS group_id FROM o LEFT JOIN degree d ON d.u = o.class_id LEFT JOIN lowest m ON m.u = o.class_id"""

P2_COUNTS = rf"""WITH t AS (SELECT row_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM processed),
l AS (SELECT row_id, regexp_replace(text, '[{WS}]+', '', 'g') AS bare, w, list_filter(string_split(regexp_replace(text, '\r\n|[\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[{WS}]+', '', 'g') <> '') AS lines, known FROM t, (SELECT list(DISTINCT word) AS known FROM common_words) k)
SELECT row_id, len(w) AS word_count, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1), 6) AS mean_word_length,
round(length(regexp_replace(bare, '[^\p{{P}}\p{{S}}\p{{C}}]', '', 'g')) / greatest(length(bare), 1), 6) AS symbol_ratio,
round(len(list_filter(lines, lambda x: regexp_matches(x, '[\p{{P}}\p{{S}}][{WS}]*$'))) / greatest(len(lines), 1), 6) AS punctuated_lines,
round(len(list_filter(w, lambda x: list_contains(known, x))) / greatest(len(w), 1), 6) AS common_share FROM l"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _skeleton(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '{LINE_ENDS}', chr(10), 'g'), '\\x{{FE0F}}', '', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '({EMOJI})\\x{{200D}}({EMOJI})', '\\1' || chr(57344) || '\\2', 'g')"
    x = f"replace(regexp_replace(regexp_replace({x}, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g'), chr(57344), chr(8205))"
    single = {c: u for c, u in compatibility_forms().items() if len(u) == 1}
    x = f"translate({x}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    # joined forms that the tables here can hold: Latin ligatures and the Arabic lam-alefs
    for c, u in compatibility_forms().items():
        if len(u) > 1 and (ord(c) <= 0xFB06 or ord(c) >= 0xFEF5):
            x = f"replace({x}, {_quoted(c)}, {_quoted(u)})"
    x = f"nfc_normalize({x})"
    for sequence, letter in SAME_SEQUENCE.items():
        x = f"replace({x}, {_quoted(sequence)}, {_quoted(letter)})"
    x = f"regexp_replace(regexp_replace({x}, 'ي({ARABIC_LETTER})', 'ی\\1', 'g'), 'ي({ARABIC_LETTER})', 'ی\\1', 'g')"
    return f"translate({x}, {_quoted(''.join(SAME_SHAPE))}, {_quoted(''.join(SAME_SHAPE.values()))})"


P8_FOUND = f"""WITH s AS MATERIALIZED (SELECT doc_id, text, {_skeleton('text')} AS s FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.s, '[^\\s]')"""
