"""DuckDB SQL with the rows of those registered queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') g FROM w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) t(i)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a doc_id, min(b) component_id FROM r GROUP BY 1) c USING (doc_id)"""


def quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
    failed = []
    for r in RULES:
        over, _, under = r.ratio.partition(" / ")
        value = f"coalesce(({over}) / nullif({under or 1}, 0)::DOUBLE, 0)"
        bad = [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
        failed.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    failed = [x.replace("cast(n_words as double)", "n_words") for x in failed]
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') t FROM documents), a AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') g FROM a, unnest(generate_series(1, len(w) - 2)) u(i)),
q AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), o AS (SELECT doc_id, count(DISTINCT i + k) n FROM q, unnest([0, 1, 2]) u(k) GROUP BY 1),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(o.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words FROM a LEFT JOIN o USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {', '.join(failed)}) AS failed_rules FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j"""


# A digest's 160 bits are four numbers of eight base-32 digits.
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), f AS (SELECT h, min(page_id) first FROM p GROUP BY 1), d AS (SELECT page_id, h, first, sha1(h) x FROM p JOIN f USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(x, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

ORACLE_SQL = {"op2_jaccard_join": JACCARD, "op3_quality_rules": quality(), "op8_warc_zip": WARC}
