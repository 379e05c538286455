"""The subpackage's queries and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, media, minhash, packing, spelling, warc
from .attention_lm import op4_attention_lm
from .bpe import op7_byte_bpe
from .collocations import op12_collocations
from .decontamination import op13_decontamination
from .line_crf import op3_line_crf
from .line_dedup import BLOCK, HIDDEN, TAG, op6_line_dedup
from .media import op2_media_sniffing
from .minhash import op1_minhash_dedup
from .packing import op8_length_packing
from .quality_rules import RULES, mask, op10_quality_rules
from .sharding import op5_external_shuffle
from .spelling import op11_spelling_variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_media_sniffing": op2_media_sniffing,
        "op3_line_crf": op3_line_crf,
        "op4_attention_lm": op4_attention_lm,
        "op5_external_shuffle": op5_external_shuffle,
        "op6_line_dedup": op6_line_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_length_packing": op8_length_packing,
        "op9_warc": warc.op9_warc,
        "op10_quality_rules": op10_quality_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_collocations": op12_collocations,
        "op13_decontamination": op13_decontamination,
    }


RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, u.i, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM twice, (VALUES (0), (1), (2)) AS k(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS BIGINT) AS n_letter_words,
    CAST(len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_capital_words,
    CAST(len(list_filter(w, lambda x: suffix(x, '!!') OR suffix(x, '??'))) AS BIGINT) AS n_shouts
    FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)} AS BIGINT) AS failed_bits FROM m)
SELECT *, 'v2' AS policy, failed_bits & {mask("base")} <> 0 AS base_failed, failed_bits & {mask("v2")} = 0 AS kept FROM f
"""

LINES_SQL = f"""
WITH p AS (SELECT page_id,
    lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), '\\n[ \\t\\r\\n]*', chr(10), 'g') AS text
    FROM pages),
l AS (SELECT page_id, host, u.i, u.line, trim(u.line, ' ' || chr(9) || chr(13)) AS bare
    FROM (SELECT page_id, host, string_split(text, chr(10)) AS a FROM p WHERE text IS NOT NULL), LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i) u),
n AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host HAVING count(*) >= 5),
c AS (SELECT host, bare, count(DISTINCT page_id) AS c FROM l WHERE bare <> '' GROUP BY host, bare),
b AS (SELECT c.host, c.bare FROM c JOIN n ON c.host = n.host WHERE c > 0.2::DOUBLE * pages),
k AS (SELECT l.page_id, count(*) AS n_lines, count(b.bare) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE b.bare IS NULL), '') AS text
    FROM l LEFT JOIN b ON l.host = b.host AND l.bare = b.bare GROUP BY l.page_id)
SELECT p.page_id, p.host, k.text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM p LEFT JOIN k ON p.page_id = k.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": minhash.ORACLE_SQL, "op2_media_sniffing": media.ORACLE_SQL, "op8_length_packing": packing.ORACLE_SQL, "op6_line_dedup": LINES_SQL, "op9_warc": warc.ORACLE_SQL, "op10_quality_rules": RULES_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_collocations": collocations.ORACLE_SQL, "op13_decontamination": decontamination.ORACLE_SQL}
