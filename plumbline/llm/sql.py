"""The queries that SQL can express, as DuckDB SQL.  They compute the same rows by plain set operations."""

from __future__ import annotations

from plumbline.llm.decontamination import MIN_SHARE, WIDTH
from plumbline.llm.fill_middle import SEED
from plumbline.llm.quality_rules import DELTA, QUANTILES, RATES, RISK

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
WITH items AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_ASCII_LOWER.format('text')}, '{_ALNUM}') AS w
    FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
    SELECT DISTINCT item, least(len(w), {WIDTH}) AS n, w[i : i + least(len(w), {WIDTH}) - 1] AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w
    FROM documents
), lengths AS (
    SELECT DISTINCT n FROM item_windows
), hits AS (
    SELECT r, i, x.n, item
    FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n
    ) x JOIN item_windows t ON t.n = x.n AND t.win = x.w[i : i + x.n - 1]
), marked AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), named AS (
    SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {MIN_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""

_RATES = ", ".join(
    f"CASE WHEN {b} > 0 THEN ({s} * {a} + {b} - 1) // {b} ELSE 0 END AS {name}" for name, (a, b, s) in RATES.items()
)
_LONG = " UNION ALL ".join(f"SELECT lang, half, '{r}' AS rate, {r} AS value FROM good" for r in RATES)
_CUTS = " UNION ".join(
    f"SELECT lang, rate, min(value) AS cutoff FROM filled WHERE 1000 * below >= {q} * whole GROUP BY lang, rate"
    for q in QUANTILES
)
_WITHIN = " AND ".join(f"({r} <= coalesce(max_{r}, {r}))" for r in RATES)

_PART = RISK / len(RATES)
QUALITY_RULES = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, w[i : i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), twice AS (
    SELECT r, unnest(places) AS i FROM (SELECT r, list(i) AS places FROM windows GROUP BY r, win HAVING count(*) > 1)
), covered AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY r
), counted AS (
    SELECT r, doc_id, lang, md5(t) AS digest, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS chars,
           CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_repeat_words
    FROM docs LEFT JOIN covered USING (r)
), judged AS (
    SELECT *, coalesce(chars, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM counted
), rated AS (
    SELECT *, {_RATES} FROM judged
), good AS (
    SELECT DISTINCT lang, digest, CASE WHEN digest[1] < '8' THEN 0 ELSE 1 END AS half, {', '.join(RATES)}
    FROM rated JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed
), long AS ({_LONG}),
by_value AS (SELECT lang, half, rate, value, count(*) AS n FROM long GROUP BY ALL),
filled AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, rate ORDER BY value) AS below, sum(n) OVER (PARTITION BY lang, rate) AS whole
    FROM by_value WHERE half = 0
), candidates AS ({_CUTS}),
tested AS (
    SELECT c.lang, c.rate, cutoff, CAST(sum(CASE WHEN value > cutoff THEN n ELSE 0 END) AS BIGINT) AS k,
           CAST(sum(n) AS BIGINT) AS n
    FROM candidates c JOIN by_value v ON c.lang IS NOT DISTINCT FROM v.lang AND c.rate = v.rate AND half = 1
    GROUP BY ALL
), proven AS (
    SELECT lang, rate, min(cutoff) AS cutoff FROM tested
    WHERE k < n * {_PART} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(
        lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_PART}) + (n - j) * ln(1 - {_PART})
    ))) <= {DELTA} / (SELECT count(*) FROM candidates)
    GROUP BY lang, rate
), limits AS (
    SELECT lang AS l, {', '.join(f"min(cutoff) FILTER (WHERE rate = '{r}') AS max_{r}" for r in RATES)}
    FROM proven GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_WITHIN} AS kept
FROM rated LEFT JOIN limits ON lang IS NOT DISTINCT FROM l
"""

# Rebuilt from the output alone: the parts between the markers, in the order of the text.
_AT = "strpos(output, '{0}')"
_REBUILT = {
    "psm": f"substr(output, 4, {_AT.format('<S>')} - 4) || substr(output, {_AT.format('<M>')} + 3)"
           f" || substr(output, {_AT.format('<S>')} + 3, {_AT.format('<M>')} - {_AT.format('<S>')} - 3)",
    "spm": f"substr(output, {_AT.format('<P>')} + 3, {_AT.format('<M>')} - {_AT.format('<P>')} - 3)"
           f" || substr(output, {_AT.format('<M>')} + 3) || substr(output, 4, {_AT.format('<P>')} - 4)",
}
_DRAW = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"

FILL_MIDDLE = f"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
    FROM documents
), drawn AS (
    SELECT *, len(units) AS n, {_DRAW.format(1)} % (len(units) + 1) AS u, {_DRAW.format(9)} % (len(units) + 1) AS v,
           CASE WHEN len(units) = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                WHEN {_DRAW.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM docs
), cuts AS (
    SELECT *, array_to_string(units[1 : least(u, v)], '') AS a, array_to_string(units[least(u, v) + 1 : greatest(u, v)], '') AS b,
           array_to_string(units[greatest(u, v) + 1 :], '') AS c
    FROM drawn
), made AS (
    SELECT *, CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE t END AS output
    FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'psm' THEN {_REBUILT['psm']} WHEN 'spm' THEN {_REBUILT['spm']} ELSE output END) AS restored_sha256
FROM made
"""

SQL: dict[str, str] = {
    "op8_decontaminate": DECONTAMINATE, "op9_quality_rules": QUALITY_RULES, "op13_fill_middle": FILL_MIDDLE,
}
