"""The registered queries once more as DuckDB SQL over the same tables, for checking results.

Written independently of the Spark expressions where two ways exist: word lists instead of look-around
patterns, enumerated calendars instead of the closed form, windows over whole groups instead of slices.
"""

from __future__ import annotations

from collections.abc import Iterable

from plumbline import config as c
from plumbline.sources import tables as t

SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = f"[^{SPACE}]+"
TOKEN = r"[\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values: Iterable[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def numbers(values: Iterable[float]) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def r(expr: str) -> str:
    """Six digits, without a negative zero."""
    return f"(round(({expr})::DOUBLE, 6) + 0e0)"


def n(expr: str) -> str:
    return f"({expr})::BIGINT"


def any_of(text: str, terms: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(x)})" for x in terms) + ")"


# --- shared tables ------------------------------------------------------------------------------------

STORIES = f"""
stories AS (
  SELECT doc_id AS id, substr(source, 4)::BIGINT AS idproject, doc_id AS issuekey,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created,
    CASE WHEN NOT contains(lower(text), 'license') THEN {strings(t.TITLES)}[(doc_id % 7 + 1)::INT] END AS title,
    CASE WHEN length(text) >= {t.MIN_TEXT} THEN text || ' ' || {strings(t.PHRASES)}[(doc_id % 24 + 1)::INT] END AS description,
    CASE WHEN NOT contains(text, '%') THEN {numbers(t.POINTS)}[((doc_id + doc_id // 24) % 8 + 1)::INT] END AS storypoints,
    CASE WHEN NOT contains(text, '%')
      THEN {numbers(t.POINTS)}[((doc_id + doc_id // 24) % 8 + 1)::INT] * {numbers(t.ACTUAL_FACTOR)}[(doc_id % 4 + 1)::INT]
      END AS actual_points,
    CASE WHEN NOT contains(lower(text), 'license') THEN 1 + doc_id % 9 END AS days_to_complete,
    doc_id % 4 = 2 AS caused_spillover
  FROM documents)"""

CLEANED = f"""{STORIES},
cleaned AS (
  SELECT id, idproject, title, description, storypoints AS story_points,
    title || ' ' || description AS full_text,
    len(regexp_extract_all(description, {q(WORD)})) AS word_count,
    len(regexp_extract_all(title, {q(WORD)})) AS title_word_count,
    length(description) AS char_count,
    len(regexp_extract_all(description, {q(c.BULLET_PATTERN)})) > 0 AS has_list,
    len(regexp_extract_all(description, {q(c.BULLET_PATTERN)})) AS list_item_count,
    contains(description, '```') AS has_code_block
  FROM stories WHERE storypoints IS NOT NULL AND description IS NOT NULL AND title IS NOT NULL)"""

_TEXT = "lower(full_text)"
_RULES = {
    "lf_high_complexity": ("story_points >= 8", 1),
    "lf_low_complexity_safe": ("story_points <= 2", 0),
    "lf_fibonacci_anomaly": (f"story_points NOT IN ({', '.join(str(p) for p in c.POINT_SCALE)})", 1),
    "lf_missing_acceptance_criteria": (
        "NOT contains(lower(description), 'acceptance criteria') AND list_item_count < 3", 1),
    "lf_dependency_link": (f"regexp_matches({_TEXT}, {q(c.DEPENDENCY_PATTERN)})", 1),
    "lf_very_short_description": ("word_count < 15", 1),
    "lf_very_long_description": ("word_count > 200", 1),
    "lf_bug_fix": (any_of("lower(title)", c.LF_TERMS["lf_bug_fix"]), 0),
    "lf_documentation_story": (any_of(_TEXT, c.LF_TERMS["lf_documentation_story"]), 0),
}


def _vote(name: str) -> str:
    cond, vote = _RULES.get(name) or (any_of(_TEXT, c.LF_TERMS[name]), 1)
    return f"CASE WHEN {cond} THEN {vote} ELSE -1 END AS {name}"


VOTES = f"""{CLEANED},
votes AS (SELECT *, {', '.join(_vote(name) for name in c.LF_NAMES)} FROM cleaned)"""


def _count(vote: int) -> str:
    return " + ".join(f"({name} = {vote})::INT" for name in c.LF_NAMES)


COUNTED = f"{VOTES},\ncounted AS (SELECT *, {_count(0)} AS n_safe, {_count(1)} AS n_risk FROM votes)"
LONG_VOTES = f"""{COUNTED},
long AS ({' UNION ALL '.join(
    f"SELECT id, {j} AS j, '{name}' AS lf, {name} AS vote, n_safe, n_risk FROM counted" for j, name in enumerate(c.LF_NAMES))})"""


def _evidence() -> str:
    return " + ".join(
        f"CASE {name} WHEN 1 THEN ln({a} / (1e0 - {a})) WHEN 0 THEN -ln({a} / (1e0 - {a})) ELSE 0e0 END"
        for name, a in zip(c.LF_NAMES, (f"{x}::DOUBLE" for x in t.LF_ACCURACY))
    )


LABELED = f"""{VOTES},
odds AS (SELECT *, {_evidence()} AS e FROM votes),
labeled AS (
  SELECT *, 1e0 / (1e0 + exp(-e)) AS risk_prob_risk, 1e0 - 1e0 / (1e0 + exp(-e)) AS risk_prob_safe,
    CASE WHEN round(e, 10) > 0 THEN 1 ELSE 0 END AS risk_label_binary,
    CASE WHEN round(e, 10) > 0 THEN 'RISK' ELSE 'SAFE' END AS risk_label,
    greatest(1e0 / (1e0 + exp(-e)), 1e0 - 1e0 / (1e0 + exp(-e))) AS risk_confidence
  FROM odds)"""

CLASSES = f"""{LABELED},
classes AS (
  SELECT * REPLACE (CASE WHEN risk_label = 'SAFE' THEN 'Low'
    WHEN risk_confidence > {c.CLASS_THRESHOLD} THEN 'High' ELSE 'Medium' END AS risk_label)
  FROM labeled)"""


def _weight(k: int, base: str) -> str:
    return f"(1 + {base} % 11 + CASE WHEN y = {k} AND id % 5 <> 0 THEN 12 ELSE 0 END)::DOUBLE"


PREDS = f"""
truth AS (
  SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS y FROM labels),
weights AS (
  SELECT id, y, {_weight(0, "(id * 7)")} AS w0, {_weight(1, "(id * 9)")} AS w1,
    {_weight(2, "(id * 11 + id // 11 * 3)")} AS w2 FROM truth),
preds AS (
  SELECT id, y, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2,
    CASE WHEN id % 9 = 0 THEN 1 - (y > 0)::INT ELSE (y > 0)::INT END AS given,
    w0 / (w0 + w1 + w2) AS pb0, (w1 + w2) / (w0 + w1 + w2) AS pb1
  FROM weights)"""

ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
SCORED = f"{PREDS},\nscored AS (SELECT *, {ARGMAX} AS y_pred FROM preds)"


def _costs(matrix) -> str:
    return ", ".join(
        f"p0 * {row[0]!r}::DOUBLE + p1 * {row[1]!r}::DOUBLE + p2 * {row[2]!r}::DOUBLE AS k{i}" for i, row in enumerate(matrix)
    )


COSTED = f"""{PREDS},
costs AS (SELECT *, {_costs(c.COST_MATRIX)} FROM preds),
costed AS (
  SELECT *, CASE WHEN k0 <= k1 AND k0 <= k2 THEN 0 WHEN k1 <= k2 THEN 1 ELSE 2 END AS y_pred, least(k0, k1, k2) AS chosen
  FROM costs)"""


def _longest(source: str, label: str = "y") -> str:
    return " UNION ALL ".join(
        f"SELECT {k} AS class, p{k} AS score, ({label} = {k})::INT AS positive FROM {source}" for k in range(3)
    )


PER_CLASS = f"{SCORED},\nper_class AS ({_longest('scored')})"
CURVE = f"""{PER_CLASS},
ties AS (SELECT class, score, sum(positive) AS pos, count(*) - sum(positive) AS neg FROM per_class GROUP BY ALL),
curve AS (
  SELECT class, score, pos, neg,
    sum(pos) OVER (PARTITION BY class ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY class ORDER BY score DESC) AS fp,
    sum(pos) OVER (PARTITION BY class) AS n_pos, sum(neg) OVER (PARTITION BY class) AS n_neg
  FROM ties)"""


def report(source: str, by: str = "") -> str:
    """Per-class rows from (y, y_pred)."""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"""SELECT {lead}{k} AS class,
  CASE WHEN count(*) FILTER (y_pred = {k}) = 0 THEN 0e0
    ELSE count(*) FILTER (y = {k} AND y_pred = {k})::DOUBLE / count(*) FILTER (y_pred = {k}) END AS precision,
  CASE WHEN count(*) FILTER (y = {k}) = 0 THEN 0e0
    ELSE count(*) FILTER (y = {k} AND y_pred = {k})::DOUBLE / count(*) FILTER (y = {k}) END AS recall,
  CASE WHEN count(*) FILTER (y = {k}) + count(*) FILTER (y_pred = {k}) = 0 THEN 0e0
    ELSE 2e0 * count(*) FILTER (y = {k} AND y_pred = {k})
      / (count(*) FILTER (y = {k}) + count(*) FILTER (y_pred = {k})) END AS f1,
  count(*) FILTER (y = {k}) AS support FROM {source}{group}"""
        for k in range(3)
    )


# --- symbolic features --------------------------------------------------------------------------------

_PASSIVE = (
    rf"(^|[^a-z])({'|'.join(c.BE_FORMS)})\s+([a-z]+ly\s+)?([a-z]+ed|{'|'.join(c.IRREGULAR_PARTICIPLES)})([^a-z]|$)"
)


def _terms(terms: Iterable[str]) -> str:
    return " + ".join(f"(length(low) - length(replace(low, {q(x)}, '')))::DOUBLE / {len(x)}" for x in terms)


def _is_in(terms: Iterable[str]) -> str:
    return f"len(list_filter(toks, lambda x: x IN ({', '.join(q(x) for x in terms)})))"


_VAGUE = "|".join(x.replace("-", r"\-") for x in c.VAGUE_TERMS)


def features(source: str, keep: str = "id") -> str:
    """CTEs ending in ``feats`` from a table with columns ``keep`` and ``t``."""
    values = {
        "flesch_reading_ease": "CASE WHEN n_sent > 0 AND n_word > 0 THEN 206.835e0 - 1.015e0 * (n_word::DOUBLE / n_sent)"
        " - 84.6e0 * (n_syll::DOUBLE / n_word) ELSE 100e0 END",
        "gunning_fog": "CASE WHEN n_sent > 0 AND n_word > 0 THEN 0.4e0 * (n_word::DOUBLE / n_sent"
        " + 100e0 * (n_hard::DOUBLE / n_word)) ELSE 0e0 END",
        "lexical_density": f"CASE WHEN n_run > 0 THEN (len(toks) - {_is_in(c.FUNCTION_WORDS)})::DOUBLE / n_run ELSE 0e0 END",
        "weak_modal_density": f"{_is_in(c.WEAK_MODALS)}::DOUBLE / greatest(n_sent, 1)",
        "has_vague_quantifiers": f"regexp_matches(low, {q(rf'(^|[^{TOKEN[1:-1]}])({_VAGUE})($|[^{TOKEN[1:-1]}])')})::INT",
        "passive_voice_ratio": f"len(list_filter(sents, lambda x: regexp_matches(x, {q(_PASSIVE)})))::DOUBLE / greatest(n_sent, 1)",
        "satd_count": _terms(c.SATD_TERMS),
        "security_count": _terms(c.SECURITY_TERMS),
        "complexity_count": _terms(c.COMPLEXITY_TERMS),
        "char_count": "length(t)",
        "word_count": "n_run",
        "sentence_count": "n_sent",
        "question_count": "length(t) - length(replace(t, '?', ''))",
        "code_block_count": "((length(t) - length(replace(t, '```', ''))) // 3) // 2",
        "list_item_count": f"len(regexp_extract_all(t, {q(c.BULLET_PATTERN)}))",
    }
    columns = ",\n    ".join(
        f"CASE WHEN NOT regexp_matches(t, {q(WORD)}) THEN 0e0 ELSE ({v})::DOUBLE END AS {k}" for k, v in values.items()
    )
    syllables = f"greatest(len(regexp_extract_all(w, '[{c.VOWELS}]+')), 1)"
    return f"""
f0 AS (SELECT {keep}, coalesce(t, '') AS t, lower(coalesce(t, '')) AS low FROM {source}),
f1 AS (SELECT *, regexp_extract_all(low, '{TOKEN}+') AS toks, regexp_extract_all(low, '\\p{{L}}+') AS words,
    list_filter(string_split_regex(low, '[.!?]+(\\s|$)|\\n+'), lambda x: regexp_matches(x, {q(WORD)})) AS sents,
    len(regexp_extract_all(t, {q(WORD)})) AS n_run FROM f0),
f2 AS (SELECT *, len(sents) AS n_sent, len(words) AS n_word,
    coalesce(list_sum(list_transform(words, lambda w: {syllables})), 0) AS n_syll,
    len(list_filter(words, lambda w: len(regexp_extract_all(w, '[{c.VOWELS}]+')) >= 3)) AS n_hard FROM f1),
feats AS (SELECT {keep},
    {columns}
  FROM f2)"""


FEATS = f"{CLEANED},\nftexts AS (SELECT id, idproject, full_text AS t FROM cleaned),{features('ftexts', 'id, idproject')}"


def _md5(seed: object, key: str = "id") -> str:
    return f"md5('{seed}-' || {key}::VARCHAR)"


PROJECT_SPLIT = f"""
psplit AS (
  SELECT id, idproject, CASE WHEN k::DOUBLE / m <= 0.6e0 THEN 'train' WHEN k::DOUBLE / m <= 0.8e0 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT id, idproject, row_number() OVER (PARTITION BY idproject ORDER BY {_md5(c.SEED)}, id) AS k,
    count(*) OVER (PARTITION BY idproject) AS m FROM cleaned))"""
LABEL_SPLIT = f"""
lsplit AS (
  SELECT id, y, CASE WHEN k <= round(m * 0.2e0) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {_md5(c.SEED)}, id) AS k,
    count(*) OVER (PARTITION BY y) AS m FROM preds))"""
_Z = ", ".join(
    f"(f.{x} - s.m_{x}) / CASE WHEN s.s_{x} > 1e-12 THEN s.s_{x} ELSE 1e0 END AS {x}" for x in c.FEATURE_NAMES
)
SCALED = f"""{FEATS},{PROJECT_SPLIT},
zstats AS (
  SELECT {', '.join(f'avg(f.{x}) AS m_{x}, stddev_pop(f.{x}) AS s_{x}' for x in c.FEATURE_NAMES)}
  FROM feats f JOIN psplit p USING (id) WHERE p.split = 'train'),
scaled AS (SELECT f.id, p.split, {_Z} FROM feats f JOIN psplit p USING (id), zstats s)"""


def _tfidf(source: str, fit_source: str, size: int, min_df: int, max_df: str) -> str:
    """CTEs ending in ``weights2``; sources have (id, terms)."""
    return f"""
fit_terms AS (SELECT id, unnest(terms) AS term FROM {fit_source}),
n_docs AS (SELECT count(*) AS n FROM {fit_source}),
vocab AS (
  SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM fit_terms GROUP BY term
  HAVING count(DISTINCT id) >= {min_df} AND count(DISTINCT id) <= {max_df} * (SELECT n FROM n_docs)
  ORDER BY tf DESC, term LIMIT {size}),
all_terms AS (SELECT id, unnest(terms) AS term FROM {source}),
tf AS (SELECT id, term, count(*) AS k FROM all_terms GROUP BY ALL),
raw AS (SELECT id, term, k * (ln((1e0 + (SELECT n FROM n_docs)) / (1e0 + df)) + 1e0) AS w FROM tf JOIN vocab USING (term)),
weights2 AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM raw)"""


_TERMS = f"regexp_extract_all(lower(full_text), '{TOKEN}{{2,}}')"
TFIDF = f"{CLEANED},\nterms AS (SELECT id, {_TERMS} AS terms FROM cleaned),{_tfidf('terms', 'terms', 1000, 2, '0.8')}"
BIGRAM = f"""{CLEANED},{PREDS},{LABEL_SPLIT},
words1 AS (SELECT c.id, s.split, {_TERMS} AS ws FROM cleaned c LEFT JOIN lsplit s USING (id)),
terms AS (SELECT id, split, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS terms FROM words1),
train_terms AS (SELECT id, terms FROM terms WHERE split = 'train'),{_tfidf('terms', 'train_terms', 1000, 1, '1.0')}"""

# --- confident learning -------------------------------------------------------------------------------

NOISE = f"""{PREDS},
th AS (SELECT avg(pb0) FILTER (given = 0) AS t0, avg(pb1) FILTER (given = 1) AS t1 FROM preds),
conf AS (
  SELECT p.*, CASE WHEN pb0 >= t0 - 1e-6 AND pb1 >= t1 - 1e-6 THEN (pb1 > pb0)::INT
    WHEN pb0 >= t0 - 1e-6 THEN 0 WHEN pb1 >= t1 - 1e-6 THEN 1 END AS est FROM preds p, th),
cj AS (
  SELECT count(*) FILTER (given = 0 AND est = 0) AS c00, count(*) FILTER (given = 0 AND est = 1) AS c01,
    count(*) FILTER (given = 1 AND est = 0) AS c10, count(*) FILTER (given = 1 AND est = 1) AS c11,
    count(*) FILTER (given = 0) AS n0, count(*) FILTER (given = 1) AS n1 FROM conf),
cal AS (
  SELECT *, floor(c01::DOUBLE / (greatest(c00, 1) + c01) * n0 + 0.5e0)::BIGINT AS m01,
    floor(c10::DOUBLE / (greatest(c11, 1) + c10) * n1 + 0.5e0)::BIGINT AS m10 FROM cj),
ranked AS (
  SELECT *, CASE given WHEN 0 THEN pb1 - pb0 ELSE pb0 - pb1 END AS margin,
    row_number() OVER (PARTITION BY given ORDER BY CASE given WHEN 0 THEN pb1 - pb0 ELSE pb0 - pb1 END DESC) AS k FROM preds),
lims AS (
  SELECT max(margin) FILTER (given = 0 AND k = m01) AS l0, max(margin) FILTER (given = 1 AND k = m10) AS l1 FROM ranked, cal),
flagged AS (
  SELECT id, y, given, coalesce(margin >= CASE given WHEN 0 THEN l0 ELSE l1 END, false)
    AND (pb1 > pb0)::INT <> given AS is_issue FROM ranked, lims)"""

# --- explanation --------------------------------------------------------------------------------------

_FF = t.FACTOR_FEATURES


def _phi(k: int, j: int) -> str:
    return f"{t.FACTOR_WEIGHTS[k][j]!r}::DOUBLE * ({_FF[j]} - avg({_FF[j]}) OVER ())"


PHI = f"""{FEATS},
phi AS ({' UNION ALL '.join(
    f"SELECT id, {k} AS class, '{f}' AS feature, {f} AS value, {_phi(k, j)} AS phi FROM feats"
    for k in range(3) for j, f in enumerate(_FF))}),
class_scores AS (SELECT id, class, sum(phi) AS s FROM phi GROUP BY ALL),
chosen AS (SELECT id, arg_max(class, (round(s, 9), -class)) AS predicted FROM class_scores GROUP BY id),
ordered AS (
  SELECT p.id, c.predicted, p.feature, p.value, p.phi, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.phi) DESC, feature) AS rank
  FROM phi p JOIN chosen c ON c.id = p.id AND c.predicted = p.class)"""


def sentence(feature: str, value: str) -> str:
    m = c.FACTOR_MESSAGES

    def numbered(key: str, number: str) -> str:
        before, after = m[key].split("{n}")
        return f"{q(before)} || trunc({number})::BIGINT || {q(after)}"

    rules = [
        ("flesch_reading_ease", "< 30", q(m["flesch_hard"])), ("flesch_reading_ease", "< 50", q(m["flesch_mid"])),
        ("gunning_fog", "> 16", q(m["fog_hard"])), ("gunning_fog", "> 12", q(m["fog_mid"])),
        ("weak_modal_density", "> 0.15e0", numbered("modal", f"{value} * 10")),
        ("has_vague_quantifiers", "> 0.5e0", q(m["vague"])), ("passive_voice_ratio", "> 0.2e0", q(m["passive"])),
        ("satd_count", "> 0", numbered("satd", value)), ("security_count", "> 0", numbered("security", value)),
        ("complexity_count", "> 0", numbered("complexity", value)),
        ("word_count", "> 200", q(m["long"])), ("word_count", "< 20", q(m["short"])),
    ]
    return "CASE " + " ".join(f"WHEN {feature} = '{f}' AND {value} {cond} THEN {out}" for f, cond, out in rules) + " END"


# --- similarity ---------------------------------------------------------------------------------------


def _nearest(k: int, minimum: float) -> str:
    norm = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"
    return f"""
vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
unit AS (SELECT id, list_transform(e, lambda x: x / {norm}) AS e FROM vec),
pairs AS (SELECT a.id AS query_id, b.id AS id, round(list_dot_product(a.e, b.e), 12) AS sim FROM unit a JOIN unit b ON a.id <> b.id),
topk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id DESC) AS rank FROM pairs
  QUALIFY rank <= {k}),
near AS (SELECT * FROM topk WHERE sim >= {minimum})"""


_SIMILAR = f"SELECT query_id, rank, id, {r('sim')} AS similarity FROM near"

# --- health and scope ---------------------------------------------------------------------------------


def _health(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    generic = any_of("lower(coalesce(description, ''))", c.HEALTH_GENERIC)
    return f"""{STORIES},
hrows AS (
  SELECT *, storypoints AS est, coalesce(len(regexp_extract_all(description, {q(WORD)})), 0) AS words, {generic} AS generic
  FROM stories),
hs AS (
  SELECT {lead}count(*) AS story_count,
    least(count(*) / 100e0, 1e0) * 100 AS volume_score,
    100e0 * count(*) FILTER (coalesce(regexp_matches(description, {q(WORD)}), false) AND est > 0 AND actual_points > 0
      AND days_to_complete > 0) / count(*) AS completeness_score,
    100e0 * sum(CASE WHEN words >= 15 THEN 2 WHEN words >= 5 THEN 1 ELSE 0 END
      + CASE WHEN NOT generic OR words > 5 THEN 1 ELSE 0 END) / (3e0 * count(*)) AS quality_score,
    100e0 * (0.3e0 * count(*) FILTER (est IN ({', '.join(str(p) for p in c.HEALTH_SCALE)})) / count(*)
      + 0.3e0 * least((count(DISTINCT est) + (count(*) FILTER (est IS NULL) > 0)::INT) / 5e0, 1e0)
      + 0.4e0 * CASE WHEN count(*) FILTER (est > 0) = 0 THEN 0e0
          ELSE count(*) FILTER (est > 0 AND actual_points / est BETWEEN 0.5 AND 2)::DOUBLE / count(*) FILTER (est > 0) END)
      AS consistency_score
  FROM hrows{group})"""


def _health_report(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    m = c.HEALTH_MESSAGES
    before, after = m["volume"].split("{n}")
    grades = " ".join(f"WHEN o >= {limit} THEN '{g}'" for limit, g in c.HEALTH_GRADES)
    advice = (
        f"concat_ws(' | ', CASE WHEN volume_score < 70 THEN {q(before)} || story_count || {q(after)} END,"
        f" CASE WHEN completeness_score < 80 THEN {q(m['completeness'])} END,"
        f" CASE WHEN quality_score < 70 THEN {q(m['quality'])} END,"
        f" CASE WHEN consistency_score < 70 THEN {q(m['consistency'])} END)"
    )
    names = ("volume", "completeness", "quality", "consistency")
    return f"""WITH {_health(by)},
ho AS (SELECT *, 0.3e0 * volume_score + 0.25e0 * completeness_score + 0.25e0 * quality_score + 0.2e0 * consistency_score AS o,
    {advice} AS adv FROM hs)
SELECT {lead}CASE {grades} ELSE 'F' END AS overall_grade, round(o, 1) AS overall_score,
  {', '.join(f'round({x}_score, 1) AS {x}_score' for x in names)}, story_count,
  CASE WHEN adv = '' THEN {q(m['fine'])} ELSE adv END AS recommendations FROM ho"""


SPRINTS = f"""
sprints AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS end_date, o_custkey % 40 AS cur, 1 + o_orderkey % 13 AS new,
    {numbers(t.VELOCITIES)}[(o_orderkey % 4 + 1)::INT] AS velocity, o_orderpriority AS team FROM orders),
timed AS (SELECT *, greatest(1, ceil(new / velocity))::BIGINT AS days, CASE WHEN cur > 0 THEN new * 100e0 / cur ELSE 0e0 END AS pct
  FROM sprints)"""


def _calendar(days: str) -> str:
    """The ``days``-th working day after end_date, by listing the days."""
    return (
        f"strftime(list_filter(list_transform(range(1, ({days} * 2 + 5)::BIGINT), lambda i: end_date + i::INT),"
        f" lambda d: isodow(d) < 6)[({days})::INT], '%Y-%m-%d')"
    )


# Isotonic regression in its min-max form: at the i-th distinct score, the largest over j <= i of the least over k >= i of
# the mean from j to k.
_ISOTONIC = f"""{PREDS}, long AS (
  SELECT id, y, unnest([0, 1, 2]) AS class, unnest([p0, p1, p2]) AS score FROM preds
), points AS (
  SELECT class, score, avg((y = class)::DOUBLE) AS share, count(*) AS w, row_number() OVER (PARTITION BY class ORDER BY score) AS i
  FROM long GROUP BY class, score
), sums AS (
  SELECT class, i, score, sum(w) OVER u AS w, sum(w * share) OVER u AS s FROM points WINDOW u AS (PARTITION BY class ORDER BY i)
), means AS (
  SELECT b.class, a.i AS j, b.i AS k, (b.s - coalesce(z.s, 0)) / (b.w - coalesce(z.w, 0)) AS m
  FROM sums a JOIN sums b ON a.class = b.class AND a.i <= b.i LEFT JOIN sums z ON z.class = a.class AND z.i = a.i - 1
), least AS (
  SELECT class, j, k, min(m) OVER (PARTITION BY class, j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM means
), fitted AS (
  SELECT class, k AS i, max(m) AS v FROM least GROUP BY class, k
)"""

_CALIBRATED = f"""WITH {_ISOTONIC}, met AS (
  SELECT id, y, long.class, long.score, v FROM long JOIN sums USING (class, score) JOIN fitted USING (class, i)
), wide AS (
  SELECT id, y, {', '.join(f'max(v) FILTER (class = {k}) AS v{k}, max(score) FILTER (class = {k}) AS p{k}' for k in range(3))}
  FROM met GROUP BY id, y
)
SELECT id, {n('y')} AS y, {', '.join(r(f'CASE WHEN v0 + v1 + v2 = 0 THEN p{k} / (p0 + p1 + p2) ELSE v{k} / (v0 + v1 + v2) END') + f' AS p{k}' for k in range(3))}
FROM wide"""

_SM = c.SCOPE_MESSAGES
_SCOPE_BEFORE, _SCOPE_AFTER = _SM["scope"].split("{pct}")
_SCOPE = f"""WITH {SPRINTS}
SELECT id, strftime(end_date, '%Y-%m-%d') AS original_end_date, {_calendar('days')} AS new_end_date, days AS days_added,
  {n('cur')} AS original_points, {n('cur + new')} AS new_points, {n('new')} AS points_added, {r('pct')} AS pct_increase,
  'Adding ' || new || ' story points to the current ' || cur || ' points (' || printf('%.1f', pct)
    || '% increase) will require approximately ' || days || ' additional business day'
    || CASE WHEN days <> 1 THEN 's' ELSE '' END || ' at your team''s velocity of ' || printf('%.1f', velocity)
    || ' points/day.' AS impact_summary,
  concat_ws(' | ', CASE WHEN days > 5 THEN {q(_SM['major'])} WHEN days > 2 THEN {q(_SM['delay'])} END,
    CASE WHEN cur > 0 AND pct > 30 THEN {q(_SCOPE_BEFORE)} || printf('%.0f', pct) || {q(_SCOPE_AFTER)} END,
    CASE WHEN new >= 8 THEN {q(_SM['large'])} END, {q(_SM['document'])}) AS recommendations
FROM timed"""

# --- metric tables ------------------------------------------------------------------------------------

DAILY = """
daily AS (SELECT event_type AS stage, dayofyear(ts) AS step, count(*)::DOUBLE AS cnt, avg(value) AS mean FROM events GROUP BY ALL)"""
LOSSES = """
losses AS (SELECT event_type AS run, dayofyear(ts) AS round, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'val' END AS split,
  avg(value) AS loss FROM events GROUP BY ALL)"""


def _checks(source: str, allowed: Iterable[str]) -> str:
    inside = ", ".join(q(x) for x in allowed)
    return (
        f"count(*) AS n_rows, count(*) FILTER (risk_label IS NULL OR risk_label NOT IN ({inside})) AS n_bad_label,"
        f" count(*) FILTER (risk_confidence IS NULL OR risk_confidence NOT BETWEEN 0 AND 1) AS n_bad_conf FROM {source}"
    )


def _verify(stage: str, source: str, allowed: Iterable[str], missing: str = "") -> str:
    return (
        f"SELECT '{stage}' AS stage, '{missing}' AS missing_columns, *,"
        f" n_bad_label = 0 AND n_bad_conf = 0 AND '{missing}' = '' AS ok FROM (SELECT {_checks(source, allowed)})"
    )


_B, _C3 = c.BINARY_LABELS, c.CLASS_LABELS
_RAW_COLUMNS = [
    "id", "idproject", "issuekey", "created", "title", "description", "storypoints", "actual_points",
    "days_to_complete", "caused_spillover",
]


def _vocab(source: str, label: str, name: str) -> str:
    def outside(allowed):
        return f"count(*) FILTER ({label} IS NULL OR {label} NOT IN ({', '.join(q(x) for x in allowed)}))"

    return (
        f"SELECT CASE WHEN {outside(_B)} = 0 THEN 'binary' WHEN {outside(_C3)} = 0 THEN '3-class' ELSE 'unexpected' END"
        f" AS vocabulary, count(*) AS n_rows, '{name}' AS source FROM {source}"
    )


def _requests() -> str:
    trimmed = r"regexp_replace(coalesce(description, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
    rules = [
        ("description_missing", "description IS NULL"),
        ("description_empty", f"NOT regexp_matches(description, {q(WORD)})"),
        ("description_short", f"length({trimmed}) BETWEEN 1 AND 2"),
        ("points_not_integer", "try_cast(cur AS INT) IS NULL OR try_cast(new AS INT) IS NULL"),
        ("points_out_of_range", "try_cast(cur AS INT) < 0 OR try_cast(new AS INT) < 1"),
        ("velocity_not_number", "try_cast(velocity AS DOUBLE) IS NULL"),
        ("velocity_not_positive", "try_cast(velocity AS DOUBLE) <= 0"),
    ]
    parts = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules)
    return f"""WITH req AS (
  SELECT doc_id AS id, CASE WHEN lang <> 'es' THEN text END AS description,
    CASE WHEN lang = 'fr' THEN 'many' ELSE (doc_id % 40 - 1)::VARCHAR END AS cur, (doc_id % 13)::VARCHAR AS new,
    coalesce(CASE WHEN lang <> 'de' THEN ['0.0', '0.5', '1.0', '2.0'][(doc_id % 4 + 1)::INT] END, '2.0') AS velocity
  FROM documents), chk AS (SELECT id, concat_ws(' | ', {parts}) AS reasons FROM req)
SELECT id, reasons = '' AS accepted, reasons FROM chk"""


_RUN_SEEDS = ", ".join(str(s) for s in c.ABLATION_SEEDS)
_RUNS = f"""{COSTED},
seeded AS (SELECT c.*, s.seed FROM costed c, (SELECT unnest([{_RUN_SEEDS}]) AS seed) s),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed, y ORDER BY md5(seed::VARCHAR || '-' || id::VARCHAR), id) AS k,
  count(*) OVER (PARTITION BY seed, y) AS m FROM seeded),
held AS (SELECT * FROM rk WHERE k <= round(m * 0.2e0)),
runs AS (
  SELECT 'cost' AS config, seed, y, y_pred FROM held UNION ALL
  SELECT 'argmax', seed, y, {ARGMAX} FROM held UNION ALL SELECT 'always_low', seed, y, 0 FROM held),
rep AS ({report('runs', 'config, seed')}),
f1s AS (SELECT config, seed, avg(f1) AS macro_f1 FROM rep GROUP BY ALL)"""

_ECE_BIN = " + ".join(f"(conf >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))
_CURVE_BIN = " + ".join(f"(score > {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))
_CAL_CURVE = f"""{PER_CLASS},
cc AS (SELECT class, {_CURVE_BIN} AS bin, count(*) AS n, avg(positive) AS fraction_positive, avg(score) AS mean_predicted
  FROM per_class GROUP BY ALL)"""
_FACTOR_LINES = f"""{PHI},{PREDS},
said AS (SELECT o.id, o.rank, CASE WHEN phi > 0 THEN '- ↑ ' ELSE '- ↓ ' END || {sentence('feature', 'value')} AS line
  FROM ordered o WHERE rank <= 5 AND abs(phi) >= 0.01e0),
told AS (SELECT id, string_agg(line, chr(10) ORDER BY rank) AS lines FROM said WHERE line IS NOT NULL GROUP BY id)"""
_LEVEL = f"{strings(c.CLASS_LABELS)}[(predicted + 1)::INT]"

_WEAK_METRICS = (
    ["n_rows", "coverage", "mean_votes", "n_conflicting", "pct_conflicting"],
    ["n_safe", "n_risk", "mean", "median", "min", "max", "n_high_confidence"],
)
_OVERALL = """SELECT count(*) AS n_rows, avg((n_safe + n_risk > 0)::INT) AS coverage,
  count(*) FILTER (n_safe + n_risk = 0) AS n_no_vote, avg(n_safe + n_risk) AS mean_votes, min(n_safe + n_risk) AS min_votes,
  max(n_safe + n_risk) AS max_votes, count(*) FILTER (n_safe > 0 AND n_risk > 0) AS n_conflicting,
  100e0 * count(*) FILTER (n_safe > 0 AND n_risk > 0) / count(*) AS pct_conflicting FROM counted"""
_LABEL_STATS = """SELECT count(*) AS n_rows, count(*) FILTER (risk_label = 'SAFE') AS n_safe,
  count(*) FILTER (risk_label = 'RISK') AS n_risk, avg(risk_confidence) AS mean, median(risk_confidence) AS median,
  min(risk_confidence) AS min, max(risk_confidence) AS max, count(*) FILTER (risk_confidence > 0.75) AS n_high_confidence
  FROM labeled"""
_LF_SUMMARY = """SELECT j, lf, concat_ws(',', CASE WHEN bool_or(vote = 0) THEN '0' END, CASE WHEN bool_or(vote = 1) THEN '1' END) AS polarity,
  avg((vote <> -1)::INT) AS coverage, avg((vote <> -1 AND n_safe + n_risk >= 2)::INT) AS "overlaps",
  avg(((vote = 0 AND n_risk > 0) OR (vote = 1 AND n_safe > 0))::INT) AS conflicts, count(*) FILTER (vote <> -1) AS n_votes
  FROM long GROUP BY j, lf"""
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS lf_a, '{b}' AS lf_b, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END AS r FROM votes"
    for i, a in enumerate(c.LF_NAMES)
    for b in c.LF_NAMES[i + 1 :]
)
_ACTIVE = "list_filter([" + ", ".join(
    f"CASE WHEN {name} <> -1 THEN {2 * j} + {name} END" for j, name in enumerate(c.LF_NAMES)
) + "], lambda x: x IS NOT NULL)"


def _story_rows() -> str:
    return f"""SELECT id, description, trunc(story_points)::BIGINT AS estimated_points, trunc(story_points)::BIGINT AS actual_points,
  NULL::BIGINT AS days_to_complete, NULL::BOOLEAN AS caused_spillover, risk_label AS risk_level, NULL::VARCHAR AS epic,
  NULL::VARCHAR AS reporter FROM labeled"""


def _confidence(source: str, threshold: float) -> str:
    return f"WITH {LABELED} SELECT id, risk_label, {r('risk_confidence')} AS risk_confidence FROM {source} WHERE risk_confidence > {threshold}"


def _pairs(values: dict[str, str]) -> str:
    return "unnest([" + ", ".join(f"{{'metric': '{k}', 'value': ({v})::DOUBLE}}" for k, v in values.items()) + "], recursive := true)"


SQL: dict[str, str] = {
    "scan_stories": f"""WITH {STORIES} SELECT * REPLACE (strftime(created, '%Y-%m-%d %H:%M:%S') AS created) FROM stories""",
    "csv_roundtrip": f"WITH {STORIES} SELECT id, idproject, title, description, storypoints FROM stories",
    "high_confidence": _confidence("labeled", 0.75),
    "stage_metrics": f"""WITH {DAILY}, m AS (
  SELECT stage, step, 'count' AS metric, cnt AS value FROM daily UNION ALL SELECT stage, step, 'mean_value', mean FROM daily)
SELECT 'run-1' AS run_id, stage || '/' || metric AS key, step, {r('value')} AS value FROM m""",
    "story_json": f"WITH {LABELED} {_story_rows()}",
    "validate_labels": f"""WITH {LABELED} SELECT n_rows, n_bad_label, {r('lo')} AS min_conf, {r('hi')} AS max_conf, n_bad_conf,
  n_bad_label = 0 AND n_bad_conf = 0 AND n_rows > 0 AS ok
FROM (SELECT min(risk_confidence) AS lo, max(risk_confidence) AS hi, {_checks('labeled', _B)})""",
    "label_vocab": f"""WITH {CLASSES} {_vocab('labeled', 'risk_label', 'weak')} UNION ALL {_vocab('classes', 'risk_label', 'mapped')}
UNION ALL {_vocab('orders', 'o_orderpriority', 'orders')}""",
    "missing_classes": f"""WITH {LABELED}, m AS (SELECT DISTINCT CASE risk_label WHEN 'SAFE' THEN 'Low' WHEN 'RISK' THEN 'High' END AS label FROM labeled)
SELECT label FROM (SELECT unnest({strings(_C3)}) AS label) EXCEPT SELECT label FROM m""",
    "verify_report": f"""WITH {CLASSES}, sure AS (SELECT * FROM labeled WHERE risk_confidence > 0.75)
{_verify('weak_labels', 'labeled', _B)} UNION ALL {_verify('pruned', 'sure', _B)}
UNION ALL {_verify('mapped', 'classes', _C3)} UNION ALL {_verify('unmapped', 'labeled', _C3, 'risk_class')}""",
    "null_profile": f"WITH {STORIES} " + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(*) FILTER ({x} IS NULL) AS n_null, {r(f'100e0 * count(*) FILTER ({x} IS NULL) / count(*)')} AS pct FROM stories"
        for x in _RAW_COLUMNS
    ),
    "dataset_profile": f"""WITH {STORIES} SELECT count(*) AS n_rows, {len(_RAW_COLUMNS)}::BIGINT AS n_columns, min(id) AS sample_id,
  (SELECT title FROM stories ORDER BY id LIMIT 1) AS sample_title FROM stories""",
    "value_counts": f"""WITH {LABELED} SELECT risk_label AS value, count(*) AS n, {r('100e0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM labeled GROUP BY 1""",
    "points_hist": f"""WITH {STORIES} SELECT storypoints AS value, count(*) AS n, {r('100e0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM stories GROUP BY 1""",
    "text_stats": f"WITH {CLEANED} " + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", {r(f'avg({x})')} AS mean, {r(f'median({x})')} AS median, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max FROM cleaned"
        for x in ("word_count", "title_word_count", "char_count")
    ),
    "imbalance": f"""WITH {PREDS}, k AS (SELECT y, count(*) AS n FROM preds GROUP BY y)
SELECT max(n) AS largest, min(n) AS smallest, {r('max(n)::DOUBLE / min(n)')} AS ratio, max(n)::DOUBLE / min(n) > 3 AS imbalanced FROM k""",
    "request_validation": _requests(),
    "preprocess": f"WITH {CLEANED} SELECT * FROM cleaned",
    "dropna_funnel": f"""WITH {STORIES}, k AS (SELECT count(*) AS a, count(storypoints) AS b,
  count(*) FILTER (storypoints IS NOT NULL AND description IS NOT NULL) AS c,
  count(*) FILTER (storypoints IS NOT NULL AND description IS NOT NULL AND title IS NOT NULL) AS d FROM stories)
SELECT 0::BIGINT AS step, 'raw' AS filter, a AS remaining, 0::BIGINT AS removed FROM k UNION ALL
SELECT 1, 'story_points', b, a - b FROM k UNION ALL SELECT 2, 'description', c, b - c FROM k UNION ALL SELECT 3, 'title', d, c - d FROM k""",
    "confidence_filter": _confidence("labeled", 0.5),
    "map_3class": f"WITH {CLASSES} SELECT id, risk_label, {r('risk_confidence')} AS risk_confidence FROM classes",
    "map_simple": f"WITH {LABELED} SELECT id, CASE risk_label WHEN 'SAFE' THEN 'Low' ELSE 'High' END AS risk_label FROM labeled",
    "label_encode": f"""WITH {CLASSES} SELECT id, risk_label, CASE risk_label WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END::BIGINT AS risk_class FROM classes""",
    "sample_n": f"WITH {LABELED} SELECT id, risk_label FROM labeled ORDER BY {_md5(c.SEED)}, id LIMIT 500",
    "stories_by_risk": f"""WITH {LABELED} SELECT id, 'Low' AS level FROM labeled WHERE risk_label = 'SAFE' UNION ALL
SELECT id, 'Medium' FROM labeled WHERE risk_label = 'RISK' UNION ALL SELECT id, 'high' FROM labeled WHERE risk_label = 'RISK'""",
    "story_lookup": f"""WITH {STORIES} SELECT id, idproject, title, description, storypoints FROM stories WHERE id IN (SELECT doc_id FROM labels)""",
    "story_count": "SELECT count(*) AS n FROM documents",
    "to_story": f"WITH {LABELED} {_story_rows()}",
    "estimation_flags": f"""WITH {STORIES} SELECT id, storypoints, actual_points, actual_points > 1.5 * storypoints AS was_underestimated,
  {r('actual_points / storypoints')} AS estimation_accuracy FROM stories""",
    "symbolic_features": f"WITH {FEATS} SELECT id, {', '.join(f'{r(x)} AS {x}' for x in c.FEATURE_NAMES)} FROM feats",
    "lf_votes": f"WITH {VOTES} SELECT id, {', '.join(f'{n(x)} AS {x}' for x in c.LF_NAMES)} FROM votes",
    "list_items_numbered": f"""WITH {STORIES} SELECT id, {n(f"coalesce(len(regexp_extract_all(description, {q(c.NUMBERED_PATTERN)})), 0)")} AS list_items FROM stories""",
    "custom_lf": f"""WITH {CLEANED} SELECT id, CASE WHEN title_word_count >= 4 THEN 1 ELSE -1 END::BIGINT AS lf_long_title,
  CASE WHEN has_list AND word_count < 100 THEN 0 ELSE -1 END::BIGINT AS lf_listed FROM cleaned""",
    "vote_distribution": f"""WITH {LONG_VOTES}, v AS (SELECT unnest([-1, 0, 1]) AS vote)
SELECT v.vote::BIGINT AS vote, count(l.id) AS n, {r('100e0 * count(l.id) / (SELECT count(*) FROM long)')} AS pct
FROM v LEFT JOIN long l ON l.vote = v.vote GROUP BY v.vote""",
    "lf_summary": f"""WITH {LONG_VOTES}, s AS ({_LF_SUMMARY}) SELECT {n('j')} AS j, lf, polarity, {r('coverage')} AS coverage,
  {r('"overlaps"')} AS "overlaps", {r('conflicts')} AS conflicts, n_votes FROM s""",
    "lf_overall": f"""WITH {COUNTED}, o AS ({_OVERALL}) SELECT n_rows, {r('coverage')} AS coverage, n_no_vote, {r('mean_votes')} AS mean_votes,
  {n('min_votes')} AS min_votes, {n('max_votes')} AS max_votes, n_conflicting, {r('pct_conflicting')} AS pct_conflicting FROM o""",
    "lf_correlation": f"WITH {VOTES}, k AS ({_CORR}) SELECT lf_a, lf_b, {r('r')} AS r FROM k",
    "lf_correlation_mean": f"WITH {VOTES}, k AS ({_CORR}) SELECT {r('avg(r)')} AS mean_r, count(r) AS n_pairs FROM k",
    "label_model_moments": f"""WITH {VOTES}, act AS (SELECT id, {_ACTIVE} AS on_ FROM votes),
one AS (SELECT id, unnest(on_) AS a FROM act)
SELECT {n('x.a')} AS a, {n('y.a')} AS b, {r('count(*)::DOUBLE / (SELECT count(*) FROM votes)')} AS value FROM one x JOIN one y USING (id) GROUP BY ALL""",
    "soft_labels": f"WITH {LABELED} SELECT id, {r('risk_prob_safe')} AS risk_prob_safe, {r('risk_prob_risk')} AS risk_prob_risk FROM labeled",
    "probabilistic_labels": f"""WITH {LABELED} SELECT id, {n('risk_label_binary')} AS risk_label_binary, risk_label,
  {r('risk_prob_safe')} AS risk_prob_safe, {r('risk_prob_risk')} AS risk_prob_risk, {r('risk_confidence')} AS risk_confidence FROM labeled""",
    "label_stats": f"""WITH {LABELED}, s AS ({_LABEL_STATS}) SELECT n_rows, n_safe, n_risk, {r('mean')} AS mean, {r('median')} AS median,
  {r('min')} AS min, {r('max')} AS max, n_high_confidence FROM s""",
    "weak_label_metrics": f"""WITH {LONG_VOTES}, {LABELED.split(VOTES + ',')[1]},
o AS ({_OVERALL}), s AS ({_LABEL_STATS}), m AS (
  SELECT 'lf_coverage/' || lf AS metric, coverage AS value FROM ({_LF_SUMMARY})
  UNION ALL SELECT {_pairs({k: k for k in _WEAK_METRICS[0]})} FROM o UNION ALL SELECT {_pairs({k: k for k in _WEAK_METRICS[1]})} FROM s)
SELECT 'weak_labels' AS stage, metric, {r('value')} AS value FROM m""",
    "tfidf_vectors": f"WITH {TFIDF} SELECT id, term, {r('tfidf')} AS tfidf FROM weights2",
    "tfidf_stats": f"""WITH {TFIDF}, k AS (SELECT (SELECT n FROM n_docs) AS n_rows, (SELECT count(*) FROM vocab) AS n_terms, count(*) AS nnz FROM weights2)
SELECT n_rows, n_terms, nnz, {r('1e0 - nnz::DOUBLE / (n_rows * n_terms)')} AS sparsity FROM k""",
    "folds": f"""WITH {PREDS} SELECT id, {n('given')} AS given, ntile(5) OVER (PARTITION BY given ORDER BY id) - 1 AS fold FROM preds""",
    "prob_stats": f"WITH {PREDS} " + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", {r(f'avg({x})')} AS mean, {r(f'stddev_pop({x})')} AS std FROM preds" for x in ("pb0", "pb1")
    ),
    "cl_thresholds": f"""WITH {PREDS} SELECT {n('given')} AS class, {r('avg(CASE given WHEN 0 THEN pb0 ELSE pb1 END)')} AS threshold, count(*) AS n FROM preds GROUP BY given""",
    "confident_joint": f"""WITH {NOISE} SELECT 0::BIGINT AS given, 0::BIGINT AS estimated, c00 AS raw, n0 - m01 AS calibrated, {r('(n0 - m01)::DOUBLE / (n0 + n1)')} AS share FROM cal
UNION ALL SELECT 0, 1, c01, m01, {r('m01::DOUBLE / (n0 + n1)')} FROM cal UNION ALL SELECT 1, 0, c10, m10, {r('m10::DOUBLE / (n0 + n1)')} FROM cal
UNION ALL SELECT 1, 1, c11, n1 - m10, {r('(n1 - m10)::DOUBLE / (n0 + n1)')} FROM cal""",
    "label_issues": f"WITH {NOISE} SELECT id, {n('given')} AS given, is_issue FROM flagged",
    "issue_breakdown": f"""WITH {NOISE} SELECT {n('CASE WHEN grouping(given) = 1 THEN -1 ELSE given END')} AS given, count(*) AS n,
  count(*) FILTER (is_issue) AS n_issues, {r('100e0 * count(*) FILTER (is_issue) / count(*)')} AS pct FROM flagged GROUP BY ROLLUP (given)""",
    "label_health": f"""WITH {NOISE}, h AS (SELECT (n0 - m01 + n1 - m10)::DOUBLE / (n0 + n1) AS v FROM cal)
SELECT {r('v')} AS health, CASE WHEN v >= 0.8 THEN 'excellent' WHEN v >= 0.6 THEN 'good' WHEN v >= 0.4 THEN 'moderate' ELSE 'poor' END AS band FROM h""",
    "pruned": f"WITH {NOISE} SELECT id, {n('y')} AS y, {n('given')} AS given FROM flagged WHERE NOT is_issue",
    "prune_report": f"""WITH {NOISE} SELECT {n('given')} AS given, count(*) AS n_before, count(*) FILTER (NOT is_issue) AS n_after,
  count(*) FILTER (is_issue) AS n_removed, {r('100e0 * count(*) FILTER (NOT is_issue) / count(*)')} AS retention FROM flagged GROUP BY given""",
    "noise_metrics": f"""WITH {NOISE}, k AS (SELECT count(*) AS n, count(*) FILTER (is_issue) AS i, count(*) FILTER (is_issue AND given = 0) AS i0,
  count(*) FILTER (is_issue AND given = 1) AS i1, count(*) FILTER (given = 0) AS g0, count(*) FILTER (given = 1) AS g1 FROM flagged),
m AS (SELECT {_pairs({
        'original_size': 'n', 'num_issues': 'i', 'filtered_size': 'n - i', 'pct_pruned': '100e0 * i / n',
        'retention_rate': '100e0 * (n - i) / n', 'issues_SAFE': 'i0', 'issues_RISK': 'i1',
        'pct_pruned_SAFE': '100e0 * i0 / g0', 'pct_pruned_RISK': '100e0 * i1 / g1'})} FROM k
  UNION ALL SELECT 'health', (n0 - m01 + n1 - m10)::DOUBLE / (n0 + n1) FROM cal)
SELECT 'noise' AS stage, metric, {r('value')} AS value FROM m""",
    "stratified_split": f"WITH {CLEANED},{PROJECT_SPLIT} SELECT id, idproject, split FROM psplit",
    "group_split": f"""WITH {CLEANED}, h AS (SELECT id, idproject, ('0x' || substr({_md5(c.SEED, 'idproject')}, 1, 8))::BIGINT / 4294967296e0 AS v FROM cleaned)
SELECT id, idproject, CASE WHEN v < 0.6 THEN 'train' WHEN v < 0.8 THEN 'val' ELSE 'test' END AS split FROM h""",
    "label_split": f"WITH {PREDS},{LABEL_SPLIT} SELECT id, {n('y')} AS y, split FROM lsplit",
    "split_distribution": f"""WITH {PREDS},{LABEL_SPLIT} SELECT split, {n('y')} AS y, count(*) AS n,
  {r('100e0 * count(*) / sum(count(*)) OVER (PARTITION BY split)')} AS pct FROM lsplit GROUP BY split, y""",
    "sample_weights": f"""WITH {PREDS} SELECT id, {n('y')} AS y, {r('(SELECT count(*)::DOUBLE / count(DISTINCT y) FROM preds) / count(*) OVER (PARTITION BY y)')} AS weight FROM preds""",
    "scaled_features": f"WITH {SCALED} SELECT id, split, {', '.join(f'{r(x)} AS {x}' for x in c.FEATURE_NAMES)} FROM scaled",
    "fused_features": f"""WITH {SCALED}, fu AS (
  SELECT s.id, list_concat([{', '.join(c.FEATURE_NAMES)}],
    coalesce(list_transform(embedding, lambda x: x::DOUBLE), list_transform(range(64), lambda x: 0::DOUBLE))) AS v
  FROM scaled s LEFT JOIN embeddings e ON e.vec_id = s.id), ix AS (SELECT id, v, unnest(range(0, len(v))) AS position FROM fu)
SELECT id, position, {r('v[position + 1]')} AS value FROM ix""",
    "tfidf_bigram": f"WITH {BIGRAM} SELECT id, term, {r('tfidf')} AS tfidf FROM weights2",
    "l2_normalized": f"""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings),
ix AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm, unnest(range(0, len(e))) AS position FROM v)
SELECT id, position, {r('e[position + 1] / nrm')} AS value FROM ix""",
    "dedup_score": f"""WITH dtexts AS (SELECT doc_id AS id, text AS t FROM documents),{features('dtexts')}
SELECT id, {r('flesch_reading_ease')} AS flesch_reading_ease, {r('word_count')} AS word_count, {r('sentence_count')} AS sentence_count FROM feats""",
    "best_round": f"""WITH {LOSSES}, v AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, round) AS k FROM losses WHERE split = 'val'),
t AS (SELECT run, max(round) AS last_round, count(*) FILTER (split = 'train') AS n_train FROM losses GROUP BY run)
SELECT run, round AS best_round, {r('loss')} AS best_loss, last_round, n_train FROM v JOIN t USING (run) WHERE k = 1""",
    "argmax_class": f"WITH {SCORED} SELECT id, {n('y_pred')} AS y_pred FROM scored",
    "renormalize": f"""WITH {PREDS}, s AS (SELECT id, {', '.join(f'greatest(p{k} - 0.3e0, 0e0) AS s{k}' for k in range(3))} FROM preds)
SELECT id, {', '.join(r(f'CASE WHEN s0 + s1 + s2 <> 0 THEN s{k} / (s0 + s1 + s2) ELSE s{k} END') + f' AS p{k}' for k in range(3))} FROM s""",
    "calibrated": _CALIBRATED,
    "isotonic_fit": f"""WITH {_ISOTONIC}, pools AS (
  SELECT class, round(v, 10) AS v, min(score) AS low, max(score) AS high FROM sums JOIN fitted USING (class, i) GROUP BY class, round(v, 10))
SELECT {n('class')} AS class, {r('unnest(list_distinct([low, high]))')} AS boundary, {r('v')} AS value FROM pools""",
    "ece": f"""WITH {SCORED}, s AS (SELECT greatest(p0, p1, p2) AS conf, (y = y_pred)::INT AS hit FROM scored),
b AS (SELECT {_ECE_BIN} AS bin, count(*) AS k, avg(hit) AS acc, avg(conf) AS con FROM s WHERE conf < 1 GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS n, {r('sum(k * abs(acc - con)) / (SELECT count(*) FROM s)')} AS ece FROM b""",
    "calibration_curve": f"""WITH {_CAL_CURVE} SELECT {n('class')} AS class, {n('bin')} AS bin, n, {r('fraction_positive')} AS fraction_positive, {r('mean_predicted')} AS mean_predicted FROM cc""",
    "calibration_gap": f"WITH {_CAL_CURVE} SELECT {n('class')} AS class, {r('avg(abs(fraction_positive - mean_predicted))')} AS gap FROM cc GROUP BY class",
    "cost_decision": f"WITH {COSTED} SELECT id, {n('y_pred')} AS y_pred, {r('chosen')} AS chosen_cost FROM costed",
    "realized_cost": f"""WITH {COSTED}, k AS (SELECT *, {str([[float(x) for x in row] for row in c.COST_MATRIX])}[(y_pred + 1)::INT][(y + 1)::INT]::DOUBLE AS cost FROM costed)
SELECT count(*) AS n, {r('sum(cost)')} AS total_cost, {r('avg(cost)')} AS average_cost, {r('avg((y = y_pred)::INT)')} AS accuracy FROM k""",
    "cost_matrix": f"""WITH {PREDS}, m AS (SELECT * FROM (VALUES (0, 0, 0.0), (0, 1, 2.0), (0, 2, 100.0), (1, 0, 1.0), (1, 1, 0.0), (1, 2, 20.0),
  (2, 0, 3.0), (2, 1, 2.0), (2, 2, 0.0)) AS v(predicted, tr, cost))
SELECT {n('predicted')} AS predicted, {n('tr')} AS "true", cost::DOUBLE AS cost,
  {r('(SELECT count(*) FROM preds WHERE y = tr)::DOUBLE / (SELECT count(*) FROM preds)')} AS true_share FROM m""",
    "risk_decision": f"""WITH {COSTED} SELECT id, {strings(_C3)}[(y_pred + 1)::INT] AS risk_level, {r('100e0 * [p0, p1, p2][(y_pred + 1)::INT]')} AS confidence FROM costed""",
    "assessment_fallback": f"""WITH {COSTED} SELECT d.doc_id AS id, coalesce({strings(_C3)}[(y_pred + 1)::INT], 'Medium') AS risk_level,
  round(coalesce([p0, p1, p2][(y_pred + 1)::INT] * 100e0, 50e0), 1) AS confidence FROM documents d LEFT JOIN costed c ON c.id = d.doc_id""",
    "accuracy": f"WITH {SCORED} SELECT count(*) AS n, {r('avg((y = y_pred)::INT)')} AS accuracy FROM scored",
    "confusion_matrix": f"WITH {SCORED} " + " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS y, {j}::BIGINT AS y_pred, count(*) FILTER (y = {i} AND y_pred = {j}) AS n,
  {r(f'CASE WHEN count(*) FILTER (y = {i}) = 0 THEN 0e0 ELSE 100e0 * count(*) FILTER (y = {i} AND y_pred = {j}) / count(*) FILTER (y = {i}) END')} AS row_pct FROM scored"""
        for i in range(3) for j in range(3)
    ),
    "class_report": f"""WITH {SCORED}, rep AS ({report('scored')}) SELECT {n('class')} AS class, {r('precision')} AS precision, {r('recall')} AS recall,
  {r('f1')} AS f1, support FROM rep""",
    "f1_summary": f"WITH {SCORED}, rep AS ({report('scored')}) SELECT " + ", ".join(
        f"{r(f'avg({m})')} AS macro_{m}, {r(f'sum({m} * support) / sum(support)')} AS weighted_{m}" for m in ("precision", "recall", "f1")
    ) + " FROM rep",
    "roc_points": f"""WITH {CURVE} SELECT {n('class')} AS class, {r('score')} AS threshold, {r('fp::DOUBLE / n_neg')} AS fpr, {r('tp::DOUBLE / n_pos')} AS tpr FROM curve""",
    "roc_auc": f"""WITH {CURVE}, st AS (SELECT *, coalesce(lag(fp) OVER w, 0) AS fp0, coalesce(lag(tp) OVER w, 0) AS tp0 FROM curve
  WINDOW w AS (PARTITION BY class ORDER BY score DESC))
SELECT {n('class')} AS class, {r('sum((fp - fp0) * (tp + tp0) / 2e0) / max(n_pos * n_neg)')} AS auc FROM st GROUP BY class""",
    "pr_points": f"""WITH {CURVE} SELECT {n('class')} AS class, {r('score')} AS threshold, {r('tp::DOUBLE / (tp + fp)')} AS precision, {r('tp::DOUBLE / n_pos')} AS recall FROM curve""",
    "average_precision": f"""WITH {CURVE}, st AS (SELECT *, coalesce(lag(tp) OVER (PARTITION BY class ORDER BY score DESC), 0) AS tp0 FROM curve)
SELECT {n('class')} AS class, {r('sum((tp - tp0) * (tp::DOUBLE / (tp + fp))) / max(n_pos)')} AS average_precision FROM st GROUP BY class""",
    "ablation_summary": f"WITH {_RUNS} SELECT config, count(*) AS n_runs, {r('avg(macro_f1)')} AS mean_f1, {r('stddev_pop(macro_f1)')} AS std_f1 FROM f1s GROUP BY config",
    "attributions": f"WITH {PHI} SELECT id, {n('class')} AS class, feature, {r('value')} AS value, {r('phi')} AS phi FROM phi",
    "top_factors": f"""WITH {PHI} SELECT id, {n('predicted')} AS predicted, rank, feature, {r('value')} AS value, {r('phi')} AS phi
FROM ordered WHERE rank <= 5 AND abs(phi) >= 0.01e0""",
    "factor_text": f"""WITH {FEATS}, lf AS ({' UNION ALL '.join(f"SELECT id, '{f}' AS feature, {f} AS value FROM feats" for f in c.FEATURE_NAMES)}),
s AS (SELECT id, feature, {sentence('feature', 'value')} AS sentence FROM lf) SELECT * FROM s WHERE sentence IS NOT NULL""",
    "explanations": f"""WITH {_FACTOR_LINES}
SELECT c.id, {_LEVEL} AS risk_level, concat_ws(chr(10), 'This story is classified as **' || {_LEVEL} || ' Risk**.', chr(10) || '**Key Risk Factors:**',
  t.lines, CASE WHEN p.id IS NOT NULL THEN concat_ws(chr(10), chr(10) || '**Probability Distribution:**', printf('- Low: %.1f', p0 * 100) || '%',
  printf('- Medium: %.1f', p1 * 100) || '%', printf('- High: %.1f', p2 * 100) || '%') END) AS explanation
FROM chosen c LEFT JOIN preds p ON p.id = c.id LEFT JOIN told t ON t.id = c.id""",
    "global_importance": f"""WITH {PHI}, pc AS (SELECT class, feature, avg(abs(phi)) AS importance FROM phi GROUP BY ALL),
ov AS (SELECT feature, avg(importance) AS overall, row_number() OVER (ORDER BY avg(importance) DESC, feature) AS rank FROM pc GROUP BY feature)
SELECT {n('class')} AS class, feature, {r('importance')} AS importance, {r('overall')} AS overall, rank FROM pc JOIN ov USING (feature)""",
    "beeswarm_data": f"""WITH {PHI}, pc AS (SELECT class, feature, avg(abs(phi)) AS importance FROM phi GROUP BY ALL),
tf AS (SELECT feature FROM pc GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 3)
SELECT id, feature, {r('value')} AS value, {r('phi')} AS phi FROM phi WHERE class = 2 AND feature IN (SELECT feature FROM tf)""",
    "waterfall_data": f"""WITH {PHI}, w AS (SELECT id, least(rank, 4) AS step, CASE WHEN rank <= 3 THEN feature ELSE 'other' END AS feature, sum(phi) AS phi
  FROM ordered GROUP BY ALL)
SELECT id, step, feature, {r('phi')} AS phi, {r('sum(phi) OVER (PARTITION BY id ORDER BY step)')} AS running FROM w""",
    "dependence_data": f"""WITH {PHI}, cr AS ({' UNION ALL '.join(
        f"SELECT '{f}' AS f, coalesce(abs(corr(word_count, {f})), 0) AS r FROM feats" for f in _FF if f != 'word_count')}),
pk AS (SELECT f FROM cr ORDER BY r DESC, f DESC LIMIT 1)
SELECT p.id, {r('p.value')} AS value, {r('p.phi')} AS phi, pk.f AS interaction, {r('i.value')} AS interaction_value
FROM phi p, pk, phi i WHERE p.class = 2 AND p.feature = 'word_count' AND i.id = p.id AND i.class = 2 AND i.feature = pk.f""",
    "example_high": f"""WITH {PREDS} SELECT id, {n('y')} AS y, {r('p0')} AS p0, {r('p1')} AS p1, {r('p2')} AS p2, {n('given')} AS given, {r('pb0')} AS pb0, {r('pb1')} AS pb1
FROM preds WHERE y = 2 ORDER BY id LIMIT 1""",
    "similar_topk": f"WITH {_nearest(5, 0.0)} {_SIMILAR}",
    "similar_by_vec": f"WITH {_nearest(5, -1.0)} {_SIMILAR}",
    "similar_blocked": f"WITH {_nearest(5, 0.0)} {_SIMILAR}",
    "embedding_store": f"""WITH {CLEANED}, d AS (SELECT count(DISTINCT full_text) AS texts, count(*) AS n FROM cleaned)
SELECT {n('run')} AS run, CASE WHEN run = 1 THEN texts ELSE 0 END AS encoded, n AS embedded FROM d, (VALUES (1), (2)) AS v(run)""",
    "similar_queries": f"WITH {_nearest(5, 0.0)} {_SIMILAR} WHERE query_id % 100 = 0",
    "similar_ids": f"""WITH {_nearest(5, 0.0)}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM near WHERE sim >= 0.3)
SELECT u.query_id, coalesce(string_agg(k.id::VARCHAR, ',' ORDER BY k.k), '') AS ids
FROM (SELECT DISTINCT query_id FROM near) u LEFT JOIN (SELECT * FROM k WHERE k <= 3) k USING (query_id) GROUP BY u.query_id""",
    "similar_detail": f"""WITH {_nearest(3, 0.0)},{CLASSES} SELECT near.query_id, near.rank, near.id, {r('near.sim')} AS similarity, title,
  CASE WHEN length(description) > 200 THEN substr(description, 1, 200) || '...' ELSE description END AS description,
  risk_label AS risk_level, story_points FROM near LEFT JOIN classes ON classes.id = near.id""",
    "health_scores": f"""WITH {_health()} SELECT story_count, {', '.join(f'{r(f"{x}_score")} AS {x}_score' for x in ("volume", "completeness", "quality", "consistency"))} FROM hs""",
    "health_report": _health_report(),
    "health_by_project": _health_report("idproject"),
    "days_needed": f"WITH {SPRINTS} SELECT id, days FROM timed",
    "business_days": f"WITH {SPRINTS} SELECT id, {_calendar('new')} AS new_end_date FROM timed",
    "scope_impact": _SCOPE,
    "team_velocity": f"""WITH {SPRINTS} SELECT team, {r('sum(new)')} AS points, {n('date_diff(' + q('day') + ', min(end_date), max(end_date)) + 1')} AS days,
  {r('sum(new)::DOUBLE / (date_diff(' + q('day') + ', min(end_date), max(end_date)) + 1)')} AS velocity FROM sprints GROUP BY team""",
    "stage_funnel": f"""WITH {LABELED}, k AS (
  SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS n FROM stories UNION ALL SELECT 1, 'weak_labels', count(*) FROM labeled UNION ALL
  SELECT 2, 'confident', count(*) FILTER (risk_confidence > 0.5) FROM labeled UNION ALL
  SELECT 3, 'high_confidence', count(*) FILTER (risk_confidence > 0.75) FROM labeled)
SELECT {n('stage_no')} AS stage_no, stage, n, coalesce(lag(n) OVER w - n, 0) AS lost, {r('coalesce(100e0 * n / lag(n) OVER w, 100e0)')} AS kept_pct
FROM k WINDOW w AS (ORDER BY stage_no)""",
    "risk_points_correlation": f"WITH {LABELED} SELECT {r('corr(risk_prob_risk, story_points)')} AS r FROM labeled",
    "stream_score": f"""WITH {CLASSES} SELECT s.id, c.id IS NOT NULL AS accepted, coalesce(c.risk_label, 'Medium') AS risk_level,
  round(coalesce(c.risk_confidence * 100e0, 50e0), 1) AS confidence FROM stories s LEFT JOIN classes c ON c.id = s.id""",
}
