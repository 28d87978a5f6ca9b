"""The queries as DuckDB SQL."""

from __future__ import annotations


def _hw(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[ \n\r\t]'), lambda w: regexp_replace(w, '[^\x{{590}}-\x{{5FF}}]', '', 'g')), lambda w: w <> '')"


_SP = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _pipes(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '|', '')))"


def _tokens(x: str) -> str:
    return rf"coalesce(len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')), 0)"


def _overlap(text: str, headline: str) -> str:
    h, a = f"list_distinct({_hw(headline)})", f"({_hw(text)})[1:50]"
    return f"CASE WHEN len({h}) = 0 THEN 0.0 ELSE round(len(list_intersect({h}, {a})) / len({h}), 4) END"


def _edit(o: str, r: str) -> str:
    ow, rw = _hw(o), _hw(r)
    j = f"coalesce(len(list_intersect(list_distinct({ow}), list_distinct({rw}))) / nullif(len(list_distinct(list_concat({ow}, {rw}))), 0), 0.0)"
    end = f"regexp_replace({o}, '{_SP}+$', '')"
    closed = " OR ".join(f"suffix({end}, '{c}')" for c in (".", "!", "?", '"', "”", "׳"))
    return f"""CASE WHEN {o} IS NULL OR {r} IS NULL THEN NULL
  WHEN {_pipes(o)} > 0 AND {_pipes(r)} = 0 THEN 'pipes_removed'
  WHEN len({rw}) < len({ow}) AND (({_strip(r)} <> '' AND contains({o}, {_strip(r)})) OR {j} >= 0.8) THEN 'boilerplate_stripped'
  WHEN NOT ({closed}) AND (suffix({end}, '...') OR suffix({end}, '…') OR coalesce(({ow})[-1] IN ('של','עם','אל','כי','אשר','וכן','וגם','אבל','או','גם','רק'), false)) THEN 'truncation_repaired'
  WHEN {j} >= 0.5 THEN 'light_edit' ELSE 'full_rewrite' END"""


_DIMS = ("faithfulness", "single_focus", "informativeness", "cleanliness")
_RECS = "recs AS (SELECT id, pos, text, headline, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM records WHERE id IS NOT NULL) WHERE rn = 1)"
_ROWS = "rows_ AS (SELECT DISTINCT * FROM row_labels)"
_LABELS = "labels_ AS (SELECT hesum_id AS id, max(source_label) AS filter_label FROM row_labels WHERE reached_model_curation GROUP BY hesum_id)"
_REPL = "repl AS (SELECT id, min(replacement_headline) AS replacement_headline FROM headline_target_curation_results GROUP BY id)"
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY annotator_id, hesum_id, task ORDER BY coalesce(submitted_at, '') DESC, pos DESC) AS rn FROM annotations) WHERE rn = 1)"
_LONG = (
    _LATEST
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT annotator_id, hesum_id, '{c}' AS dimension, scores.{c} AS score FROM latest WHERE task = 'rubric' AND scores.{c} BETWEEN 1 AND 5" for c in _DIMS)
    + ")"
)
_POOLED = "pooled AS (SELECT hesum_id, dimension, CAST(round(avg(score)) AS INTEGER) AS score FROM long GROUP BY ALL)"
_STRATA = {
    "S0": "reached_model_curation AND source_label = 'usable' AND headline_action = 'kept'",
    "S2": "multi_pipe",
    "S3": "source_label = 'unusable_multiple_independent_items'",
    "S4": "headline_action = 'rewritten'",
}
_S5 = "source_label IS NOT NULL AND source_label NOT IN ('usable', 'unusable_multiple_independent_items')"
_MEMBERS = "members AS (" + " UNION ALL ".join(f"SELECT DISTINCT hesum_id, '{s}' AS stratum FROM row_labels WHERE {c}" for s, c in _STRATA.items()) + ")"
_SCORES = f"{_LONG}, {_MEMBERS}, scored AS (SELECT stratum, dimension, score FROM long JOIN members USING (hesum_id))"
_COUNTS = _SCORES + ", counts AS (SELECT stratum, dimension, score, count(*) AS n FROM scored GROUP BY ALL)"
_DELTA = """deltas AS (SELECT a.stratum, a.dimension, round(sum(sign(a.score - b.score) * CAST(a.n AS DOUBLE) * b.n) / sum(CAST(a.n AS DOUBLE) * b.n), 6) AS delta
FROM counts a JOIN counts b ON a.dimension = b.dimension AND b.stratum = 'S0' WHERE a.stratum <> 'S0' GROUP BY ALL)"""
_ARMS = f"{_LONG}, arms AS (SELECT hesum_id, dimension, min(score) AS raw, max(score) AS curated FROM long GROUP BY ALL HAVING count(*) > 1)"
_ARM = _ARMS + ", arm AS (SELECT dimension, 'raw' AS arm, raw AS score FROM arms UNION ALL SELECT dimension, 'curated', curated FROM arms)"
_OUT = f"""won AS (SELECT *, lower({_strip("winner")}) AS w FROM annotations WHERE task = 'pairwise' AND slot_map IS NOT NULL),
outcomes AS (SELECT *, CASE WHEN w = 'tie' THEN 'tie' WHEN (w = 'a') = coalesce(slot_map['a'] = 'curated', false) THEN 'curated' ELSE 'original' END AS outcome FROM won WHERE w IN ('a', 'b', 'tie'))"""


def _kappa(source: str, by: str) -> str:
    return f"""src AS ({source}),
labels AS (SELECT {by}, label, row_number() OVER (PARTITION BY {by} ORDER BY label) AS i FROM (SELECT {by}, a AS label FROM src UNION SELECT {by}, b FROM src)),
placed AS (SELECT {", ".join("src." + c.strip() for c in by.split(","))}, x.i AS i, y.i AS j FROM src
  JOIN labels x ON {" AND ".join(f"x.{c.strip()} = src.{c.strip()}" for c in by.split(","))} AND x.label = a
  JOIN labels y ON {" AND ".join(f"y.{c.strip()} = src.{c.strip()}" for c in by.split(","))} AND y.label = b),
kappas AS (SELECT {by}, count(*) AS n, round(1 - CAST(count(*) AS DOUBLE) * sum((i - j) * (i - j))
  / nullif(CAST(count(*) * sum(i * i) + count(*) * sum(j * j) - 2 * sum(i) * sum(j) AS DOUBLE), 0), 3) AS kappa FROM placed GROUP BY {by})"""


def _rate(by: str = "") -> str:
    z = 1.959963984540054
    p, n = "(curated / nullif(CAST(n_non_tie AS DOUBLE), 0))", "CAST(n_non_tie AS DOUBLE)"
    spread = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z!r} / (4 * {n} * {n}))"
    low = f"CASE WHEN n_non_tie = 0 THEN 0.0 ELSE 100 * greatest(0.0, ({p} + {z * z!r} / (2 * {n}) - {spread}) / (1 + {z * z!r} / {n})) END"
    high = f"CASE WHEN n_non_tie = 0 THEN 0.0 ELSE 100 * least(1.0, ({p} + {z * z!r} / (2 * {n}) + {spread}) / (1 + {z * z!r} / {n})) END"
    cols = f"{by}, " if by else ""
    return f"""WITH {_OUT},
one AS (SELECT {cols}count(*) AS n, count(*) FILTER (outcome = 'curated') AS curated, count(*) FILTER (outcome = 'original') AS original,
  count(*) FILTER (outcome = 'tie') AS tie, count(*) FILTER (outcome <> 'tie') AS n_non_tie FROM outcomes {"GROUP BY " + by if by else ""}),
r AS (SELECT *, {low} AS lo, {high} AS hi FROM one)
SELECT {cols}n, curated, original, tie, n_non_tie, round(100 * curated / nullif(n, 0), 1) AS curated_pct, round(100 * tie / nullif(n, 0), 1) AS tie_pct,
  round(100 * curated / nullif(n_non_tie, 0), 1) AS non_tie_curated_pct, round(lo, 4) AS wilson_low, round(hi, 4) AS wilson_high, lo > 50 OR hi < 50 AS excludes_50 FROM r"""


def _distribution(source: str, by: str, ctes: str) -> str:
    return f"""WITH {ctes}, levels AS (SELECT unnest([1, 2, 3, 4, 5]) AS level), g AS (SELECT {by}, count(score) AS total FROM {source} GROUP BY {by}),
c AS (SELECT {by}, score AS level, count(*) AS n FROM {source} GROUP BY ALL)
SELECT {", ".join("g." + x.strip() for x in by.split(","))}, levels.level, coalesce(c.n, 0) AS n, CASE WHEN total = 0 THEN 0.0 ELSE round(coalesce(c.n, 0) * 100 / total, 4) END AS share
FROM g CROSS JOIN levels LEFT JOIN c ON c.level = levels.level AND {" AND ".join(f"c.{x.strip()} = g.{x.strip()}" for x in by.split(","))}"""


_TAILS = f"""WITH RECURSIVE {_RECS},
w AS (SELECT id, {_hw("text")} AS ws FROM recs),
seed AS (SELECT id, ws, array_to_string(ws[-5:], ' ') AS t5 FROM w WHERE len(ws) >= 5),
surv AS (SELECT id, ws FROM seed WHERE t5 IN (SELECT t5 FROM seed GROUP BY t5 HAVING count(*) >= 5)),
sx AS (SELECT id, l, array_to_string(ws[-l:], ' ') AS tail FROM surv, LATERAL (SELECT unnest(range(5, len(ws) + 1)) AS l)),
sup AS (SELECT tail, l FROM sx GROUP BY tail, l HAVING count(*) >= 5),
deep AS (SELECT id, max_by(sx.tail, sx.l) AS tail, max(sx.l) AS l FROM sx JOIN sup USING (tail, l) GROUP BY id),
ok AS (SELECT tail, l FROM deep GROUP BY tail, l HAVING count(*) >= 5)"""

_FUNNEL = """count(*) AS total, count(*) FILTER (tail_boilerplate_removed) AS tail_boilerplate_removed, count(*) FILTER (over_token_budget AND NOT multi_pipe) AS over_budget_only,
count(*) FILTER (multi_pipe AND NOT over_token_budget) AS multi_pipe_only, count(*) FILTER (over_token_budget AND multi_pipe) AS both, count(*) FILTER (reached_model_curation) AS reached,
count(*) FILTER (source_label = 'usable') AS usable, count(*) FILTER (reached_model_curation AND source_label <> 'usable') AS unusable,
count(*) FILTER (headline_action = 'kept') AS kept, count(*) FILTER (headline_action = 'rewritten') AS rewritten"""


def _mark(x: str, seed: object) -> str:
    return f"md5('{seed}:' || {x})"


def _part(source: str, section: str, who: str = "NULL", dimension: str = "NULL", **measures: str) -> str:
    names, values = ", ".join(f"'{m}'" for m in measures), ", ".join(f"CAST({v} AS DOUBLE)" for v in measures.values())
    return f"SELECT '{section}' AS section, CAST({who} AS VARCHAR) AS who, CAST({dimension} AS VARCHAR) AS dimension, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM ({source})"


def _reports(sql: dict[str, str]) -> dict[str, str]:
    """The whole programs' reports, from the SQL of their parts."""
    win = sql["pairwise_rate"]
    together = f"WITH {_LONG}, {_POOLED}, one AS (SELECT hesum_id, dimension, max_by(score, annotator_id) AS score FROM long GROUP BY ALL), x AS (SELECT o.dimension, p.score AS a, o.score AS b FROM one o JOIN pooled p USING (hesum_id, dimension))"
    judged = f"""WITH {_OUT}, last AS (SELECT annotator_id, hesum_id, max_by(outcome, pos) AS o FROM outcomes GROUP BY ALL), judge AS (SELECT hesum_id, min_by(outcome, pos) AS j FROM outcomes GROUP BY 1),
x AS (SELECT annotator_id, CASE o WHEN 'original' THEN 0 WHEN 'tie' THEN 1 ELSE 2 END AS a, CASE j WHEN 'original' THEN 0 WHEN 'tie' THEN 1 ELSE 2 END AS b FROM last JOIN judge USING (hesum_id))"""
    human = [
        _part(sql["completion_check"], "completion", "annotator_id", expected="expected_tasks", submitted="submitted_tasks", missing="missing_tasks"),
        _part(sql["judge_kappa"], "judge and rater", "annotator_id", "dimension", n="n", kappa="kappa"),
        _part(f"{together}, {_kappa('SELECT dimension, a, b FROM x', 'dimension')} SELECT * FROM kappas", "judge and raters", "NULL", "dimension", n="n", kappa="kappa"),
        _part(
            together + " SELECT dimension, round(avg(a), 3) AS ma, round(avg(b), 3) AS mb, round(100 * count(*) FILTER (a = b) / count(*), 1) AS e, round(100 * count(*) FILTER (abs(a - b) <= 1) / count(*), 1) AS w FROM x GROUP BY 1",
            "closeness", "NULL", "dimension", mean_judge="ma", mean_raters="mb", exact_pct="e", within_one_pct="w",
        ),
        _part(judged + " SELECT annotator_id, round(100 * count(*) FILTER (a = b) / count(*), 2) AS pct FROM x GROUP BY 1", "pairs agreed with judge", "annotator_id", percent_agreement="pct"),
        _part(f"{judged}, {_kappa('SELECT annotator_id, a, b FROM x', 'annotator_id')} SELECT * FROM kappas", "pairs with judge", "annotator_id", n="n", kappa="kappa"),
        _part(win, "win rate", n="n", curated="curated", tie="tie", non_tie_curated_pct="non_tie_curated_pct", wilson_low="wilson_low", wilson_high="wilson_high"),
    ]
    chosen = f"""{_LONG}, {_POOLED}, {_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_mark("hesum_id", 42)}, hesum_id) AS r FROM members),
chosen AS (SELECT DISTINCT hesum_id FROM k WHERE r <= 75), again AS (SELECT hesum_id FROM chosen ORDER BY {_mark("hesum_id", 43)}, hesum_id LIMIT 60),
first_pass AS (SELECT * FROM pooled WHERE hesum_id IN (SELECT hesum_id FROM chosen)),
second_pass AS (SELECT hesum_id, dimension, min(score) AS score FROM long WHERE hesum_id IN (SELECT hesum_id FROM again) GROUP BY ALL)"""
    pilot = [
        _part(_distribution("first_pass", "dimension", chosen), "distribution", "'level ' || level", "dimension", n="n"),
        _part(f"WITH {chosen}, c AS (SELECT dimension, score, count(*) AS n FROM first_pass GROUP BY ALL) SELECT dimension, sum(n) AS n, round(max(n) / sum(n), 6) AS m, (max(n) / sum(n) >= 0.85)::INT AS d FROM c GROUP BY 1", "degenerate", "NULL", "dimension", n="n", max_share="m", is_degenerate="d"),
        _part(f"WITH {chosen}, {_kappa('SELECT dimension, f.score AS a, g.score AS b FROM first_pass f JOIN second_pass g USING (hesum_id, dimension)', 'dimension')} SELECT * FROM kappas", "test-retest", "NULL", "dimension", n="n", kappa="kappa"),
    ]
    experiment = [
        _part(_distribution("arm", "arm, dimension", _ARM), "level", "arm || ' ' || level", "dimension", n="n"),
        _part(sql["arm_means"], "mean", "arm", "dimension", mean_score="mean_score"),
        _part(win, "win rate", n="n", non_tie_curated_pct="non_tie_curated_pct", wilson_low="wilson_low", wilson_high="wilson_high"),
    ]
    union = " UNION ALL ".join
    held = "(SELECT hesum_id FROM curated_records WHERE split IN ('val', 'test') AND hesum_id IS NOT NULL)"
    text, summary = _strip("text"), _strip("summary")
    return {
        "human_validation": union(human),
        "pilot_report": union(pilot),
        "experiment_report": union(experiment),
        "training_pool_steps": f"""WITH {_RECS}, l AS (SELECT * FROM recs WHERE text IS NOT NULL), f AS (SELECT * FROM l WHERE id NOT IN {held})
SELECT 'loaded' AS step, count(*) AS n_rows FROM l UNION ALL SELECT 'not held out', count(*) FROM f UNION ALL SELECT 'distinct texts', count(DISTINCT text) FROM f UNION ALL SELECT 'sampled', least(500, count(DISTINCT text)) FROM f""",
        "limit_sample": f"SELECT hesum_id FROM (SELECT DISTINCT hesum_id FROM curated_records WHERE split = 'train' AND hesum_id IS NOT NULL) ORDER BY {_mark('hesum_id', 42)}, hesum_id LIMIT 60",
        "first_validation_rows": "SELECT DISTINCT hesum_id FROM curated_records WHERE split = 'val' AND hesum_id IS NOT NULL ORDER BY hesum_id LIMIT 100",
        "training_check": f"""WITH r AS (SELECT split, {text} AS text, {summary} AS summary FROM curated_records WHERE {text} <> '' AND {summary} <> ''),
s AS (SELECT DISTINCT split, text FROM r), m AS (SELECT text FROM s GROUP BY text HAVING count(*) > 1), c AS (SELECT split, count(*) AS c FROM s JOIN m USING (text) GROUP BY 1)
SELECT r.split, count(*) AS n, 0 AS n_blank_text, 0 AS n_blank_summary, coalesce(any_value(c), 0) AS n_shared, 0 AS n_prompt_lacks_text, 0 AS n_other_completion FROM r LEFT JOIN c ON c.split = r.split GROUP BY r.split""",
        "incremental_ingest": f"SELECT coalesce(error, 'done') AS state, count(*) AS n FROM ({sql['batch_parse']}) GROUP BY 1",
        "judged_records": f"""WITH {_RECS} SELECT id, 4 AS n_scores, (length('Article:') + 1 + least(length(text), 6000) + 1 + length('Headline: ') + length(headline)) % 5 + 1 AS faithfulness
FROM recs WHERE text IS NOT NULL AND headline IS NOT NULL""",
        "generation_resume": f"WITH {_RECS} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM recs WHERE headline IS NOT NULL",
        "tail_ids": _TAILS + " SELECT tail, l AS length, id FROM deep JOIN ok USING (tail, l)",
    }


def oracle_sql() -> dict[str, str]:
    sql = _queries()
    return sql | _reports(sql)


def _queries() -> dict[str, str]:
    return {
        "word_extract": f"SELECT pos, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, array_to_string(w[1:3], ' ') AS lead FROM (SELECT pos, {_hw('text')} AS w FROM records)",
        "lead_overlap": f"SELECT pos, {_overlap('text', 'headline')} AS overlap FROM records",
        "pipe_filter": f"SELECT pos, {_pipes('headline')} AS n_pipes, {_pipes('headline')} <= 1 AS keep FROM records",
        "token_budget": f"SELECT pos, {_tokens('text')} AS article_tokens, {_tokens('headline')} AS headline_tokens, {_tokens('text')} + {_tokens('headline')} <= 4000 AS keep FROM records",
        "strip_think": f"SELECT pos, {_strip('''regexp_replace(prediction, '(?s)<think>.*?</think>', '', 'g')''')} AS answer FROM predictions_curated",
        "clean_nullable": f"SELECT doc_id, length(nullif({_strip('text')}, '')) AS n_chars_clean FROM documents",
        "text_prefix": "SELECT pos, substring(text, 1, 80) AS text_prefix, length(substring(text, 1, 6000)) AS n_chars FROM records",
        "truncate_tokens": "SELECT pos, array_to_string(string_split(headline, ' ')[1:4], ' ') AS short_headline FROM records",
        "prompt_render": "SELECT pos, md5('Article:' || chr(10) || substring(text, 1, 6000) || chr(10) || chr(10) || 'Headline: ' || headline || chr(10)) AS prompt_md5 FROM records",
        "edit_class": f"WITH {_RECS}, {_REPL} SELECT id, {_edit('headline', 'replacement_headline')} AS edit_type FROM recs JOIN repl USING (id) WHERE replacement_headline IS NOT NULL",
        "edit_class_counts": f"WITH {_RECS}, {_REPL} SELECT {_edit('headline', 'replacement_headline')} AS edit_type, count(*) AS n FROM recs JOIN repl USING (id) WHERE replacement_headline IS NOT NULL GROUP BY 1",
        "gap_metadata": r"SELECT pos, regexp_matches(headline, '[A-Za-z0-9]') AND regexp_matches(headline, '[.!?;:)\]}]') AS is_metadata FROM records",
        "tail_candidates": _TAILS + " SELECT tail, l AS length, count(*) AS n_records FROM deep JOIN ok USING (tail, l) GROUP BY tail, l",
        "longest_tail": _TAILS + " SELECT id, tail, l AS length FROM deep JOIN ok USING (tail, l)",
        "curation_keep": "SELECT DISTINCT hesum_id AS id FROM row_labels WHERE article_tokens + headline_tokens <= 4000 AND n_pipes <= 1",
        "model_input": f"WITH {_RECS} SELECT id, headline FROM recs WHERE {_tokens('text')} + {_tokens('headline')} <= 4000 AND coalesce({_pipes('headline')} <= 1, true)",
        "usable_ids": f"WITH {_LABELS} SELECT id FROM labels_ WHERE filter_label = 'usable'",
        "final_dataset": f"WITH {_RECS}, {_LABELS}, {_REPL} SELECT id AS hesum_id, coalesce(replacement_headline, headline) AS headline, md5(text) AS text_md5 FROM recs JOIN repl USING (id) WHERE id IN (SELECT id FROM labels_ WHERE filter_label = 'usable')",
        "training_records": f"SELECT source, count(*) AS n, CAST(sum(length({_strip('summary')})) AS BIGINT) AS n_chars FROM curated_records WHERE {_strip('text')} <> '' AND {_strip('summary')} <> '' GROUP BY source",
        "ledger": _TAILS
        + f""", trimmed AS (SELECT id FROM deep JOIN ok USING (tail, l)), {_LABELS}, {_REPL},
p AS (SELECT id, replacement_headline, true AS present FROM repl),
lab AS (SELECT id, filter_label, true AS reached FROM labels_)
SELECT r.id AS hesum_id, {_tokens("text")} AS article_tokens, {_tokens("headline")} AS headline_tokens, coalesce({_pipes("headline")}, 0) AS n_pipes,
  {_tokens("text")} + {_tokens("headline")} > 4000 AS over_token_budget, coalesce({_pipes("headline")}, 0) > 1 AS multi_pipe,
  r.id IN (SELECT id FROM trimmed) AS tail_boilerplate_removed, filter_label AS source_label, coalesce(reached, false) AS reached_model_curation,
  CASE WHEN present THEN CASE WHEN replacement_headline IS NULL THEN 'kept' ELSE 'rewritten' END END AS headline_action,
  CASE WHEN present THEN {_edit("headline", "replacement_headline")} END AS headline_edit_type, {_overlap("text", "headline")} AS headline_lead_overlap
FROM recs r LEFT JOIN lab ON lab.id = r.id LEFT JOIN p ON p.id = r.id""",
        "curation_funnel": f"WITH {_ROWS} SELECT {_FUNNEL} FROM rows_",
        "funnel_links": f"""WITH {_ROWS}, f AS (SELECT {_FUNNEL} FROM rows_)
SELECT 'all records' AS source, 'over budget only' AS target, over_budget_only AS value FROM f UNION ALL SELECT 'all records', 'several pipes only', multi_pipe_only FROM f
UNION ALL SELECT 'all records', 'both', f."both" FROM f UNION ALL SELECT 'all records', 'model curation', total - over_budget_only - multi_pipe_only - f."both" FROM f
UNION ALL SELECT 'model curation', 'unusable', unusable FROM f UNION ALL SELECT 'model curation', 'usable', usable FROM f
UNION ALL SELECT 'usable', 'kept', kept FROM f UNION ALL SELECT 'usable', 'rewritten', rewritten FROM f""",
        "ledger_reconciliation": f"""WITH {_ROWS}, a AS (SELECT count(*) AS total, count(*) FILTER (tail_boilerplate_removed) AS tail_boilerplate_removed, count(*) FILTER (over_token_budget) AS over_token_budget,
count(*) FILTER (multi_pipe) AS multi_pipe, count(*) FILTER (reached_model_curation) AS reached_model_curation, count(*) FILTER (source_label = 'usable') AS usable,
count(*) FILTER (reached_model_curation AND source_label <> 'usable') AS unusable, count(*) FILTER (headline_action = 'kept') AS headline_kept, count(*) FILTER (headline_action = 'rewritten') AS headline_rewritten FROM rows_),
u AS (UNPIVOT a ON COLUMNS(*) INTO NAME name VALUE actual)
SELECT name, CASE WHEN name = 'total' THEN 1500 END AS expected, actual, CASE WHEN name = 'total' THEN actual = 1500 END AS agrees FROM u""",
        "label_counts": f"""WITH {_LABELS}, k AS (SELECT unnest(['usable', 'unusable_multiple_independent_items', 'unusable_substantive_content_not_in_text', 'unusable_damaged_or_fragmentary_text', 'unusable_insufficient_substantive_content', 'unusable_other']) AS filter_label)
SELECT filter_label, CAST(sum(c) AS BIGINT) AS n FROM (SELECT filter_label, 0 AS c FROM k UNION ALL SELECT filter_label, count(*) FROM labels_ GROUP BY 1) GROUP BY 1""",
        "strata_table": f"WITH {_ROWS} "
        + " UNION ALL ".join(
            f"SELECT '{s}' AS stratum, '{text}' AS criterion, count(*) FILTER ({c}) AS n FROM rows_"
            for s, text, c in (
                ("S0", "usable source; original headline kept", _STRATA["S0"]),
                ("S2", "headline contains at least two pipe separators", _STRATA["S2"]),
                ("S3", "multiple independent items", _STRATA["S3"]),
                ("S4", "headline rewritten during curation", _STRATA["S4"]),
                ("S5", "other unusable-source labels", _S5),
            )
        ),
        "stratum_members": f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT hesum_id, '{s}' AS stratum FROM rows_ WHERE {c}" for s, c in _STRATA.items()),
        "coverage_check": f"""WITH {_LABELS}, {_REPL} SELECT count(a.id) AS n_left, count(b.id) AS n_right, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS n_both,
count(*) FILTER (b.id IS NULL) AS n_missing, count(*) FILTER (a.id IS NULL) AS n_extra FROM labels_ a FULL JOIN repl b ON a.id = b.id""",
        "enum_check": "SELECT headline_edit_type AS value, count(*) AS n FROM row_labels WHERE NOT coalesce(headline_edit_type IN ('pipes_removed', 'boilerplate_stripped', 'truncation_repaired', 'light_edit', 'full_rewrite'), false) GROUP BY 1",
        "label_enum_check": "SELECT source_label AS value, count(*) AS n FROM row_labels WHERE NOT coalesce(source_label IN ('usable', 'unusable_multiple_independent_items', 'unusable_substantive_content_not_in_text', 'unusable_damaged_or_fragmentary_text', 'unusable_insufficient_substantive_content', 'unusable_other'), false) GROUP BY 1",
        "headline_stage_input": f"WITH {_RECS}, {_LABELS} SELECT id, headline FROM recs WHERE id IN (SELECT id FROM labels_ WHERE filter_label = 'usable')",
        "duplicate_ids": "WITH r AS (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS k, count(*) OVER (PARTITION BY id) AS n FROM records) SELECT id, n, pos AS first_repeat FROM r WHERE k = 2",
        "id_sets": f"""WITH {_RECS}, {_LABELS}, {_REPL} SELECT 'difference' AS operation, count(*) AS n FROM (SELECT id FROM recs EXCEPT ALL SELECT id FROM repl)
UNION ALL SELECT 'intersection', count(*) FROM (SELECT id FROM labels_ INTERSECT SELECT id FROM repl) UNION ALL SELECT 'union', count(*) FROM (SELECT id FROM labels_ UNION SELECT id FROM repl)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT id FROM labels_ UNION ALL SELECT id FROM repl)""",
        "score_distribution": _distribution("long", "dimension", _LONG),
        "share_by_level": _distribution("scored", "stratum, dimension", _SCORES),
        "median_by_stratum": f"WITH {_SCORES} SELECT stratum, dimension, count(*) AS n, CAST(median(score) AS DOUBLE) AS median FROM scored GROUP BY ALL",
        "cliffs_delta": f"WITH {_COUNTS}, {_DELTA}, s AS (SELECT stratum, dimension, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL) SELECT d.stratum, d.dimension, s.n, q.n AS n_reference, delta FROM deltas d JOIN s USING (stratum, dimension) JOIN s q ON q.stratum = 'S0' AND q.dimension = d.dimension",
        "e1_summary": f"WITH {_COUNTS}, {_DELTA} SELECT m.stratum, m.dimension, n, median, delta FROM (SELECT stratum, dimension, count(*) AS n, CAST(median(score) AS DOUBLE) AS median FROM scored GROUP BY ALL) m LEFT JOIN deltas d ON d.stratum = m.stratum AND d.dimension = m.dimension",
        "arm_means": f"WITH {_ARM} SELECT dimension, arm, count(*) AS n, round(avg(score), 6) AS mean_score FROM arm GROUP BY ALL",
        "rubric_paired": f"""WITH {_ARM}, c AS (SELECT arm, dimension, score, count(*) AS n FROM arm GROUP BY ALL),
d AS (SELECT a.dimension, round(round(sum(sign(a.score - b.score) * CAST(a.n AS DOUBLE) * b.n) / sum(CAST(a.n AS DOUBLE) * b.n), 6), 4) AS cliffs_delta_unpaired FROM c a JOIN c b ON a.dimension = b.dimension AND a.arm = 'curated' AND b.arm = 'raw' GROUP BY 1)
SELECT dimension, count(*) AS n, round(avg(raw), 3) AS raw_mean, round(avg(curated), 3) AS curated_mean, round(avg(curated - raw), 3) AS mean_difference, any_value(cliffs_delta_unpaired) AS cliffs_delta_unpaired FROM arms JOIN d USING (dimension) GROUP BY 1""",
        "degenerate_dimension": f"WITH {_COUNTS} SELECT stratum, dimension, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS max_share, max(n) / sum(n) >= 0.85 AS is_degenerate FROM counts GROUP BY ALL",
        "transition_matrix": f"WITH {_ARMS} SELECT raw AS before, " + ", ".join(f"count(*) FILTER (curated = {v}) AS to_{v}" for v in range(1, 6)) + " FROM arms GROUP BY raw",
        "kappa": f"WITH {_LONG}, {_kappa('SELECT x.annotator_id AS rater_a, y.annotator_id AS rater_b, x.dimension, x.score AS a, y.score AS b FROM long x JOIN long y ON x.hesum_id = y.hesum_id AND x.dimension = y.dimension AND x.annotator_id < y.annotator_id', 'rater_a, rater_b, dimension')} SELECT * FROM kappas WHERE n >= 2",
        "judge_kappa": f"WITH {_LONG}, {_POOLED}, {_kappa('SELECT annotator_id, l.dimension, p.score AS a, l.score AS b FROM long l JOIN pooled p ON p.hesum_id = l.hesum_id AND p.dimension = l.dimension', 'annotator_id, dimension')} SELECT * FROM kappas",
        "closeness": f"""WITH {_LONG}, {_POOLED}, x AS (SELECT l.dimension, p.score AS a, l.score AS b FROM long l JOIN pooled p ON p.hesum_id = l.hesum_id AND p.dimension = l.dimension)
SELECT dimension, count(*) AS n, round(avg(a), 3) AS mean_a, round(avg(b), 3) AS mean_b, round(100 * count(*) FILTER (a = b) / count(*), 1) AS exact_pct, round(100 * count(*) FILTER (abs(a - b) <= 1) / count(*), 1) AS within_one_pct FROM x GROUP BY 1""",
        "quantile_bins": f"""WITH {_LONG}, {_POOLED}, {_ROWS}, x AS (SELECT p.hesum_id, round(ln(greatest(article_tokens, 1)), 6) AS v, p.score FROM pooled p JOIN rows_ r ON r.hesum_id = p.hesum_id WHERE dimension = 'faithfulness' AND article_tokens IS NOT NULL),
b AS (SELECT *, ntile(16) OVER (ORDER BY v, substring(md5(hesum_id), 1, 2), md5(hesum_id), hesum_id) AS bin FROM x)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(v) AS x_min, max(v) AS x_max, round(avg(score), 6) AS y_mean FROM b GROUP BY 1""",
        "lead_bias_medians": f"""WITH {_LONG}, {_POOLED}, {_ROWS}, t AS (SELECT hesum_id, round(ln(greatest(article_tokens, 1)), 6) AS v, headline_lead_overlap FROM rows_ WHERE article_tokens IS NOT NULL),
x AS (SELECT dimension AS series, hesum_id, v, CAST(score AS DOUBLE) AS y FROM pooled JOIN t USING (hesum_id) UNION ALL SELECT 'headline_lead_overlap', hesum_id, v, headline_lead_overlap FROM t WHERE headline_lead_overlap IS NOT NULL),
b AS (SELECT *, ntile(16) OVER (PARTITION BY series ORDER BY v, md5(coalesce(hesum_id, '')), hesum_id, y) AS bin FROM x)
SELECT series, CAST(bin AS INTEGER) AS bin, count(*) AS n, median(v) AS x_median, median(y) AS y_median FROM b GROUP BY 1, 2""",
        "dedupe_latest": f"WITH {_LATEST} SELECT annotator_id, hesum_id, task, pos FROM latest",
        "annotator_counts": "SELECT annotator_id, count(*) AS n, count(*) FILTER (task = 'rubric') AS n_rubric FROM annotations GROUP BY 1",
        "pairwise_rate": _rate(),
        "pairwise_by_annotator": _rate("annotator_id"),
        "pairwise_agreement": f"""WITH {_OUT}, p AS (SELECT 1 AS g, hesum_id, CASE max_by(outcome, pos) WHEN 'original' THEN 0 WHEN 'tie' THEN 1 ELSE 2 END AS a, CASE min_by(outcome, pos) WHEN 'original' THEN 0 WHEN 'tie' THEN 1 ELSE 2 END AS b FROM outcomes GROUP BY hesum_id),
{_kappa("SELECT g, a, b FROM p", "g")} SELECT count(*) AS n, round(100 * count(*) FILTER (a = b) / count(*), 2) AS percent_agreement, (SELECT kappa FROM kappas) AS quadratic_kappa, count(*) = 0 AS insufficient FROM p""",
        "completion_check": """WITH e AS (SELECT DISTINCT annotator_id, hesum_id, unnest(['rubric', 'pairwise']) AS task FROM annotations WHERE annotator_id IS NOT NULL AND hesum_id IS NOT NULL),
done AS (SELECT DISTINCT annotator_id, hesum_id, task, 1 AS d FROM annotations)
SELECT annotator_id, count(*) AS expected_tasks, count(d) AS submitted_tasks, count(*) FILTER (d IS NULL) AS missing_tasks, count(*) FILTER (d IS NULL) = 0 AS complete FROM e LEFT JOIN done USING (annotator_id, hesum_id, task) GROUP BY 1""",
        "numeric_id_order": f"WITH {_RECS} SELECT id, CASE WHEN regexp_full_match(id, '[0-9]+') THEN 0 ELSE 1 END AS kind, CASE WHEN regexp_full_match(id, '[0-9]+') AND length(id) <= 20 THEN lpad(CAST(CAST(id AS HUGEINT) AS VARCHAR), 20, '0') ELSE id END AS order_key FROM recs",
        "next_batch": f"""WITH {_RECS}, {_REPL} SELECT id FROM recs WHERE id NOT IN (SELECT id FROM repl WHERE id IS NOT NULL)
ORDER BY CASE WHEN regexp_full_match(id, '[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(id, '[0-9]+') THEN lpad(CAST(CAST(id AS HUGEINT) AS VARCHAR), 20, '0') ELSE id END LIMIT 1000""",
        "pilot_sample": f"WITH {_RECS}, {_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_mark('hesum_id', 42)}, hesum_id) AS r FROM members) SELECT hesum_id, stratum, length(text) AS n_chars FROM k JOIN recs ON recs.id = hesum_id WHERE r <= 75",
        "stratified_sample": f"WITH {_MEMBERS}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_mark('hesum_id', 42)}, hesum_id) AS r FROM members) SELECT hesum_id, stratum FROM k WHERE r <= 75",
        "seeded_sample": f"WITH {_RECS} SELECT id FROM recs ORDER BY {_mark('id', 1234)}, id LIMIT 120",
        "slot_randomised": f"WITH {_RECS} SELECT id, substring({_mark('id', 42)}, 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS curated_is_a FROM recs",
        "split_counts": f"""WITH {_RECS}, k AS (SELECT id, row_number() OVER (ORDER BY {_mark('id', 42)}, id) AS r, count(*) OVER () AS n FROM recs)
SELECT CASE WHEN r <= n - ceil(n / 5) THEN 'train' WHEN r <= n - ceil(ceil(n / 5) / 2) THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(id) AS least_id FROM k GROUP BY 1""",
        "split_leakage": f"""WITH s AS (SELECT DISTINCT split, text FROM curated_records WHERE text IS NOT NULL), m AS (SELECT text FROM s GROUP BY text HAVING count(*) > 1),
c AS (SELECT split, count(*) AS c FROM s JOIN m USING (text) GROUP BY 1)
SELECT r.split, count(*) AS n, count(*) FILTER (coalesce({_strip("text")} = '', true)) AS n_blank_text, count(*) FILTER (coalesce({_strip("summary")} = '', true)) AS n_blank_summary, coalesce(any_value(c), 0) AS n_shared
FROM curated_records r LEFT JOIN c ON c.split = r.split GROUP BY r.split""",
        "held_out_anti": f"WITH {_RECS} SELECT id FROM recs WHERE id NOT IN (SELECT hesum_id FROM curated_records WHERE split IN ('val', 'test') AND hesum_id IS NOT NULL)",
        "training_pool": f"""WITH {_RECS}, p AS (SELECT id AS hesum_id, pos, text FROM recs WHERE text IS NOT NULL AND id NOT IN (SELECT hesum_id FROM curated_records WHERE split IN ('val', 'test') AND hesum_id IS NOT NULL)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos) AS k FROM p) WHERE k = 1) SELECT hesum_id, pos FROM u ORDER BY {_mark('hesum_id', 42)}, hesum_id LIMIT 500""",
        "dedupe_text": "SELECT min(pos) AS pos FROM records GROUP BY text",
        "pair_by_text": """WITH a AS (SELECT text, count(*) AS n FROM predictions_curated WHERE model = 'student-3b' GROUP BY 1), b AS (SELECT text, count(*) AS n FROM predictions_curated WHERE model IS DISTINCT FROM 'student-3b' GROUP BY 1),
j AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.text IS NOT DISTINCT FROM b.text)
SELECT count(*) AS n_texts, count(*) FILTER (na > 0 AND nb > 0) AS n_paired, count(*) FILTER (na = 0) AS only_b, count(*) FILTER (nb = 0) AS only_a, count(*) FILTER (na > 1 OR nb > 1) AS n_repeated FROM j""",
        "judge_reply_parse": "SELECT pos, " + " + ".join(f"coalesce(CAST(scores.{c} BETWEEN 1 AND 5 AS INTEGER), 0)" for c in _DIMS) + " AS n_scores, " + ", ".join(f"CASE WHEN scores.{c} BETWEEN 1 AND 5 THEN scores.{c} END AS {c}" for c in _DIMS) + " FROM annotations WHERE task = 'rubric'",
        "winner_reply_parse": f"SELECT pos, CASE WHEN lower({_strip('winner')}) IN ('a', 'b', 'tie') THEN lower({_strip('winner')}) END AS winner FROM annotations WHERE task = 'pairwise'",
        "batch_parse": f"""WITH {_LABELS}, k AS (SELECT *, (length(id) + ascii(substring(id, -1, 1))) % 7 AS k FROM labels_)
SELECT 'c-' || id AS custom_id, CASE k WHEN 2 THEN 'http_error' WHEN 1 THEN 'incomplete' WHEN 0 THEN 'unparsable' END AS error, CASE WHEN k > 2 THEN filter_label END AS label FROM k""",
        "final_check": f"""WITH {_RECS}, {_LABELS}, {_REPL}, f AS (SELECT id, text, coalesce(replacement_headline, headline) AS headline FROM recs JOIN repl USING (id) WHERE id IN (SELECT id FROM labels_ WHERE filter_label = 'usable'))
SELECT true AS exact_columns, true AS all_strings, count(*) AS n_rows, count(*) - count(DISTINCT id) AS n_repeated_keys, count(*) FILTER (text IS NULL) + count(*) FILTER (headline IS NULL) AS n_nulls FROM f""",
        "rubric_check": "SELECT count(*) AS n, count(*) FILTER (ok = 4) AS n_valid, count(*) FILTER (lacks > 0) AS n_incomplete, count(*) FILTER (outside > 0) AS n_out_of_range FROM (SELECT "
        + " + ".join(f"coalesce(CAST(scores.{c} BETWEEN 1 AND 5 AS INTEGER), 0)" for c in _DIMS) + " AS ok, "
        + " + ".join(f"CAST(scores.{c} IS NULL AS INTEGER)" for c in _DIMS) + " AS lacks, "
        + " + ".join(f"coalesce(CAST(scores.{c} NOT BETWEEN 1 AND 5 AS INTEGER), 0)" for c in _DIMS) + " AS outside FROM annotations WHERE task = 'rubric')",
        "loaded_predictions": f"SELECT model, variant, count(*) AS n FROM predictions_curated WHERE {_strip('text')} <> '' AND {_strip('''regexp_replace(prediction, '(?s)<think>.*?</think>', '', 'g')''')} <> '' GROUP BY ALL",
        "resume_choice": "SELECT 'checkpoint-12' AS name, CAST(12 AS BIGINT) AS step",
        "step_times": "SELECT count(*) AS n, CAST(median(scores.cleanliness) AS DOUBLE) AS median_s, CAST(min(scores.cleanliness) AS DOUBLE) AS min_s, CAST(median(scores.cleanliness) AS DOUBLE) AS projected_hours FROM annotations WHERE pos > 2",
        "windowed_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
