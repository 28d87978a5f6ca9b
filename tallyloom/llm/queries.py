"""The queries of the training-data operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import answers, bytebpe, consensus, crosssplit, cutoff, leak, moderation, neardup, quota
from tallyloom.session import table as t

FLAG_AT = 0.5


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    members, pairs = crosssplit.cross_split(crosssplit.sides_of(t(s, d, "curated_records"), t(s, d, "predictions_curated")), crosssplit.ARTICLES)
    return crosssplit.overlaps(members, pairs)


def _headlines(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t(s, d, "records"), t(s, d, "headline_target_curation_results")


def _quota(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t(s, d, "row_labels"), t(s, d, "sample_targets")


def _docs_items(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t(s, d, "documents"), t(s, d, "eval_items")


def _docs_samples(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t(s, d, "documents"), t(s, d, "moderation_samples")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: neardup.near_duplicate_pairs(t(s, d, "records"), p=neardup.ARTICLES).select("pos_a", "pos_b"),
        "p1_groups": lambda s, d: neardup.near_duplicate_groups(t(s, d, "records"), p=neardup.ARTICLES),
        "p2_found": lambda s, d: cutoff.cut_off(*_headlines(s, d)),
        "p2_rates": lambda s, d: cutoff.cut_rates(*_headlines(s, d)),
        "p2_reasons": lambda s, d: cutoff.cut_reasons(*_headlines(s, d)),
        "p3_found": lambda s, d: answers.defects(t(s, d, "predictions_curated")),
        "p3_reasons": lambda s, d: answers.defect_reasons(t(s, d, "predictions_curated")),
        "p3_rates": lambda s, d: answers.defect_rates(t(s, d, "predictions_curated")),
        "p4_found": lambda s, d: quota.report(*_quota(s, d)).where("drawn < need AND NOT can_be_met").select("target_id"),
        "p4_report": lambda s, d: quota.report(*_quota(s, d)),
        "p4_sample": lambda s, d: quota.draw(*_quota(s, d)),
        "p5_found": lambda s, d: _overlaps(s, d).select("split", "eval_key", "train_id"),
        "p5_report": lambda s, d: crosssplit.split_report(t(s, d, "curated_records"), t(s, d, "predictions_curated")),
        "p5_rates": lambda s, d: crosssplit.split_rates(t(s, d, "curated_records"), t(s, d, "predictions_curated")),
        "p6_found": lambda s, d: consensus.consensus(t(s, d, "annotations")).select("hesum_id", "task", "label"),
        "p6_items": lambda s, d: consensus.consensus(t(s, d, "annotations")),
        "p6_annotators": lambda s, d: consensus.reliability(t(s, d, "annotations")),
        "p7_ids": lambda s, d: bytebpe.encode(t(s, d, "documents")),
        "p7_rates": lambda s, d: bytebpe.token_rates(t(s, d, "documents")),
        "p8_found": lambda s, d: leak.leaks(*_docs_items(s, d)),
        "p8_passages": lambda s, d: leak.passages(*_docs_items(s, d)),
        "p8_items": lambda s, d: leak.item_report(*_docs_items(s, d)),
        "p9_found": lambda s, d: moderation.scores(*_docs_samples(s, d)).where(F.col("score") >= FLAG_AT).select("doc_id"),
        "p9_scores": lambda s, d: moderation.scores(*_docs_samples(s, d)),
        "p9_rates": lambda s, d: moderation.source_rates(*_docs_samples(s, d), threshold=FLAG_AT),
    }


_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '[\p{M}\p{Cf}]', '', 'g')), '[\p{L}\p{N}]+')"
_TRIGRAMS = "unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g"
_PAIRS = f"""w AS (SELECT pos, {_WORDS} AS ws FROM records WHERE text IS NOT NULL),
g AS (SELECT DISTINCT pos, {_TRIGRAMS} FROM w WHERE len(ws) >= 30),
n AS (SELECT pos, count(*) AS n FROM g GROUP BY pos),
pairs AS (SELECT a.pos AS pos_a, b.pos AS pos_b FROM g a JOIN g b ON a.g = b.g AND a.pos < b.pos JOIN n na ON na.pos = a.pos JOIN n nb ON nb.pos = b.pos
  GROUP BY a.pos, b.pos, na.n, nb.n HAVING 2 * count(*) >= na.n + nb.n - count(*))"""
_QUOTA = """
WITH held AS (SELECT source_label, headline_action, multi_pipe, count(DISTINCT hesum_id) AS available FROM row_labels WHERE hesum_id IS NOT NULL GROUP BY ALL),
size AS (SELECT CAST(floor(count(DISTINCT hesum_id) / 10) AS BIGINT) AS n FROM row_labels),
quota AS (
  SELECT t.target_id, t.source_label, t.headline_action, t.multi_pipe, CAST(greatest(coalesce(target_pct, 0), 0) AS BIGINT) AS pct, n,
         coalesce(available, 0) AS available,
         CAST(greatest(greatest(coalesce(min_rows, 0), 0), floor(greatest(coalesce(target_pct, 0), 0) * n / 100)) AS BIGINT) AS need
  FROM sample_targets t CROSS JOIN size LEFT JOIN held h ON t.source_label IS NOT DISTINCT FROM h.source_label
    AND t.headline_action IS NOT DISTINCT FROM h.headline_action AND t.multi_pipe IS NOT DISTINCT FROM h.multi_pipe
),
mine AS (
  SELECT r.hesum_id, min(target_id) AS target_id FROM row_labels r JOIN quota q ON r.source_label IS NOT DISTINCT FROM q.source_label
    AND r.headline_action IS NOT DISTINCT FROM q.headline_action AND r.multi_pipe IS NOT DISTINCT FROM q.multi_pipe
  WHERE r.hesum_id IS NOT NULL GROUP BY r.hesum_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY md5('4:' || hesum_id), hesum_id) AS place, count(*) OVER (PARTITION BY target_id) AS size FROM mine),
w AS (SELECT target_id, any_value(need) AS need, any_value(size) AS size, least(any_value(pct * n), 100 * any_value(size)) AS w FROM quota JOIN ranked USING (target_id) GROUP BY target_id),
s AS (SELECT *, coalesce(sum(w) OVER (ORDER BY target_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
hit AS (
  SELECT r.hesum_id, r.target_id, place, need, ((s + 63) * s.size + w * place) // (100 * s.size) > ((s + 63) * s.size + w * (place - 1)) // (100 * s.size) AS hit
  FROM ranked r JOIN s ON r.target_id = s.target_id
),
got AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY target_id) AS got, row_number() OVER (PARTITION BY target_id, hit ORDER BY place) AS k FROM hit),
drawn AS (SELECT hesum_id, target_id, NOT hit AS repaired FROM got WHERE hit OR k <= need - got)
"""


_NEAR = f"""
WITH r AS (
  SELECT split, hesum_id AS key, text FROM curated_records WHERE split IN ('train', 'val', 'test')
  UNION ALL SELECT 'predictions', CAST(pos AS VARCHAR), text FROM predictions_curated),
w AS (SELECT text, {_WORDS} AS ws FROM (SELECT DISTINCT text FROM r WHERE text IS NOT NULL)),
g AS (SELECT DISTINCT text, {_TRIGRAMS} FROM w WHERE len(ws) >= 3),
n AS (SELECT text, count(*) AS n FROM g GROUP BY text),
t AS (SELECT DISTINCT text FROM r WHERE split = 'train'), e AS (SELECT DISTINCT text FROM r WHERE split <> 'train'),
near AS (
  SELECT a.text AS et, b.text AS tt, count(*) / (na.n + nb.n - count(*)) AS similarity FROM g a JOIN g b ON a.g = b.g JOIN n na ON na.text = a.text JOIN n nb ON nb.text = b.text
  WHERE a.text IN (SELECT text FROM e) AND b.text IN (SELECT text FROM t)
  GROUP BY a.text, b.text, na.n, nb.n HAVING 2 * count(*) >= na.n + nb.n - count(*))
"""


def _upper(e: str, n: str) -> str:
    """Wilson's upper bound, two deviations."""
    return f"(CASE WHEN {n} <= 0 THEN 1 ELSE ({e} + 2 + 2 * sqrt({e} * ({n} - {e}) / {n} + 1)) / ({n} + 4) END)"


def _cut_sql() -> str:
    """Problem 2 in DuckDB's SQL, up to a table ``cut`` (uid, field, id, source, reason, words)."""
    blank = r"[ \t\n\r\f\x0b]"
    cases = []
    for k, word, sentence in ((3, 0.25, 0.1), (2, 0.25, 0.08), (1, 0.25, 0.03)):
        part, whole = f"(i{k} + e{k})", f"(i{k} + e{k} + l{k})"
        cases.append(f"WHEN {_upper(part, whole)} <= {word} THEN 'inside a word {k}' WHEN {_upper(f'e{k}', part)} <= {sentence} THEN 'inside a sentence {k}' WHEN e{k} >= 3 AND e{k} >= 0.1 * {whole} THEN NULL")
    columns = ", ".join(f"coalesce(max({v}) FILTER (k = {k}), 0) AS {n}{k}" for n, v in (("i", "inside"), ("e", "final - own"), ("l", "longer")) for k in (1, 2, 3))
    return rf"""
WITH outlet AS (SELECT id, min(source) AS source FROM records WHERE id IS NOT NULL GROUP BY id),
raw AS (
  SELECT 'headline' AS field, id, source, headline AS v FROM records
  UNION ALL SELECT 'replacement_headline', r.id, o.source, r.replacement_headline FROM headline_target_curation_results r LEFT JOIN outlet o ON r.id = o.id),
kept AS (SELECT row_number() OVER () AS uid, field, id, min(source) AS source, v FROM raw WHERE id IS NOT NULL AND v IS NOT NULL AND regexp_matches(v, '[\p{{L}}\p{{N}}]') GROUP BY field, id, v),
ends AS (
  SELECT *, regexp_replace(v, '(?:[ \t\n\r\f\x0b…]|\.{{2,}}|\x{{FFFD}})+$', '') AS core, regexp_matches(v, '\x{{FFFD}}[ \t\n\r\f\x0b….]*$') AS broken,
         regexp_replace(regexp_replace(v, '(\p{{L}})["״](\p{{L}})', '\1\2', 'g'), '(\p{{L}})["״](\p{{L}})', '\1\2', 'g') AS unquoted FROM kept),
vals AS (
  SELECT uid, field, id, source, v, broken, regexp_matches(core, '[|:;,(\[]{blank}*$') AS hanging, regexp_matches(core, '[.!?"”״׳)]{blank}*$') AS closed,
         (length(unquoted) - length(regexp_replace(unquoted, '["“”״]', '', 'g'))) % 2 = 1 AS open_quote, length(v) AS n_chars, strlen(v) AS n_bytes, regexp_matches(v, '{blank}$') AS blank_end,
         list_filter(list_transform(regexp_split_to_array(core, '{blank}+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}|]+|[^\p{{L}}\p{{N}}|]+$', '', 'g'), '\p{{N}}+', '0', 'g')), lambda w: w <> '') AS ws FROM ends),
lengths AS (
  SELECT field, source, unit, n, count(*) AS c FROM (SELECT field, source, 'chars' AS unit, n_chars AS n, broken FROM vals UNION ALL SELECT field, source, 'bytes', n_bytes, broken FROM vals)
  WHERE source IS NOT NULL AND NOT broken GROUP BY ALL),
near AS (
  SELECT *, sum(c) OVER (PARTITION BY field, source, unit ORDER BY n RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 10.0 AS around, sum(c) OVER (PARTITION BY field, source, unit) AS total,
         sum(c) OVER (PARTITION BY field, source, unit ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beyond FROM lengths),
piles AS (SELECT field, source, unit, n FROM near WHERE c >= greatest(5, 0.1 * total) AND c >= 4 * (around - c / 10.0) AND coalesce(beyond, 0) <= 0.2 * total),
reach AS (SELECT field, source, n - free AS at, min(n) AS n FROM piles, (SELECT unnest([0, 1, 2, 3]) AS free) WHERE unit = 'bytes' GROUP BY ALL),
marked AS (
  SELECT v.*, CASE WHEN lc.n IS NOT NULL THEN 'chars ' || lc.n WHEN lb.n IS NOT NULL THEN 'bytes ' || lb.n END AS pile, lc.n IS NOT NULL OR coalesce(lb.n = v.n_bytes, false) AS exact,
         NOT (broken OR hanging OR open_quote OR lc.n IS NOT NULL OR lb.n IS NOT NULL) AS sound
  FROM vals v LEFT JOIN piles lc ON lc.unit = 'chars' AND lc.field = v.field AND lc.source = v.source AND lc.n = v.n_chars
  LEFT JOIN reach lb ON lb.field = v.field AND lb.source = v.source AND lb.at = v.n_bytes
    AND (lb.n = lb.at OR len(list_filter(regexp_extract_all(v.v, '\p{{L}}'), lambda c: strlen(c) > lb.n - lb.at)) > 0)),
places AS (SELECT ws, k, unnest(range(1, len(ws) - k + 2)) AS i, sound FROM marked, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
counts AS (
  SELECT k, array_to_string(ws[i:i + k - 2], ' ') AS c, ws[i + k - 1] AS w, count(*) FILTER (i + k <= len(ws) AND NOT coalesce(ws[i + k] = '|', false)) AS inside,
         count(*) FILTER (coalesce(ws[i + k] = '|', sound)) AS final FROM places GROUP BY ALL),
beginnings AS (SELECT k, c, w, sum(n) AS longer FROM (SELECT k, c, inside + final AS n, unnest(list_transform(range(1, length(w)), lambda j: left(w, j))) AS w FROM counts) GROUP BY ALL),
finals AS (SELECT uid, k, array_to_string(ws[len(ws) - k + 1:len(ws) - 1], ' ') AS c, ws[len(ws)] AS w, sound::INT AS own FROM marked, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
seen AS (SELECT uid, {columns} FROM finals f JOIN counts USING (k, c, w) LEFT JOIN beginnings USING (k, c, w) GROUP BY uid),
graded AS (SELECT m.*, CASE WHEN NOT closed THEN CASE {" ".join(cases)} END END AS g, NOT blank_end AND (closed OR (e1 >= 5 AND e1 >= 2 * i1 AND e2 > 0)) AS usual FROM marked m JOIN seen USING (uid)),
judged AS (SELECT *, CASE WHEN g IS NOT NULL THEN left(g, length(g) - 2) WHEN broken THEN 'broken character' WHEN hanging THEN 'trailing separator' WHEN open_quote THEN 'open quotation' END AS reason0 FROM graded),
limits AS (SELECT field, source, pile FROM judged WHERE pile IS NOT NULL GROUP BY ALL HAVING avg((reason0 IS NOT NULL)::INT) FILTER (exact) >= 0.3),
cut AS (
  SELECT j.uid, j.field, j.id, j.source, CASE WHEN reason0 IS NULL AND l.pile IS NOT NULL AND NOT usual THEN 'field limit' ELSE reason0 END AS reason, CAST(coalesce(right(g, 1), '0') AS INT) AS words
  FROM judged j LEFT JOIN limits l ON l.field = j.field AND l.source = j.source AND l.pile = j.pile)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_PAIRS} SELECT pos_a, pos_b FROM pairs",
        "p1_groups": f"""WITH RECURSIVE {_PAIRS},
links AS (SELECT pos_a AS a, pos_b AS b FROM pairs UNION SELECT pos_b, pos_a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT pos, least(pos, coalesce(low.b, pos)) AS "group", coalesce(n, 0) AS n_links FROM records LEFT JOIN low ON low.a = pos LEFT JOIN degree ON degree.a = pos""",
        "p2_found": _cut_sql() + "SELECT DISTINCT field, id FROM cut WHERE reason IS NOT NULL",
        "p2_rates": _cut_sql() + "SELECT source, field, count(*) AS n_values, count(reason) AS n_cut, round(count(reason) / count(*), 4) AS cut_rate FROM cut GROUP BY source, field",
        "p2_reasons": _cut_sql() + "SELECT field, reason, words, count(*) AS n FROM cut WHERE reason IS NOT NULL GROUP BY ALL",
        "p4_found": _QUOTA + "SELECT target_id FROM quota WHERE available < need",
        "p4_report": _QUOTA
        + """SELECT q.target_id, pct, need, available, count(d.target_id) AS drawn, count(*) FILTER (d.repaired) AS repaired, available >= need AS can_be_met
FROM quota q LEFT JOIN drawn d ON q.target_id = d.target_id GROUP BY q.target_id, pct, need, available""",
        "p4_sample": _QUOTA + "SELECT * FROM drawn",
        "p5_found": _NEAR + """SELECT DISTINCT x.split, x.key AS eval_key, y.key AS train_id FROM near JOIN r x ON x.text = et AND x.split <> 'train' JOIN r y ON y.text = tt AND y.split = 'train'
WHERE x.key IS NOT NULL AND y.key IS NOT NULL""",
        "p5_report": _NEAR + """, found AS (SELECT x.split, x.key AS eval_key, y.key AS train_id, max(similarity) AS similarity FROM near JOIN r x ON x.text = et AND x.split <> 'train' JOIN r y ON y.text = tt AND y.split = 'train'
WHERE x.key IS NOT NULL AND y.key IS NOT NULL GROUP BY ALL), src AS (SELECT DISTINCT hesum_id, source FROM curated_records WHERE split = 'train')
SELECT split, source, count(DISTINCT eval_key) AS n_eval, count(DISTINCT train_id) AS n_train, count(*) FILTER (similarity >= 1) AS n_exact, count(*) FILTER (similarity < 1) AS n_near FROM found JOIN src ON hesum_id = train_id GROUP BY ALL""",
        "p5_rates": _NEAR + """, found AS (SELECT DISTINCT x.split, x.key AS eval_key, y.key AS train_id FROM near JOIN r x ON x.text = et AND x.split <> 'train' JOIN r y ON y.text = tt AND y.split = 'train'
WHERE x.key IS NOT NULL AND y.key IS NOT NULL), hit AS (SELECT split, eval_key AS key FROM found UNION SELECT 'train', train_id FROM found),
own AS (SELECT DISTINCT split, hesum_id AS key, source, text FROM curated_records WHERE split IN ('train', 'val', 'test') AND hesum_id IS NOT NULL),
k AS (SELECT DISTINCT split, key, source FROM own UNION ALL
  SELECT 'predictions', CAST(pos AS VARCHAR), min(o.source) FROM predictions_curated p LEFT JOIN own o ON o.split = 'test' AND o.text = p.text WHERE pos IS NOT NULL GROUP BY pos)
SELECT k.split, source, count(DISTINCT k.key) AS n_keys, count(DISTINCT hit.key) AS n_overlapping, round(count(DISTINCT hit.key) / count(DISTINCT k.key), 4) AS rate
FROM k LEFT JOIN hit ON hit.split = k.split AND hit.key = k.key GROUP BY k.split, source""",
        "p8_items": f"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(1, len(ws) - 10)) AS k, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM d WHERE len(ws) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i WHERE len(ws) >= 12),
hit AS (SELECT DISTINCT doc_id, item_id, k FROM dg JOIN ig USING (g)),
new AS (SELECT *, coalesce(k - lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) > 12, false)::INT AS new FROM hit),
part AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS part FROM new),
passage AS (SELECT doc_id, item_id, max(k) - min(k) + 12 AS n_words FROM part GROUP BY doc_id, item_id, part)
SELECT p.item_id, e.split, count(DISTINCT p.doc_id) AS n_docs, count(DISTINCT d.source) AS n_sources, max(n_words) AS longest
FROM passage p JOIN d USING (doc_id) JOIN (SELECT DISTINCT item_id, split FROM eval_items) e USING (item_id) GROUP BY p.item_id, e.split""",
        "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS ws FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM d WHERE len(ws) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) AS g FROM i WHERE len(ws) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
