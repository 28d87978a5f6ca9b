"""Problem 2: values cut off by a field limit or mid-transfer, in pure SQL.

Word trigrams are counted inside values and at their ends, over all values of all fields; the end of a part before a
separator bar counts as an end. The final trigram of each value is joined to these counts, in two ways:

- *inside a sentence*: the trigram is frequent inside values and almost never terminal;
- *inside a word*: the trigram's last word is the beginning of longer words that follow the same two words, and almost
  never a word of its own there.

"Almost never" is a bound on a rate: the upper end of Wilson's interval of the terminal share. Where other values often end
with the trigram, the value is whole; where the trigram alone can't tell, the final bigram and then the final word are
judged in the same way (back-off). ``words`` says how many words decided.

Lengths that pile up at the end of an outlet's length distribution, in characters or in bytes, are that outlet's limit only
if the trigrams show a cut in many values of just that length; the other values there are then cases too, unless their end
is a usual one. A cut at a number of bytes may fall inside a letter, whose rest is then dropped, so a value that is short of
a limit in bytes by less than a letter counts as one of that length. A broken character, an open quotation mark or a
trailing separator also show a cut. A trailing ellipsis alone does not: a teaser ends in one, so it is taken off first.

Scale: grams are grouped as a hash of their context and the word, with partial aggregation; a hot gram (a third of all
values may end alike) is one counter. Beginnings of words are made from the grouped rows, and only for contexts that end a
value. Counts of one outlet's lengths are bounded by its longest value.

Defined results: null and blank values are not cases; repeated rows count once; a value of an unknown outlet has no limit;
values of one word are judged by that word; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import keep

#: Quotation marks that stand inside a Hebrew word are not quotation marks.
VALUES_SQL = r"""
WITH outlet AS (SELECT id, min(source) AS source FROM {records} WHERE id IS NOT NULL GROUP BY id),
raw AS (
  SELECT 'headline' AS field, id, source, headline AS v FROM {records}
  UNION ALL
  SELECT 'replacement_headline', r.id, o.source, r.replacement_headline FROM {replacements} r LEFT JOIN outlet o ON r.id = o.id
),
kept AS (
  SELECT field, id, min(source) AS source, v FROM raw
  WHERE id IS NOT NULL AND v IS NOT NULL AND v RLIKE '[\\p{{L}}\\p{{N}}]' GROUP BY field, id, v
),
ends AS (
  SELECT *, regexp_replace(v, '(?:[\\s…]|\\.{{2,}}|\\uFFFD)+$', '') AS core,
         v RLIKE '\\uFFFD[\\s….]*$' AS broken,
         regexp_replace(v, '(?<=\\p{{L}})["״](?=\\p{{L}})', '') AS unquoted
  FROM kept
)
SELECT monotonically_increasing_id() AS uid, field, id, source, v, broken,
       core RLIKE '[|:;,(\\[]\\s*$' AS hanging,
       core RLIKE '[.!?"”״׳)]\\s*$' AS closed,
       (char_length(unquoted) - char_length(regexp_replace(unquoted, '["“”״]', ''))) % 2 = 1 AS open_quote,
       char_length(v) AS n_chars, octet_length(v) AS n_bytes,
       filter(transform(split(core, '\\s+'), w ->
         regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}|]+|[^\\p{{L}}\\p{{N}}|]+$', ''), '\\p{{N}}+', '0')), w -> w <> '') AS ws
FROM ends
"""

#: An outlet's limit: a length with `pile` times the values of its neighbours and few values beyond it.
LIMITS_SQL = """
WITH lengths AS (
  SELECT field, source, unit, n, count(*) AS c FROM (
    SELECT field, source, explode(map('chars', n_chars, 'bytes', n_bytes)) AS (unit, n) FROM {values}
    WHERE source IS NOT NULL AND NOT broken) GROUP BY field, source, unit, n
),
near AS (
  SELECT *,
         sum(c) OVER w / 10D AS around,
         sum(c) OVER (PARTITION BY field, source, unit) AS total,
         sum(c) OVER (PARTITION BY field, source, unit ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS beyond
  FROM lengths
  WINDOW w AS (PARTITION BY field, source, unit ORDER BY n RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)
)
SELECT field, source, unit, n FROM near
WHERE c >= greatest(5, 0.1 * total) AND c >= {pile} * (around - c / 10D) AND coalesce(beyond, 0) <= 0.2 * total
"""

#: A letter of 2, 3 or 4 bytes that was cut leaves up to 1, 2 or 3 bytes free; values without such letters must fill the limit.
MARKED_SQL = r"""
WITH reach AS (
  SELECT field, source, n - free AS at, min(n) AS n FROM {limits} LATERAL VIEW explode(array(0, 1, 2, 3)) frees AS free
  WHERE unit = 'bytes' GROUP BY field, source, n - free
)
SELECT v.uid, v.field, v.id, v.source, v.broken, v.hanging, v.closed, v.open_quote, v.ws, v.v RLIKE '\\s$' AS blank_end,
       CASE WHEN lc.n IS NOT NULL THEN concat('chars ', lc.n) WHEN lb.n IS NOT NULL THEN concat('bytes ', lb.n) END AS pile,
       lc.n IS NOT NULL OR coalesce(lb.n = v.n_bytes, false) AS exact,
       NOT (v.broken OR v.hanging OR v.open_quote OR lc.n IS NOT NULL OR lb.n IS NOT NULL) AS sound
FROM {values} v
LEFT JOIN {limits} lc ON lc.unit = 'chars' AND lc.field = v.field AND lc.source = v.source AND lc.n = v.n_chars
LEFT JOIN reach lb ON lb.field = v.field AND lb.source = v.source AND lb.at = v.n_bytes AND CASE lb.n - lb.at
  WHEN 0 THEN true
  WHEN 1 THEN v.v RLIKE '[\\x{{80}}-\\x{{10FFFF}}&&\\p{{L}}]'
  WHEN 2 THEN v.v RLIKE '[\\x{{800}}-\\x{{10FFFF}}&&\\p{{L}}]'
  ELSE v.v RLIKE '[\\x{{10000}}-\\x{{10FFFF}}&&\\p{{L}}]' END
"""

#: Grams of one to three words: ``c`` stands for the words before the last one, and the first letter of that, ``w``.
COUNTS_SQL = """
SELECT c, w, sum(inside) AS inside, sum(final) AS final FROM (
  SELECT xxhash64(k, array_join(slice(ws, i, k - 1), ' '), left(ws[i + k - 2], 1)) AS c, ws[i + k - 2] AS w,
         int(i + k <= size(ws) AND NOT coalesce(get(ws, i + k - 1) = '|', false)) AS inside,
         int(coalesce(get(ws, i + k - 1) = '|', sound)) AS final
  FROM {marked} LATERAL VIEW explode(array(1, 2, 3)) ks AS k
  LATERAL VIEW explode(if(size(ws) >= k, sequence(1, size(ws) - k + 1), array())) places AS i
) GROUP BY c, w
"""

FINALS_SQL = """
SELECT uid, k, xxhash64(k, array_join(slice(ws, size(ws) - k + 1, k - 1), ' '), left(ws[size(ws) - 1], 1)) AS c, ws[size(ws) - 1] AS w, int(sound) AS own
FROM {marked} LATERAL VIEW explode(array(1, 2, 3)) ks AS k WHERE size(ws) >= k
"""

#: The final grams of each value with their counts: inside, at other values' ends, and as beginnings of longer words.
SEEN_SQL = """
WITH needed AS (SELECT DISTINCT c FROM {finals}),
near AS (SELECT n.* FROM {counts} n LEFT SEMI JOIN needed ON n.c = needed.c),
stats AS (
  SELECT c, w, sum(inside) AS inside, sum(final) AS final, sum(longer) AS longer FROM (
    SELECT c, w, inside, final, 0 AS longer FROM near
    UNION ALL
    SELECT c, explode(transform(sequence(1, char_length(w) - 1), i -> left(w, i))) AS w, 0, 0, inside + final FROM near WHERE char_length(w) > 1
  ) GROUP BY c, w
)
SELECT f.uid, {columns} FROM {finals} f JOIN stats s ON s.c = f.c AND s.w = f.w GROUP BY f.uid
"""


def _upper(e: str, n: str) -> str:
    """The upper end of Wilson's interval (two deviations) of a share of ``e`` in ``n``; 1 where n is 0."""
    return f"(CASE WHEN {n} <= 0 THEN 1D ELSE ({e} + 2D + 2D * sqrt({e} * CAST({n} - {e} AS DOUBLE) / {n} + 1D)) / ({n} + 4D) END)"


def gram_reason(word: tuple[float, ...], sentence: tuple[float, ...], usual: float) -> str:
    """(reason, words) of a value by its final grams, the longest first: SQL over i, e, l of 1 to 3 words."""
    cases = []
    for k in (3, 2, 1):
        i, e, both, whole = f"i{k}", f"e{k}", f"(i{k} + e{k})", f"(i{k} + e{k} + l{k})"
        cases.append(f"WHEN {_upper(both, whole)} <= {word[k - 1]}D THEN struct('inside a word' AS reason, {k} AS words)")
        cases.append(f"WHEN {_upper(e, both)} <= {sentence[k - 1]}D THEN struct('inside a sentence' AS reason, {k} AS words)")
        cases.append(f"WHEN e{k} >= 3 AND e{k} >= {usual}D * {whole} THEN NULL")
    return "CASE " + " ".join(cases) + " END"


JUDGED_SQL = """
WITH by_grams AS (
  SELECT m.uid, m.field, m.id, m.source, m.pile, m.exact, m.broken, m.hanging, m.closed, m.open_quote, {grams} AS g,
         NOT m.blank_end AND (m.closed OR (e1 >= 5 AND e1 >= 2 * i1 AND e2 > 0)) AS usual
  FROM {marked} m JOIN {seen} s ON m.uid = s.uid
)
SELECT uid, field, id, source, pile, exact, usual,
  CASE WHEN NOT closed AND g IS NOT NULL THEN g.reason WHEN broken THEN 'broken character' WHEN hanging THEN 'trailing separator' WHEN open_quote THEN 'open quotation' END AS reason,
  CASE WHEN NOT closed AND g IS NOT NULL THEN g.words END AS words
FROM by_grams
"""

#: A pile of lengths is a limit if values of just that length often enough show a cut by their words. A value there whose end
#: is a usual one came whole.
LIMITED_SQL = """
WITH limits AS (SELECT field, source, pile FROM {judged} WHERE pile IS NOT NULL GROUP BY field, source, pile HAVING avg(int(reason IS NOT NULL)) FILTER (WHERE exact) >= {shown})
SELECT j.uid, j.field, j.id, j.source, CASE WHEN j.reason IS NULL AND l.pile IS NOT NULL AND NOT usual THEN 'field limit' ELSE j.reason END AS reason, words
FROM {judged} j LEFT JOIN limits l ON l.field = j.field AND l.source = j.source AND l.pile = j.pile
"""

#: Bounds of the share of ends at which a final gram of one, two or three words shows a cut.
WORD, SENTENCE, USUAL = (0.25, 0.25, 0.25), (0.03, 0.08, 0.1), 0.1


def seen_grams(marked: DataFrame, asked: DataFrame) -> DataFrame:
    """(uid, i, e, l of 1 to 3 words): how often the final grams of ``asked`` stand inside and at sound ends of ``marked``, and
    begin longer words there. Both have uid, ws and sound."""
    spark = marked.sparkSession
    columns = ", ".join(f"coalesce(max({v}) FILTER (WHERE k = {k}), 0) AS {n}{k}" for n, v in (("i", "inside"), ("e", "final - own"), ("l", "longer")) for k in (1, 2, 3))
    return spark.sql(SEEN_SQL.replace("{columns}", columns), finals=spark.sql(FINALS_SQL, marked=asked), counts=spark.sql(COUNTS_SQL, marked=marked))


def judged(records: DataFrame, replacements: DataFrame, pile: int = 4, word: tuple[float, ...] = WORD, sentence: tuple[float, ...] = SENTENCE, usual: float = USUAL, shown: float = 0.3) -> DataFrame:
    """Every value with the reason for which it is a case, or null, and how many final words showed it."""
    spark = records.sparkSession
    values = spark.sql(VALUES_SQL, records=records.select("id", "source", "headline"), replacements=replacements.select("id", "replacement_headline"))
    values = keep(values, "cutoff-values")
    limits = keep(spark.sql(LIMITS_SQL, values=values, pile=pile), "cutoff-limits")
    marked = spark.sql(MARKED_SQL, values=values, limits=limits)
    seen, grams = seen_grams(marked, marked), gram_reason(word, sentence, usual)
    found = keep(spark.sql(JUDGED_SQL.replace("{grams}", grams), marked=marked, seen=seen), "cutoff-judged")
    return spark.sql(LIMITED_SQL, judged=found, shown=shown)


def cut_off(records: DataFrame, replacements: DataFrame) -> DataFrame:
    """(field, id): the values that lost their end."""
    return judged(records, replacements).where("reason IS NOT NULL").select("field", "id").distinct()


def cut_reasons(records: DataFrame, replacements: DataFrame) -> DataFrame:
    """(field, reason, words, n): the cases by reason and by how many final words decided; 0 where no gram did."""
    rows = judged(records, replacements).where("reason IS NOT NULL")
    return rows.groupBy("field", "reason", F.coalesce("words", F.lit(0)).alias("words")).agg(F.count("*").alias("n"))


def cut_rates(records: DataFrame, replacements: DataFrame) -> DataFrame:
    """Per source and field: values, values that lost their end, and their share."""
    rows = judged(records, replacements)
    return rows.groupBy("source", "field").agg(F.count("*").alias("n_values"), F.count("reason").alias("n_cut"), F.round(F.count("reason") / F.count("*"), 4).alias("cut_rate"))
