"""Text column functions. All take and return columns and stay in the JVM unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship

#: The Hebrew block, the delimiters of coarse tokens, the white space that a strip takes off.
SCRIPT = r"\x{590}-\x{5FF}"
DELIMITERS = "[ \n\r\t]"
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Last words that show a cut headline.
DANGLING = ("של", "עם", "אל", "כי", "אשר", "וכן", "וגם", "אבל", "או", "גם", "רק")
#: Endings that rule a cut out.
CLOSING = (".", "!", "?", '"', "”", "׳")
LEAD_WORDS, LIGHT_EDIT, BOILERPLATE = 50, 0.5, 0.8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Both ends without any Unicode white space."""
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def rstrip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"{SPACE}+$", "")


def clean_nullable(x: Column | str) -> Column:
    """Stripped text; blank becomes null."""
    return F.nullif(strip(x), F.lit(""))


def script_words(x: Column | str, script: str = SCRIPT) -> Column:
    """Words of one script: the script's characters of each coarse token, empty ones left out. A null text has none.

    Other characters but delimiters go first, in one pass over the text.
    """
    plain = F.regexp_replace(F.coalesce(_c(x), F.lit("")), f"[^{script} \n\r\t]+", "")
    return F.filter(F.split(plain, f"{DELIMITERS}+", -1), lambda w: w != "")


def count_pipes(x: Column | str) -> Column:
    return F.char_length(_c(x)) - F.char_length(F.replace(_c(x), F.lit("|"), F.lit("")))


def token_count(x: Column | str, pattern: str = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]") -> Column:
    """The default token counter: words and single other characters. A null text has none."""
    return F.coalesce(F.regexp_count(_c(x), F.lit(pattern)), F.lit(0))


def truncate_tokens(x: Column | str, n: int) -> Column:
    """The first ``n`` blank-separated tokens."""
    return F.array_join(F.slice(F.split(_c(x), " ", -1), 1, n), " ")


def prefix(x: Column | str, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(_c(x), 1, n)


def lead_overlap(text: Column | str, headline: Column | str, n: int = LEAD_WORDS, script: str = SCRIPT) -> Column:
    """Share of the headline's distinct words among the article's first ``n`` words, to 4 places; 0 without words."""
    h = F.array_distinct(script_words(headline, script))
    lead = F.slice(script_words(text, script), 1, n)
    return F.when(F.size(h) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(h, lead)) / F.size(h), 4))


def classify_edit(original: Column | str, replacement: Column | str, script: str = SCRIPT) -> Column:
    """The kind of a headline's repair; the first that fits. Null where either side is null."""
    o, r = _c(original), _c(replacement)
    ow, rw = script_words(o, script), script_words(r, script)
    union, both = F.size(F.array_union(ow, rw)), F.size(F.array_intersect(ow, rw))
    jaccard = F.when(union == 0, F.lit(0.0)).otherwise(both / union)
    end, trimmed = rstrip(o), strip(r)
    closed = F.lit(False)
    for mark in CLOSING:
        closed = closed | end.endswith(F.lit(mark))
    cut = end.endswith(F.lit("...")) | end.endswith(F.lit("…")) | F.coalesce(F.try_element_at(ow, F.lit(-1)).isin(*DANGLING), F.lit(False))
    kind = (
        F.when((count_pipes(o) > 0) & (count_pipes(r) == 0), "pipes_removed")
        .when((F.size(rw) < F.size(ow)) & (((trimmed != "") & F.contains(o, trimmed)) | (jaccard >= BOILERPLATE)), "boilerplate_stripped")
        .when(~closed & cut, "truncation_repaired")
        .when(jaccard >= LIGHT_EDIT, "light_edit")
        .otherwise("full_rewrite")
    )
    return F.when(o.isNotNull() & r.isNotNull(), kind)


def strip_think(x: Column | str) -> Column:
    """Closed reasoning blocks taken off, then stripped."""
    return strip(F.regexp_replace(_c(x), r"(?s)<think>.*?</think>", ""))


def gap_is_metadata(x: Column | str) -> Column:
    """Whether text between words looks like scraped metadata: a Latin letter or digit and a closing mark."""
    return _c(x).rlike("[A-Za-z0-9]") & _c(x).rlike(r"[.!?;:)\]}]")


def numeric_order(x: Column | str) -> list[Column]:
    """Sort keys: decimal ids first, by value, then others as text."""
    x = _c(x)
    digits = x.rlike("^[0-9]+$")
    value = F.lpad(F.regexp_replace(x, "^0+(?=[0-9])", ""), 20, "0")
    return [F.when(digits, 0).otherwise(1), F.when(digits & (F.char_length(x) <= 20), value).otherwise(x)]


def checkpoint_step(x: Column | str) -> Column:
    """N of checkpoint-N, else -1."""
    found = F.regexp_extract(_c(x), "checkpoint-([0-9]+)$", 1)
    return F.when(found == "", -1).otherwise(F.try_to_number(found, F.lit("9" * 18))).cast("bigint")


def arm_of(winner: Column | str, curated_is_a: Column | str, other: str = "original") -> Column:
    """The arm that a blind letter means."""
    w, a = _c(winner), _c(curated_is_a)
    return F.when(w == "tie", "tie").when((w == "a") == a, "curated").otherwise(other)


def fill(template: str, **columns: Column | str) -> Column:
    """A prompt: a template whose {names} are columns. Literal parts are built once; a null column gives null."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(_c(columns[name]))
    return F.concat(*parts)


def spans_of(text: str, keep=lambda c: "֐" <= c <= "׿") -> tuple[list[str], list[tuple[int, int]]]:
    """Script words with [start of the coarse token, end of the last script character)."""
    words, spans, at = [], [], 0
    for token in _tokens(text):
        chosen = [i for i, c in enumerate(token) if keep(c)]
        if chosen:
            words.append("".join(token[i] for i in chosen))
            spans.append((at, at + chosen[-1] + 1))
        at += len(token) + 1
    return words, spans


def _tokens(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")


def word_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, word, start, end) of every script word; an Arrow pass, linear in the text."""
    ship(df.sparkSession)
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, place, word, start, end = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w, s = spans_of(t or "")
                keys += [k] * len(w)
                place += range(1, len(w) + 1)
                word += w
                start += [a for a, _ in s]
                end += [b for _, b in s]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(place, pa.int32()), pa.array(word, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["key", "place", "word", "start", "end"])

    return picked.mapInArrow(run, f"key {kind}, place int, word string, start int, end int").withColumnRenamed("key", key)


def register(spark) -> None:
    """SQL names for the functions that queries use most: script_words, lead_overlap, classify_edit, token_count."""
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION tl_script_words(t STRING) RETURNS ARRAY<STRING> RETURN
        filter(transform(split(coalesce(t, ''), '[ \n\r\t]', -1), w -> regexp_replace(w, '[^{SCRIPT.replace(chr(92), chr(92) * 2)}]', '')), w -> w <> '')""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tl_pipes(t STRING) RETURNS INT RETURN char_length(t) - char_length(replace(t, '|', ''))")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION tl_token_count(t STRING) RETURNS INT RETURN coalesce(regexp_count(t, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'), 0)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION tl_lead_overlap(t STRING, h STRING) RETURNS DOUBLE RETURN
        CASE WHEN size(tl_script_words(h)) = 0 THEN 0D ELSE round(size(array_intersect(array_distinct(tl_script_words(h)), slice(tl_script_words(t), 1, 50))) / size(array_distinct(tl_script_words(h))), 4) END""")
