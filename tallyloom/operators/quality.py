"""Validation as one-row aggregates, and replies of external models as parsed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.schemas import DIMENSIONS, LEVELS, WINNERS


def check_final(df: DataFrame, columns: tuple[str, ...] = ("hesum_id", "text", "headline"), key: str = "hesum_id") -> DataFrame:
    """One row: whether columns are exactly these, all strings, without nulls, and keys unique."""
    exact = tuple(df.columns) == columns
    strings = all(t == "string" for _, t in df.dtypes)
    per_key = df.groupBy(key).agg(F.count("*").alias("c"), *(F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in df.columns if c != key))
    nulls = F.sum(sum((F.col(f"_{c}") for c in df.columns if c != key), F.lit(0)))
    return per_key.agg(
        F.lit(exact).alias("exact_columns"), F.lit(strings).alias("all_strings"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("c") > 1).alias("n_repeated_keys"), (F.coalesce(nulls, F.lit(0)) + F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c"))), F.lit(0))).cast("bigint").alias("n_nulls"),
    )


def check_splits(df: DataFrame, text: str = "text", summary: str = "summary") -> DataFrame:
    """(split, n, n_blank_text, n_blank_summary, n_shared): n_shared counts the split's distinct texts that other splits hold too."""
    blank = lambda c: F.coalesce(X.strip(c) == "", F.lit(True))
    per = df.groupBy("split").agg(F.count("*").alias("n"), F.count_if(blank(text)).alias("n_blank_text"), F.count_if(blank(summary)).alias("n_blank_summary"))
    where = df.where(F.col(text).isNotNull()).select("split", F.sha2(F.col(text), 256).alias("d")).distinct()
    shared = where.groupBy("d").agg(F.collect_set("split").alias("s")).where(F.size("s") > 1).select(F.explode("s").alias("_s")).groupBy("_s").agg(F.count("*").alias("c"))
    return per.join(shared, F.col("split") == F.col("_s"), "left").select("split", "n", "n_blank_text", "n_blank_summary", F.coalesce("c", F.lit(0)).alias("n_shared"))


def check_rubric(df: DataFrame, scores: str = "scores") -> DataFrame:
    """One row: rubric rows, rows with all four scores from 1 to 5, rows that lack one, rows out of range."""
    each = [F.col(f"{scores}.{d}") for d in DIMENSIONS]
    lacks = F.lit(False)
    outside = F.lit(False)
    for c in each:
        lacks = lacks | c.isNull()
        outside = outside | F.coalesce(~c.between(min(LEVELS), max(LEVELS)), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(~lacks & ~outside).alias("n_valid"), F.count_if(lacks).alias("n_incomplete"), F.count_if(outside).alias("n_out_of_range"))


def check_enum(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(value, n) of values that aren't allowed; null counts as one."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


# ---- replies ----


def reply_object(raw: Column | str) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def parse_rubric(raw: Column | str) -> Column:
    """A map of the dimensions whose score is an integer from 1 to 5; a malformed reply has none. true is no score."""
    text = reply_object(raw)
    entries = []
    for d in DIMENSIONS:
        # as text, so that 4.0, "4" and true are told from 4; each dimension is read alone
        kind = F.get_json_object(text, f"$.{d}.score")
        typed = F.from_json(text, f"{d} STRUCT<score: INT, justification: STRING>")[d]["score"]
        ok = kind.rlike(r"^-?[0-9]+$") & typed.between(1, 5)
        entries.append(F.when(ok, F.struct(F.lit(d).alias("key"), typed.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def parse_winner(raw: Column | str) -> Column:
    """a, b or tie of a pairwise reply, else null."""
    w = F.lower(X.strip(F.get_json_object(reply_object(raw), "$.winner")))
    return F.when(w.isin(*WINNERS), w)


def parse_batch_line(line: Column | str) -> Column:
    """(id, custom_id, data, error) of a line of a batch's output: an error unless the HTTP status is 2xx, the response is
    complete and its text is an object."""
    c = F.col(line) if isinstance(line, str) else line
    status = F.get_json_object(c, "$.response.status_code").cast("int")
    state = F.get_json_object(c, "$.response.body.status")
    text = F.get_json_object(c, "$.response.body.output[0].content[0].text")
    parsed = reply_object(text)
    error = (
        F.when(F.get_json_object(c, "$.error.code").isNotNull(), F.get_json_object(c, "$.error.code"))
        .when(status.isNull() | ~status.between(200, 299), "http_error")
        .when(~F.coalesce(state == "completed", F.lit(False)), "incomplete")
        .when(F.coalesce(parsed == "", F.lit(True)), "unparsable")
    )
    custom = F.get_json_object(c, "$.custom_id")
    return F.struct(F.coalesce(F.nullif(F.get_json_object(text, "$.id"), F.lit("")), custom).alias("id"), custom.alias("custom_id"), F.when(error.isNull(), parsed).alias("data"), error.alias("error"))


def batch_request(key: Column | str, prompt: Column | str, model: str, url: str = "/v1/responses") -> Column:
    """A batch request as JSON."""
    k = F.col(key) if isinstance(key, str) else key
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.to_json(F.struct(k.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), F.struct(F.lit(model).alias("model"), p.alias("input")).alias("body")))


def resume_choice(files: DataFrame, required: tuple[str, ...] = ("trainer_state.json", "optimizer.pt", "scheduler.pt"), weights: tuple[str, ...] = ("model.safetensors", "pytorch_model.bin", "adapter_model.safetensors")) -> DataFrame:
    """(name, step): the complete checkpoint folder of the highest step. ``files`` has paths folder/file."""
    parts = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("name"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    known = parts.where(F.col("file").isin(*required, *weights))
    whole = known.groupBy("name").agg(F.collect_set("file").alias("have"))
    need, any_of = F.array(*map(F.lit, required)), F.array(*map(F.lit, weights))
    complete = whole.where((F.size(F.array_except(need, "have")) == 0) & F.arrays_overlap("have", any_of)).withColumn("step", X.checkpoint_step("name")).where("step >= 0")
    return complete.orderBy(F.desc("step"), "name").limit(1).select("name", "step")


def step_times(metrics: DataFrame, warm_up: int = 2, total_steps: int | None = None) -> DataFrame:
    """(n, median_s, min_s, projected_hours) of (step, seconds), without the first steps."""
    rows = metrics.where(F.col("step") > warm_up)
    one = rows.agg(F.count("*").alias("n"), F.median("seconds").alias("median_s"), F.min("seconds").alias("min_s"))
    return one.withColumn("projected_hours", F.lit(total_steps) * F.col("median_s") / 3600)
