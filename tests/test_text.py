"""Text functions on literal values with known answers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.functions import text as X


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'boolean' if isinstance(v, bool) else 'string'}" for n, v in values.items()))
    assert names
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, found",
    [("(שלום),  עולם! abc ב1ג", [("שלום", 0, 5), ("עולם", 9, 13), ("בג", 19, 22)]), ('"א\xa0ב" ג', [("אב", 0, 4), ("ג", 6, 7)]), ("2024 - abc", []), ("", [])],
)
def test_spans(spark, text, found):
    w, s = X.spans_of(text)
    assert [(a, *b) for a, b in zip(w, s)] == found
    assert one(spark, X.script_words("t"), t=text) == w


def test_spans_table(spark):
    df = spark.createDataFrame([(1, "א ב", "x"), (2, None, "y")], "id bigint, text string, key string")
    assert [tuple(r) for r in X.word_spans(df, "id", "text").collect()] == [(1, 1, "א", 0, 1), (1, 2, "ב", 2, 3)]


@pytest.mark.parametrize("text, headline, want", [("א ב ג ד", "א ג ה", 0.6667), ("א ב", "abc", 0.0), (" ".join(["מלה"] * 50) + " סוף", "סוף מלה", 0.5), (None, "א", 0.0)])
def test_lead_overlap(spark, text, headline, want):
    assert one(spark, X.lead_overlap("a", "b"), a=text, b=headline) == want


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("דיווח | בכיר התפטר", "בכיר התפטר", "pipes_removed"),
        ("חדשות: השר הודיע על רפורמה", "השר הודיע על רפורמה", "boilerplate_stripped"),
        ("השר הודיע כי…", "השר הודיע על רפורמה בחינוך", "truncation_repaired"),
        ("השר דיבר עם", "השר דיבר עם ראש העיר על התקציב", "truncation_repaired"),
        ("השר הודיע היום...", "השר הודיע על רפורמה", "full_rewrite"),
        ("השר הודיע היום", "השר הודיע אתמול", "light_edit"),
        ("לא תאמינו", "השר הודיע על רפורמה", "full_rewrite"),
        (None, "א", None),
    ],
)
def test_edits(spark, a, b, want):
    assert one(spark, X.classify_edit("a", "b"), a=a, b=b) == want


def test_strip_and_think(spark):
    assert one(spark, X.strip("t"), t=" \x1c\xa0 א 　\n") == "א"
    assert one(spark, X.strip_think("t"), t="<think>a\nb</think> x <think>c</think>") == "x"
    assert one(spark, X.strip_think("t"), t="<think>open") == "<think>open"
    assert one(spark, X.clean_nullable("t"), t=" \n") is None


def test_small_functions(spark):
    assert one(spark, X.count_pipes("t"), t="a|b||") == 3
    assert one(spark, X.token_count("t"), t="אחת, two 3!") == 5
    assert one(spark, X.truncate_tokens("t", 2), t="a b c") == "a b"
    assert one(spark, X.prefix("t", 2), t="א🙂ב") == "א🙂"
    assert one(spark, X.checkpoint_step("t"), t="checkpoint-120") == 120
    assert one(spark, X.checkpoint_step("t"), t="checkpoint-x") == -1
    assert one(spark, X.gap_is_metadata("t"), t=" 12. ") is True
    assert one(spark, X.gap_is_metadata("t"), t=" 12 ") is False
    assert one(spark, X.arm_of("w", "a", "raw"), w="b", a=True) == "raw"
    assert one(spark, X.arm_of("w", "a"), w="b", a=False) == "curated"
    assert one(spark, X.fill("a {x} b {{}}", x="x"), x="1") == "a 1 b {}"


def test_numeric_order(spark):
    df = spark.createDataFrame([("10",), ("2",), ("a",), ("01",)], "id string")
    assert [r.id for r in df.orderBy(*X.numeric_order("id")).collect()] == ["01", "2", "10", "a"]


def test_register(spark):
    X.register(spark)
    r = spark.sql("SELECT tl_script_words('א b ג') w, tl_pipes('a|') p, tl_token_count('a b.') n, tl_lead_overlap('א ב', 'א ג') o").first()
    assert (r.w, r.p, r.n, r.o) == (["א", "ג"], 1, 3, 0.5)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="אבגx1 .\n\t\xa0\"🙂", max_size=40))
def test_spans_hold(text):
    words, spans = X.spans_of(text)
    for w, (a, b) in zip(words, spans):
        assert "".join(c for c in text[a:b] if "֐" <= c <= "׿") == w
    assert [b for _, b in spans] == sorted(b for _, b in spans)


