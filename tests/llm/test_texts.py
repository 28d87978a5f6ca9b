"""Cut-off values, broken answers, tokenizer, leaks and moderation on literal cases, held-out data and round trips."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import answers as AN
from tallyloom.llm import bytebpe as BP
from tallyloom.llm import cutoff as CO
from tallyloom.llm import leak as LK
from tallyloom.llm import moderation as MO
from tallyloom.llm.wordform import words

VOCABULARY = Path(BP.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="needs the public vocabulary")


# ---- values that lost their end ----


def headlines(spark, extra):
    rng = random.Random(1)
    who, what, where = ("mayor", "judge", "coach", "nurse"), ("budget", "bridge", "league", "clinic"), ("haifa", "lod", "akko", "yafo")
    rows = [(str(i), f"{'out' if i % 2 else 'let'}", f"the {rng.choice(who)} opened the new {rng.choice(what)} plan in {rng.choice(where)}") for i in range(200)]
    rows += [(str(1000 + i), "lim", f"the {rng.choice(who)} opened the new {rng.choice(what)} plan in {rng.choice(where)} and left"[:30]) for i in range(40)]
    rows += [(k, "out", v) for k, v in extra.items()]
    records = spark.createDataFrame([(*r, "t") for r in rows], "id string, source string, headline string, text string")
    return records, spark.createDataFrame([("0", "the mayor opened the new bri"), ("1", None), ("2", "the judge opened the new budget plan in lod"), (None, "x y"), ("zz", "the coach opened the")], "id string, replacement_headline string")


def test_cut_off(spark):
    extra = {
        "a": "the mayor opened the new", "b": "the judge opened the new brid", "c": "the coach opened the new league plan in haifa...", "d": "the coach opened the new league plan in ak�",
        "e": None, "f": "  ", "g": 'the nurse said "the new clinic', "h": "…", "i": "the nurse opened the new clinic plan in yafo", "j": "word " * 3000 + "in",
    }
    records, repl = headlines(spark, extra)
    got = {(r.field, r.id) for r in CO.cut_off(records.union(records.where("id = 'a'")), repl).collect()}
    found = {i for f, i in got if f == "headline" and not i.isdigit()}
    assert found == {"a", "b", "d", "g", "j"}
    assert {i for f, i in got if f == "replacement_headline"} == {"0", "zz"}
    limited = {i for f, i in got if f == "headline" and i.isdigit()}
    assert limited == {str(1000 + i) for i in range(40)}
    reasons = {(r.reason, r.words) for r in CO.cut_reasons(records, repl).collect()}
    assert ("inside a word", 3) in reasons and ("inside a sentence", 3) in reasons
    rates = {(r.source, r.field): r for r in CO.cut_rates(records, repl).collect()}
    assert rates["lim", "headline"].cut_rate == 1.0 and rates["let", "headline"].n_cut == 0
    assert CO.cut_off(records.limit(0), repl.limit(0)).count() == 0


def test_cut_inside_a_letter(spark):
    rng = random.Random(2)
    who, what, when = ("השופט", "ראש העיר", "שר הדתות", "דובר בנק"), ("הגשר", "התקציב", "הליגה", "המרפאה"), ("הבוקר", "אתמול", "השבוע", "בערב")
    said = lambda: f"{rng.choice(who)} פתח את {rng.choice(what)} {rng.choice(when)}"
    rows = [(str(i), "let", said() + rng.choice(("", " ליד הגשר", " בגלל התקציב"))) for i in range(300)]
    sent = [f"{'-' * (i % 9 * 2)}{said()} {rng.choice(('ליד', 'בגלל'))} {rng.choice(what)} ועוד {rng.choice(what)} {rng.choice(when)}" for i in range(180)]
    cut = [(f"c{i}", "byt", v.encode()[:49].decode(errors="ignore")) for i, v in enumerate(sent)]
    line = "-" * 7 + "השופט פתח את הגשר בערב"
    whole = [("closed", "byt", line + "."), ("latin", "byt", "the mayor opened one bridge and clinics in haifa"), ("two", "byt", line)]
    assert {len(v.encode()) for _, _, v in cut} == {48, 49} and [len(v.encode()) for _, _, v in whole] == [48, 48, 47]
    records = spark.createDataFrame([(*r, "t") for r in rows + cut + whole], "id string, source string, headline string, text string")
    got = {r.id for r in CO.cut_off(records, spark.createDataFrame([], "id string, replacement_headline string")).collect()}
    assert got == {k for k, _, _ in cut}


# ---- broken answers ----

PROMPT = "ראש העיר פתח את הגשר החדש בחיפה. התושבים ברכו על המהלך!\nהעלות היא 5 מיליון שקלים."


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), (" ‏.", "empty"), ("תקציר:", "empty"), ("תקציר (עד 2 משפטים):", "empty"), ("<think>א ב ג</think>", "empty"), ("<think>א ב", "empty"),
        ("לא אוכל לסייע בבקשה זו.", "refusal"), ("As an AI model I cannot do it.", "refusal"), ("Je ne peux pas résumer.", "refusal"), ("Извините, я не могу.", "refusal"),
        ('"אני מצטער, איני יכול להגיב", אמר ראש העיר ופתח את הגשר.', None), ("השר סירב לסכם ואמר כי לא יוכל לסייע.", None),
        ("The mayor opened the bridge.", "language"), ("Мэр открыл мост в городе.", "language"), ("افتتح رئيس البلدية الجسر.", "language"), ("Smart City Hub: ראש העיר חנך גשר.", None),
        ("התושבים ברכו על המהלך", "copy"), ("תקציר: העלות היא 5 מיליון שקלים. ראש הָעיר פתח את הגשר החדש בחיפה", "copy"), ("ראש העיר פתח את הגשר החדש.", None), ("העיר פתח את הגשר החדש בחיפה.", None),
        ('הוא אמר "הגשר', "truncated"), ("ראש העיר חנך את", "truncated"), ("ראש העיר חנך אמש", None), ("ראש העיר חנך גשר (הבוקר)", None),
    ],
)
def test_answers(answer, defect):
    assert AN.read_answer(PROMPT, answer).defect == defect


def test_copy_needs_a_prompt():
    assert AN.read_answer(None, "התושבים ברכו על המהלך.").defect is None
    assert AN.read_answer("", "שלום.").defect is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=8), st.integers(1, 4))
def test_suffix_automaton(text, query, least):
    covered = set()
    for i in range(len(query)):
        for j in range(i + least, len(query) + 1):
            if any(text[k : k + j - i] == query[i:j] for k in range(len(text))):
                covered.update(range(i, j))
    want = len(covered) / len(query) if query else 0.0
    assert AN.SuffixAutomaton(text).coverage(query, least) == pytest.approx(want)


def test_word_of_the_prompt_that_an_answer_begins():
    assert AN.read_answer(PROMPT, "ראש העיר פתח את הגשר החד").begun and AN.read_answer(PROMPT, "הם שמחו על המה").begun
    assert not AN.read_answer(PROMPT, "ראש העיר פתח את הגשר").begun and not AN.read_answer(None, "ראש העיר פתח גש").begun
    assert not AN.read_answer(PROMPT, "ראש העיר פתח גש.").begun


def test_truncated_answers(spark):
    rng = random.Random(2)
    full = [f"{rng.choice(('השר', 'השופט', 'המאמן'))} אישר אתמול את {rng.choice(('התקציב', 'הגשר', 'הסקר'))} החדש של המדינה." for _ in range(200)]
    rows = [(i, PROMPT, a, "m", "v", "x") for i, a in enumerate(full)]
    rows += [(900, PROMPT, "השר אישר אתמול את", "m", None, "x"), (901, PROMPT, "השר אישר אתמול את התקצ", "m", None, "x"), (902, PROMPT, "השר אישר אתמול את הגשר החדש של המדינה", "m", None, "x"), (903, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "pos bigint, text string, prediction string, model string, variant string, done string")
    assert {(r.pos, r.defect) for r in AN.defects(df).collect()} == {(900, "truncated"), (901, "truncated"), (903, "empty")}
    how = {(r.defect, r.how): r.n for r in AN.defect_reasons(df).collect()}
    assert how == {("truncated", "stopword"): 1, ("truncated", "counts, inside a word"): 1, ("empty", "no word"): 1}
    assert {(r.model, r.defect): r.n_defective for r in AN.defect_rates(df).collect()} == {("m", "truncated"): 2, (None, "empty"): 1}
    assert AN.defects(df.limit(0)).count() == 0


# ---- tokenizer ----


@needs_vocabulary
def test_tokenizer_matches_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY.with_suffix(".json")))
    t.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "a'sdtmlvreI  \n\t12!. א\xa0ְ—🙂\r3'　\x1c"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    texts += ["", None, "'" * 60, "x" * 5000, "<|endoftext|> a", " ", "it's they'll 've'd", "א" * 3000 + " ב"]
    ids, off, starts, piece_off, sizes = BP.encode_batch(texts, BP.Merger(BP.load_ranks()))
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for x, w, a, b in zip(texts, want, off, off[1:]):
        assert ids[a:b].tolist() == w.ids, x
    tokens = {v: k for k, v in BP.load_ranks().items()}
    assert all(BP.decode_ids(ids[a:b].tolist(), tokens) == (x or "") for x, a, b in zip(texts, off, off[1:]))
    for i, x in enumerate(texts):  # each piece's ids decode to its slice of the text
        s, n = starts[piece_off[i] : piece_off[i + 1]].tolist(), sizes[piece_off[i] : piece_off[i + 1]].tolist()
        at = off[i]
        for a, b, k in zip(s, [*s[1:], len(x or "")], n):
            assert BP.decode_ids(ids[at : at + k].tolist(), tokens) == x[a:b]
            at += k
        assert at == off[i + 1]


@needs_vocabulary
def test_tokenizer_table(spark):
    df = spark.createDataFrame([(1, "ab", "s", [1]), (2, None, "s", None), (3, "", None, None), (1, "ab", "s", [1])], "doc_id bigint, text string, source string, ids array<int>")
    rows = BP.encode(df).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in rows) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    spans = BP.encode(spark.createDataFrame([(1, "ab cd!")], "doc_id bigint, text string"), spans=True).first()
    assert spans.starts == [0, 2, 5] and sum(spans.piece_ids) == len(spans.ids)
    assert {r.source: (r.n_docs, r.n_round_trip, r.n_empty) for r in BP.token_rates(df).collect()} == {"s": (3, 3, 1), None: (1, 1, 1)}
    assert BP.encode(df.limit(0)).count() == 0


def test_parts_of_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 20, "", "c", "d" * 9])], names=["text"])
    parts = list(BP.parts_of(batch, 0, rows=3, chars=10))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert list(BP.parts_of(batch.slice(0, 0), 0)) == [] and [p.num_rows for p in BP.parts_of(batch.slice(2), 0, chars=10)] == [1, 3]


def test_scan_is_the_automaton():
    rng = np.random.default_rng(1)
    cls = rng.integers(0, 5, 3000).astype(np.uint8)
    t, state, want = BP._transitions(), BP.CUT, []
    for c in cls:
        state = t[c * 8 + state]
        want.append(state)
    assert BP.scan_states(cls).tolist() == want


# ---- leaks ----


def test_leaks(spark):
    item = [f"q{i}" for i in range(30)]
    docs = [(1, "x " + " ".join(item[3:15]) + " y"), (2, " ".join(item[3:14])), (3, ", ".join(w.upper().replace("Q", "qְ") for w in item)), (4, None), (5, ""), (6, "x " + " ".join(item[3:15]) + " y")]
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, "short"), (13, None)]
    d = spark.createDataFrame([(*x, "s", "k") for x in docs], "doc_id bigint, text string, source string, item_id string")
    i = spark.createDataFrame([(*x, "test") for x in items], "item_id bigint, text string, split string")
    want = {(k, m) for k in (1, 3, 6) for m in (10, 11)}
    assert {tuple(r) for r in LK.leaks(d, i).collect()} == want
    assert {tuple(r) for r in LK.leaks(d, i, block_runs=20).collect()} == want  # in blocks
    p = {(r.doc_id, r.item_id): (r.start, r.end, r.n_words) for r in LK.passages(d, i).collect()}
    a, b, n = p[1, 10]
    assert docs[0][1][a:b] == " ".join(item[3:15]) and n == 12 and p[3, 10][2] == 30
    assert {r.item_id: (r.n_docs, r.longest) for r in LK.item_report(d, i).collect()} == {10: (3, 30), 11: (3, 30)}
    assert LK.leaks(d.limit(0), i).count() == 0 and LK.leaks(d, i.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=20), st.lists(st.lists(st.sampled_from("ab"), max_size=12), max_size=4))
def test_automaton_finds_all_runs(doc, items):
    auto = LK.ItemAutomaton([(k, " ".join(x)) for k, x in enumerate(items)], run=3)
    got = {i for _, own in auto.hits(words(" ".join(doc))) for i in own}
    runs = {tuple(doc[i : i + 3]) for i in range(len(doc) - 2)}
    assert got == {k for k, x in enumerate(items) if any(tuple(x[i : i + 3]) in runs for i in range(len(x) - 2))}


# ---- moderation ----

SMALL = MO.Network(epochs=8, size=2500, background=100)


def test_disguises():
    assert MO.plain_words("מ.נ.י.א.ק") == ["מניאק"] and MO.plain_words("h o r n y   g i r l s") == ["horny", "girls"]
    assert MO.plain_words("moooron p0rn ערו*ות") == ["moron", "porn", "ערוות"] and MO.plain_words("פ-ו-ר-נ-ו") == ["פורנו"]
    assert MO.plain_words(None) == MO.plain_words(" ") == []
    w = MO.windows(list(range(50)), MO.Network())
    assert sorted({x for p in w for x in p}) == list(range(50)) and all(len(p) == 24 for p in w)


def test_gradients_of_the_recurrent_cell():
    rng = np.random.default_rng(0)
    h, x = 3, rng.standard_normal((4, 2, 9)).astype(np.float32)
    u = (rng.standard_normal((3, 9)) * 0.5).astype(np.float32)
    out, tape = MO._gru(x, u, h, True)
    dx, du = MO._gru_back(np.ones_like(out), tape, u, h)
    eps = 1e-2
    for array, grad in ((x, dx), (u, du)):
        for _ in range(6):
            at = tuple(rng.integers(s) for s in array.shape)
            old = array[at]
            array[at] = old + eps
            up = MO._gru(x, u, h, False)[0].sum()
            array[at] = old - eps
            down = MO._gru(x, u, h, False)[0].sum()
            array[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(grad[at], abs=2e-2)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_moderation_held_out(spark):
    d = "/root/testdata/sf0.01"
    samples = spark.read.parquet(f"{d}/moderation_samples.parquet").where("text IS NOT NULL")
    rows = sorted((r.sample_id, r.text, r.label) for r in samples.collect())
    held, kept = rows[::4], [r for i, r in enumerate(rows) if i % 4]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = MO.fit(docs, spark.createDataFrame(kept, "sample_id bigint, text string, label string"), SMALL)
    p = MO.Scorer(model, SMALL)([t for _, t, _ in held])
    right = np.mean([(1 - a[0] >= 0.5) == (y != "clean") for a, (_, _, y) in zip(p, held)])
    assert right > 0.95
    long = MO.Scorer(model, SMALL)(["שלום עולם " * 2000 + held[0][1], None, "", "  "])
    assert long[1:, 0].tolist() == [1, 1, 1]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_moderation_without_lists(spark, monkeypatch):
    """Words in no list are judged by what the network learned: no flag is set in training or scoring."""
    d = "/root/testdata/sf0.01"
    rows = sorted((r.sample_id, r.text, r.label) for r in spark.read.parquet(f"{d}/moderation_samples.parquet").where("text IS NOT NULL").collect())
    docs = spark.read.parquet(f"{d}/documents.parquet")
    held, kept = rows[1::4], [(t, y) for i, (_, t, y) in enumerate(rows) if i % 4 != 1]
    background = MO.background_windows(docs, SMALL)
    monkeypatch.setattr(MO, "flags", lambda word: (0, 0, 0))
    p = MO.Scorer(MO.train(kept, background, SMALL), SMALL)([t for _, t, _ in held])
    assert np.mean([(1 - a[0] >= 0.5) == (y != "clean") for a, (_, _, y) in zip(p, held)]) > 0.93


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_seeds_are_not_in_the_documents(spark):
    docs = [MO.plain_words(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    runs = {tuple(d[a : a + 4]) for d in docs for a in range(len(d) - 3)}
    for block in MO.lists.SEEDS.values():
        for line in block.strip().splitlines():
            w = MO.plain_words(line)
            assert runs.isdisjoint(tuple(w[a : a + 4]) for a in range(len(w) - 3)), line


def test_network_is_fitted_once(spark, monkeypatch):
    samples = spark.createDataFrame([(1, "you idiot", "abusive"), (2, "the council met again", "clean")], "sample_id bigint, text string, label string")
    docs = spark.createDataFrame([(1, "shut up you idiot bastard", "s")], "doc_id bigint, text string, source string")
    tiny = MO.Network(epochs=1, size=200, background=10)
    first = MO.fit(docs, samples, tiny)
    monkeypatch.setattr(MO, "train", None)
    again = MO.fit(docs, samples, tiny)
    assert all((first[k] == again[k]).all() for k in first)


def test_moderation_table(spark):
    samples = spark.createDataFrame([(1, "you idiot", "he", "abusive"), (2, "the council met", None, "clean"), (3, None, None, "clean"), (4, "x", None, "odd")], "sample_id bigint, text string, lang string, label string")
    docs = spark.createDataFrame([(1, "shut up you idiot bastard", "s", 0.1), (2, None, "s", 0.1), (3, "", None, 0.1), (1, "shut up you idiot bastard", "s", 0.1)], "doc_id bigint, text string, source string, score double")
    tiny = MO.Network(epochs=3, size=600, background=10)
    got = [(r.doc_id, r.label) for r in MO.scores(docs, samples, tiny).collect()]
    assert sorted(got) == [(1, "abusive"), (1, "abusive"), (2, "clean"), (3, "clean")]
    rates = {r.source: (r.n_docs, r.n_flagged) for r in MO.source_rates(docs, samples, net=tiny).collect()}
    assert rates == {"s": (3, 2), None: (1, 0)}
    assert MO.scores(docs.limit(0), samples, tiny).count() == 0


def test_piece_of_a_long_text():
    rng, seq = np.random.default_rng(0), [str(i) for i in range(60)]
    got = [MO.piece(seq, 24, rng) for _ in range(500)]
    assert all(len(g) == 24 for g in got) and {w for g in got for w in g} == set(seq)
    assert MO.piece(seq[:24], 24, rng) == seq[:24]
