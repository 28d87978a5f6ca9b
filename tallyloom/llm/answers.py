"""Problem 3: broken prompt and response pairs.

Each answer is read once: reasoning blocks and a label are taken off, then

- *empty*: no letter or digit is left;
- *refusal*: a phrase automaton finds a first-person refusal outside quotation marks in the first sentence;
- *language*: votes of stopwords and scripts, names (capitalised words) aside, go to another language than Hebrew;
- *copy*: a suffix automaton of the prompt's words measures how much of the answer is copied; where all of it is, a check
  that the answer is a chain of whole sentences of the prompt decides;
- *truncated*: an unfinished answer with something left open on a delimiter stack, with a stopword that governs what follows
  as its last word, or whose last word is none of the prompt's but, after the state that the prompt's automaton is in, begins
  one (unless finished answers end with it). That leaves cuts whose words the prompt doesn't hold: there, as an addition to
  the method, the final words are joined to counts of runs of words inside and at the ends of all sentences, as for problem 2.
  ``p3_reasons`` gives the share of each.

Scale: one pass in Arrow batches, then grouping by short runs with partial aggregation; hot runs are one counter. An
automaton is built per prompt and only where enough of the answer's words occur in the prompt at all to matter.

Defined results: a null answer is empty; a null or empty prompt has nothing to copy; repeated rows are each reported under
their own pos; the first defect in the order above is given; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.cutoff import SENTENCE, USUAL, WORD, gram_reason, seen_grams
from tallyloom.llm.wordform import strip_marks, words
from tallyloom.session import keep, ship

_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_NAME_LABEL = re.compile(r"^\W*(?:[A-Z][\w&'.-]*\s+){0,4}[A-Z][\w&'.-]*\s*[:：]\s*")
_WORD_LABEL = re.compile(r"^\W*(?:תקציר|סיכום|כותרת|תשובה|תמצית|summary|answer|headline|résumé|резюме|итог|ответ|ملخص|الجواب)(?:\s*\([^)]*\))?\s*[:：]\s*", re.I)
_SENTENCE = re.compile(r"[.!?…؟]+[\"”״'’)\]]*(?=\s|$)|\n+")
_DONE = re.compile(r"(?:[.!?؟][\"”״'’)\]]*|\))\s*$")
_ELLIPSIS = re.compile(r"(?:…|\.{2,}|�)[\"”״'’)\]]*\s*$")
_INNER = re.compile(r"(?<=[^\W\d_])[\"״”](?=[^\W\d_])")

#: First-person refusals, as normalised words; the subject is the answerer.
REFUSALS = """
אני מצטער אך|אני מצטערת אך|מצטער אבל|מצטערת אבל|מצטער הבקשה|מצטערת הבקשה|סליחה אבל|אני נמנע|אני נמנעת|איני יכול|אינני יכול|אינני יכולה|איני יכולה
אני לא יכול|אני לא יכולה|לא אוכל|אין באפשרותי|אין ביכולתי|אין לי גישה|אין לי אפשרות|לא אסכם|לא אכתוב|כמודל שפה|בתור מודל שפה|אני מעדיף לא|אני מעדיפה לא
מעדיף שלא|מעדיפה שלא|מעדיף להימנע|מעדיפה להימנע|אני מעדיף|אני מעדיפה|רגיש מדי|רגיש מדיי|חורגת מהנחיות|חורג מהנחיות|אני מסרב|אני מסרבת|נבצר ממני|לא ניתן לסכם|לא ניתן לספק
i m sorry|i am sorry|i can t|i can not|i cannot|i am unable|i m unable|as an ai|as a language model|i must decline|i won t|i will not be able|i do not have access|i don t have access|unable to provide|sorry but
je suis désolé|je suis desole|je ne peux pas|je ne suis pas en mesure|en tant que modèle|je regrette|je dois refuser|il m est impossible
я не могу|извините|к сожалению я|простите|как языковая модель|как модель|я вынужден отказаться|не в состоянии|мне жаль
لا أستطيع|لا يمكنني|عذرا|آسف|أعتذر|بصفتي نموذج|كنموذج لغوي|ليس بإمكاني|يؤسفني
""".strip().replace("\n", "|").split("|")

#: Stopwords of the languages that vote.
STOPWORDS = {
    "he": "של את על לא כי הוא היא זה גם עם אל או אך אבל אם כל יש אין בין לפי לאחר אחרי עד רק מה מי אני הם אמר כך".split(),
    "en": "the of and to in a is that for on with as was at by it from be are this an or which has have not but had their said after about near because although before while who".split(),
    "fr": "le la les de des du et en un une que qui dans pour sur au aux par est pas plus ce cette avec selon après se sont ont d l".split(),
    "ru": "и в не на что с по как из у за от к о для это но после их он она они был была были".split(),
    "ar": "في من على أن إن إلى عن مع هذا هذه بعد التي الذي قال وقال ما لا بأن بين كان".split(),
    "es": "el los las y que en por para con una del se como más su al es son según".split(),
    "de": "der die das und ist nicht mit von den dem ein eine zu auf für im des sich nach wurde".split(),
}
#: Hebrew stopwords that something must follow: no sentence ends with one.
GOVERNING = frozenset("של את על כי עם אל או אך אבל אם כל בין לפי לאחר אחרי עד רק מי אשר כדי בשל בעקבות לקראת".split())
_SCRIPTS = {"he": "֐-׿יִ-ﭏ", "ru": "Ѐ-ԯ", "ar": "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"}
_SCRIPT_RE = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}


@cache
def _refusal_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase in REFUSALS:
        auto.add_word(f" {' '.join(words(phrase))} ", phrase)
    auto.make_automaton()
    return auto


@cache
def _votes() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, stop in STOPWORDS.items():
        for w in stop:
            out.setdefault(w, []).append(lang)
    return out


class SuffixAutomaton:
    """All runs of a word sequence."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in sequence:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def coverage(self, sequence: list[str], least: int) -> float:
        """Share of the words that lie in matched runs of at least ``least`` words."""
        if not sequence:
            return 0.0
        covered, state, run = 0, 0, 0
        upto = 0  # words before this place are counted
        for i, w in enumerate(sequence):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                run += 1
            else:
                run = 0
            if run >= least:
                first = max(upto, i + 1 - run)
                covered += i + 1 - first
                upto = i + 1
        return covered / len(sequence)


    def begins(self, sequence: list[str], fragment: str) -> bool:
        """Whether, after the longest matched end of ``sequence`` or a shorter one, a longer word starts with ``fragment``."""
        state = 0
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
            state = self.next[state].get(w, 0)
        while state >= 0:
            if any(w != fragment and w.startswith(fragment) for w in self.next[state]):
                return True
            state = self.link[state]
        return False


def strip_label(text: str) -> str:
    for pattern in (_WORD_LABEL, _NAME_LABEL, _WORD_LABEL):
        text = pattern.sub("", text, count=1)
    return text


def without_quotes(text: str) -> str:
    """The text outside pairs of quotation marks."""
    return re.sub(r"\"[^\"]*\"|“[^”]*”|«[^»]*»", " ", _INNER.sub("", text))


def refuses(text: str) -> bool:
    first = _SENTENCE.split(without_quotes(text).strip(), maxsplit=1)[0]
    line = f" {' '.join(words(first))} "
    return next(_refusal_automaton().iter(line), None) is not None


def language(text: str) -> str | None:
    """The language most words vote for; a stopword's vote counts 3, a script's 1; capitalised words are names."""
    tally: dict[str, int] = {}
    stop = _votes()
    for w in re.findall(r"[^\W\d_]+", strip_marks(text)):
        for lang in stop.get(w.lower(), ()):
            tally[lang] = tally.get(lang, 0) + 3
        for lang, script in _SCRIPT_RE.items():
            if script.match(w):
                tally[lang] = tally.get(lang, 0) + 1
                break
        else:
            if not w[0].isupper():
                tally["latin"] = tally.get("latin", 0) + 1
    if not tally:
        return None
    latin = tally.pop("latin", 0)
    best = max(tally, key=lambda k: tally[k], default=None)
    if best is None or (best in _SCRIPTS and latin > tally[best]):
        return "other" if latin else None
    return best


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


def is_chain(answer: list[str], parts: list[list[str]]) -> bool:
    """Whether the answer is one sentence after another of ``parts``, in any order."""
    reach = {0}
    for i in range(len(answer)):
        if i in reach:
            for p in parts:
                if p and answer[i : i + len(p)] == p:
                    reach.add(i + len(p))
    return len(answer) in reach


def left_open(text: str) -> bool:
    """A stack of delimiters that doesn't end empty; marks inside words don't count."""
    pairs = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
    stack: list[str] = []
    for c in _INNER.sub("", text):
        if c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append(c)
        elif c in pairs.values():
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
    return bool(stack)


@dataclass(frozen=True)
class Reading:
    """What a pair alone shows: a defect and what showed it; else the finished sentences as words, the words of an unfinished
    last one, and whether the last of these only begins a word of the prompt."""

    defect: str | None = None
    how: str | None = None
    done: tuple[list[str], ...] = ()
    open: tuple[str, ...] = ()
    begun: bool = False


def read_answer(prompt: str | None, answer: str | None, copied: float = 0.98) -> Reading:
    body = _THINK.sub("", answer or "")
    rest = strip_label(body.strip())
    found = words(rest)
    if not found:
        return Reading("empty", "no word")
    if refuses(rest):
        return Reading("refusal", "automaton")
    if language(rest) not in ("he", None):
        return Reading("language", "votes")
    source = words(prompt)
    have = set(source)
    automaton: SuffixAutomaton | None = None
    if source and sum(w in have for w in found) >= copied * len(found):
        automaton = SuffixAutomaton(source)
        if automaton.coverage(found, 3) >= copied or len(found) < 3:
            if is_chain(found, [words(s) for s in sentences(prompt)]):
                return Reading("copy", "automaton")
    plain = rest.strip()
    pieces = [p for p in (words(s) for s in sentences(plain)) if p]
    if _DONE.search(plain) and not _ELLIPSIS.search(plain):
        return Reading(done=tuple(pieces))
    last = pieces.pop() if pieces else []
    if left_open(plain) or plain.endswith("�"):
        return Reading("truncated", "delimiters", tuple(pieces))
    if last and last[-1] in GOVERNING:
        return Reading("truncated", "stopword", tuple(pieces))
    begun = bool(last) and last[-1] not in have and any(w.startswith(last[-1]) for w in have)
    if begun:
        begun = (automaton or SuffixAutomaton(source)).begins(last[:-1], last[-1])
    return Reading(None, None, tuple(pieces), tuple(last), begun)


#: Finished sentences, and the unfinished last part of each answer, for the grams of :mod:`cutoff`.
PARTS_SQL = """
SELECT uid, pos, transform(s, w -> regexp_replace(w, '[0-9]+', '0')) AS ws, sound FROM (
  SELECT pos AS uid, pos, s, true AS sound FROM {read} LATERAL VIEW explode(done) d AS s
  UNION ALL SELECT pos, pos, open, false FROM {read} WHERE size(open) > 0
)
"""

#: ``usual``: the last word ends at least three finished sentences, and a fair share of those that have it.
LATE_SQL = """
SELECT r.pos, CASE WHEN r.begun AND NOT coalesce(g.usual, false) THEN 'automaton' WHEN g.reason IS NOT NULL THEN concat('counts, ', g.reason.reason) END AS how
FROM (SELECT pos, begun FROM {read} WHERE size(open) > 0) r
LEFT JOIN (SELECT uid, {grams} AS reason, e1 >= 3 AND e1 >= 0.1D * (i1 + e1 + l1) AS usual FROM {seen}) g ON g.uid = r.pos
"""


def explained(pairs: DataFrame) -> DataFrame:
    """(pos, defect, how) of all defective pairs of ``pairs`` (pos, text, prediction); ``how`` says what showed it."""
    spark = ship(pairs.sparkSession)
    text = pa.list_(pa.string())
    kinds = {"pos": pa.int64(), "defect": pa.string(), "how": pa.string(), "begun": pa.bool_(), "done": pa.list_(text), "open": text}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_answer(t, a) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [[getattr(f, name) for f in found] for name in list(kinds)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, list(kinds.values())[1:]))], names=list(kinds))

    schema = "pos bigint, defect string, how string, begun boolean, done array<array<string>>, open array<string>"
    read = keep(pairs.select("pos", "text", "prediction").mapInArrow(run, schema), "answers")
    parts = spark.sql(PARTS_SQL, read=read)
    seen = seen_grams(parts, parts.where("NOT sound"))
    late = spark.sql(LATE_SQL.replace("{grams}", gram_reason(WORD, SENTENCE, USUAL)), read=read, seen=seen)
    cut = late.where("how IS NOT NULL").select("pos", F.lit("truncated").alias("defect"), "how")
    return read.where("defect IS NOT NULL").select("pos", "defect", "how").unionByName(cut)


def defects(pairs: DataFrame) -> DataFrame:
    """(pos, defect) of all defective pairs."""
    return explained(pairs).select("pos", "defect")


def defect_reasons(pairs: DataFrame) -> DataFrame:
    """(defect, how, n): defective pairs by what showed the defect."""
    return explained(pairs).groupBy("defect", "how").agg(F.count("*").alias("n"))


def defect_rates(pairs: DataFrame) -> DataFrame:
    """Per model, variant and defect: pairs and their share of the model's and variant's pairs."""
    found = defects(pairs)
    named = pairs.select(F.col("pos").alias("_p"), "model", "variant")
    total = named.groupBy("model", "variant").agg(F.count("*").alias("n_pairs"))
    n = found.join(named, F.col("pos") == F.col("_p")).groupBy("model", "variant", "defect").agg(F.count("*").alias("n_defective"))
    same = n.model.eqNullSafe(total.model) & n.variant.eqNullSafe(total.variant)
    return n.join(total, same).select(n.model, n.variant, "defect", "n_defective", "n_pairs", F.round(F.col("n_defective") / F.col("n_pairs"), 4).alias("rate"))
