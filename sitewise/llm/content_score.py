"""Scores of abusive, hateful and sexual content by a weighted lexicon.

A text is folded (``folding``), and all entries are found in one pass of an Aho-Corasick automaton over
the folded words. Hits inside exception phrases do not count. The score of a place is the sum over
classes of hits within ``WINDOW`` words, each class up to its heaviest weight, where classes that threaten,
classes that shut out a group, and the others add up apart; a text is a case if any place reaches 1. The score itself is normalised by length: weights per 1,000 words, with at least
``WINDOW`` words, so that long harmless texts score low and one insult in a long letter still is a case.

Texts are read where they lie, whole, in Arrow batches; nothing is shuffled but the counts per source.

Defined results: null, empty and blank texts score 0 and are no case; repeated texts are scored as often
as they occur; very long texts are folded word by word and take time in proportion to their length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.llm import abuse_lexicon as lex
from sitewise.llm.folding import Folder, plain

WINDOW = 14
# Classes whose weights add up: what threatens somebody, what shuts a group out, and everything else.
THREAT = {"announced", "coming", "strong_violence", "violence", "weapon", "whereabouts", "person", "their_body", "no_way_out", "alive"}
SHUT_OUT = {"group", "vermin", "denied"}
WEAK = {"frame", "adj", "noun", "brains", "denied"} | THREAT  # say nothing alone
FIELDS = [("score", T.DoubleType()), ("peak", T.DoubleType()), ("is_case", T.BooleanType()), ("n_words", T.LongType()), ("kinds", T.ArrayType(T.StringType()))]


def expanded(phrase: str) -> Iterator[str]:
    """All phrases of one with alternatives in braces."""
    parts = [p[1:-1].split("|") if p.startswith("{") else [p] for p in re.findall(r"\{[^}]*\}|[^{]+", phrase)]
    for combo in itertools.product(*parts):
        yield " ".join(plain("".join(combo)).split())


class Scorer:
    def __init__(self) -> None:
        import ahocorasick

        profane = {w for words in lex.PROFANE.values() for w in words.split()}
        nouns, adjectives = lex.NOUNS.split(), lex.ADJECTIVES.split()
        phrases = {w for _, _, ps in lex.PHRASES for p in ps for e in expanded(p) for w in e.split()}
        self.folder = Folder(profane, set(nouns) | set(adjectives), phrases)
        self.auto = ahocorasick.Automaton()
        self.top: dict[str, float] = {"profane": 1.0, "noun": 0.6, "adj": 0.4}
        entries: dict[str, list[tuple[str, float]]] = {}

        def add(text: str, kind: str, weight: float) -> None:
            if text:
                entries.setdefault(f" {text} ", []).append((kind, weight))

        for w in sorted(profane | {w for w in self.folder.inflected if w not in self.folder.known}):
            if w not in set(nouns) | {n + "s" for n in nouns} | set(adjectives) | {a + "s" for a in adjectives}:
                add(plain(w), "profane", 1.0)
        for w in nouns:
            add(w, "noun", 0.6)
            add(w + "s", "noun", 0.6)
        for w in adjectives:
            add(w, "adj", 0.4)
        for kind, weight, phrases in lex.PHRASES:
            self.top[kind] = max(self.top.get(kind, 0.0), weight)
            for p in phrases:
                for e in expanded(p):
                    add(e, kind, weight)
        for p in lex.EXCEPTIONS:
            for e in expanded(p):
                add(e, "exception", 0.0)
        for text, kinds in entries.items():
            self.auto.add_word(text, (len(text), tuple(sorted(set(kinds)))))
        self.auto.make_automaton()
        self.chinese = re.compile("|".join(map(re.escape, sorted(lex.CHINESE, key=len, reverse=True))))

    def score(self, text: str | None) -> tuple[float, float, bool, int, list[str]]:
        """(weight per 1,000 words, largest sum of a place, case or not, words, kinds of the hits)."""
        if text is None or not text.strip():
            return 0.0, 0.0, False, 0, []
        words = self.folder.fold(text)
        line = " " + " ".join(words) + " "
        hits, harmless, n_signs = [], [], 0
        for end, (length, kinds) in self.auto.iter(line):
            begin = end - length + 1
            for kind, weight in kinds:
                (harmless if kind == "exception" else hits).append((begin, end, kind, weight))
        if harmless:
            hits = [h for h in hits if not any(b <= h[0] and h[1] <= e for b, e, _, _ in harmless)]
        if any("一" <= c <= "鿿" for c in line):
            # no blanks between words: signs count as words, and places of their own, behind those of the line
            tight = re.sub(r"[\s\W_]+", "", plain(text))
            n_signs = sum("一" <= c <= "鿿" for c in tight)
            hits += [(len(line) + m.start(), len(line) + m.end(), "chinese", 1.0) for m in self.chinese.finditer(tight)]
        n = len(words) + n_signs
        if not hits:
            return 0.0, 0.0, False, n, []
        places, at, marks = 0, 0, []
        for b, _, kind, weight in self._outermost(hits):  # in order of their begin
            if kind == "chinese":
                marks.append((len(words) + WINDOW + b - len(line), kind, weight))
            else:
                places, at = places + line.count(" ", at, b + 1), max(b + 1, at)
                marks.append((places, kind, weight))
        marks.sort()
        peak, kinds, left = 0.0, set(), 0
        for right in range(len(marks)):
            while marks[right][0] - marks[left][0] >= WINDOW:
                left += 1
            best: dict[str, float] = {}
            for _, kind, weight in marks[left : right + 1]:
                best[kind] = max(best.get(kind, 0.0), weight)
            sums = {"threat": sum(w for k, w in best.items() if k in THREAT), "hate": sum(w for k, w in best.items() if k in SHUT_OUT), "insult": sum(w for k, w in best.items() if k not in THREAT | {"denied"})}
            total = max(sums.values())
            if total >= 0.999:
                kinds |= set(best) - WEAK or {max(sums, key=sums.get)}
            peak = max(peak, total)
        weight = sum(w for _, kind, w in marks if kind not in WEAK)
        return round(1000.0 * weight / max(n, WINDOW), 4), round(peak, 4), peak >= 0.999, n, sorted(kinds)

    @staticmethod
    def _outermost(hits: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        """Within a class, a hit inside a longer one does not count again."""
        out, reach = [], {}
        for h in sorted(hits, key=lambda x: (x[0], -x[1])):
            if h[1] > reach.get(h[2], -1):
                out.append(h)
                reach[h[2]] = h[1]
        return out


@lru_cache(maxsize=1)
def scorer() -> Scorer:
    return Scorer()


def score_texts(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The ``keep`` columns with score, peak, is_case, n_words, kinds."""
    schema = df.select(*keep).schema
    for name, kind in FIELDS:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer()
        for batch in batches:
            rows = [s.score(t.as_py()) for t in batch.column(len(keep))]
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            kinds = [pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=[*keep, *[n for n, _ in FIELDS]])

    return df.select(*keep, text).mapInArrow(run, schema)


def rates(scored: DataFrame, source: str) -> DataFrame:
    """Per source (null is a source of its own): texts, cases, rate and mean score."""
    return scored.groupBy(source).agg(F.count("*").alias("n_texts"), F.count_if("is_case").alias("n_cases"), F.round(F.avg(F.col("is_case").cast("double")), 6).alias("case_rate"), F.round(F.avg("score"), 4).alias("mean_score"))
