"""Language identification: words first, then ever shorter character n-grams.

Counts of whole words and of n-grams are summed by language over all labelled texts that aren't held out. The most frequent of each kind, a
fixed number, are the model, each with its smoothed log frequency in every language. A text is judged by its distinct words: a known word adds
its log frequencies, an unknown one the mean of those of its longest n-grams that are known. Every word counts as often as it occurs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialise

#: n-grams from the longest down; 0 stands for whole words, which are at most LONGEST characters.
SIZES, LONGEST = (4, 3, 2, 1), 40
#: Entries of a task's dictionary, after which it is handed on; unknown words whose values a task remembers at most.
ENTRIES, REMEMBERED = 300_000, 300_000
_RUNS, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words(text: str | None) -> Counter:
    """How often a text's words, runs of letters in lower case, occur."""
    found = Counter(_RUNS.findall((text or "").lower()))
    if not "".join(found).isalpha():
        for run in [w for w in found if not w.isalpha()]:  # numerals that are no decimal digits
            n = found.pop(run)
            for w in _LETTERS.findall(run):
                found[w] += n
    return found


def grams(word: str, size: int) -> Iterator[str]:
    """The n-grams of a word with a space at either end; its letters alone for size 1."""
    padded = word if size == 1 else f" {word} "
    return (padded[i : i + size] for i in range(len(padded) - size + 1))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; also of a null id, from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of docs (lang, text): partial counts, of at most ENTRIES words at a time in a task."""

    def flushed(known: dict[str, Counter]) -> Iterator[pd.DataFrame]:
        for lang, seen in known.items():
            yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())}).astype({"lang": object, "word": object, "n": np.int64})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Counter] = {}
        size = 0
        for each in frames:
            for lang, text in zip(each["lang"], each["text"]):
                seen = known.setdefault(lang, Counter())
                before = len(seen)
                seen.update(words(text))
                size += len(seen) - before
                if size >= ENTRIES:
                    yield from flushed(known)
                    known, size = {}, 0
        yield from flushed(known)

    return docs.select("lang", "text").mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counted: DataFrame) -> DataFrame:
    """lang, size, gram, n of the distinct words (lang, word, n) of all texts."""

    def flushed(lang: str, size: int, seen: dict[str, int]) -> pd.DataFrame:
        return pd.DataFrame({"lang": lang, "size": size, "gram": list(seen), "n": list(seen.values())}).astype({"lang": object, "size": np.int32, "gram": object, "n": np.int64})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, int], dict[str, int]] = {}
        entries = 0
        for each in frames:
            for lang, word, n in zip(each["lang"], each["word"], each["n"].tolist()):
                for size in SIZES:
                    seen = known.setdefault((lang, size), {})
                    before = len(seen)
                    for g in grams(word, size):
                        seen[g] = seen.get(g, 0) + n
                    entries += len(seen) - before
                if entries >= ENTRIES:
                    yield from (flushed(*key, seen) for key, seen in known.items())
                    known, entries = {}, 0
        yield from (flushed(*key, seen) for key, seen in known.items())

    found = counted.mapInPandas(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return found.unionByName(counted.where(F.length("word") <= LONGEST).select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n"))


class Model(NamedTuple):
    langs: list[str]  # in order of their bytes
    places: dict[int, dict[str, int]]  # by size, of a gram its row in scores
    scores: np.ndarray  # log frequencies, gram by language
    usual: int  # the language of most words, for texts of which nothing is known


def fit(docs: DataFrame, most: int = 40_000, most_words: int = 100_000, smoothing: float = 0.5) -> Model:
    """The model of docs (lang, text): the ``most_words`` most frequent words and the ``most`` most frequent grams of each size, ties by the gram.

    Counts cover all rows; only the model is bounded, to that many rows of a value a language.
    """
    counts = materialise(gram_counts(materialise(word_counts(docs), "word-counts")), "gram-counts")
    totals = counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()  # at most five rows a language
    langs = sorted({r["lang"] for r in totals}, key=str.encode)
    at = {lang: i for i, lang in enumerate(langs)}
    each = counts.groupBy("size", "gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    each, places, rows = materialise(each, "grams"), {size: {} for size in (0, *SIZES)}, []
    for size in (0, *SIZES):
        n = np.full(len(langs), smoothing)
        for r in totals:
            if r["size"] == size:
                n[at[r["lang"]]] += r["n"]
        for r in each.where(F.col("size") == size).orderBy(F.desc("all"), "gram").limit(most if size else most_words).select("gram", "by").toLocalIterator():
            row = np.full(len(langs), smoothing)
            for lang, count in r["by"]:
                row[at[lang]] += count
            places[size][r["gram"]] = len(rows)
            rows.append(np.log(row / n).astype(np.float32))
    words_of = np.zeros(len(langs))
    for r in totals:
        words_of[at[r["lang"]]] += r["n"]
    return Model(langs, places, np.array(rows, np.float32).reshape(len(rows), len(langs)), int(words_of.argmax()) if langs else -1)


def backoff(model: Model, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The log frequencies of unknown words: the mean of a word's longest n-grams that are known. Which words have any, and theirs in this order."""
    where, flat, lengths = [], [], []
    left = list(enumerate(asked))
    for size in SIZES:
        get, missed = model.places[size].get, []
        for i, w in left:
            padded = w if size == 1 else f" {w} "
            if found := [at for at in map(get, [padded[k : k + size] for k in range(len(padded) - size + 1)]) if at is not None]:
                where.append(i)
                flat += found
                lengths.append(len(found))
            else:
                missed.append((i, w))
        left = missed
    if not where:
        return np.zeros(0, np.int64), np.zeros((0, len(model.langs)))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.array(where), np.add.reduceat(model.scores[flat].astype(np.float64), starts, axis=0) / np.array(lengths)[:, None]


class Judge:
    """A model with the unknown words that a task has met: each has a row beside the model's, the last row being nothing."""

    def __init__(self, model: Model) -> None:
        self.model, self.size = model, len(model.scores)
        self.most = max(1000, min(REMEMBERED, (1 << 24) // max(1, len(model.langs))))
        self.rows = np.zeros((self.size + self.most + 1, len(model.langs)))
        self.rows[: self.size] = model.scores
        self._start()

    def _start(self) -> None:
        self.known, self.next = dict(self.model.places[0]), self.size

    def _places(self, asked: list[str]) -> list[int]:
        """The rows of at most self.most words."""
        at = list(map(self.known.get, asked))
        if None not in at:
            return at
        if self.next + at.count(None) > self.size + self.most:
            self._start()
            at = list(map(self.known.get, asked))
        new = [i for i, x in enumerate(at) if x is None]
        there, values = backoff(self.model, [asked[i] for i in new])
        first, self.next = self.next, self.next + len(new)
        self.rows[first : self.next] = 0  # nothing for words of which no letter is known
        self.rows[first + there] = values
        for k, i in enumerate(new, first):
            at[i] = k
            if len(asked[i]) <= LONGEST:  # longer ones may be of any length, so they aren't remembered
                self.known[asked[i]] = k
        return at

    def verdict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its share of the likelihood, and und for one without letters or with nothing learned."""
        seen, langs = words(text), self.model.langs
        if not seen or not langs:
            return "und", 0.0
        total, asked, n = np.zeros(len(langs)), list(seen), np.fromiter(seen.values(), np.float64, len(seen))
        for i in range(0, len(asked), self.most):
            total += n[i : i + self.most] @ self.rows[self._places(asked[i : i + self.most])]
        if not total.any():  # log frequencies are below zero
            return langs[self.model.usual], round(1 / len(langs), 6)
        share = np.exp(total - total.max())
        best = int(share.argmax())
        return langs[best], round(float(share[best] / share.sum()), 6)


def language_id(docs: DataFrame, most: int = 40_000, most_words: int = 100_000) -> DataFrame:
    """A row a document: doc_id, held_out, lang_pred, score. Learned from the text and lang of the documents that aren't held out and have a lang.

    Defined cases: a null text, or one without a letter, is und with score 0, as is every text if nothing was learned; a text of whose letters
    none is known is of the language of most words; of equally likely languages the first by bytes is taken; a null doc_id stays null and is held
    out; rows that repeat doc_id and text get the same verdict; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("NOT held_out AND lang IS NOT NULL"), most, most_words))  # of bounded size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(model.value)
        for each in frames:
            found = [judge.verdict(text) for text in each["text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score"])
            out.insert(0, "held_out", each["held_out"].astype(bool))
            out.insert(0, "doc_id", each["doc_id"].astype("Int64"))
            yield out

    return rows.selectExpr("cast(doc_id as long) doc_id", "held_out", "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
