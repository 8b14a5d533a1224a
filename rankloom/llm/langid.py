"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language. A word it doesn't know backs
off to its longest character n-grams that are known, then to shorter ones. A text's score for a
language is the sum over all its words; the prediction is the largest, its score the posterior of
that language under equal priors.

The model is fitted on a bounded sample of the labelled rows: about ``SAMPLE`` documents for each
language, chosen by a hash of id and text (so an id that very many rows have isn't in as a whole), so that it takes as long for any input. That is its only bound:
every language, every word of the sampled documents and every n-gram of those words is in its
tables, whose size follows from the sample. Prediction reads whole texts only, never language, source
or id.

Defined results: ``und`` and 0.0 for a null text, a text without a letter, or a model without a
language; ties go to the language that sorts first; repeated rows are predicted one by one; rows
without an id are never learned from and never held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents a language that the model is fitted on, about.
SAMPLE = 600
ORDERS = (4, 3, 2, 1)
#: Pseudo-counts of a word, and of an n-gram, in a language that hasn't shown it.
SMOOTH = 0.2
CACHE = 200_000
#: Rows of a batch that are in Python at a time.
SLICE = 512
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Log frequencies by language: one row of ``matrix`` for each known word and n-gram, the last row for nothing known."""

    def __init__(self, languages: list[str], counts: Iterable[tuple[str, str, int]]):
        """counts: (language, word, count)."""
        self.languages = sorted(languages)
        place = {x: i for i, x in enumerate(self.languages)}
        self.words: dict[str, int] = {}
        row, column, value = [], [], []
        for lang, word, n in counts:
            row.append(self.words.setdefault(word, len(self.words)))
            column.append(place[lang])
            value.append(n)
        parts = [_table(len(self.words), len(place), row, column, value)]
        names, at = list(self.words), len(self.words)
        self.grams: dict[int, dict[str, int]] = {}
        for n in ORDERS:
            found: dict[str, int] = {}
            who, grams = [], []
            for r, w in enumerate(names):
                for g in _grams(w, n):
                    who.append(r)
                    grams.append(found.setdefault(g, len(found)))
            # A gram's count in a language: that of each word it stands in, once for each place.
            parts.append(np.zeros((len(found), len(place))))
            np.add.at(parts[-1], np.array(grams, np.int64), parts[0][np.array(who, np.int64)])
            self.grams[n] = {g: at + j for g, j in found.items()}
            at += len(found)
        logs = [np.log((p + SMOOTH) / (p.sum(axis=0) + SMOOTH * max(1, len(p)))) for p in parts]
        self.matrix = np.concatenate([*logs, np.zeros((1, len(place)))]).astype(np.float32)

    def rows(self, word: str) -> list[int]:
        """The rows whose mean is the word's score: its own, or those of its longest known n-grams."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        for n in ORDERS:
            get = self.grams[n].get
            found = [r for g in _grams(word, n) if (r := get(g)) is not None]
            if found:
                return found
        return [len(self.matrix) - 1]


def _table(n: int, k: int, row: list[int], column: list[int], value: list[int]) -> np.ndarray:
    out = np.zeros((n, k))
    np.add.at(out, (np.array(row, np.int64), np.array(column, np.int64)), np.array(value, np.float64))
    return out


def _grams(word: str, n: int) -> list[str]:
    w = word if n == 1 else f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Predictor:
    """A model and a cache of word scores as rows of one matrix."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > CACHE:
            self._clear()
            new = list(words)
        if not new:
            return
        rows = [self.model.rows(w) for w in new]
        counts = np.array([len(r) for r in rows])
        flat = self.model.matrix[np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))]
        means = np.add.reduceat(flat, np.cumsum(counts) - counts, axis=0) / counts[:, None]
        first, end = len(self.row), len(self.row) + len(new)
        if end > len(self.scores):
            self.scores = np.concatenate([self.scores[:first], np.zeros((2 * end - first, self.scores.shape[1]))])
        self.scores[first:end] = means
        self.row.update(zip(new, range(first, end), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, at = [], 0
        while at < len(texts):  # about 2 MB of text at a time
            to, load, split = at, 0, []
            while to < len(texts) and (to == at or load < 2 << 20):
                load += len(texts[to] or "")
                split.append(_WORD.findall(texts[to].lower()) if texts[to] else [])
                to += 1
            self._learn(set().union(*split))
            out += map(self._one, split)
            at = to
        return out

    def _one(self, words: list[str]) -> tuple[str, float]:
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        s = self.scores[list(map(self.row.__getitem__, words))].sum(axis=0)
        best = int(s.argmax())
        return self.model.languages[best], 1.0 / float(np.exp(np.minimum(s - s[best], 0.0)).sum())


def fit(docs: DataFrame, *, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Model:
    """Fit on a sample of the labelled rows that aren't held out."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row a language
    if not n:
        return Model([], [])
    share = docs.sparkSession.createDataFrame([(k, min(1.0, sample / c)) for k, c in n.items()], "_lang string, _share double")
    place = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), place.alias("_place")).join(F.broadcast(share), "_lang").filter("_place < _share")
    words = chosen.select("_lang", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0))).alias("_word"))
    counts = words.groupBy("_lang", "_word").count().toArrow()  # as many rows as the sample has words
    return Model(list(n), zip(*(c.to_pylist() for c in counts.columns), strict=True))


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``, which replace columns of those names; others stay as they are."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by SAMPLE
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text)
    rows = docs.select(*names)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = Predictor(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                b = batch.slice(k, SLICE)
                found = p.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Fit on the table's own labels, then predict: doc_id, held_out, lang_pred, score."""
    model = fit(docs, text=text)
    d = docs.select("doc_id", F.col(text).alias("text"))
    return predict(d, model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))

