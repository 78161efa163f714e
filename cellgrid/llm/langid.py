"""Language identification, words first: a known word speaks by its log frequency in each language, an unseen one by its longest known character n-grams.

The model is fitted on a bounded sample: about SAMPLE_CHARS characters a language, about TOTAL_CHARS in all, at most SAMPLE_TEXT_CHARS of one text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import materialise, others, part_of, remove, spare, thin

SAMPLE_CHARS, TOTAL_CHARS, SAMPLE_TEXT_CHARS = 3_000_000, 24_000_000, 200_000
MAX_LANGUAGES = 500
#: A word is known if the sample has it so often, in all languages together.
MIN_COUNT = 2
#: An n-gram is known from so many occurrences; longest first.
ORDERS, MIN_GRAM = (5, 4, 3, 2, 1), 3
SMOOTHING = 0.1
UNDETERMINED = "und"
CACHE = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class LanguageModel:
    """One matrix of log probabilities, a column a language; rows for known words and for the known n-grams of each order.

    words and grams: (text, counts in the order of langs). An n-gram's order is its length, so one table holds them all."""

    def __init__(self, langs: list[str], words: list[tuple[str, list[int]]], grams: list[tuple[str, list[int]]]):
        self.langs = langs
        self.word_at = {w: i for i, (w, _) in enumerate(words)}
        self.gram_at: dict[str, int] = {}
        parts = [_logs([c for _, c in words], len(langs))]
        start = len(words)
        for n in ORDERS:
            own = [x for x in grams if len(x[0]) == n]
            self.gram_at |= {g: start + i for i, (g, _) in enumerate(own)}
            parts.append(_logs([c for _, c in own], len(langs)))
            start += len(own)
        self.matrix = np.concatenate([*parts, np.zeros((1, len(langs)), np.float32)])

    def evidence(self, word: str) -> list[int]:
        """Rows whose mean speaks for the word: its own if it is known, else those of its known n-grams of the greatest length that has any; else the last row, zero."""
        at = self.word_at.get(word)
        if at is not None:
            return [at]
        known = self.gram_at
        for n in ORDERS:
            marked = f"^{word}$" if n > 1 else word
            if rows := [known[g] for g in [marked[i : i + n] for i in range(len(marked) - n + 1)] if g in known]:
                return rows
        return [len(self.matrix) - 1]

    def word_row(self, word: str) -> np.ndarray:
        return self.matrix[self.evidence(word)].astype(float).mean(axis=0)


def _logs(counts: list[list[int]], langs: int) -> np.ndarray:
    table = np.array(counts, float).reshape(len(counts), langs)
    return np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (len(table) + 1))).astype(np.float32)


class _Rows(dict):
    """Row numbers of words met so far in one matrix that grows; new words are added text by text."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.matrix = np.zeros((1024, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self]
        if not new:
            return
        found = list(map(self.model.evidence, new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for rows in found for i in rows), np.int64, int(sizes.sum()))
        means = np.add.reduceat(self.model.matrix[flat], np.cumsum(sizes) - sizes, axis=0, dtype=float) / sizes[:, None]
        start = len(self)
        while start + len(new) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[start : start + len(new)] = means
        self.update(zip(new, range(start, start + len(new)), strict=True))


class Identifier:
    def __init__(self, model: LanguageModel):
        self.model, self.rows = model, _Rows(model)

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (ties: the first by name) and its share of the likelihood. Null, or no letter, or no language learned: 'und', 0."""
        if not text or not self.model.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        words = words_of(text)
        if len(self.rows) > CACHE:
            self.rows = _Rows(self.model)
        self.rows.learn(words)
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        logs = self.rows.matrix[at].sum(axis=0)
        best = int(logs.argmax())
        return self.model.langs[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum())


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS, text_chars: int = SAMPLE_TEXT_CHARS) -> LanguageModel:
    """Fits on a sample of the labelled rows, drawn by a hash of key and text, with at most text_chars characters of one text; every language with a text has a part in it.
    Word counts are summed in each task, then by language and word. Repeated rows count as often as they are there.

    The sample bounds what reaches the driver: about total_chars characters' words. More than MAX_LANGUAGES distinct values of the language raise an error."""
    use = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), part_of(F.col(text_col).cast("string"), text_chars, [key_col, text_col]).alias("text"), F.col(key_col).cast("string").alias("k")
    )
    langs = sorted(r["lang"] for r in use.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model has a column for each")
    each = min(sample_chars, total_chars // max(1, len(langs)))
    sample = thin(use, ["k", "text"], F.length("text"), each, "lang")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            yield _counted([(x, w, n) for x, c in counts.items() for w, n in c.items()])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = counts.setdefault(lang, Counter())
                for order in ORDERS:
                    for g in grams_of(word, order):
                        own[g] += n
            yield _counted([(x, g, n) for x, c in counts.items() for g, n in c.items()])

    kind = "lang string, item string, n long"
    words = sample.select("lang", "text").mapInArrow(count_words, kind).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = materialise(words, "language-words")
    grams = words.mapInArrow(count_grams, kind)
    known = [_by_language(x, langs, least) for x, least in ((words, MIN_COUNT), (grams, MIN_GRAM))]
    remove(words)
    return LanguageModel(langs, *known)


def _counted(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "item", "n"])


def _by_language(counted: DataFrame, langs: list[str], least: int) -> list[tuple[str, list[int]]]:
    """Items seen at least so often in all languages together, with their counts in each; as many as the sample can hold."""
    if not langs:
        return []
    sums = counted.groupBy("item").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, x in enumerate(langs)])
    table = sums.where(F.col("n") >= least).drop("n").toArrow()
    counts = np.stack([table[f"n{k}"].to_numpy() for k in range(len(langs))], axis=1).tolist()
    return sorted(zip(table["item"].to_pylist(), counts, strict=True))


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` (0 to 1) for each whole text; columns of these names are replaced. No shuffle; the model's size follows from its sample."""
    held = df.sparkSession.sparkContext.broadcast(model)
    out = df.select(*others(df, ["lang_pred", "score"]), F.col(text_col).cast("string").alias(spare(df, "_text")))
    schema = T.StructType([*out.schema[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = Identifier(held.value)
        for batch in batches:
            got = [name(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return out.mapInArrow(run, schema)
