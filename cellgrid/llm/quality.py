"""Quality by compression: zstandard dictionaries of good and of bad labelled text; the better one compresses a text, the more it is of that kind.

A text is cut into pieces of PIECE bytes, as a long one would soon serve as its own dictionary; all pieces count. The feature is
(size with the bad dictionary - size with the good one) / their mean, and a logistic curve fitted on other labelled texts turns it into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import fold, others, part_of, spare, thin

LEVEL, PIECE, DICTIONARY = 3, 2048, 110 * 1024
#: The classifier is fitted on about so many labelled rows of each class and, of those, about so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 6_000_000
#: A longer labelled text takes part in the fit by so many of its characters, from a place chosen by hash, as one of them could be larger than the sample. Scoring reads whole texts.
SAMPLE_TEXT_CHARS = 200_000
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    empty: float

    def scorer(self):
        if not self.good or not self.bad:
            return lambda text: self.empty
        sizes = []
        for raw in (self.good, self.bad):
            trained = zstd.ZstdCompressionDict(raw)
            trained.precompute_compress(level=LEVEL)
            sizes.append(zstd.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = sizes

        def score(text: bytes | None) -> float:
            return self.probability(difference(text, good, bad)) if text else self.empty

        return score

    def probability(self, feature: float) -> float:
        z = self.slope * feature + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def difference(text: bytes, good, bad) -> float:
    with_good = with_bad = 0
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        with_good += len(good(piece))
        with_bad += len(bad(piece))
    return 2 * (with_bad - with_good) / (with_bad + with_good)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; if there are too few texts to train one, the texts themselves."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstd.train_dictionary(DICTIONARY, pieces, k=512, d=8).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with each class weighing as much as it has rows."""
    scale = float(x.std()) or 1.0
    z, w = np.column_stack([x / scale, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "label", key_col: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, text_chars: int = SAMPLE_TEXT_CHARS) -> QualityModel:
    """Fits on a bounded sample of labelled rows (about `rows` rows and `chars` characters a class, drawn by hash of the key, at most `text_chars` of one text); labels other than
    0 and 1 are ignored, as are rows without a key or text.

    Two thirds of the sample make the dictionaries, the rest the curve. With one class only, or none, every score is that class's share (0.5 for none)."""
    use = labelled.where(F.col(label_col).isin(0, 1) & (F.length(text_col) > 0))
    use = use.select(F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y"), part_of(F.col(text_col), text_chars, [key_col]).alias("t"))
    use = thin(thin(use, ["k"], F.lit(1), rows, "y", seed=1), ["k"], F.length("t"), chars, "y", seed=2).withColumn("t", F.col("t").cast("binary"))
    got = use.select("y", "t", (F.pmod(F.xxhash64("k", F.lit(3)), F.lit(3)) == 0).alias("curve")).collect()
    share = sum(r["y"] for r in got) / len(got) if got else 0.5
    makes = [sorted(bytes(r["t"]) for r in got if r["y"] == y and not r["curve"]) for y in (1, 0)]
    if not all(makes):
        return QualityModel(b"", b"", 0.0, 0.0, share)
    raw = QualityModel(dictionary(makes[0]), dictionary(makes[1]), 1.0, 0.0, share)
    compress = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in (raw.good, raw.bad)]
    curve = [r for r in got if r["curve"]] or got
    x = np.array([difference(bytes(r["t"]), *compress) for r in curve])
    y = np.array([float(r["y"]) for r in curve])
    slope, intercept = logistic(x, y) if 0 < y.sum() < len(y) else (0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    return QualityModel(raw.good, raw.bad, slope, intercept, 1 / (1 + math.exp(-intercept)))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", key_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled texts of the folds that are not held out. The labels are thinned first, to about `rows` a class, so only their keys meet the documents.

    A key labelled both 0 and 1 is left out. A row repeated with its key and text counts once."""
    keys = labels.where(F.col(label_col).isin(0, 1) & (fold(key_col, folds) != held_out))
    keys = keys.groupBy(key_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_max")).where("label = _max").select(key_col, F.col("label").cast("int").alias("label"))
    keys = thin(keys, [key_col], F.lit(1), rows, "label", seed=1)
    return docs.select(key_col, text_col).join(F.broadcast(keys), key_col).dropDuplicates([key_col, text_col])  # about 2 * rows keys


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the score, 0 to 1, of each whole text; null and empty texts get the curve's value at no difference. A column of the name is replaced. No shuffle."""
    held = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes
    out = df.select(*others(df, [out_col]), F.col(text_col).cast("binary").alias(spare(df, "_text")))
    schema = T.StructType([*out.schema[:-1], T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            scores = pa.array([score(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], out_col])

    return out.mapInArrow(run, schema)
