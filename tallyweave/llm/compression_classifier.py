"""Quality by compression: which of two dictionaries helps a text more?

One zstandard dictionary is built from good texts and one from bad ones. Every
text is compressed with both, in fixed chunks, so that a dictionary counts
throughout and not only until the text has a history of its own. The difference
of the sizes by their sum, as the chunks have it, goes through a logistic curve
that is fitted on labelled texts the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import Sample, as_text, fit_logistic, labelled_sample, sigmoid


@dataclass(frozen=True)
class Settings:
    """``per_class`` and ``max_chars`` bound what is learned from: so many texts of either label, a window of each.

    Of these, one in ``calibrate_every`` sets the curve, the others make the dictionaries.
    """

    per_class: int = 2000
    max_chars: int = 4096
    calibrate_every: int = 5
    dictionary_bytes: int = 112640
    chunk: int = 2048
    level: int = 3
    shrink: int = 48


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    settings: Settings

    def scorer(self) -> "Scorer":
        return Scorer(self)


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the ends of the texts themselves."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        share = max(64, size // max(1, len(texts)))
        return b"".join(t[:share] for t in texts)[-size:]


class Scorer:
    """Compressors of one model, for one task."""

    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = (self._compressor(d) for d in (model.good, model.bad))

    def _compressor(self, data: bytes) -> zstandard.ZstdCompressor:
        level = self.model.settings.level
        # Raw text or a trained dictionary: zstandard tells them apart by the magic number.
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: str | None) -> float:
        """Normalised difference of the compressed sizes, over 0 if the good dictionary helps more; 0 without text."""
        s = self.model.settings
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        good = bad = 0
        for i in range(0, len(raw), s.chunk):
            piece = raw[i : i + s.chunk]
            good += len(self.good.compress(piece))
            bad += len(self.bad.compress(piece))
        return (bad - good) / (bad + good + s.shrink)

    def score(self, differences) -> np.ndarray:
        w = np.asarray(self.model.curve)
        return sigmoid(features(np.asarray(differences, dtype=float)) @ w[:-1] + w[-1])


def features(d: np.ndarray) -> np.ndarray:
    """The difference, and how far it lies on the bad side: the two slopes of the curve differ."""
    return np.column_stack([d * 10, np.minimum(d, 0) * 10])


def train(sample: Sample, settings: Settings = Settings()) -> Model:
    """Dictionaries and curve from labelled texts; with one label or none, a constant score.

    The dictionaries get as many texts of either label; in the curve the labels weigh as in all rows.
    """
    by = {y: [t for t in sample.texts(y) if t] for y in (0, 1)}
    if min(len(v) for v in by.values()) < 2:
        share = (sample.counts[1] + 1) / (sum(sample.counts) + 2)
        return Model(b"none", b"none", (0.0, 0.0, float(np.log(share / (1 - share)))), settings)
    k = settings.calibrate_every
    made = {y: [t.encode("utf-8", "surrogatepass") for i, t in enumerate(v) if i % k or len(v) < k] for y, v in by.items()}
    model = Model(dictionary(made[1], settings.dictionary_bytes), dictionary(made[0], settings.dictionary_bytes), (), settings)
    held = [(t, y) for y, v in by.items() for t in v[::k]]
    scorer = model.scorer()
    d = np.array([scorer.difference(t) for t, _ in held])
    y = np.array([label for _, label in held], dtype=float)
    weights = np.where(y == 1, sample.counts[1] / y.sum(), sample.counts[0] / (1 - y).sum())
    curve = fit_logistic(features(d), y, weights)
    return Model(model.good, model.bad, tuple(float(w) for w in curve), settings)


def fit(docs: DataFrame, labels: DataFrame, fold: Column, *, label: str = "quality", settings: Settings = Settings()) -> Model:
    """Learn from the rows of ``labels`` (doc_id and ``label``) for which ``fold`` holds."""
    return train(labelled_sample(docs, labels, label, fold, settings.per_class, settings.max_chars), settings)


def score_column(spark, text: Column, model: Model) -> Column:
    """A double from 0 to 1 for each whole text. Null and empty texts have a difference of 0 and the score that goes with it."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = shared.value.scorer()
        return pd.Series(scorer.score([scorer.difference(as_text(t)) for t in texts]))

    return run(text)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score as ``into``; a column of that name is replaced. Rows are judged by their text alone."""
    return docs.withColumn(into, score_column(docs.sparkSession, F.col(f"`{text}`"), model))
