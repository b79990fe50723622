"""Periodic runs of words, found with a dictionary of basic factors.

For every power of two, equal factors (stretches of words) of that length have
equal names; the names of one length are pairs of names of the length before.
A run of period ``q`` holds at least four periods, so with the power of two
``f``, ``f / 2 < q <= f``, each factor of length ``f`` in it comes again after
``q`` words, and by the periodicity lemma no sooner. Hence a stretch of
neighbouring places whose successors are all at distance ``q`` proposes the
period, and is extended to the run.

The words of a whole batch of texts are named at once, the words of each text
apart, so the work is a few sorts of arrays. Factors that occur once have no
name and drop out of the longer lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import as_text, words_of

SCHEMA = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


@dataclass(frozen=True)
class Limits:
    """A run counts if it holds ``periods`` (four at least) periods and ``words`` words."""

    periods: int = 4
    words: int = 6
    batch_words: int = 400_000

    def __post_init__(self):
        if self.periods < 4:
            raise ValueError("shorter runs are not found by factors of one length")


def find_runs(names: np.ndarray, ends: np.ndarray, limits: Limits = Limits()) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start and period.

    ``names``: the words of several texts one after the other, as integers that no two texts share.
    ``ends``: for each word, where its text ends.
    """
    name, n, found = names.astype(np.int64), len(names), []
    f = 1
    longest = int(np.diff(np.concatenate([[0], np.unique(ends)])).max()) if n else 0
    places = np.arange(n)
    while len(places) and limits.periods * (f // 2 + 1) <= longest:
        order = np.argsort(name[places], kind="stable")
        place, key = places[order], name[places][order]
        same = key[1:] == key[:-1]
        gap = place[1:] - place[:-1]
        near = same & (gap <= f) & (gap > f // 2)
        found.append(_stretches(place[:-1][near], gap[near], f))
        again = np.zeros(len(place), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        # Names of the next length, for places both of whose halves occur twice.
        number = np.cumsum(np.concatenate([[True], ~same]))
        here = np.zeros(n, dtype=np.int64)
        here[place[again]] = number[again]
        places = np.sort(place[again])
        places = places[places + f < n]
        places = places[here[places + f] > 0]
        name = np.zeros(n, dtype=np.int64)
        name[places] = here[places] * (n + 1) + here[places + f]
        f *= 2
    if not found:
        return np.empty((0, 3), dtype=np.int64)
    start, length, period = np.concatenate(found).T
    long = (length >= limits.words) & (length >= limits.periods * period)
    return _extended(names, ends, start[long], length[long], period[long])


def _stretches(place: np.ndarray, gap: np.ndarray, f: int) -> np.ndarray:
    """Neighbouring places with one and the same gap, as rows of start, length and period."""
    if not len(place):
        return np.empty((0, 3), dtype=np.int64)
    order = np.argsort(place)
    place, gap = place[order], gap[order]
    head = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(gap) != 0)])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(place)) - 1
    return np.column_stack([place[first], place[last] - place[first] + gap[first] + f, gap[first]])


def _extended(names: np.ndarray, ends: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Runs as far as their period holds, each once."""
    n = len(names)
    while True:
        left = (start > 0) & (names[np.maximum(start - 1, 0)] == names[np.maximum(start - 1, 0) + period])
        stop = start + length
        right = (stop < n) & (names[np.minimum(stop, n - 1)] == names[np.minimum(stop, n - 1) - period])
        if not (left.any() or right.any()):
            break
        start, length = start - left, length + left + right
    runs = np.unique(np.column_stack([start, period, length]), axis=0) if len(start) else np.empty((0, 3), dtype=np.int64)
    return runs[:, [0, 2, 1]]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without what repeats the first period of a run."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _batch(texts: list[list[bytes]], limits: Limits) -> Iterator[np.ndarray]:
    """The runs of each text, its words numbered from 0."""
    parts, base = [], 0
    for words in texts:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
        parts.append(at + base)
        base += len(ids)
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    stop = np.cumsum(sizes)
    runs = find_runs(np.concatenate(parts), np.repeat(stop, sizes), limits)
    bounds = np.searchsorted(runs[:, 0], np.concatenate([[0], stop]))
    for k in range(len(texts)):
        own = runs[bounds[k] : bounds[k + 1]].copy()
        own[:, 0] -= stop[k] - sizes[k]
        yield own


def _rows(texts: list[str | None], limits: Limits) -> Iterator[tuple]:
    waiting: list[list[bytes]] = []
    size = 0

    def flush():
        for words, runs in zip(waiting, _batch(waiting, limits), strict=True):
            listed = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
            yield len(words), listed, b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")

    for text in texts:
        waiting.append(words_of(text))
        size += len(waiting[-1])
        if size >= limits.batch_words:
            yield from flush()
            waiting, size = [], 0
    if waiting:
        yield from flush()


def periodic_runs(docs: DataFrame, *, text: str = "text", into: str = "periodic", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with a struct ``into``: number of words, all runs by start and period, and the collapsed text.

    A run is a stretch of words with smallest period ``period`` that cannot be
    extended. Words that repeat the first period of a run are dropped from the
    collapsed text; the others are joined by one space.

    A map over whole texts, however long, without a shuffle. Null, empty and
    blank texts have no words, no runs and an empty collapsed text. Of runs
    with one start, the one of smaller period comes first. Repeated rows have equal
    results; an empty table gives an empty one. A column named ``into`` is replaced, all others stay.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(list(_rows([as_text(t) for t in texts], limits)), columns=["n_words", "runs", "collapsed"])

    # Not to be copied into the expressions that are made of its fields.
    return docs.withColumn(into, run.asNondeterministic()(F.col(f"`{text}`")))


def greatest(runs: Column) -> Column:
    """The run that holds most periods; of equal ones the first, then the one of smaller period. Null if there is none."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def planted(words: list[bytes], h: int) -> list[bytes]:
    """``words`` that repeat from place ``a`` on, with a period that ``h`` sets."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def with_planted_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where the words of every tenth document, by a hash of its id, repeat from some place on.

    Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))

    @F.pandas_udf("string")
    def run(hashes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(
            [b" ".join(planted(words_of(t), int(x))).decode("utf-8", "surrogatepass") if x % 10 == 0 and t and words_of(t) else t
             for x, t in zip(hashes, map(as_text, texts), strict=True)], dtype=object,
        )

    return docs.withColumn(text, run(F.coalesce(h, F.lit(1)), F.col(f"`{text}`")))
