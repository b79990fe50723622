"""Toxicity with a bidirectional gated recurrent network and attention pooling.

A word enters as its own vector and as the mean of the vectors of its character
n-grams, so inflected and unseen forms keep what their parts say; one of over 40
characters, such as a sentence in a script without spaces, enters as overlapping
pieces, each a word. Two gated
recurrent networks read a window in both directions, attention pools their
states, and a logistic unit gives the window's score. Every document is cut into
overlapping windows that cover all its words; its score is that of its worst
window, calibrated. The network is written and trained in numpy.

Labels hold for documents, not windows. In training a toxic document stands for
its highest-scoring window and a clean one for its highest and a random one,
chosen anew in every epoch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.common import Sample, as_text, fit_logistic, labelled_sample, sigmoid, words_of

_INNER = re.compile(r"[\W_]+")
# Longer tokens are cut into pieces: short ones, as a word's n-grams are averaged, and such that the longest n-gram, of five, lies whole in one.
LONGEST, PIECE, OVERLAP = 40, 16, 4


@dataclass(frozen=True)
class Settings:
    """``per_class`` and ``max_chars`` bound what is learned from: so many texts of either label, a window of each."""

    per_class: int = 800
    max_chars: int = 16000
    calibrate_every: int = 5
    window: int = 48
    stride: int = 36
    hidden: int = 12
    word_dim: int = 8
    char_dim: int = 8
    attention: int = 12
    vocabulary: int = 6000
    min_count: int = 3
    buckets: int = 16384
    epochs: int = 6
    batch: int = 128
    rate: float = 0.01
    forget: float = 0.5
    seed: int = 11


def normal(token: bytes) -> str:
    """A token as the network reads it: lower case, letters and digits only."""
    return _INNER.sub("", token.decode("utf-8", "replace").lower())


def tokens_of(text: str | None) -> list[bytes]:
    """The words of ``text``; those of over ``LONGEST`` letters and digits in overlapping pieces, so that none is cut short."""
    words = words_of(text)
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[bytes] = []
    for word in words:
        w = normal(word) if len(word) > LONGEST else ""
        if len(w) > LONGEST:
            out += [w[i : i + PIECE].encode("utf-8", "surrogatepass") for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
        else:
            out.append(word)
    return out


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of three to five, with each word's ends marked: all words' buckets
    one after the other, and how many each word has."""
    marked = [f"^{w}$" if w else "" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters to the word's end
    ids, owners = [], []
    with np.errstate(over="ignore"):
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, 6):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] if len(h) else h
            if n > 2:
                ok = left[: len(h)] >= n
                mixed = h[ok] ^ (h[ok] >> np.uint64(29))
                ids.append(((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % buckets)
                owners.append(owner[: len(h)][ok])
    at = np.concatenate(owners)
    return np.concatenate(ids)[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(words))


def pick(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` and ``sizes`` of some rows only."""
    n = sizes[rows]
    first = (np.cumsum(sizes) - sizes)[rows]
    return flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Inputs(dict):
    """Tokens of a text as rows of a table of known words, made when first met: the word's own row, and its form."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.rows: dict[str, int] = {}
        self.words: list[int] = [0]
        self.forms: list[str] = [""]

    def __missing__(self, token: bytes) -> int:
        w = normal(token)
        row = self.rows.get(w)
        if row is None:
            row = self.rows[w] = len(self.words)
            self.words.append(self.vocabulary.get(w, 0))
            self.forms.append(w)
        self[token] = row
        return row

    def read(self, text: str | None) -> np.ndarray:
        words = tokens_of(text)
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def windows(n: int, s: Settings) -> np.ndarray:
    """First words of the overlapping windows that cover ``n`` words."""
    return np.arange(0, max(n - (s.window - s.stride), 1), s.stride) if n else np.empty(0, dtype=np.int64)


def cut_windows(rows: np.ndarray, starts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each window, padded with 0, and which places are filled."""
    at = starts[:, None] + np.arange(s.window)
    filled = at < len(rows)
    return np.where(filled, rows[np.minimum(at, max(len(rows) - 1, 0))], 0), filled


@dataclass
class Model:
    """Weights by name, the vocabulary, and the curve from the worst window's logit to a score."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    curve: tuple[float, float]
    settings: Settings


def embed(p: dict[str, np.ndarray], words: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Input vectors of rows: the word's, and the mean of its n-grams'."""
    chars = np.zeros((len(words), p["chars"].shape[1]), dtype=np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        chars[some] = np.add.reduceat(p["chars"][flat], (np.cumsum(sizes) - sizes)[some], axis=0) / sizes[some, None]
    return np.concatenate([p["words"][words], chars], axis=1).astype(np.float32)


def recur(gates: np.ndarray, filled: np.ndarray, u: np.ndarray, c: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [2, N, T, H] of both directions from input gates [2, N, T, 3H] in reading order of each direction."""
    _, n, t, h3 = gates.shape
    h = h3 // 3
    state = np.zeros((2, n, h), dtype=np.float32)
    out = np.empty((2, n, t, h), dtype=np.float32)
    for k in range(t):
        rec = state @ u + c[:, None]
        g = gates[:, :, k]
        zr = 1 / (1 + np.exp(-(g[:, :, : 2 * h] + rec[:, :, : 2 * h])))
        z, r = zr[:, :, :h], zr[:, :, h:]
        new = np.tanh(g[:, :, 2 * h :] + r * rec[:, :, 2 * h :])
        m = np.stack([filled[:, k], filled[:, t - 1 - k]])[:, :, None]
        if keep is not None:
            keep.append((state, z, r, new, rec[:, :, 2 * h :], m))
        state = np.where(m, new + z * (state - new), state)
        out[:, :, k] = state
    return out


def pool(p: dict[str, np.ndarray], both: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows from their states [N, T, 2H] by attention."""
    u = np.tanh(both @ p["wa"] + p["ba"])
    s = np.where(filled, u @ p["va"], -1e9)
    a = np.exp(s - s.max(axis=1, keepdims=True)) * filled
    a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
    pooled = (a[:, :, None] * both).sum(axis=1)
    return pooled @ p["wo"] + p["bo"][0], (u, a, pooled)


def join_directions(out: np.ndarray) -> np.ndarray:
    return np.concatenate([out[0], out[1][:, ::-1]], axis=2)


def gate_table(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Input gates [rows, 2, 3H] of input vectors: what a word adds, whatever its neighbours."""
    return np.einsum("nd,kdg->nkg", x, p["w"]).astype(np.float32) + p["b"]


def logits(p: dict[str, np.ndarray], table: np.ndarray, rows: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Window logits; ``table`` from ``gate_table``."""
    gates = np.stack([table[rows, 0], table[rows[:, ::-1], 1]])
    return pool(p, join_directions(recur(gates, filled, p["u"], p["c"])), filled)[0]


def gradients(p, x, rows, filled, y, weight) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss, gradients of the weights, and of the input vectors ``x`` of ``rows``."""
    n, t = rows.shape
    xs = x[rows]
    seq = np.stack([xs, xs[:, ::-1]])
    gates = np.einsum("kntd,kdg->kntg", seq, p["w"]).astype(np.float32) + p["b"][:, None, None]
    kept: list = []
    both = join_directions(recur(gates, filled, p["u"], p["c"], kept))
    out, (ua, a, pooled) = pool(p, both, filled)
    prob = sigmoid(out)
    loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum())
    d = (weight * (prob - y) / weight.sum()).astype(np.float32)
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()], dtype=np.float32)}
    dp = d[:, None] * p["wo"]
    dboth = a[:, :, None] * dp[:, None]
    da = (both * dp[:, None]).sum(axis=2)
    ds = a * (da - (a * da).sum(axis=1, keepdims=True))
    g["va"] = np.einsum("nt,nta->a", ds, ua)
    du = ds[:, :, None] * p["va"] * (1 - ua**2)
    g["wa"], g["ba"] = np.einsum("nth,nta->ha", both, du), du.sum(axis=(0, 1))
    dboth += du @ p["wa"].T
    h = p["u"].shape[1]
    dstates = np.stack([dboth[:, :, :h], dboth[:, ::-1, h:]])
    dgates = np.zeros_like(gates)
    g["u"], g["c"] = np.zeros_like(p["u"]), np.zeros_like(p["c"])
    back = np.zeros((2, n, h), dtype=np.float32)
    ut = p["u"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        state, z, r, new, rec, m = kept[k]
        dh = back + dstates[:, :, k]
        live = dh * m
        dz = live * (state - new) * z * (1 - z)
        dn = live * (1 - z) * (1 - new**2)
        dr = dn * rec * r * (1 - r)
        dgates[:, :, k] = np.concatenate([dz, dr, dn], axis=2)
        drec = np.concatenate([dz, dr, dn * r], axis=2)
        g["u"] += state.transpose(0, 2, 1) @ drec
        g["c"] += drec.sum(axis=1)
        back = dh * ~m + live * z + drec @ ut
    g["w"] = np.einsum("kntd,kntg->kdg", seq, dgates)
    g["b"] = dgates.sum(axis=(1, 2))
    dseq = np.einsum("kntg,kdg->kntd", dgates, p["w"])
    dx = dseq[0] + dseq[1][:, ::-1]
    dx[~filled] = 0
    return loss, g, dx


def _start(s: Settings, texts: list[set[str]], y: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Random weights; the first place of each input vector starts at what the part says of toxic documents."""
    rng = np.random.default_rng(s.seed)
    counts = [Counter(), Counter()]
    parts = [Counter(), Counter()]
    known = sorted(set().union(*texts))
    number, (flat, sizes) = {w: k for k, w in enumerate(known)}, grams(known, s.buckets)
    for words, label in zip(texts, y.astype(int)):
        counts[label].update(words)
        own = np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))
        parts[label].update(np.unique(pick(flat, sizes, own)[0]).tolist())
    size = [max(1, int((y == k).sum())) for k in (0, 1)]

    def odds(c, key):
        return np.log((c[1][key] + 0.5) / (size[1] + 1)) - np.log((c[0][key] + 0.5) / (size[0] + 1))

    seen = [(c, w) for w, c in (counts[0] + counts[1]).items() if c >= s.min_count and w]
    seen.sort(key=lambda v: (-abs(odds(counts, v[1])) * np.sqrt(v[0]), v[1]))
    vocabulary = {w: k + 1 for k, (_, w) in enumerate(seen[: s.vocabulary])}
    dim, h = s.word_dim + s.char_dim, s.hidden
    f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {
        "words": f(len(vocabulary) + 1, s.word_dim, scale=0.1), "chars": f(s.buckets, s.char_dim, scale=0.1),
        "w": f(2, dim, 3 * h, scale=dim**-0.5), "b": np.zeros((2, 3 * h), dtype=np.float32),
        "u": f(2, h, 3 * h, scale=h**-0.5), "c": np.zeros((2, 3 * h), dtype=np.float32),
        "wa": f(2 * h, s.attention, scale=(2 * h) ** -0.5), "ba": np.zeros(s.attention, dtype=np.float32), "va": f(s.attention, scale=0.3),
        "wo": f(2 * h, scale=0.3), "bo": np.zeros(1, dtype=np.float32),
    }
    p["words"][0] = 0
    for w, k in vocabulary.items():
        p["words"][k, 0] = 0.5 * odds(counts, w)
    p["chars"][:, 0] = 0
    for b in sorted(parts[0].keys() | parts[1].keys()):
        if parts[0][b] + parts[1][b] >= s.min_count:
            p["chars"][b, 0] = 0.5 * odds(parts, b)
    return p, vocabulary


def train(sample: Sample, s: Settings = Settings()) -> Model:
    """Fit on labelled texts. With one label or none the score is a constant."""
    rows = [(t, y) for t, y in sample.rows if words_of(t)]
    y = np.array([label for _, label in rows], dtype=np.float64)
    if not 2 <= y.sum() <= len(y) - 2:
        share = (sample.counts[1] + 1) / (sum(sample.counts) + 2)
        p, vocabulary = _start(s, [], np.empty(0))
        return Model(p, vocabulary, (0.0, float(np.log(share / (1 - share)))), s)
    held = np.zeros(len(rows), dtype=bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[:: s.calibrate_every]] = True
    learn = np.flatnonzero(~held)
    p, vocabulary = _start(s, [{normal(w) for w in tokens_of(rows[k][0])} for k in learn], y[learn])
    inputs = Inputs(vocabulary)
    texts = [inputs.read(t) for t, _ in rows]
    words = np.array(inputs.words)
    flat, sizes = grams(inputs.forms, s.buckets)
    cuts = [cut_windows(r, windows(len(r), s), s) for r in texts]
    owner = np.repeat(np.arange(len(rows)), [len(c[0]) for c in cuts])
    all_rows, all_filled = (np.concatenate([c[k] for c in cuts]) for k in (0, 1))
    rng = np.random.default_rng(s.seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0

    def window_scores(x: np.ndarray) -> np.ndarray:
        table = gate_table(p, x)
        return np.concatenate([logits(p, table, all_rows[i : i + 2048], all_filled[i : i + 2048]) for i in range(0, len(all_rows), 2048)])

    for epoch in range(s.epochs):
        x = embed(p, words, flat, sizes)
        # Before the network knows anything, its inputs' first places tell the windows apart.
        hint = np.maximum(x[:, 0], 0) + np.maximum(x[:, s.word_dim], 0)
        scores = window_scores(x) if epoch else np.where(all_filled, hint[all_rows], 0).max(axis=1)
        order = np.lexsort((-scores, owner))
        top = order[np.searchsorted(owner[order], learn)]
        clean = learn[y[learn] == 0]
        begin = np.searchsorted(owner, clean)
        end = np.searchsorted(owner, clean, side="right")
        chance = begin + (rng.random(len(clean)) * (end - begin)).astype(np.int64)
        chosen = np.concatenate([top, chance])
        chosen = chosen[rng.permutation(len(chosen))]
        # Small samples go in small batches, so that there are steps enough.
        batch = int(np.clip(len(chosen) // 20, 8, s.batch))
        for i in range(0, len(chosen), batch):
            k = chosen[i : i + batch]
            used, local = np.unique(all_rows[k], return_inverse=True)
            # Every other word is taken as unknown, so that its parts must say what it means.
            seen = np.where(rng.random(len(used)) < s.forget, 0, words[used])
            ids, many = pick(flat, sizes, used)
            x = embed(p, seen, ids, many)
            label = y[owner[k]]
            _, g, dx = gradients(p, x, local.reshape(all_rows[k].shape), all_filled[k], label, np.where(label == 1, 1.5, 1.0))
            flatdx = np.zeros((len(used), x.shape[1]), dtype=np.float32)
            np.add.at(flatdx, local.ravel(), dx.reshape(-1, x.shape[1]))
            g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
            np.add.at(g["words"], seen, flatdx[:, : s.word_dim])
            g["words"][0] = 0
            mine = np.repeat(np.arange(len(used)), many)
            np.add.at(g["chars"], ids, (flatdx[:, s.word_dim :] / np.maximum(many, 1)[:, None])[mine])
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[name] -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    scores = window_scores(embed(p, words, flat, sizes))
    worst = np.full(len(rows), -np.inf)
    np.maximum.at(worst, owner, scores)
    label = y[held]
    weights = np.where(label == 1, sample.counts[1] / max(1, label.sum()), sample.counts[0] / max(1, (1 - label).sum()))
    curve = fit_logistic(worst[held][:, None] / 4, label, weights, ridge=1e-2)
    return Model(p, vocabulary, (float(curve[0]) / 4, float(curve[1])), s)


class Scorer:
    """A model at work in one task: gates of the words met so far, emptied when they are many."""

    MOST = 150_000

    def __init__(self, model: Model):
        self.model, self.inputs = model, None

    def _gates(self) -> np.ndarray:
        new = slice(len(self.table), len(self.inputs.words))
        if new.stop > new.start:
            x = embed(self.model.p, np.array(self.inputs.words[new]), *grams(self.inputs.forms[new], self.model.settings.buckets))
            self.inputs.forms[new] = [""] * (new.stop - new.start)
            self.table = np.concatenate([self.table, gate_table(self.model.p, x)])
        return self.table

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; one without words gets what the network says of nothing."""
        p = self.model.p
        worst = np.full(len(texts), -np.inf)
        for owner, rows, filled in self._batches(texts):
            np.maximum.at(worst, owner, logits(p, self._gates(), rows, filled))
        worst[np.isinf(worst)] = float(p["bo"][0])
        a, b = self.model.curve
        return sigmoid(a * worst + b)

    def _batches(self, texts: list[str | None], most: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of the texts, about ``most`` at a time: which text each is of, its rows, the filled places."""
        s, held, n = self.model.settings, [], 0
        for k, t in enumerate(texts):
            if not held and (self.inputs is None or len(self.inputs) > self.MOST):
                self.inputs = Inputs(self.model.vocabulary)
                self.table = np.empty((0, 2, 3 * s.hidden), dtype=np.float32)
            read = self.inputs.read(t)
            starts = windows(len(read), s)
            for i in range(0, len(starts), most):
                rows, filled = cut_windows(read, starts[i : i + most], s)
                held.append((np.full(len(rows), k), rows, filled))
                n += len(rows)
                if n >= most:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))


def fit(docs: DataFrame, labels: DataFrame, fold: Column, *, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from the rows of ``labels`` (doc_id and ``label``) for which ``fold`` holds."""
    return train(labelled_sample(docs, labels, label, fold, settings.per_class, settings.max_chars), settings)


def score_column(spark, text: Column, model: Model) -> Column:
    """A double from 0 to 1 for each whole text. Null, empty and blank texts get one and the same score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in parts:
            yield pd.Series(scorer.score([as_text(t) for t in texts]))

    return run(text)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score as ``into``; a column of that name is replaced. Rows are judged by their text alone."""
    return docs.withColumn(into, score_column(docs.sparkSession, F.col(f"`{text}`"), model))
