"""SentencePiece encoding with the N best segmentations, and decoding.

A text is a lattice of pieces. A forward Viterbi pass gives each place the best
score from the start. Backward from the end, an A* search extends partial
segmentations to the left; the forward score of its place is an exact estimate
of what is still to come, so complete segmentations leave the queue best first.
As the estimate is exact, each open segmentation stands for a complete one of just
that score: the N best open ones hold the N best, and no more are kept. Segmentations
share their tails by pointers, so memory and time are linear in an unbroken run.

Texts are cut where no piece reaches over, which leaves the result as it is:
the best segmentations of a text then follow from those of its units, and units
recur, so most are looked up. Of the units of a text only the N - 1 with the
smallest loss of their second best can differ from the best one in the N best.

Alternatives are kept as the spans in which they differ from the best ids;
``apply_spans`` writes them out.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
BARRED = -1e8
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

SCHEMA = (
    "struct<ids: array<int>, n_tokens: long, score: double, round_trip: boolean, "
    "alternatives: array<struct<score: double, spans: array<struct<from: int, to: int, ids: array<int>>>>>>"
)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: what a lattice needs of a model. About as large as the model's file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_from: int  # id of <0x00>, or -1
    unk: int
    usable: tuple[bool, ...]
    dummy_prefix: bool = True


def load_pieces(model: str = MODEL) -> Pieces:
    """Read a model with the identity normaliser. Runs on the driver, once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    usable = tuple(not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n))
    first = sp.piece_to_id("<0x00>")
    return Pieces(
        tuple(sp.id_to_piece(i) for i in range(n)), tuple(sp.get_score(i) for i in range(n)),
        first if sp.is_byte(first) else -1, sp.unk_id(), usable,
    )


class Remembered(dict):
    """Words and units already cut. When the young ones are many they become the old ones, and the
    former old ones go; what is used again is young again. So memory is bounded and frequent words stay."""

    MOST = 250_000
    LONGEST = 1_000  # characters of what is remembered, so that the entries are bounded in bytes, too

    def __init__(self, cut):
        super().__init__()
        self.cut, self.old = cut, {}

    def __missing__(self, text: str):
        got = self.old.get(text)
        if got is None:
            got = self.cut(text)
            if len(text) > self.LONGEST:
                return got
        if len(self) >= self.MOST:
            self.old = dict(self)
            self.clear()
        self[text] = got
        return got


class Segmenter:
    """Encodes and decodes with one vocabulary; one per worker."""

    def __init__(self, vocab: Pieces, n: int):
        self.vocab, self.n = vocab, n
        self.longest, self.piece = 1, {}
        # A node of the tree of pieces: nodes by next character, ids and score of the piece that ends here.
        self.root: tuple[dict, list] = ({}, [])
        inside: set[str] = set()
        spanned = False
        for i, (p, s) in enumerate(zip(vocab.pieces, vocab.scores)):
            if not vocab.usable[i]:
                continue
            self.longest, self.piece[p] = max(self.longest, len(p)), ((i,), s)
            inside.update(p[k - 1 : k + 1] for k in range(1, len(p)))
            node = self.root
            for c in p:
                node = node[0].setdefault(c, ({}, []))
            node[1][:] = [((i,), s)]
            spanned |= SPACE in p.lstrip(SPACE)
        self.inside = inside
        # Finds all pieces of a word in one pass; used where every character is a piece itself.
        self.finder = ahocorasick.Automaton()
        for i, (p, s) in enumerate(zip(vocab.pieces, vocab.scores)):
            if vocab.usable[i]:
                self.finder.add_word(p, (len(p) - 1, (i,), s))
        if len(self.finder):
            self.finder.make_automaton()
        self.single = {p for i, p in enumerate(vocab.pieces) if vocab.usable[i] and len(p) == 1}
        # Models bar pieces with a score of -1e9; those do not count as the lowest.
        self.unk_score = min((s for i, s in enumerate(vocab.scores) if vocab.usable[i] and s > BARRED), default=0.0) - UNKNOWN_PENALTY
        # Where no piece holds a space after another character, words are independent.
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S) if not spanned else re.compile("(?s).+")
        self.known, self.unit = Remembered(self.cut), Remembered(self.viterbi)
        self.best_of = Remembered(self.ranked)
        self.borders = re.compile(r"\b").finditer
        # UTF-8 of every id. A byte piece is its byte, which is read together with its neighbours.
        low = vocab.bytes_from
        out = [bytes([i - low]) if 0 <= low <= i < low + 256 else p.replace(SPACE, " ").encode() for i, p in enumerate(vocab.pieces)]
        self.out = pa.array(out, type=pa.large_binary())

    def arcs(self, unit: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The arcs (start, ids, score) of the lattice that end at a place."""
        found = []
        for i in range(max(0, end - self.longest), end):
            arc = self.piece.get(unit[i:end])
            if arc is not None:
                found.append((i, *arc))
        if unit[end - 1] not in self.single:
            found.append((end - 1, self.unknown(unit[end - 1]), self.unk_score))
        return found

    def unknown(self, char: str) -> tuple[int, ...]:
        """Ids of a character without a piece: its bytes, or the unknown id."""
        low = self.vocab.bytes_from
        return tuple(low + b for b in char.encode("utf-8", "surrogatepass")) if low >= 0 else (self.vocab.unk,)

    def forward(self, unit: str) -> list[float]:
        """Best score from the start up to each place."""
        best = [0.0]
        for end in range(1, len(unit) + 1):
            best.append(max([best[i] + s for i, _, s in self.arcs(unit, end)]))
        return best

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of a unit, best first; among equal scores the last ids that differ decide, smaller first.

        ``queue`` holds open segmentations by their ids from the end backward: the first of
        those with the best score is next, its extensions take its place, and the last of
        those with the worst score are given up when there are more than can still be found.
        """
        best = self.forward(unit)
        # (score with the estimate, place, score so far, (ids of the last arc, the arcs right of it))
        queue: list[tuple] = [(best[-1], len(unit), 0.0, None)]
        found: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(found) < n:
            scores = [e[0] for e in queue]
            k = scores.index(max(scores))
            _, at, gone, tail = queue.pop(k)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                found.append((gone, tuple(ids)))
                continue
            more = sorted(self.arcs(unit, at), key=lambda arc: arc[1][::-1])
            queue[k:k] = [(best[i] + gone + s, i, gone + s, (ids, tail)) for i, ids, s in more]
            while len(queue) > n - len(found):
                scores = [e[0] for e in reversed(queue)]
                queue.pop(-1 - scores.index(min(scores)))
        return found

    def viterbi(self, u: str) -> tuple[bytes, float, float]:
        """The best segmentation and the runner-up's loss, in one forward pass over the arcs as they are found.

        Of equally good arcs into a place the one with the smaller last id leads, as in ``search``.
        """
        n, none, root = len(u), float("-inf"), self.root
        best, second, back = [0.0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        fast = self.single.issuperset(u)
        for end, (less, ids, s) in self.finder.iter(u) if fast else ():
            i = end - less
            end += 1
            x, b = best[i] + s, best[end]
            if x > b:
                # What was best, or the runner-up of where the arc begins; runners-up never lead.
                y = second[i] + s
                second[end] = y if y > b else b
                best[end], back[end] = x, (i, ids)
            elif x > second[end]:
                second[end] = x
                if x == b and ids < back[end][1]:
                    back[end] = (i, ids)
            elif x == b and ids < back[end][1]:
                back[end] = (i, ids)
        for i in range(0 if fast else n):
            first, other, node, single = best[i], second[i], root, False
            for j in range(i, n):
                node = node[0].get(u[j])
                if node is None:
                    break
                if not node[1]:
                    continue
                ids, s = node[1][0]
                x, y, at = first + s, other + s, j + 1
                if j == i:
                    single = True
                if x > best[at]:
                    if best[at] > y:
                        y = best[at]
                    best[at], back[at] = x, (i, ids)
                else:
                    if x == best[at] and ids[::-1] < back[at][1][::-1]:
                        back[at] = (i, ids)
                    if x > y:
                        y = x
                if y > second[at]:
                    second[at] = y
            if not single:
                # Only longer pieces from further left can compete with a character without a piece.
                ids, at = self.unknown(u[i]), i + 1
                x, y = first + self.unk_score, other + self.unk_score
                if x > best[at]:
                    y = max(y, best[at])
                    best[at], back[at] = x, (i, ids)
                else:
                    if x == best[at] and ids[::-1] < back[at][1][::-1]:
                        back[at] = (i, ids)
                    y = max(y, x)
                second[at] = max(second[at], y)
        at, ids = n, []
        while at:
            at, last = back[at]
            ids.extend(last[::-1])
        return array("i", ids[::-1]).tobytes(), best[n], best[n] - second[n]

    def split(self, word: str) -> list[str]:
        """Units of a word: cut where letters end or begin, if no piece holds the two characters there."""
        # Most words are letters behind a space, with one sign after them or none.
        if len(word) > 2 and word[1:-1].isalnum() and (word[0].isalnum() or word[:2] in self.inside):
            last = word[-1]
            whole = last.isalnum() or last != "_" and word[-2:] in self.inside
            if whole or last != "_":
                return [word] if whole else [word[:-1], last]
        cuts = [k for k in map(_AT, self.borders(word)) if 0 < k < len(word) and word[k - 1 : k + 1] not in self.inside]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def cut(self, word: str) -> tuple[bytes, float, float]:
        """Packed ids, score and the loss of the second best (infinite if there is none) of a word or unit."""
        units = self.split(word)
        if len(units) == 1:
            return self.unit[word] if word in self.unit else self.viterbi(word)
        # A unit may have been met as a word of its own.
        parts = [self.known.get(u) or self.unit[u] for u in units]
        if len(parts) == 2:
            (ids, score, loss), (more, other, least) = parts
            return ids + more, score + other, loss if loss < least else least
        return b"".join([p[0] for p in parts]), sum(p[1] for p in parts), min(p[2] for p in parts)

    def encode(self, text: str) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """Ids and score of the best segmentation, and the next ``n - 1`` as (score, spans)."""
        if not text:
            return np.empty(0, dtype=np.int32), 0.0, []
        words = self.words.findall((SPACE if self.vocab.dummy_prefix else "") + text.replace(" ", SPACE))
        packed, scores, losses = zip(*map(self.known.__getitem__, words))
        ids = np.frombuffer(b"".join(packed), dtype=np.int32)
        score = float(sum(scores))
        return ids, score, self.alternatives(words, packed, losses, score) if self.n > 1 else []

    def ranked(self, unit: str) -> list[tuple[float, int, int, list[int]]]:
        """The N best of a unit as (score, from, to, ids): what stands instead of the best ids from one place to another."""
        (top, first), *rest = self.search(unit, self.n)
        out = [(top, 0, 0, [])]
        for score, ids in rest:
            low, high, most = 0, 0, min(len(first), len(ids))
            while low < most and first[low] == ids[low]:
                low += 1
            while high < most - low and first[-1 - high] == ids[-1 - high]:
                high += 1
            out.append((score, low, len(first) - high, list(ids[low : len(ids) - high])))
        return out

    def alternatives(self, words, packed, losses, score):
        more = self.n - 1
        loss = np.array(losses)
        if len(loss) > more:
            limit = np.partition(loss, more - 1)[more - 1]
            chosen = np.flatnonzero(loss <= limit)
            if len(chosen) > more:
                low = chosen[loss[chosen] < limit]
                chosen = np.sort(np.concatenate([low, chosen[loss[chosen] == limit][: more - len(low)]]))
        else:
            chosen = np.arange(len(loss))
        slots, at, done = [], 0, 0  # a slot: the place of its first id, the N best of the unit
        for k in chosen[np.isfinite(loss[chosen])].tolist():
            at, done = at + sum(map(len, packed[done:k])) // 4, k
            place = at
            for u in self.split(words[k]):
                ids, _, second = self.unit[u]
                if second < float("inf"):
                    slots.append((place, self.best_of[u]))
                place += len(ids) // 4
        # The same search over choices: a state is a rank for each slot, its successors lower one rank.
        queue, seen, out = [(0.0, (0,) * len(slots))], set(), []
        while queue and len(out) <= more:
            lost, ranks = heapq.heappop(queue)
            out.append((score - lost, [
                (at + best[r][1], at + best[r][2], best[r][3]) for (at, best), r in zip(slots, ranks) if r
            ]))
            for k, r in enumerate(ranks):
                best = slots[k][1]
                if r + 1 < len(best):
                    nxt = (*ranks[:k], r + 1, *ranks[k + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(queue, (lost + best[r][0] - best[r + 1][0], nxt))
        return out[1:]

    def decode(self, ids) -> str:
        """Text of ids; runs of byte pieces are read as UTF-8, the dummy prefix goes. Ids out of range raise."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.out):
            raise ValueError("id out of range")
        # The cells of an Arrow column lie one behind the other, so their bytes are the text's.
        _, ends, cells = self.out.take(pa.array(ids)).buffers()
        size = int(np.frombuffer(ends, dtype=np.int64)[len(ids)])
        whole = cells.to_pybytes()[:size].decode("utf-8", "replace") if size else ""
        return whole[1:] if self.vocab.dummy_prefix and whole.startswith(" ") else whole


def apply_spans(ids, spans) -> list[int]:
    """An alternative's ids from the best ids and its spans (from, to, ids), which are in order."""
    out, done = [], 0
    for start, end, new in spans:
        out.extend(ids[done:start])
        out.extend(new)
        done = end
    out.extend(ids[done:])
    return out


_AT = re.Match.start
_SEGMENTERS: dict[tuple[int, int], Segmenter] = {}


def _segmenter(shared, n: int) -> Segmenter:
    key = (shared.value.__hash__(), n)
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(shared.value, n)
    return _SEGMENTERS[key]


def _packed(rows: Iterator[tuple | None]) -> pa.Array:
    """Rows of ``SCHEMA`` as one Arrow array; the ids stay packed all the way."""
    ids, n, scores, trips, valid, alts = [], [0], [], [], [], []
    for r in rows:
        valid.append(r is not None)
        best, score, more, trip = r if r is not None else (np.empty(0, dtype=np.int32), None, None, None)
        ids.append(best)
        n.append(n[-1] + len(best))
        scores.append(score)
        trips.append(trip)
        alts.append(None if more is None else [
            {"score": s, "spans": [{"from": a, "to": b, "ids": x} for a, b, x in spans]} for s, spans in more
        ])
    values = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), type=pa.int32())
    span = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("ids", pa.list_(pa.int32()))])
    alt = pa.list_(pa.struct([("score", pa.float64()), ("spans", pa.list_(span))]))
    columns = [
        pa.ListArray.from_arrays(pa.array(n, type=pa.int32()), values), pa.array(np.diff(n), type=pa.int64()),
        pa.array(scores, type=pa.float64()), pa.array(trips, type=pa.bool_()), pa.array(alts, type=alt),
    ]
    return pa.StructArray.from_arrays(columns, ["ids", "n_tokens", "score", "round_trip", "alternatives"], mask=pa.array([not v for v in valid]))


def encode_column(spark, text: Column, *, model: str = MODEL, n: int = 4) -> Column:
    """A struct of ``SCHEMA`` for each whole text: best ids and score, whether decoding gives the text back, and the next ``n - 1``.

    A null text has a null struct; an empty one has no ids, score 0 and no
    alternatives. A text with fewer segmentations than ``n`` has fewer
    alternatives. Scores are sums of piece scores, whatever way the model was
    trained; characters without a piece become bytes.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    shared = spark.sparkContext.broadcast(load_pieces(model))

    @F.arrow_udf(SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        s = _segmenter(shared, n)

        def rows():
            for t in texts.to_pylist():
                if t is None:
                    yield None
                    continue
                ids, score, more = s.encode(t)
                yield ids, score, more, s.decode(ids) == t

        return _packed(rows())

    return run(text)


def decode_column(spark, ids: Column, *, model: str = MODEL) -> Column:
    """Text of an array of ids; null ids give null, an empty array the empty text."""
    shared = spark.sparkContext.broadcast(load_pieces(model))

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        s = _segmenter(shared, 1)
        return pa.array([None if v is None else s.decode(v) for v in values.to_pylist()], type=pa.string())

    return run(ids)


def encode(docs: DataFrame, *, text: str = "text", into: str = "pieces", model: str = MODEL, n: int = 4) -> DataFrame:
    """``docs`` with the struct of ``encode_column`` as ``into``; a column of that name is replaced."""
    return docs.withColumn(into, encode_column(docs.sparkSession, F.col(f"`{text}`"), model=model, n=n))
