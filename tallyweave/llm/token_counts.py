"""Token counts by rank-synchronous merging of ragged arrays.

The symbols of many pre-tokens lie in one flat array, sequence after sequence.
In every round each sequence that still has a pair in the vocabulary merges its
lowest-ranked pair, all sequences at once; sequences without one leave the
arrays. What survives is counted.

A byte-pair model with scores per piece merges the best pair of the whole text,
the leftmost of equals, over and over. Two facts make the batch give the same:

- No piece reaches over two neighbouring characters that stand together in no
  piece, so the text falls apart there into sequences of their own.
- Within one round, occurrences of the lowest rank merge from the left as long
  as no merge brings up a pair of that rank or a lower one; the occurrences
  behind such a merge wait for the next round.

Pre-tokens recur, so their counts are kept in a bounded table per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import as_text

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Merges:
    """What counting needs of a model; its size is that of the model's file, some megabytes."""

    chars: np.ndarray  # code points that occur in pieces; the place of one is its symbol
    is_piece: np.ndarray  # by symbol: whether it stands for itself, or for its bytes
    keys: np.ndarray  # sorted: left symbol * n_symbols + right symbol
    ranks: np.ndarray  # by key
    symbols: np.ndarray  # by key: what the pair becomes
    reopens: np.ndarray  # by symbol: whether a better piece begins or ends with it
    n_symbols: int
    neighbours: np.ndarray  # sorted: pairs of code point symbols that stand together in some piece
    run: int  # longest run of spaces to leave in a sequence, 0: no bound
    alone: str  # frequent white space that no piece holds


def load_merges(model: str = MODEL) -> Merges:
    """Read a byte-pair model with byte fallback, identity normaliser and dummy prefix. Runs on the driver, once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return build_merges([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids])


def build_merges(pieces: list[str], scores: list[float]) -> Merges:
    order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
    rank = {p: order[s] for p, s in zip(pieces, scores, strict=True)}
    chars = sorted({c for p in pieces for c in p})
    symbol = {c: k for k, c in enumerate(chars)}
    for p in pieces:
        symbol.setdefault(p, len(symbol))
    n = len(symbol)
    pairs, near, reopens = {}, set(), np.zeros(n, dtype=bool)
    for p in pieces:
        for k in range(1, len(p)):
            a, b = symbol.get(p[:k]), symbol.get(p[k:])
            if a is not None and b is not None:
                pairs[a * n + b] = (rank[p], symbol[p])
            for part in (p[:k], p[k:]):
                if rank.get(part, -1) >= rank[p]:
                    reopens[symbol[part]] = True
            near.add(symbol[p[k - 1]] * len(chars) + symbol[p[k]])
    keys = np.array(sorted(pairs), dtype=np.int64)
    is_piece = np.zeros(n, dtype=bool)
    is_piece[[symbol[p] for p in pieces]] = True
    return Merges(
        np.array([ord(c) for c in chars], dtype=np.int64), is_piece, keys, np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int32),
        np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int32), reopens, n, np.array(sorted(near), dtype=np.int64), _longest_run(rank),
        "".join(c for c in "\n\t\r" if c not in symbol),
    )


def _longest_run(rank: dict[str, int]) -> int:
    """The longest piece of spaces, if every longer run falls into such pieces from its left and a rest.

    So it does where pieces of two and more spaces rank last, alike, and hold nothing
    else: they are merged after all others, leftmost first. That is tried out here.
    """
    worst = max(rank.values(), default=0)
    runs = {len(p) for p in rank if set(p) == {SPACE} and len(p) > 1}
    if not runs or any(SPACE in p and len(p) > 1 and not (r == worst if set(p) == {SPACE} else r < worst and SPACE * 2 not in p) for p, r in rank.items()):
        return 0
    most = max(runs)

    def left_first(n: int) -> list[int]:
        out = [1] * n
        while (k := next((k for k in range(len(out) - 1) if out[k] + out[k + 1] in runs), None)) is not None:
            out[k : k + 2] = [out[k] + out[k + 1]]
        return out

    full = all(left_first(n) == [most] * ((n - 1) // most) + left_first((n - 1) % most + 1) for n in range(1, 3 * most + 2))
    return most if full else 0


class Counter:
    """Counts of pre-tokens under one model."""

    MOST = 400_000
    LONGEST = 48

    def __init__(self, merges: Merges):
        self.m = merges
        self.table = np.full(0x110000, -1, dtype=np.int32)
        self.table[merges.chars] = np.arange(len(merges.chars), dtype=np.int32)
        alone = re.escape(merges.alone)
        self.cut = re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        self.known: dict[str, int] = {}

    def texts(self, texts: list[str | None], chunk: int = 2_000_000) -> list[int]:
        """Tokens of whole texts, in order; nulls and empty texts have none."""
        out = [0] * len(texts)
        batch, owners, size = [], [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            for part in _parts(" " + text.replace(SPACE, " "), chunk):
                batch.append(self.cut.findall(part))
                owners.append(k)
                size += len(part)
                if size >= chunk:
                    self._add(batch, owners, out)
                    batch, owners, size = [], [], 0
        self._add(batch, owners, out)
        return out

    def _add(self, batch: list[list[str]], owners: list[int], out: list[int]) -> None:
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        new: set[str] = set()
        for tokens in batch:
            new.update(set(tokens).difference(known))
        fresh = sorted(new)
        counts = self.pre_tokens(fresh).tolist()
        long = {}
        for t, n in zip(fresh, counts, strict=True):
            (known if len(t) <= self.LONGEST else long)[t] = n
        look = known.__getitem__ if not long else lambda t: known[t] if t in known else long[t]
        for k, tokens in zip(owners, batch, strict=True):
            out[k] += sum(map(look, tokens))

    def pre_tokens(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token; spaces stand for the model's space symbol."""
        counts = np.zeros(len(tokens), dtype=np.int64)
        if not tokens:
            return counts
        m = self.m
        code = np.frombuffer("".join(tokens).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
        sym = self.table[code]
        absent = sym < 0
        if absent.any():
            # Characters that no piece holds are their UTF-8 bytes.
            c = code[absent]
            counts += np.bincount(owner[absent], weights=1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), minlength=len(tokens)).astype(np.int64)
        whole = np.empty(len(sym), dtype=bool)  # whether a sequence begins here
        whole[0] = True
        near = sym[:-1].astype(np.int64) * len(m.chars) + sym[1:]
        whole[1:] = (owner[1:] != owner[:-1]) | absent[1:] | absent[:-1] | ~_member(m.neighbours, near)
        if m.run:
            whole |= self._runs(code == ord(SPACE), owner)
        keep = ~absent
        sym, owner, seq = sym[keep].astype(np.int64), owner[keep], np.cumsum(whole)[keep]
        for s, o in self._merged(sym, owner, seq):
            # A character that is no piece of its own is its bytes, too.
            width = np.ones(len(s), dtype=np.int64)
            odd = ~m.is_piece[s]
            if odd.any():
                c = m.chars[s[odd]]
                width[odd] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            counts += np.bincount(o, weights=width, minlength=len(tokens)).astype(np.int64)
        return counts

    def _runs(self, space: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Cuts after every full piece of a longer run of spaces; the last spaces stay with what follows."""
        out = np.zeros(len(space), dtype=bool)
        kind = np.where(space, owner, -1)
        edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
        long = space[edge[:-1]] & (np.diff(edge) > self.m.run)
        for a, b in zip(edge[:-1][long].tolist(), edge[1:][long].tolist(), strict=True):
            out[a : b : self.m.run] = True
        return out

    def _merged(self, sym: np.ndarray, owner: np.ndarray, seq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Surviving symbols with their owners, as sequences come to their end."""
        rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
        at = np.flatnonzero(seq[1:] == seq[:-1])
        rank[at], made[at] = self._pairs(sym[at], sym[at + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(rank, start)
            open_ = best < NONE
            if not open_.all():
                stays = np.repeat(open_, size)
                yield sym[~stays], owner[~stays]
                sym, owner, seq, rank, made = sym[stays], owner[stays], seq[stays], rank[stays], made[stays]
                best, size = best[open_], size[open_]
                if not len(sym):
                    return
            pick = np.flatnonzero(rank == np.repeat(best, size))
            pick = _every_other(pick)
            pick = self._before_reopening(pick, sym, seq, rank, made)
            sym[pick] = made[pick]
            keep = np.ones(len(sym), dtype=bool)
            keep[pick + 1] = False
            dirty = np.zeros(len(sym), dtype=bool)
            dirty[pick] = True
            before = pick[pick > 0] - 1
            dirty[np.where(keep[before], before, before - 1)] = True
            sym, owner, seq, rank, made, dirty = sym[keep], owner[keep], seq[keep], rank[keep], made[keep], dirty[keep]
            at = np.flatnonzero(dirty)
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[seq[at] == seq[at + 1]]
            rank[at], made[at] = self._pairs(sym[at], sym[at + 1])

    def _before_reopening(self, pick, sym, seq, rank, made) -> np.ndarray:
        """The picks of each sequence up to its first one that brings up a pair of its own rank or a lower one."""
        s = seq[pick]
        doubtful = self.m.reopens[made[pick]]
        if not doubtful.any() or not (s[1:] == s[:-1]).any():
            return pick
        p, n = np.flatnonzero(doubtful), len(sym)
        at, new = pick[p], made[pick[p]].astype(np.int64)
        opens = np.zeros(len(pick), dtype=bool)
        left = np.flatnonzero((at > 0) & (seq[np.maximum(at - 1, 0)] == seq[at]))
        before = p[left] - 1
        joined = (before >= 0) & (pick[np.maximum(before, 0)] == at[left] - 2)
        l = np.where(joined, made[pick[np.maximum(before, 0)]], sym[at[left] - 1])
        opens[p[left]] |= self._pairs(l, new[left])[0] <= rank[at[left]]
        right = np.flatnonzero((at + 2 < n) & (seq[np.minimum(at + 2, n - 1)] == seq[at]))
        opens[p[right]] |= self._pairs(new[right], sym[at[right] + 2])[0] <= rank[at[right]]
        if not opens.any():
            return pick
        earlier = np.cumsum(opens) - opens
        first = np.concatenate([[True], s[1:] != s[:-1]])
        base = earlier[first][np.cumsum(first) - 1]
        return pick[earlier == base]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.m
        if not len(m.keys) or not len(left):
            return np.full(len(left), NONE, dtype=np.int32), np.zeros(len(left), dtype=np.int32)
        key = left.astype(np.int64) * m.n_symbols + right
        k = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        there = m.keys[k] == key
        return np.where(there, m.ranks[k], NONE), np.where(there, m.symbols[k], 0)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def _every_other(pick: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (chains of neighbouring places) the first, the third and so on."""
    if len(pick) < 2:
        return pick
    head = np.concatenate([[True], np.diff(pick) != 1])
    place = np.arange(len(pick))
    first = place[head][np.cumsum(head) - 1]
    return pick[(place - first) % 2 == 0]


def _parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size``, cut where a run of spaces begins."""
    a = 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while b > 0 and text[b - 1] == " ":
            b -= 1
        if b <= a:
            b = text.find(" ", a + size)
            while 0 <= b < len(text) and text[b] == " ":
                b += 1
            b = text.find(" ", b) if b >= 0 else b
        if b <= a:
            break
        yield text[a:b]
        a = b
    yield text[a:]


def count_tokens(docs: DataFrame, *, text: str = "text", into: str = "n_tokens", model: str = MODEL, merges: Merges | None = None) -> DataFrame:
    """``docs`` with ``into``: the number of tokens of each whole text, as long.

    A map over rows: no shuffle, no state between rows but the table of known
    pre-tokens. Null and empty texts have 0 tokens. Special strings inside a text
    are ordinary text. Very long texts are read in parts of two million characters cut
    between pre-tokens, one unbroken run at a time. Repeated rows and ties have equal counts; an
    empty table gives an empty one. A column named ``into`` is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(merges or load_merges(model))

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for texts in batches:
            yield pd.Series(counter.texts([as_text(t) for t in texts]), dtype="int64")

    return docs.withColumn(into, run(F.col(f"`{text}`")))
