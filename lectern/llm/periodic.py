"""Runs of periodically repeated words, found by where dyadic blocks occur again in their neighbourhood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are searched together until they have so many words; a longer text is searched alone.
WORDS = 1 << 17
#: A run has at least so many words, and at least so many times its period.
LEAST_WORDS, LEAST_POWER = 6, 4


class WaveletMatrix:
    """Whole numbers below 2**bits in an order; counts and order statistics of any stretch, many stretches at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (values >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _down(self, level: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stretches of the numbers whose next bit is 0, and of those whose next bit is 1."""
        a, b = self.ones[level][low], self.ones[level][high]
        return low - a, high - b, a + self.zeros[level], b + self.zeros[level]

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers of the stretch are less than x."""
        count = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            low0, high0, low1, high1 = self._down(level, low, high)
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(one, high0 - low0, 0)
            low, high = np.where(one, low1, low0), np.where(one, high1, high0)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with k smaller ones in the stretch."""
        value = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            low0, high0, low1, high1 = self._down(level, low, high)
            one = k >= high0 - low0
            k = k - np.where(one, high0 - low0, 0)
            value = value << 1 | one
            low, high = np.where(one, low1, low0), np.where(one, high1, high0)
        return value


def _grouped(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the codes, and for each place in it where its group of equal codes begins and ends."""
    order = np.argsort(code, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1], [True]]))
    size = np.diff(edge)
    return order, np.repeat(edge[:-1], size), np.repeat(edge[1:], size)


class Blocks:
    """The suffix array of texts that are searched together, with the ranks of all stretches of 1, 2, 4, ... words.

    Suffixes of different texts are never equal.  Only those whose first two words occur again in their
    text are in the array (``suffixes``): all others can't begin a repeated block.  ``ranks[k]`` is
    equal at two places if and only if the same 2**k words of the same text begin there.
    """

    def __init__(self, words: np.ndarray, of: np.ndarray, end: np.ndarray):
        n = len(words)
        order, first, _ = _grouped(of.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        single = np.empty(n, np.int64)
        single[order] = first
        self.ranks = [single]
        order, first, last = _grouped(single * (n + 1) + self._behind(np.arange(n), 1, end))
        again = last - first > 1
        self.suffixes = order[again]
        slot = np.cumsum(again) - 1  # the array holds these suffixes alone
        rank = np.arange(n) + n
        rank[self.suffixes] = slot[first[again]]
        self.ranks.append(rank)
        #: Blocks that occur again in their text and begin at a multiple of their length: place, length, stretch of the array.
        self.blocks = [self._aligned(self.suffixes, 2, slot[first[again]], slot[last[again] - 1] + 1)]
        slots, length = np.arange(len(self.suffixes)), 2
        while len(slots):
            at = self.suffixes[slots]
            order, first, last = _grouped(rank[at] * (2 * n + 1) + self._behind(at, length, end))
            self.suffixes[slots] = at = at[order]
            length *= 2
            rank = rank.copy()
            rank[at] = slots[first]
            more = last - first > 1
            if not more.any():
                break
            self.ranks.append(rank)
            self.blocks.append(self._aligned(at[more], length, slots[first[more]], slots[last[more] - 1] + 1))
            slots = slots[more]

    def _behind(self, at: np.ndarray, by: int, end: np.ndarray) -> np.ndarray:
        """1 + the rank so many words further on, 0 beyond the end of the text."""
        on = at + by
        return np.where(on < end[at], self.ranks[-1][np.minimum(on, len(end) - 1)] + 1, 0)

    @staticmethod
    def _aligned(at: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        use = at % length == 0
        return np.stack([at[use], np.full(use.sum(), length), low[use], high[use]])

    def forward(self, at: np.ndarray, by: np.ndarray) -> np.ndarray:
        """How many words from a place on are the same ``by`` words further on."""
        on = at.copy()
        for k in reversed(range(len(self.ranks))):
            inside = on + by < len(self.ranks[k])
            here = np.where(inside, on, 0)
            on = on + ((inside & (self.ranks[k][here] == self.ranks[k][np.where(inside, on + by, 0)])).astype(np.int64) << k)
        return on - at

    def backward(self, at: np.ndarray, by: np.ndarray) -> np.ndarray:
        """How many words before a place are the same ``by`` words further on."""
        on = at.copy()
        for k in reversed(range(len(self.ranks))):
            here = on - (1 << k)
            inside = here >= 0
            here = np.maximum(here, 0)
            on = on - ((inside & (self.ranks[k][here] == self.ranks[k][here + by])).astype(np.int64) << k)
        return at - on


def find_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of texts laid end to end (word numbers, words of each text), by start, then period.

    A run of period q holds a whole aligned block of the length B with q < B <= 2q, and q words more of the run lie
    before or behind the block; so the block's next occurrence behind it, or the last one before it, is q
    words away: both are asked of the wavelet matrix over the suffix array, and such a progression
    of step q is a candidate, which ranks of dyadic stretches extend to both sides as far as the period lasts."""
    ends = np.cumsum(lengths)
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none
    found = Blocks(words, np.repeat(np.arange(len(lengths)), lengths), np.repeat(ends, lengths))
    at, length, low, high = np.concatenate(found.blocks, axis=1)
    if not len(at):
        return none, none, none
    array = WaveletMatrix(found.suffixes, len(words).bit_length())
    before, behind = array.below(low, high, at), array.below(low, high, at + 1)
    some = behind < high - low
    step = array.smallest(low[some], high[some], behind[some]) - at[some]
    back = before > 0
    step_back = at[back] - array.smallest(low[back], high[back], before[back] - 1)
    start = np.concatenate([at[some], at[back] - step_back])
    period = np.concatenate([step, step_back])
    size = np.concatenate([length[some], length[back]])
    near = (2 * period >= size) & (period < size)
    start, period = start[near], period[near]
    left = found.backward(start, period)
    total = left + found.forward(start, period) + period
    start = start - left
    long = total >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
    start, total, period = start[long], total[long], period[long]
    order = np.lexsort((period, total, start))
    start, total, period = start[order], total[order], period[order]
    fresh = np.ones(len(start), bool)  # of equal stretches the one of the smallest period
    fresh[1:] = (start[1:] != start[:-1]) | (total[1:] != total[:-1])
    start, total, period = start[fresh], total[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], total[order], period[order]


def _collapsed(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Of texts as words: for each the starts, lengths and periods of its runs, and its words without the repeats of runs."""
    lengths = np.array([len(t) for t in texts], np.int64)
    every = [w for t in texts for w in t]
    numbers = pa.array(every, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if every else np.empty(0, np.int64)
    start, total, period = find_runs(numbers, lengths)
    gone = np.zeros(len(every) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + total, -1)
    stays = np.cumsum(gone)[:-1] == 0
    edge = np.concatenate([[0], np.cumsum(lengths)])
    cut = np.searchsorted(start, edge)
    for i, words in enumerate(texts):
        a, b = cut[i], cut[i + 1]
        kept = words if a == b else [w for w, stay in zip(words, stays[edge[i] : edge[i + 1]].tolist(), strict=True) if stay]
        yield start[a:b] - edge[i], total[a:b], period[a:b], kept


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_words, runs, collapsed)."""
    for batch in batches:
        texts = [(t or b"").split() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        at = 0
        while at < len(texts):
            to, held = at + 1, len(texts[at])
            while to < len(texts) and held + len(texts[to]) <= WORDS:
                held += len(texts[to])
                to += 1
            found = list(_collapsed(texts[at:to]))
            flat = [pa.array(np.concatenate([f[c] for f in found]), pa.int64()) for c in range(3)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["start", "length", "period"]))
            kept = pa.array([b" ".join(f[3]).decode() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([len(t) for t in texts[at:to]], pa.int64()), runs, kept], ["id", "n_words", "runs", "collapsed"])
            at = to


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All stretches of words of each text that repeat with some period, as far as they go.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run has the smallest period q (words q apart are identical), at least
    max(6, 4q) words, and no neighbour that continues it.  Returns one row for each row: the key, ``n_words``,
    ``runs`` (start, length, period; by start, then period) and ``collapsed``: the words that no run contains behind its
    first q words, one blank between.

    Whole texts are searched, many short ones at a time; the memory for a text follows its number of words.  Null,
    empty and blank texts: no words, no runs, collapsed ''.  Each row is searched for itself, so null and repeated keys
    are returned as they came.  No rows: no rows.  Other columns are not looked at, whatever their names.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_search, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", key)
