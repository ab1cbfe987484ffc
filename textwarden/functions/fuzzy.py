"""Nearly literal quotes: the similarity that no built-in function gives, behind filters that lose no match.

The ratio is 2 M / (n + m) for texts of n and m characters whose matching blocks hold M. The blocks are a common subsequence, so M is at most the
longest one's length; and they leave at most kq = n - M characters of the quote and kw = m - M of the window without a partner. Of the quote's n - 2 runs
of three characters each lost character breaks at most three and each stranger between two matched ones at most two, so at least n - 2 - 3 kq - 2 kw
stand in the window as they are: a text that holds fewer has no such window. A run that is left stands as far from the window's begin as from the
quote's, but for the strangers or lost characters before it, n - M at most of either. So as many places of the text have a run that the quote has on a
diagonal (place in the text less place in the quote) no farther than that from the window's begin.

In windows of 200 characters and more the library begins no block at a popular character (see _held_in_runs), which leaves few blocks, and long ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def least_matched(n: int, m: int, threshold: float) -> int:
    """The fewest matched characters with which texts of n and m characters reach the threshold."""
    least = max(0, ceil(threshold * (n + m) / 2) - 1)
    while n + m and 2.0 * least / (n + m) < threshold:
        least += 1
    return least


class Quote:
    """A quote, and for each of its characters the places where it stands, as bits."""

    def __init__(self, text: str):
        self.text, self.places = text, {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def common(self, window: str, lost: int | None = None) -> int:
        """Length of the longest common subsequence (all places of the quote at once, as bits of one number); 0 once over `lost` characters of the window are in vain."""
        whole = free = (1 << len(self.text)) - 1
        for k in range(0, len(window), 16):
            for bits in map(self.places.get, window[k : k + 16]):
                if bits:
                    met = free & bits
                    free = free + met | free - met
            free &= whole
            if lost is not None and min(k + 16, len(window)) - len(self.text) + free.bit_count() > lost:
                return 0
        return len(self.text) - free.bit_count()

    def alike(self, window: str, threshold: float) -> bool:
        least = least_matched(len(self.text), len(window), threshold)
        return self.common(window, len(window) - least) >= least and SequenceMatcher(None, self.text, window).ratio() >= threshold


def near(quote: str, source: str, threshold: float = 0.85) -> bool:
    """Whether a window of the quote's length, moved by an eighth of it, matches by `threshold` (Ratcliff-Obershelp)."""
    n = len(quote)
    if not n:
        return False
    own, seen = Quote(quote), set()
    for at in range(0, max(1, len(source) - n + 1), max(1, n // 8)):
        window = source[at : at + n]
        if window not in seen and own.alike(window, threshold):
            return True
        seen.add(window)
    return False


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _runs(text: str) -> np.ndarray:
    """Each run of three code points as one number."""
    c = _points(text)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each pair the numbers start, start + 1, ..., start + count - 1."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


#: Characters of a text whose windows are looked at together, and places in quotes that its runs are compared with at one time.
PIECE, MET = 1 << 14, 1 << 20
#: Diagonals of quotes that are counted at one time.
HELD = 1 << 22
#: Windows of so many characters have popular ones; runs that are looked for in them, and characters of a piece up to which popular ones are counted.
POPULAR_FROM, RUN, KINDS = 200, 5, 128


def _longer_runs(runs: np.ndarray) -> np.ndarray:
    """Runs of RUN characters as numbers, from those of three; different runs may be one number."""
    return runs[:-2] * np.int64(0x5851F42D4C957F2D) + runs[2:]


class _Grams:
    """Numbers of runs, and the items and places in them that have each."""

    def __init__(self, runs: list[np.ndarray]):
        keys = np.concatenate([np.empty(0, np.int64), *runs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.counts = np.unique(keys[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(r)) for r in runs)])[order]

    def among(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of a text are found among these, and as which."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        slot = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[slot] == runs)
        return at, slot[at]

    def met(self, at: np.ndarray, slot: np.ndarray, use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the text, item and place in it of each run that a text and an item share, by the text's places, then items, then theirs; MET at one time."""
        total = np.cumsum(self.counts[slot])
        cuts = np.searchsorted(total, np.arange(MET, int(total[-1]) if len(total) else 0, MET))
        for at_, slot_ in zip(np.split(at, cuts), np.split(slot, cuts), strict=True):
            counts = self.counts[slot_]
            row, here = _spread(self.starts[slot_], counts), np.repeat(at_, counts)
            if not use.all():
                kept = use[self.item[row]]
                row, here = row[kept], here[kept]
            yield here, self.item[row], self.place[row]


class Quotes:
    """Quotes by their runs of three characters, to be looked for in many texts."""

    def __init__(self, texts: Iterable[str], threshold: float = 0.85):
        self.quotes, self.threshold = [Quote(t) for t in texts], threshold
        runs = [_runs(q.text) for q in self.quotes]
        self.n = np.array([len(q.text) for q in self.quotes], np.int64)
        self.runs, self.longer = _Grams(runs), _Grams([_longer_runs(r) if n >= POPULAR_FROM else r[:0] for r, n in zip(runs, self.n.tolist(), strict=True)])
        self.step = np.maximum(1, self.n // 8)
        self.least = np.array([least_matched(n, n, threshold) for n in self.n.tolist()], np.int64)
        self.lost = self.n - self.least
        self.need = self.n - 2 - 5 * self.lost

    def found(self, text: str) -> Iterator[int]:
        """Numbers of the quotes that stand in the text or are near one of its windows, as near() has it."""
        size = len(text)
        runs = _runs(text)
        at, slot = self.runs.among(runs)
        own = np.unique(slot)
        held = np.bincount(self.runs.item[_spread(self.runs.starts[own], self.runs.counts[own])], minlength=len(self.n))
        whole = np.array([bool(q.text) and h >= n - 2 and q.text in text for q, h, n in zip(self.quotes, held, self.n, strict=True)], bool)
        yield from np.flatnonzero(whole).tolist()
        # With no character to lose only the quote itself is near.
        open_ = ~whole & (self.n > 0)
        for i in np.flatnonzero(open_ & (self.n > size)).tolist():
            if self.quotes[i].alike(text, self.threshold):
                yield i
        long = open_ & (self.n <= size) & (self.lost > 0)
        for i in np.flatnonzero(long & (self.need <= 0)).tolist():  # so short that no run need be left
            if near(self.quotes[i].text, text, self.threshold):
                yield i
        wanted = long & (self.need > 0) & (held >= self.need)
        for first in range(0, size, PIECE):
            if not wanted.any():
                return
            end = min(size, first + PIECE + int(self.n[wanted].max()))
            lo, hi = np.searchsorted(at, [first, end - 2])
            some = np.flatnonzero(wanted)
            for group in np.split(some, np.flatnonzero(np.diff(np.cumsum(self._wide(some, end - first)) // HELD)) + 1):
                whose, begins = self._windows(group, first, size)
                left = np.flatnonzero(self._held_in_runs(text[first:end], runs[first : end - 2], whose, begins - first))
                whose, begins = whose[left], begins[left]
                left = np.flatnonzero(self._held_in_place(end - first, at[lo:hi] - first, slot[lo:hi], whose, begins - first))
                for i, begin in zip(whose[left].tolist(), begins[left].tolist(), strict=True):
                    if wanted[i] and self.quotes[i].alike(text[begin : begin + int(self.n[i])], self.threshold):
                        wanted[i] = False
                        yield i

    def _wide(self, items: np.ndarray, length: int) -> np.ndarray:
        """Diagonals of each item and a piece of the text, and 2 lost before them."""
        return length + self.n[items] + 2 * self.lost[items] + 2

    def _windows(self, some: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Quotes and the begins of their windows in a piece; in the whole text they are multiples of the step."""
        step = self.step[some]
        low, high = -(-first // step), np.minimum(first + PIECE - 1, size - self.n[some]) // step + 1
        windows = np.maximum(high - low, 0)
        whose = np.repeat(some, windows)
        return whose, _spread(low, windows) * self.step[whose]

    def _held_in_runs(self, piece: str, runs: np.ndarray, whose: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which windows can match by blocks that each hold an unpopular character, as they must where the ratio leaves out popular ones.

        In a window of 200 characters or more those that stand there over n // 100 + 1 times begin no block, save one at both begins. Of M matched
        characters in so many blocks, all but RUN - 1 of each begin a run of RUN characters that the quote has too.
        """
        good = np.ones(len(whose), bool)
        some = np.flatnonzero(self.n[whose] >= POPULAR_FROM)
        kind, rank, often = np.unique(_points(piece), return_inverse=True, return_counts=True)
        few = POPULAR_FROM // 100 + 1  # so many are popular in no window
        if not len(some) or (often > few).sum() > KINDS:
            return good
        whose, begins = whose[some], begins[some]
        use = np.zeros(len(self.n), bool)
        use[whose] = True
        # Each quote's runs in the piece, counted up to each place; rows for quotes in use alone.
        row = np.cumsum(use) - 1
        wide = len(piece) + 1
        seen = np.zeros(int(use.sum()) * wide, bool)
        for here, item, _ in self.longer.met(*self.longer.among(_longer_runs(runs)), use):
            seen[row[item] * wide + here + 1] = True
        seen = np.cumsum(seen, dtype=np.int32)
        n, base = self.n[whose], row[whose] * wide + begins
        held = seen[base + n - RUN + 1] - seen[base]
        # The other way round, so many unpopular characters a window needs that holds no more runs.
        wants = -(-(self.least[whose] - held) // (RUN - 1)) - 1
        number = np.full(len(kind), -1)
        number[often > few] = np.arange((often > few).sum())
        up_to = np.zeros((wide, int((often > few).sum()) + 1), np.int32)
        up_to[np.arange(1, wide), number[rank]] = 1  # the last column is that of those never popular
        up_to = np.cumsum(up_to, axis=0, dtype=np.int32)
        for k in range(0, len(some), 1 << 14):
            cut = slice(k, k + (1 << 14))
            count = up_to[begins[cut] + n[cut]] - up_to[begins[cut]]
            most = (n[cut] // 100 + 1).astype(np.int32)[:, None]
            unpopular = count[:, -1] + np.where(count[:, :-1] <= most, count[:, :-1], 0).sum(axis=1)
            good[some[cut]] = unpopular >= wants[cut]
        return good

    def _held_in_place(self, length: int, at: np.ndarray, slot: np.ndarray, whose: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which windows have enough places whose runs the quote has on diagonals that lie no farther than `lost` from the window's begin."""
        use = np.zeros(len(self.n), bool)
        use[whose] = True
        # At x of a quote are the text's places that have a run on one of the diagonals from x to x + 2 lost, each once.
        wide = np.where(use, self._wide(np.arange(len(use)), length), 0)
        base = np.cumsum(wide) - wide + self.n + 2 * self.lost
        change = np.zeros(int(wide.sum()) + 1, np.int64)
        for here, item, place in self.runs.met(at, slot, use):
            diagonal = here - place
            begin, end = diagonal - 2 * self.lost[item], diagonal + 1
            same = np.flatnonzero((here[1:] == here[:-1]) & (item[1:] == item[:-1])) + 1
            end[same] = np.minimum(end[same], begin[same - 1])
            change += np.bincount(base[item] + begin, minlength=len(change)) - np.bincount(base[item] + end, minlength=len(change))
        places = np.cumsum(change)
        return places[base[whose] + begins - self.lost[whose]] >= self.need[whose]


def near_quote(quote: Column, source: Column, threshold: float = 0.85) -> Column:
    """near() of short texts, for the rows that a search has left; null for null."""

    def run(quote: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([near(q or "", s or "", threshold) for q, s in zip(quote, source, strict=True)])

    return F.pandas_udf(run, "boolean")(quote, source)
