"""Parsing of bytes into phrases by a rolling hash, for work inside tasks.

Every window of LENGTH bytes is governed by the smallest rolling hash among the
grams of GRAM bytes in it (the last of equals), its trigger. A phrase is a longest
run of windows with one trigger, so it is cut by content alone: equal windows lie at
the same distance from equal triggers wherever they occur.
"""

from dataclasses import dataclass

import numpy as np

from .words import BYTE_VALUES, mixed, powers

PIECE = 1 << 17    # bytes of text parsed at a time: its arrays stay in a core's cache


@dataclass
class Parse:
    """Phrases of some texts, in order.

    text: number of the text; at: first window, in bytes from the text's start;
    n: windows; trigger: hash of the trigger; begin: first window, in bytes from the
    piece's start.
    """
    text: np.ndarray
    at: np.ndarray
    n: np.ndarray
    trigger: np.ndarray
    begin: np.ndarray
    sums: np.ndarray
    grams: np.ndarray
    arrived: np.ndarray     # whether the trigger is the last gram of the first window
    length: int

    def phrase(self, chosen=slice(None)) -> np.ndarray:
        """Hash of the n + length - 1 bytes of the chosen phrases."""
        return spans(self.sums, self.begin[chosen], self.n[chosen] + self.length - 1)

    def reach(self, chosen: np.ndarray) -> np.ndarray:
        """Bytes from the start of the chosen phrases' first window to their trigger."""
        w = self.grams.size - (self.sums.size - self.length) + 1
        out = np.full(chosen.size, w - 1, dtype=np.int64)
        inside = np.flatnonzero(~self.arrived[chosen])
        view = np.lib.stride_tricks.sliding_window_view(self.grams, w)[self.begin[chosen[inside]], ::-1]
        out[inside] = w - 1 - view.argmin(axis=1)
        return out

    def windows(self, chosen: np.ndarray):
        """(phrase, place in the text, place in the piece, distance to the trigger) of their windows."""
        n = self.n[chosen]
        which = np.repeat(chosen, n)
        step = np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)
        return which, self.at[which] + step, self.begin[which] + step, np.repeat(self.reach(chosen), n) - step


def spans(sums: np.ndarray, begin: np.ndarray, length) -> np.ndarray:
    """Hash of the bytes from begin on, from sums with a leading 0."""
    _, down = powers(sums.size)
    return mixed((sums[begin + length] - sums[begin]) * down[begin])


def smallest_in_a_row(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values in a row, by doubling."""
    best, have = values, 1
    while have < w:
        step = min(have, w - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def parses(texts, length: int, gram: int):
    """Yield a Parse for some of the texts at a time; texts are byte strings."""
    held, index, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) >= length:
            held.append(text)
            index.append(i)
            size += len(text)
        if held and (size >= PIECE or i == len(texts) - 1):
            yield _parse(held, index, length, gram)
            held, index, size = [], [], 0


def _parse(held, index, length, gram) -> Parse:
    data = np.frombuffer(b"".join(held), dtype=np.uint8)
    up, down = powers(data.size + 1)
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[:sums.size - gram])
    w = length - gram + 1
    low = smallest_in_a_row(grams, w)
    # the trigger is new when its gram has just come in, or when the one before has gone out
    arrived = grams[w - 1:] == low
    new = arrived.copy()
    new[1:] |= low[1:] != low[:-1]
    offsets = np.cumsum([0] + [len(t) for t in held])
    new[offsets[:-1]] = True
    beyond = offsets[1:] - length + 1        # windows that cross the end of a text belong to none
    new[beyond[beyond < new.size]] = True
    edges = np.flatnonzero(new)
    owner = np.searchsorted(offsets, edges, side="right") - 1
    n = np.diff(np.append(edges, new.size))
    inside = edges < beyond[owner]
    begin, owner, n = edges[inside], owner[inside], n[inside]
    return Parse(np.asarray(index)[owner], begin - offsets[owner], n, low[begin], begin, sums, grams,
                 arrived[begin], length)
