"""Words of texts as arrays, for work inside tasks.

Texts are taken in pieces of about PIECE bytes (one longer text is a piece of its
own), joined by a blank, so that a batch of any size needs little memory. Words are
found on UTF-8 bytes: both kinds of word used here end at ASCII characters only.
A word's hash is a polynomial over random byte values, mixed; 64 bits.
"""

import numpy as np

PIECE = 1 << 19
_ONE = np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def byte_class(separators) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Anything but blanks; letters, digits and all beyond ASCII.
NON_BLANK = byte_class([0x20, *range(0x09, 0x0E)])
ALNUM = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed((np.arange(256, dtype=np.uint64) + _ONE) * BASE)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int):
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if _powers[0].size < n:
        size = max(n, 2 * PIECE)
        for i, base in enumerate((BASE, INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


class Piece:
    """Words of some texts: text, begin, end (bytes in data) and hash of each word."""

    def __init__(self, first: int, texts: list[bytes], word_bytes: np.ndarray):
        self.first, self.n = first, len(texts)
        self.data = b" ".join(texts) + b" "
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        inside = word_bytes[self.bytes].view(np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.begin, self.end = edges[::2], edges[1::2]
        bounds = np.searchsorted(self.begin, self.offsets)
        self.bounds = bounds                       # words of text i: bounds[i] .. bounds[i + 1]
        self.text = np.repeat(np.arange(self.n), np.diff(bounds))

    def hashes(self) -> np.ndarray:
        up, down = powers(self.bytes.size)
        total = np.cumsum(BYTE_VALUES[self.bytes] * up)
        before = np.where(self.begin > 0, total[self.begin - 1], np.uint64(0))
        length = (self.end - self.begin).astype(np.uint64)
        return mixed((total[self.end - 1] - before) * down[self.begin] + length)


def pieces(texts, word_bytes: np.ndarray):
    """Lower-case A-Z in the texts (None is empty) and cut them into words, piece by piece."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass").translate(LOWER) if isinstance(text, str) else b""
        if held and size + len(raw) > PIECE:
            yield Piece(first, held, word_bytes)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield Piece(first, held, word_bytes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (n - k + 1 of them)."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * BASE + hashes[j:j + n]
    return mixed(out)
