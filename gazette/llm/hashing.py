"""Array kernels over UTF-8 text that run inside Arrow tasks: words, spans and their 64-bit hashes."""

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; the table grows by doubling."""
    table = _powers.get(base)
    if table is None:
        table = np.ones(1, np.uint64)
    while len(table) < n:
        step = np.uint64(pow(base, len(table), 2**64))
        table = np.concatenate([table, table * step])
    if len(table) <= 1 << 21:  # 16 MB; a longer table is for one long text
        _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """Hashes of any byte span of ``data`` from one pass of prefix sums."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _power(_BASE, len(raw)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(raw) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        span = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(span + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` bytes, by start."""
        span = self.sums[size:] - self.sums[: len(self.sums) - size]
        span *= self.back[: len(span)]
        span += np.uint64(size * 0xD6E8FEB86659FD93 % 2**64)
        return mix(span)


class Words:
    """The words of several texts side by side: byte spans, and the text each belongs to.

    ``tokens`` is one list of byte words per text. ``first[d] .. first[d + 1]`` are the words of
    text ``d``.
    """

    def __init__(self, tokens: list[list[bytes]]):
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.n = int(self.first[-1])
        data = b" ".join(b" ".join(t) for t in tokens if t)
        self.spans = Spans(data)
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        self.start = np.concatenate([[0], gaps + 1])[: self.n]
        self.end = np.concatenate([gaps, [len(data)]])[: self.n]
        self.text = np.repeat(np.arange(len(tokens)), counts)

    def hashes(self) -> np.ndarray:
        return self.spans.hash(self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within a text, and the index of their first word.

        A text with fewer words, but not none, gives its whole sequence.
        """
        last = np.minimum(np.arange(self.n) + k, self.first[self.text + 1]) - 1 if self.n else np.empty(0, np.int64)
        whole = (last - np.arange(self.n) == k - 1) | (np.arange(self.n) == self.first[self.text])
        at = np.flatnonzero(whole)
        return self.spans.hash(self.start[at], self.end[last[at]]), at


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; a null text has none."""
    return text.lower().split() if text else []


_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and any characters beyond ASCII, A-Z in lower case."""
    return text.translate(_ALNUM).lower().split() if text else []


def crc32_remainder(column, modulus: int):
    """``crc32(id as text) mod modulus`` as a Spark column."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))
