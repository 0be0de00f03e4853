"""External induced sorting of all suffixes of a text, with their common-prefix values.

Suffixes are L (greater than the next one) or S. The leftmost S suffixes of their runs are named by
their substrings up to the next such one, and the string of names is sorted one level down. From
their order everything else follows: L suffixes are induced in ascending passes over priority
queues keyed by first symbol, S suffixes in descending ones. Queue entries are tuples (position,
common prefix with the entry before); an induced tuple's common prefix is one more than the least one
among the tuples between its source and the source before it. Entries with one key leave in the order
they came, so a queue is a sequence of chunks, and chunks beyond a memory budget wait on disk.

The string of names is a third of the text at most; it is sorted in memory by doubling.
"""

import os
import tempfile

import numpy as np

from gazette.llm.decontaminate import suffix_order

CAP = 100  # common prefixes are not followed beyond this


class DiskQueues:
    """First-in first-out chunks of (position, common prefix) per first symbol."""

    def __init__(self, symbols: int, budget: int):
        self.chunks: list[list] = [[] for _ in range(symbols)]
        self.held, self.budget, self.folder, self.files = 0, budget, None, 0

    def push(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        size = position.nbytes + common.nbytes
        if self.held + size > self.budget:
            self.folder = self.folder or tempfile.mkdtemp(prefix="queues-")
            path = os.path.join(self.folder, str(self.files))
            self.files += 1
            with open(path, "wb") as f:
                np.save(f, position)
                np.save(f, common)
            self.chunks[symbol].append(path)
        else:
            self.held += size
            self.chunks[symbol].append((position, common))

    def pop(self, symbol: int):
        """What came for a symbol, in order, also what is pushed meanwhile: as many chunks at once as the budget takes."""
        chunks = self.chunks[symbol]
        while chunks:
            taken, size = [], 0
            while chunks and (not taken or size < self.budget):
                chunk = chunks.pop(0)
                if isinstance(chunk, str):
                    with open(chunk, "rb") as f:
                        position, common = np.load(f), np.load(f)
                    os.unlink(chunk)
                else:
                    position, common = chunk
                    self.held -= position.nbytes + common.nbytes
                taken.append((position, common))
                size += position.nbytes + common.nbytes
            yield taken[0] if len(taken) == 1 else tuple(np.concatenate(x) for x in zip(*taken, strict=True))

    def close(self) -> None:
        if self.folder:
            os.rmdir(self.folder)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low .. high]`` (inclusive) for each pair."""
    width = high - low + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, span = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - span + 1])
        table = np.minimum(table[:-span], table[span:]) if len(table) > span else table
        span *= 2
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to ``cap``; a separator (0) matches nothing."""
    out = np.zeros(len(a), np.uint8)
    todo = np.arange(len(a))
    n = len(text)
    for k in range(cap):
        x, y = a[todo] + k, b[todo] + k
        same = (x < n) & (y < n)
        todo = todo[same]
        x, y = text[x[same]], text[y[same]]
        todo = todo[(x == y) & (x > 0)]
        if not len(todo):
            break
        out[todo] = k + 1
    return out


def _common_of(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """``_common`` of a single pair."""
    size = min(cap, len(text) - max(a, b))
    x = text[a : a + size]
    differ = np.flatnonzero((x != text[b : b + size]) | (x == 0))
    return int(differ[0]) if len(differ) else size


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. Equal symbols take the type of what follows; the last is a separator."""
    n = len(text)
    edge = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # last place of each run
    smaller = np.append(text[edge[:-1]] < text[edge[:-1] + 1], True)
    return np.repeat(smaller, np.diff(np.concatenate([[-1], edge])))


def _sorted_leftmost(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Leftmost S suffixes in order: their substrings are named, the names' suffixes sorted."""
    code = (text.astype(np.int64) << 1) | small
    end = np.append(leftmost[1:], len(text) - 1)  # a substring reaches to the next one's first symbol
    order = np.arange(len(leftmost))
    rank = np.zeros(len(leftmost), np.int64)
    todo, at = order, 0
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for k in range(at, at + 6):
            place = leftmost[todo] + k
            inside = place <= end[todo]
            key = (key << 10) | np.where(inside, code[np.minimum(place, len(text) - 1)] + 1, 0)
        again = np.lexsort((key, rank[todo]))
        todo, key = todo[again], key[again]
        lead = rank[todo]
        first = np.concatenate([[True], (lead[1:] != lead[:-1]) | (key[1:] != key[:-1])])
        group = np.concatenate([[True], lead[1:] != lead[:-1]])
        base = np.maximum.accumulate(np.where(group, np.arange(len(todo)), 0))
        rank[todo] = lead + np.maximum.accumulate(np.where(first, np.arange(len(todo)), 0)) - base
        at += 6
        last = np.append(np.flatnonzero(first)[1:], len(todo))
        tied = np.repeat(np.diff(np.concatenate([np.flatnonzero(first), [len(todo)]])) > 1, last - np.flatnonzero(first))
        todo = todo[tied & (leftmost[todo] + at <= end[todo])]
    breaks = np.flatnonzero(text[leftmost] == 0)
    # separators are all different: they come first, in text order
    rank += len(breaks)
    rank[breaks] = np.arange(len(breaks))
    return suffix_order(rank)


def suffixes_with_common(text: np.ndarray, cap: int = CAP, budget: int = 1 << 28) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of ``text`` in order, and each one's common prefix with the one before, up to ``cap``.

    ``text`` holds symbols from 1 and separators 0, the last symbol being one; separators are all
    different and match nothing. ``cap`` is at most 254.
    """
    text = np.asarray(text, np.int32)
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    small = _types(text)
    leftmost = np.flatnonzero(small & ~np.concatenate([[True], small[:-1]]))
    if len(leftmost):
        leftmost = leftmost[_sorted_leftmost(text, small, leftmost)]
    if len(text) < 1 << 31:
        leftmost = leftmost.astype(np.int32)  # every other position is derived from these
    close = np.zeros(len(leftmost), np.uint8)
    close[1:] = _common(text, leftmost[:-1], leftmost[1:], cap)
    symbols = int(text.max()) + 1
    cuts = np.searchsorted(text[leftmost], np.arange(symbols + 1))

    def induce(ascending: bool, seeds, wanted: np.ndarray) -> list[list]:
        """Chunks of induced suffixes by first symbol; ``seeds(c)`` yields the chunks known beforehand."""
        queues = DiskQueues(symbols, budget)
        since = np.full(symbols, 255, np.int64)  # least common prefix since the last push
        begun = np.zeros(symbols, bool)
        done: list[list] = [[] for _ in range(symbols)]

        def pass_on(position, common):
            least = int(common.min())
            ok = position > 0
            ok[ok] = wanted[position[ok] - 1]
            rows = np.flatnonzero(ok)
            if not len(rows):
                np.minimum(since, least, out=since)
                return
            target = text[position[rows] - 1]
            order = np.argsort(target, kind="stable")
            rows, target = rows[order], target[order]
            head = np.concatenate([[True], target[1:] != target[:-1]])
            low = np.where(head, 0, np.concatenate([[0], rows[:-1] + 1]))
            value = _range_min(common, low, rows).astype(np.int64)
            value[head] = np.minimum(value[head], since[target[head]])
            value = np.minimum(value + 1, cap)
            value[head & ~begun[target]] = 0
            starts = np.flatnonzero(head)
            ends = np.append(starts[1:], len(rows))
            np.minimum(since, least, out=since)
            last = rows[ends - 1]
            rest = np.full(len(last), 255, np.int64)
            more = last + 1 < len(common)
            if more.any():
                rest[more] = _range_min(common, last[more] + 1, np.full(int(more.sum()), len(common) - 1))
            since[target[starts]] = rest
            begun[target[starts]] = True
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                queues.push(int(target[s]), position[rows[s:e]] - 1, value[s:e].astype(np.uint8))

        for c in range(symbols) if ascending else range(symbols - 1, -1, -1):
            before = -1
            for position, common in queues.pop(c):
                done[c].append((position, common))
                pass_on(position, common)
                before = position[-1]
            for position, common in seeds(c):
                if before >= 0:
                    common = common.copy()
                    common[0] = _common_of(text, int(before), int(position[0]), cap)
                pass_on(position, common)
                before = -1
        queues.close()
        return done

    def leftmost_of(c):
        if cuts[c] < cuts[c + 1]:
            common = close[cuts[c] : cuts[c + 1]].copy()
            common[0] = 0
            yield leftmost[cuts[c] : cuts[c + 1]], common

    flat = [
        (np.concatenate([p for p, _ in chunks]), np.concatenate([v for _, v in chunks])) if chunks else (np.empty(0, np.int64), np.empty(0, np.uint8))
        for chunks in induce(True, leftmost_of, ~small)
    ]

    def large_of(c):
        position, common = flat[c]
        if len(position):
            yield position[::-1], np.concatenate([[0], common[:0:-1]]).astype(np.uint8)

    rest = induce(False, large_of, small)
    order, values = [], []
    for c in range(symbols):
        position, common = flat[c]
        downward = [p for p, _ in rest[c]]
        if c == 0:  # separators induce nothing and are not induced
            downward = [np.flatnonzero(text == 0)[::-1]]
            rest[0] = [(downward[0], np.zeros(len(downward[0]), np.uint8))]
        if downward:
            s_position = np.concatenate(downward)[::-1]
            s_down = np.concatenate([v for _, v in rest[c]])
            s_common = np.concatenate([[0], s_down[:0:-1]]).astype(np.uint8)
            if len(position):
                s_common[0] = _common_of(text, int(position[-1]), int(s_position[0]), cap)
            position, common = np.concatenate([position, s_position]), np.concatenate([common, s_common])
        order.append(position)
        values.append(common)
    return np.concatenate(order), np.concatenate(values)
