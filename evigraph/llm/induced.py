"""External induced sorting of one shard: suffix order and common prefixes through disk-backed queues."""

from __future__ import annotations

import tempfile

import numpy as np

# Symbols of a reduced text that are sorted in memory; a longer one is sorted by recursion.
IN_MEMORY = 1 << 22
# Tuples that the queues of one level hold in memory; more go to a scratch file.
QUEUE_TUPLES = 1 << 24


class TupleQueue:
    """A priority queue of (position, common prefix) tuples: by symbol, then by order of arrival.

    Tuples wait in one list per symbol. When more than ``limit`` wait in memory, all of them are appended
    to a scratch file, which goes when the queue does; a symbol's tuples are read back when its turn comes.
    """

    def __init__(self, symbols: int, limit: int = QUEUE_TUPLES):
        self.waiting: list[list] = [[] for _ in range(symbols)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.limit, self.held = limit, 0
        self.file = None
        self.end = 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Insert tuples in the given order."""
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions, prefixes = symbols[order], positions[order], prefixes[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbols)], strict=True):
            self.waiting[symbols[begin]].append((positions[begin:end], prefixes[begin:end]))
        self.held += len(symbols)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(self.end)
        for symbol, parts in enumerate(self.waiting):
            if parts:
                positions = np.concatenate([p for p, _ in parts]).astype(np.int64)
                prefixes = np.concatenate([x for _, x in parts]).astype(np.int64)
                self.spilled[symbol].append((self.end, len(positions)))
                self.end += self.file.write(positions.tobytes()) + self.file.write(prefixes.tobytes())
                self.waiting[symbol] = []
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Take all tuples of a symbol."""
        parts = []
        for at, n in self.spilled[symbol]:
            self.file.seek(at)
            data = np.frombuffer(self.file.read(16 * n), dtype=np.int64)
            parts.append((data[:n], data[n:].astype(np.int16)))
        here = self.waiting[symbol]
        self.held -= sum(len(p) for p, _ in here)
        parts += here
        self.waiting[symbol], self.spilled[symbol] = [], []
        if not parts:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int16)
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])

    def close(self) -> None:
        if self.file:
            self.file.close()


class _RunningMinima:
    """For every symbol the smallest common prefix since its last inducing tuple."""

    def __init__(self, symbols: int):
        self.least = np.full(symbols, -1, dtype=np.int16)

    def step(self, prefixes: np.ndarray, symbols: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Pass a batch of tuples; for those at ``which``, inducing ``symbols``, the minimum up to each."""
        m = len(prefixes)
        upto = np.minimum.accumulate(prefixes)
        if not len(which):
            np.minimum(self.least, upto[-1], out=self.least)
            return np.empty(0, dtype=np.int16)
        order = np.argsort(symbols, kind="stable")
        at, of = which[order], symbols[order]
        new = np.concatenate(([True], of[1:] != of[:-1]))
        out = np.empty(len(at), dtype=np.int16)
        out[new] = np.minimum(self.least[of[new]], upto[at[new]])
        later = np.flatnonzero(~new)
        if len(later):
            low, high = at[later - 1] + 1, at[later]
            out[later] = _range_minima(prefixes, low, high)
        last = np.concatenate((new[1:], [True]))
        after = np.minimum.accumulate(prefixes[::-1])[::-1]
        np.minimum(self.least, upto[-1], out=self.least)
        ends = at[last] + 1
        self.least[of[last]] = np.where(ends < m, after[np.minimum(ends, m - 1)], np.iinfo(np.int16).max)
        back = np.empty(len(at), dtype=np.int16)
        back[order] = out
        return back


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of closed ranges by a table of minima over powers of two."""
    out = np.empty(len(low), dtype=values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-size], table[size:])
            size *= 2
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[low[here]], table[high[here] - size + 1])
    return out


def _index(n: int) -> type:
    """Integers that hold the positions of a text of ``n`` symbols."""
    return np.int32 if n < (1 << 31) - 1024 else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True for a suffix smaller than its successor (S); the last one is S."""
    n = len(text)
    rises = np.empty(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    rises[-1] = True
    decided = np.empty(n, dtype=bool)
    decided[:-1] = text[:-1] != text[1:]
    decided[-1] = True
    nearest = np.where(decided, np.arange(n, dtype=_index(n)), _index(n)(n))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return rises[nearest]


def _names(text: np.ndarray, small: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between successive S* positions, by rounds of packed symbols."""
    most = 2 * int(text.max()) + 1
    bits = most.bit_length()
    kind = np.min_scalar_type(most)
    n = len(text)
    each = max(1, 64 // bits)
    ends = np.concatenate((stars[1:], stars[-1:]))
    rank = np.zeros(len(stars), dtype=np.int64)
    active = np.arange(len(stars))
    done = 0
    padded = np.zeros(n + 1, dtype=kind)
    padded[:n] = text
    padded[:n] *= kind.type(2)
    padded[:n] += small
    while len(active):
        key = np.zeros(len(active), dtype=np.uint64)
        for k in range(each):
            at = stars[active] + done + k
            part = padded[np.minimum(at, n)].astype(np.uint64)
            part[at > ends[active]] = 0
            key = key << np.uint64(bits) | part
        order = np.lexsort((key, rank[active]))
        a, k, r = active[order], key[order], rank[active][order]
        same_rank = np.concatenate(([False], r[1:] == r[:-1]))
        same = same_rank & np.concatenate(([False], k[1:] == k[:-1]))
        # ranks are positions of the first member, so that refining one group leaves the others alone
        begin = np.flatnonzero(~same_rank)
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(a)]))))
        first = np.where(same, 0, place)
        group = np.cumsum(~same) - 1
        rank[a] = r + first[~same][group]
        done += each
        sizes = np.bincount(group)
        again = (sizes[group] > 1) & (stars[a] + done <= ends[a])
        active = np.sort(a[again])
    _, dense = np.unique(rank, return_inverse=True)
    return dense


def _doubled(names: np.ndarray, symbols: int) -> np.ndarray:
    """Order of the suffixes of a short reduced text to a depth of ``symbols`` symbols."""
    n = len(names)
    rank = names.astype(np.int64)
    size = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - size] = rank[size:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        new = np.cumsum(step)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        size *= 2
        if new[-1] == n - 1 or size >= min(symbols, n):
            return order


def _common(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, counted up to ``depth``."""
    n = len(text)
    padded = np.concatenate((text, np.full(depth + 8, -1, dtype=text.dtype)))
    out = np.full(len(left), depth, dtype=np.int16)
    active = np.arange(len(left))
    done = 0
    while len(active) and done < depth:
        a, b = left[active] + done, right[active] + done
        open_ = np.ones(len(active), dtype=bool)
        for k in range(8):
            differ = open_ & ((padded[np.minimum(a + k, n)] != padded[np.minimum(b + k, n)]) | (a + k >= n) | (b + k >= n))
            out[active[differ]] = done + k
            open_ &= ~differ
        active = active[open_]
        done += 8
    return np.minimum(out, depth)


def _run(text: np.ndarray, at: int, depth: int) -> int:
    part = text[at : at + depth]
    change = np.flatnonzero(part != part[0])
    return int(change[0]) if len(change) else len(part)


def suffix_order(text: np.ndarray, depth: int, in_memory: int = IN_MEMORY, limit: int = QUEUE_TUPLES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order and the common prefix of each with the one before, up to ``depth``.

    ``text`` holds small integers and ends with a 0 that occurs nowhere else. Suffixes that agree in
    ``depth`` symbols may stand in any order. Substrings between S* positions are named; the text of
    the names is sorted by the same procedure unless it is short; its order is then induced to all
    larger-than-successor suffixes from the left and to all others from the right. Both inductions
    take tuples from a priority queue and push the tuples they induce, a whole symbol at a time.
    """
    n = len(text)
    small = _types(text)
    stars = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(_index(n))
    if not len(stars):
        return np.array([n - 1]), np.zeros(1, dtype=np.int16)
    names = _names(text, small, stars)
    # successive S* positions are two symbols or more apart
    steps = depth // 2 + 2
    if names.max() + 1 == len(names):
        order = np.argsort(names)
    elif len(names) <= in_memory:
        order = _doubled(names, steps)
    else:
        reduced = np.concatenate((names + 1, [0]))
        order = suffix_order(reduced, steps, in_memory, limit)[0]
        order = order[order < len(names)]
    ranked = stars[order]
    seeds = np.zeros(len(ranked), dtype=np.int16)
    seeds[1:] = _common(text, ranked[:-1], ranked[1:], depth)
    symbols = int(text.max()) + 1
    present = np.flatnonzero(np.bincount(text, minlength=symbols))
    star_at = np.searchsorted(text[ranked], np.arange(symbols + 1))

    # from the left: suffixes that are larger than their successors
    queue, least = TupleQueue(symbols, limit), _RunningMinima(symbols)
    large: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for c in present.tolist():
        kept, before = [], None
        while True:
            positions, prefixes = queue.pop(c)
            if not len(positions):
                break
            kept.append((positions, prefixes))
            before = int(positions[-1])
            _induce(text, small, positions, prefixes, False, queue, least, depth)
        large[c] = (np.concatenate([p for p, _ in kept]), np.concatenate([x for _, x in kept])) if kept else (np.empty(0, _index(n)), np.empty(0, np.int16))
        positions, prefixes = ranked[star_at[c] : star_at[c + 1]], seeds[star_at[c] : star_at[c + 1]].copy()
        if len(positions):
            prefixes[0] = 0 if before is None else min(_run(text, before, depth), _run(text, int(positions[0]), depth))
            _induce(text, small, positions, prefixes, False, queue, least, depth)
    queue.close()

    # from the right: the others; what is taken here is the whole order, from its end
    queue, least = TupleQueue(symbols, limit), _RunningMinima(symbols)
    out_positions, out_prefixes = [], []
    for c in present[::-1].tolist():
        after = None
        while True:
            positions, prefixes = queue.pop(c)
            if not len(positions):
                break
            out_positions.append(positions)
            out_prefixes.append(prefixes)
            after = int(positions[-1])
            _induce(text, small, positions, prefixes, True, queue, least, depth)
        positions, below = large[c]
        if c == 0:  # the end of the text, which nothing precedes
            positions, below = np.array([n - 1], dtype=_index(n)), np.zeros(1, dtype=np.int16)
        if len(positions):
            positions = positions[::-1]
            prefixes = np.concatenate(([0], below[:0:-1])).astype(np.int16)
            if after is not None:
                prefixes[0] = min(_run(text, after, depth), _run(text, int(positions[0]), depth))
            out_positions.append(positions)
            out_prefixes.append(prefixes)
            _induce(text, small, positions, prefixes, True, queue, least, depth)
    queue.close()
    order = np.concatenate(out_positions)[::-1]
    # a prefix was kept with the larger of two neighbours taken one after the other
    above = np.concatenate(out_prefixes)[::-1]
    return order, np.concatenate(([0], above[:-1])).astype(np.int16)


def _induce(text, small, positions, prefixes, wanted: bool, queue: TupleQueue, least: _RunningMinima, depth: int) -> None:
    """Push the predecessors of the wanted type with their common prefixes."""
    before = positions - 1
    which = np.flatnonzero((before >= 0) & (small[before] == wanted))
    at = before[which]
    symbols = text[at]
    minima = least.step(prefixes, symbols, which)
    queue.push(symbols, at, np.minimum(minima + 1, depth).astype(np.int16))


def repeated_starts(chunks: list[bytes], length: int, in_memory: int = IN_MEMORY, limit: int = QUEUE_TUPLES) -> list[np.ndarray]:
    """Per chunk the positions whose next ``length`` bytes start anywhere else in the chunks too."""
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    raw = np.frombuffer(b"\0".join(chunks) + b"\0", dtype=np.uint8)
    stops = np.cumsum(sizes + 1) - 1
    # bytes that occur get symbols from 2 on, the end of a chunk is 1 and that of the text 0
    inside = np.ones(len(raw), dtype=bool)
    inside[stops] = False
    table = np.zeros(256, dtype=np.int16)
    found = np.flatnonzero(np.bincount(raw[inside], minlength=256))
    table[found] = np.arange(2, 2 + len(found))
    text = np.zeros(len(raw) + 1, dtype=np.int16)
    text[:-1] = table[raw]
    text[stops] = 1
    order, prefix = suffix_order(text, length, in_memory, limit)
    hit = np.zeros(len(text), dtype=bool)
    long = np.flatnonzero(prefix >= length)
    hit[order[long]] = True
    hit[order[long - 1]] = True
    # a match that runs over the end of a chunk is none; such positions are too near the end anyway
    at = np.flatnonzero(hit[: len(raw)])
    owner = np.searchsorted(stops, at, side="right")
    begin = np.concatenate(([0], stops[:-1] + 1))
    local = at - begin[np.minimum(owner, len(sizes) - 1)]
    fits = (local >= 0) & (local + length <= sizes[np.minimum(owner, len(sizes) - 1)])
    owner, local = owner[fits], local[fits]
    cuts = np.searchsorted(owner, np.arange(len(chunks) + 1))
    return [local[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
