"""External induced suffix sorting: one disk-backed bulk priority queue per pass carries suffix tuples and
common-prefix lengths, through a recursion on names of S* substrings."""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queued tuples that a queue keeps in memory; beyond, its largest buckets go to an unnamed file.
QUEUE_BYTES = 8_000_000
_BUCKETS = 192
#: Common prefixes are counted up to this length, if no other is given.
CAP = 250
#: Reduced strings up to this length are sorted in memory by doubling, which ends the recursion; longer ones by induction again.
SMALL = 400_000


def _kind(cap: int):
    """Type that holds common prefixes up to cap."""
    return np.uint8 if cap <= 250 else np.int32


class BulkQueue:
    """Priority queue of tuples (key, place, lcp) that come out by key, equal keys in order of arrival.

    Keys are cut into ranges; a range's tuples lie in arrays, or in a file that ends with the process. Keys
    pushed are never below those taken, so a range is sorted once, when it is reached.
    """

    def __init__(self, n_keys: int, cap: int = CAP, limit: int | None = None):
        self.kinds = (np.int32, np.int32, _kind(cap))
        self.tuple = sum(np.dtype(k).itemsize for k in self.kinds)
        self.width = max(2, -(-n_keys // _BUCKETS))
        self.parts: list[list] = [[] for _ in range(-(-n_keys // self.width) + 1)]
        self.held, self.limit, self.file, self.at = 0, QUEUE_BYTES if limit is None else limit, None, 0
        self.head: tuple[np.ndarray, ...] | None = None

    def push(self, key: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        """Put in tuples whose keys rise."""
        if not len(key):
            return
        first, last = int(key[0]) // self.width, int(key[-1]) // self.width
        if first == last:
            self.parts[first].append((key, place, lcp))
        else:
            edges = np.searchsorted(key, np.arange(first, last + 2) * self.width).tolist()
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]), first):
                if lo < hi:
                    self.parts[i].append((key[lo:hi], place[lo:hi], lcp[lo:hi]))
        self.held += self.tuple * len(key)
        while self.held > self.limit and self._spill():
            pass

    def _spill(self) -> bool:
        sizes = [sum(len(x[0]) for x in p if isinstance(x[0], np.ndarray)) for p in self.parts]
        most = int(np.argmax(sizes))
        if not sizes[most]:
            return False
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for i, x in enumerate(self.parts[most]):
            if isinstance(x[0], np.ndarray):
                self.parts[most][i] = (self.file.tell(), len(x[0]))
                for c, kind in zip(x, self.kinds, strict=True):
                    self.file.write(np.ascontiguousarray(c, kind).tobytes())
        self.held -= self.tuple * sizes[most]
        return True

    def _load(self, x: tuple) -> tuple[np.ndarray, ...]:
        if isinstance(x[0], np.ndarray):
            return x
        self.file.seek(x[0])
        return tuple(np.frombuffer(self.file.read(np.dtype(kind).itemsize * x[1]), kind) for kind in self.kinds)

    def front(self) -> tuple[np.ndarray, ...] | None:
        """All tuples of the lowest range that has any, sorted; None: the queue is empty."""
        while self.at < len(self.parts):
            if part := self.parts[self.at]:
                self.held -= self.tuple * sum(len(x[0]) for x in part if isinstance(x[0], np.ndarray))
                self.parts[self.at] = []
                got = [self._load(x) for x in part]
                if self.head is not None:
                    got.insert(0, self.head)
                key, place, lcp = (np.concatenate(c) for c in zip(*got, strict=True)) if len(got) > 1 else got[0]
                if (key[1:] < key[:-1]).any():
                    order = np.argsort(key - self.at * self.width if self.width > 1 << 15 else (key - self.at * self.width).astype(np.uint16), kind="stable")
                    key, place, lcp = key[order], place[order], lcp[order]
                self.head = (key, place, lcp)
            if self.head is not None and len(self.head[0]):
                return self.head
            self.head = None
            self.at += 1
        return None

    def take(self, n: int) -> None:
        """Remove the first n tuples of front()."""
        self.head = tuple(x[n:] for x in self.head)


_NONE = np.iinfo(np.int32).max


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair (none empty), by a table of powers of two."""
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table, k, top = values, 0, int(level.max(initial=0))
    while True:
        at = np.nonzero(level == k)[0]
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if k == top:
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def _induce(text, wanted, runs, seeds, seed_lcp, n_chars, falling, cap):
    """Order of the suffixes with `wanted` set, from sorted ones of the other type (in scan order).

    Scanning suffixes in order, each puts the one before it, if wanted, into the queue at its first
    character; so equal characters come out in the order of what follows. A tuple's lcp is that with the
    tuple put before it under the same character: one more than the least lcp scanned in between.
    Bulk: a front of the queue can be taken as far as what it puts in cannot come before its end.
    Returns places in scan order and, for each, the lcp with the one before (0 at a new character).
    """
    code = 2 * (n_chars - 1 - text) if falling else 2 * text
    give = np.full(len(text), _NONE, np.int32)  # the key of the suffix before, if wanted
    give[1:] = np.where(wanted[:-1], code[:-1], _NONE)
    queue = BulkQueue(2 * n_chars, cap)
    queue.push(code[seeds] + 1, seeds, seed_lcp)  # seeds come after wanted ones of their character
    small = 2 * n_chars < 1 << 16
    carry = np.full(2 * n_chars, -1, np.int32)  # least lcp since the last push under a key; none yet: -1
    out_place, out_lcp = [], []
    last_key, last_place = -2, -1
    while (head := queue.front()) is not None:
        key, place, lcp = head
        target = give[place]
        if key[-1] > target.min():
            new = np.nonzero(np.minimum.accumulate(target) < key)[0]
            if len(new):  # whole groups of equal keys, up to the first whose end is above what is put in
                n = int(np.searchsorted(key, key[new[0]], side="left")) or int(np.searchsorted(key, key[0], side="right"))
                key, place, lcp, target = key[:n], place[:n], lcp[:n], target[:n]
        queue.take(len(key))
        starts = np.nonzero(key[1:] != key[:-1])[0] + 1
        if key[0] != last_key:
            starts = np.concatenate([[0], starts])
        scan = lcp.copy()
        scan[starts] = 0
        own = key & 1 == 0
        out_place.append(place[own])
        out_lcp.append(scan[own])
        for i in starts[(key[starts] & 1) == 1].tolist():  # a character's seeds after its wanted ones
            before, at = (int(key[i - 1]), place[i - 1]) if i else (last_key, last_place)
            if before == key[i] - 1:
                scan[i] = min(cap, runs[place[i]], runs[at])
        last_key, last_place = int(key[-1]), int(place[-1])
        at = np.nonzero(target < _NONE)[0]
        if len(at):
            to = target[at]
            order = np.argsort(to.astype(np.uint16) if small else to, kind="stable")
            at, to = at[order], to[order]
            heads = np.concatenate([[0], np.nonzero(to[1:] != to[:-1])[0] + 1])
            value = np.empty(len(at), scan.dtype)
            rest = np.ones(len(at), bool)
            rest[heads] = False
            rest = np.nonzero(rest)[0]
            if len(rest):
                value[rest] = np.minimum(_range_min(scan, at[rest - 1] + 1, at[rest] + 1), cap - 1) + 1
            value[heads] = np.minimum(np.minimum(carry[to[heads]], np.minimum.accumulate(scan)[at[heads]]), cap - 1) + 1
            queue.push(to, place[at] - 1, value)
            np.minimum(carry, scan.min(), out=carry)
            tails = np.append(heads[1:] - 1, len(to) - 1)
            end = np.append(np.minimum.accumulate(scan[::-1])[::-1][1:], np.iinfo(scan.dtype).max)
            carry[to[tails]] = end[at[tails]]
        else:
            np.minimum(carry, scan.min(), out=carry)
    return (np.concatenate(out_place), np.concatenate(out_lcp)) if out_place else (np.zeros(0, np.int32), np.zeros(0, _kind(cap)))


def _names(text, lms, ends, stops, n_chars, types, runs):
    """Ranks of the S* substrings (from an S* place to the next one, both included; those that end at a
    separator stay distinct), their order, where in it a new one begins, and how many characters, types
    included, each new one shares with that before."""
    bits = int(2 * n_chars + 2).bit_length()
    per = max(1, 60 // bits)
    length = ends - lms + 1
    m = len(lms)
    rank = np.zeros(m, np.int64)
    order = np.arange(m)
    live = np.arange(m)
    step = 0
    while len(live):
        # pack the next `per` characters with their types
        word = np.zeros(len(live), np.int64)
        for j in range(per):
            at = np.minimum(lms[live] + step * per + j, ends[live])
            inside = step * per + j < length[live]
            word = word << bits | np.where(inside, 2 * text[at] + types[at] + 1, 0)
        done = (step + 1) * per >= length[live]
        tie = np.where(done, stops[live], 0)  # separators differ by place
        # sort within groups of equal rank; live is ordered by rank
        by = np.lexsort((tie, word, rank[live]))
        live, word, tie, done = live[by], word[by], tie[by], done[by]
        r = rank[live]
        same_group = np.concatenate([[False], r[1:] == r[:-1]])
        same_word = same_group & np.concatenate([[False], (word[1:] == word[:-1])])
        same = same_word & np.concatenate([[False], tie[1:] == tie[:-1]])
        where = rank[live] + _within(same_group)
        order[where] = live
        start = np.maximum.accumulate(np.where(~same, np.arange(len(live)), 0))
        rank[live] = where[start]
        # a group goes on if it has several members whose substrings aren't over
        alone = ~same & ~np.concatenate([same[1:], [False]])
        live = live[~(alone | done)]
        step += 1
    new = np.concatenate([[True], np.diff(rank[order]) != 0])
    first = lms[order[new]]
    lcp = np.zeros(len(first), np.int64)
    live, a, b = np.arange(1, len(first)), first[:-1].copy(), first[1:].copy()
    while len(live):  # from run to run of equal characters; a separator is equal to nothing
        same = (text[a] == text[b]) & (types[a] == types[b]) & (text[a] != 0)
        live, a, b = live[same], a[same], b[same]
        short = np.minimum(runs[a], runs[b])
        lcp[live] += short
        go = runs[a] == runs[b]
        live, a, b = live[go], a[go] + short[go], b[go] + short[go]
    return rank, order, new, lcp


def _within(same: np.ndarray) -> np.ndarray:
    """Place of each element in its run, runs beginning where same is False."""
    i = np.arange(len(same))
    return i - np.maximum.accumulate(np.where(~same, i, 0))


def suffix_array(text: np.ndarray, n_chars: int, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp) of all suffixes of strings that each end with a separator 0; other characters are
    from 1 to n_chars - 1. Separators differ, the earlier is the smaller; suffixes of separators come first.
    lcp is that with the suffix before, up to cap; a separator never counts."""
    text = np.asarray(text, np.int32)
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, _kind(cap))
    seps = np.nonzero(text == 0)[0]
    place = np.arange(n, dtype=np.int32)
    step = np.zeros(n, np.int32)
    step[:-1] = text[1:] - text[:-1]
    is_sep = text == 0
    edge = np.where((step != 0) | is_sep, place, n)
    edge = np.minimum.accumulate(edge[::-1])[::-1]  # last place of the run of equal characters
    runs = edge - place + 1
    rises = (step[np.minimum(edge, n - 1)] > 0) | is_sep
    runs[is_sep] = 0
    star = np.zeros(n, bool)
    star[1:] = rises[1:] & ~rises[:-1]
    star |= is_sep
    lms = np.nonzero(star)[0].astype(np.int32)
    ends = np.append(lms[1:], n - 1)
    at_sep = is_sep[lms]
    ends[at_sep] = lms[at_sep]  # a separator is a substring of its own
    stop = np.where(is_sep[ends], np.cumsum(is_sep)[ends], 0)
    rank, order, new, step_lcp = _names(text, lms, ends, stop, n_chars, rises, runs)
    dense = np.empty(len(lms), np.int64)
    dense[order] = np.cumsum(new) - 1
    n_names = int(new.sum())
    if n_names == len(lms):
        sub, x, y, base, shared = order, order[:-1], order[1:], 0, step_lcp[1:]
    else:
        small = np.where(at_sep, 0, dense - int(at_sep.sum()) + 1)
        sort = suffix_array if len(small) > SMALL else _by_doubling
        sub, sub_lcp = sort(small, n_names - int(at_sep.sum()) + 1, cap)
        same = sub_lcp[1:].astype(np.int64)  # so many names are common; then two differ
        x, y = sub[:-1] + same, sub[1:] + same
        base = lms[x] - lms[sub[:-1]]
        low, high = np.minimum(dense[x], dense[y]), np.maximum(dense[x], dense[y])
        shared = np.zeros(len(x), np.int64)  # the same name: they share cap names or more
        apart = np.nonzero(low < high)[0]
        if len(apart):
            shared[apart] = _range_min(step_lcp, low[apart] + 1, high[apart] + 1)
    seeds, seed_lcp = lms[sub], np.zeros(len(sub), _kind(cap))
    a, b = lms[x] + shared, lms[y] + shared
    # equal characters of unlike types: the shorter run of them is common too
    seed_lcp[1:] = np.minimum(cap, base + shared + np.where(text[a] == text[b], np.minimum(runs[a], runs[b]), 0))
    falls, low_lcp = _induce(text, ~rises & ~is_sep, runs, seeds, seed_lcp, n_chars, False, cap)
    rest, rest_lcp = _scan_down(text, rises & ~is_sep, runs, falls, low_lcp, n_chars, cap)
    return _merge(text, runs, seps, falls, low_lcp, rest, rest_lcp, cap)


def _by_doubling(text: np.ndarray, n_chars: int, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """As suffix_array, for strings in memory: ranks of prefixes of 1, 2, 4, ... characters."""
    n = len(text)
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text.astype(np.int64) + np.count_nonzero(text == 0))
    levels, h = [], 1
    while True:
        order = np.argsort(rank, kind="stable")
        sorted_ = rank[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels.append(rank)
        if new.all():
            break
        follow = np.zeros(n, np.int64)
        follow[:-h] = rank[h:] + 1
        rank = rank * (n + 1) + follow
        h *= 2
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in reversed(range(len(levels) - 1)):
        same = (np.maximum(a, b) < n) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        a, b = a + (same << k), b + (same << k)
        lcp[1:] += same << k
    return order.astype(np.int32), np.minimum(lcp, cap).astype(_kind(cap))


def _scan_down(text, wanted, runs, falls, low_lcp, n_chars, cap):
    """The S suffixes, rising, from the L suffixes, by a scan from the highest."""
    seeds = falls[::-1]
    seed_lcp = _next_to_before(low_lcp[::-1])
    got, lcp = _induce(text, wanted, runs, seeds, seed_lcp, n_chars, True, cap)
    return got[::-1], _next_to_before(lcp[::-1])


def _next_to_before(lcp):
    """lcp with the element before, of a sequence that was turned around."""
    out = np.zeros(len(lcp), lcp.dtype)
    out[1:] = lcp[:-1]
    return out


def _merge(text, runs, seps, falls, low_lcp, rises, high_lcp, cap):
    """All suffixes: separators, then by character L before S."""
    place = np.concatenate([seps.astype(np.int32), falls, rises])
    lcp = np.concatenate([np.zeros(len(seps), low_lcp.dtype), low_lcp, high_lcp])
    key = 2 * text[place]
    key[len(seps) + len(falls) :] += 1
    order = np.argsort(key.astype(np.uint16) if int(key.max(initial=0)) < 1 << 16 else key, kind="stable")
    place, lcp, key = place[order], lcp[order], key[order]
    new = np.nonzero(key[1:] != key[:-1])[0] + 1
    lcp[new] = np.where(key[new] >> 1 == key[new - 1] >> 1, np.minimum(cap, np.minimum(runs[place[new]], runs[place[new - 1]])), 0)
    lcp[: max(1, len(seps))] = 0
    return place, lcp
