"""SentencePiece encoding and decoding: distinct sampled segmentations by perturbed A-star search."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Power of the pieces' chances: the lower, the more alike are segmentations.
ALPHA = 0.5
#: Choices of lattices that a worker remembers from text to text, of 20 bytes each, with some 6 for their nodes and names.
CHOICES = 1_000_000
#: Characters of texts that are drawn together, about; of new lattices that are made together, at least.
TOGETHER, MADE = 150_000, 40_000
#: Decisions of a sample whose alternatives are drawn at once; the rest waits as one region.
BLOCK = 16
#: Code points below this have a table of the pairs that pieces hold.
_LOW = 1024
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_B = 0x9E3779B97F4A7C15


@dataclass
class Vocabulary:
    """Pieces with spaces as themselves; chances by Zipf's law from a piece's rank (BPE models hold merge
    ranks, not probabilities)."""

    ids: dict[str, int]
    chances: dict[str, float]
    byte_ids: list[int]
    byte_chance: float
    surfaces: list[bytes | None]

    @staticmethod
    def load(path: str, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        ids, ranks, byte_ids, surfaces = {}, {}, [0] * 256, []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                surfaces.append(None)
            else:
                own = piece.replace("▁", " ")
                surfaces.append(own.encode())
                ids[own], ranks[own] = i, min(float(n), max(0.0, -m.get_score(i)))
        total = sum(1 / (r + 2) for r in ranks.values()) + 256 / (n + 2)
        return Vocabulary(ids, {p: (1 / (r + 2) / total) ** alpha for p, r in ranks.items()}, byte_ids, (1 / (n + 2) / total) ** alpha, surfaces)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _width(code: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points."""
    return 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int):
        if n > len(self.up):
            for name, base in (("up", _B), ("down", pow(_B, -1, 2**64))):
                one = np.full(max(n, 1 << 18), base, np.uint64)
                one[0] = 1
                setattr(self, name, np.cumprod(one))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Prefixes:
    """Hashes of any substrings of one string, from running sums."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(h + (end - start).astype(np.uint64) * _M2)


class Table:
    """Open-address table from hashes to running numbers, many at a time."""

    def __init__(self):
        self.keys, self.n, self.bits = np.zeros(1 << 12, np.uint64), 0, 13
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash; -1: it isn't there."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[slot]
        open_ = np.nonzero((out >= 0) & (self.keys[out] != h))[0]
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & mask
            got = self.slots[slot]
            out[open_] = got
            more = (got >= 0) & (self.keys[got] != h[open_])
            open_, slot = open_[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes that are new, each once."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        while self.n + len(h) > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        self.keys[number] = h
        self.n += len(h)
        if 2 * self.n > len(self.slots):
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(self.n, dtype=np.int32))
        else:
            self._place(number)
        return number

    def _place(self, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (self.keys[number] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several, one stays
            more = self.slots[slot] != number
            number, slot = number[more], (slot[more] + 1) & mask


class Lattices:
    """Lattices of units, which are stretches of text that no piece of the vocabulary leaves.

    A unit ends wherever the two code points around a place stand side by side in no piece, so the lattice of a
    whole text is the chain of its units' lattices, however long its words are. A node is a place in a unit; its
    choices are the pieces that begin there, with their chances given that the node is reached, from summed chances
    of what follows. Choices of one node stand together: cum (running chance), log_p, next (node after the piece; -1:
    the unit's end), number (the piece's; -1 - code point where only bytes cover it) and own (the node).
    Many units are made at a time; equal units are made once, and found by 64-bit hashes of their
    characters and length.
    """

    _KINDS = (("cum", np.float32), ("log_p", np.float32), ("next", np.int32), ("number", np.int32), ("own", np.int32))

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        names = list(vocabulary.ids)
        self.longest = max(map(len, names), default=1)
        sizes = np.array([len(x) for x in names], np.int64)
        codes, ends = _codes("".join(names)), np.cumsum(sizes)
        whole = Prefixes(codes)
        self.table, piece = Table(), []
        for size in range(1, self.longest + 1):  # all beginnings of pieces
            at = np.nonzero(sizes >= size)[0]
            start = ends[at] - sizes[at]
            h, first = np.unique(whole(start, start + size), return_index=True)
            self.table.add(h)
            own = np.full(len(h), -1, np.int64)
            full = np.nonzero(sizes[at] == size)[0]
            own[np.searchsorted(h, whole(start[full], ends[at][full]))] = at[full]
            piece.append(own)
        self.piece = np.concatenate(piece)
        self.log_chance = np.log(np.array([vocabulary.chances[x] for x in names]))
        self.ids = np.array([vocabulary.ids[x] for x in names], np.int32)
        inner = np.ones(len(codes), bool)
        inner[ends - 1] = False
        a, b = codes[:-1][inner[:-1]].astype(np.int64), codes[1:][inner[:-1]].astype(np.int64)
        self.low_pairs = np.zeros(_LOW * _LOW, bool)
        low = (a < _LOW) & (b < _LOW)
        self.low_pairs[a[low] * _LOW + b[low]] = True
        self.high_pairs = np.unique(a[~low] << 32 | b[~low])
        self.clear()

    def clear(self) -> None:
        """Forget all units."""
        self.known, self.roots = Table(), np.zeros(1 << 12, np.int32)
        self.starts, self.nodes, self.used = np.zeros(1 << 14, np.int32), 0, 0
        for name, kind in self._KINDS:
            setattr(self, name, np.zeros(1 << 16, kind))

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each code point."""
        out = np.ones(len(codes), bool)
        a, b = codes[:-1], codes[1:]
        high = (a >= _LOW) | (b >= _LOW)
        out[1:] = ~self.low_pairs[np.where(high, 0, a * np.uint32(_LOW) + b)]
        at = np.nonzero(high)[0]
        if len(at):
            pair = a[at].astype(np.int64) << 32 | b[at].astype(np.int64)
            found = np.searchsorted(self.high_pairs, pair)
            known = self.high_pairs[np.minimum(found, len(self.high_pairs) - 1)] == pair if len(self.high_pairs) else np.zeros(len(at), bool)
            out[at + 1] = ~known
        return out

    def units(self, text: str) -> list[str]:
        """The text, after one space that decoding takes off, cut into units."""
        own = " " + text
        edges = [*np.nonzero(self.cuts(_codes(own)))[0].tolist(), len(own)]
        return [own[a:b] for a, b in zip(edges, edges[1:])] if text else []

    def first_nodes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First node of each unit of the texts (none empty), and the place of each text's first unit."""
        codes = _codes("".join(f" {t}" for t in texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = self.cuts(codes)
        begins[ends[:-1]] = True
        edges = np.append(np.nonzero(begins)[0], len(codes))
        firsts = np.searchsorted(edges, np.concatenate([[0], ends]))
        h = Prefixes(codes)(edges[:-1], edges[1:])
        got = self.known.find(h)
        fresh = np.nonzero(got < 0)[0]
        if len(fresh):
            fresh = fresh[np.unique(h[fresh], return_index=True)[1]]
            sizes = edges[fresh + 1] - edges[fresh]
            total, at = np.cumsum(sizes), 0
            while at < len(fresh):
                to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + MADE, side="right")))
                some = fresh[at:to]
                self._add(codes, edges[some], sizes[at:to], h[some])
                at = to
            got = self.known.find(h)
        return self.roots[got], firsts

    def _room(self, name: str, n: int) -> np.ndarray:
        old = getattr(self, name)
        if n > len(old):
            new = np.zeros(max(n, len(old) + len(old) // 2), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def _add(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        unit_end = np.repeat(ends, sizes)
        place = np.arange(n)
        codes = codes[place + np.repeat(begins - (ends - sizes), sizes)]
        # nodes are numbered from the ends of units backwards, so that what a node needs is made before it
        back = unit_end - place
        order = np.argsort(back.astype(np.uint16) if back.max() < 1 << 16 else back, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[order] = place
        hashes, live, found = Prefixes(codes), place, []
        degree = np.zeros(n, np.int64)
        for size in range(1, self.longest + 1):
            live = live[back[live] >= size]
            got = self.table.find(hashes(live, live + size))
            there = got >= 0
            number = np.where(there, self.piece[got], -1)
            if size == 1:  # a code point without a piece of its own is given as bytes
                at, by_bytes = live, number < 0
                log_w = np.where(by_bytes, np.log(self.v.byte_chance) * _width(codes), self.log_chance[number])
                named = np.where(by_bytes, -1 - codes.astype(np.int64), self.ids[number])
            else:
                is_piece = number >= 0
                at, number = live[is_piece], number[is_piece]
                log_w, named = self.log_chance[number], self.ids[number]
            found.append((rank[at], size, log_w, named, at))
            degree[rank[at]] += 1
            live = live[there]
            if not len(live):
                break
        start = np.concatenate([[0], np.cumsum(degree)])
        total = int(start[-1])
        weight, after, number = np.empty(total), np.empty(total, np.int64), np.empty(total, np.int32)
        free = start[:-1].copy()
        for node, size, log_w, named, at in found:
            to = free[node]
            weight[to], number[to] = log_w, named
            after[to] = np.where(back[at] == size, -1, rank[at + size])
            free[node] += 1
        own = np.repeat(place, degree)
        sums = np.zeros(n + 1)  # log of summed chances from a node to its unit's end; the last: the end itself
        log_p = np.empty(total)
        edges = np.concatenate([[0], np.cumsum(np.bincount(back)[1:])]).tolist()
        for a, b in zip(edges, edges[1:]):
            lo, hi = int(start[a]), int(start[b])
            x = weight[lo:hi] + sums[after[lo:hi]]
            at, wide = start[a:b] - lo, own[lo:hi] - a
            top = np.maximum.reduceat(x, at)
            sums[a:b] = top + np.log(np.add.reduceat(np.exp(x - top[wide]), at))
            log_p[lo:hi] = x - sums[a:b][wide]
        p = np.exp(log_p)
        cum = np.cumsum(p)
        cum -= np.concatenate([[0.0], cum])[start[:-1]][own]
        lo, hi = self.used, self.used + total
        for name, values in (("cum", cum), ("log_p", log_p), ("next", np.where(after < 0, -1, after + self.nodes)), ("number", number), ("own", own + self.nodes)):
            self._room(name, hi)[lo:hi] = values
        self._room("starts", self.nodes + n + 1)[self.nodes : self.nodes + n + 1] = start + self.used
        first = self.known.add(h)
        self._room("roots", self.known.n)[first] = rank[ends - sizes] + self.nodes
        self.used, self.nodes = hi, self.nodes + n


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit_interval(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def uniforms(seed: int, stream: int, n: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by seed, stream and place."""
    base = _mix(np.array([(seed ^ (stream * 0xD1342543DE82EF95)) & (2**64 - 1)], np.uint64))
    return _unit_interval(_mix(base + _GOLD * np.arange(1, n + 1, dtype=np.uint64)))


def walk(lattices: Lattices, node: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Free decisions from each node to its unit's end (-1: there already), drawn from each unit's own stream:
    the choices, and the place of each unit's first."""
    rounds = []
    count = np.zeros(len(node), np.int64)
    active = np.nonzero(node >= 0)[0]
    node, step = node[active], 0
    starts, cum, after = lattices.starts, lattices.cum, lattices.next
    while len(active):
        step = (step + int(_GOLD)) % 2**64
        u = _unit_interval(_mix(base[active] + np.uint64(step))).astype(np.float32)
        lo, hi = starts[node], starts[node + 1] - 1
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            right = (cum[mid] < u) & open_
            hi = np.where(right, hi, np.where(open_, mid, hi))
            lo = np.where(right, mid + 1, lo)
        rounds.append((active, lo))
        count[active] += 1
        node = after[lo]
        more = node >= 0
        active, node = active[more], node[more]
    places = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(places[-1], np.int32)
    for r, (units, chosen) in enumerate(rounds):
        out[places[units] + r] = chosen
    return out, places


@dataclass
class Path:
    """One segmentation: its choices in order, and the place of each unit's first, their number last."""

    choices: np.ndarray
    log_p: np.ndarray
    starts: np.ndarray
    gumbel: float
    total: float = 0.0

    def __post_init__(self):
        self.total = float(self.log_p.sum(dtype=np.float64))


class Sampler:
    """Gumbel top-k without replacement over all segmentations of one text.

    The chain of lattices is one lattice; a segmentation is a row of choices, the next piece at a node. A
    region is a set of segmentations that share their first choices and avoid some
    at the next; its perturbed maximum is a Gumbel variable at its log mass, truncated at that of the
    region it came from. The search takes the region with the highest maximum, draws the segmentation
    that attains it, and splits what is left; so segmentations come out by falling perturbed value. The
    free decisions of many texts are drawn together (walk); ask() says what this text needs drawn next,
    and tell() takes it.
    """

    def __init__(self, lattices: Lattices, seed: int, roots: np.ndarray, k: int):
        self.l, self.seed, self.roots = lattices, seed & (2**64 - 1), roots
        self.heap, self.number, self.want = [], 0, k + 1
        self.draws, self.at, self.stock = 0, 0, np.zeros(0)
        self.found: list[Path] = []

    def _u(self, n: int) -> np.ndarray:
        if self.at + n > len(self.stock):
            self.draws += 1
            self.stock, self.at = uniforms(self.seed, self.draws, max(n, 4 * BLOCK)), 0
        self.at += n
        return self.stock[self.at - n : self.at]

    def stream(self) -> int:
        """Start value of the streams for the sample that comes next; each unit has one of its own."""
        return (self.seed + (len(self.found) + 1) * 0xD6E8FEB86659FD93) & (2**64 - 1)

    def _settle(self) -> bool:
        """Split tails until a region leads; False: nothing is left."""
        while self.heap and self.heap[0][4] is None:
            value, _, path, t, _, prefix = heapq.heappop(self.heap)
            self._open(path, t, prefix, -value)
        return bool(self.heap)

    def ask(self) -> tuple[np.ndarray, int] | None:
        """(nodes, number of the first) of the units to draw; None: no segmentation is left."""
        if not self.found:
            self.plan = None
            return self.roots, 0
        if not self._settle():
            return None
        value, _, path, t, banned, prefix = heapq.heappop(self.heap)
        unit = int(np.searchsorted(path.starts, t, side="right")) - 1
        node = int(self.l.own[path.choices[t]])
        lo, hi = int(self.l.starts[node]), int(self.l.starts[node + 1])
        row = np.exp(self.l.log_p[lo:hi].astype(np.float64))
        row[[b - lo for b in banned]] = 0.0
        cum = np.cumsum(row)
        chosen = min(int(np.searchsorted(cum, self._u(1)[0] * cum[-1])), int(np.nonzero(row)[0][-1]))
        nodes = self.roots[unit:].copy()
        nodes[0] = self.l.next[lo + chosen]
        self.plan = (path, t, banned, prefix, -value, unit, lo, row, chosen)
        return nodes, unit

    def tell(self, choices: np.ndarray, starts: np.ndarray) -> None:
        log_p = self.l.log_p[choices]
        if self.plan is None:
            g = -float(np.log(-np.log(self._u(1)[0])))
            self.found.append(Path(choices, log_p, starts, g))
            self._open(self.found[0], 0, 0.0, g)
            return
        old, t, banned, prefix, g, unit, lo, row, chosen = self.plan
        own = lo + chosen
        lp = float(self.l.log_p[own])
        path = Path(np.concatenate([old.choices[:t], np.array([own], np.int32), choices]), np.concatenate([old.log_p[:t], np.array([lp], np.float32), log_p]), np.concatenate([old.starts[: unit + 1], starts[1:] + t + 1]), g)
        self.found.append(path)
        row[chosen] = 0.0
        left = float(row.sum())
        if left > 0:
            self._push(float(self._truncated(np.array([prefix + np.log(left)]), g)[0]), path, t, (*banned, own), prefix)
        self._open(path, t + 1, prefix + lp, g)

    def next_best(self) -> float:
        """The perturbed value of the segmentation that would come next; -inf: there is none."""
        return -self.heap[0][0] if self._settle() else -np.inf

    def _push(self, value: float, path: Path, t: int, banned, prefix: float) -> None:
        self.number += 1
        heapq.heappush(self.heap, (-value, self.number, path, t, banned, prefix))

    def _truncated(self, mass: np.ndarray, bound: float) -> np.ndarray:
        return -np.logaddexp(-bound, np.log(-np.log(self._u(len(mass)))) - mass)

    def _open(self, path: Path, t: int, prefix: float, bound: float) -> None:
        """Regions that leave the path at one of its next BLOCK decisions from t on, and the tail after them."""
        part = path.log_p[t : t + BLOCK].astype(np.float64)
        if not len(part):
            return
        before = prefix + np.concatenate([[0.0], np.cumsum(part)])
        node = self.l.own[path.choices[t : t + BLOCK]]
        other = np.maximum(-np.expm1(part), 1e-12)  # chances are single precision: where there is a choice, it has mass
        values = self._truncated(before[:-1] + np.log(other), bound)
        end = t + len(part)
        keep = np.nonzero(self.l.starts[node + 1] - self.l.starts[node] > 1)[0]
        if len(keep) > self.want:
            keep = keep[np.argpartition(-values[keep], self.want - 1)[: self.want]]  # no more can come next
        for i in keep.tolist():
            self._push(float(values[i]), path, t + i, (int(path.choices[t + i]),), float(before[i]))
        if end < len(path.log_p):
            rest = min(0.0, float(path.log_p[end:].sum(dtype=np.float64)))
            mass = before[-1] + np.log(max(-np.expm1(rest), 1e-12))
            # the value is the maximum of what is left; it bounds the regions that this is split into
            self._push(float(self._truncated(np.array([mass]), bound)[0]), path, end, None, float(before[-1]))


def piece_ids(lattices: Lattices, paths: list[Path]) -> list[np.ndarray]:
    """Piece numbers of each path in its text's order; what no piece covers is its bytes' pieces."""
    raw = lattices.number[np.concatenate([x.choices for x in paths])]
    ends = np.cumsum([len(x.choices) for x in paths])
    bare = np.nonzero(raw < 0)[0]
    if len(bare):
        by = np.array(lattices.v.byte_ids, np.int32)
        code = -1 - raw[bare].astype(np.int64)
        width = _width(code)
        times = np.ones(len(raw), np.int64)
        times[bare] = width
        places = np.cumsum(times)
        at, raw = places[bare] - width, np.repeat(raw, times)
        one = width == 1
        raw[at[one]] = by[code[one]]
        for i, c in zip(at[~one].tolist(), code[~one].tolist(), strict=True):
            for j, b in enumerate(chr(c).encode("utf-8", "surrogatepass")):
                raw[i + j] = by[b]
        ends = places[ends - 1]
    return np.split(raw, ends[:-1])


def sample_texts(lattices: Lattices, texts: list[str], seeds: list[int], k: int) -> list[tuple[list[Path], float]]:
    """For each text (none empty) at most k paths by falling perturbed value, and the value that would come
    next; draws depend on a text and its seed alone."""
    if not texts:
        return []
    if lattices.used > CHOICES:
        lattices.clear()
    roots, firsts = lattices.first_nodes(texts)
    samplers = [Sampler(lattices, seed, roots[a:b], k) for seed, a, b in zip(seeds, firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
    # the first numbers of all texts at once
    base = _mix(np.array([s.seed ^ 0xD1342543DE82EF95 for s in samplers], np.uint64))[:, None]
    stocks = _unit_interval(_mix(base + _GOLD * np.arange(1, 4 * BLOCK + 1, dtype=np.uint64)))
    for s, stock in zip(samplers, stocks, strict=True):
        s.draws, s.stock = 1, stock
    for _ in range(k):
        asked = [(s, a) for s in samplers if (a := s.ask()) is not None]
        if not asked:
            break
        counts = np.array([len(a[0]) for _, a in asked])
        lows = np.cumsum(counts) - counts
        base = _mix(np.array([s.stream() for s, _ in asked], np.uint64))
        unit = (np.arange(counts.sum()) + np.repeat(np.array([a[1] for _, a in asked]) - lows, counts)).astype(np.uint64)
        chosen, places = walk(lattices, np.concatenate([a[0] for _, a in asked]), _mix(np.repeat(base, counts) + unit * _M2))
        for (s, _), at, n in zip(asked, lows.tolist(), counts.tolist(), strict=True):
            lo, hi = places[at], places[at + n]
            s.tell(chosen[lo:hi], places[at : at + n + 1] - lo)
    return [(s.found, s.next_best()) for s in samplers]


_kept: list[Lattices] = []


def _lattices(vocabulary: Vocabulary) -> Lattices:
    """This process's lattices, which its tasks use one after the other; draws don't depend on what they hold."""
    if not _kept or _kept[0].v is not vocabulary:
        _kept[:] = [Lattices(vocabulary)]
    return _kept[0]


def inclusions(above: float) -> tuple[float, float]:
    """Chance that a segmentation's perturbed value exceeds the threshold, from its log chance less the threshold;
    and the logarithm of that chance, which is `above` itself where that is far below 0."""
    chance = float(-np.expm1(-np.exp(min(50.0, above))))
    return chance, float(np.log(chance)) if above > -30 else float(above)


_OUT = "key string, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, log_inclusion double"


def encode(docs: DataFrame, model: str, k: int = 2, key: str = "doc_id", text: str = "text", seed: int = 11, alpha: float = ALPHA) -> DataFrame:
    """(key, sample, ids, log_prob, perturbed, inclusion, log_inclusion): at most k distinct segmentations of each text,
    drawn without replacement with chances by their scores, sample 1 with the highest perturbed value.

    inclusion is the chance that a segmentation's perturbed value exceeds the (k+1)-th: dividing by it makes
    weighted sums unbiased; 1 where all segmentations were drawn. Of long texts it is below what a double holds, and 0;
    log_inclusion, its logarithm, holds it for texts of any length: weigh by exp(-log_inclusion), in logarithms. Draws depend on seed, key and text alone:
    repeated rows and reruns give equal results. A text with fewer than k segmentations gives all of them; a
    null or empty text gives one without ids. Texts of any length are held whole, one at a time, and no word or piece is
    cut: a lattice ends only where no piece can cross (see Lattices). A worker remembers lattices of up to CHOICES
    choices (some 30 MB) and forgets them all beyond; while it draws, it needs about 40 bytes for each character of a text, and some 150
    for each of a stretch that it has not met before. The model file is
    read on the driver and its pieces (as many as the model has) are broadcast. No shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, alpha))

    def run(batches):
        lattices = _lattices(vocabulary.value)

        def answer(some):
            full = [x for x in some if x[2]]
            drawn = sample_texts(lattices, [x[2] for x in full], [x[1] for x in full], k)
            ids = iter(piece_ids(lattices, [p for paths, _ in drawn for p in paths]) if drawn else ())
            drawn, rows = iter(drawn), []
            for name, _, t in some:
                if not t:
                    rows.append((name, 1, np.zeros(0, np.int32), 0.0, 0.0, 1.0, 0.0))
                    continue
                paths, kappa = next(drawn)
                for i, p in enumerate(paths, 1):
                    rows.append((name, i, next(ids), p.total, p.gumbel, *inclusions(p.total - kappa)))
            return _rows(rows)

        for b in batches:
            some, size = [], 0
            for name, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                some.append((name, h, t.as_py() or ""))
                size += len(some[-1][2])
                if size > TOGETHER:
                    yield answer(some)
                    some, size = [], 0
            if some:
                yield answer(some)

    rows = docs.select(F.col(key).cast("string"), F.xxhash64(F.lit(seed), F.col(key)), F.col(text))
    return rows.mapInArrow(run, _OUT).withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


def _rows(rows) -> pa.RecordBatch:
    key, sample, ids, *scores = zip(*rows, strict=True)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(sample, pa.int32()), flat, *(pa.array(x, pa.float64()) for x in scores)], [x.split()[0] for x in _OUT.split(", ")])


def decode_ids(ids, surfaces: list[bytes | None]) -> str:
    """The text of piece numbers; control pieces are nothing, broken UTF-8 becomes U+FFFD."""
    raw = b"".join([surfaces[i] or b"" for i in ids])
    return raw.decode("utf-8", "replace")[1:] if raw[:1] == b" " else raw.decode("utf-8", "replace")


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of its piece numbers; null ids give null."""
    surfaces = df.sparkSession.sparkContext.broadcast(Vocabulary.load(model).surfaces)

    @F.pandas_udf("string")
    def texts(column):
        import pandas as pd

        return pd.Series([None if x is None else decode_ids(x.tolist(), surfaces.value) for x in column], dtype=object)

    return df.withColumn(out, texts(F.col(ids)))
