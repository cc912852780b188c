"""Documents packed into token sequences of a fixed size, by bounded-space online best fit."""

from __future__ import annotations

import os
import re
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Tokens of a sequence, windows that a partition keeps open, partitions whose leftovers are merged at once.
WINDOW, OPEN, FAN = 2_048, 16, 64
#: Id that ends each document.
END = 1
#: Bytes of an id in `ids`: unsigned, little-endian.
WIDTH = 4
#: Chunks of text whose ids a worker remembers, in two generations of so many; longer ones than so many characters aren't kept.
REMEMBERED, LONG = 400_000, 48
#: Marks that are tokens of their own after a letter or digit.
MARKS = ".,;:!?"
#: Such a mark at the end of a chunk, after a letter or digit of Latin-1.
_LAST_MARK = re.compile(rf"[{MARKS}](?!\S)(?<=[{''.join(c for c in map(chr, range(256)) if c.isalnum())}].)")
#: Bytes of ids in one batch of rows.
BATCH = 4 << 20
#: What str.split() takes for white space and the tokenizer doesn't.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

_SCHEMA = "sequence_id long, offset long, key long, start long, length long, doc_tokens long, ids binary, rest binary, part int"
_ARROW = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("rest", pa.binary()), ("part", pa.int32())])


class Chunks(dict):
    """Ids of chunks of text without white space, as bytes. No token, normal form or pattern of the tokenizer crosses white space, so a
    text's ids are those of its chunks in a row. The newest generation is looked at first; what it finds in the one before moves over."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_file(path), {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None and chunk[-1] in MARKS and "ÿ" >= chunk[-2:-1] and chunk[-2:-1].isalnum():
            return self[chunk[:-1]] + self[chunk[-1]]  # not remembered: its parts are
        if found is None:
            found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= LONG:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")
            text = text.lower()  # as the tokenizer does; letters beyond have rules of their own
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, _LAST_MARK.sub(r" \g<0>", text).split()))  # words ahead of a mark are met without it


_chunks: dict[str, Chunks] = {}


def chunks_of(path: str) -> Chunks:
    """A worker's memory of a vocabulary that lowers case and drops white space."""
    if path not in _chunks:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _chunks[path] = Chunks(path)
    return _chunks[path]


class Packer:
    """A fixed number of open windows. A document takes whole windows first; its tail goes where it fits best. Where none fits, the fullest
    window is filled with the tail's head and emitted, and what is left of the tail opens a new one."""

    def __init__(self, first: int, window: int, most: int):
        self.next, self.window, self.most = first, window, most
        self.open: list[tuple[int, list]] = []  # (free, pieces)
        self.done: list[tuple] = []

    def add(self, key, start: int, ids, total: int) -> None:
        """Places a run of a document's ids that starts at its id `start`."""
        size, at = len(ids) // WIDTH, 0
        while size - at >= self.window:
            self.emit([(key, start + at, self.window, total, ids[at * WIDTH : (at + self.window) * WIDTH])])
            at += self.window
        while at < size:
            need = size - at
            free, k = min(((f, i) for i, (f, _) in enumerate(self.open) if f >= need), default=(0, -1))
            if k < 0 and len(self.open) < self.most:
                self.open.append((self.window, []))
                free, k = self.window, len(self.open) - 1
            elif k < 0:
                free, k = min((f, i) for i, (f, _) in enumerate(self.open))
            take = min(need, free)
            pieces = self.open[k][1]
            pieces.append((key, start + at, take, total, ids[at * WIDTH : (at + take) * WIDTH]))
            at += take
            if take == free:
                self.open.pop(k)
                self.emit(pieces)
            else:
                self.open[k] = (free - take, pieces)

    def emit(self, pieces: list) -> None:
        offset = 0
        for key, start, length, total, ids in pieces:
            self.done.append((self.next, offset, key, start, length, total, ids, None))
            offset += length
        self.next += 1

    def rest(self) -> None:
        """The pieces of windows that are still open, without a sequence."""
        for _, pieces in self.open:
            self.done += [(None, None, key, start, length, total, None, ids) for key, start, length, total, ids in pieces]
        self.open = []

    def close(self) -> None:
        """What is left in whole windows, and the last of it in sequences whose lengths are the powers of two that add up to it: no padding."""
        left = [p for _, pieces in self.open for p in pieces]
        self.open = []
        while left:
            total = sum(p[2] for p in left)
            size = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            taken: list = []
            while size:
                key, start, length, total, ids = left.pop(0)
                part = min(size, length)
                taken.append((key, start, part, total, ids[: part * WIDTH]))
                if part < length:
                    left.insert(0, (key, start + part, length - part, total, ids[part * WIDTH :]))
                size -= part
            self.emit(taken)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def _batches(rows: list[tuple], part: int):
    """Rows of a partition as batches of bounded bytes."""
    at = size = 0
    for i, r in enumerate(rows):
        size += WIDTH * r[4]
        if size >= BATCH or i == len(rows) - 1:
            cols = [*zip(*rows[at : i + 1], strict=True), [part] * (i + 1 - at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
            at, size = i + 1, 0


def _merger(level: int, final: bool, window: int, open_windows: int):
    """Packs the leftovers of a group of partitions; the final one closes all windows."""

    def merge(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        rows = zip(*(group.column(c).to_pylist() for c in ("key", "start", "rest", "doc_tokens")), strict=True)
        packer = Packer(level << 57 | part << 31, window, open_windows)
        for k, start, ids, total in sorted(rows, key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1], r[2])):
            packer.add(k, start, ids, total)
        packer.close() if final else packer.rest()
        return pa.Table.from_batches(_batches(packer.take(), part), schema=_ARROW)

    return merge


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN, end: int = END) -> DataFrame:
    """Pieces of documents in sequences of `window` tokens: (key, start, length, doc_tokens, sequence_id, offset, ids).

    A document is the ids of its text and `end`; a piece is `length` of them from `start` on, at `offset` of its sequence; ids are unsigned 32-bit
    numbers, little-endian, in one binary. Each id lies in exactly one piece, and a sequence's pieces leave no gap. All sequences are full but the
    last few, whose lengths are different powers of two. tokenizer: a file of the tokenizers library whose tokens don't cross white space and that lowers case.

    Each partition is packed online with `open_windows` windows (see Packer). What is open at its end is merged: the leftovers of FAN partitions
    are packed by one task in the same way, then those of FAN such tasks, until one task is left. It holds FAN * open_windows windows at most, whatever the input.
    Tokenised pieces are written once, in the shared folder; tasks that are repeated name their sequences alike, by partition and number.

    Keys are whole numbers. Null texts are empty: a document of `end` alone. Null and equal keys, and repeated rows, are documents of their own. Very long texts
    take whole windows. No rows: no pieces. Other columns are not read, and may have any names.
    """

    def first(batches):
        part = TaskContext.get().partitionId()
        chunks, packer, last = chunks_of(tokenizer), Packer(part << 31, window, open_windows), array("I", [end]).tobytes()
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                ids = chunks.ids(t.as_py() or "") + last
                packer.add(k.as_py(), 0, ids, len(ids) // WIDTH)
                if len(packer.done) > 2_000:
                    yield from _batches(packer.take(), part)
            yield from _batches(packer.take(), part)
        packer.rest()
        yield from _batches(packer.take(), part)

    tables = [materialize(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(first, _SCHEMA), "packed")]
    while True:
        left = tables[-1].where("ids is null").withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        top = left.agg(F.max("part")).first()[0]
        if top is None:
            break

        merge = _merger(len(tables), top == 0, window, open_windows)
        tables.append(materialize(left.groupBy("part").applyInArrow(merge, _SCHEMA), "packed"))
    own = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    out = None
    for table in tables:
        some = table.where("ids is not null").select(F.col("key").alias(key), *own)
        out = some if out is None else out.unionByName(some)
    return out


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pack()'s pieces: the ids of each sequence in a row, padded to `window` unless their number is a
    power of two. A sequence has `window` ids at most, so no group is large."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    made = pieces.groupBy("sequence_id").agg(own.alias("own"))
    n = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x.length)
    ids = F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x.ids))
    made = made.select("sequence_id", n.alias("n_tokens"), ids.alias("ids"))
    size = F.when(F.bit_count("n_tokens") == 1, F.col("n_tokens")).otherwise(F.lit(window))
    fill = F.lit(pad.to_bytes(WIDTH, "little"))
    return made.withColumn("ids", F.rpad("ids", (WIDTH * size).cast("int"), fill))
