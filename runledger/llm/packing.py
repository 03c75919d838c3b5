"""Packing token ids into training sequences.

``pack_tiers``: hierarchical multi-length packing. Documents are routed to windows of 256, 512, 1024 or
2048 tokens (the smallest that holds them; longer ones first give full 2048 windows). Every window is
led by the longest piece of its tier, its gap is filled best-fit from the same and shorter tiers, and
where nothing fits a piece is cut at the gap, so that all windows are full but the last few of a task.
Equal numbers of tokens, one tier at a time in units of 2048, make up the step groups.

``pack_best_fit``: best-fit-decreasing into rows of one length. Overlong documents are split losslessly;
the open row with the least room that still holds a piece is found by a segment tree over capacities.

Both pack within tasks, in slices of the task's documents, so nothing is shuffled and a task holds one
slice. Packing follows the input's order within partitions; it is the same again for the same partitions.

Defined results: a null text is empty and gives the closing id alone; repeated rows are packed each; a
null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import columns, in_batches
from runledger.llm.tokens import END, encoder

TIERS = (256, 512, 1024, 2048)
STEP_UNITS = 16
#: Pieces stay in the pool until so many tokens are there to choose from.
POOL_TOKENS = 16 * TIERS[-1]
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ROWS = "sequence_id long, ids binary, positions binary, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _documents(batch: pa.RecordBatch, path: str) -> Iterator[list[tuple]]:
    """Slices of (doc_id, ids with the closing id as uint32 bytes)."""
    encode, close = encoder(path).encode, int(END).to_bytes(4, "little")
    body, offsets = textvec.buffers(batch.column("text"))
    for at, to in textvec.slices(offsets):
        flat, ends = encode(body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        raw = flat.astype("<u4").tobytes()
        yield [(doc, raw[4 * a : 4 * b] + close) for doc, a, b in zip(batch.column("doc_id").slice(at, to - at).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class _Pool:
    """Pieces (doc_id, start, ids, doc_tokens) in order of length; ties in order of arrival."""

    def __init__(self) -> None:
        self.order: list[tuple[int, int]] = []
        self.pieces: dict[int, tuple] = {}
        self.tokens = self.seen = 0

    def add(self, piece: tuple) -> None:
        self.seen -= 1  # of equal lengths the first to arrive is the last in order, and is taken first
        insort(self.order, (len(piece[2]) // 4, self.seen))
        self.pieces[self.seen] = piece
        self.tokens += len(piece[2]) // 4

    def take(self, at: int) -> tuple:
        n, key = self.order.pop(at)
        self.tokens -= n
        return self.pieces.pop(key)

    def best_fit(self, room: int) -> tuple | None:
        """The longest piece of at most room tokens."""
        at = bisect_left(self.order, (room + 1, -1 << 62)) - 1
        return self.take(at) if at >= 0 else None

    def cut(self, room: int) -> tuple:
        """The first room tokens of the shortest piece, all being longer; the rest goes back."""
        doc, start, ids, total = self.take(0)
        self.add((doc, start + room, ids[4 * room :], total))
        return doc, start, ids[: 4 * room], total


def _fill(pool: _Pool, size: int) -> list[tuple]:
    """Pieces of exactly size tokens out of a pool that has as many."""
    out, room = [], size
    while room:
        piece = pool.best_fit(room) or pool.cut(room)
        room -= len(piece[2]) // 4
        out.append(piece)
    return out


def _windows(pool: _Pool, least: int) -> Iterator[tuple[int, list[tuple]]]:
    """(tier, pieces) of full windows while the pool has at least ``least`` tokens; a window is led by the longest piece."""
    while pool.tokens >= max(least, TIERS[0]):
        longest = pool.order[-1][0]
        tier = next(t for t in TIERS if t >= min(longest, TIERS[-1]))
        while tier > pool.tokens:
            tier //= 2
        yield tier, _fill(pool, tier)


def _tiers(batches: Iterator[pa.RecordBatch], path: str, step_units: int) -> Iterator[pa.RecordBatch]:
    pool, base = _Pool(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    count, units, filled = 0, 0, dict.fromkeys(TIERS, 0)
    unit_of: dict[int, int] = {}
    rows: list[tuple] = []

    def emit(tier: int, pieces: list[tuple]) -> None:
        nonlocal count, units
        if filled[tier] % TIERS[-1] == 0:  # a new unit: a full step's worth of one tier
            unit_of[tier], units = units, units + 1
        filled[tier] += tier
        at = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, ids, total, base + count, at, tier, base + unit_of[tier] // step_units))
            at += len(ids) // 4
        count += 1

    def flushed() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)
            rows.clear()

    for batch in batches:
        for docs in _documents(batch, path):
            for doc, ids in docs:
                total, at = len(ids) // 4, 0
                while total - at >= TIERS[-1]:
                    emit(TIERS[-1], [(doc, at, ids[4 * at : 4 * (at + TIERS[-1])], total)])
                    at += TIERS[-1]
                if at < total:
                    pool.add((doc, at, ids[4 * at :], total))
            for tier, pieces in _windows(pool, POOL_TOKENS):
                emit(tier, pieces)
            yield from flushed()
    for tier, pieces in _windows(pool, TIERS[0]):
        emit(tier, pieces)
    if pool.tokens:
        emit(TIERS[0], _fill(pool, pool.tokens))
    yield from flushed()


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def pack_tiers(docs: DataFrame, tokenizer: str, step_units: int = STEP_UNITS) -> DataFrame:
    """One row a piece of docs (doc_id, text): where it lies, its ids (uint32, little-endian), tier and step group."""
    own = columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return in_batches(own, partial(_tiers, path=tokenizer, step_units=step_units), _PIECES)


class _Capacities:
    """A segment tree over capacities 0..most: how many open rows have each; finds the least that is at least n."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def pop(self, n: int) -> tuple[int, int] | None:
        """(capacity, row) of the open row with the least capacity >= n."""
        at = self.leaves + n
        while not self.count[at]:
            while at & 1:  # a right child: climb until there is something to the right
                at >>= 1
                if not at:
                    return None
            at += 1
            if at == 1 or at & (at - 1) == 0:
                return None
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indexes of lengths (each at most size), longest first into the fullest row that holds it."""
    rows: list[list[int]] = []
    open_ = _Capacities(size)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.pop(lengths[i])
        if found is None:
            found = size, len(rows)
            rows.append([])
        rows[found[1]].append(i)
        open_.put(found[0] - lengths[i], found[1])
    return rows


def _best_fit(batches: Iterator[pa.RecordBatch], path: str, size: int) -> Iterator[pa.RecordBatch]:
    count, kind = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, "<u2" if encoder(path).size <= 1 << 16 else "<u4"
    pending: list[tuple] = []

    def packed() -> pa.RecordBatch:
        nonlocal count
        out: list[tuple] = []
        for row in best_fit_decreasing([len(p[2]) // 4 for p in pending], size):
            pieces = [pending[i] for i in row]
            ends = np.cumsum([0, *(len(p[2]) // 4 for p in pieces)]).tolist()
            ids = np.frombuffer(b"".join(p[2] for p in pieces), "<u4").astype(kind)
            places = np.arange(len(ids)) - np.repeat(ends[:-1], np.diff(ends))
            out.append((count, *(np.pad(x.astype(kind), (0, size - len(x))).tobytes() for x in (ids, places)), ends[-1], ends, [p[0] for p in pieces], [p[1] for p in pieces]))
            count += 1
        pending.clear()
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _ROWS.split(", ")])

    held = 0
    for batch in batches:
        for docs in _documents(batch, path):
            for doc, ids in docs:
                pending += [(doc, at, ids[4 * at : 4 * (at + size)]) for at in range(0, len(ids) // 4, size)]
                held += len(ids) // 4
                if held >= POOL_TOKENS * 32:
                    yield packed()
                    held = 0
    if pending:
        yield packed()


def pack_best_fit(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """One row a packed sequence: the padded id matrix row (uint16, or uint32 for large vocabularies), the
    position of each id in the same width, starting anew at every segment (padding has 0), the cumulative
    segment lengths, and the documents and starts of the segments."""
    own = columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return own.mapInArrow(partial(_best_fit, path=tokenizer, size=size), _ROWS)
