"""Repeated byte strings across a corpus, by longest-previous-factor arrays over suffix order.

A window is a string of ``length`` bytes of one text. It is repeated if it also starts elsewhere, in another text or
the same one; every byte of a repeated window can be removed, or only those of the later copies (``keep_first``).
A suffix array of the whole corpus is cut into parts that tasks can sort, so that equal windows always meet:

1. Every window is dealt to its anchor, the smallest hash of the strings of half its length in it; equal windows have
   equal anchors. Runs of windows with one anchor are a chunk (on average one for about a quarter of the length);
   only hashes, places and sizes of chunks are shuffled.
2. Chunks whose anchor occurs once go, unless they hold it twice. Equal chunks (by anchor, content and size) are one
   class: in a class of two or more every window is repeated, and one chunk of it stands for all.
3. Where an anchor has several classes, and some windows are still open, the classes' bytes are brought together,
   once a class. A task sorts the suffixes of its chunks by prefix doubling up to ``length`` bytes. Text positions
   follow the order of documents, and equal prefixes lie in the order of their positions, so the nearest smaller and
   nearest greater position in suffix order that share ``length`` bytes are the neighbours: if there is a smaller one
   the longest previous factor reaches ``length``, and the window has an earlier copy; if a greater one, a later copy.
4. An anchor with more classes than ``CROWD`` would be one task's: its windows are dealt by hashes of the whole
   window instead and counted by partial aggregation, an exact way for the same windows.
5. Windows become spans of bytes, merged for each text. Only texts that keep a part are shuffled.

Defined results: texts are UTF-8 bytes, null is empty; texts shorter than ``length`` have no window; overlapping
copies count; "first" is by doc_id (null last), then file and row, then place; repeated rows and ids are texts of their
own; an empty table gives an empty result; other columns are ignored. Hashes have 64 bits (two of them for a class).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import FILTER_BITS, _marked, columns, located, maybe_in, stored

LENGTH = 400
#: Classes of an anchor that one task may sort; windows of a chunk at most; bytes that a task sorts at once, about.
CROWD, MOST_WINDOWS, SORTED_BYTES = 2048, 512, 1 << 19
_BASE = 0x9E3779B97F4A7C15
_CHUNKS = "a long, c long, i long, f long, r long, s long, m int, twice boolean"
_SPANS = "f long, r long, start long, end long"
_LAST = (1 << 63) - 1


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _sums(body: np.ndarray) -> np.ndarray:
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _powers(textvec.SLICE_BYTES * 2)[0][: len(body)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts: np.ndarray | slice, size: np.ndarray | int) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes from starts, out of prefix sums."""
    if isinstance(starts, slice):
        starts = np.arange(starts.start, starts.stop)
    return textvec.mix((sums[starts + size] - sums[starts]) * _powers(textvec.SLICE_BYTES * 2)[1][starts])


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row, by doubling."""
    done = 1
    while done * 2 <= width:
        values, done = np.minimum(values[:-done], values[done:]), done * 2
    return values if done == width else np.minimum(values[: len(values) - (width - done)], values[width - done :])


def chunks(body: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, row, first window, windows, whether the anchor lies in it twice) of the chunks of rows."""
    none = np.zeros(0, np.int64)
    if len(body) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool)
    half = length // 2
    width = length - half + 1
    sums = _sums(body)
    grams = _hashes(sums, slice(0, len(body) - half + 1), half)
    least = _minima(grams, width)
    row = np.searchsorted(ends, np.arange(len(least)), "right") - 1
    whole = np.arange(len(least)) + length <= ends[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(new & whole)
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(bool)
    stops = np.append(starts[1:], len(least))
    bound = np.flatnonzero(np.diff(whole.astype(np.int8)) == -1) + 1  # the first place past each row's last window
    last = np.append(bound, len(least))[np.searchsorted(bound, starts, "right")]
    stops = np.minimum(stops, last)
    pieces = -(-(stops - starts) // MOST_WINDOWS)
    if (pieces > 1).any():  # long runs of one anchor: periodic texts
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stops = np.minimum(np.repeat(stops, pieces), np.repeat(starts, pieces) + (piece + 1) * MOST_WINDOWS)
        starts = np.repeat(starts, pieces) + piece * MOST_WINDOWS
    m, anchor = stops - starts, least[starts]
    size = m + width - 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(starts - first, size)
    twice = np.add.reduceat((grams[at] == np.repeat(anchor, size)).astype(np.int32), first) > 1
    return anchor, _hashes(sums, starts, m + length - 1), row[starts], starts - ends[row[starts]], m, twice


def _blocks(body: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, ends of rows, place of the first byte in its text): slices of rows, and of a long text blocks
    that overlap by one byte less than a window."""
    for at, to in textvec.slices(offsets, textvec.SLICE_BYTES):
        part = body[offsets[at] : offsets[to]]
        if to - at > 1 or len(part) <= textvec.SLICE_BYTES:
            yield at, part, offsets[at : to + 1] - offsets[at], 0
            continue
        for start in range(0, max(1, len(part) - length + 1), textvec.SLICE_BYTES):
            piece = part[start : start + textvec.SLICE_BYTES + length - 1]
            yield at, piece, np.array([0, len(piece)]), start


def _chunk(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = textvec.buffers(batch.column("text"))
        for at, part, ends, start in _blocks(body, offsets, length):
            a, c, row, s, m, twice = chunks(part, ends, length)
            if len(a):
                rows = pa.array(row + at)
                own = [batch.column(x).take(rows) for x in ("i", "f", "r")]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), *own, pa.array(s + start), pa.array(m.astype(np.int32)), pa.array(twice)], ["a", "c", "i", "f", "r", "s", "m", "twice"])


def suffix_ranks(body: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the prefixes of ``length`` bytes of the suffixes at starts, in suffix order; equal ones have equal ranks.

    Prefix doubling; a sort of one array of integers a round, with the place in the lowest bits.
    """
    n = len(body)
    bits = np.uint64(max(1, int(n - 1).bit_length()))

    def ranked(keys: np.ndarray, places: int) -> np.ndarray:
        order = np.sort((keys << bits) | np.arange(len(keys), dtype=np.uint64))
        place, key = (order & np.uint64((1 << int(bits)) - 1)).astype(np.int64), order >> bits
        out = np.zeros(places, np.uint64)
        out[place] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(np.uint64)
        return out

    done, rank = min(4, length), np.zeros(n, np.uint64)
    for j in range(done):
        rank = (rank << np.uint64(8)) | np.concatenate([body[j:], np.zeros(j, np.uint8)]).astype(np.uint64)
    rank = ranked(rank, n)

    def paired(at: np.ndarray, further: int) -> np.ndarray:
        return (rank[at] << bits) | rank[np.minimum(at + further, n - 1)]

    while done * 2 <= length:
        rank, done = ranked(paired(np.arange(n), done), n), done * 2
    return ranked(paired(starts, length - done), len(starts))


def previous_and_next(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows in text order with these ranks: whether the longest previous factor reaches the window's length, and
    the longest next one. In suffix order, equal ones by position, both are read off the neighbours."""
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``SORTED_BYTES`` that hold all chunks of their anchors, out of rows sorted by these."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            table = pa.Table.from_batches([batch.slice(at, 256)])
            held.append(table)
            size += table.column("bytes").nbytes
            if size < SORTED_BYTES:
                continue
            full = pa.concat_tables(held).combine_chunks()
            anchor = full.column("a").to_numpy()
            cut = int(np.searchsorted(anchor == anchor[-1], True))  # the last may go on
            if cut:
                yield full.slice(0, cut)
            held, size = [full.slice(cut)], full.slice(cut).column("bytes").nbytes
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _factor(batches: Iterator[pa.RecordBatch], length: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Spans of bytes of the chunks' windows that have another copy (``keep_first``: an earlier one)."""
    for table in _whole(batches):
        column = table.column("bytes").combine_chunks()
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        body, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
        m, s = table.column("m").to_numpy().astype(np.int64), table.column("s").to_numpy()
        chunk = np.repeat(np.arange(len(m)), m)
        within = np.arange(len(chunk)) - np.repeat(np.cumsum(m) - m, m)
        earlier, later = previous_and_next(suffix_ranks(body, ends[chunk] + within, length))
        yield from _runs(table, chunk, within, earlier if keep_first else earlier | later, s, length)


def _runs(table: pa.Table, chunk: np.ndarray, within: np.ndarray, hit: np.ndarray, s: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~(hit[:-1] & (chunk[1:] == chunk[:-1]))
    last[:-1] &= ~(hit[1:] & (chunk[1:] == chunk[:-1]))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    if len(a):
        rows = chunk[a]
        own = [pa.array(table.column(x).to_numpy()[rows]) for x in ("f", "r")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(s[rows] + within[a]), pa.array(s[rows] + within[b] + length)], ["f", "r", "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A hash of every window of the chunks."""
    for batch in batches:
        for k in range(batch.num_rows):
            body, m = np.frombuffer(batch.column("bytes")[k].as_py(), np.uint8), batch.column("m")[k].as_py()
            own = [pa.array(np.full(m, batch.column(x)[k].as_py())) for x in ("i", "f", "r")]
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(_sums(body), slice(0, m), length).view(np.int64)), *own, pa.array(batch.column("s")[k].as_py() + np.arange(m))], ["w", "i", "f", "r", "p"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(f, r, start, end): bytes of repeated windows of texts (i, f, r, text), spans may overlap."""
    found = stored(texts.select("i", "f", "r", "text").mapInArrow(partial(_chunk, length=length), _CHUNKS), "repeat-chunks")
    anchors = found.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("m").alias("m0"), F.max("m").alias("m1"), F.bool_or("twice").alias("any_twice"))
    anchors = anchors.where("n > 1 OR any_twice").select("a", F.expr("c0 <> c1 OR m0 <> m1").alias("several"), "any_twice")
    anchors = stored(anchors, "repeat-anchors")
    shared = stored(maybe_in(found, "a", anchors.select("a")).join(anchors, "a"), "repeat-shared")
    place = F.struct("i", "f", "r", "s")
    classes = shared.groupBy("a", "c", "m").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("several").alias("several"), F.first("any_twice").alias("any_twice"))
    classes = stored(classes, "repeat-classes")

    # classes of two or more: all windows are repeated
    several = classes.where("n > 1").select("a", "c", "m", "first")
    whole = shared.select("a", "c", "m", "i", "f", "r", "s").join(several, ["a", "c", "m"])
    if keep_first:
        whole = whole.where(place != F.col("first"))
    whole = whole.select("f", "r", F.col("s").alias("start"), (F.col("s") + F.col("m") + F.lit(length - 1)).alias("end"))

    # anchors with open windows: those of a class of one beside other classes, or of a chunk that may repeat itself
    open_ = (F.col("n") == 1) & F.col("several") | F.col("any_twice") if not keep_first else F.col("several") | F.col("any_twice")
    wanted = classes.groupBy("a").agg(F.count("*").alias("classes"), F.bool_or(open_).alias("open")).where("open").select("a", (F.col("classes") > CROWD).alias("crowd"))
    wanted = classes.join(wanted, "a").select("a", "crowd", "m", "first.*")
    by_text = stored(wanted.groupBy("f", "r").agg(F.collect_list(F.struct("a", "crowd", "m", "i", "s")).alias("parts")), "repeat-wanted")
    key = lambda: F.concat_ws(" ", "f", "r")
    bodies = maybe_in(texts.withColumn("_key", key()), "_key", by_text.select(key())).select("f", "r", F.col("text").cast("binary").alias("body"))
    parts = bodies.join(by_text, ["f", "r"]).select("f", "r", "body", F.explode("parts").alias("p"))
    parts = parts.select("p.a", "p.crowd", "p.i", "f", "r", "p.s", "p.m", F.expr(f"substring(body, CAST(p.s AS INT) + 1, p.m + {length - 1})").alias("bytes"))
    parts = stored(parts, "repeat-parts")
    dealt = parts.where("NOT crowd").drop("crowd").repartition("a").sortWithinPartitions("a", "i", "f", "r", "s")
    sorted_ = dealt.mapInArrow(partial(_factor, length=length, keep_first=keep_first), _SPANS)

    single = parts.where("crowd").mapInArrow(partial(_windows, length=length), "w long, i long, f long, r long, p long")
    counts = single.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("i", "f", "r", "p")).alias("first")).where("n > 1")
    crowded = single.join(counts, "w")
    if keep_first:
        crowded = crowded.where(F.struct("i", "f", "r", "p") != F.col("first"))
    crowded = crowded.select("f", "r", F.col("p").alias("start"), (F.col("p") + length).alias("end"))
    return whole.unionByName(sorted_).unionByName(crowded)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans as maximal ones, with the bytes that they cover."""
    for batch in batches:
        starts, ends, removed = [], [], []
        for spans in batch.column("spans"):
            flat = spans.values
            a, b = flat.field("start").to_numpy(), np.maximum.accumulate(flat.field("end").to_numpy())
            new = np.concatenate([[True], a[1:] > b[:-1]])
            starts.append(a[new])
            ends.append(b[np.append(new[1:], True)])
            removed.append(int((ends[-1] - starts[-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("r"), pa.array(removed, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["f", "r", "n_removed", "starts", "ends"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text."""
    for batch in batches:
        for k in range(batch.num_rows):
            body, at, kept = batch.column("body")[k].as_py(), 0, []
            for start, end in zip(batch.column("starts")[k].as_py() or (), batch.column("ends")[k].as_py() or (), strict=True):
                kept.append(body[at:start])
                at = end
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), pa.array([b"".join([*kept, body[at:]])], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, plain: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs (doc_id, text): the bytes that stay when those
    of repeated windows go; n_spans counts the maximal runs removed. ``plain``: docs is a mere read of Parquet files."""
    own = located(columns(docs, doc_id="doc_id", text="text"), plain)
    texts = own.select(F.col("c0").cast("long").alias("doc_id"), F.coalesce("c1", F.lit("")).alias("text"), F.xxhash64("_file").alias("f"), F.col("_row").alias("r"))
    texts = texts.withColumn("i", F.coalesce("doc_id", F.lit(_LAST)))
    spans = stored(repeated_spans(texts, length, keep_first), "repeat-spans")
    listed = spans.groupBy("f", "r").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    merged = stored(listed.mapInArrow(_merge, "f long, r long, n_removed long, starts array<long>, ends array<long>"), "repeat-merged")

    key = lambda: F.concat_ws(" ", "f", "r")
    size = F.octet_length("text").cast("long")
    marked = _marked(texts.withColumn("_key", key()), F.col("_key"), merged.select(key()), FILTER_BITS)
    none = F.lit(0).cast("long")
    clean = marked.where("NOT _hit").select("doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    sizes = marked.where("_hit").select("doc_id", "f", "r", size.alias("n_bytes"))
    hit = stored(sizes.join(merged, ["f", "r"], "left").withColumn("n_removed", F.coalesce("n_removed", none)).withColumn("n_spans", F.coalesce(F.size("starts").cast("long"), none)), "repeat-hit")
    gone = hit.where("n_removed = n_bytes AND n_spans > 0").select("doc_id", "n_bytes", "n_removed", "n_spans", F.lit(b"").alias("kept"))
    rest = hit.where("NOT (n_removed = n_bytes AND n_spans > 0)")
    bodies = maybe_in(texts.withColumn("_key", key()), "_key", rest.select(key())).select("f", "r", F.col("text").cast("binary").alias("body"))
    cut = bodies.join(rest, ["f", "r"]).select("doc_id", "n_bytes", "n_removed", F.when(F.col("starts").isNull(), 0).otherwise(F.col("n_spans")).alias("n_spans"), "starts", "ends", "body")
    cut = cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return clean.unionByName(gone).unionByName(cut)
