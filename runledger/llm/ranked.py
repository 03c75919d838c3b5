"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

The documents are dealt as Spark reads them; every task turns its own texts into shards of an inverted index
(a list of documents and contributions for each term of the queries, ascending) and ranks them there, so that no
posting is shuffled. A first pass counts what all documents have in common: how many hold a term, how many there
are, and their length. In the second, for every shard and query:

1. Term at a time: the short lists are summed into accumulators, ascending by document.
2. Document at a time: the accumulators are one more list with a bound, its largest sum, beside the long lists
   with theirs. In blocks of documents, the lists whose bounds together stay below the lowest score that still
   counts are not walked: documents come from the other lists, and are looked up there only while their score so
   far and the bounds left can reach that score.

A task hands on at most ``k`` documents an item; a window over these, limited before its shuffle too, gives the
ranks. Items are taken in blocks of bounded size (``BLOCK_ITEMS`` items, ``BLOCK_BYTES`` bytes of text), so what
tasks get of the queries doesn't grow with their number; each block passes over all documents.

Defined results: terms are maximal runs of 0-9, A-Z, a-z and characters beyond ASCII, with A-Z in lower case, and
compared by 64-bit hashes; a null or empty text has none; documents without a term count in no statistic; a null
id is ranked after all others of an equal score; repeated rows, of documents or items, are documents and items of
their own; an item without terms, or an empty table on either side, gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import columns, new_path

BLOCK_ITEMS, BLOCK_BYTES = 2000, 4_000_000
#: A shard holds about so many documents and postings at most (one document at least); blocks of documents within it.
SHARD_DOCS, SHARD_POSTINGS, STRETCH = 8192, 2_000_000, 2048
#: A list is short if it holds at most so large a share of a shard's documents.
SHORT = 1 / 32

_TERM = np.zeros(256, dtype=bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_FOUND = "item long, doc_id long, score long"


def _term_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, hash of each term, its row less the first) in slices of bounded bytes."""
    body, offsets = textvec.buffers(column)
    for at, to in textvec.slices(offsets):
        part, ends = body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, past = textvec.runs(part, ends, _TERM)
        yield at, to, textvec.span_hashes(part, starts, past), np.searchsorted(ends, starts, "right") - 1


def _postings(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, terms with repeats of each row; row, term and occurrences of each posting) of the slices; terms sorted."""
    for batch in batches:
        for at, to, hashes, row in _term_hashes(batch.column("text")):
            place = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
            wanted = terms[place] == hashes if len(terms) else np.zeros(len(hashes), bool)
            key, tf = np.unique(row[wanted] * max(len(terms), 1) + place[wanted], return_counts=True)
            yield batch.column("doc_id").slice(at, to - at), np.bincount(row, minlength=to - at), key // max(len(terms), 1), key % max(len(terms), 1), tf


def _statistics(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term (by its place), and at -1 and -2 the documents with a term and all their terms."""
    held, docs, total = np.zeros(len(terms), np.int64), 0, 0
    for _, n, _, term, _ in _postings(batches, terms):
        held += np.bincount(term, minlength=len(terms))
        docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    there = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], there]).astype(np.int64)), pa.array(np.concatenate([[docs, total], held[there]]).astype(np.int64))], ["term", "n"])


class _Top:
    """The ``k`` best documents so far of an item, and the lowest score that still counts."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.nulls, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), 1

    def take(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.nulls, nulls])
        best = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[best], ids[best], nulls[best]
        if len(best) == self.k:
            self.least = max(1, int(self.scores[-1]))  # an equal score may still win by its id


def _lookup(docs: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted documents in a list, 0 where it doesn't hold them."""
    place = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[place] == wanted, values[place], 0)


class _Shard:
    """An inverted index over some documents: for each term its documents, ascending, and their contributions."""

    def __init__(self, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, docs: int, total: int) -> None:
        self.nulls = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((doc, term))
        term, self.docs = term[order], doc[order]
        m = 50 + 50 * n * docs // max(total, 1)
        self.scores = weights[term] * (1_000_000_000 * tf[order] // (1000 * tf[order] + 20 * m[self.docs]))
        self.ends = np.searchsorted(term, np.arange(len(weights) + 1))
        self.short = max(1, int(len(n) * SHORT))

    def lists(self, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """The lists of a query with their bounds, lowest bound first: the long ones, and one of the short ones' sums."""
        out, docs, scores = [], [], []
        for a, b in zip(self.ends[query], self.ends[query + 1], strict=True):
            if b - a > self.short:
                out.append((self.docs[a:b], self.scores[a:b], int(self.scores[a:b].max())))
            elif b > a:
                docs.append(self.docs[a:b])
                scores.append(self.scores[a:b])
        if docs:
            order = np.argsort(flat := np.concatenate(docs), kind="stable")
            flat, values = flat[order], np.concatenate(scores)[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            sums = np.add.reduceat(values, first)
            out.append((flat[first], sums, int(sums.max())))
        return sorted((x for x in out if x[2] > 0), key=lambda x: x[2])

    def rank(self, query: np.ndarray, top: _Top) -> None:
        lists = self.lists(query)
        reach = np.cumsum([x[2] for x in lists])  # the most that a document gets from the lists up to here
        if not lists or reach[-1] < top.least:
            return
        cuts = np.arange(0, len(self.ids) + STRETCH, STRETCH)
        parts = [np.searchsorted(x[0], cuts) for x in lists]
        for j in range(len(cuts) - 1):
            skipped = int(np.searchsorted(reach, top.least))  # their bounds together stay below what counts
            if skipped == len(lists):
                return
            own = [(d[p[j] : p[j + 1]], s[p[j] : p[j + 1]]) for (d, s, _), p in zip(lists, parts, strict=True)]
            docs = np.unique(np.concatenate([d for d, _ in own[skipped:]]))
            if not len(docs):
                continue
            scores = np.zeros(len(docs), np.int64)
            for d, s in own[skipped:]:
                scores[np.searchsorted(docs, d)] += s
            for i in range(skipped - 1, -1, -1):
                alive = scores + reach[i] >= top.least
                docs, scores = docs[alive], scores[alive]
                if len(docs) and len(own[i][0]):
                    scores = scores + _lookup(*own[i], docs)
            good = scores >= top.least
            if good.any():
                top.take(scores[good], self.ids[docs[good]], self.nulls[docs[good]])


def _search(batches: Iterator[pa.RecordBatch], terms: np.ndarray, weights: np.ndarray, queries: list[np.ndarray], docs: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    tops, held, rows = [_Top(k) for _ in queries], [], 0

    def ranked() -> None:
        first = np.cumsum([0, *(len(x[1]) for x in held)])
        joined = [np.concatenate([x[i] + first[j] if i == 2 else x[i] for j, x in enumerate(held)]) for i in (1, 2, 3, 4)]
        shard = _Shard(pa.concat_arrays([x[0] for x in held]), *joined, weights, docs, total)
        for query, top in zip(queries, tops, strict=True):
            shard.rank(query, top)

    for found in _postings(batches, terms):
        held.append(found)
        rows += len(found[1])
        if rows >= SHARD_DOCS or sum(len(x[2]) for x in held) >= SHARD_POSTINGS:
            ranked()
            held, rows = [], 0
    if held:
        ranked()
    for item, top in enumerate(tops):
        if len(top.ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), item)), pa.array(top.ids, mask=top.nulls), pa.array(top.scores)], ["item", "doc_id", "score"])


def _item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items (id, text), in blocks of bounded size."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"] or ""))
        size += len(block[-1][1].encode())
        if len(block) >= most or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of docs (doc_id, text) with the highest score above 0 for
    every row of items (item_id, text), equal scores by ascending doc_id."""
    spark = docs.sparkSession
    texts = columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = columns(items, item_id="item_id", text="text").withColumn("item_id", F.col("item_id").cast("long"))
    path = new_path(spark, "ranked")
    spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").write.parquet(path)
    for block in _item_blocks(asked, block_items):
        own: list[np.ndarray] = []
        for at, to, hashes, row in _term_hashes(pa.array([text for _, text in block], pa.string())):
            own += [np.unique(hashes[row == i]) for i in range(to - at)]
        terms = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        counts = texts.mapInArrow(partial(_statistics, terms=terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        held = {r["term"]: r["n"] for r in counts}
        n = held.get(-1, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        queries = [np.searchsorted(terms, x) for x in own]
        found = texts.mapInArrow(partial(_search, terms=terms, weights=weights, queries=queries, docs=n, total=held.get(-2, 0), k=k), _FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
        best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("item_id long, rank int, doc_id long, score long").parquet(path)
