"""Cross-entropy difference: bits a word that a target model saves over a background model.

Two bigram models, one counted on target texts and one on all texts, share one vocabulary: every word of
all texts. Both are smoothed alike, p(w | v) = (n(v, w) + K p(w)) / (n(v) + K) and
p(w) = (n(w) + 1) / (N + V + 1); at the start of a text p(w) counts alone. Every word and every bigram
counts, those that occur once too, at every size.

The counts are no table that tasks hold. A text's word w adds log2 p(w), where a word follows it
log2(K / (n(w) + K)), and after a word v log2(1 + n(v, w) / (K p(w))). Words and bigrams are dealt out by
their hash with the row they are from, so that the task which counts one knows its rows and sends them
their share. Only what is frequent, and would be hot there, is counted beforehand and scored where the
text is: the ``VOCABULARY`` most frequent words, and at most ``BIGRAMS`` bigrams of these that a sample of
about ``SAMPLE`` texts has ``HOT`` times. Which ones these are changes the work and not the result. The
target ids are sent to tasks too, 8 bytes each.

A document's score is its mean over words of log2 p_target - log2 p_background: the higher, the more it
is like the target. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, compared as 64-bit hashes.
Defined results: a null text or one without words has 0 words and null scores; without target texts the
target model is uniform over the vocabulary; repeated rows are counted and scored each; target ids are a
set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import columns, stored

VOCABULARY = 50_000
BIGRAMS = 1_000_000
SAMPLE, HOT = 10_000, 20
K = 5.0
_SHIFT = 1 << 20  # above any place in the vocabulary: a bigram (v, w) of it has the code (v + 1) * _SHIFT + w
_FLUSH = 2_000_000
_GROUPED = 500_000
#: Kinds of records: a bigram of the vocabulary, a word of it after another one, another word, and a row itself.
_KNOWN, _AFTER_OTHER, _OTHER, _ROW = range(4)
_RECORD = "a long, b long, kind int, row long, c long, inner long, target double, background double"
_SHARE = "row long, doc_id long, n long, target double, background double"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        body, offsets = textvec.buffers(batch.column("text"))
        for at, to in textvec.slices(offsets):
            words, counts = textvec.word_hashes(body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            yield batch, at, to, words, counts


def _in_target(batch: pa.RecordBatch, at: int, to: int, targets: np.ndarray) -> np.ndarray:
    """Which rows at:to have an id in the sorted targets."""
    ids = batch.column("doc_id").slice(at, to - at)
    if not len(targets):
        return np.zeros(to - at, bool)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return (targets[np.minimum(np.searchsorted(targets, own), len(targets) - 1)] == own) & ids.is_valid().to_numpy(zero_copy_only=False)


def _count_words(batches: Iterator[pa.RecordBatch], targets) -> Iterator[pa.RecordBatch]:
    """(code, n, target): how often words occur in all and in target texts, combined over about ``_FLUSH`` words."""
    every: list[np.ndarray] = []
    inside: list[np.ndarray] = []

    def flushed() -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(every), return_counts=True)
        own, m = np.unique(np.concatenate(inside), return_counts=True)
        target = np.zeros(len(codes), np.int64)
        target[np.searchsorted(codes, own)] = m
        every.clear()
        inside.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(target)], ["code", "n", "target"])

    size = 0
    for batch, at, to, words, counts in _words(batches):
        every.append(words)
        inside.append(words[np.repeat(_in_target(batch, at, to, targets.value), np.diff(counts))])
        size += len(words)
        if size >= _FLUSH:
            yield flushed()
            size = 0
    if every:
        yield flushed()


def _ids(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary; its length for other words."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[place] == words, place, len(vocabulary))


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are the first and which the last of their text."""
    first, last = np.zeros(counts[-1], bool), np.zeros(counts[-1], bool)
    full = counts[1:] > counts[:-1]
    first[counts[:-1][full]] = True
    last[counts[1:][full] - 1] = True
    return first, last


def _pairs(ids: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the second word, code) of each pair of words of the vocabulary within a text."""
    second = ~first & (ids < size)
    second[1:] &= ids[:-1] < size
    place = np.flatnonzero(second)
    return place, (ids[place - 1] + 1) * _SHIFT + ids[place]


def _find(codes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each code is among the sorted ones, its place there)."""
    if not len(among):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    place = np.minimum(np.searchsorted(among, codes), len(among) - 1)
    return among[place] == codes, place


def _sampled_pairs(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value
    for _, _, _, words, counts in _words(batches):
        codes, n = np.unique(_pairs(_ids(words, known), _ends(counts)[0], len(known))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])


def _count_pairs(batches: Iterator[pa.RecordBatch], vocabulary, wanted, targets) -> Iterator[pa.RecordBatch]:
    """(code, n, target) of the wanted bigrams, once a task."""
    known, codes = vocabulary.value, wanted.value
    n, target = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for batch, at, to, words, counts in _words(batches):
        place, pairs = _pairs(_ids(words, known), _ends(counts)[0], len(known))
        hit, found = _find(pairs, codes)
        inside = np.repeat(_in_target(batch, at, to, targets.value), np.diff(counts))[place[hit]]
        n += np.bincount(found[hit], minlength=len(codes))
        target += np.bincount(found[hit][inside], minlength=len(codes))
    some = n > 0
    yield pa.RecordBatch.from_arrays([pa.array(codes[some]), pa.array(n[some]), pa.array(target[some])], ["code", "n", "target"])


class Models:
    """What is frequent under both models, with the totals; the rest is counted while scoring. Model 0 is the target."""

    def __init__(self, targets: np.ndarray, vocabulary: np.ndarray, words: np.ndarray, totals: np.ndarray, size: int, codes: np.ndarray, pairs: np.ndarray) -> None:
        """words, pairs: counts (word or bigram, model); totals: words of both models; size: the distinct words of all texts."""
        self.targets, self.vocabulary, self.all = targets, vocabulary, totals + size + 1
        self.chance = (words + 1) / self.all
        self.word = np.log2(self.chance)
        self.backoff = np.log2(K / (words + K))
        order = np.argsort(codes)
        self.codes = codes[order]
        self.pair = np.log2(1 + pairs[order] / (K * self.chance[self.codes % _SHIFT]))


def fit(docs: DataFrame, target_ids: DataFrame) -> Models:
    """Models from docs (doc_id, text), the target being the rows whose doc_id is in target_ids (doc_id)."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().toArrow()
    targets = np.sort(ids.column("doc_id").to_numpy().astype(np.int64))
    inside = context.broadcast(targets)

    by_word = stored(texts.mapInArrow(partial(_count_words, targets=inside), "code long, n long, target long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("target").alias("target")), "lm-words")
    size, *totals = by_word.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = by_word.orderBy(F.desc("n"), "code").limit(VOCABULARY).toArrow()
    hashes = top.column("code").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary, words = hashes[order], np.stack([top.column(c).to_numpy()[order] for c in ("target", "n")], axis=1).astype(float)
    shared = context.broadcast(vocabulary)  # at most VOCABULARY hashes

    sample = texts.sample(min(1.0, SAMPLE / max(1, texts.count())), 7)
    hot = sample.mapInArrow(partial(_sampled_pairs, vocabulary=shared), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "code").limit(BIGRAMS).toArrow()
    wanted = context.broadcast(np.sort(hot.column("code").to_numpy().astype(np.int64)))  # at most BIGRAMS, and as many as a sample has HOT times
    counted = partial(_count_pairs, vocabulary=shared, wanted=wanted, targets=inside)
    pairs = texts.mapInArrow(counted, "code long, n long, target long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).toArrow()
    return Models(targets, vocabulary, words, np.array(totals, float), size, pairs.column("code").to_numpy().astype(np.int64), np.stack([pairs.column(c).to_numpy() for c in ("target", "n")], axis=1).astype(float))


def _records(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Each row with its words' bits as far as the models hold them, and one record for each other word or bigram of it.

    a and b say what is counted, c how often the row has it, inner how often another word follows; the
    last bit of row is set in the target.
    """
    held: Models = models.value
    size, seen = len(held.vocabulary), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    names = [c.split()[0] for c in _RECORD.split(", ")]
    for batch, at, to, words, counts in _words(batches):
        n = np.diff(counts)
        rows = (seen + np.arange(to - at)) * 2 + _in_target(batch, at, to, held.targets)
        seen += to - at
        ids, (first, last) = _ids(words, held.vocabulary), _ends(counts)
        known, of = ids < size, np.repeat(np.arange(to - at), n)
        bits = np.zeros((len(words), 2))
        bits[known] = held.word[ids[known]]
        bits[known & ~last] += held.backoff[ids[known & ~last]]
        place, codes = _pairs(ids, first, size)
        hit, found = _find(codes, held.codes)
        bits[place[hit]] += held.pair[found[hit]]

        a, b, kind = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64), np.full(len(words), -1)
        a[place[~hit]], kind[place[~hit]] = codes[~hit].astype(np.uint64), _KNOWN
        before = np.zeros(len(words), np.uint64)  # the word before: its place in the vocabulary plus one, or its hash
        before[1:] = np.where(known[:-1], (ids[:-1] + 1).astype(np.uint64), words[:-1])
        before[first] = 0
        after = np.zeros(len(words), bool)
        after[1:] = known[1:] & ~known[:-1] & ~first[1:]
        a[after], b[after], kind[after] = before[after], (ids[after] + 1).astype(np.uint64), _AFTER_OTHER
        a[~known], b[~known], kind[~known] = words[~known], before[~known], _OTHER

        some = np.flatnonzero(kind >= 0)
        key = textvec.mix(textvec.mix(textvec.mix(a[some]) + b[some]) + (of[some] * 4 + kind[some]).astype(np.uint64))
        order = some[np.argsort(key)]
        key = np.sort(key)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        one = order[starts]
        c = np.diff(np.append(starts, len(key)))
        inner = np.add.reduceat((~last[order]).astype(np.int64), starts) if len(key) else c
        none = pa.nulls(len(one), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(a[one].view(np.int64)), pa.array(b[one].view(np.int64)), pa.array(kind[one].astype(np.int32)), pa.array(rows[of[one]]), pa.array(c), pa.array(inner), none, none], names)
        sums = [pa.array(np.bincount(of, bits[:, i], to - at)) for i in (0, 1)]
        key = textvec.mix(rows.astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").slice(at, to - at), pa.array(np.full(to - at, _ROW, np.int32)), pa.array(rows), pa.array(n), pa.array(np.zeros(to - at, np.int64)), *sums], names)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Whether each place is the first of its keys, which are sorted."""
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def _shares(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    """Rows' bits from records sorted by (a, kind, b), each group whole."""
    held: Models = models.value
    names = [c.split()[0] for c in _SHARE.split(", ")]

    def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = table.filter(pa.compute.equal(table.column("kind"), _ROW)).combine_chunks()
        for part in own.select(["row", "b", "c", "target", "background"]).rename_columns(names).to_batches():
            yield part
        table = table.filter(pa.compute.not_equal(table.column("kind"), _ROW))
        if not table.num_rows:
            return
        a, b, kind, row, c, inner = (table.column(x).to_numpy() for x in ("a", "b", "kind", "row", "c", "inner"))
        both = np.stack([c * (row & 1), c], axis=1)
        wide, narrow = _changes(a, kind), _changes(a, kind, b)
        of_word, of_pair = (np.add.reduceat(both, np.flatnonzero(x))[np.cumsum(x) - 1] for x in (wide, narrow))
        other = kind == _OTHER
        chance = (of_word + 1) / held.all
        for which, word in ((kind == _KNOWN, a % _SHIFT), (kind == _AFTER_OTHER, b - 1)):
            chance[which] = held.chance[word[which]]
        bits = c[:, None] * np.log2(1 + of_pair / (K * chance))
        bits[other & (b == 0)] = 0
        bits[other] += c[other, None] * np.log2(chance[other]) + inner[other, None] * np.log2(K / (of_word[other] + K))
        none = pa.nulls(len(row), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(row), none, none, pa.array(bits[:, 0]), pa.array(bits[:, 1])], names)

    parts: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        parts.append(batch)
        size += batch.num_rows
        if size >= _GROUPED:
            table = pa.Table.from_batches(parts).combine_chunks()
            cut = int(np.flatnonzero(_changes(table.column("a").to_numpy(), table.column("kind").to_numpy()))[-1])  # the last group may go on
            yield from worked(table.slice(0, cut))
            parts = table.slice(cut).to_batches()
            size = 0
    if parts:
        yield from worked(pa.Table.from_batches(parts).combine_chunks())


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_bits, background_bits, score) for every row of docs (doc_id, text)."""
    own = columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(own, target_ids))  # at most VOCABULARY words and BIGRAMS bigrams, and the target ids
    dealt = own.mapInArrow(partial(_records, models=shared), _RECORD).repartition("a").sortWithinPartitions("a", "kind", "b")
    rows = dealt.mapInArrow(partial(_shares, models=shared), _SHARE).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n_words"), F.sum("target").alias("t"), F.sum("background").alias("b"))
    mean = lambda x: F.when(F.col("n_words") > 0, x / F.col("n_words"))
    return rows.select("doc_id", "n_words", mean(-F.col("t")).alias("target_bits"), mean(-F.col("b")).alias("background_bits"), mean(F.col("t") - F.col("b")).alias("score"))
