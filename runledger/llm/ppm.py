"""Language identification by prediction by partial matching.

Every language has a byte context tree of orders 0 to 3, counted on labelled texts. The chance of a byte
after a context c with n occurrences of d different bytes is count / (n + d) if c has seen it; else the
escape d / (n + d) times the chance after the next shorter context, in which what c has seen is excluded;
below order 0 all bytes are alike. The statistics are frozen: a text's code length under a language is
the sum of -log2 over all its bytes, and the shortest code wins.

The trees are fitted on a bounded sample, about ``SAMPLE`` texts a language chosen by hash, and hold every
context that these have. They are kept sparse: windows of four bytes that any language has seen are found
in one hash table with their cost under all languages; for any other window the shorter contexts are
searched, so that code lengths are those of the definition. Long texts are worked on in blocks.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties take the first
language in order; without any labelled text every text is ``und``; rows with a null language are not
learned from; repeated rows are learned and scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import columns, in_batches

SAMPLE = 1000
ORDER = 3
LETTER = r"\p{L}"
_BLOCK = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _windows(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte its code: the byte and up to three before it in the same text, each plus one, in base 257; 0 is the text's start."""
    code = body.astype(np.int64) + 1
    out = code.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros_like(code)
        before[back:] = code[:-back]
        for k in range(back):  # bytes nearer to the text's start than ``back`` have none there
            places = offsets[:-1] + k
            before[places[places < offsets[1:]]] = 0
        out += before * 257**back
    return out


def _blocks(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, codes, where each row's codes end) in blocks; a long text comes in several."""
    for at, to in textvec.slices(offsets, _BLOCK):
        own, ends = body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if len(own) <= _BLOCK:
            yield at, to, _windows(own, ends), ends
            continue
        for start in range(0, len(own), _BLOCK):
            lead = min(start, ORDER)
            part = own[start - lead : start + _BLOCK]
            codes = _windows(part, np.array([0, len(part)]))[lead:]
            yield at, to, codes, np.array([0, len(codes)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            part = batch.filter(pa.array(langs == lang))
            for _, _, codes, _ in _blocks(*textvec.buffers(part.column("text"))):
                found, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "code", "n"])


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of each of the values."""
    found, place = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(place, v, len(found)) for v in values)


def _find(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is among the sorted ones, its place there)."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[place] == keys, place


class _Language:
    """One language's tree: for each order its windows with their bits, and its contexts with the bits of an escape."""

    def __init__(self, code: np.ndarray, n: np.ndarray, symbols: int) -> None:
        self.levels = []
        below: np.ndarray | None = None  # chances of the windows one order shorter
        for order in range(ORDER + 1):
            windows, count = _grouped(code % 257 ** (order + 1), n)
            contexts, total, kinds = _grouped(windows // 257, count, np.ones(len(windows)))
            of = np.searchsorted(contexts, windows // 257)
            chance = count / (total + kinds)[of]
            shorter = np.full(len(windows), 1 / symbols) if below is None else below[np.searchsorted(self.levels[-1][0], windows % 257**order)]
            left = 1 - np.bincount(of, shorter, len(contexts))  # what the shorter context leaves to bytes not seen in this one
            escape = kinds / (total + kinds) / np.maximum(left, 1e-12)
            self.levels.append((windows, -np.log2(chance), contexts, -np.log2(escape)))
            below = chance

    def bits(self, codes: np.ndarray, symbols: int) -> np.ndarray:
        """-log2 of the chance of each window's last byte."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            windows, bits, contexts, escape = self.levels[order]
            own = codes[open_] % 257 ** (order + 1)
            seen, place = _find(own, windows)
            out[open_[seen]] += bits[place[seen]]
            open_, own = open_[~seen], own[~seen]
            known, place = _find(own // 257, contexts)
            out[open_[known]] += escape[place[known]]
        out[open_] += np.log2(symbols)
        return out


class Trees:
    """The frozen trees of all languages, with a hash table of all windows of four bytes that any of them has seen."""

    def __init__(self, langs: list[str], codes: np.ndarray, n: np.ndarray) -> None:
        """Parallel: the language, code and count of each window."""
        self.langs = sorted(set(langs))
        digits = np.unique(np.concatenate([codes // 257**k % 257 for k in range(ORDER + 1)]))
        self.symbols = len(digits[digits > 0]) + 2  # the bytes seen, the text's start, and all other bytes as one
        own = np.searchsorted(np.array(self.langs, object), np.array(langs, object))
        self.trees = [_Language(codes[own == k], n[own == k], self.symbols) for k in range(len(self.langs))]
        self.codes = np.unique(codes)
        self.cost = np.stack([t.bits(self.codes, self.symbols) for t in self.trees], axis=1)
        self.shift = np.uint64(64 - max(8, 2 + int(len(self.codes)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left = np.arange(len(self.codes))
        slot = self._slot(self.codes)
        while len(left):  # each free slot takes the first of those that want it, the others go one further
            free = np.flatnonzero(self.slots[slot[left]] < 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            took = left[free[first]]
            self.slots[slot[took]] = took
            left = np.setdiff1d(left, took, assume_unique=True)
            slot[left] = (slot[left] + 1) % len(self.slots)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each window under every language."""
        slot = self._slot(codes)
        place = self.slots[slot]
        open_ = np.flatnonzero((place >= 0) & (self.codes[place] != codes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.slots)
            place[open_] = self.slots[slot[open_]]
            open_ = open_[(place[open_] >= 0) & (self.codes[place[open_]] != codes[open_])]
        out = self.cost[place]
        strange = np.flatnonzero(place < 0)
        if len(strange):
            found, back = np.unique(codes[strange], return_inverse=True)
            out[strange] = np.stack([t.bits(found, self.symbols) for t in self.trees], axis=1)[back]
        return out

    def bits(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text under every language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for at, to, codes, ends in _blocks(body, offsets):
            sums = np.zeros((len(codes) + 1, len(self.langs)))
            np.cumsum(self._costs(codes), axis=0, out=sums[1:])
            out[at:to] += sums[ends[1:]] - sums[ends[:-1]]
        return out


def hash_share(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 52)) / float(1 << 52)


def hash_sample(rows: DataFrame, key: str, by: str, sample: int) -> DataFrame:
    """(key, by): for each value of ``by`` about the ``sample`` keys with the smallest hash, and no more.

    The distinct keys of a value are counted first (within 2 %, by sketches), and only keys below a share of the hashes
    that holds about twice the sample are ranked: no task sees more than that of one value, however hot it is or its
    keys are.
    """
    counts = rows.groupBy(by).agg(F.approx_count_distinct(key, 0.02).alias("_n"))  # one row a label
    few = rows.select(key, by).join(F.broadcast(counts), by).where(hash_share(F.col(key)) < 2.0 * sample / F.col("_n")).select(key, by).distinct()
    ranked = few.withColumn("_rank", F.row_number().over(W.partitionBy(by).orderBy(hash_share(F.col(key)), key)))
    return ranked.where(F.col("_rank") <= sample).select(key, by)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from rows (key, text, lang): of each language those of the ``sample`` keys with the smallest hash."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND key IS NOT NULL")
    keys = hash_sample(usable, "key", "lang", sample)  # at most ``sample`` a language
    found = usable.join(F.broadcast(keys), ["key", "lang"], "left_semi").select("text", "lang")
    found = found.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    return Trees(found.column("lang").to_pylist(), found.column("code").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64))


def _predict(batches: Iterator[pa.RecordBatch], trees, with_text: bool) -> Iterator[pa.RecordBatch]:
    model, left_out = trees.value, ("lettered",) if with_text else ("text", "lettered")
    for batch in batches:
        bits = model.bits(*textvec.buffers(batch.column("text")))
        odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 500))
        wordless = ~np.array(batch.column("lettered").to_pylist(), bool)
        picked = np.where(wordless, "und", np.array(model.langs, object)[bits.argmin(axis=1)])
        score = np.where(wordless, 0.0, 1 / odds.sum(axis=1))
        names = [c for c in batch.schema.names if c not in left_out]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(picked.tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])


def identify(docs: DataFrame, trees: Trees | None, with_text: bool = False) -> DataFrame:
    """docs (text and any other columns), without its text if not asked for, with lang_pred and score, the odds of the winner."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    if trees is None:
        return (docs if with_text else docs.drop("text")).withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    lettered = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered")
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample's texts: their distinct windows of four bytes
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *["text string"] * with_text, "lang_pred string, score double"])
    return in_batches(docs.select(*(F.col(f"`{f.name}`") for f in others), "text", lettered), partial(_predict, trees=shared, with_text=with_text), schema)


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def held_out_prediction(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows with crc32(doc_id) mod folds other than held."""
    own = columns(docs, doc_id="doc_id", text="text", lang="lang").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)))
    trees = fit(own.where("NOT held_out AND doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify(own.select("doc_id", "held_out", "text"), trees)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs with a language: not ``und``, and the winner likelier than all others together."""
    trees = fit(columns(docs, key="doc_id", text="text", lang="lang"))
    own = {f"k{i}": c for i, c in enumerate(docs.columns) if c != "text"}
    marked = identify(columns(docs, **own, text="text"), trees, with_text=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    back = {c: k for k, c in own.items()}
    return marked.select(*(F.col("text") if c == "text" else F.col(back[c]).alias(c) for c in docs.columns))
