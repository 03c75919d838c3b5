"""Toxicity scores over deobfuscated text: a noisy-channel decoder and a lexicon of odds.

Texts hide words by leetspeak (``1d10t``), spacing (``i d i o t``) and repetition (``idiooot``). Spans that
look like that become lattices: every sign offers the letters it may stand for, separators may vanish or end
a word, runs may shrink to one or two letters; spans may have any length. Viterbi search over the lattice
under a character language model (order 4, learned here) restores the likeliest words. The score then
reads the plain words and the restored ones: every word and every prefix of 4 to 7 bytes is a feature, and those that toxic rows show
in most of their texts and far more often than chance (a likelihood-ratio test that allows for the number
of features tried) carry log odds. The odds are cut where the learned rows err least; texts with none get
the rate of such texts among the learned rows.

Learned on all labelled rows: all their character sequences and features count, summed by Spark; what reaches the
driver are sequences of at most four letters, the lexicon and the rows by distinct score. Defined results: a null or empty text scores like one without
features; labels other than 0 and 1, null ids and unlabelled rows teach nothing; without labelled rows
every score is 0; repeated rows are scored each, repeated labels count as toxic if one of them does; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import FILTER_BITS, _marked, columns, maybe_in, stored, without
from runledger.llm.ppm import remainder

PREFIXES = (4, 5, 6, 7)
CACHED = 100  # longer spans are decoded each time, so that a cache stays small

#: The letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
_SIGN = r"0-9@$!|+(*#€£"
_LETTER = r"a-zß-ÿ"
_GAP = r"[ ._\-]"
_SPANS = re.compile(
    rf"(?<![{_LETTER}{_SIGN}])(?:"
    rf"(?P<spaced>[{_LETTER}{_SIGN}](?:{_GAP}{{1,2}}[{_LETTER}{_SIGN}](?![{_LETTER}{_SIGN}])){{2,}})"
    rf"|(?P<leet>(?=[{_SIGN}]*[{_LETTER}])(?=[{_LETTER}]*[{_SIGN}])[{_LETTER}{_SIGN}]{{3,}})"
    rf"|(?P<run>(?=[{_LETTER}]*?([{_LETTER}])\4\4)[{_LETTER}]{{4,}})"
    rf")(?![{_LETTER}{_SIGN}])"
)


class CharModel:
    """Interpolated character model of order 4 over words; ``^`` opens and ``$`` closes a word."""

    def __init__(self, grams: dict[str, int]) -> None:
        self.counts: dict[str, int] = {}
        self.totals: dict[str, int] = {}
        self.known: dict[tuple[str, str], float] = {}
        for gram, n in grams.items():
            for k in range(len(gram)):
                context = gram[k:-1]
                self.counts[gram[k:]] = self.counts.get(gram[k:], 0) + n
                self.totals[context] = self.totals.get(context, 0) + n

    def cost(self, before: str, char: str) -> float:
        found = self.known.get((before, char))
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[before, char] = self._cost(before, char)
        return found

    def _cost(self, before: str, char: str) -> float:
        chance = 1 / 64
        for k in range(4):
            context = before[len(before) - k :]
            total = self.totals.get(context, 0)
            if len(context) < k or not total:
                break
            chance = (self.counts.get(context + char, 0) + 4 * chance) / (total + 4)
        return -float(np.log(chance))


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each place of a span the strings it may stand for, with the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    for run in re.finditer(rf"{_GAP}+|(.)\1*", span):
        char, n = run[1], len(run[0])
        if char is None:  # separators vanish or end a word
            out.append([("", 0.0), (" ", 0.0)])
            continue
        letters = [(c, 1.0) for c in LEET.get(char, "")] or [(char, 0.0)]
        for _ in range(n if n < 3 else 0):
            out.append(letters)
        if n >= 3:
            out.append([(c * k, cost + 0.5 * k) for c, cost in letters for k in (1, 2)])
    return out


def _spelt(path: tuple) -> str:
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def decode(span: str, model: CharModel) -> str:
    """The likeliest words of a span: exact Viterbi search over the lattice, states being the last three characters."""
    states: dict[str, tuple[float, tuple]] = {"^": (0.0, ())}  # paths are chains, so that a place costs the same in long spans
    for options in lattice(span):
        new: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in states.items():
            for text, extra in options:
                at, total = state, cost + extra
                for char in text:
                    total += model.cost(at, "$" if char == " " else char)
                    at = "^" if char == " " else (at + char)[-3:]
                if at not in new or total < new[at][0]:
                    new[at] = (total, (path, text))
        states = new
    ends = [(cost + model.cost(state, "$"), path) for state, (cost, path) in states.items()]
    least = min(ends, key=lambda e: e[0])[0]
    return min(_spelt(path) for cost, path in ends if cost == least)


def restored(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """The words restored from a text's suspicious spans, in order."""
    out = []
    for found in _SPANS.finditer(text.lower()):
        span = found[0]
        word = cache.get(span)
        if word is None:
            if len(cache) > 100_000:
                cache.clear()
            word = decode(span, model)
            if len(span) <= CACHED:
                cache[span] = word
        out.append(word)
    return " ".join(out)


_INSIDE = np.zeros(256, bool)
_INSIDE[97:123] = _INSIDE[65:91] = _INSIDE[128:] = True


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and prefix; a word is a run of a-z, A-Z and bytes from 128 on."""
    starts, ends = textvec.runs(body, offsets, _INSIDE)
    parts = [(starts, ends, 0)] + [(starts[ends - starts > n], starts[ends - starts > n] + n, n) for n in PREFIXES]
    starts, ends = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    kinds = np.repeat(np.array([p[2] for p in parts], np.uint64), [len(p[0]) for p in parts])
    return np.searchsorted(offsets, starts, "right") - 1, textvec.mix(textvec.span_hashes(body, starts, ends) + kinds)


def _with_restored(batch: pa.RecordBatch, model: CharModel, cache: dict[str, str]) -> pa.Array:
    texts = batch.column("text").to_pylist()
    return pa.array([f"{t} {restored(t, model, cache)}" if t else "" for t in texts], pa.string())


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for batch in batches:
        words = Counter(w for t in batch.column("text").to_pylist() for w in re.findall(rf"[{_LETTER}]+", (t or "").lower()))
        grams: Counter[str] = Counter()
        for word, n in words.items():
            word = f"^{word}$"
            for i in range(1, len(word)):
                grams[word[max(0, i - 3) : i + 1]] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])


def _feature_counts(batches: Iterator[pa.RecordBatch], model: CharModel, wanted=None) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label every feature is, or those that the shared bit set ``wanted`` may have."""
    cache: dict[str, str] = {}
    wanted = None if wanted is None else wanted.value
    for batch in batches:
        body, offsets = textvec.buffers(_with_restored(batch, model, cache))
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        for at, to in textvec.slices(offsets):
            row, found = features(body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            if wanted is not None:
                place = found & np.uint64(FILTER_BITS - 1)
                own = (wanted[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                row, found = row[own], found[own]
            pairs = np.unique(np.stack([found, row.astype(np.uint64)]), axis=1)
            kinds, place = np.unique(pairs[0], return_inverse=True)
            ones = np.bincount(place, toxic[at:to][pairs[1].astype(np.int64)], len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(place, minlength=len(kinds)) - ones), pa.array(ones)], ["feature", "n0", "n1"])


class Scorer:
    """Frozen: the character model, the lexicon (sorted hashes with log odds) and the log odds of texts without features."""

    def __init__(self, model: CharModel, hashes: np.ndarray, odds: np.ndarray, without: float) -> None:
        self.model, self.without, self.cut = model, without, 0.0
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, found = features(body, offsets)
        some = self.maybe[(found >> np.uint64(48)).astype(np.int64)]
        row, found = row[some], found[some]
        best, more = np.full(len(offsets) - 1, self.without), np.zeros(len(offsets) - 1)
        if len(self.hashes) and len(found):
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            hit = self.hashes[place] == found
            np.maximum.at(best, row[hit], self.odds[place[hit]])
            np.add.at(more, row[hit], 0.01)
        odds = np.where(best > self.without, best + np.minimum(more, 0.2), best)
        return 1 / (1 + np.exp(-(odds - self.cut)))


def _bits(counts: DataFrame) -> np.ndarray:
    """A bit set of the features of counts: 8 MB, whatever their number."""
    place = F.pmod("feature", F.lit(FILTER_BITS)) + 1
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    sets = counts.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("set"))
    for r in sets.toArrow().to_pylist():
        part = np.frombuffer(r["set"], np.uint8)
        out[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return out


def learnable(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(text, toxic) of the rows of docs (doc_id, text) whose id is in marked (doc_id, toxic; one row an id).

    Of the texts only those are shuffled that a bit set takes for toxic or for wrongly let through by the one before.
    """
    maybe = maybe_in(docs.where("text IS NOT NULL"), "doc_id", marked.select("doc_id"))
    wrong = maybe.select("doc_id").join(marked, "doc_id", "left_anti").distinct()
    own = _marked(without(maybe, ["doc_id"], wrong), F.col("doc_id"), marked.where("toxic = 1").select("doc_id"), FILTER_BITS)
    checked = own.where("_hit").join(marked, "doc_id").select("text", "toxic")
    return own.where("NOT _hit").select("text", F.lit(0).cast("long").alias("toxic")).unionByName(checked)


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic)."""
    marked = columns(labels, doc_id="doc_id", toxic="toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    learned = stored(learnable(docs, stored(marked, "toxic-marked")), "toxic-learned")  # read five times
    grams = learned.mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    if not grams.num_rows:
        return None
    model = CharModel(dict(zip(grams.column("gram").to_pylist(), grams.column("n").to_pylist(), strict=True)))
    totals = learned.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    base = (n1 + 0.5) / (n0 + n1 + 1)
    counted = lambda rows, wanted=None: rows.mapInArrow(partial(_feature_counts, model=model, wanted=wanted), "feature long, n0 long, n1 long")
    # features of toxic rows first; other rows count only those that would pass the test if no other row had them
    ones = stored(counted(learned.where("toxic = 1")).groupBy("feature").agg(F.sum("n1").alias("n1")), "toxic-features")
    tried = ones.count()
    least = float(np.log(max(tried, 1)) + 1)
    able = ones.where(F.col("n1") * -float(np.log(base)) > least * (1 - 1e-9))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(able))
    zeros = counted(learned.where("toxic = 0"), shared).groupBy("feature").agg(F.sum("n0").alias("n0"))
    counts = able.join(zeros, "feature", "left").select("feature", F.coalesce("n0", F.lit(0)).alias("n0"), "n1")
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    gain = F.col("n1") * F.log(share / base) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    kept = counts.where(share > max(base, 0.5)).where(gain > least).orderBy("feature").toArrow()
    n0, n1, hashes = (kept.column(c).to_numpy() for c in ("n0", "n1", "feature"))
    scorer = Scorer(model, hashes.astype(np.int64).view(np.uint64), np.log((n1 + base) / (n0 + 1 - base)), -9.0)
    # on the learned rows: the rate of toxic rows among those without features, and the cut; a score is one of a few a feature
    scored = learned.select(F.lit(None).cast("long").alias("doc_id"), "toxic", "text").mapInArrow(partial(_score, scorer=_Held(scorer)), "doc_id long, toxic long, score double")
    rows = scored.groupBy("score").agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1")).orderBy("score").toArrow()
    chance, n0, n1 = np.clip(rows.column("score").to_numpy(), 1e-9, 1 - 1e-9), rows.column("n0").to_numpy(), rows.column("n1").to_numpy()
    found = np.log(chance / (1 - chance))
    plain = found < -8.9
    scorer.cut = best_cut(found[~plain], n0[~plain], n1[~plain])
    scorer.without = float(np.log((n1[plain].sum() + 0.1) / (n0[plain].sum() + 1))) + scorer.cut
    return scorer


def best_cut(odds: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """The odds from which on calling rows toxic errs least, given how many rows of each label have them; of equally good
    cuts the middle one."""
    if not len(odds):
        return 0.0
    order = np.argsort(odds, kind="stable")
    odds, n0, n1 = odds[order], n0[order], n1[order]
    edges = np.concatenate([[odds[0] - 1], (odds[1:] + odds[:-1]) / 2, [odds[-1] + 1]])
    errors = np.concatenate([[0], np.cumsum(n1)]) + np.concatenate([[0], np.cumsum(n0[::-1])])[::-1]
    errors = np.where(np.concatenate([[True], odds[1:] > odds[:-1], [True]]), errors, n0.sum() + n1.sum() + 1)
    good = edges[errors == errors.min()]
    return float(good[len(good) // 2])


class _Held:
    """A model passed with the task itself, read like a broadcast."""

    def __init__(self, value: Scorer) -> None:
        self.value = value


def _score(batches: Iterator[pa.RecordBatch], scorer) -> Iterator[pa.RecordBatch]:
    held, cache = scorer.value, {}
    for batch in batches:
        body, offsets = textvec.buffers(_with_restored(batch, held.model, cache))
        out = [held.scores(body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]) for at, to in textvec.slices(offsets)]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, "score"])


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """docs (text and any other columns) without its text, with score."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    if scorer is None:
        return docs.drop("text").withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # sequences of at most four letters and telling features
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "score double"])
    return docs.select(*(F.col(f"`{f.name}`") for f in others), "text").mapInArrow(partial(_score, scorer=shared), schema)


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the rows with crc32(doc_id) mod folds other than held."""
    own = columns(docs, doc_id="doc_id", text="text").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)))
    scorer = fit(own.where("NOT held_out AND doc_id IS NOT NULL").select("doc_id", "text"), labels)
    return score(own.select("doc_id", "held_out", "text"), scorer).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
