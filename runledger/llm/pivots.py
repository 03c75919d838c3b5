"""Embedding near-deduplication through a pivot-permutation index.

Every vector is described by the ordered list of its nearest reference points (pivots). The index is
inverted: a list for every ``shared`` pivots together, holding the vectors that have all of them among
their ``prefix`` nearest. Two vectors meet in a list exactly if they share so many pivots; pairs that
meet are verified by cosine in double precision. Pivots are fitted on a bounded sample (``SAMPLE``
vectors a dimension, chosen by hash, picked farthest-first while they are further apart than two links can reach;
the rest are seeded random directions, so that no two lie within one tight group, whose order would be noise); every vector is indexed. Long lists are cut
into blocks and every pair of blocks is a task's work of its own, so a hot list is spread and none is cut
off. A pair is counted in one list only, that of its smallest shared pivots.

Equal vectors of a label are one class from the start and are never expanded into pairs. Vectors are
compared only under equal labels that are not null and in equal dimensions. Defined results: a vector
that is null, empty, zero or holds a null or non-finite component links with nothing and is its own
component; repeated rows count as other vectors; a null id counts in no component and gets a null one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import columns, connected_components, stored

PIVOTS, PREFIX, SHARED = 64, 6, 3
SAMPLE = 1024
BLOCK = 512
MOST_DIMENSIONS = 64


def fit_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, least: float = 0.98) -> dict[int, np.ndarray]:
    """Pivots of each dimension from at most ``sample`` vectors of it (and of at most 64 dimensions; others take
    seeded random ones), picked farthest-first by cosine and no closer than twice the angle of ``least``."""
    apart = math.cos(min(math.pi, 2 * math.acos(min(1.0, max(-1.0, least)))))
    dims = [r["dim"] for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMENSIONS).collect()]
    out = {}
    for dim in dims:
        rows = vectors.where(F.col("dim") == dim).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        unit = np.array([r["vector"] for r in rows], float)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        chosen, nearest = [0], unit @ unit[0]
        while len(chosen) < min(pivots, len(unit)):
            furthest = int(np.argmin(nearest))
            if nearest[furthest] >= apart:
                break
            chosen.append(furthest)
            nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        out[dim] = np.concatenate([unit[chosen], _random(dim, pivots - len(chosen))])
    return out


def _random(dim: int, n: int) -> np.ndarray:
    raw = np.random.default_rng(dim).normal(size=(n, dim))
    return raw / np.linalg.norm(raw, axis=1)[:, None] if n else raw


def _vectors(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _index(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], prefix: int) -> Iterator[pa.RecordBatch]:
    """The permutation prefix (nearest pivots first) of each vector."""
    for batch in batches:
        own = _vectors(batch.column("vector"))
        nearest: list = [None] * len(own)
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(own):
            by_dim.setdefault(len(v), []).append(i)
        for dim, rows in by_dim.items():
            points = pivots.get(dim)
            points = _random(dim, PIVOTS) if points is None else points
            order = np.argsort(-(np.array([own[i] for i in rows]) @ points.T), axis=1, kind="stable")[:, :prefix]
            for i, found in zip(rows, order, strict=True):
                nearest[i] = found.astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "copies", "vector")), pa.array(nearest, pa.list_(pa.int32()))], ["id", "label", "copies", "vector", "nearest"])


def _verify(batches: Iterator[pa.RecordBatch], least: float, shared: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, links) of sorted blocks: links counted for vector a (b null), or an edge (a, b) of a component."""
    held: pa.Table | None = None

    def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
        vectors = _vectors(table.column("vector").combine_chunks())
        nearest = _vectors(table.column("nearest").combine_chunks())
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        cuts = _cuts(table)
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if to - at < 2:
                continue
            x = np.array(vectors[at:to])
            norm = np.sqrt((x * x).sum(axis=1))
            close = (x @ x.T) / norm[:, None] / norm >= least
            np.fill_diagonal(close, False)
            halves = block[at:to]
            if halves[0] != halves[-1]:  # two blocks: only the pairs across them
                close &= halves[:, None] != halves
            if not close.any():
                continue
            smallest = np.sort(np.array(nearest[at:to]), axis=1)
            one, two = np.nonzero(np.triu(close))
            own = _first_shared(smallest, one, two, shared)
            here = _first_of(table, at)
            counted = (own == here).all(axis=1)
            here_links = np.zeros(to - at, np.int64)
            np.add.at(here_links, one[counted], copies[at + two[counted]])
            np.add.at(here_links, two[counted], copies[at + one[counted]])
            for i in np.flatnonzero(here_links):
                counts[ids[at + i]] = counts.get(ids[at + i], 0) + int(here_links[i])
            label = np.arange(to - at)
            while True:
                low = np.where(close, label, to - at).min(axis=1)
                new = np.minimum(label, low)
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            edges += [(int(ids[at + i]), int(ids[at + label[i]])) for i in np.flatnonzero(label != np.arange(to - at))]
        rows = [(a, None, n) for a, n in counts.items()] + [(a, b, 0) for a, b in edges]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "links"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cuts = _cuts(held)
        if len(cuts) > 2:  # the last group may go on in the next batch
            yield from worked(held.slice(0, cuts[-2]))
            held = held.slice(cuts[-2])
    if held is not None:
        yield from worked(held)


def _cuts(table: pa.Table) -> np.ndarray:
    key, one, two = (table.column(c).to_numpy() for c in ("key", "one", "two"))
    new = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])


def _first_of(table: pa.Table, at: int) -> np.ndarray:
    return np.array(table.column("pivots")[at].as_py(), np.int32)


def _first_shared(smallest: np.ndarray, one: np.ndarray, two: np.ndarray, shared: int) -> np.ndarray:
    """The ``shared`` smallest pivots that both ends of each pair have."""
    a, b = smallest[one], smallest[two]
    common = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int32).max)
    return np.sort(common, axis=1)[:, :shared]


def near_vectors(vectors: DataFrame, least: float = 0.98, pivots: int = PIVOTS, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    own = columns(vectors, vec_id="vec_id", embedding="embedding", label="label")
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    own = own.withColumn("usable", usable)
    classes = stored(own.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    fitted = fit_pivots(classes.select("id", "vector", F.size("vector").alias("dim")), pivots, least=least)
    index = stored(classes.select("id", "label", "copies", "vector").mapInArrow(partial(_index, pivots=fitted, prefix=prefix), "id long, label string, copies long, vector array<double>, nearest array<int>"), "vector-index")

    # inverted lists: one for every ``shared`` pivots of the prefix, smallest first
    sets = F.array(*(F.array_sort(F.array(*(F.element_at("nearest", i + 1) for i in places))) for places in combinations(range(prefix), shared)))
    posts = index.select("id", "label", F.size("vector").alias("dim"), F.explode(sets).alias("pivots")).select("id", "label", "dim", "pivots", F.xxhash64("label", "dim", "pivots").alias("key"))
    lengths = posts.groupBy("label", "dim", "pivots").agg(F.count("*").alias("n")).where("n > 1")
    lists = posts.join(lengths, ["label", "dim", "pivots"])
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    lists = lists.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "pivots")
    full = lists.join(index.select("id", "copies", "vector", "nearest"), "id")
    dealt = full.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "block", "id")
    found = stored(dealt.mapInArrow(partial(_verify, least=least, shared=shared), "a long, b long, links long"), "vector-links")

    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b IS NOT NULL").selectExpr("a", "b"))
    by_class = classes.join(links, classes["id"] == links["a"], "left").drop("a").join(parts.withColumnRenamed("id", "part"), F.col("id") == F.col("part"), "left")
    by_class = by_class.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = own.where("usable").join(by_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    lone = own.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
