"""MinHash near-deduplication with sequential Bayesian verification.

1. Every text becomes the set of its k-word shingles (64-bit hashes) and a signature of 288 minima.
   Texts with the same set are one node from here on, however many rows and ids they have.
2. Signatures are cut into 48 bands of 6. A pair at similarity 0.8 shares no band with a chance of
   about 5e-7. Nodes that share a band are candidates.
3. The first node of a band's bucket leads it. Candidates are grouped under their leader, once however
   many bands they share, so every two that share a bucket meet in its leader's group. A group is cut into
   blocks of bounded size, and the leader comes along to each. Within a block members are compared with the
   leader, then those that are still apart from it with the other members. So a large group costs about one
   comparison and one shuffled set a member; what comes out are links of a spanning forest, not pairs.
4. Members that are then still apart from their leader, and only these, meet all other blocks of the group.
   In a group of g members with u such ones that is u * g comparisons and u * g / 256 shuffled sets.
5. A comparison reads the signatures in batches of 32 positions and stops as soon as the posterior
   chance of similarity >= 0.8, given the matches so far, is below ``MISS``. Survivors are verified
   exactly on their full shingle sets.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; with fewer than k words the
whole sequence is one shingle; a null text or one without words has no shingles and is linked with
nothing; rows that share an id are one document, repeated ones and those with different texts; a null id
gets a null component and is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm import textvec
from runledger.llm.common import columns, connected_components, in_batches, maybe_in, stored, without

BANDS, ROWS = 48, 6
PERMS = BANDS * ROWS
STEP = 32
MISS = 1e-6
#: A block holds about so many documents and shingles at most (one document at least).
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000

_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
_SKETCH = "doc_id long, n long, set_key binary, bands array<long>, sig binary"
_LINKS = "leader long, a long, b long"


def _minima(shingles: np.ndarray) -> np.ndarray:
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 4096):
        np.minimum(out, np.multiply.outer(_MULTIPLIERS, high[at : at + 4096]).min(axis=1), out=out)
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, word hashes, words before each row) in slices of bounded bytes."""
    body, offsets = textvec.buffers(batch.column("text"))
    for at, to in textvec.slices(offsets):
        words, counts = textvec.word_hashes(body[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        yield at, to, words, counts


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, words, counts in _texts(batch):
            minima, sizes, keys = np.zeros((to - at, PERMS), np.uint32), np.zeros(to - at, np.int64), []
            for i in range(to - at):
                shingles = textvec.shingle_hashes(words[counts[i] : counts[i + 1]], k)
                sizes[i] = len(shingles)
                keys.append(_key(shingles))
                if len(shingles):
                    minima[i] = _minima(shingles)
            bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (to - at, BANDS))
            for j in range(ROWS):
                bands = textvec.mix(bands * np.uint64(0x9E3779B97F4A7C15) + minima.reshape(-1, BANDS, ROWS)[:, :, j])
            full = sizes > 0
            ends = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, to - at), pa.array(sizes), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[full].reshape(-1).view(np.int64))),
                    pa.array([m.tobytes() for m in minima.astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "n", "set_key", "bands", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, words, counts in _texts(batch):
            sets = [textvec.shingle_hashes(words[counts[i] : counts[i + 1]], k) for i in range(to - at)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["set_key", "shingles"])


def fewest_matches(threshold: float, miss: float = MISS, steps: int = PERMS // STEP) -> np.ndarray:
    """For 32, 64, ... compared positions the fewest matches with P(similarity >= threshold | matches) >= miss.

    Uniform prior on the similarity s; a position matches by chance too, so with p = s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = np.zeros(steps, np.int64)
    for i in range(steps):
        n = STEP * (i + 1)
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)
        out[i] = int(np.argmax(posterior >= miss))
    return out


def _alive(one: np.ndarray, others: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """Places of the others that no batch of signature positions rules out against one."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for i, least in enumerate(fewest):
        span = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (others[alive, span] == one[span]).sum(axis=1)
        alive, matches = alive[matches >= least], matches[matches >= least]
    return alive


def _links(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of the others has 100 * intersection >= percent * union with one, on full sets."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat((one[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return common * 100 >= (len(one) + sizes - common) * percent


class _Block:
    """Nodes of a leader's group that meet in a task, in two parts of a forest; finds the links that join these."""

    def __init__(self, part: pa.Table, label: np.ndarray, percent: int) -> None:
        self.ids, self.label, self.percent = part.column("node").to_numpy(), label, percent
        self.sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, PERMS)
        sets = part.column("shingles").combine_chunks()
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
        self.sets, self.sizes = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], np.diff(ends)
        self.found: list[tuple[int, int]] = []

    def compare(self, i: int, others: np.ndarray, fewest: np.ndarray) -> None:
        """Link i with those of the others that are still apart from it and similar."""
        others = others[self.label[others] != self.label[i]]
        n = self.sizes[i]
        others = others[np.minimum(n, self.sizes[others]) * 100 >= np.maximum(n, self.sizes[others]) * self.percent]
        others = others[_alive(self.sigs[i], self.sigs[others], fewest)] if len(others) else others
        others = others[_links(self.sets[i], [self.sets[j] for j in others], self.percent)] if len(others) else others
        for j in others:
            if self.label[i] != self.label[j]:
                self.found.append((int(self.ids[i]), int(self.ids[j])))
                self.label[self.label == self.label[j]] = self.label[i]


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each value of the keys, out of rows sorted by them."""
    held: pa.Table | None = None

    def cuts(table: pa.Table) -> np.ndarray:
        own = [table.column(c).to_numpy() for c in keys]
        return np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in own], axis=0)) + 1, [table.num_rows]])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        at = cuts(held)
        for a, b in zip(at[:-2], at[1:-1], strict=True):  # the last may go on in the next batch
            yield held.slice(a, b - a)
        held = held.slice(at[-2])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _out(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["leader", "a", "b"])


def _first_links(batches: Iterator[pa.RecordBatch], fewest: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (leader, a, b) within the blocks of a group; b is null for a node that is still apart from its leader, where there are more blocks."""
    for part in _whole(batches, ("leader", "block")):
        leader, more = part.column("leader")[0].as_py(), part.column("blocks")[0].as_py() > 1
        block = _Block(part, np.arange(part.num_rows), percent)
        everyone, lead = np.arange(part.num_rows), int(np.flatnonzero(block.ids == leader)[0])
        block.compare(lead, everyone, fewest)
        for i in np.flatnonzero(block.label != block.label[lead]):
            block.compare(i, everyone[(everyone > i) | (block.label == block.label[lead])], fewest)
        rows = [(leader, a, b) for a, b in block.found]
        if more:
            rows += [(leader, int(a), None) for a in block.ids[block.label != block.label[lead]]]
        if rows:
            yield _out(rows)


def _second_links(batches: Iterator[pa.RecordBatch], fewest: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of open nodes (``mine``) with the nodes of another block; nodes that are not open are one part already."""
    for part in _whole(batches, ("leader", "one", "two")):
        mine, apart = (part.column(c).to_numpy() for c in ("mine", "apart"))
        block = _Block(part, np.where(apart, np.arange(part.num_rows), -1), percent)
        others = np.flatnonzero(~mine)
        for i in np.flatnonzero(mine):
            block.compare(i, others[block.ids[others] != block.ids[i]], fewest)
        if block.found:
            leader = part.column("leader")[0].as_py()
            yield _out([(leader, a, b) for a, b in block.found])


def _blocks(docs: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(docs) / BLOCK_DOCS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _group_links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (a, b) within groups (leader, node, n), verified."""
    fewest = fewest_matches(percent / 100)

    def material(rows: DataFrame) -> DataFrame:
        """rows with the signature and shingles of their node. Texts are never shuffled, only sets, and each node's once before rows need copies."""
        wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")
        found = in_batches(maybe_in(texts, "doc_id", wanted.select("id")), partial(_sets, k=k), "set_key binary, shingles array<long>")
        found = found.groupBy("set_key").agg(F.first("shingles").alias("shingles"))  # repeated rows, and what the filter lets through in excess
        return rows.join(wanted.join(found.hint("merge"), "set_key").select("node", "sig", "shingles").hint("merge"), "node")

    sizes = groups.groupBy("leader").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    # written, so that the joins with it have plain shuffles on both sides, whose hot leaders Spark can split
    sizes = stored(sizes.where("docs > 1").select("leader", _blocks("docs", "shingles").alias("blocks")), "near-sizes")
    members = groups.where("node <> leader").join(sizes, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks", "node")
    leaders = sizes.select("leader", _upto("blocks").alias("block"), "blocks", F.col("leader").alias("node"))
    dealt = material(members.unionByName(leaders)).repartition("leader", "block").sortWithinPartitions("leader", "block", "node")
    first = stored(in_batches(dealt, partial(_first_links, fewest=fewest, percent=percent), _LINKS), "near-links")
    still = first.where("b IS NULL").select("leader", F.col("a").alias("node"))
    if still.isEmpty():
        return first.select("a", "b")

    # open nodes against all other nodes of their group but the leader
    some = groups.where("node <> leader").join(still.withColumn("apart", F.lit(True)), ["leader", "node"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    totals = some.groupBy("leader").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.count_if("apart").alias("u"), F.sum(F.when(F.col("apart"), F.col("n"))).alias("v"))
    totals = stored(totals.where("u > 0").select("leader", _blocks("u", "v").alias("ones"), _blocks("docs", "shingles").alias("twos")), "near-sizes")
    some = some.join(totals, "leader")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    mine = some.where("apart").select("leader", block("ones").alias("one"), _upto("twos").alias("two"), "node", "apart", F.lit(True).alias("mine"))
    others = some.select("leader", _upto("ones").alias("one"), block("twos").alias("two"), "node", "apart", F.lit(False).alias("mine"))
    dealt = material(mine.unionByName(others)).repartition("leader", "one", "two").sortWithinPartitions("leader", "one", "two", "node")
    second = stored(in_batches(dealt, partial(_second_links, fewest=fewest, percent=percent), _LINKS), "near-links")
    return first.where("b IS NOT NULL").unionByName(second).select("a", "b")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) for every row of docs (doc_id, text).

    Links join documents with 100 * intersection >= percent * union of their shingle sets; a component's
    id is its smallest doc_id. class_id is the smallest doc_id with the same set.
    """
    texts = columns(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = stored(in_batches(texts, partial(_sketch, k=k), _SKETCH), "near-sketches")
    own = sketches.where("n > 0 AND doc_id IS NOT NULL")
    nodes = own.groupBy("set_key").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "bands", "sig")))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("leader")).where("c > 1")
    groups = stored(members.join(buckets, "key").groupBy("leader", "node").agg(F.min("n").alias("n")), "near-groups")
    links = _group_links(groups, nodes.select("node", "id", "set_key", "sig"), texts, k, percent)

    several = own.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b")
    several = stored(own.select("doc_id", "set_key").join(several.select("doc_id", "a"), "doc_id"), "near-ids")  # ids with more than one text
    if not several.isEmpty():
        key = nodes.select("set_key", "node")
        links = links.unionByName(several.join(key.withColumnRenamed("node", "b"), "set_key").join(key.select(F.col("set_key").alias("a"), F.col("node").alias("c")), "a").select(F.col("c").alias("a"), "b").distinct())

    labels = connected_components(links).select(F.col("id").alias("node"), "component")
    named = nodes.select("node", "id", "set_key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labels.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component", "left").select("set_key", F.col("id").alias("class_id"), F.coalesce("least", "id").alias("component_id"))
    there = F.col("doc_id").isNotNull()
    joined = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(named, "set_key", "left")
    joined = joined.withColumn("component_id", F.when(there, F.coalesce("component_id", "doc_id"))).withColumn("class_id", F.when(there, F.coalesce("class_id", "doc_id")))
    return joined.select("doc_id", "n_shingles", "component_id", (there & (F.col("doc_id") == F.col("component_id"))).alias("kept"), "class_id")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay (one document of each group, with all rows of its id), with all their columns.

    Rows without id and those without words stay; an empty table stays one. Of the texts only those whose
    id may have to go are shuffled.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("_id"))
    gone = near_components(docs, k, percent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return without(own, ["_id"], stored(gone, "near-gone")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
