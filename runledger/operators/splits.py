"""Leakage-safe splits: every run of a task lands on the same side, decided by hashes of the task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_mod(text: Column, m: int) -> Column:
    """The 256-bit SHA-256 of text modulo m, exactly, 16 bits at a time (m below 2**46)."""
    h = F.sha2(text, 256)
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("long"), lambda acc, i: (acc * 65536 + F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("long")) % m)


def holdout(tasks: DataFrame, salt: str, out_of: int = 10_000, below: int = 2_000) -> DataFrame:
    """tasks with in_holdout by bucket of sha256(salt NUL task_id): no shuffle."""
    bucket = hash_mod(F.concat(F.lit(salt), F.lit("\0"), F.col("task_id")), out_of)
    return tasks.withColumn("bucket", bucket).withColumn("in_holdout", bucket < below)


def ranked_folds(tasks: DataFrame, salt: str, folds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct tasks (within ``by``) dealt to folds in order of sha256(salt NUL task_id).

    Ranks are counted in 256 ranges of the hash and offset by the sizes of the ranges before, so no task
    ranks all rows.
    """
    own = tasks.select(*by, "task_id").distinct().withColumn("h", F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.col("task_id")), 256)).withColumn("range", F.substring("h", 1, 2))
    sizes = own.groupBy(*by, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*(by or (F.lit(0),))).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).drop("n")
    rank = F.row_number().over(W.partitionBy(*by, "range").orderBy("h", "task_id")) + F.col("before") - 1
    return own.join(sizes, [*by, "range"]).select(*by, "task_id", rank.alias("rank"), (rank % folds).cast("int").alias("fold"))


def roles(folds: DataFrame, k: int) -> DataFrame:
    """Every test fold's view of the tasks: test, calibration (the next fold), validation (the one after), else train."""
    at = folds.crossJoin(F.broadcast(folds.sparkSession.range(k).select(F.col("id").cast("int").alias("test_fold"))))
    ahead = F.pmod(F.col("fold") - F.col("test_fold"), F.lit(k))
    return at.withColumn("role", F.when(ahead == 0, "test").when(ahead == 1, "calibration").when(ahead == 2, "validation").otherwise("train"))


def balanced_folds(members: DataFrame, salt: str, folds: int) -> DataFrame:
    """Folds in which every group of members (task_id, group_id) is spread: tasks of one membership signature are dealt
    out in hash order, starting at a fold of the signature's own."""
    signed = members.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("group_id")), "|").alias("signature"))
    ranked = ranked_folds(signed, salt, folds, ("signature",))
    start = hash_mod(F.concat(F.lit(salt), F.lit("\0"), F.col("signature")), folds)
    return ranked.select("task_id", "signature", ((F.col("rank") + start) % folds).cast("int").alias("fold"))


def nested_protocol(tasks: DataFrame, salt: str, seeds: tuple[int, ...], outer: int = 5, inner: int = 5) -> DataFrame:
    """Development tasks (outside the holdout) with their outer fold under each seed and, for every outer test fold they
    are trained for, the inner fold."""
    dev = holdout(tasks.select("task_id").distinct(), salt).where("NOT in_holdout").select("task_id")
    out = None
    for seed in seeds:  # a few constants
        outer_folds = ranked_folds(dev, f"{salt}:{seed}:outer", outer).select("task_id", F.col("fold").alias("outer_fold"))
        training = roles(outer_folds.withColumnRenamed("outer_fold", "fold"), outer).where("role = 'train'").select("task_id", F.col("test_fold"))
        inner_folds = ranked_folds(training, f"{salt}:{seed}:inner", inner, ("test_fold",)).select("task_id", "test_fold", F.col("fold").alias("inner_fold"))
        one = inner_folds.join(outer_folds, "task_id").withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


#: Declared groups that covering_folds takes at most; what it plans on the driver is bounded by this times the folds, squared.
GROUPS = 2_000


def _starts(sizes: dict[str, int], of: dict[str, list[str]], at: dict[str, int], fixed: dict[tuple[str, int], int], folds: int) -> dict[str, int]:
    """New first folds of the movable signatures: each in turn goes where most (group, fold) places gain their only
    tasks and none loses its last, until a round changes nothing. A place's count only falls if it stays above 0."""
    there = dict(fixed)
    covers = lambda s, start: [(start + i) % folds for i in range(sizes[s])]
    def put(s: str, start: int, by: int) -> None:
        for g in of[s]:
            for f in covers(s, start):
                there[g, f] = there.get((g, f), 0) + by

    for s in sizes:
        put(s, at[s], 1)
    for _ in range(len(sizes) + 1):  # every round but the last covers a place more
        before = dict(at)
        for s in sorted(sizes):
            put(s, at[s], -1)
            gain = lambda start, s=s: sum(not there.get((g, f), 0) for g in of[s] for f in covers(s, start))
            best = max(gain(start) for start in range(folds))
            if gain(at[s]) < best:
                at[s] = next(start for start in range(folds) if gain(start) == best)
            put(s, at[s], 1)
        if at == before:
            break
    return at


def covering_folds(members: DataFrame, salt: str, folds: int) -> DataFrame:
    """balanced_folds in which every group has a task in every fold: (task_id, signature, fold, moved).

    A signature with as many tasks as folds is in all of them; only groups without one can lack a fold. For each such
    group up to ``folds`` of its smaller signatures (by hash) may turn to another first fold, which moves all their
    tasks; that many are enough for a group by itself. Signatures turn one after the other, so a cover that needs
    several to turn at once may be missed; a group that still lacks a fold is an error with its name, as is one with
    fewer tasks than folds. Null groups and tasks count for nothing; repeated members count once; no members, no rows.
    What reaches the driver is bounded by GROUPS groups times folds rows; more groups are an error.
    """
    own = members.select("task_id", "group_id").where("task_id IS NOT NULL AND group_id IS NOT NULL").distinct()
    dealt = balanced_folds(own, salt, folds)
    sizes = dealt.groupBy("signature").agg(F.count("*").cast("int").alias("n"))
    signed = own.join(dealt, "task_id")
    groups = signed.groupBy("group_id", "signature").agg(F.count("*").alias("n")).groupBy("group_id").agg(F.max("n").alias("most"), F.sum("n").alias("tasks"))
    told = groups.orderBy("group_id").limit(GROUPS + 1).collect()
    if len(told) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    if few := [r.group_id for r in told if r.tasks < folds]:
        raise ValueError(f"groups with fewer tasks than folds: {few}")
    spread = signed.join(F.broadcast(groups.where(F.col("most") < folds).select("group_id")), "group_id")  # at most GROUPS rows
    places = spread.groupBy("group_id", "fold").agg(F.count("*").alias("n"))
    lacking = places.groupBy("group_id").agg(F.count("*").alias("k")).where(F.col("k") < folds).select("group_id")
    small = spread.join(F.broadcast(lacking), "group_id").select("group_id", "signature").distinct()
    rank = F.row_number().over(W.partitionBy("group_id").orderBy(F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.col("signature")), 256), "signature"))
    movable = small.withColumn("rank", rank).where(F.col("rank") <= folds).select("signature").distinct()
    start = hash_mod(F.concat(F.lit(salt), F.lit("\0"), F.col("signature")), folds).cast("int")
    turning = spread.join(movable, "signature").select("signature", "group_id").distinct().join(sizes, "signature").groupBy("signature", "n").agg(F.collect_set("group_id").alias("groups")).withColumn("start", start).collect()
    count = {(r.group_id, r.fold): r.n for r in places.collect()}
    of = {r.signature: r.groups for r in turning}
    for r in turning:
        for g in r.groups:
            for i in range(r.n):
                count[g, (r.start + i) % folds] -= 1
    before = {r.signature: r.start for r in turning}
    size = {r.signature: r.n for r in turning}
    after = _starts(size, of, dict(before), count, folds)
    for s, first in after.items():
        for g in of[s]:
            for i in range(size[s]):
                count[g, (first + i) % folds] = count.get((g, (first + i) % folds), 0) + 1
    if bare := sorted({g for g in {r.group_id for r in told if r.most < folds} if any(not count.get((g, f), 0) for f in range(folds))}):
        raise ValueError(f"groups without a task in some fold: {bare}")
    turns = [(s, (after[s] - before[s]) % folds) for s in after]
    turned = members.sparkSession.createDataFrame(turns, "signature string, turn int")
    out = dealt.join(F.broadcast(turned), "signature", "left").withColumn("turn", F.coalesce("turn", F.lit(0)))
    return out.select("task_id", "signature", ((F.col("fold") + F.col("turn")) % folds).alias("fold"), (F.col("turn") != 0).alias("moved"))
