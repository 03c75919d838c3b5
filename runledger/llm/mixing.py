"""Mixing sources to target weights by entropy balancing.

Every document i of source s gets a rate r_i >= 0, the expected number of its copies in the mix. Among
all rates with sum(r_i * size_i) = target_s and r_i <= 3 the ones nearest to 1 in relative entropy are
r_i = min(3, exp(lambda_s * size_i / mean_s)); the convex dual in lambda is solved by Newton steps, each
one distributed aggregation over the (source, size) histogram. Rates are then rounded into copies:
systematically along the sizes of a source, and the rest of the target is filled greedily, so that what
a source takes misses its target by less than its smallest document that still has room.

Defined results: a null text has size 0; a null source is a source of its own and comes last; documents
of size 0 count towards no target and get the copies their rate of 1 rounds to, taking 0 words; repeated
rows are documents of their own; an empty table gives an empty result; other columns are ignored.
Everything is DataFrame operations; nothing is collected but one convergence flag a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import columns, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: A hot cell's rows are ranked in so many parts at least, and in one more for every ROWS_A_SALT rows of the table.
SALTS, ROWS_A_SALT = 64, 500_000
_STEPS_A_ROUND = 4
_MOST_ROUNDS = 40
_FILL_PASSES = 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(cells: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(src, source_size, n_sized, target) from cells (src, source, size, cell_n): weights by code point order, null last.

    A target stops at ``most`` times its source's size; the excess is shared again by weight until none
    is above. Sorted by cap over weight the capped sources come first, so one running sum finds the level.
    The windows run over one row a source.
    """
    one = W.orderBy(F.asc_nulls_last("source"))
    sized = F.when(F.col("size") > 0, F.col("cell_n")).otherwise(0)
    by_source = cells.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("cell_n")).alias("source_size"), F.sum(sized).alias("n_sized"))
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(one) - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("src"))
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return ranked.withColumn("target", target).select("src", "source_size", "n_sized", "target")


def _rate(most: int) -> Column:
    """The tilted rate of a cell; sources at their cap take everything at the most, those without target nothing."""
    tilted = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(most)))))
    return F.when(F.col("full"), F.lit(float(most))).when(F.col("target") <= 0, F.when(F.col("size") > 0, 0.0).otherwise(1.0)).otherwise(tilted)


def _newton(cells: DataFrame, params: DataFrame, most: int) -> DataFrame:
    """One safeguarded Newton step on log(taken / target) for every source."""
    rate = _rate(most)
    at = cells.join(params, "src").groupBy("src", "source_size", "target", "mean", "full", "lo", "hi", "lam").agg(
        F.sum(F.col("cell_n") * F.col("size") * rate).alias("taken"),
        F.sum(F.when(F.col("lam") * F.col("size") / F.col("mean") < F.log(F.lit(float(most))), F.col("cell_n") * F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope"),
    )
    gap = F.log(F.col("taken") / F.col("target"))
    at = at.withColumn("gap", F.when(F.col("full") | (F.col("target") <= 0), F.lit(0.0)).when(F.coalesce(F.col("taken"), F.lit(0.0)) <= 0, F.lit(-1.0)).otherwise(gap))
    at = at.withColumn("lo", F.when(F.col("gap") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
    step = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") * F.col("taken") / F.col("slope"))
    stride = F.greatest(F.lit(1.0), F.abs("lam"))
    middle = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).when(F.col("gap") < 0, F.col("lam") + stride).otherwise(F.col("lam") - stride)
    inside = step.isNotNull() & ~F.isnan(step) & (F.coalesce(step > F.col("lo"), F.lit(True))) & (F.coalesce(step < F.col("hi"), F.lit(True))) & (F.abs(step - F.col("lam")) <= 2 * stride)
    done = F.abs("gap") <= 1e-9
    lam = F.when(done, F.col("lam")).when(inside, step).otherwise(middle)
    return at.select("src", "source_size", "target", "mean", "full", "lo", "hi", lam.alias("lam"), (done | (lam == F.col("lam"))).alias("done"))


def balance(cells: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """The dual solution: (src, source_size, target, mean, full, lam) for cells (src, size, cell_n)."""
    none = F.lit(None).cast("double")
    params = targets.select(
        "src", "source_size", "target", (F.col("source_size") / F.greatest("n_sized", F.lit(1)) + F.when(F.col("source_size") == 0, 1.0).otherwise(0.0)).alias("mean"),
        (F.col("target") >= F.col("source_size") * float(most)).alias("full"), none.alias("lo"), none.alias("hi"), F.lit(0.0).alias("lam"), F.lit(False).alias("done"),
    )
    params = stored(params, "mix-dual")
    for _ in range(_MOST_ROUNDS):
        for _ in range(_STEPS_A_ROUND):
            params = _newton(cells, params, most)
        params = stored(params, "mix-dual")
        if params.where("NOT done").isEmpty():
            break
    return params.select("src", "source_size", "target", "mean", "full", "lam")


def _cell_copies(cells: DataFrame, dual: DataFrame, most: int) -> DataFrame:
    """(src, size, cell_n, cell_copies): whole copies of each cell, by windows over the distinct sizes of a source."""
    source, sizes = W.partitionBy("src"), W.partitionBy("src").orderBy("size")
    at = cells.join(dual, "src").withColumn("rate", _rate(most))
    at = at.withColumn("ideal", F.sum(F.col("cell_n") * F.col("rate")).over(sizes.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.floor(F.col("ideal") + 0.5)
    at = at.withColumn("whole", whole).withColumn("k", F.least(F.col("whole") - F.coalesce(F.lag("whole").over(sizes), F.lit(0)), F.col("cell_n") * most))
    for _ in range(_FILL_PASSES):
        at = at.withColumn("rest", F.col("target") - F.sum(F.col("k") * F.col("size")).over(source))
        room = F.when(F.col("rest") > 0, F.col("cell_n") * most - F.col("k")).otherwise(F.col("k"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & (room > 0)
        at = at.withColumn("best", F.max(F.when(fits, F.col("size"))).over(source))
        moved = F.least(room, F.floor(F.abs("rest") / F.col("size"))) * F.signum("rest").cast("long")
        at = at.withColumn("k", F.col("k") + F.when(F.col("size") == F.col("best"), moved).otherwise(0))
    return at.select("src", "size", "cell_n", F.col("k").alias("cell_copies"), "rate", "source_size", "target")


def _mixed(docs: DataFrame, own: dict[str, str], weights, most: int, salts: int | None) -> DataFrame:
    """docs' columns under the names of own, with what the mix does with each row.

    Within a cell of equal source and size the first documents by id take the spare copies; ranks are
    counted in parts that grow in number with the table, so that no task holds a hot cell.
    """
    salts = salts or max(SALTS, docs.count() // ROWS_A_SALT)
    at = columns(docs, id="doc_id", source="source", text="text", **own)
    at = at.withColumn("size", word_count(F.col("text"))).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("salt", F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(salts)))
    at = at.select("id", "src", "source", "size", "salt", *own)
    if list(own.values()) == ["doc_id"]:
        at = stored(at, "mix-sizes")
    parts = stored(at.groupBy("src", "source", "size", "salt").agg(F.count("*").alias("part_n")), "mix-cells")
    cells = parts.groupBy("src", "source", "size").agg(F.sum("part_n").alias("cell_n"))
    cells = stored(cells, "mix-cells")
    targets = source_targets(cells, weights, most)
    cells = cells.select("src", "size", "cell_n")
    # the plan of all fill passes is run by itself: the one that moves the rows is small
    copies = stored(_cell_copies(cells, balance(cells, targets, most), most), "mix-copies")
    before = W.partitionBy("src", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("src", "size", "salt", "part_n").join(copies, ["src", "size"]).withColumn("before", F.coalesce(F.sum("part_n").over(before), F.lit(0)))
    ranked = at.join(parts, ["src", "size", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("src", "size", "salt").orderBy("id")) - 1)
    spare = (F.col("rank") < F.col("cell_copies") % F.col("cell_n")).cast("long")
    ranked = ranked.withColumn("copies", F.floor(F.col("cell_copies") / F.col("cell_n")) + spare)
    return ranked.select(*own, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mix(docs: DataFrame, keep: list[str] | None = None, weights=WEIGHTS, most: int = MOST_COPIES, salts: int | None = None) -> DataFrame:
    """The mix of docs (doc_id, source, text): size, source_size, target, taken, copies and rate of each row.

    ``keep``: columns of docs to carry along (default doc_id only); then the new columns are called mix_*.
    """
    own = {f"k{i}": c for i, c in enumerate(keep or ["doc_id"])}
    mixed = _mixed(docs, own, weights, most, salts)
    return mixed.select(*(F.col(k).alias(c) for k, c in own.items()), *(F.col(n).alias(f"mix_{n}" if keep else n) for n in mixed.columns if n not in own))


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of docs with all their columns whatever these are called, each as often as the mix takes it.

    Null and empty texts have size 0 and stay once; ties and repeated rows as in ``mix``; an empty table stays one.
    """
    own = {f"k{i}": c for i, c in enumerate(docs.columns)}
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return _mixed(docs, own, WEIGHTS, MOST_COPIES, None).where("copies > 0").select(*own, copy).select(*(F.col(k).alias(c) for k, c in own.items()))
