"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Document rates are the ones nearest to 1 (in relative entropy) that meet the targets
and stay at or below the cap: rate = min(cap, exp(lambda_source * size / mean size)). The lambdas maximise a concave
dual that separates by source; safeguarded Newton steps for all sources at once run over a histogram of sizes. Rates
are then rounded to whole copies systematically: documents of a part of a source stand in order of size, and one more
copy is taken each time the running sum of the rates' fractions passes a whole number, so a part misses its sum of words
by less than its longest document. At most as many rounds of single moves as the cap then bring each source as near to its
target as its documents allow.

Defined results: null texts have size 0; a null source is a source of its own, ordered last; empty tables give empty
results; sources whose texts are all empty take nothing; repeated rows, and rows without a doc_id, are rows of their own;
other columns are kept as they are and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fitted, fresh, join_spread, materialize, named, row_keyed, stable

CAP = 3
WEIGHTS = (1, 2, 3)
#: Relative error of a source's sum.
TOLERANCE = 1e-9
#: Documents of a part of a source, and most parts of one; bits of the hash that part equal sizes in a round of moves; the
#: unit of fractions is 2 ** -UNIT.
PART, PARTS, PART_BITS, UNIT = 1000, 4096, 12, 40
#: A source: its name, and whether it has one, so that joins need no comparison of nulls.
SOURCE = ["has_source", "source"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_source(source: Column) -> list[Column]:
    return [source.isNotNull().alias("has_source"), F.coalesce(source, F.lit("")).alias("source")]


def ranked(per: DataFrame) -> DataFrame:
    """One row a source with `rank`, from 0 by code point, null last: sorted by ranges, then the ranges' counts are summed."""
    at = materialize(per.orderBy(F.desc("has_source"), "source").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = at.groupBy(part.alias("part")).agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    return at.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id", "part", "start")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """has_source, source, source_size, n_docs, target. `sizes` has the source, size and n (rows of that size).

    Water filling: sources not capped share by weight what the capped ones leave, at one level of words a unit of weight;
    sources above cap times their size at this level are capped, until none is. Only sums come to the driver."""
    per = sizes.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    per = materialize(ranked(per).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))))
    room = F.col("source_size") * cap
    total, level, before = per.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        capped = room <= F.col("weight") * F.lit(level)
        k, full, open_ = per.agg(F.count_if(capped), F.sum(F.when(capped, room)), F.sum(F.when(~capped, F.col("weight")))).first()
        if k == before or not open_:
            break
        before, level = k, (total - (full or 0)) / open_
    return per.select(*SOURCE, "source_size", "n_docs", F.least(room.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """targets with lam, the solution of the dual: sum of size * min(cap, exp(lam * size / mean)) = target.

    Newton steps on the logarithm of the words taken; one that leaves the bracket known so far is replaced by a bisection, or by a doubling while the bracket
    is open. All sources step together; the histogram is read once a step, whatever the number of documents. The words
    taken grow with lam from 0 to all that the cap allows, so each open target is reached; a bracket ends at a double.
    """
    state = materialize(
        targets.withColumn("mean", F.col("source_size") / F.col("n_docs"))
        .withColumn("full", F.col("target") >= F.col("source_size") * cap * (1 - TOLERANCE))
        .withColumns({"lam": F.lit(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "done": (F.col("source_size") == 0) | F.col("full")})
    )
    sizes, n = sizes.where("size > 0"), targets.count()
    while True:
        if state.where(~F.col("done")).isEmpty():
            return state
        open_ = state.where(~F.col("done"))
        x = F.col("size") / F.col("mean")
        tilted = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        inside = tilted < cap
        sums = (
            sizes.join(open_.select(*SOURCE, "lam", "mean"), SOURCE)
            .groupBy(*SOURCE)
            .agg(
                F.sum(F.col("n") * F.col("size") * F.when(inside, tilted).otherwise(F.lit(float(cap)))).alias("taken"),
                F.sum(F.when(inside, F.col("n") * F.col("size") * x * tilted).otherwise(0.0)).alias("slope"),
            )
        )
        sums = fitted(sums, n)
        below, at = F.col("off") < 0, F.col("lam")
        step = state.join(sums, SOURCE, "left").withColumn("off", F.col("taken") - F.col("target"))
        step = step.withColumns({"low": F.when(below, at).otherwise(F.col("lo")), "high": F.when(F.col("off") > 0, at).otherwise(F.col("hi")), "newton": at - F.ln(F.try_divide("taken", "target")) * F.try_divide("taken", "slope"), "reach": 2 * F.abs(at) + 8})
        step = materialize(fitted(step, n))  # a step's choices on stored numbers: short plans
        near = (F.col("slope") > 0) & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")) & (F.abs(F.col("newton") - at) < F.col("reach"))
        held = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        out = F.when(below, F.least("high", at + F.col("reach"))).otherwise(F.greatest("low", at - F.col("reach")))
        after = F.when(near, F.col("newton")).when(held, (F.col("low") + F.col("high")) / 2).otherwise(out)
        met = F.abs("off") <= F.col("target") * TOLERANCE
        closed = F.col("high") - F.col("low") <= F.lit(1e-14) * (F.abs(at) + 1)
        kept = F.col("done") | F.col("taken").isNull()
        moved_to = {"lam": F.when(met, at).otherwise(after), "lo": F.col("low"), "hi": F.col("high"), "done": met | closed}
        state = step.select(*SOURCE, "source_size", "n_docs", "target", "mean", "full", *(F.when(kept, F.col(c)).otherwise(v).alias(c) for c, v in moved_to.items()))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 8) -> DataFrame:
    """One row per document of a `stable` table: row, doc_id, source, size, source_size, target, rate, copies, taken (size * copies)."""
    counted = materialize(row_keyed(docs.select("doc_id", "source", "text"), "row").select("row", "doc_id", *with_source(F.col("source")), word_count(F.col("text")).alias("size")))
    total = counted.count()
    sizes = materialize(fitted(counted.groupBy(*SOURCE, "size").agg(F.count("*").alias("n")), total))
    state = tilts(sizes, source_targets(sizes, weights, cap), cap)
    of_source = join_spread(counted, state.withColumn("n", F.col("n_docs")), SOURCE, total)
    tilted = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(cap))).otherwise(F.least(tilted, F.lit(float(cap))))
    shuffled = F.xxhash64(F.lit(seed), "doc_id", "size")
    part = F.pmod(shuffled, F.least(F.ceil(F.col("n_docs") / PART), F.lit(PARTS)))
    in_order = Window.partitionBy(*SOURCE, "part").orderBy("size", "shuffled", "row")
    past = F.sum("fraction").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) + F.pmod(F.xxhash64(F.lit(seed), *SOURCE, "part"), F.lit(1 << UNIT))
    extra = F.shiftright(past, UNIT) - F.shiftright(past - F.col("fraction"), UNIT)
    rounded = (
        of_source.withColumns({"rate": rate, "shuffled": shuffled, "part": part})
        .withColumn("fraction", F.floor((F.col("rate") - F.floor("rate")) * float(1 << UNIT)).cast("long"))
        .withColumn("copies", (F.floor("rate") + extra).cast("int"))
    )
    kept = ["row", "doc_id", *SOURCE, "size", "source_size", "target", "rate", "copies", "n_docs", "shuffled"]
    rounded = moved(materialize(rounded.select(*kept)), cap, total)
    return rounded.select("row", "doc_id", F.when(F.col("has_source"), F.col("source")).alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def moved(rounded: DataFrame, cap: int, total: int) -> DataFrame:
    """Rows with single documents taken once more (or less) until no able document is as short as what its source still
    lacks (or has too much). A round goes through the sizes of a source from the longest down and takes as many of each as
    still fit, from counts alone; so only documents that can move again are left to the next, `cap` rounds in all. Of
    equal size those with the least hash move: counts by part of the hash say which parts do so wholly."""
    while True:
        rest = rounded.groupBy(*SOURCE).agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("rest"), F.count("*").alias("n"))
        rest = materialize(fitted(rest, total).select(*SOURCE, F.round("rest").cast("long").alias("rest"), "n").where("rest <> 0"))
        room = F.when(F.col("rest") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        able = join_spread(rounded, rest, SOURCE, total).where((F.col("size") > 0) & (F.abs("rest") >= F.col("size")) & room)
        part = F.shiftrightunsigned("shuffled", 64 - PART_BITS).cast("int")
        able = able.select(*SOURCE, "size", "rest", part.alias("part"), "shuffled", "row")
        counts = materialize(fitted(able.groupBy(*SOURCE, "size", "part").agg(F.count("*").alias("k"), F.first("rest").alias("rest")), total))
        sizes = counts.groupBy(*SOURCE, "size").agg(F.sum("k").alias("k"), F.first("rest").alias("rest")).groupBy(*SOURCE)
        sizes = sizes.agg(F.sort_array(F.collect_list(F.struct("size", "k")), asc=False).alias("sizes"), F.first("rest").alias("rest"))
        none = F.filter(F.transform("sizes", lambda c: F.struct(c["size"].alias("size"), c["k"].alias("take"))), lambda c: F.lit(False))
        start = F.struct(F.abs("rest").alias("left"), none.alias("taken"))

        def step(acc: Column, c: Column) -> Column:
            take = F.least(c["k"], F.floor(acc["left"] / c["size"]).cast("long"))
            found = F.struct((acc["left"] - take * c["size"]).alias("left"), F.concat(acc["taken"], F.array(F.struct(c["size"].alias("size"), take.alias("take")))).alias("taken"))
            return F.when(take > 0, found).otherwise(acc)

        quotas = sizes.select(*SOURCE, F.signum("rest").cast("int").alias("move"), F.explode(F.aggregate("sizes", start, step)["taken"]).alias("q")).select(*SOURCE, "move", "q.size", "q.take")
        past = Window.partitionBy(*SOURCE, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a part
        shares = counts.join(quotas, [*SOURCE, "size"]).withColumn("mine", F.least("k", F.col("take") - F.coalesce(F.sum("k").over(past), F.lit(0)))).where("mine > 0")
        shares = materialize(fitted(shares.select(*SOURCE, "size", "part", "move", "mine"), total))
        if shares.isEmpty():
            return rounded
        first = Window.partitionBy(*SOURCE, "size", "part").orderBy("shuffled", "row")
        moves = able.join(shares, [*SOURCE, "size", "part"]).withColumn("at", F.row_number().over(first)).where("at <= mine").select("row", "move")
        rounded = materialize(rounded.join(moves, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their columns; those with no copy are gone."""
    docs = stable(docs)
    row = fresh(docs, "row")
    times, copy = fresh(docs, "times"), fresh(docs, "copy")
    copies = mix(docs).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(times))
    return row_keyed(docs, row).join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), named(times)))).select(*map(named, docs.columns))
