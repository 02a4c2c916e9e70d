"""Signals, positions, profit and loss, and what is made of them. Rows are (sym_y, sym_x, bar_ts) with y, x, beta, z."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.quantiles import quantile_columns

from .blocks import running_last
from .pairs import PAIR, by_pair, hedge_ratios, spread_zscores, spreads
from .sequential import PART_SECONDS, Recursion, scanned_in_parts


def so_far():
    return by_pair().rowsBetween(Window.unboundedPreceding, 0)


def split_at(pairs: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Formation (before ts) and trading (from ts on)."""
    at = F.lit(ts).cast("timestamp_ntz")
    return pairs.where(F.col("bar_ts") < at), pairs.where(F.col("bar_ts") >= at)


def out_of_sample_spreads(pairs: DataFrame, ts: str) -> DataFrame:
    """Spreads of the trading period with ratios of the formation period alone."""
    formation, trading = split_at(pairs, ts)
    return spreads(trading, hedge_ratios(formation))


def walk_forward(pairs: DataFrame, form_days: int, trade_days: int) -> DataFrame:
    """fold and spreads of its trading days, ratios from its formation days alone. Folds start at the first bar's day and
    go on, trade_days apart, as long as there are bars to trade; they are a small table of dates."""
    days = lambda n: F.make_interval(days=n)
    ends = pairs.agg(F.date_trunc("day", F.min("bar_ts")).cast("timestamp_ntz").alias("first"), F.max("bar_ts").alias("last"))
    last_fold = F.floor((F.datediff("last", "first") - form_days) / trade_days).cast("int")
    f = ends.where(F.datediff("last", "first") >= form_days).select("first", F.explode(F.sequence(F.lit(0), last_fold)).alias("fold"))
    f = f.select("fold", (F.col("first") + days(F.col("fold") * trade_days)).alias("f0"))
    f = F.broadcast(f.withColumn("t0", F.col("f0") + days(F.lit(form_days))).withColumn("t1", F.col("f0") + days(F.lit(form_days + trade_days))))
    formed = pairs.join(f, (F.col("bar_ts") >= F.col("f0")) & (F.col("bar_ts") < F.col("t0")))
    beta = F.covar_pop("y", "x") / F.nullif(F.var_pop("x"), F.lit(0.0))
    ratios = formed.groupBy("fold", *PAIR).agg(beta.alias("beta"), (F.avg("y") - beta * F.avg("x")).alias("alpha"))
    traded = pairs.join(f, (F.col("bar_ts") >= F.col("t0")) & (F.col("bar_ts") < F.col("t1")))
    return traded.join(ratios, ["fold", *PAIR]).select("fold", *PAIR, "bar_ts", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("spread"))


def held(z: Column, entry: float | Column, leave: float | Column) -> Column:
    """1 below -entry, -1 above entry, 0 inside leave, else nothing new."""
    return F.when(z < -F.lit(entry), 1).when(z > F.lit(entry), -1).when(F.abs(z) < F.lit(leave), 0)


def positions(scored: DataFrame, entry: float = 1.0, leave: float = 0.5, part_seconds: int | None = None) -> DataFrame:
    """pos with hysteresis: the last decision carried on, in one window of a pair. With part_seconds, parts of a pair's time
    run at once, for pairs too long for a task; scored is read twice then."""
    if part_seconds:
        said = running_last(scored, held(F.col("z"), entry, leave), "_said", PAIR, "bar_ts", part_seconds)
        return said.withColumn("pos", F.coalesce("_said", F.lit(0)).cast("int")).drop("_said")
    return scored.withColumn("pos", F.coalesce(F.last(held(F.col("z"), entry, leave), ignorenulls=True).over(so_far()), F.lit(0)).cast("int"))


def guarded_rule(entry: float, leave: float, stop: float, most_bars: int) -> Recursion:
    """A finite automaton: flat, flat and locked, or a side held for 1 to most_bars bars (more bars act like most_bars). The
    map of rows is the table of the state behind each state."""
    states = [(0, 0, False), (0, 0, True), *((side, bars, False) for side in (1, -1) for bars in range(1, most_bars + 1))]
    place = {s: i for i, s in enumerate(states)}

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (pos, bars, locked), (z,) = state, row
        new = pos
        if z is not None:
            inside = abs(z) < leave
            cut = pos != 0 and (abs(z) > stop or bars >= most_bars)
            locked = (locked or cut) and not inside
            new = 0 if inside or locked else pos if pos else 1 if z < -entry else -1 if z > entry else 0
        bars = min(bars + 1, most_bars) if new and new == pos else 1 if new else 0
        return (new, bars, locked), (new,)

    def of_rows(columns: list[np.ndarray]) -> list[float]:
        none = np.array([v is None for v in columns[0]])
        z = np.array([0.0 if v is None else v for v in columns[0]], float)
        kind = np.where(none, -1, (np.abs(z) < leave) + 2 * (np.abs(z) > stop) + 4 * (z < -entry) + 8 * (z > entry))
        kinds, first, which = np.unique(kind, return_index=True, return_inverse=True)
        tables = np.array([[place[step(s, (columns[0][i],))[0]] for s in states] for i in first], np.int64)
        maps = tables[which]
        while len(maps) > 1:  # neighbours at a time
            odd = maps[-1:] if len(maps) % 2 else maps[:0]
            pairs = maps[: len(maps) // 2 * 2]
            maps = np.concatenate([np.take_along_axis(pairs[1::2], pairs[::2], 1), odd])
        return maps[0].astype(float).tolist()

    def composed(first: list[float], then: list[float]) -> list[float]:
        return [then[int(i)] for i in first]

    def passed(map_: list[float], state: tuple) -> tuple:
        return states[int(map_[place[tuple(state)]])]

    return Recursion((0, 0, False), step, "pos int", "_pos int, _bars int, _locked boolean", of_rows, composed, passed)


def guarded_positions(scored: DataFrame, entry: float = 1.0, leave: float = 0.5, stop: float = 2.0, most_bars: int = 5, part_seconds: int = PART_SECONDS) -> DataFrame:
    """Positions with a stop-loss lockout and a longest holding: after a stop or a time-out nothing is held until z comes
    back inside leave; a bar without z changes nothing. Parts of a series run at once."""
    return scanned_in_parts(scored.select(*PAIR, "bar_ts", "z"), PAIR, ("bar_ts",), ("z",), guarded_rule(entry, leave, stop, most_bars), part_seconds)


def guarded_reference(z: list[float | None], entry: float, leave: float, stop: float, most_bars: int) -> list[int]:
    """The same rule for one series, written out once more, for tests."""
    pos, bars, locked, out = 0, 0, False, []
    for v in z:
        if v is not None:
            inside = abs(v) < leave
            locked = (locked or pos != 0 and (abs(v) > stop or bars >= most_bars) and not inside) and not inside
            new = 0 if inside or locked else pos if pos else 1 if v < -entry else -1 if v > entry else 0
        else:
            new = pos
        bars = bars + 1 if new and new == pos else 1 if new else 0
        pos = new
        out.append(pos)
    return out


def pnl(traded: DataFrame, cost: float = 0.0) -> DataFrame:
    """Profit of the position held before, less cost for each change of it."""
    before = F.coalesce(F.lag("pos").over(by_pair()), F.lit(0))
    move = (F.col("y") - F.lag("y").over(by_pair())) - F.col("beta") * (F.col("x") - F.lag("x").over(by_pair()))
    return traded.withColumn("pnl", before * F.coalesce(move, F.lit(0.0)) - cost * F.abs(F.col("pos") - before))


def trades(earned: DataFrame) -> DataFrame:
    """One row per spell of one position: side, entry, exit (its last bar), bars held and profit up to the bar after."""
    changed = (F.col("pos") != F.coalesce(F.lag("pos").over(by_pair()), F.lit(0))).cast("int")
    next_pnl = F.coalesce(F.lead("pnl").over(by_pair()), F.lit(0.0))
    runs = earned.withColumns({"_c": changed, "_next": next_pnl}).withColumn("spell", F.sum("_c").over(so_far()))
    return runs.where("pos <> 0").groupBy(*PAIR, "spell").agg(F.min("bar_ts").alias("entry_ts"), F.max("bar_ts").alias("exit_ts"), F.max("pos").alias("side"), F.count("*").alias("bars"), F.sum("_next").alias("pnl"))


def equity(earned: DataFrame) -> DataFrame:
    """cum_pnl, drawdown (from the highest so far, 0 at the start) and max_drawdown (the deepest so far)."""
    cum = earned.withColumn("cum_pnl", F.sum("pnl").over(so_far()))
    cum = cum.withColumn("drawdown", F.col("cum_pnl") - F.greatest(F.max("cum_pnl").over(so_far()), F.lit(0.0)))
    return cum.withColumn("max_drawdown", F.min("drawdown").over(so_far()))


def performance(earned: DataFrame, per_year: int) -> DataFrame:
    """Per pair: sharpe, sortino, hit rate, turnover, exposure."""
    before = F.coalesce(F.lag("pos").over(by_pair()), F.lit(0))
    root, mean = math.sqrt(per_year), F.avg("pnl")
    down = F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), 2)))
    return earned.withColumn("_t", F.abs(F.col("pos") - before)).groupBy(*PAIR).agg(
        (root * mean / F.nullif(F.stddev_samp("pnl"), F.lit(0.0))).alias("sharpe"), (root * mean / F.nullif(down, F.lit(0.0))).alias("sortino"),
        (F.count_if(F.col("pnl") > 0) / F.nullif(F.count_if(F.col("pnl") != 0), F.lit(0))).alias("hit_rate"), F.sum("_t").cast("long").alias("turnover"), F.avg(F.abs("pos")).alias("exposure"),
    )


def tail_risk(earned: DataFrame, level: float) -> DataFrame:
    """Historical value at risk and expected shortfall of the bars' profit; nulls for a pair without any. Pairs with a null
    name are pairs like any other."""
    var = quantile_columns(earned, PAIR, "pnl", {"var": level}).withColumnsRenamed({c: f"_{c}" for c in PAIR})
    same = F.col("sym_y").eqNullSafe(F.col("_sym_y")) & F.col("sym_x").eqNullSafe(F.col("_sym_x"))
    return earned.join(var, same, "left").groupBy(*PAIR).agg(F.first("var").alias("value_at_risk"), F.avg(F.when(F.col("pnl") <= F.col("var"), F.col("pnl"))).alias("shortfall"))


def cross_section(panel: DataFrame, x: str = "x", group: str = "grp") -> DataFrame:
    """Rank, z, demeaned and group-neutral values among the symbols of a time."""
    t, g = Window.partitionBy("bar_ts"), Window.partitionBy("bar_ts", group)
    c = F.col(x)
    return panel.select(
        "bar_ts", "symbol", F.rank().over(t.orderBy(c.desc())).alias("rank"), ((c - F.avg(c).over(t)) / F.nullif(F.stddev_samp(c).over(t), F.lit(0.0))).alias("z"),
        (c - F.avg(c).over(t)).alias("demeaned"), (c - F.avg(c).over(g)).alias("neutral"),
    )


def long_short(panel: DataFrame, tiles: int, x: str = "x") -> DataFrame:
    """Equal weights: long the highest tile, short the lowest, each summing to one."""
    t = Window.partitionBy("bar_ts")
    tiled = panel.withColumn("tile", F.ntile(tiles).over(t.orderBy(F.col(x), "symbol")))
    tops, lows = F.count_if(F.col("tile") == tiles).over(t), F.count_if(F.col("tile") == 1).over(t)
    return tiled.select("bar_ts", "symbol", "tile", F.when(F.col("tile") == tiles, 1.0 / tops).when(F.col("tile") == 1, -1.0 / lows).otherwise(0.0).alias("weight"))


def capital(earned: DataFrame) -> DataFrame:
    """Weights of pairs that sum to one, inverse to the deviation of their profit; a pair without deviation gets none."""
    inverse = earned.groupBy(*PAIR).agg(F.coalesce(1.0 / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)), F.lit(0.0)).alias("_i"))
    total = inverse.agg(F.sum("_i").alias("_t"))  # one row
    return inverse.crossJoin(F.broadcast(total)).select(*PAIR, (F.col("_i") / F.nullif("_t", F.lit(0.0))).alias("weight"))


def portfolio(earned: DataFrame, weights: DataFrame) -> DataFrame:
    """Profit of all pairs by time: summed, with equal capital, and with the capital that weights (PAIR, weight) give."""
    each = earned.join(weights, list(PAIR), "left")
    return each.groupBy("bar_ts").agg(
        F.sum("pnl").alias("pnl"), F.avg("pnl").alias("pnl_per_pair"), F.sum(F.col("pnl") * F.coalesce("weight", F.lit(0.0))).alias("pnl_weighted"), F.count_if(F.col("pos") != 0).cast("long").alias("open_pairs"),
    )


def sweep(spread: DataFrame, grid: list[tuple[int, float, float]], cost: float) -> DataFrame:
    """Total profit of every pair under every (n, entry, leave) of a small grid, which is broadcast; z is scored once for each n."""
    g = spread.sparkSession.createDataFrame(grid, "n int, entry double, leave double")
    scored = reduce(DataFrame.unionByName, (spread_zscores(spread, n).withColumn("n", F.lit(n)) for n in sorted({n for n, _, _ in grid})))
    each = scored.join(F.broadcast(g), "n")
    w = Window.partitionBy(*PAIR, "n", "entry", "leave").orderBy("bar_ts")
    pos = F.coalesce(F.last(held(F.col("z"), F.col("entry"), F.col("leave")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int")
    each = each.withColumn("pos", pos)
    before = F.coalesce(F.lag("pos").over(w), F.lit(0))
    move = (F.col("y") - F.lag("y").over(w)) - F.col("beta") * (F.col("x") - F.lag("x").over(w))
    each = each.withColumn("pnl", before * F.coalesce(move, F.lit(0.0)) - cost * F.abs(F.col("pos") - before))
    return each.groupBy(*PAIR, "n", "entry", "leave").agg(F.sum("pnl").alias("pnl"))
