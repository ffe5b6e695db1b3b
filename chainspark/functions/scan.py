"""Ordered scans that never gather a hot key into one task.

A plain window sorts every row of a key in one task, so one oversized match or player stops the
job. Here rows are dealt and windowed by (key, chunk), where ``chunk`` is a column that is
non-decreasing in the scan order (an index divided by a constant, a date). One total per (key, chunk)
comes from an aggregate with map-side combine that reads only keys, chunk and values; the totals are
windowed over the chunks of their key, and what a chunk carries from its neighbours is joined on
(key, chunk), as the rows are dealt already. Hot keys and others take this one path; keys with
one chunk drop out of the carry before that join. Where the order is a draw, chunks cannot be told before the size
of the key is: there ``chunk`` is a function of the size, and keys above a row limit
(``spark.chainspark.hotRows``, one million by default; at most rows/limit keys, which bounds what is broadcast)
are cut, and the carry is of these keys only. Results are exact for every limit and chunking; ``chunk=None`` is the plain window, for
groups whose size is bounded by construction (states, replicates).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000

_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Running:
    """One running aggregate: over the rows before (or after) the current one."""

    name: str
    fn: str
    value: Column
    inclusive: bool = False
    reverse: bool = False


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the right side's keys are dropped."""
    named = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def _order(order, reverse: bool):
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _combine(fn: str, outer: Column, inner: Column) -> Column:
    if fn in ("sum", "count"):
        return F.coalesce(outer, F.lit(0)) + F.coalesce(inner, F.lit(0))
    pick = F.least if fn == "min" else F.greatest
    return pick(outer, inner)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk=None,
         outs: list[Running] = (), totals: dict[str, tuple[str, Column]] | None = None,
         after: dict[str, Column] | None = None, before: dict[str, Column] | None = None,
         cut: Column | None = None) -> DataFrame:
    """Running aggregates, whole-key totals and neighbour values in one pass.

    All windows share a single (keys, chunk) exchange; ask for everything at once rather than
    nesting scans. ``cut`` is true for the rows of keys above the row limit when only these have
    several chunks: the carry is theirs alone, and small. A chunk given by its column's name leaves the rows
    dealt by the keys and that column, which a join on them can use.
    """
    totals, after, before = totals or {}, after or {}, before or {}
    names = df.columns
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    sides = [(1, after, "__after"), (-1, before, "__before")]
    final = [*names, *[o.name for o in outs], *totals, *after, *before]

    if not outs and not after and not before:
        whole = df.groupBy(*keys).agg(*[_AGG[fn](v).alias(n) for n, (fn, v) in totals.items()])
        return same_keys(df, whole, keys).select(*names, *totals)

    d = df
    group = list(keys)
    part = chunk if isinstance(chunk, str) else "__chunk"
    if chunk is not None:
        if callable(chunk):
            limit = int(df.sparkSession.conf.get("spark.chainspark.hotRows", str(HOT_ROWS)))
            hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > limit)
            d = same_keys(d, F.broadcast(hot), keys, "left")
            cut = F.col("__rows").isNotNull()
            d = d.withColumn("__chunk", F.when(cut, chunk(F.col("__rows"))))
        elif not isinstance(chunk, str):
            d = d.withColumn("__chunk", chunk)
        aggs = [_AGG[o.fn](o.value).alias(f"__t_{o.name}") for o in outs]
        aggs += [_AGG[fn](v).alias(f"__s_{n}") for n, (fn, v) in totals.items()]
        for step, cols, tag in sides:
            if cols:
                edge = F.min_by if step == 1 else F.max_by
                own = F.struct(*[v.alias(n) for n, v in cols.items()])
                aggs.append(edge(own, F.struct(*order)).alias(f"{tag}_e"))
        per_chunk = (d if cut is None else d.filter(cut)).groupBy(*keys, part).agg(F.lit(True).alias("__cut"), *aggs)
        whole = Window.partitionBy(*keys)
        cols_out = [F.count(F.lit(1)).over(whole).alias("__chunks")]
        for o in outs:
            w = whole.orderBy(*_order([part], o.reverse)).rowsBetween(
                Window.unboundedPreceding, -1)
            merge = F.sum if o.fn == "count" else _AGG[o.fn]
            cols_out.append(merge(F.col(f"__t_{o.name}")).over(w).alias(f"__o_{o.name}"))
        for n, (fn, _) in totals.items():
            merge = F.sum if fn == "count" else _AGG[fn]
            cols_out.append(merge(F.col(f"__s_{n}")).over(whole).alias(f"__w_{n}"))
        for step, cols, tag in sides:
            if cols:
                near = F.lead if step == 1 else F.lag
                cols_out.append(near(f"{tag}_e").over(whole.orderBy(part)).alias(f"{tag}_c"))
        # null chunks and null keys are chunks and keys like others; a key with one chunk carries nothing
        carry = per_chunk.select(*keys, part, "__cut", *cols_out).filter("__chunks > 1").drop("__chunks")
        if cut is not None:
            # the chunks of keys above the limit: a few for each limit's worth of rows
            d = same_keys(d.drop("__rows"), F.broadcast(carry), [*keys, part], "left")
            group.append(part)
        else:
            # one struct is the key of the join and of the windows, so rows are dealt once; equal structs
            # may hold nulls
            dealt = F.struct(*keys, part)
            d = d.withColumn("__g", dealt).drop(*keys, part)
            carry = carry.withColumn("__g", dealt).drop(*keys, part)
            d = d.join(carry, "__g", "left")
            for c in (*keys, part):
                d = d.withColumn(c, F.col("__g")[c])
            group = ["__g"]
    for n, (fn, v) in totals.items():
        own = _AGG[fn](v).over(Window.partitionBy(*group))
        d = d.withColumn(n, own if chunk is None else
                         F.when(F.col("__cut"), F.col(f"__w_{n}")).otherwise(own))
    for o in outs:
        w = Window.partitionBy(*group).orderBy(*_order(order, o.reverse)).rowsBetween(
            Window.unboundedPreceding, 0 if o.inclusive else -1)
        inner = _AGG[o.fn](o.value).over(w)
        outer = F.col(f"__o_{o.name}") if chunk is not None else F.lit(None)
        if chunk is None:
            value = F.coalesce(inner, F.lit(0)) if o.fn in ("sum", "count") else inner
        else:
            value = _combine(o.fn, outer, inner)
        d = d.withColumn(o.name, value)
    near_cols = {}
    for step, cols, tag in sides:
        w = Window.partitionBy(*group).orderBy(*order)
        near = F.lead if step == 1 else F.lag
        for n, v in cols.items():
            # columns are taken one by one, so none is copied into the rows that are dealt
            value = near(v).over(w)
            near_cols[n] = value if chunk is None else F.when(near(F.lit(True)).over(w), value).otherwise(F.col(f"{tag}_c")[n])
    return d.select(*[c for c in final if c not in near_cols], *[v.alias(n) for n, v in near_cols.items()]).select(*final)


def running(df: DataFrame, keys: list[str], order: list[str], outs: list[Running],
            chunk=None, totals=None) -> DataFrame:
    """Running aggregates (and whole-key totals) only."""
    return scan(df, keys, order, chunk, outs, totals)


def position(df: DataFrame, keys: list[str], order: list[str], chunk=None,
             index: str = "k", size: str | None = None) -> DataFrame:
    """1-based position inside the key, and optionally the size of the key."""
    one = F.lit(1)
    return scan(df, keys, order, chunk, [Running(index, "count", one, inclusive=True)],
                {size: ("count", one)} if size else None)


def neighbour(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, Column],
              offset: int = 1, chunk=None) -> DataFrame:
    """Values of the next (offset=1) or previous (offset=-1) row of the key; null at the end."""
    assert offset in (1, -1)
    return scan(df, keys, order, chunk, after=cols if offset == 1 else None,
                before=cols if offset == -1 else None)


def exact_quantile(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                   grid: int = 1000) -> DataFrame:
    """Exact linear-interpolation quantiles per key, for groups of any size.

    Keys below the row limit (``spark.chainspark.hotRows``) are aggregated exactly as they are. For a larger key
    each order statistic is selected in passes: a sketch of the values inside an open range gives two
    edges around the rank, the next pass counts what lies below, at, between and above them (map-side) and
    sketches what lies between, and the range shrinks to about 3/``grid`` of its rows. An edge that holds the rank
    is the answer, so a value may fill any share of the rows; ranges below the limit are
    fetched. State is a few numbers per rank of a hot key: at most rows/limit keys.
    Null values don't count; a key of only such has no row.
    """
    spark = df.sparkSession
    d = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    limit = int(spark.conf.get("spark.chainspark.hotRows", str(HOT_ROWS)))
    names, levels = list(probs), list(probs.values())
    hot = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).collect()
    small = d
    if hot:
        known = spark.createDataFrame([(*tuple(r)[:-1], True) for r in hot], ", ".join([*_key_schema(d, keys), "__hot boolean"]))
        small = same_keys(d, F.broadcast(known), keys, "left").filter("__hot IS NULL").drop("__hot")
    out = small.groupBy(*keys).agg(F.percentile("v", F.array(*[F.lit(p) for p in levels])).alias("q"))
    out = out.filter("q IS NOT NULL").select(*keys, *[F.col("q")[k].alias(name) for k, name in enumerate(names)])
    if not hot:
        return out
    ranks = {i: sorted({int(f(p * (r["n"] - 1))) for p in levels for f in (math.floor, math.ceil)}) for i, r in enumerate(hot)}
    found = _select(d, keys, {(i, r): tuple(hot[i])[:-1] for i, of in ranks.items() for r in of}, [r["n"] for r in hot], limit, grid)
    rows = []
    for i, r in enumerate(hot):
        cells = []
        for p in levels:
            at = p * (r["n"] - 1)
            low, high = found[i, math.floor(at)], found[i, math.ceil(at)]
            cells.append(low + (high - low) * (at - math.floor(at)))
        rows.append((*tuple(r)[:-1], *cells))
    return out.unionByName(spark.createDataFrame(rows, ", ".join([*_key_schema(d, keys), *[f"`{n}` double" for n in names]])))


def _key_schema(d: DataFrame, keys: list[str]) -> list[str]:
    return [f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys]


def _select(d: DataFrame, keys: list[str], targets: dict[tuple[int, int], tuple], sizes: list[int], limit: int,
            grid: int) -> dict[tuple[int, int], float]:
    """Order statistics (key number, 0-based rank) of the keys' values v, by narrowing ranges."""
    spark, inf = d.sparkSession, float("inf")
    cuts = F.array(*[F.lit(k / grid) for k in range(1, grid)])
    schema = ", ".join([*_key_schema(d, keys), "i int, r bigint, lo double, e1 double, e2 double, hi double"])
    # open range, rows at or below its start, rows inside, sketch of what is inside
    state = {t: [-inf, inf, 0, sizes[t[0]], None] for t in targets}
    done: dict[tuple[int, int], float] = {}
    while True:
        wide = {t: s for t, s in state.items() if s[3] > limit}
        if not wide:
            break
        rows = []
        for (i, r), (lo, hi, below, inside, sketch) in wide.items():
            e1, e2 = lo, hi
            if sketch:
                at = (r - below + 0.5) / inside * grid
                e1 = sketch[int(at) - 2] if at >= 2 else lo
                e2 = sketch[int(at) + 1] if at + 1 < grid - 1 else hi
            rows.append((*targets[i, r], i, r, lo, e1, e2, hi))
        v, lo, e1, e2, hi = (F.col(c) for c in ("v", "lo", "e1", "e2", "hi"))
        inner = (v > e1) & (v < e2)
        asked = same_keys(d, F.broadcast(spark.createDataFrame(rows, schema)), keys).filter((v > lo) & (v < hi))
        counted = asked.groupBy("i", "r").agg(
            F.count_if(v < e1).alias("below"), F.count_if((v == e1) & (e1 > lo)).alias("first"), F.count_if(inner).alias("inside"),
            F.count_if((v == e2) & (e2 > e1) & (e2 < hi)).alias("last"),
            F.percentile_approx(F.when(inner, v), cuts, 10 * grid).alias("sketch")).collect()
        edges = {(row[-6], row[-5]): row[-4:] for row in rows}
        for c in counted:
            t = (c["i"], c["r"])
            lo, e1, e2, hi = edges[t]
            below, inside = state[t][2:4]
            left = t[1] - below
            for start, end, n, sketch in ((lo, e1, c["below"], None), (e1, e1, c["first"], None), (e1, e2, c["inside"], c["sketch"]),
                                          (e2, e2, c["last"], None), (e2, hi, inside - c["below"] - c["first"] - c["inside"] - c["last"], None)):
                if left < n:
                    break
                left, below = left - n, below + n
            if start == end:
                done[t] = start
                del state[t]
            else:
                state[t] = [start, end, below, n, sketch]
    if state:
        rows = [(*targets[t], *t, s[0], s[1], s[2]) for t, s in state.items()]
        last = ", ".join([*_key_schema(d, keys), "i int, r bigint, lo double, hi double, below bigint"])
        asked = same_keys(d, F.broadcast(spark.createDataFrame(rows, last)), keys).filter("v > lo AND v < hi")
        at = (F.col("r") - F.col("below") + 1).cast("int")
        picked = asked.groupBy("i", "r", "below").agg(F.sort_array(F.collect_list("v")).alias("v"))
        done |= {(c["i"], c["r"]): c["x"] for c in picked.select("i", "r", F.element_at("v", at).alias("x")).collect()}
    return done
