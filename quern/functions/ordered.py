"""Ordered work inside groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole group in one task. The helpers here look at group
sizes first (one pre-aggregated count) and keep the plain window while every group fits in a task.
Groups above ``limit`` rows are cut into ordered chunks: windows run per (key, chunk) and what must
cross a chunk border (prefix sums, last values, neighbour rows) travels in small per-chunk summaries.
Cut points are picked by a hash of the rows' place, so both branches of a plan see the same chunks.

A plan on the large path uses its input several times (sizes, cut points, summaries, rows). The input, the cut points and
the summaries are therefore written once as an order index in the shared folder (``session.stored``) and read from
there: what came before is computed twice at most (to count it, to write it), however long the chain of operators is.

``lead`` is a numeric column that never decreases along ``order``; ``order`` are column names,
ascending, that together order the rows of a group completely.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import stored

ROWS_PER_TASK = 2_000_000
RANKED_ROWS = 250_000  # above this, ranks come from counts per distinct value: windows over ties hold a group several times
REPEATS = 8  # rows per distinct value, from which on rows are numbered value by value
CUTS = 4  # cut points per ROWS_PER_TASK rows of a large group
UNKNOWN = object()  # group sizes not looked at yet; pass the result of hot_groups to look only once
CHUNK = "_chunk"
TILE = "_tile"
_names = itertools.count()


def window(keys: Sequence[str]):
    return Window.partitionBy(*[F.col(k) for k in keys])


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def quoted(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False) -> DataFrame:
    """Null-safe join on ``keys`` that keeps one copy of the keys."""
    mine = {k: f"_key{next(_names)}" for k in keys}  # no name of a caller's column, nor of an earlier join
    right = b.select(*[quoted(k).alias(n) for k, n in mine.items()], *[quoted(c) for c in b.columns if c not in keys])
    cond = F.lit(True)
    for k, n in mine.items():
        cond = cond & quoted(k).eqNullSafe(F.col(n))
    if small:
        right = F.broadcast(right)
    return a.join(right, cond, how).drop(*mine.values())


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> tuple[DataFrame, int, int] | None:
    """Groups above ``limit`` rows as (frame of keys and n, limit, largest n), None if there are none."""
    limit = limit or ROWS_PER_TASK
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n")).first()[0]
    if not top or top <= limit:
        return None
    return counts.where(F.col("_n") > limit), limit, top


def chunked(df: DataFrame, keys: Sequence[str], lead: Column, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame | None:
    """``df`` with an ordered chunk number for rows of hot groups (0 elsewhere); None when nothing is hot.

    Cut points are rows of the group itself, picked by a hash of their place, ``CUTS`` per ``limit`` rows on average:
    a group has as many pieces as its size asks for, and rows that tie on ``lead`` are cut by the rest of ``order``.
    Nulls come first, as in an ascending window. Rows and cut points are written once and read from there.
    """
    limit = limit or ROWS_PER_TASK
    if hot_groups(df, keys, limit) is None:
        return None
    df = stored(df)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    rows = df.withColumn("_place", F.struct(lead.cast("double").alias("l"), *[quoted(c).alias(f"o{i}") for i, c in enumerate(order)]))
    inside = join_keys(rows, hot.drop("_n"), keys, "left_semi") if keys else rows
    step = max(1, limit // CUTS)
    picked = inside.where(F.pmod(F.xxhash64(F.col("_place").cast("string")), F.lit(step)) == 0)
    sorted_cuts = picked.groupBy(*keys).agg(F.array_sort(F.collect_set("_place")).alias("_c"))
    size = F.greatest(F.ceil(F.sqrt(F.size("_c"))), F.lit(1)).cast("int")
    blocks = F.ceil(F.size("_c") / F.col("_size")).cast("int")
    last = lambda i: F.element_at("_c", F.least((i + 1) * F.col("_size"), F.size("_c")))
    bounds = sorted_cuts.withColumn("_size", size).withColumn("_blocks", blocks)
    bounds = bounds.select(
        *keys,
        F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), last).alias("_coarse"),
        F.transform(F.sequence(F.lit(0), F.col("_blocks")), lambda i: F.slice("_c", i * F.col("_size") + 1, F.col("_size"))).alias("_fine"),
        "_size",
    )
    # without keys there is one row of cut points; else the planner looks at their size
    rows = join_keys(rows, stored(bounds), keys, "left", small=not keys)
    rows = rows.withColumn("_block", F.size(F.filter("_coarse", lambda b: b < F.col("_place"))))
    inner = F.size(F.filter(F.element_at("_fine", F.col("_block") + 1), lambda b: b < F.col("_place")))
    rows = rows.withColumn(CHUNK, F.when(F.col("_coarse").isNull(), 0).otherwise(F.col("_block") * F.col("_size") + inner))
    return rows.drop("_place", "_coarse", "_fine", "_size", "_block")


def running(
    df: DataFrame,
    keys: Sequence[str],
    lead: Column,
    order: Sequence[str],
    sums: dict[str, Column],
    limit: int | None = None,
) -> DataFrame:
    """Inclusive prefix sums of each expression along the order of its group."""
    spread = chunked(df, keys, lead, limit, order)
    if spread is None:
        w = window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(e).over(w) for n, e in sums.items()})
    part = [*keys, CHUNK]
    w = window(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumns({n: F.sum(e).over(w) for n, e in sums.items()})
    before = window(keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        spread.groupBy(*part)
        .agg(*[F.sum(e).alias(f"_b_{n}") for n, e in sums.items()])
        .withColumns({f"_b_{n}": F.sum(f"_b_{n}").over(before) for n in sums})
        .where(F.col(CHUNK) > 0)  # only chunks of hot groups
    )
    out = join_keys(local, stored(base), part, "left")
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in sums}).drop(
        CHUNK, *[f"_b_{n}" for n in sums]
    )


def numbered(
    df: DataFrame, keys: Sequence[str], lead: Column, order: Sequence[str], name: str = "rn", limit: int | None = None
) -> DataFrame:
    """Row number 1..n along the order of the group, for groups of any size."""
    return running(df, keys, lead, order, {name: F.lit(1).cast("long")}, limit)


def carried(
    df: DataFrame,
    keys: Sequence[str],
    lead: Column,
    order: Sequence[str],
    cols: dict[str, Column],
    reverse: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Last non-null value at or before each row (``reverse``: first non-null value at or after it)."""
    # backwards is the same carry over descending order: a frame that grows is cheap, one that shrinks is
    # evaluated anew for every row
    direction = [F.desc(c) if reverse else F.asc(c) for c in order]
    spread = chunked(df, keys, lead, limit, order)
    if spread is None:
        w = window(keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.last(e, ignorenulls=True).over(w) for n, e in cols.items()})
    part = [*keys, CHUNK]
    w = window(part).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumns({n: F.last(e, ignorenulls=True).over(w) for n, e in cols.items()})
    best = F.min_by if reverse else F.max_by
    place = F.struct(*[F.col(c) for c in order])
    edge = spread.groupBy(*part).agg(
        *[best(e, F.when(e.isNotNull(), place)).alias(f"_e_{n}") for n, e in cols.items()]
    )
    outer = window(keys).orderBy(F.desc(CHUNK) if reverse else F.asc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    multi = edge.withColumns({f"_e_{n}": F.last(F.col(f"_e_{n}"), ignorenulls=True).over(outer) for n in cols})
    # a group with one chunk needs nothing from outside: keep rows of groups that have a chunk above 0
    multi = multi.withColumn("_hot", F.max(CHUNK).over(window(keys)) > 0).where("_hot").drop("_hot")
    out = join_keys(local, stored(multi), part, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"_e_{n}")) for n in cols}).drop(
        CHUNK, *[f"_e_{n}" for n in cols]
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    lead: Column,
    order: Sequence[str],
    before: int,
    after: int,
    build: Callable[[object], dict[str, Column]],
    limit: int | None = None,
    found: object = UNKNOWN,
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` rows ahead.

    ``build`` gets a window spec (partitioned and ordered, no frame) and returns the columns. Hot groups
    are cut into tiles of equal row count; each tile also gets copies of the neighbour rows it looks at.
    """
    limit = limit or ROWS_PER_TASK
    found = hot_groups(df, keys, limit) if found is UNKNOWN else found
    if found is None:
        return df.withColumns(build(window(keys).orderBy(*order)))
    tile = max(limit, before + after + 1)
    rows = numbered(df, keys, lead, order, "_rn", limit).withColumn("_rn", F.col("_rn") - 1)
    home = F.floor(F.col("_rn") / tile)
    offset = F.col("_rn") - home * tile
    copies = F.array_compact(
        F.array(
            home,
            F.when((offset < after) & (home > 0), home - 1),
            F.when(offset >= tile - before, home + 1),
        )
    )
    rows = rows.withColumn("_home", home).withColumn(TILE, F.explode(copies))
    out = rows.withColumns(build(window([*keys, TILE]).orderBy(*order)))
    return out.where(F.col(TILE) == F.col("_home")).drop(TILE, "_home", "_rn")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    limit: int | None = None,
    found: object = UNKNOWN,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: ``{out: (column, probability)}``.

    Groups above ``limit`` rows are first reduced to distinct values with counts and read off prefix sums.
    """
    limit = limit or ROWS_PER_TASK
    by_col: dict[str, list[tuple[str, float]]] = {}
    for out, (c, p) in wanted.items():
        by_col.setdefault(c, []).append((out, p))
    found = hot_groups(df, keys, limit) if found is UNKNOWN else found
    if found is None:
        arrays = [F.percentile(F.col(c).cast("double"), F.array(*[F.lit(float(p)) for _, p in ps])).alias(f"_q{i}")
                  for i, (c, ps) in enumerate(by_col.items())]
        got = df.groupBy(*keys).agg(*arrays)
        picks = [F.col(f"_q{i}")[j].alias(out) for i, ps in enumerate(by_col.values()) for j, (out, _) in enumerate(ps)]
        return got.select(*keys, *picks)
    df = stored(df.select(*[quoted(c) for c in dict.fromkeys([*keys, *by_col])]))
    result = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    for c, ps in by_col.items():
        vals = df.select(*keys, F.col(c).cast("double").alias("_v")).where("_v IS NOT NULL")
        counts = stored(vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k")))
        cum = running(counts, keys, F.col("_v"), ["_v"], {"_cum": F.col("_k")}, limit)
        size = counts.groupBy(*keys).agg(F.sum("_k").alias("_n"))
        cum = join_keys(cum, size, keys) if keys else cum.withColumn("_n", size.scalar())
        aggs = []
        for i, (_, p) in enumerate(ps):
            pos = F.lit(float(p)) * (F.col("_n") - 1)
            start = F.col("_cum") - F.col("_k")
            for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
                aggs.append(F.max(F.when((start <= at) & (at < F.col("_cum")), F.col("_v"))).alias(f"_{tag}{i}"))
        got = cum.groupBy(*keys).agg(*aggs, F.max("_n").alias("_n"))
        values = []
        for i, (out, p) in enumerate(ps):
            pos = F.lit(float(p)) * (F.col("_n") - 1)
            values.append((F.col(f"_lo{i}") + (pos - F.floor(pos)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(out))
        result = join_keys(result, got.select(*keys, *values), keys)
    return stored(result.select(*keys, *[quoted(w) for w in wanted]))


def numbered_ties(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "rn", limit: int | None = None) -> DataFrame:
    """Row number 1..n along (value, tie), for groups of any size.

    Where groups are large and their values repeat, rows are numbered among those of their value and the rows of smaller
    values are added: no row is cut into chunks and only counts are summed along the order.
    """
    limit = limit or ROWS_PER_TASK
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(value).alias("d")).where(F.col("n") > limit)
    n, d = seen.agg(F.min("n"), F.max("d")).first()
    if n is None or d * REPEATS > n:
        return numbered(df, keys, F.col(value), [value, tie], name, limit)
    df = stored(df)
    counts = stored(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k")))
    if counts.agg(F.max("_k")).first()[0] > limit:
        return numbered(df, keys, F.col(value), [value, tie], name, limit)
    before = running(counts, keys, F.col(value), [value], {"_before": F.col("_k")}, limit)
    rows = df.withColumn(name, F.row_number().over(window([*keys, value]).orderBy(tie)).cast("long"))
    rows = join_keys(rows, before.select(*keys, value, (F.col("_before") - F.col("_k")).alias("_before")), [*keys, value])
    return rows.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, pct: bool = False, limit: int | None = None) -> DataFrame:
    """(keys, value, rank): the averaged rank of each distinct value, from its count. ``df`` must not change between reads."""
    v = F.col(value)
    counts = stored(df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k")))
    cum = running(counts, keys, v, [value], {"_cum": F.col("_k")}, limit)
    rank = F.col("_cum") - F.col("_k") + (F.col("_k") + 1) / 2.0
    if pct:
        size = counts.groupBy(*keys).agg(F.sum("_k").alias("_n"))
        cum = join_keys(cum, size, keys) if keys else cum.withColumn("_n", size.scalar())
        rank = rank / F.col("_n")
    return cum.select(*keys, value, rank.alias(out))


def ranked_rows(limit: int | None = None) -> int:
    """Rows of a group above which ranks come from counts."""
    return limit or min(RANKED_ROWS, ROWS_PER_TASK)


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", pct: bool = False, limit: int | None = None
) -> DataFrame:
    """Rank from 1 with ties averaged, optionally divided by the group's non-null count."""
    v = F.col(value)
    if hot_groups(df, keys, ranked_rows(limit)) is None:
        ties = Window.partitionBy(*[F.col(k) for k in keys], v)
        r = F.rank().over(window(keys).orderBy(v.asc_nulls_last())) + (F.count(v).over(ties) - 1) / 2.0
        r = r / F.count(v).over(window(keys)) if pct else r
        return df.withColumn(out, F.when(v.isNotNull(), r))
    df = stored(df)
    return join_keys(df, value_ranks(df, keys, value, out, pct, limit), [*keys, value])


def hash_lead(col: Column) -> Column:
    """Number in the order of a lower-case hex digest."""
    return F.conv(F.substring(col, 1, 12), 16, 10).cast("double")


def digest(*cols: Column | str, seed: int | str = 0) -> Column:
    """md5 of the values and a seed: a reproducible random order."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))
