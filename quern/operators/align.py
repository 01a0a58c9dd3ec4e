"""Order-dependent work along a series: step limiting, path decoding, window matching, periodic denoising.

Each entity is one pass in order. Entities of ordinary length are one group each; an entity above the row
limit is cut into ordered chunks that are decoded round by round, handing a small state forward and, for
path decoding, the chosen end state backward. No task ever holds more than one chunk of an entity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.mathx import clip
from quern.functions.ordered import CHUNK, ROWS_PER_TASK, chunked, framed, hot_groups, join_keys, numbered, quantiles
from quern.session import cut_lineage

# forward(payload, state, rows) -> state; backward(payload, state, rows, choice) -> (values, choice)
Forward = Callable[[object, object, pd.DataFrame], object]
Backward = Callable[[object, object, pd.DataFrame, object], tuple[np.ndarray, object]]


def decode(df: DataFrame, entity: str, pos: str, uid: str, cols: Sequence[str], payload: DataFrame, forward: Forward, backward: Backward, limit: int | None = None) -> DataFrame:
    """(entity, uid, value): the decoded value of every row. ``payload``: one row (entity, payload) per entity."""
    limit = limit or ROWS_PER_TASK
    rows = df.select(entity, F.col(uid).cast("long").alias("_u"), F.col(pos).cast("double").alias("_p"), *[F.col(c).cast("double").alias(c) for c in cols])
    # fresh column identities: the payload usually comes from the same table
    payload = payload.select(F.col(entity).alias("_e"), F.col("payload").alias("_y")).select(F.col("_e").alias(entity), F.col("_y").alias("payload"))
    keytype = dict(df.dtypes)[entity]
    schema = f"`{entity}` {keytype}, _u long, value double"

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["_p", "_u"], kind="stable")

    def whole(pdf: pd.DataFrame, pay: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({entity: [], "_u": [], "value": []})
        pdf = ordered(pdf)
        values, _ = backward(pay["payload"].iloc[0] if len(pay) else None, None, pdf, None)
        return pd.DataFrame({entity: pdf[entity], "_u": pdf["_u"], "value": values})

    def finish(x: DataFrame) -> DataFrame:
        return x.select(entity, F.col("_u").alias(uid), "value")

    found = hot_groups(rows, [entity], limit)
    if found is None:
        return finish(rows.groupBy(entity).cogroup(payload.groupBy(entity)).applyInPandas(whole, schema))

    hot = found[0].select(entity)
    plain = rows.join(F.broadcast(hot), entity, "left_anti")  # hot_groups bounds their number
    out = plain.groupBy(entity).cogroup(payload.join(F.broadcast(hot), entity, "left_anti").groupBy(entity)).applyInPandas(whole, schema)
    cut = chunked(rows.join(F.broadcast(hot), entity, "left_semi"), [entity], F.col("_p"), limit)
    cut = cut_lineage(cut)
    n = cut.agg(F.max(CHUNK)).first()[0] + 1
    start = payload.join(F.broadcast(hot), entity, "left_semi").withColumn("state", F.lit(None).cast("binary"))
    carry = f"`{entity}` {keytype}, state binary"

    def step(pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        raw = st["state"].iloc[0]
        if not pdf.empty:
            raw = pickle.dumps(forward(st["payload"].iloc[0], pickle.loads(raw) if raw is not None else None, ordered(pdf)))
        return pd.DataFrame({entity: [st[entity].iloc[0]], "state": [raw]})

    states = [start]
    for c in range(n - 1):
        nxt = cut.where(F.col(CHUNK) == c).groupBy(entity).cogroup(states[-1].groupBy(entity)).applyInPandas(step, carry)
        states.append(payload.join(cut_lineage(nxt), entity))

    def trace(pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        raw, ch = st["state"].iloc[0], st["choice"].iloc[0]
        if pdf.empty:
            return pd.DataFrame({entity: [st[entity].iloc[0]], "_u": [None], "value": [None], "choice": [ch]})
        pdf = ordered(pdf)
        values, choice = backward(st["payload"].iloc[0], pickle.loads(raw) if raw is not None else None, pdf, pickle.loads(ch) if ch is not None else None)
        res = pd.DataFrame({entity: pdf[entity], "_u": pdf["_u"], "value": values, "choice": None})
        return pd.concat([res, pd.DataFrame({entity: [pdf[entity].iloc[0]], "_u": [None], "value": [None], "choice": [pickle.dumps(choice)]})])

    choice = hot.withColumn("choice", F.lit(None).cast("binary"))
    for c in reversed(range(n)):
        st = states[c].join(choice, entity)
        got = cut.where(F.col(CHUNK) == c).groupBy(entity).cogroup(st.groupBy(entity)).applyInPandas(trace, schema + ", choice binary")
        got = cut_lineage(got)
        choice = got.where("_u IS NULL").select(entity, "choice")
        out = out.unionByName(got.where("_u IS NOT NULL").drop("choice"))
    return finish(out)


def step_limit(df: DataFrame, entity: str, pos: str, uid: str, col: str, max_step: float = 2.5, limit: int | None = None) -> DataFrame:
    """Each value moves at most ``max_step`` away from the limited value before it."""

    def run(state: object, pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[col].to_numpy(float)
        y = np.empty(len(x))
        last = state
        for i, v in enumerate(x):
            last = v if last is None else last + min(max(v - last, -max_step), max_step)
            y[i] = last
        return y

    payload = df.select(entity).distinct().withColumn("payload", F.lit(0))
    return decode(
        df, entity, pos, uid, [col], payload, lambda pay, st, pdf: float(run(st, pdf)[-1]), lambda pay, st, pdf, ch: (run(st, pdf), None), limit
    )


def feature_bank(df: DataFrame, entity: str, pos: str, uid: str, col: str, limit: int | None = None) -> DataFrame:
    """Locally normalised views of a series: raw and smoothed z-scores and a robust slope of the smoothed series."""
    found = hot_groups(df, [entity], limit or ROWS_PER_TASK)  # all steps see the same groups
    med = quantiles(df, [entity], {"_med": (col, 0.5)}, limit, found)
    rows = join_keys(df, med, [entity]).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    rows = join_keys(rows, quantiles(rows, [entity], {"_mad": ("_dev", 0.5)}, limit, found), [entity])
    scale = F.greatest(1.4826 * F.col("_mad"), F.lit(1e-3))

    def build(w) -> dict[str, Column]:
        wide, small = w.rowsBetween(-30, 30), w.rowsBetween(-10, 10)
        return {
            "_m": F.avg(col).over(wide), "_s": F.stddev_samp(col).over(wide), "_q": F.avg(col).over(small),
            "_a": F.avg(col).over(w.rowsBetween(-11, 9)), "_b": F.avg(col).over(w.rowsBetween(-9, 11)),
        }

    rows = framed(rows, [entity], F.col(pos), [pos, uid], 30, 30, build, limit, found)
    sd = F.greatest(F.coalesce("_s", F.lit(0.0)), 0.25 * scale)
    z = lambda c: clip((F.col(c) - F.col("_m")) / sd, -5.0, 5.0)
    rows = rows.withColumns({"f_raw": z(col), "f_smooth": z("_q"), "f_slope": clip((F.col("_b") - F.col("_a")) / 2 / scale, -5.0, 5.0)})
    return rows.drop("_med", "_dev", "_mad", "_m", "_s", "_q", "_a", "_b")


def _grid(payload, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    g = payload["grid"]
    return np.array([r["x"] for r in g], float), np.array([[r[c] for c in cols] for r in g], float)


def beam(rows: DataFrame, payload: DataFrame, entity: str, pos: str, uid: str, col: str, width: int = 12, radius: int = 2, penalty: float = 8.0, scale: float = 80.0, limit: int | None = 200_000) -> DataFrame:
    """Beam search over grid positions: squared value error plus a penalty per grid step; best ``width`` paths kept."""
    moves = np.arange(-radius, radius + 1)

    def sweep(pay, state, pdf):
        grid, vals = _grid(pay, ["y"])
        vals = vals[:, 0]
        if state is None:
            at = int(np.clip(np.searchsorted(grid, pay["start"]), 0, len(grid) - 1))
            state = (np.zeros(1), np.array([at]))
        cost, idx = state
        marks = []
        for v in pdf[col].to_numpy(float):
            nxt = np.clip(idx[:, None] + moves[None, :], 0, len(grid) - 1)
            total = (cost[:, None] + (v - vals[nxt]) ** 2 / scale + penalty * np.abs(moves)[None, :]).ravel()
            keep = np.argsort(total, kind="stable")[:width]
            cost, idx = total[keep], nxt.ravel()[keep]
            marks.append((idx, keep // len(moves)))
        return grid, (cost, idx), marks

    def backward(pay, state, pdf, choice):
        grid, _, marks = sweep(pay, state, pdf)
        at = 0 if choice is None else choice
        path = np.empty(len(marks), int)
        for r in range(len(marks) - 1, -1, -1):
            idx, parent = marks[r]
            path[r] = idx[at]
            at = int(parent[at])
        return grid[path], at

    return decode(rows, entity, pos, uid, [col], payload, lambda p, s, d: sweep(p, s, d)[1], backward, limit)


COARSE, FINE = 4, 8  # parts of a window whose means make its words
BREAKS = (-0.6745, 0.0, 0.6745)  # fixed values: quartiles of the normal distribution
SHORT, SHORT_ROWS = 128, 10_000  # known rows and rows of entities that are held in one row of arrays
SLACK = 1e-8  # scores are rounded to nine digits; bounds this close below one are still looked at


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is computed once, also where it is used inside a lambda."""
    return F.transform(F.array(value), build)[0]


def _parts(size: int, parts: int) -> list[tuple[int, int]]:
    """First place and length of each part of a window."""
    cut = [i * size // parts for i in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]


def _means(z: Column, size: int, parts: int) -> Column:
    return F.array(*[_total(F.slice(z, lo + 1, n)) / n for lo, n in _parts(size, parts)])


def _word(means: Column, parts: int) -> Column:
    """A number for the levels of the part means."""
    out = F.lit(0).cast("long")
    for i in range(parts):
        level = F.lit(0)
        for b in BREAKS:
            level = level + (means[i] > b).cast("int")
        out = out * (len(BREAKS) + 1) + level
    return out


def _unit(window: Column, size: int) -> Column:
    """The window with mean 0 and deviation 1."""
    flat = lambda w, mean: F.transform(w, lambda x: x - mean)
    over = lambda c: F.sqrt(_total(F.transform(c, lambda x: x * x)) / size) + 1e-6
    scaled = lambda c: _let(over(c), lambda sd: F.transform(c, lambda x: x / sd))
    return _let(window, lambda w: _let(_total(w) / size, lambda mean: _let(flat(w, mean), scaled)))


def _described(rows: DataFrame, window: Column, size: int) -> DataFrame:
    """Adds ``_z`` (the window with mean 0 and deviation 1), its square sum, part means and words."""
    rows = rows.withColumn("_z", _unit(window, size))
    rows = rows.withColumns({"_ss": _total(F.transform("_z", lambda x: x * x)), "_m4": _means(F.col("_z"), size, COARSE), "_m8": _means(F.col("_z"), size, FINE)})
    return rows.withColumns({"_c": _word(F.col("_m4"), COARSE), "_f": _word(F.col("_m8"), FINE)})


def _boxes(cand: DataFrame, keys: Sequence[str], means: str, parts: int, *more: Column) -> DataFrame:
    """Per word: the range of each part mean and the largest square sum of its windows."""
    low, high = ([f(F.col(means)[i]) for i in range(parts)] for f in (F.min, F.max))
    return cand.groupBy(*keys).agg(F.array(*low).alias("lo"), F.array(*high).alias("hi"), F.max("_b").alias("b"), *more)


def _bound(own: Column, ss: Column, box: Column, size: int, parts: int) -> Column:
    """The largest correlation a window can have with one in the box.

    The squared distance of two windows is at least that of their part means, weighted by length, and the product of
    the windows is half of their square sums less that distance.
    """
    away = F.lit(0.0)
    for i, (_, n) in enumerate(_parts(size, parts)):
        gap = F.greatest(box["lo"][i] - own[i], own[i] - box["hi"][i], F.lit(0.0))
        away = away + n * gap * gap
    return (ss + box["b"] - away) / (2 * size)


def _product(a: Column, b: Column, size: int) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y)) / size


def best_windows(suffix: DataFrame, cand: DataFrame, entity: str, uid: str, size: int) -> DataFrame:
    """(entity, uid, score, value): the candidate window of the same entity with the highest correlation, the first of equals.

    ``suffix``: entity, uid and the columns of ``_described``; ``cand``: entity, ``_at``, ``_v`` and those columns.
    Candidates have words at two resolutions with boxes around them. A window first meets one candidate of the coarse
    word with the highest bound; then coarse words, fine words and at last candidates are looked at only if their bound
    reaches that score. The result is that of comparing all pairs.
    """
    # windows that repeat exactly stand for their first place
    cand = cand.groupBy(entity, "_c", "_f", F.col("_z").alias("_y")).agg(F.min(F.struct("_at", "_v")).alias("_first"), F.first("_ss").alias("_b"), F.first("_m4").alias("_m4"), F.first("_m8").alias("_m8"))
    seen = F.min_by("_y", "_first").alias("seen")
    coarse = _boxes(cand, [entity, "_c"], "_m4", COARSE, seen)
    fine = _boxes(cand, [entity, "_c", "_f"], "_m8", FINE)
    # at most 256 coarse words per entity
    listed = coarse.groupBy(entity).agg(F.collect_list(F.struct("_c", "lo", "hi", "b", "seen")).alias("_boxes"))
    s = suffix.select(entity, F.col(uid).alias("_u"), "_z", "_ss", "_m4", "_m8").join(listed, entity)
    bounded = F.transform("_boxes", lambda x: F.struct(_bound(F.col("_m4"), F.col("_ss"), x, size, COARSE).alias("bound"), x["_c"].alias("_c"), x["seen"].alias("seen")))
    reach = lambda boxes: _product(F.col("_z"), F.array_max(boxes)["seen"], size) - SLACK
    words = lambda boxes, t: F.transform(F.filter(boxes, lambda x: x["bound"] >= t), lambda x: x["_c"])
    s = s.withColumn("_hit", _let(bounded, lambda boxes: _let(reach(boxes), lambda t: F.struct(t.alias("least"), words(boxes, t).alias("words")))))
    s = s.select(entity, "_u", "_z", "_ss", "_m8", F.col("_hit.least").alias("_least"), F.explode("_hit.words").alias("_c"))
    near = s.join(fine, [entity, "_c"]).where(_bound(F.col("_m8"), F.col("_ss"), F.struct("lo", "hi", "b"), size, FINE) >= F.col("_least"))
    near = near.select(entity, "_u", "_z", "_c", "_f")
    met = near.join(cand.select(entity, "_c", "_f", "_y", "_first"), [entity, "_c", "_f"])
    score = F.round(_product(F.col("_z"), F.col("_y"), size), 9)
    best = met.groupBy(entity, "_u").agg(F.max(F.struct(score.alias("score"), (-F.col("_first._at")).alias("at"), F.col("_first._v").alias("v"))).alias("m"))
    return best.select(entity, F.col("_u").alias(uid), F.col("m.score").alias("score"), F.col("m.v").alias("value"))


def _smooth(values: Column) -> Column:
    """Means over five values, fewer at the ends."""
    around = lambda i: F.slice(values, F.greatest(i - 2, F.lit(0)) + 1, F.least(i + 2, F.size(values) - 1) - F.greatest(i - 2, F.lit(0)) + 1)
    return F.transform(values, lambda _, i: _let(around(i), lambda w: _total(w) / F.size(w)))


def _short_matches(p: DataFrame, entity: str, pos: str, uid: str, known: str, col: str, halves: Sequence[int], stride: int) -> DataFrame:
    """(entity, uid, last_known, pos_h, score_h): every suffix row against all known windows of its entity.

    An entity is one row that holds its two parts as arrays, so its windows are never sent anywhere.
    """
    entry = F.struct(F.col(pos).alias("p"), F.col(uid).alias("u"), F.col(col).cast("double").alias("x"), F.col(known).alias("v"))
    taken = F.col(col).isNotNull()
    first = F.col("rn") <= F.col("n_known")
    parts = {"_k": first & taken, "_s": ~first & taken, "_o": ~first & ~taken}
    e = p.groupBy(entity).agg(F.first("last_known").alias("last_known"), *[F.sort_array(F.collect_list(F.when(c, entry))).alias(n) for n, c in parts.items()])
    e = e.where((F.size("_s") > 0) | (F.size("_o") > 0))
    value = lambda name: F.transform(name, lambda r: r["x"])
    e = e.withColumns({"_kx": _smooth(value("_k")), "_sx": _smooth(value("_s"))})
    # an entity without a name has no windows in common with another row
    n = F.when(F.col(entity).isNotNull(), F.size("_k")).otherwise(0)

    def windows(h: int) -> Column:
        size = 2 * h + 1
        at = lambda i: F.struct(_unit(F.slice("_kx", i + 1, F.lit(size)), size).alias("y"), F.get("_k", i + h)["v"].alias("v"))
        return F.when(n > size, F.transform(F.sequence(F.lit(0), n - size, F.lit(stride)), at))

    listed = {f"_c{h}": windows(h) for h in halves}
    top = max(halves)
    ends = F.concat(F.array_repeat(F.get("_sx", F.lit(0)), top), F.col("_sx"), F.array_repeat(F.get("_sx", F.size("_sx") - 1), top))
    e = e.withColumns(listed).withColumns({"_e": ends, "_n": F.size("_s"), "_u": F.transform(F.concat("_s", "_o"), lambda r: r["u"])})
    rows = e.select(entity, "last_known", *listed, "_e", "_n", F.posexplode("_u").alias("_i", uid))

    def best(h: int) -> Column:
        size = 2 * h + 1
        score = lambda z, c: F.round(_product(z, c["y"], size), 9)
        highest = lambda z: F.array_max(F.transform(f"_c{h}", lambda c, i: F.struct(score(z, c).alias("score"), (-i).alias("at"), c["v"].alias("v"))))
        window = F.slice("_e", F.col("_i") + (top - h + 1), F.lit(size))
        return F.when(F.col(f"_c{h}").isNotNull() & (F.col("_i") < F.col("_n")), _let(_unit(window, size), highest))

    rows = rows.withColumns({f"_m{h}": best(h) for h in halves})
    found = {f"pos_{h}": F.coalesce(f"_m{h}.v", "last_known") for h in halves} | {f"score_{h}": F.coalesce(f"_m{h}.score", F.lit(0.0)) for h in halves}
    return rows.select(entity, uid, "last_known", *[c.alias(n) for n, c in found.items()])


def _long_matches(p: DataFrame, entity: str, pos: str, uid: str, known: str, col: str, halves: Sequence[int], stride: int, limit: int | None) -> DataFrame:
    """The same for entities of any length, by the words of their windows."""
    part = F.when(F.col("rn") <= F.col("n_known"), "known").otherwise("suffix")
    rows = p.withColumn("_part", part).where(F.col(col).isNotNull())
    keys = [entity, "_part"]
    rows = numbered(rows, keys, F.col(pos), [pos, uid], "_i", limit)
    rows = framed(rows, keys, F.col(pos), [pos, uid], 2, 2, lambda w: {"_g": F.avg(col).over(w.rowsBetween(-2, 2))}, limit)
    top = max(halves)
    around = lambda w: {f"_w{h}": F.collect_list("_g").over(w.rowsBetween(-h, h)) for h in halves}
    rows = framed(rows, keys, F.col(pos), [pos, uid], top, top, around, limit)
    length = rows.where("_part = 'known'").groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    out = p.where(F.col("rn") > F.col("n_known")).select(entity, uid, "last_known")
    for h in halves:
        size, w = 2 * h + 1, F.col(f"_w{h}")
        before = F.greatest(h + 1 - F.col("_i"), F.lit(0)).cast("int")
        padded = F.concat(F.array_repeat(w[0], before), w, F.array_repeat(F.element_at(w, -1), F.lit(size) - F.size(w) - before))
        suffix = _described(rows.where("_part = 'suffix'").select(entity, uid, padded.alias("_p")), F.col("_p"), size)
        whole = rows.where((F.col("_part") == "known") & (F.size(w) == size) & ((F.col("_i") - 1 - h) % stride == 0))
        whole = whole.join(length.where(F.col("_n") > size).select(entity), entity, "left_semi")
        cand = _described(whole.select(entity, F.col("_i").alias("_at"), F.col(known).alias("_v"), w.alias("_p")), F.col("_p"), size)
        best = best_windows(suffix, cand, entity, uid, size).withColumnsRenamed({"score": f"score_{h}", "value": f"pos_{h}"})
        out = out.join(best, [entity, uid], "left")
        out = out.withColumns({f"pos_{h}": F.coalesce(f"pos_{h}", "last_known"), f"score_{h}": F.coalesce(f"score_{h}", F.lit(0.0))})
    return out


def match_ncc(p: DataFrame, entity: str, pos: str, uid: str, known: str, col: str, halves: Sequence[int] = (8, 15, 25), stride: int = 3, sharpness: float = 3.0, limit: int | None = None, short: int = SHORT) -> DataFrame:
    """Position of the best-correlated known window for each suffix row, per window size and mixed.

    The series is smoothed over five rows. Windows of the known part are whole and start at every ``stride``-th row;
    those of the suffix are one per row, with the edge values repeated beyond the ends. Where the known part has no more
    rows than a window, its last value is given with score 0. The mixed position weighs the sizes by
    exp(sharpness x correlation). Input: ``prefix_frame`` columns; rows without a value of ``col`` take no part.
    Entities of up to ``short`` known rows compare all windows in one row of arrays, longer ones look them up by words.
    """
    args = (entity, pos, uid, known, col, halves, stride)
    sizes = p.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"), F.max("n_known").alias("_known"))
    long = (F.col("_known") > short) | (F.col("_rows") > SHORT_ROWS)
    some, all_ = sizes.agg(F.max(long), F.min(long)).first()
    if not some:
        out = _short_matches(p, *args)
    elif all_:
        out = _long_matches(p, *args, limit)
    else:
        marked = join_keys(p, sizes.select(entity, long.alias("_long")), [entity])
        out = _short_matches(marked.where("NOT _long"), *args).unionByName(_long_matches(marked.where("_long").drop("_long"), *args, limit))
    weights = [F.exp(F.lit(sharpness) * F.col(f"score_{h}")) for h in halves]
    moved = [F.col(f"pos_{h}") * w for h, w in zip(halves, weights)]
    return out.withColumn("matched", sum(moved[1:], moved[0]) / sum(weights[1:], weights[0])).drop("last_known")
