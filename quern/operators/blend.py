"""Blending of prediction sets.

Sets that belong together are columns of one wide frame (one row per id), so row-wise blends need no
shuffle and every comparison of sets is one aggregation. The number of sets is small and known, like a schema.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ordered import average_rank, hot_groups, join_keys, numbered, numbered_ties, ranked_rows, running, value_ranks
from quern.operators.profile import pair_table, pairs_of
from quern.session import cut_lineage, stored

PRED_EPS = 1e-15


def add(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def align_wide(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """(id, model, value) rows to one row per id."""
    return long.groupBy("id").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models])


def mean(df: DataFrame, models: Sequence[str], out: str = "blend") -> DataFrame:
    return df.withColumn(out, add([F.col(m) for m in models]) / len(models))


def weighted(df: DataFrame, weights: dict[str, float], out: str = "blend", lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    total = sum(weights.values())
    w = add([F.col(m) * F.lit(float(v)) for m, v in weights.items()]) / F.lit(float(total))
    return df.withColumn(out, F.when(w.isNotNull(), F.least(F.greatest(w, F.lit(lo)), F.lit(hi))))


def rank_pct(df: DataFrame, keys: Sequence[str], weights: dict[str, float], out: str = "blend", limit: int | None = None) -> DataFrame:
    """Weighted mean of percentile ranks inside each slice."""
    ranked = df
    if hot_groups(df, keys, ranked_rows(limit)) is None:
        for m in weights:
            ranked = average_rank(ranked, keys, m, f"_r_{m}", pct=True, limit=limit)
    else:  # written once for all sets
        ranked = rows = stored(df)
        for m in weights:
            ranked = join_keys(ranked, value_ranks(rows, keys, m, f"_r_{m}", pct=True, limit=limit), [*keys, m])
    blend = add([F.col(f"_r_{m}") * F.lit(float(w)) for m, w in weights.items()]) / F.lit(float(sum(weights.values())))
    return ranked.withColumn(out, blend).drop(*[f"_r_{m}" for m in weights])


def rank_ecdf(train: DataFrame, rows: DataFrame, models: Sequence[str], out: str = "blend", limit: int | None = None) -> DataFrame:
    """Mid-rank of each value among the training values, (below + up to and including + 1) / (2 (n + 1)), averaged."""
    n = train.agg(F.count(F.lit(1))).scalar()
    got = rows
    for m in models:
        both = train.select(F.col(m).alias("_v"), F.lit(1).alias("_k")).unionAll(rows.select(F.col(m), F.lit(0)))
        vals = both.where("_v IS NOT NULL").groupBy("_v").agg(F.sum("_k").alias("_k"))
        cum = running(vals, [], F.col("_v"), ["_v"], {"_c": F.col("_k")}, limit)
        mid = (2 * F.col("_c") - F.col("_k") + 1) / (2.0 * (n + 1))
        got = join_keys(got, cum.select(F.col("_v").alias(m), mid.alias(f"_e_{m}")), [m])
    return got.withColumn(out, add([F.col(f"_e_{m}") for m in models]) / len(models)).drop(*[f"_e_{m}" for m in models])


def _position(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, limit: int | None) -> DataFrame:
    rows = numbered_ties(df, keys, value, tie, out, limit)
    return rows.withColumn(out, F.col(out) - 1)


def rank_remap(df: DataFrame, anchor: str, support: str, weight: float, tie: str, out: str = "blend", limit: int | None = None) -> DataFrame:
    """Blend ranks 0..1 of two sets, then give the i-th row of the blend the i-th smallest anchor value."""
    large = hot_groups(df, [], limit) is not None
    rows = _position(df, [], anchor, tie, "_pa", limit)
    rows = _position(rows, [], support, tie, "_ps", limit)
    n = df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).scalar()
    rows = rows.withColumn("_b", F.round((F.lit(1 - weight) * F.col("_pa") + F.lit(weight) * F.col("_ps")) / n, 12))
    rows = stored(rows) if large else rows  # both sides of the last join read it
    sorted_anchor = rows.select(F.col("_pa").alias("_pb"), F.col(anchor).alias(out))
    rows = _position(rows, [], "_b", tie, "_pb", limit)
    return rows.join(sorted_anchor, "_pb").drop("_pa", "_ps", "_b", "_pb")


def rerank_within_mask(df: DataFrame, mask: Column, base: str, special: str, tie: str, keys: Sequence[str] = (), out: str = "reranked", limit: int | None = None) -> DataFrame:
    """Reorder only masked rows by the mean rank of two scores; their set of base scores stays the same."""
    keys = list(keys)
    inside = df.where(mask)
    rows = average_rank(average_rank(inside, keys, base, "_ra", limit=limit), keys, special, "_rb", limit=limit)
    rows = rows.withColumn("_m", (F.col("_ra") + F.col("_rb")) / 2)
    rows = _position(_position(rows, keys, "_m", tie, "_pm", limit), keys, base, tie, "_pb", limit)
    values = rows.select(*keys, F.col("_pb").alias("_pm"), F.col(base).alias(out))
    moved = join_keys(rows.select(*df.columns, "_pm"), values, [*keys, "_pm"]).drop("_pm")
    return moved.unionByName(df.where(~F.coalesce(mask, F.lit(False))).withColumn(out, F.col(base)))


def geometric(df: DataFrame, models: dict[str, float], classes: Sequence[str], multiplier: dict[str, float] | None = None, prefix: str = "g_") -> DataFrame:
    """Weighted geometric mean of class probabilities (columns model + class), times multipliers, renormalised."""
    raw = {}
    for c in classes:
        logs = add([F.lit(float(w)) * F.ln(F.greatest(F.col(f"{m}{c}"), F.lit(PRED_EPS))) for m, w in models.items()])
        raw[c] = F.exp(logs / F.lit(float(sum(models.values())))) * F.lit(float((multiplier or {}).get(c, 1.0)))
    total = add(list(raw.values()))
    return df.withColumns({f"{prefix}{c}": v / total for c, v in raw.items()})


def logit_mean(df: DataFrame, models: dict[str, float], out: str = "blend", eps: float = 1e-6) -> DataFrame:
    """Weighted mean of logits of binary probabilities, back to a probability."""
    clip = lambda m: F.least(F.greatest(F.col(m), F.lit(eps)), F.lit(1 - eps))
    z = add([F.lit(float(w)) * F.ln(clip(m) / (1 - clip(m))) for m, w in models.items()]) / F.lit(float(sum(models.values())))
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def hrank(df: DataFrame, base: dict[str, float], steps: Sequence[float], down: float = 0.7, out: str = "blend") -> DataFrame:
    """Row-wise weights: base weight plus a correction by the set's place in the sorted row, both directions mixed."""
    items = F.array_sort(F.array(*[F.struct(F.col(m).alias("v"), F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, (m, w) in enumerate(base.items())]))
    fix = F.array(*[F.lit(float(s)) for s in steps])

    def side(sorted_items: Column) -> Column:
        parts = F.zip_with(sorted_items, fix, lambda x, s: x["v"] * (x["w"] + s))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    desc = F.array_sort(
        F.array(*[F.struct((-F.col(m)).alias("k"), F.lit(i).alias("i"), F.col(m).alias("v"), F.lit(float(w)).alias("w")) for i, (m, w) in enumerate(base.items())])
    )
    mix = F.lit(down) * side(desc) + F.lit(1 - down) * side(items)
    return df.withColumn(out, F.least(F.greatest(mix, F.lit(0.0)), F.lit(1.0)))


def selective(df: DataFrame, anchor: str, support: str, tie: str, share: float = 0.02, weight: float = 0.1, extreme_only: bool = False, out: str = "blend", limit: int | None = None) -> DataFrame:
    """Move only the rows where the two sets disagree most (optionally only at the ends of the anchor's ranking)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    rows = df
    eligible = F.lit(True)
    if extreme_only:
        rows = _position(rows, [], anchor, tie, "_pa", limit)
        r = F.col("_pa") / F.greatest(n - 1, F.lit(1))
        eligible = (r <= 0.10) | (r >= 0.90)
    rows = rows.withColumn("_d", F.when(eligible, -F.round(F.abs(F.col(support) - F.col(anchor)), 12)).otherwise(F.lit(1.0)))
    rest = None
    if extreme_only and hot_groups(df, [], limit) is not None:
        # the rows between the ends come last and are never moved: they need no number
        rows = stored(rows)
        rest = rows.where("_d > 0").withColumn("_rn", F.lit(None).cast("long"))
        rows = rows.where("_d IS NULL OR _d <= 0")
    rows = numbered(rows, [], F.col("_d"), ["_d", tie], "_rn", limit)
    rows = rows if rest is None else rows.unionByName(rest)
    chosen = (F.col("_d") <= 0) & (F.col("_rn") <= F.greatest(F.bround(n * F.lit(share), 0), F.lit(1.0)))
    moved = F.lit(1 - weight) * F.col(anchor) + F.lit(weight) * F.col(support)
    value = F.when(chosen, moved).otherwise(F.col(anchor))
    drop = [c for c in ("_pa", "_d", "_rn") if c in rows.columns]
    return rows.withColumns({out: F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), "changed": chosen.cast("int")}).drop(*drop)


def family_mean(long: DataFrame, pattern: str = r"_seed\d+$") -> DataFrame:
    """Average the seeds of one model: the name without its seed suffix is the family."""
    return long.groupBy("id", F.regexp_replace("model", pattern, "").alias("family")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("members"))


def score_weights(scores: DataFrame, temperature: float, power: float = 12.0) -> DataFrame:
    """Normalised weights from one score per set: raw, shifted by the minimum, softmax and a high power."""
    st = scores.agg(F.struct(F.max("score").alias("hi"), F.min("score").alias("lo")).alias("s")).scalar()
    w = scores.withColumns(
        {
            "_raw": F.col("score"),
            "_shifted": F.col("score") - st["lo"] + 1e-3,
            "_softmax": F.exp((F.col("score") - st["hi"]) / F.lit(temperature)),
            "_power": F.pow(F.col("score"), F.lit(power)),
        }
    )
    tot = w.agg(F.struct(*[F.sum(f"_{k}").alias(k) for k in ("raw", "shifted", "softmax", "power")]).alias("t")).scalar()
    return w.select("model", "score", *[(F.col(f"_{k}") / tot[k]).alias(f"w_{k}") for k in ("raw", "shifted", "softmax", "power")])


def label_agreement(df: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Share of equal labels for every pair of sets: one aggregation over the wide frame."""
    return pair_table(df, pairs_of(sets), {"agreement": lambda a, b: F.avg((F.col(a) == F.col(b)).cast("int"))})


def score_agreement(df: DataFrame, sets: Sequence[str]) -> DataFrame:
    return pair_table(
        df, pairs_of(sets), {"corr": lambda a, b: F.corr(a, b), "mean_abs_delta": lambda a, b: F.avg(F.abs(F.col(a) - F.col(b)))}
    )


def families(agreement: DataFrame, sets: Sequence[str], threshold: float) -> dict[str, str]:
    """Sets joined whenever a pair agrees above the threshold: {set: first set of its family}.

    Works on the pair table, one row per pair of sets, never on prediction rows.
    """
    parent = {s: s for s in sets}

    def root(s: str) -> str:
        while parent[s] != s:
            s = parent[s]
        return s

    for r in agreement.where(F.col("agreement") >= threshold).select("a", "b").collect():
        x, y = sorted((root(r["a"]), root(r["b"])), key=list(sets).index)
        parent[y] = x
    return {s: root(s) for s in sets}


def keep_diverse(agreement: DataFrame, scores: dict[str, float], threshold: float) -> list[str]:
    """Best score first; keep a set only if it agrees below the threshold with every set kept so far."""
    near = {frozenset((r["a"], r["b"])) for r in agreement.where(F.col("agreement") >= threshold).select("a", "b").collect()}
    kept: list[str] = []
    for s in sorted(scores, key=lambda k: (-scores[k], k)):
        if all(frozenset((s, k)) not in near for k in kept):
            kept.append(s)
    return kept


def diversity_weights(agreement: DataFrame, scores: dict[str, float], threshold: float = 0.99, scale: float = 10.0) -> DataFrame:
    """Normalised weights per set: equal, score around the median, diversity, their product, one over family size,
    and uniqueness (one over mean agreement)."""
    sets = list(scores)
    fam = families(agreement, sets, threshold)
    size = {s: sum(f == fam[s] for f in fam.values()) for s in sets}
    long = agreement.select(F.explode(F.array("a", "b")).alias("model"), "agreement")
    per = long.groupBy("model").agg(F.avg("agreement").alias("mean_agreement"))
    base = agreement.sparkSession.createDataFrame([(s, float(scores[s]), 1.0 / size[s]) for s in sets], "model string, score double, family double")
    j = base.join(per, "model")
    med = j.agg(F.percentile("score", F.lit(0.5))).scalar()
    div = F.greatest(1 - F.col("mean_agreement"), F.lit(1e-9))
    j = j.withColumns(
        {
            "_equal": F.lit(1.0),
            "_score": F.least(F.greatest(1 + (F.col("score") - med) * F.lit(scale), F.lit(0.5)), F.lit(1.5)),
            "_diversity": F.least(F.greatest(div / j.agg(F.avg(div)).scalar(), F.lit(0.5)), F.lit(2.0)),
            "_family": F.col("family"),
            "_unique": 1 / F.col("mean_agreement"),
        }
    ).withColumn("_hybrid", F.col("_score") * F.col("_diversity"))
    kinds = ("equal", "score", "diversity", "hybrid", "family", "unique")
    tot = j.agg(F.struct(*[F.sum(f"_{k}").alias(k) for k in kinds]).alias("t")).scalar()
    return j.select("model", "mean_agreement", *[(F.col(f"_{k}") / tot[k]).alias(f"w_{k}") for k in kinds])


def coalition(sets: Sequence[str], classes: Sequence[str]) -> Column:
    """Size of the largest group of sets that agree on a row."""
    return F.greatest(*[add([(F.col(s) == c).cast("int") for s in sets]) for c in classes])


def vote_strength(df: DataFrame, sets: Sequence[str], classes: Sequence[str]) -> DataFrame:
    out = df.groupBy(coalition(sets, classes).alias("coalition")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("unanimous", (F.col("coalition") == len(sets)).cast("int"))


def _totals(weights: dict[str, float], classes: Sequence[str]) -> dict[str, Column]:
    # rounded, so that equal votes tie exactly whatever the order of addition
    return {c: F.round(add([F.when(F.col(s) == c, F.lit(float(w))).otherwise(0.0) for s, w in weights.items()]), 12) for c in classes}


def first_max(values: dict[str, Column]) -> Column:
    """Key of the largest value, the first one on ties."""
    top = F.greatest(*values.values())
    out = None
    for k, v in values.items():
        out = F.when(v == top, F.lit(k)) if out is None else out.when(v == top, F.lit(k))
    return out


def weighted_vote(df: DataFrame, weights: dict[str, float], classes: Sequence[str], best: str, out: str = "vote") -> DataFrame:
    """Weighted hard vote; ties go to the best set's label if it is among the tied, else to the first class."""
    tot = _totals(weights, classes)
    top = F.greatest(*tot.values())
    best_total = None
    for c, v in tot.items():
        best_total = F.when(F.col(best) == c, v) if best_total is None else best_total.when(F.col(best) == c, v)
    label = F.when(best_total == top, F.col(best)).otherwise(first_max(tot))
    return df.withColumns({out: label, "vote_share": top / add(list(tot.values()))})


def anchor_override(df: DataFrame, fam: dict[str, str], scores: dict[str, float], classes: Sequence[str], threshold: float, need: int = 3, scale: float = 10.0, out: str = "override") -> DataFrame:
    """Change the best set's label only where family votes agree strongly and at least ``need`` families support it."""
    groups: dict[str, list[str]] = {}
    for s, f in fam.items():
        groups.setdefault(f, []).append(s)
    rows = df
    fam_scores = {}
    for f, members in groups.items():
        lead = max(members, key=lambda s: scores[s])
        rows = weighted_vote(rows, {m: 1.0 for m in members}, classes, lead, f"_f_{f}").drop("vote_share")
        fam_scores[f] = max(scores[m] for m in members)
    ordered = sorted(fam_scores.values())
    k = len(ordered)
    med = ordered[k // 2] if k % 2 else (ordered[k // 2 - 1] + ordered[k // 2]) / 2
    w = {f"_f_{f}": min(max(1 + (s - med) * scale, 0.5), 1.5) for f, s in fam_scores.items()}
    tot = _totals(w, classes)
    challenger = first_max(tot)
    conf = F.greatest(*tot.values()) / add(list(tot.values()))
    support = None
    for c in classes:
        votes = add([(F.col(f) == c).cast("int") for f in w])
        support = F.when(F.col("_ch") == c, votes) if support is None else support.when(F.col("_ch") == c, votes)
    anchor = max(scores, key=lambda s: scores[s])
    rows = rows.withColumns({"_ch": challenger, "confidence": conf})
    change = (F.col("_ch") != F.col(anchor)) & (F.col("confidence") >= threshold) & (support >= need)
    return rows.withColumn(out, F.when(change, F.col("_ch")).otherwise(F.col(anchor))).drop("_ch", *w)


def vote_with_judge(df: DataFrame, weights: dict[str, float], classes: Sequence[str], probs: dict[str, str], mass: float, star: dict[str, float], out: str = "vote") -> DataFrame:
    """Weighted vote where a probability model adds mass on disputed rows only; unanimous rows never change."""
    sets = list(weights)
    unanimous = F.lit(True)
    for s in sets[1:]:
        unanimous = unanimous & (F.col(s) == F.col(sets[0]))
    tot = {c: (v + F.lit(mass) * F.col(probs[c])) * F.lit(float(star.get(c, 1.0))) for c, v in _totals(weights, classes).items()}
    return df.withColumn(out, F.when(unanimous, F.col(sets[0])).otherwise(first_max(tot)))


def leave_one_out(df: DataFrame, scores: dict[str, float], classes: Sequence[str], temperature: float = 0.05) -> DataFrame:
    """Blend all sets but one and score the result (balanced accuracy) against the one left out, in one pass."""
    import math

    aggs, names = [], list(scores)
    for h in names:
        rest = {s: math.exp((scores[s] - max(v for k, v in scores.items() if k != h)) / temperature) for s in names if s != h}
        vote = first_max(_totals(rest, classes))
        for c in classes:
            hit = F.when(F.col(h) == c, (vote == c).cast("int"))
            aggs.append(F.avg(hit).alias(f"{h}|{c}"))
    one = df.agg(*aggs)
    rec = lambda h: add([F.coalesce(F.col(f"`{h}|{c}`"), F.lit(0.0)) for c in classes]) / add([F.col(f"`{h}|{c}`").isNotNull().cast("int") for c in classes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(h).alias("held_out"), rec(h).alias("balanced_accuracy")) for h in names])).alias("r")).select("r.*")


def prior_correction(df: DataFrame, probs: dict[str, str], target: dict[str, float] | Column, out: str = "p_") -> DataFrame:
    """Scale class probabilities so their means move to a target prior, then renormalise rows.

    ``target``: numbers per class, or a struct column with one field per class.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(k) for k, c in probs.items()]).alias("m")).scalar()
    goal = lambda k: F.lit(float(target[k])) if isinstance(target, dict) else target[k]
    raw = {k: F.col(c) * (goal(k) / F.greatest(means[k], F.lit(1e-9))) for k, c in probs.items()}
    total = add(list(raw.values()))
    return df.withColumns({f"{out}{k}": v / total for k, v in raw.items()})


def sinkhorn(df: DataFrame, probs: dict[str, str], target: dict[str, float], mix: float = 0.5, rounds: int = 100, tol: float = 1e-10) -> DataFrame:
    """Alternate column and row scaling towards target class shares, mixed with the raw log probabilities.

    Row scaling follows from the column factors, so the state is one number per class and each round is one
    small aggregation; it stops early once the factors are stable.
    """
    keys = list(probs)
    source, df = df, df.select(*probs.values()).persist()
    n = df.count()
    v = {k: 1.0 for k in keys}

    def balanced(factors: dict[str, float]) -> dict[str, Column]:
        raw = {k: F.col(probs[k]) * F.lit(factors[k]) for k in keys}
        total = F.greatest(add(list(raw.values())), F.lit(1e-12))
        return {k: x / total for k, x in raw.items()}

    for i in range(rounds):
        q = balanced(v) if i else {k: F.col(probs[k]) for k in keys}
        sums = df.agg(*[F.sum(x).alias(k) for k, x in q.items()]).first()
        step = {k: n * target[k] / max(sums[k], 1e-12) for k in keys}
        v = {k: v[k] * step[k] for k in keys}
        top = max(v.values())
        v = {k: x / top for k, x in v.items()}
        if max(step.values()) / min(step.values()) - 1 < tol:
            break
    df.unpersist()
    q = balanced(v)
    ln = lambda x: F.ln(x + F.lit(1e-12))
    score = {k: F.lit(1 - mix) * ln(F.col(probs[k])) + F.lit(mix) * ln(q[k]) for k in keys}
    return source.withColumns({**{f"q_{k}": x for k, x in q.items()}, "decision": first_max(score)})


def anchor_gate(df: DataFrame, probs: dict[str, str], anchor: str, tie: str, top: int, out: str = "gated", limit: int | None = None) -> DataFrame:
    """Accept the model's label only on the ``top`` rows with the largest margin between its two best classes."""
    p = F.array_sort(F.array(*[-F.col(c) for c in probs.values()]))
    rows = df.withColumn("_m", F.round(p[0] - p[1], 12))
    rows = numbered(rows, [], F.col("_m"), ["_m", tie], "_rn", limit)
    label = first_max({k: F.col(c) for k, c in probs.items()})
    take = F.col("_rn") <= top
    return rows.withColumns({out: F.when(take, label).otherwise(F.col(anchor)), "changed": (take & (label != F.col(anchor))).cast("int")}).drop("_m", "_rn")


def simplex_grid(n: int, parts: int = 10) -> list[tuple[float, ...]]:
    """All weight vectors in steps of 1 / parts that sum to one."""
    return [tuple(x / parts for x in w) for w in product(range(parts + 1), repeat=n) if sum(w) == parts]


def recall_grid(df: DataFrame, y: str, preds: Sequence[Column], batch: int = 50) -> DataFrame:
    """Balanced accuracy of many predictions over the same rows: (setting, balanced_accuracy).

    Each prediction is one hit column and one mean per class; rows are never multiplied by the settings.
    """
    out = None
    for lo in range(0, len(preds), batch):
        part = range(lo, min(lo + batch, len(preds)))
        hits = df.select(F.col(y).alias("_y"), *[(preds[i] == F.col(y)).cast("int").alias(f"h{i}") for i in part])
        rec = hits.groupBy("_y").agg(*[F.avg(f"h{i}").alias(f"h{i}") for i in part])
        rows = F.array(*[F.struct(F.lit(i).alias("setting"), F.col(f"h{i}").alias("r")) for i in part])
        one = rec.select(F.explode(rows).alias("x")).groupBy("x.setting").agg(F.avg("x.r").alias("balanced_accuracy"))
        out = one if out is None else out.unionAll(one)
    return out


def weight_grid_accuracy(df: DataFrame, models: Sequence[str], classes: Sequence[str], y: str, grid: Sequence[tuple[float, ...]]) -> DataFrame:
    """Balanced accuracy of the blended class probabilities (columns model + class) for each weight vector."""
    preds = [first_max({c: F.round(add([F.lit(float(x)) * F.col(f"{m}{c}") for x, m in zip(w, models)]), 12) for c in classes}) for w in grid]
    names = F.array(*[F.concat_ws("/", *[F.lit(f"{x:g}") for x in w]) for w in grid])
    return recall_grid(df, y, preds).select("setting", F.get(names, F.col("setting")).alias("weights"), "balanced_accuracy")


def cross_weight_grid(df: DataFrame, keys: Sequence[str], models: Sequence[str], y: str, grid: Sequence[tuple[float, ...]], tie: str, limit: int | None = None) -> DataFrame:
    """Average precision at 20 % for each weight vector: ranking needs the scores themselves, so rows repeat per vector."""
    from quern.operators.metrics import ap_at_share

    ws = F.array(*[F.struct(F.lit(i).alias("w"), F.round(add([F.lit(float(x)) * F.col(m) for x, m in zip(w, models)]), 12).alias("score")) for i, w in enumerate(grid)])
    rows = df.select(*keys, y, tie, F.explode(ws).alias("g")).select(*keys, y, tie, "g.*")
    ap = ap_at_share(rows, ["w", *keys], y, "score", tie, limit=limit)
    names = F.array(*[F.concat_ws("/", *[F.lit(f"{x:g}") for x in w]) for w in grid])
    return ap.groupBy("w").agg(F.avg("ap").alias("ap")).select(F.get(names, F.col("w")).alias("weights"), "ap")


def hill_climb(df: DataFrame, models: Sequence[str], classes: Sequence[str], y: str, step: float = 0.05, rounds: int = 800) -> DataFrame:
    """Best single step of +-``step`` on one weight per round until balanced accuracy stops growing.

    All moves of a round are scored by one aggregation. ``converged`` tells whether the search stopped by itself.
    """
    w = [1.0 / len(models)] * len(models)
    df = df.select(y, *[f"{m}{c}" for m in models for c in classes]).persist()
    score = lambda ws: [r["balanced_accuracy"] for r in weight_grid_accuracy(df, models, classes, y, ws).orderBy("setting").collect()]
    best, converged = score([tuple(w)])[0], False
    for _ in range(rounds):
        moves = []
        for i in range(len(models)):
            for d in (step, -step):
                c = list(w)
                c[i] += d
                if min(c) >= -1e-9:
                    total = sum(c)
                    moves.append(tuple(max(x, 0.0) / total for x in c))
        got = score(moves)
        top = max(range(len(moves)), key=lambda i: got[i])
        if got[top] <= best + 1e-6:
            converged = True
            break
        best, w = got[top], list(moves[top])
    df.unpersist()
    rows = [(m, float(x), float(best), converged) for m, x in zip(models, w)]
    return df.sparkSession.createDataFrame(rows, "model string, weight double, balanced_accuracy double, converged boolean")


def convex_logloss(df: DataFrame, models: Sequence[str], y: str, rounds: int = 500, rate: float = 2.0, tol: float = 1e-6) -> DataFrame:
    """Non-negative weights summing to one that minimise log loss, by exponentiated gradient steps (one pass each).

    ``converged`` tells whether the loss stopped falling before the rounds ran out.
    """
    import math

    w = [1.0 / len(models)] * len(models)
    loss, converged = None, False
    df = df.select(y, *models).persist()
    for _ in range(rounds):
        p = F.least(F.greatest(add([F.lit(x) * F.col(m) for x, m in zip(w, models)]), F.lit(1e-7)), F.lit(1 - 1e-7))
        g = (p - F.col(y)) / (p * (1 - p))
        r = df.agg(
            F.avg(-(F.col(y) * F.ln(p) + (1 - F.col(y)) * F.ln(1 - p))).alias("loss"), *[F.avg(F.col(m) * g).alias(f"g{i}") for i, m in enumerate(models)]
        ).first()
        if loss is not None and abs(loss - r["loss"]) < tol:
            loss, converged = r["loss"], True
            break
        loss = r["loss"]
        grads = [r[f"g{i}"] for i in range(len(models))]
        scale = max(abs(x) for x in grads) or 1.0
        raw = [x * math.exp(-rate * (gr - min(grads)) / max(scale, 1.0)) for x, gr in zip(w, grads)]
        w = [x / sum(raw) for x in raw]
    df.unpersist()
    return df.sparkSession.createDataFrame([(m, x, float(loss), converged) for m, x in zip(models, w)], "model string, weight double, log_loss double, converged boolean")


# fixed values: grid of class multipliers
MULTIPLIERS = [0.5 + 0.05 * i for i in range(31)]


def multiplier_grid(df: DataFrame, probs: dict[str, str], y: str, klass: str, mult: dict[str, float], grid: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """Balanced accuracy for each multiplier of one class, the others fixed.

    A growing multiplier flips a row to the class once, so a row is summed up by how many grid values flip it
    and by the best other class: one small count table holds the result for the whole grid.
    """
    order = list(probs)
    others = {k: F.round(F.col(c) * F.lit(float(mult.get(k, 1.0))), 12) for k, c in probs.items() if k != klass}
    values = [float(x) for x in sorted(grid)]
    rows = df.select(F.col(y).alias("_y"), F.col(probs[klass]).alias("_p"), F.greatest(*others.values()).alias("_top"), first_max(others).alias("_other"))
    earlier = F.col("_other").isin(*[k for k in order if order.index(k) < order.index(klass)]) if order.index(klass) else F.lit(False)
    scaled = lambda x: F.round(F.col("_p") * x, 12)
    flips = F.size(F.filter(F.array(*[F.lit(x) for x in values]), lambda x: (scaled(x) > F.col("_top")) | ((scaled(x) == F.col("_top")) & ~F.col("_early"))))
    cells_ = rows.withColumn("_early", earlier).groupBy("_y", "_other", flips.alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(values)])
    long = cells_.withColumn("s", F.explode(step))
    pred = F.when(F.col("s.i") >= len(values) - F.col("_f"), F.lit(klass)).otherwise(F.col("_other"))
    rec = long.groupBy(F.col("s.x").alias("multiplier"), "_y").agg((F.sum(F.when(pred == F.col("_y"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("r"))
    return rec.groupBy("multiplier").agg(F.avg("r").alias("balanced_accuracy")).select(F.lit(klass).alias("class"), "multiplier", "balanced_accuracy")


def multiplier_search(df: DataFrame, probs: dict[str, str], y: str, rounds: int = 12) -> DataFrame:
    """Greedy class multipliers: each class in turn takes its best grid value until nothing improves.

    The result is divided by its mean. ``converged`` tells whether a whole round brought nothing.
    """
    mult = {k: 1.0 for k in probs}
    best, converged = None, False
    df = df.select(y, *probs.values()).persist()
    for _ in range(rounds):
        improved = False
        for k in probs:
            got = multiplier_grid(df, probs, y, k, mult).agg(F.max_by(F.struct("multiplier", "balanced_accuracy"), "balanced_accuracy")).first()[0]
            if best is None or got["balanced_accuracy"] > best + 1e-6:
                best, mult[k], improved = got["balanced_accuracy"], got["multiplier"], True
        if not improved:
            converged = True
            break
    df.unpersist()
    mean = sum(mult.values()) / len(mult)
    rows = [(k, float(v) / mean, float(best), converged) for k, v in mult.items()]
    return df.sparkSession.createDataFrame(rows, "class string, multiplier double, balanced_accuracy double, converged boolean")


def stack_features(df: DataFrame, models: Sequence[str], limit: int | None = None) -> DataFrame:
    """OOF columns with their mean, deviation, range, pairwise differences and percentile ranks."""
    arr = F.array(*[F.col(m) for m in models])
    mean_ = add([F.col(m) for m in models]) / len(models)
    var = add([(F.col(m) - F.col("s_mean")) * (F.col(m) - F.col("s_mean")) for m in models]) / len(models)
    out = df.withColumn("s_mean", mean_).withColumns({"s_std": F.sqrt(var), "s_range": F.array_max(arr) - F.array_min(arr)})
    out = out.withColumns({f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in pairs_of(models)})
    for m in models:
        out = average_rank(out, [], m, f"{m}_rank", pct=True, limit=limit)
    return out


def candidate_report(df: DataFrame, anchor: str, candidates: dict[str, str], moved: float = 1e-9) -> DataFrame:
    """Per blend: recipe, correlation and mean distance to the anchor, changed rows, risk band, first identical blend."""
    names = list(candidates)
    # the correlation of a set with itself or a constant is left null
    aggs = []
    for c in names:
        d = F.abs(F.col(c) - F.col(anchor))
        aggs += [
            F.when((F.stddev_pop(c) > 0) & (F.stddev_pop(anchor) > 0), F.corr(c, anchor)).alias(f"corr_{c}"),
            F.avg(d).alias(f"delta_{c}"),
            F.sum((d > moved).cast("int")).alias(f"rows_{c}"),
        ]
    for a, b in pairs_of(names):
        aggs.append(F.max((F.abs(F.col(a) - F.col(b)) > 1e-12).cast("int")).alias(f"ne_{a}_{b}"))
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(names):
        dup = F.coalesce(*[F.when(F.col(f"ne_{a}_{c}") == 0, F.lit(a)) for a in names[:i]]) if i else F.lit(None).cast("string")
        delta = F.col(f"delta_{c}")
        risk = F.when(delta < 0.005, "low").when(delta < 0.02, "medium").otherwise("high")
        rows.append(
            F.struct(
                F.lit(c).alias("blend"), F.lit(candidates[c]).alias("recipe"), F.col(f"corr_{c}").alias("corr"), delta.alias("delta"),
                F.col(f"rows_{c}").alias("changed_rows"), risk.alias("risk"), dup.alias("duplicate_of"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# fixed values: gate quantiles and fallback weights tried
QUANTILES = (0.70, 0.80, 0.85, 0.90, 0.95)
ANCHOR_WEIGHTS = (0.10, 0.20, 0.25, 0.35)


def uncertainty_gate(df: DataFrame, entity: str, y: str, pred: str, fallback: str, spreads: Sequence[str], limit: int | None = None) -> DataFrame:
    """Grid of gate quantile x fallback weight scored by pooled RMSE and the worst tenth's share of squared error.

    Uncertainty of an entity: mean over spread columns of its median's robust z-score. Everything after the first
    aggregation works on one row per entity.
    """
    from quern.functions.ordered import quantiles

    ep, ef = F.col(pred) - F.col(y), F.col(fallback) - F.col(y)
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum(ep * ep).alias("sp"), F.sum(ef * ef).alias("sf"))
    meds = quantiles(df, [entity], {f"_m_{s}": (s, 0.5) for s in spreads}, limit)
    per = join_keys(per, meds, [entity])
    per = cut_lineage(per)  # read by five small jobs below
    med = quantiles(per, [], {s: (f"_m_{s}", 0.5) for s in spreads}, limit).first()
    per = per.withColumns({f"_d_{s}": F.abs(F.col(f"_m_{s}") - F.lit(med[s])) for s in spreads})
    mad = quantiles(per, [], {s: (f"_d_{s}", 0.5) for s in spreads}, limit).first()
    z = [(F.col(f"_m_{s}") - F.lit(med[s])) / F.lit(max(1.4826 * mad[s], 1e-6)) for s in spreads]
    per = per.select(entity, "n", "sp", "sf", (add(z) / len(spreads)).alias("u"))
    cut = quantiles(per, [], {f"q{int(q * 100)}": ("u", q) for q in QUANTILES}, limit).first()
    grid = [(q, w) for q in QUANTILES for w in ANCHOR_WEIGHTS]
    cells = [F.struct(F.lit(0.0).alias("quantile"), F.lit(0.0).alias("anchor_weight"), F.lit(0).alias("gated"), F.col("sp").alias("sse"))]
    for q, w in grid:
        gate = F.round(F.col("u"), 9) >= F.round(F.lit(cut[f"q{int(q * 100)}"]), 9)
        sse = F.when(gate, F.lit((1 - w) ** 2) * F.col("sp") + F.lit(w**2) * F.col("sf")).otherwise(F.col("sp"))
        cells.append(F.struct(F.lit(q).alias("quantile"), F.lit(w).alias("anchor_weight"), gate.cast("int").alias("gated"), sse.alias("sse")))
    rows = per.select(entity, "n", F.explode(F.array(*cells)).alias("g")).select(entity, "n", "g.*")
    keys = ["quantile", "anchor_weight"]
    ranked = numbered(rows.withColumn("_neg", -F.col("sse")), keys, F.col("_neg"), ["_neg", entity], "_rn", limit)
    size = per.agg(F.greatest(F.ceil(F.count(F.lit(1)) * 0.1), F.lit(1))).scalar()
    out = ranked.groupBy(*keys).agg(
        F.sum("gated").alias("gated_entities"), F.sqrt(F.sum("sse") / F.sum("n")).alias("pooled_rmse"),
        (F.sum(F.when(F.col("_rn") <= size, F.col("sse"))) / F.greatest(F.sum("sse"), F.lit(1e-12))).alias("worst_share"),
    )
    base = out.where("quantile = 0").select(F.struct("pooled_rmse", "worst_share").alias("b")).scalar()
    ok = (F.col("pooled_rmse") < base["pooled_rmse"] - 0.01) & (F.col("worst_share") <= base["worst_share"])
    return out.withColumn("accepted", ok.cast("int"))


def guarded(df: DataFrame, a: str, b: str, distance: str, near: float = 150.0, w_near: float = 0.6, w_far: float = 0.2, out: str = "blend") -> DataFrame:
    """Weight of ``b`` depends on whether the neighbour is within ``near``."""
    w = F.when(F.col(distance) <= near, w_near).otherwise(w_far)
    return df.withColumn(out, (1 - w) * F.col(a) + w * F.col(b))


def gate_accept(scores: DataFrame, variant: str, base: str, floor: float = -0.002, gain: float = 0.001) -> DataFrame:
    """Accept a variant if no holdout loses more than ``floor`` and one gains ``gain``; strict: every holdout gains.

    Input rows: holdout, variant, score.
    """
    wide = scores.groupBy("holdout").agg(
        F.max(F.when(F.col("variant") == variant, F.col("score"))).alias("v"), F.max(F.when(F.col("variant") == base, F.col("score"))).alias("b")
    )
    d = F.col("v") - F.col("b")
    return wide.agg(F.min(d).alias("worst"), F.max(d).alias("best")).withColumns(
        {"accept": ((F.col("worst") >= floor) & (F.col("best") >= gain)).cast("int"), "accept_strict": (F.col("worst") >= gain).cast("int")}
    )


