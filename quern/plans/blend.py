"""Blending and decision queries."""

from pyspark.sql import functions as F

from quern.operators import blend as N
from quern.operators.profile import pairs_of
from quern.plans import pool as P
from quern.registry import query

M = P.MODELS
PR = f"WITH {P.PRED}"


@query("blend_mean", f"{PR} SELECT id, (m1 + m2 + m3 + m4) / 4 AS blend FROM pred", f="blend")
def _(t):
    return N.mean(P.pred(t), M).select("id", "blend")


WT = {"m1": 0.5, "m2": 0.3, "m3": 0.1, "m4": 0.1}


@query("blend_weighted", f"{PR} SELECT id, least(greatest(0.5e0 * m1 + 0.3e0 * m2 + 0.1e0 * m3 + 0.1e0 * m4, 0.05), 0.9) AS blend FROM pred", f="blend")
def _(t):
    return N.weighted(P.pred(t), WT, lo=0.05, hi=0.9).select("id", "blend")


def rk(m, part="PARTITION BY slice"):
    p2 = f"{part}, {m}" if part else f"PARTITION BY {m}"
    return f"((rank() OVER ({part} ORDER BY {m}) + (count(*) OVER ({p2}) - 1) / 2e0) / count(*) OVER ({part}))"


@query("blend_rank_pct", f"{PR} SELECT id, 0.5e0 * {rk('m1')} + 0.3e0 * {rk('m2')} + 0.2e0 * {rk('m3')} AS blend FROM pred", f="blend")
def _(t):
    return N.rank_pct(P.pred(t).select("id", "slice", "m1", "m2", "m3"), ["slice"], {"m1": 0.5, "m2": 0.3, "m3": 0.2}).select("id", "blend")


@query(
    "blend_rank_ecdf",
    f"""{PR}, tr AS (SELECT * FROM pred WHERE id % 5 <> 0), te AS (SELECT * FROM pred WHERE id % 5 = 0), n AS (SELECT count(*) AS n FROM tr),
{', '.join(f"s{m} AS (SELECT v, sum(k) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, k FROM (SELECT v, sum(k) AS k FROM (SELECT {m} AS v, 1 AS k FROM tr UNION ALL SELECT {m}, 0 FROM te) GROUP BY 1))" for m in ('m1', 'm2'))}
SELECT id, ((2 * sm1.c - sm1.k + 1) / (2e0 * (n + 1)) + (2 * sm2.c - sm2.k + 1) / (2e0 * (n + 1))) / 2 AS blend FROM te JOIN sm1 ON te.m1 = sm1.v JOIN sm2 ON te.m2 = sm2.v, n""",
    f="blend",
)
def _(t):
    p = P.pred(t)
    return N.rank_ecdf(p.where("id % 5 <> 0"), p.where("id % 5 = 0"), ["m1", "m2"]).select("id", "blend")


@query(
    "blend_rank_remap",
    f"""{PR}, r AS (SELECT id, m1, row_number() OVER (ORDER BY m1, id) - 1 AS pa, row_number() OVER (ORDER BY m2, id) - 1 AS ps FROM pred),
b AS (SELECT *, row_number() OVER (ORDER BY round((0.95e0 * pa + 0.05e0 * ps) / ((SELECT count(*) FROM pred) - 1), 12), id) - 1 AS pb FROM r) SELECT b.id, a.m1 AS blend FROM b JOIN r a ON a.pa = b.pb""",
    f="blend",
)
def _(t):
    return N.rank_remap(P.pred(t).select("id", "m1", "m2"), "m1", "m2", 0.05, "id").select("id", "blend")


@query(
    "rerank_within_mask",
    f"""{PR}, i AS (SELECT *, (rank() OVER (PARTITION BY slice ORDER BY m1) + (count(*) OVER (PARTITION BY slice, m1) - 1) / 2e0 + rank() OVER (PARTITION BY slice ORDER BY m2) + (count(*) OVER (PARTITION BY slice, m2) - 1) / 2e0) / 2 AS m FROM pred WHERE price > 300000),
p AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY m, id) AS pm, row_number() OVER (PARTITION BY slice ORDER BY m1, id) AS pb FROM i)
SELECT a.id, b.m1 AS reranked FROM p a JOIN p b ON a.slice = b.slice AND a.pm = b.pb UNION ALL SELECT id, m1 FROM pred WHERE price <= 300000""",
    f="reranked",
)
def _(t):
    return N.rerank_within_mask(P.pred(t), F.col("price") > 300000, "m1", "m2", "id", ["slice"]).select("id", "reranked")


PB = f"WITH {P.PROB}"


@query(
    "blend_geometric",
    f"{PB}, g AS (SELECT id, {', '.join(f'''exp(0.6e0 * ln(a{c}) + 0.4e0 * ln(b{c})) * {1.2 if c == 'P' else 1.0}e0 AS g{c}''' for c in P.CLS)} FROM prob) SELECT id, {', '.join(f'g{c} / (gF + gO + gP) AS g_{c}' for c in P.CLS)} FROM g",
    f="g_F g_O g_P",
)
def _(t):
    return N.geometric(P.prob(t), {"a": 0.6, "b": 0.4}, P.CLS, {"P": 1.2}).select("id", "g_F", "g_O", "g_P")


LG = "least(greatest({0}, 1e-6), 1 - 1e-6)"


@query(
    "blend_logit",
    f"{PR} SELECT id, 1 / (1 + exp(-(" + " + ".join(f"{w}e0 * ln({LG.format(m)} / (1 - {LG.format(m)}))" for m, w in (("m1", 0.7), ("m2", 0.3))) + "))) AS blend FROM pred",
    f="blend",
)
def _(t):
    return N.logit_mean(P.pred(t), {"m1": 0.7, "m2": 0.3}).select("id", "blend")


HB, HS = {"m1": 0.58, "m2": 0.18, "m3": 0.14, "m4": 0.10}, (-0.035, 0.005, 0.012, 0.018)


@query(
    "blend_hrank",
    f"""{PR}, l AS ({' UNION ALL '.join(f"SELECT id, {i} AS i, {m} AS v, {w}e0 AS w FROM pred" for i, (m, w) in enumerate(HB.items()))}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) AS d, row_number() OVER (PARTITION BY id ORDER BY v, i) AS a FROM l)
SELECT id, least(greatest(0.7e0 * sum(v * (w + ({list(HS)}::DOUBLE[])[d])) + (1 - 0.7e0) * sum(v * (w + ({list(HS)}::DOUBLE[])[a])), 0.0), 1.0) AS blend FROM r GROUP BY 1""",
    f="blend",
)
def _(t):
    return N.hrank(P.pred(t), HB, HS).select("id", "blend")


@query(
    "blend_selective",
    f"""{PR}, n AS (SELECT count(*) AS n FROM pred), a AS (SELECT *, (row_number() OVER (ORDER BY m1, id) - 1) / (n - 1) AS r FROM pred, n),
d AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN r <= 0.1 OR r >= 0.9 THEN -round(abs(m2 - m1), 12) ELSE 1 END, id) AS rn FROM a)
SELECT id, CASE WHEN rn <= greatest(round_even(n * 0.02, 0), 1) AND (r <= 0.1 OR r >= 0.9) THEN 0.9e0 * m1 + 0.1e0 * m2 ELSE m1 END AS blend, CAST(rn <= greatest(round_even(n * 0.02, 0), 1) AND (r <= 0.1 OR r >= 0.9) AS INT) AS changed FROM d""",
    f="blend",
)
def _(t):
    return N.selective(P.pred(t).select("id", "m1", "m2"), "m1", "m2", "id", extreme_only=True).select("id", "blend", "changed")


@query("blend_family_mean", f"{PR} SELECT id, 'gbt' AS family, (m1 + m4) / 2 AS value, 2 AS members FROM pred UNION ALL SELECT id, 'net', m2, 1 FROM pred", f="value")
def _(t):
    p = P.pred(t)
    arr = F.array(*[F.struct(F.lit(n).alias("model"), F.col(m).alias("value")) for n, m in (("gbt_seed1", "m1"), ("gbt_seed22", "m4"), ("net_seed3", "m2"))])
    return N.family_mean(p.select("id", F.explode(arr).alias("x")).select("id", "x.*"))


AUCS = ", ".join(f"avg(CAST((m{i} >= 0.5) = (y = 1) AS INT)) AS m{i}" for i in (1, 2, 3, 4))


def _scores(t):
    p = P.pred(t)
    one = p.agg(*[F.avg(((F.col(m) >= 0.5) == (F.col("y") == 1)).cast("int")).alias(m) for m in M])
    return one.unpivot([], list(M), "model", "score")


@query(
    "weights_score_softmax",
    f"{PR}, s AS (UNPIVOT (SELECT {AUCS} FROM pred) ON m1, m2, m3, m4 INTO NAME model VALUE score), w AS (SELECT *, score - (SELECT min(score) FROM s) + 1e-3 AS sh, exp((score - (SELECT max(score) FROM s)) / 0.05e0) AS so, pow(score, 12) AS pw FROM s) SELECT model, score, score / sum(score) OVER () AS w_raw, sh / sum(sh) OVER () AS w_shifted, so / sum(so) OVER () AS w_softmax, pw / sum(pw) OVER () AS w_power FROM w",
    f="score w_raw w_shifted w_softmax w_power",
)
def _(t):
    return N.score_weights(_scores(t), 0.05)


LB = f"WITH {P.LAB}"
SP = pairs_of(P.SETS)
AGR = "agr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, avg(CAST({a} = {b} AS INT)) AS agreement FROM lab" for a, b in SP) + ")"


@query("agreement_matrix", f"{LB}, {P.PRED}, {AGR} SELECT a, b, agreement, NULL::DOUBLE AS corr, NULL::DOUBLE AS mean_abs_delta FROM agr UNION ALL "
       + " UNION ALL ".join(f"SELECT '{a}', '{b}', NULL, round(corr({a}, {b}), 9), avg(abs({a} - {b})) FROM pred" for a, b in pairs_of(M)), f="agreement corr mean_abs_delta")
def _(t):
    a = N.label_agreement(P.lab(t), P.SETS)
    s = N.score_agreement(P.pred(t), M).withColumn("corr", F.round("corr", 9))
    return a.unionByName(s, allowMissingColumns=True)


LMED = sorted(P.LB.values())[2]
SCV = ", ".join(f"('{k}', {v}e0)" for k, v in P.LB.items())


@query(
    "weights_diversity",
    f"""{LB}, {AGR}, l AS (SELECT a AS model, agreement FROM agr UNION ALL SELECT b, agreement FROM agr), s(model, score) AS (VALUES {SCV}),
j AS (SELECT model, score, avg(agreement) AS ma FROM l JOIN s USING (model) GROUP BY 1, 2), w AS (SELECT *, 1e0 AS e, least(greatest(1 + (score - {LMED}e0) * 10, 0.5), 1.5) AS sc, greatest(1 - ma, 1e-9) AS dv,
  CASE WHEN model IN ('l1', 'l4') AND (SELECT agreement FROM agr WHERE a = 'l1' AND b = 'l4') >= 0.95 THEN 0.5e0 ELSE 1e0 END AS fa, 1 / ma AS un FROM j), v AS (SELECT *, least(greatest(dv / avg(dv) OVER (), 0.5), 2.0) AS di FROM w)
SELECT model, ma AS mean_agreement, e / sum(e) OVER () AS w_equal, sc / sum(sc) OVER () AS w_score, di / sum(di) OVER () AS w_diversity, sc * di / sum(sc * di) OVER () AS w_hybrid, fa / sum(fa) OVER () AS w_family, un / sum(un) OVER () AS w_unique FROM v""",
    f="mean_agreement w_equal w_score w_diversity w_hybrid w_family w_unique",
)
def _(t):
    return N.diversity_weights(N.label_agreement(P.lab(t), P.SETS), P.LB, threshold=0.95)


COAL = "greatest(" + ", ".join("(" + " + ".join(f"CAST({s} = '{c}' AS INT)" for s in P.SETS) + ")" for c in P.CLS) + ")"


@query("vote_strength", f"{LB} SELECT {COAL} AS coalition, count(*) AS n, CAST({COAL} = 5 AS INT) AS unanimous FROM lab GROUP BY 1, 3")
def _(t):
    return N.vote_strength(P.lab(t), P.SETS, P.CLS)


VW = {"l1": 0.3, "l2": 0.2, "l3": 0.2, "l4": 0.1, "l5": 0.2}


def vt(weights, c):
    return "round(" + " + ".join(f"CASE WHEN {s} = '{c}' THEN {w!r}::DOUBLE ELSE 0::DOUBLE END" for s, w in weights.items()) + ", 12)"


def fmax(p):
    return f"CASE WHEN {p}F >= {p}O AND {p}F >= {p}P THEN 'F' WHEN {p}O >= {p}P THEN 'O' ELSE 'P' END"


@query(
    "weighted_vote",
    f"{LB}, t AS (SELECT *, {', '.join(f'{vt(VW, c)} AS z{c}' for c in P.CLS)} FROM lab), u AS (SELECT *, greatest(zF, zO, zP) AS top, CASE l1 WHEN 'F' THEN zF WHEN 'O' THEN zO ELSE zP END AS bt FROM t) SELECT id, CASE WHEN bt = top THEN l1 ELSE {fmax('z')} END AS vote, top / (zF + zO + zP) AS vote_share FROM u",
    f="vote_share",
)
def _(t):
    return N.weighted_vote(P.lab(t), VW, P.CLS, "l1").select("id", "vote", "vote_share")


@query(
    "near_duplicate_families",
    f"{LB}, {AGR} SELECT s.model, CASE WHEN s.model = 'l4' AND (SELECT agreement FROM agr WHERE a = 'l1' AND b = 'l4') >= 0.95 THEN 'l1' ELSE s.model END AS family, CAST(s.model <> 'l4' OR (SELECT agreement FROM agr WHERE a = 'l1' AND b = 'l4') < 0.95 AS INT) AS kept FROM (VALUES {SCV}) s(model, score)",
)
def _(t):
    agr = N.label_agreement(P.lab(t), P.SETS).persist()
    fam, kept = N.families(agr, P.SETS, 0.95), N.keep_diverse(agr, P.LB, 0.95)
    agr.unpersist()
    return t.spark.createDataFrame([(s, fam[s], int(s in kept)) for s in P.SETS], "model string, family string, kept int")


FS = {"l2": 0.66, "l3": 0.60, "l5": 0.64, "l1": 0.70}
FM = (0.64 + 0.66) / 2
FW = {k: min(max(1 + (v - FM) * 10, 0.5), 1.5) for k, v in FS.items()}


@query(
    "anchor_override",
    f"{LB}, t AS (SELECT *, {', '.join(f'{vt(FW, c)} AS z{c}' for c in P.CLS)} FROM lab), u AS (SELECT *, {fmax('z')} AS ch, greatest(zF, zO, zP) / (zF + zO + zP) AS confidence FROM t) SELECT id, confidence, CASE WHEN ch <> l1 AND confidence >= 0.7 AND {' + '.join(f'CAST({s} = ch AS INT)' for s in FW)} >= 3 THEN ch ELSE l1 END AS override FROM u",
    f="confidence",
)
def _(t):
    # l1 and l4 form one family; l1 has the better score and so decides a one-to-one tie inside it
    fam = {"l1": "l1", "l2": "l2", "l3": "l3", "l4": "l1", "l5": "l5"}
    return N.anchor_override(P.lab(t), fam, P.LB, P.CLS, 0.7).select("id", "confidence", "override")


@query(
    "vote_with_probability_judge",
    f"{LB}, {P.PROB}, t AS (SELECT lab.*, {', '.join(f'''({vt(VW, c)} + 0.4e0 * a{c}) * {1.1 if c == 'P' else 1.0}e0 AS z{c}''' for c in P.CLS)} FROM lab JOIN prob USING (id)) SELECT id, CASE WHEN l1 = l2 AND l1 = l3 AND l1 = l4 AND l1 = l5 THEN l1 ELSE {fmax('z')} END AS vote FROM t",
)
def _(t):
    rows = P.lab(t).join(P.prob(t).select("id", "aF", "aO", "aP"), "id")
    return N.vote_with_judge(rows, VW, P.CLS, {c: f"a{c}" for c in P.CLS}, 0.4, {"P": 1.1}).select("id", "vote")


def _loo():
    import math

    parts = []
    for hh in P.SETS:
        top = max(v for k, v in P.LB.items() if k != hh)
        w = {s: math.exp((P.LB[s] - top) / 0.05) for s in P.SETS if s != hh}
        parts.append(
            f"SELECT '{hh}' AS held_out, avg(r) AS balanced_accuracy FROM (SELECT {hh}, avg(CAST(v = {hh} AS INT)) AS r FROM (SELECT {hh}, {fmax('z')} AS v FROM (SELECT {hh}, {', '.join(f'{vt(w, c)} AS z{c}' for c in P.CLS)} FROM lab)) GROUP BY 1)"
        )
    return " UNION ALL ".join(parts)


@query("leave_one_model_out", f"{LB} {_loo()}", f="balanced_accuracy")
def _(t):
    return N.leave_one_out(P.lab(t), P.LB, P.CLS)


@query(
    "prior_correction",
    f"{LB}, {P.PROB}, g AS (SELECT {', '.join(f'''avg(CAST(l1 = '{c}' AS INT)) AS z{c}''' for c in P.CLS)} FROM lab), m AS (SELECT {', '.join(f'avg(a{c}) AS m{c}' for c in P.CLS)} FROM prob), r AS (SELECT id, {', '.join(f'a{c} * (z{c} / greatest(m{c}, 1e-9)) AS r{c}' for c in P.CLS)} FROM prob, g, m) SELECT id, {', '.join(f'r{c} / (rF + rO + rP) AS p_{c}' for c in P.CLS)} FROM r",
    f="p_F p_O p_P",
)
def _(t):
    goal = P.lab(t).agg(F.struct(*[F.avg((F.col("l1") == c).cast("int")).alias(c) for c in P.CLS]).alias("g")).scalar()
    return N.prior_correction(P.prob(t), {c: f"a{c}" for c in P.CLS}, goal).select("id", "p_F", "p_O", "p_P")


@query("sinkhorn_balance")
def _(t):
    p = P.prob(t)
    return N.sinkhorn(p, {c: f"a{c}" for c in P.CLS}, {"F": 0.2, "O": 0.3, "P": 0.5}).select("id", "q_F", "q_O", "q_P", "decision")


@query(
    "anchor_gate_top_n",
    f"{LB}, {P.PROB}, m AS (SELECT id, l1, {fmax('a')} AS lab_, round(greatest(aF, aO, aP) - (aF + aO + aP - greatest(aF, aO, aP) - least(aF, aO, aP)), 9) AS mg FROM lab JOIN prob USING (id)), r AS (SELECT *, row_number() OVER (ORDER BY mg DESC, id) AS rn FROM m) SELECT id, CASE WHEN rn <= 3000 THEN lab_ ELSE l1 END AS gated, CAST(rn <= 3000 AND lab_ <> l1 AS INT) AS changed FROM r",
)
def _(t):
    rows = P.prob(t).join(P.lab(t).select("id", "l1"), "id")
    return N.anchor_gate(rows, {c: f"a{c}" for c in P.CLS}, "l1", "id", 3000).select("id", "gated", "changed")


G2 = N.simplex_grid(2, 20)


@query(
    "weight_search_simplex",
    f"{PB}, g(wa, wb, name) AS (VALUES {', '.join(f'''({a}e0, {b}e0, '{a:g}/{b:g}')''' for a, b in G2)}), x AS (SELECT name, target, {', '.join(f'round(wa * a{c} + wb * b{c}, 12) AS z{c}' for c in P.CLS)} FROM prob, g), r AS (SELECT name, target, avg(CAST({fmax('z')} = target AS INT)) AS rec FROM x GROUP BY 1, 2) SELECT name AS weights, avg(rec) AS balanced_accuracy FROM r GROUP BY 1",
    f="balanced_accuracy",
)
def _(t):
    return N.weight_grid_accuracy(P.prob(t), ["a", "b"], P.CLS, "target", G2).drop("setting")


G3 = N.simplex_grid(3, 4)


@query(
    "cross_weight_grid",
    f"""{PR}, g(w1, w2, w3, weights) AS (VALUES {', '.join(f"({a}e0, {b}e0, {c}e0, '{a:g}/{b:g}/{c:g}')" for a, b, c in G3)}), x AS (SELECT slice, y, id, weights, round(w1 * m1 + w2 * m2 + w3 * m3, 12) AS s FROM pred, g),
r AS (SELECT *, row_number() OVER w AS rn, sum(y) OVER w AS hits, count(*) OVER (PARTITION BY weights, slice) AS n, sum(y) OVER (PARTITION BY weights, slice) AS pos FROM x WINDOW w AS (PARTITION BY weights, slice ORDER BY s DESC, id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT weights, slice, sum(CASE WHEN y = 1 THEN hits / rn ELSE 0 END) / greatest(least(ceil(n * 0.2), pos), 1) AS ap FROM r WHERE rn <= ceil(n * 0.2) GROUP BY weights, slice, n, pos) SELECT weights, avg(ap) AS ap FROM a GROUP BY 1""",
    f="ap",
)
def _(t):
    return N.cross_weight_grid(P.pred(t), ["slice"], ["m1", "m2", "m3"], "y", G3, "id")


@query("weight_hill_climb")
def _(t):
    return N.hill_climb(P.prob(t), ["a", "b"], P.CLS, "target")


@query("weight_convex_logloss")
def _(t):
    return N.convex_logloss(P.pred(t), list(M), "y")


@query(
    "class_multiplier_search",
    f"{PB}, g(x) AS (VALUES {', '.join(f'({0.5 + 0.05 * i!r}::DOUBLE)' for i in range(31))}), k AS (SELECT target, x, round(aF, 12) AS zF, round(aO, 12) AS zO, round(aP * x, 12) AS zP FROM prob, g), r AS (SELECT x, target, avg(CAST({fmax('z')} = target AS INT)) AS rec FROM k GROUP BY 1, 2) SELECT 'P' AS class, x AS multiplier, avg(rec) AS balanced_accuracy FROM r GROUP BY 2",
    f="multiplier balanced_accuracy",
)
def _(t):
    return N.multiplier_grid(P.prob(t), {c: f"a{c}" for c in P.CLS}, "target", "P", {})


@query("class_multiplier_greedy")
def _(t):
    return N.multiplier_search(P.prob(t), {c: f"a{c}" for c in P.CLS}, "target")


@query(
    "stack_meta_features",
    f"{PR} SELECT id, (m1 + m2 + m3) / 3 AS s_mean, round(sqrt((pow(m1 - (m1 + m2 + m3) / 3, 2) + pow(m2 - (m1 + m2 + m3) / 3, 2) + pow(m3 - (m1 + m2 + m3) / 3, 2)) / 3), 9) AS s_std, greatest(m1, m2, m3) - least(m1, m2, m3) AS s_range, m1 - m2 AS m1_minus_m2, m1 - m3 AS m1_minus_m3, m2 - m3 AS m2_minus_m3, {rk('m1', '')} AS m1_rank, {rk('m2', '')} AS m2_rank, {rk('m3', '')} AS m3_rank FROM pred",
    f="s_mean s_std s_range m1_minus_m2 m1_minus_m3 m2_minus_m3 m1_rank m2_rank m3_rank",
)
def _(t):
    out = N.stack_features(P.pred(t).select("id", "m1", "m2", "m3"), ["m1", "m2", "m3"])
    return out.drop("m1", "m2", "m3").withColumn("s_std", F.round("s_std", 9))


@query(
    "candidate_report",
    f"""{PR}, x AS (SELECT *, 0.98e0 * m1 + 0.02e0 * m2 AS c1, 0.9e0 * m1 + 0.1e0 * m3 AS c2, 0.98e0 * m1 + 0.02e0 * m2 AS c3 FROM pred)
{' UNION ALL '.join(f"SELECT '{c}' AS blend, '{r}' AS recipe, corr({c}, m1) AS corr, avg(abs({c} - m1)) AS delta, count(*) FILTER (abs({c} - m1) > 1e-9) AS changed_rows, CASE WHEN avg(abs({c} - m1)) < 0.005 THEN 'low' WHEN avg(abs({c} - m1)) < 0.02 THEN 'medium' ELSE 'high' END AS risk, {d} AS duplicate_of FROM x" for c, r, d in (('c1', '98/2', 'CAST(NULL AS VARCHAR)'), ('c2', '90/10', 'CAST(NULL AS VARCHAR)'), ('c3', '98/2 again', "'c1'")))}""",
    f="corr delta",
)
def _(t):
    x = P.pred(t).withColumns({"c1": F.expr("0.98e0 * m1 + 0.02e0 * m2"), "c2": F.expr("0.9e0 * m1 + 0.1e0 * m3"), "c3": F.expr("0.98e0 * m1 + 0.02e0 * m2")})
    return N.candidate_report(x, "m1", {"c1": "98/2", "c2": "90/10", "c3": "98/2 again"})


UG = "SELECT user_id, value AS y, 50e0 + event_id % 7 AS p, 45e0 + event_id % 11 AS f, abs(value - 40e0) AS s1, CAST(event_id % 13 AS DOUBLE) AS s2 FROM events"


@query(
    "uncertainty_gate",
    f"""WITH x AS ({UG}), e AS (SELECT user_id, count(*) AS n, sum(pow(p - y, 2)) AS sp, sum(pow(f - y, 2)) AS sf, quantile_cont(s1, 0.5) AS a, quantile_cont(s2, 0.5) AS b FROM x GROUP BY 1),
k AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM e), k2 AS (SELECT quantile_cont(abs(a - ma), 0.5) AS da, quantile_cont(abs(b - mb), 0.5) AS db FROM e, k),
u AS (SELECT e.*, ((a - ma) / greatest(1.4826e0 * da, 1e-6) + (b - mb) / greatest(1.4826e0 * db, 1e-6)) / 2 AS u FROM e, k, k2),
g AS (SELECT q, w FROM (VALUES (0.70e0), (0.80e0), (0.85e0), (0.90e0), (0.95e0)) q(q), (VALUES (0.10e0), (0.20e0), (0.25e0), (0.35e0)) w(w)),
c AS (SELECT {', '.join(f'quantile_cont(u, {q}) AS q{int(q * 100)}' for q in N.QUANTILES)} FROM u),
s AS (SELECT q, w, user_id, n, sp, sf, round(u, 9) >= round(CASE q WHEN 0.70e0 THEN q70 WHEN 0.80e0 THEN q80 WHEN 0.85e0 THEN q85 WHEN 0.90e0 THEN q90 ELSE q95 END, 9) AS gate FROM u, g, c),
t AS (SELECT q, w, user_id, n, CAST(gate AS INT) AS gated, CASE WHEN gate THEN pow(1 - w, 2) * sp + pow(w, 2) * sf ELSE sp END AS sse FROM s UNION ALL SELECT 0, 0, user_id, n, 0, sp FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY q, w ORDER BY sse DESC, user_id) AS rn FROM t),
o AS (SELECT q AS quantile, w AS anchor_weight, CAST(sum(gated) AS BIGINT) AS gated_entities, sqrt(sum(sse) / sum(n)) AS pooled_rmse, sum(sse) FILTER (rn <= (SELECT ceil(count(*) * 0.1) FROM e)) / sum(sse) AS worst_share FROM r GROUP BY 1, 2)
SELECT *, CAST(pooled_rmse < (SELECT pooled_rmse FROM o WHERE quantile = 0) - 0.01 AND worst_share <= (SELECT worst_share FROM o WHERE quantile = 0) AS INT) AS accepted FROM o""",
    f="quantile anchor_weight pooled_rmse worst_share",
)
def _(t):
    x = t.spark.sql(UG.replace("FROM events", "FROM {events}"), events=t.events)
    return N.uncertainty_gate(x, "user_id", "y", "p", "f", ["s1", "s2"])


@query("guarded_blend", f"{PR} SELECT id, CASE WHEN price % 1000 <= 150 THEN (1 - 0.6e0) * m1 + 0.6e0 * m2 ELSE (1 - 0.2e0) * m1 + 0.2e0 * m2 END AS blend FROM pred", f="blend")
def _(t):
    return N.guarded(P.pred(t).withColumn("dist", F.expr("price % 1000")), "m1", "m2", "dist").select("id", "blend")


@query(
    "gate_accept",
    f"{PR}, s AS (SELECT yr, avg(CAST((m1 >= 0.5) = (y = 1) AS INT)) AS b, avg(CAST(((0.9e0 * m1 + 0.1e0 * m2) >= 0.5) = (y = 1) AS INT)) AS v FROM pred GROUP BY 1) SELECT round(min(v - b), 9) AS worst, round(max(v - b), 9) AS best, CAST(min(v - b) >= -0.002 AND max(v - b) >= 0.001 AS INT) AS accept, CAST(min(v - b) >= 0.001 AS INT) AS accept_strict FROM s",
    f="worst best",
)
def _(t):
    p = P.pred(t)
    ok = lambda e: F.avg((F.expr(f"({e}) >= 0.5") == (F.col("y") == 1)).cast("int"))
    per = p.groupBy(F.col("yr").alias("holdout")).agg(ok("m1").alias("base"), ok("0.9e0 * m1 + 0.1e0 * m2").alias("mix"))
    out = N.gate_accept(per.unpivot(["holdout"], ["base", "mix"], "variant", "score"), "mix", "base")
    return out.withColumns({"worst": F.round("worst", 9), "best": F.round("best", 9)})
