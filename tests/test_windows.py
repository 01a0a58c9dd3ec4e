"""Window matching against all pairs."""

import numpy as np
import pytest

from quern.operators import align


def smooth(x):
    return np.array([x[max(0, i - 2) : i + 3].mean() for i in range(len(x))])


def normed(w):
    return (w - w.mean(1, keepdims=True)) / (w.std(1, keepdims=True) + 1e-6)


def brute(known, value, suffix, half, stride=3):
    size = 2 * half + 1
    if len(known) <= size:
        return [(value[-1], 0.0)] * len(suffix)
    g = smooth(known)
    starts = np.arange(0, len(g) - size + 1, stride)
    c = normed(np.stack([g[s : s + size] for s in starts]))
    padded = np.pad(smooth(suffix), half, mode="edge")
    w = normed(np.stack([padded[i : i + size] for i in range(len(suffix))]))
    score = np.round(w @ c.T / size, 9)
    return [(value[starts[r.argmax()] + half], r.max()) for r in score]


@pytest.fixture(scope="module")
def series(spark):
    """Walks, a periodic and a constant series, one with a short known part; every suffix returns to known shapes."""
    rng = np.random.default_rng(3)
    walk = rng.normal(0, 1, 200).cumsum()
    out = {
        1: (walk, np.concatenate([walk[100:160] * 2 + 5, rng.normal(0, 1, 30).cumsum()])),
        2: (np.tile(np.arange(12.0) % 5, 12), np.tile(np.arange(12.0) % 5, 3)),
        3: (np.full(80, 4.0), np.full(10, 4.0)),
        4: (rng.normal(0, 1, 31).cumsum(), rng.normal(0, 1, 40).cumsum()),
        5: (rng.normal(0, 1, 3), rng.normal(0, 1, 4)),
    }
    rows = []
    for e, (k, s) in out.items():
        for i, v in enumerate([*k, *s]):
            rows.append((e, len(rows), float(i), float(v), float(1000 + i) if i < len(k) else None, i + 1, len(k), float(1000 + len(k) - 1), "x"))
    return out, spark.createDataFrame(rows, "e long, u long, md double, value double, tvt double, rn long, n_known long, last_known double, shape string")


def test_best_window_equals_all_pairs(series):
    data, p = series
    got = {r["u"]: r for r in align.match_ncc(p, "e", "md", "u", "tvt", "value").collect()}
    u = matched = rows = 0
    for known, suffix in data.values():
        u += len(known)
        at = 1000.0 + np.arange(len(known))
        want = {h: brute(known, at, suffix, h) for h in (8, 15, 25)}
        for i in range(len(suffix)):
            r = got.pop(u + i)
            for h in (8, 15, 25):
                # windows that correlate equally to nine digits may differ by the order of addition: hold the score
                assert r[f"score_{h}"] == pytest.approx(want[h][i][1], abs=2e-9)
                if len(known) > 2 * h + 1:
                    rows += 1
                    matched += r[f"score_{h}"] != 0 or len(set(known)) == 1
                if len(known) == 200 or len(known) <= 2 * h + 1:
                    assert r[f"pos_{h}"] == want[h][i][0]
        u += len(suffix)
    assert not got and matched / rows > 0.95


def test_bounds_leave_most_candidates_out(series):
    """Every candidate's correlation lies below the bound of its word, at both resolutions."""
    rng = np.random.default_rng(4)
    size = 17
    lo, hi = np.array(align._parts(size, align.COARSE)).T
    assert lo[0] == 0 and sum(hi) == size
    a, b = (normed(rng.normal(0, 1, (200, size)).cumsum(1)) for _ in range(2))
    for parts in (align.COARSE, align.FINE):
        cut = align._parts(size, parts)
        ma, mb = (np.stack([x[:, s : s + n].mean(1) for s, n in cut], 1) for x in (a, b))
        away = ((ma[:, None] - mb[None]) ** 2 * np.array([n for _, n in cut])).sum(2)
        bound = ((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - away) / (2 * size)
        assert (a @ b.T / size <= bound + 1e-9).all()


def test_short_series_are_matched_in_one_row(spark, series):
    """Series of few known rows need no join of windows and get what the search by words gives."""
    p = series[1].where("e > 2")
    odd = "e long, u long, md double, value double, tvt double, rn long, n_known long, last_known double, shape string"
    holes = [(6, 900 + i, float(i), None if i % 7 == 3 else float(i * i % 11), 50.0 + i if i < 40 else None, i + 1, 40, 89.0, "x") for i in range(60)]
    nameless = [(None, 990 + i, float(i), float(i % 4), 50.0 + i if i < 40 else None, i + 1, 40, 89.0, "x") for i in range(44)]
    p = p.unionByName(spark.createDataFrame(holes + nameless, odd))
    args = (p, "e", "md", "u", "tvt", "value")
    short, long = align.match_ncc(*args), align.match_ncc(*args, short=0)
    assert "Join" not in short._jdf.queryExecution().executedPlan().toString()
    key = lambda r: r["u"]
    got, want = (sorted((r.asDict() for r in d.collect()), key=key) for d in (short, long))
    assert len(got) == 10 + 40 + 4 + 20 + 4
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-9, nan_ok=True)
