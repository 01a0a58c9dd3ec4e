"""Data quality, schema and leakage audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from quern.functions.ordered import join_keys, quantiles


def cells(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per (kept columns, column, value as string)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def row_digest(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """Digest of a whole row; nulls and separators cannot collide with values."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols or df.columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def roles(df: DataFrame) -> dict[str, str]:
    return {
        f.name: "numeric" if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) else "categorical"
        for f in df.schema
    }


def dataset_overview(sets: dict[str, DataFrame], id_col: str, target: str | None = None) -> DataFrame:
    """Rows, columns, target rate, missing cells, duplicate ids and duplicate rows of each dataset."""
    out = None
    for name, df in sets.items():
        missing = sum((F.sum(F.col(c).isNull().cast("int")) for c in df.columns), F.lit(0))
        rate = F.avg(target) if target and target in df.columns else F.lit(None).cast("double")
        one = df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_cols"),
            rate.alias("target_rate"),
            missing.alias("missing_cells"),
        )
        ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).agg((F.sum("k") - F.count(F.lit(1))).alias("duplicate_ids"))
        whole = (
            df.groupBy(row_digest(df).alias("h")).agg(F.count(F.lit(1)).alias("k"))
            .agg((F.sum("k") - F.count(F.lit(1))).alias("duplicate_rows"))
        )
        one = one.select(
            F.lit(name).alias("dataset"), "*", ids.scalar().alias("duplicate_ids"), whole.scalar().alias("duplicate_rows")
        )
        out = one if out is None else out.unionByName(one)
    return out


def schema_summary(df: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Per column: role, type, missing count and share, distinct count, for one table or two side by side."""

    def stats(d: DataFrame, sfx: str) -> DataFrame:
        counts = cells(d, d.columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
        return counts.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias(f"missing{sfx}"),
            F.sum("k").alias("_n"),
            F.count("value").alias(f"unique{sfx}"),
        ).select("column", f"missing{sfx}", (100.0 * F.col(f"missing{sfx}") / F.col("_n")).alias(f"missing_pct{sfx}"), f"unique{sfx}")

    kind = roles(df)
    types = dict(df.dtypes)
    role = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])
    typ = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    out = stats(df, "").withColumns({"role": role[F.col("column")], "dtype": typ[F.col("column")]})
    return out if other is None else out.join(stats(other, "_2"), "column", "left")


def constant_columns(df: DataFrame, low: int = 3) -> DataFrame:
    """Distinct values per column with null counted as a value; flags for constant and low-variance columns."""
    counts = cells(df, df.columns).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
    return counts.select(
        "column", "n_values", (F.col("n_values") <= 1).cast("int").alias("is_constant"), (F.col("n_values") <= low).cast("int").alias("is_low")
    )


def integrity_checks(train: DataFrame, test: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Named checks with the number of offending ids or rows."""

    def dup(df: DataFrame, key: Column) -> DataFrame:
        return df.groupBy(key.alias("h")).agg(F.count(F.lit(1)).alias("k")).agg((F.sum("k") - F.count(F.lit(1))).alias("n"))

    def size(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"))

    a, b, s = (d.select(id_col).distinct() for d in (train, test, sample))
    parts = {
        "train_duplicate_ids": dup(train, F.col(id_col)),
        "test_duplicate_ids": dup(test, F.col(id_col)),
        "train_test_overlap": size(a.join(b, id_col, "left_semi")),
        "test_not_in_sample": size(b.join(s, id_col, "left_anti")),
        "sample_not_in_test": size(s.join(b, id_col, "left_anti")),
        "train_duplicate_rows": dup(train, row_digest(train)),
    }
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def require_columns(df: DataFrame, columns: Sequence[str], unique: str | None = None, not_null: Sequence[str] = ()) -> DataFrame:
    """The frame itself if it has the columns, no nulls in ``not_null`` and a unique id; otherwise ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not_null:
        nulls = df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0)).alias(c) for c in not_null]).first().asDict()
        bad = {c: n for c, n in nulls.items() if n}
        if bad:
            raise ValueError(f"nulls in required columns: {bad}")
    if unique:
        repeated = df.groupBy(unique).count().where("count > 1").limit(5).collect()
        if repeated:
            raise ValueError(f"{unique} is not unique, e.g. {[r[0] for r in repeated]}")
    return df


def join_validate(left: DataFrame, right: DataFrame, on: str, left_unique: bool = False) -> DataFrame:
    """One-row report of an m:1 (or 1:1) join: repeated right keys, unmatched left rows, rows after a left join."""
    r = right.groupBy(on).agg(F.count(F.lit(1)).alias("_k"))
    l = left.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    j = l.join(r, on, "left")
    rep = j.agg(
        F.sum("_n").alias("left_rows"),
        F.sum(F.col("_n") * F.coalesce("_k", F.lit(1))).alias("joined_rows"),
        F.sum(F.when(F.col("_k").isNull(), F.col("_n")).otherwise(0)).alias("unmatched_left"),
        F.sum((F.col("_n") > 1).cast("int")).alias("repeated_left_keys"),
    )
    dup = r.agg(F.sum((F.col("_k") > 1).cast("int")).alias("n")).scalar()
    ok = (F.col("repeated_right_keys") == 0) & (F.col("joined_rows") == F.col("left_rows"))
    if left_unique:
        ok = ok & (F.col("repeated_left_keys") == 0)
    return rep.withColumn("repeated_right_keys", dup).withColumn("valid", ok.cast("int"))


def cross_split_overlap(a: DataFrame, b: DataFrame, features: Sequence[str]) -> DataFrame:
    """Full feature vectors present in both splits (null equals null) with their counts on each side."""
    ca = a.groupBy(*features).agg(F.count(F.lit(1)).alias("n_a"))
    cb = b.groupBy(*features).agg(F.count(F.lit(1)).alias("n_b"))
    return join_keys(ca, cb, features, "inner")


def column_match_rate(a: DataFrame, b: DataFrame, entity: str, row: str, cols: Sequence[str], tol: float = 0.0) -> DataFrame:
    """Per entity and column: share of positionally equal values (null = null) and largest absolute difference."""
    right = b.select(F.col(entity), F.col(row), *[F.col(c).alias(f"_{c}") for c in cols])
    pairs = a.select(entity, row, *cols).join(right, [entity, row])
    arr = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(f"_{c}").cast("double").alias("y")) for c in cols]
    )
    long = pairs.select(entity, F.explode(arr).alias("p")).select(entity, "p.*")
    same = F.coalesce(F.abs(F.col("x") - F.col("y")) <= tol, F.col("x").isNull() & F.col("y").isNull())
    return long.groupBy(entity, "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(same.cast("int")).alias("match_rate"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_diff")
    )


def column_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns only in one table or in both, with the number of non-null values on each side."""

    def filled(d: DataFrame, name: str) -> DataFrame:
        one = d.agg(*[F.count(c).alias(c) for c in d.columns])
        return one.unpivot([], d.columns, "column", name)

    j = filled(a, "values_a").join(filled(b, "values_b"), "column", "full")
    side = F.when(F.col("values_b").isNull(), "only_a").when(F.col("values_a").isNull(), "only_b").otherwise("both")
    return j.withColumn("side", side)


def missing_summary(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> DataFrame:
    both = train.select(*cols, F.lit(0).alias("_s")).unionByName(test.select(*cols, F.lit(1).alias("_s")))
    miss = F.col("value").isNull().cast("int")
    rate = lambda s: 100.0 * F.avg(F.when(F.col("_s") == s, miss))
    out = cells(both, cols, ["_s"]).groupBy("column").agg(rate(0).alias("train_pct"), rate(1).alias("test_pct"))
    return out.withColumn("delta_points", F.col("test_pct") - F.col("train_pct"))


def missing_by_target(df: DataFrame, cols: Sequence[str], target: str, classes: Sequence) -> DataFrame:
    miss = F.col("value").isNull().cast("int")
    names = [f"miss_{c}" for c in classes]
    out = cells(df, cols, [target]).groupBy("column").agg(
        *[(100.0 * F.avg(F.when(F.col(target) == c, miss))).alias(n) for c, n in zip(classes, names)]
    )
    return out.withColumn("spread", F.greatest(*names) - F.least(*names))


def missing_signal(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Class share when a feature is missing or present, and its lift against the overall share in points."""
    state = F.when(F.col("value").isNull(), "missing").otherwise("present")
    counts = cells(df, cols, [target]).groupBy("column", state.alias("state"), target).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("column", "state").agg(F.sum("n").alias("_t"))
    base = counts.groupBy("column", target).agg(F.sum("n").alias("_c")).join(counts.groupBy("column").agg(F.sum("n").alias("_a")), "column")
    out = counts.join(tot, ["column", "state"]).join(base, ["column", target])
    share = 100.0 * F.col("n") / F.col("_t")
    return out.select("column", "state", target, "n", share.alias("share_pct"), (share - 100.0 * F.col("_c") / F.col("_a")).alias("lift_points"))


SENTINELS = (-9999, -999, 9999, 99, -99)  # fixed values: placeholder codes looked for


def sentinel_report(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Placeholder values, values outside the given limits, minimum and maximum per numeric column."""
    cols = list(limits)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    lo = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(limits[c][0])))])
    hi = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(limits[c][1])))])
    v, c = F.col("v"), F.col("column")
    out = (v < lo[c]) | (v > hi[c])
    return df.select(F.explode(arr).alias("p")).select("p.*").groupBy("column").agg(
        F.sum(F.coalesce(v.isin(*[float(s) for s in SENTINELS]).cast("int"), F.lit(0))).alias("n_sentinel"),
        F.sum(F.coalesce(out.cast("int"), F.lit(0))).alias("n_outside"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def iqr_outliers(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR per column, with their share in percent."""
    want = {f"{c}|{p}": (c, p) for c in cols for p in (0.25, 0.75)}
    q = quantiles(df, [], want, limit)
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}|0.25`").alias("q1"), F.col(f"`{c}|0.75`").alias("q3")) for c in cols])
    bounds = q.select(F.explode(arr).alias("p")).select("p.*")  # one row per column
    vals = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.explode(vals).alias("p")).select("p.*").where("v IS NOT NULL").join(F.broadcast(bounds), "column")
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    bad = ((F.col("v") < lo) | (F.col("v") > hi)).cast("int")
    return long.groupBy("column", lo.alias("lower"), hi.alias("upper")).agg(
        F.sum(bad).alias("n_outliers"), (100.0 * F.avg(bad)).alias("pct")
    )


def id_alignment(a: DataFrame, b: DataFrame, id_col: str, pos: str) -> DataFrame:
    """Two id lists with positions: missing, extra and displaced ids and whether the order is the same."""
    j = a.select(id_col, F.col(pos).alias("_p")).join(b.select(id_col, F.col(pos).alias("_q")), id_col, "full")
    p, q = F.col("_p"), F.col("_q")
    flag = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    out = j.agg(flag(q.isNull()).alias("missing"), flag(p.isNull()).alias("extra"), flag(p != q).alias("displaced"))
    return out.withColumn("same_order", ((F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("displaced") == 0)).cast("int"))


def prediction_validator(preds: DataFrame, n_expected: int | Column, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Per prediction set (model, id, value): unique ids, nulls, non-finite, range and row count, with a verdict.

    Counts per (model, id) come first, so one very large set is spread over tasks.
    """
    v = F.col("value").cast("double")
    bad = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    infinite = v.isin(float("inf"), float("-inf")) | F.isnan(v)
    per = preds.groupBy("model", "id").agg(
        F.count(F.lit(1)).alias("k"), bad(v.isNull()).alias("nulls"), bad(infinite).alias("not_finite"),
        bad(~infinite & ((v < lo) | (v > hi))).alias("out_of_range"),
    )
    out = per.groupBy("model").agg(
        F.sum("k").alias("n_rows"),
        F.sum((F.col("k") > 1).cast("int")).alias("duplicate_ids"),
        *[F.sum(c).alias(c) for c in ("nulls", "not_finite", "out_of_range")],
    )
    n = F.lit(n_expected) if isinstance(n_expected, int) else n_expected
    reason = (
        F.when(F.col("n_rows") != n, "row_count").when(F.col("duplicate_ids") > 0, "duplicate_ids")
        .when(F.col("nulls") > 0, "nulls").when(F.col("not_finite") > 0, "not_finite")
        .when(F.col("out_of_range") > 0, "out_of_range").otherwise("ok")
    )
    return out.withColumn("verdict", reason)


def exact_duplicate_sets(preds: DataFrame) -> DataFrame:
    """Prediction sets with identical content: order-independent fingerprint per model, first name keeps."""
    h = F.xxhash64("id", "value").cast("decimal(38,0)")
    h2 = F.xxhash64("value", "id", F.lit(17)).cast("decimal(38,0)")
    marks = preds.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h1"), F.sum(h2).alias("h2"))
    groups = marks.groupBy("n", "h1", "h2").agg(F.min("model").alias("kept"))
    return marks.join(groups, ["n", "h1", "h2"]).select("model", "n", "kept", (F.col("model") != F.col("kept")).cast("int").alias("is_duplicate"))


def impossible_combo(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each business rule."""
    one = df.agg(*[F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in rules.items()], F.count(F.lit(1)).alias("_n"))
    return one.unpivot(["_n"], list(rules), "rule", "n_rows").select("rule", "n_rows", (100.0 * F.col("n_rows") / F.col("_n")).alias("pct"))


def file_inventory(files: DataFrame) -> DataFrame:
    """Counts per split and kind, ids that have every kind of file, from a listing (split, kind, id, columns)."""
    kinds = files.select("split", "kind").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n_kinds"))
    full = files.groupBy("split", "id").agg(F.countDistinct("kind").alias("k")).join(kinds, "split")
    full = full.groupBy("split").agg(F.sum((F.col("k") == F.col("n_kinds")).cast("int")).alias("complete_ids"))
    per = files.groupBy("split", "kind").agg(
        F.count(F.lit(1)).alias("n_files"), F.countDistinct("id").alias("n_ids"), F.countDistinct("columns").alias("n_schemas")
    )
    return per.join(full, "split")
