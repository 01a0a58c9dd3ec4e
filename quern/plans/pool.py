"""Prediction sets derived from the orders table: scores, class probabilities and labels as SQL expressions.

The expressions are valid in both engines, so the same text builds the frame and the comparison query.
"""

from quern.registry import Tables


def h(s: int) -> str:
    return f"((id * {s}) % 1009 / 1009e0)"


MODELS = ("m1", "m2", "m3", "m4")
SCORES = {
    "m1": f"0.35e0 * y + 0.65e0 * {h(7919)}",
    "m2": f"0.30e0 * y + 0.70e0 * {h(104729)}",
    "m3": f"0.25e0 * y + 0.75e0 * {h(1299709)}",
    "m4": f"0.32e0 * y + 0.60e0 * {h(7919)} + 0.08e0 * {h(31)}",
}
CLS = ("F", "O", "P")
RAW = {f"{m}{c}": f"0.2e0 + {h(s + i)} + CASE WHEN target = '{c}' THEN {b}e0 ELSE 0e0 END" for m, s, b in (("a", 7919, 0.8), ("b", 15485863, 0.6)) for i, c in enumerate(CLS)}


def _label(s: int, p: float, q: float) -> str:
    idx = "CASE target WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
    turn = f"CASE WHEN {h(s)} < {p}e0 THEN 0 WHEN {h(s)} < {q}e0 THEN 1 ELSE 2 END"
    return f"CASE (({idx}) + ({turn})) % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END"


SETS = ("l1", "l2", "l3", "l4", "l5")
LABELS = {
    "l1": _label(7919, 0.7, 0.9),
    "l2": _label(104729, 0.66, 0.8),
    "l3": _label(1299709, 0.6, 0.85),
    "l4": _label(7919, 0.69, 0.9),
    "l5": _label(613, 0.64, 0.7),
}
LB = {"l1": 0.70, "l2": 0.66, "l3": 0.60, "l4": 0.69, "l5": 0.64}  # fixed values: public score of each label set

BASE = "SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS slice, o_orderstatus AS target, CAST(o_orderstatus = 'F' AS INT) AS y, o_totalprice AS price, CAST(year(o_orderdate) AS INT) AS yr FROM orders"


def _cols(d: dict) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in d.items())


PRED = f"pred AS (SELECT *, {_cols(SCORES)} FROM ({BASE}) b)"
_NORM = ", ".join(f"r_{m}{c} / (r_{m}F + r_{m}O + r_{m}P) AS {m}{c}" for m in "ab" for c in CLS)
PROB = f"prob AS (SELECT id, cust, slice, target, y, price, {_NORM} FROM (SELECT *, {_cols({'r_' + k: v for k, v in RAW.items()})} FROM ({BASE}) b) r)"
LAB = f"lab AS (SELECT *, {_cols(LABELS)} FROM ({BASE}) b)"


def _frame(t: Tables, inner: str):
    # FROM orders becomes the parquet table of the folder at hand
    return t.spark.sql(inner.replace("FROM orders", "FROM {orders}"), orders=t.orders)


def pred(t: Tables):
    return _frame(t, f"SELECT *, {_cols(SCORES)} FROM ({BASE}) b")


def prob(t: Tables):
    return _frame(t, PROB[len("prob AS ("):-1])


def lab(t: Tables):
    return _frame(t, f"SELECT *, {_cols(LABELS)} FROM ({BASE}) b")
