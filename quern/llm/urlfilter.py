"""URL filter: allow and block rules first, then the ratio of two character language models.

Rules ``host/path`` fit their host and all its subdomains if the url's path starts with the rule's; the longest wins,
at equal length the blocking one. Urls that no rule decides are judged by two smoothed variable-order Markov models
over the characters of host and path, one of urls that rules accept, one of urls that they reject. Orders are
interpolated by the number of distinct followers of a context (Witten and Bell). The log-likelihood difference, divided
by the number of characters, is held against a threshold calibrated for balanced accuracy on every fifth url of the
ruled ones, which the models do not see. Scores at or above the threshold are allowed.

Counts are exact and cover all ruled rows. The table of n-grams grows with the corpus and is joined, never sent whole;
each level of the model joins a table of distinct n-grams to that of their suffixes, where no key has more rows than
the alphabet. The planner knows these tables by the size of their files, in which n-grams and urls take a fraction of
the driver's memory they would need as a broadcast: the joins ask for a shuffle.

Null urls and urls without ``://`` have an empty host and path. Without ruled urls of both kinds all scores and the
threshold are zero. Repeated rows count as often as they occur and get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved

ORDER = 5  # characters of context at most
BLOCK = 512  # characters of a url cut into n-grams at once
START, END = "\x02", "\x03"
BINS = 1000  # steps of the threshold per unit of score
WIDEST = 20  # scores are held within this for the calibration
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; both null if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per character of host and path and one for the end: ``g``, the character behind its context."""
    keep = urls.columns
    padded = F.concat(F.lit(START * order), "host", "path", F.lit(END))
    size = F.length("__s") - order
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda b: F.substring(F.col("__s"), b * BLOCK + 1, F.lit(BLOCK + order)))
    cut = urls.withColumn("__s", padded).select(*keep, F.explode(blocks).alias("__b")).where(F.length("__b") > order)
    each = F.transform(F.sequence(F.lit(1), F.length("__b") - order), lambda i: F.substring(F.col("__b"), i, F.lit(order + 1)))
    return cut.select(*keep, F.explode(each).alias("g"))


def model(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, ratio): log-likelihood ratio of accepted over rejected for every n-gram of the corpus.

    ``urls``: distinct host and path with ``a`` and ``r``, the accepted and rejected rows to learn from (zero where
    the url is only to be judged).
    """
    top = saved(grams(urls, order).groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams")
    level = None
    for k in range(order + 1):
        short = F.substring("g", order + 1 - k, k + 1)  # the last k + 1 characters
        now = top.groupBy(short.alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        now = now.withColumn("ctx", F.substring("g", 1, k))
        total = now.groupBy("ctx").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr")
        )
        if k == 0:
            base = total.select("na", "nr", "ta", "tr")
            now = now.drop("ctx").join(F.broadcast(base))  # one row
            pa = pr = F.lit(1.0 / 256)
        else:
            below = level.select(F.col("g").alias("low"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            now = now.join(total.hint("merge"), "ctx").withColumn("low", F.substring("g", 2, k)).join(below.hint("merge"), "low")
            pa, pr = F.col("qa"), F.col("qr")
        mix = lambda n, c, t, q: F.when(c + t > 0, (n + t * q) / (c + t)).otherwise(q)
        level = now.select("g", mix(F.col("a"), F.col("na"), F.col("ta"), pa).alias("pa"), mix(F.col("r"), F.col("nr"), F.col("tr"), pr).alias("pr"))
        if k == 0:
            # characters that one class has not seen keep a share of the unseen mass
            level = level.select("g", F.greatest("pa", F.lit(1e-6)).alias("pa"), F.greatest("pr", F.lit(1e-6)).alias("pr"))
        level = saved(level, "level")
    return level.select("g", F.log(F.col("pa") / F.col("pr")).alias("ratio"))


def scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """Adds the length-normalised log-likelihood difference to distinct urls (columns of :func:`model`)."""
    ratios = model(urls, order)
    each = grams(urls.select("host", "path"), order).join(ratios.hint("merge"), "g")
    return each.groupBy("host", "path").agg((F.sum("ratio") / F.count("*")).alias("score"))


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """Score with the best balanced accuracy from (bin, accepted, rejected); the middle of the best stretch, nearest zero."""
    accepted, rejected = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not accepted or not rejected:
        return 0.0
    below_a = below_r = 0
    best: tuple[float, float, float] | None = None
    bins = sorted(bins)
    for i, (b, a, r) in enumerate([*bins, (bins[-1][0] + 1, 0, 0)]):
        # everything under bin b is rejected
        low = bins[i - 1][0] + 1 if i else b
        middle = (low + b) / 2
        value = ((accepted - below_a) / accepted + below_r / rejected, -abs(middle), middle)
        best = value if best is None or value > best else best
        below_a, below_r = below_a + a, below_r + r
    return best[2] / BINS


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """Adds host, path, rule, score and verdict to every row; columns named alike are replaced."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    host, path = split_url(url)
    base = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    named = base.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    allow, block = (F.count(F.when(F.col("__r.verdict") == v, 1)) for v in ("allow", "block"))
    urls = saved(named.groupBy("host", "path").agg(allow.alias("na"), block.alias("nr")).withColumn("held", held), "urls")
    learn = urls.select("host", "path", F.when(F.col("held"), 0).otherwise(F.col("na")).alias("a"), F.when(F.col("held"), 0).otherwise(F.col("nr")).alias("r"))
    known = learn.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if known["a"] and known["r"]:
        scored = saved(scores(learn, order), "scores")
        bins = F.round(F.greatest(F.least("score", F.lit(float(WIDEST))), F.lit(-float(WIDEST))) * BINS).cast("int").alias("bin")
        test = urls.where("held AND na + nr > 0").join(scored.hint("merge"), ["host", "path"]).groupBy(bins).agg(F.sum("na").alias("a"), F.sum("nr").alias("r"))
        cut = threshold([(r["bin"], r["a"], r["r"]) for r in test.collect()])  # at most 2 * WIDEST * BINS rows
    else:
        scored, cut = urls.select("host", "path", F.lit(0.0).alias("score")), 0.0
    out = named.join(scored.hint("merge"), ["host", "path"], "left")
    by_score = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("__r.rule").alias("rule"), "score", F.coalesce("__r.verdict", by_score).alias("verdict"))
