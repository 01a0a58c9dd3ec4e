"""Session, URL and text queries."""

from pyspark.sql import functions as F

from quern.functions.mathx import micros
from quern.operators import metrics as M
from quern.operators import textops as X
from quern.registry import query

VISITS = """SELECT o_orderkey AS visit_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '[broken' WHEN o_orderkey % 10 = 0 THEN '[]'
  ELSE concat('["w', CAST(o_orderkey AS VARCHAR(30)), '","w', CAST(o_orderkey * 7 % 5000 AS VARCHAR(30)), '"]') END AS watch_ids FROM orders"""


def visits(t):
    return t.spark.sql(VISITS.replace("FROM orders", "FROM {orders}"), orders=t.orders)


OK = "o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 10 <> 0"


@query("scan_json_array_col", f"SELECT o_orderkey AS visit_id, CASE WHEN {OK} THEN 2 ELSE 0 END AS n, CASE WHEN {OK} THEN 'w' || o_orderkey || '|w' || (o_orderkey * 7 % 5000) ELSE '' END AS ids FROM orders")
def _(t):
    return visits(t).withColumn("a", X.json_array("watch_ids")).select("visit_id", F.size("a").alias("n"), F.array_join("a", "|").alias("ids"))


@query("session_map", f"SELECT o_orderkey AS visit_id, 'w' || o_orderkey AS watch_id FROM orders WHERE {OK} UNION ALL SELECT o_orderkey, 'w' || (o_orderkey * 7 % 5000) FROM orders WHERE {OK}")
def _(t):
    return X.session_map(visits(t), "visit_id", "watch_ids")


@query(
    "scan_list_literal",
    "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 2 END AS turns, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE length(p_name) + length(p_brand) END AS chars FROM part",
)
def _(t):
    lit = F.when(F.col("p_partkey") % 9 == 0, F.lit("not a list")).otherwise(F.concat(F.lit("['"), "p_name", F.lit("', \""), "p_brand", F.lit("\"]")))
    rows = t.part.select("p_partkey", lit.alias("s"))
    n, chars = X.list_sizes(X.list_literal("s"))
    return rows.select("p_partkey", n.alias("turns"), chars.alias("chars"))


@query(
    "url_slug",
    r"""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '  Given-' || page_id || ' ' END AS slug, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, coalesce(lower(trim(slug)), nullif(lower(list_filter(string_split(path, '/'), lambda x: x <> '')[-1]), '')) AS slug FROM p""",
)
def _(t):
    slug = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  Given-"), "page_id", F.lit(" ")))
    return t.pages.select("page_id", X.url_slug("url", slug).alias("slug"))


HITS = "hits AS (SELECT event_id, user_id || '-' || dayofmonth(ts) AS visit_id, epoch_us(ts) AS t, CAST(json_extract(props, '$.k') AS INT) AS item FROM events WHERE event_type IN ('view', 'click'))"


def hits(t):
    e = t.events.where(F.col("event_type").isin("view", "click"))
    return e.select(
        "event_id", F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("visit_id"), micros("ts").alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("item"),
    )


@query("session_sequence", f"WITH {HITS} SELECT visit_id, 0 AS piece, string_agg(CAST(item AS VARCHAR), ',' ORDER BY t, event_id) AS items, count(*) AS session_len FROM hits GROUP BY 1")
def _(t):
    return X.session_sequence(hits(t), "visit_id", "t", "event_id", "item").withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query(
    "top_k_recall",
    f"WITH {HITS}, top AS (SELECT item FROM hits GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 6), v AS (SELECT visit_id, count(DISTINCT item) AS n, count(DISTINCT item) FILTER (item IN (SELECT item FROM top)) AS hit FROM hits GROUP BY 1) SELECT visit_id, hit / n AS recall FROM v",
    f="recall",
)
def _(t):
    h = hits(t)
    top = h.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(6)
    return M.top_k_recall(h, top.withColumn("rank", F.lit(1)), ["visit_id"], "item", "rank")


@query("text_clean", r"SELECT doc_id, trim(regexp_replace(array_to_string(string_split(text, chr(10)), ' <TURN> '), '\s+', ' ', 'g')) AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", X.join_turns(F.split("text", "\n")).alias("clean"))


@query("text_nfkc_key")
def _(t):
    keyed = t.documents.select("doc_id", F.md5(X.nfkc_key("text")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


TOK = r"len(list_filter(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(
    "text_length_features",
    f"WITH p AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), n AS (SELECT conv_id, turn, length(a) AS a_chars, length(b) AS b_chars, {TOK.format('a')} AS a_tokens, {TOK.format('b')} AS b_tokens FROM p) SELECT *, a_chars - b_chars AS diff_chars, abs(a_chars - b_chars) AS abs_diff_chars, a_tokens - b_tokens AS diff_tokens, abs(a_tokens - b_tokens) AS abs_diff_tokens FROM n",
)
def _(t):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return X.length_features(c.select("conv_id", "turn", F.col("text").alias("a")).join(nxt, ["conv_id", "turn"]), "a", "b").drop("a", "b")


def q(s):
    return s.replace("'", "''")


MK = ", ".join(f"(length(text) - length(replace(text, '{q(m)}', ''))) / {len(m)}.0::DOUBLE / n AS marker_{i}" for i, m in enumerate(X.MARKERS))
FW = ", ".join(f"len(list_filter(l, lambda x: x = '{w}')) / n AS word_{w}" for w in X.FUNCTION_WORDS)
CNT = "len(regexp_extract_all(text, '{0}')) / greatest(length(text), 1)"


@query(
    "text_style_features",
    f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{q(X.WORD)}') AS w FROM documents), z AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l, greatest(len(w), 1) AS n FROM w)
SELECT doc_id, ln(1 + len(w)) AS log_tokens, ln(1 + length(text)) AS log_chars, greatest(length(text), 1) / n AS chars_per_token, len(list_distinct(l)) / n AS type_token, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n AS word_mean,
  round(sqrt(greatest(coalesce(list_sum(list_transform(w, lambda x: length(x) * length(x))), 0) / n - pow(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n, 2), 0.0)), 6) AS word_std,
  {CNT.format(chr(92) + 'p{Lu}')} AS upper, {CNT.format(chr(92) + 'p{Nd}')} AS digit, {CNT.format('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS non_ascii, {CNT.format('[' + chr(92) + 's' + chr(92) + 'p{Z}]')} AS space, {MK}, {FW} FROM z""",
    f="log_tokens log_chars chars_per_token type_token word_mean word_std upper digit non_ascii space " + " ".join(f"marker_{i}" for i in range(len(X.MARKERS))) + " " + " ".join(f"word_{w}" for w in X.FUNCTION_WORDS),
)
def _(t):
    return X.style_features(t.documents.select("doc_id", "text"), "text").drop("text").withColumn("word_std", F.round("word_std", 6))


FWL = ", ".join(f"'{w}'" for w in X.FUNCTION_WORDS)


@query(
    "text_shape_view",
    rf"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+'), lambda t: CASE WHEN NOT regexp_matches(t, '^\p{{L}}') THEN t WHEN upper(t) = t AND lower(t) <> t THEN 'X' ELSE 'x' END), '')) AS shape,
  md5(array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda t: CASE WHEN lower(t) IN ({FWL}) OR NOT regexp_matches(t, '^[\p{{L}}\p{{N}}]+$') THEN lower(t) ELSE 'CONTENT' END), ' ')) AS function_words,
  md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z’'']+|[^A-Za-z’'']+'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z’'']') AND lower(t) NOT IN ({FWL}) THEN '*' ELSE t END), '')) AS distorted FROM documents""",
)
def _(t):
    x = F.col("text")
    return t.documents.select("doc_id", F.md5(X.shape_view(x)).alias("shape"), F.md5(X.function_view(x)).alias("function_words"), F.md5(X.distort_view(x)).alias("distorted"))


@query("char_counts", "SELECT p_partkey, length(p_name) AS n_chars, " + ", ".join(f"CAST((length(p_name) - length(replace(p_name, '{c}', ''))) / {len(c)} AS INT) AS n_{i}" for i, c in enumerate(("e", "l", "o", "bl", " "))) + " FROM part")
def _(t):
    return X.char_counts(t.part.select("p_partkey", "p_name"), "p_name", ("e", "l", "o", "bl", " ")).drop("p_name")


ALPHA = "aeilr"


@query(
    "char_position_onehot",
    "SELECT p_partkey, "
    + ", ".join(", ".join(f"CAST(substr(p_name, {i + 1}, 1) = '{a}' AS INT) AS p{i}_{a}" for a in ALPHA) + f", CASE WHEN substr(p_name, {i + 1}, 1) <> '' AND instr('{ALPHA}', substr(p_name, {i + 1}, 1)) > 0 THEN instr('{ALPHA}', substr(p_name, {i + 1}, 1)) - 1 END AS val_{i}" for i in range(5))
    + ", " + ", ".join(f"length(p_name) - length(replace(p_name, '{a}', '')) AS cnt_{a}" for a in ALPHA) + " FROM part",
)
def _(t):
    return X.char_positions(t.part.select("p_partkey", "p_name"), "p_name", ALPHA, 5).drop("p_name")


@query(
    "tfidf",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN ('the', 'and', 'of')) AS w FROM benchmark),
g AS (SELECT item_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM benchmark)), x AS (SELECT item_id, term, tf * (ln(((SELECT count(*) FROM benchmark) + 1) / (df + 1)) + 1) AS x FROM tf JOIN f USING (term))
SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight FROM x""",
    f="weight",
)
def _(t):
    return X.tfidf(t.benchmark, "item_id", "text", (1, 2), 2, 0.5, ("the", "and", "of"))


@query("text_similar_groups")
def _(t):
    return X.similar_groups(t.documents, "doc_id", "text", 0.7)


@query(
    "group_centering",
    """WITH e AS (SELECT vec_id, label * 4 + vec_id % 4 AS g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), n AS (SELECT label * 4 + vec_id % 4 AS g, count(*) AS n FROM embeddings GROUP BY 1)
SELECT vec_id, i, round(CASE WHEN n BETWEEN 2 AND 12 THEN v - avg(v) OVER (PARTITION BY g, i) ELSE v END, 9) AS x FROM e JOIN n USING (g)""",
    f="x",
)
def _(t):
    e = t.embeddings.withColumn("g", F.col("label") * 4 + F.col("vec_id") % 4)
    return X.group_centering(e, "g", "embedding", 2, 12).select("vec_id", F.posexplode("centred").alias("i", "x")).withColumn("x", F.round("x", 9))


@query(
    "matched_sample",
    """WITH p AS (SELECT doc_id, lang, n_chars / 100.0::DOUBLE AS w, round(-ln((CAST('0x' || substr(md5(doc_id || '|0'), 1, 12) AS BIGINT)::DOUBLE + 1) / (281474976710656 + 1)::DOUBLE) / (n_chars / 100.0::DOUBLE), 9) AS k FROM documents WHERE n_chars > 0),
c AS (SELECT lang, count(*) // 3 AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS rn FROM p) SELECT doc_id, lang FROM r JOIN c USING (lang) WHERE rn <= n""",
)
def _(t):
    d = t.documents
    counts = d.groupBy("lang").agg(F.floor(F.count(F.lit(1)) / 3).alias("n"))
    return X.matched_sample(d.withColumn("w", F.col("n_chars") / 100.0), counts, "lang", "w", "doc_id").select("doc_id", "lang")
