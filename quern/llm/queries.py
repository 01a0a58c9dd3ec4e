"""Registered queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import ctw, decontam, embdup, langid, packing, search, sharding, simhash, toolcalls, toxicity, urlfilter, variants, warc
from quern.registry import Tables, query


def tokenizer_path() -> str:
    """The byte-level tokenizer file installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_language_id")
def _(t: Tables) -> DataFrame:
    docs = t.documents
    return langid.identify(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_simhash")
def _(t: Tables) -> DataFrame:
    return simhash.near_copies(t.documents)


@query("op4_toxicity")
def _(t: Tables) -> DataFrame:
    scored = toxicity.assess(t.documents, t.labels)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_decontamination")
def _(t: Tables) -> DataFrame:
    """Every document with the items found in it; documents without one have an empty list."""
    found = decontam.flagged(t.documents, t.benchmark)
    ids = t.documents.select("doc_id")
    return ids.join(found, "doc_id", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("consistency", F.lit(0.0)).alias("consistency"),
    )


@query("op10_packing")
def _(t: Tables) -> DataFrame:
    return packing.pack_documents(t.documents, tokenizer_path())


@query("op6_embedding_dedup")
def _(t: Tables) -> DataFrame:
    return embdup.near_vectors(t.embeddings)


@query("op8_url_filter")
def _(t: Tables) -> DataFrame:
    return urlfilter.judge(t.pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op9_warc")
def _(t: Tables) -> DataFrame:
    """The last chunk row of every record read back from the archives carries the whole payload's size and digest."""
    table = warc.archive_pages(t.pages).where("last")
    return table.select(F.col("record").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OWNERS = ",".join(map(str, sharding.fill(sharding.SHARDS, sharding.SLOTS)))


@query(
    "op5_sharding",
    f"""WITH owner AS (
  SELECT CAST(i - 1 AS INTEGER) AS slot, 'shard-' || lpad(o, 3, '0') AS shard
  FROM (SELECT unnest(string_split(l, ',')) AS o, generate_subscripts(string_split(l, ','), 1) AS i
        FROM (SELECT '{OWNERS}' AS l)))
SELECT doc_id, slot, shard
FROM (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
JOIN owner USING (slot)""",
)
def _(t: Tables) -> DataFrame:
    return sharding.place(t.documents.select("doc_id"), ["doc_id"])


@query(
    "op2_tool_calls",
    r"""WITH said AS (
  SELECT conv_id, turn, role, coalesce(min(text), '') AS text, count(*) AS copies FROM (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'system', 'assistant'))
  GROUP BY 1, 2, 3),
c AS (
  SELECT conv_id, 'turn-' || turn AS call_id, turn, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, copies, text,
         len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')) AS words
  FROM said WHERE role <> 'assistant'),
r AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM said WHERE role = 'assistant'),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, name, turn, result_turn, coalesce(copies, 0) AS copies,
         text, words, content, c.call_id IS NOT NULL AS is_call,
         name = 'reply' AND turn >= 2 AND NOT EXISTS (SELECT 1 FROM c AS d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2) AS lost
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
k AS (
  SELECT *, list_filter([CASE WHEN name = 'reply' AND length(text) < 1 THEN 'prompt too short' END,
                         CASE WHEN lost THEN 'waits for an unknown call' END,
                         CASE WHEN name = 'reply' AND words > 100000 THEN 'words too large' END,
                         CASE WHEN name = 'reply' AND words < 1 THEN 'words too small' END], lambda p: p IS NOT NULL) AS listed
  FROM j)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, result_turn), call_id) - 1 AS step, name, turn AS call_turn, result_turn, copies,
       CASE WHEN NOT is_call THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       len(listed) = 0 AS valid, array_to_string(listed, '; ') AS problems,
       '{' || concat_ws(',', CASE WHEN name = 'reply' THEN '"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words || '}'
                                  WHEN name = 'configure' THEN '"arguments":{"instructions":' || CAST(to_json(text) AS VARCHAR) || '}' END,
                        '"id":' || CAST(to_json(call_id) AS VARCHAR), '"name":' || CAST(to_json(name) AS VARCHAR), '"result":' || CAST(to_json(content) AS VARCHAR)) || '}' AS canonical
FROM k""",
)
def _(t: Tables) -> DataFrame:
    """The conversations have plain turns only: they become tool messages, which are then linked, ordered and validated."""
    return toolcalls.link(toolcalls.from_turns(t.conversations), toolcalls.TURN_SCHEMAS)


@query("op11_spelling_variants")
def _(t: Tables) -> DataFrame:
    return variants.variants(t.documents).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_lm_scoring")
def _(t: Tables) -> DataFrame:
    return ctw.score(t.documents)


@query(
    "op13_lexical_search",
    r"""WITH folded AS (SELECT doc_id, row_number() OVER () AS r, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
m AS (SELECT r, 100 - 50 + ((50 * n * docs) // total) AS m FROM n, c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50""",
)
def _(t: Tables) -> DataFrame:
    return search.search(t.documents, t.benchmark)
