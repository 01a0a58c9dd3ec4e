"""Tool calls in chats: link calls and results, order them, validate arguments, serialise canonically.

A message whose text is ``{"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}`` makes calls; one whose text is
``{"tool_call_id", "content"}`` is a result. Calls and results of a conversation are hash-joined by identifier. A
call comes after the calls it names in ``after``; the order follows the turns wherever they allow it: a call's place
is the larger of its turn and one more than the largest place of the calls it waits for. Conversations whose turns are
in that order already need no round; in the others, calls that wait for nothing open are settled round by round, in as
many rounds as their longest chain. What is left then waits in a circle, or for one.

Defined results: messages of neither form take no part. Repeated identifiers of a conversation are one call, the first
by turn, position and text, with ``copies`` counting them; results alike. A call without a result is ``unanswered``,
a result without a call is ``orphan``, a result at an earlier turn than its call is ``early``. Unknown tools,
arguments that are no JSON object, and violations of the schema are listed in ``problems``. Calls that wait for each
other in a circle, or for such calls, have ``circular`` among their problems and stay at their turn. Null conversations or identifiers join
nothing: such calls stay alone. Numbers keep the form they were given in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.shared import place as new_place
from quern.llm.shared import saved

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
SPAN = 256  # places of a conversation numbered by one task
KINDS = {
    "string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT<.*", "array": r"^ARRAY<.*",
}


def calls(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, name, arguments, after, copies): one row per identifier of a conversation."""
    found = messages.select("conv_id", "turn", F.from_json("text", CALLS).alias("m")).where("m.tool_calls IS NOT NULL")
    rows = found.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("pos", "c"))
    rows = rows.select("conv_id", F.col("c.id").alias("call_id"), F.struct("turn", "pos", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after")).alias("c"))
    one = rows.groupBy("conv_id", "call_id").agg(F.min("c").alias("c"), F.count("*").alias("copies"))
    return one.select("conv_id", "call_id", "c.turn", "c.name", "c.arguments", "c.after", "copies")


def results(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, content): the first result of an identifier."""
    found = messages.select("conv_id", "turn", F.from_json("text", RESULT).alias("m")).where("m.tool_call_id IS NOT NULL")
    one = found.groupBy("conv_id", F.col("m.tool_call_id").alias("call_id")).agg(F.min(F.struct("turn", "m.content")).alias("r"))
    return one.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))


def problems(schemas: dict[str, dict[str, dict]]) -> Column:
    """Violations of the schemas by columns ``name`` and ``arguments``, as a sorted array.

    A schema maps argument names to ``type`` (a key of ``KINDS``), ``required``, ``enum``, ``minimum``, ``maximum`` and
    ``min_length``; arguments it does not name are not allowed.
    """
    v = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(v).rlike("^OBJECT<"), F.lit(False))
    out = F.array(F.when(~F.col("name").isin(*schemas) | F.col("name").isNull(), F.lit("unknown tool")))
    for tool, args in schemas.items():
        own = [F.when(~is_object, F.lit("no object"))]
        for arg, rule in args.items():
            path = f"$['{arg}']"
            part = F.try_variant_get(v, path, "variant")
            there = part.isNotNull() & ~F.is_variant_null(part)
            text = F.try_variant_get(v, path, "string")
            own.append(F.when(is_object & ~there, F.lit(f"{arg} missing")) if rule.get("required") else F.lit(None))
            own.append(F.when(there & ~F.coalesce(F.schema_of_variant(part).rlike(KINDS[rule["type"]]), F.lit(False)), F.lit(f"{arg} is no {rule['type']}")))
            if "enum" in rule:
                own.append(F.when(there & ~text.isin(*map(str, rule["enum"])), F.lit(f"{arg} not allowed")))
            number = F.try_variant_get(v, path, "double")
            if "minimum" in rule:
                own.append(F.when(number < rule["minimum"], F.lit(f"{arg} too small")))
            if "maximum" in rule:
                own.append(F.when(number > rule["maximum"], F.lit(f"{arg} too large")))
            if "min_length" in rule:
                own.append(F.when(F.length(text) < rule["min_length"], F.lit(f"{arg} too short")))
        more = F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), F.array(*map(F.lit, args)) if args else F.array().cast("array<string>"))
        own.append(F.when(is_object & (F.size(more) > 0), F.lit("unknown argument")))
        out = F.when(F.col("name") == tool, F.array(*own)).otherwise(out)
    return F.array_sort(F.array_compact(out))


def canonical(value: Column) -> Column:
    """JSON text with sorted keys and without blanks; null if the input is no JSON."""
    return F.to_json(F.try_parse_json(value))


def places(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, circular) of calls given with turn and after."""
    keys = ["conv_id", "call_id"]
    state = nodes.select(*keys, F.coalesce("turn", F.lit(0)).cast("long").alias("place"))
    waits = nodes.select(*keys, F.explode("after").alias("on")).distinct()
    on = state.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("floor"))
    against = waits.join(on, ["conv_id", "on"]).join(state, keys).where("floor >= place").select("conv_id").distinct()
    against = saved(against, "out-of-order")
    if against.isEmpty():
        return state.withColumn("circular", F.lit(False))
    left = saved(state.join(against, "conv_id", "left_semi").where("call_id IS NOT NULL"), "unsettled")
    known = left.select("conv_id", F.col("call_id").alias("on"))
    waits = saved(waits.join(known, ["conv_id", "on"], "left_semi"), "waits")
    spark, rounds = nodes.sparkSession, []
    folder = new_place(spark, "settled")
    while True:
        rounds.append(f"{folder}/{len(rounds)}")
        left.join(waits, keys, "left_anti").write.parquet(rounds[-1])
        free = spark.read.schema(left.schema).parquet(rounds[-1])
        if free.isEmpty():
            break
        on = free.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("floor"))
        least = waits.join(on, ["conv_id", "on"]).groupBy(*keys).agg((F.max("floor") + 1).alias("floor"))
        raised = left.join(free.select(*keys), keys, "left_anti").join(least, keys, "left")
        left = saved(raised.select(*keys, F.greatest("place", "floor").alias("place")), "unsettled")
        waits = saved(waits.join(on, ["conv_id", "on"], "left_anti"), "waits")
    circles = left.select(*keys, F.lit(True).alias("circular"))
    settled = spark.read.schema(left.schema).parquet(*rounds).select(*keys, F.col("place").alias("settled"))
    state = state.join(settled, keys, "left").select(*keys, F.coalesce("settled", "place").alias("place"))
    return state.join(circles, keys, "left").withColumn("circular", F.coalesce("circular", F.lit(False)))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``step``, the dense number of a row in its conversation by (place, call_id).

    Rows are numbered inside spans of places; the counts of earlier spans are added. No task holds a conversation.
    """
    r = rows.withColumn("span", F.floor(F.col("place") / SPAN))
    sizes = r.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("place", "call_id"))
    r = r.withColumn("k", inside - 1)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s"))
    return r.join(sizes, same, "left").withColumn("step", (F.col("base") + F.col("k")).cast("long")).drop("c", "s", "base", "k", "span")


def link(messages: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per call or orphan result.

    Columns: conv_id, call_id, step, name, call_turn, result_turn, copies, status, valid, problems, canonical.
    """
    c = saved(calls(messages), "calls")
    r = saved(results(messages), "results")
    both = c.withColumn("is_call", F.lit(True)).join(r, ["conv_id", "call_id"], "full")
    both = both.withColumn("is_call", F.coalesce("is_call", F.lit(False)))
    order = places(c.select("conv_id", "call_id", "turn", "after"))
    known = c.select("conv_id", F.col("call_id").alias("on"), F.lit(1).alias("there"))
    lost = c.select("conv_id", "call_id", F.explode("after").alias("on")).join(known, ["conv_id", "on"], "left_anti").groupBy("conv_id", "call_id").agg(F.lit(True).alias("lost"))
    keys = ["conv_id", "call_id"]
    order, lost = (d.withColumnsRenamed({"conv_id": "c2", "call_id": "i2"}) for d in (order, lost))
    on = F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("call_id").eqNullSafe(F.col("i2"))
    both = both.join(order, on, "left").drop("c2", "i2").join(lost, on, "left").drop("c2", "i2")
    more = F.array_compact(F.array(F.when(F.coalesce("circular", F.lit(False)), F.lit("circular")), F.when(F.coalesce("lost", F.lit(False)), F.lit("waits for an unknown call"))))
    listed = F.when(F.col("is_call"), F.array_sort(F.concat(problems(schemas), more))).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(~F.col("is_call"), "orphan")
        .when(F.col("result_turn").isNull() & F.col("content").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    quoted = lambda x: F.regexp_replace(F.to_json(F.struct(F.col(x).alias("x"))), r"^\{\"x\":|\}$", "")
    parts = [
        F.concat(F.lit('"arguments":'), F.coalesce(canonical(F.col("arguments")), F.when(F.col("arguments").isNotNull(), quoted("arguments")))),
        F.concat(F.lit('"id":'), F.when(F.col("call_id").isNotNull(), quoted("call_id"))),
        F.concat(F.lit('"name":'), F.when(F.col("name").isNotNull(), quoted("name"))),
        F.concat(F.lit('"result":'), F.when(F.col("content").isNotNull(), quoted("content"))),
    ]
    out = both.select(
        *keys, F.coalesce("place", F.col("result_turn").cast("long"), F.lit(0).cast("long")).alias("place"), "name", F.col("turn").alias("call_turn"), "result_turn",
        F.coalesce("copies", F.lit(0).cast("long")).alias("copies"), status.alias("status"), (F.size(listed) == 0).alias("valid"), F.concat_ws("; ", listed).alias("problems"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("canonical"),
    )
    return numbered(saved(out, "linked")).select(*keys, "step", "name", "call_turn", "result_turn", "copies", "status", "valid", "problems", "canonical")


def from_turns(conversations: DataFrame) -> DataFrame:
    """Plain chat turns as tool messages: a user's turn calls ``reply``, the next turn is its result, system turns call ``configure``.

    A call waits for the user's turn two turns earlier, if there can be one.
    """
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    words = F.size(F.filter(F.split(text, r"[ \n]+"), lambda w: w != ""))
    ask = F.to_json(F.struct(F.array(F.struct(
        name(turn).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("prompt"), words.alias("words")).alias("arguments"),
        F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )).alias("tool_calls")))
    setup = F.to_json(F.struct(F.array(F.struct(name(turn).alias("id"), F.lit("configure").alias("name"), F.struct(text.alias("instructions")).alias("arguments"))).alias("tool_calls")))
    answer = F.to_json(F.struct(name(turn - 1).alias("tool_call_id"), text.alias("content")))
    said = F.when(F.col("role") == "user", ask).when(F.col("role") == "system", setup).when(F.col("role") == "assistant", answer)
    return conversations.select("conv_id", "turn", "role", said.alias("text"))


TURN_SCHEMAS = {
    "reply": {"prompt": {"type": "string", "required": True, "min_length": 1}, "words": {"type": "integer", "required": True, "minimum": 1, "maximum": 100_000}},
    "configure": {"instructions": {"type": "string", "required": True}},
}
