"""Tool-call linking for chat formatting, in DataFrame functions only.

Calls and results are joined by conversation and call identifier, ordered so that every call stands behind the calls it
depends on, validated against argument schemas, and written as canonical JSON (sorted keys, no white space).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import read_table, settle

#: For each tool its arguments: type, required, least and greatest value (of a string: its length).
SCHEMAS = {
    "reply": {"prompt": ("string", True, 1, 400), "turn": ("integer", True, 0, None)},
    "configure": {"prompt": ("string", True, 1, None), "turn": ("integer", True, 0, 0)},
}

MESSAGE = "tool_calls array<struct<id string, name string, arguments string, after array<string>>>, tool_call_id string, content string"


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls ``(conv_id, turn, idx, call_id, name, arguments, after)`` and results ``(conv_id, turn, call_id, content)``
    of messages ``(conv_id, turn, role, text)`` whose text is JSON: ``{"tool_calls": [{"id", "name", "arguments",
    "after"}]}`` or ``{"tool_call_id", "content"}``. Texts that are no such JSON give neither."""
    read = messages.select("conv_id", "turn", F.from_json(F.col("text"), MESSAGE).alias("m"))
    calls = read.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("idx", "c")).select(
        "conv_id", "turn", "idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after")
    )
    results = read.where("m.tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls, results


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations in the same form: a user turn is a call ``reply`` that depends on the user turn two before, a
    system turn is a call ``configure``, and an assistant turn is the result of the turn before it."""
    ident = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    asks = F.col("role").isin("user", "system")
    calls = messages.where(asks).select(
        "conv_id",
        "turn",
        F.lit(0).alias("idx"),
        ident(F.col("turn")).alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.when((F.col("role") == "user") & (F.col("turn") >= 2), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = messages.where(F.col("role") == "assistant").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def violations(name: Column, arguments: Column, schemas: dict) -> Column:
    """Sorted list of what is wrong with a call: ``arguments`` no JSON object, an unknown tool, a missing, ill-typed,
    out-of-range or unknown argument."""
    v = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = [F.when(~is_object, F.lit("arguments:not an object")), F.when(name.isNull() | ~name.isin(*schemas), F.lit("name:unknown"))]
    kinds = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
    for tool, args in schemas.items():
        mine = is_object & (name == tool)
        for arg, (kind, required, least, most) in args.items():
            value = F.try_variant_get(v, f"$.{arg}", "variant")
            there = F.coalesce(~F.is_variant_null(value) & value.isNotNull(), F.lit(False))
            right = F.schema_of_variant(value).rlike(f"^({kinds[kind]})$")
            if required:
                found.append(F.when(mine & ~there, F.lit(f"{arg}:missing")))
            found.append(F.when(mine & there & ~right, F.lit(f"{arg}:type")))
            size = F.length(F.try_variant_get(v, f"$.{arg}", "string")) if kind == "string" else F.try_variant_get(v, f"$.{arg}", "double")
            for limit, low in ((least, True), (most, False)):
                if limit is not None:
                    found.append(F.when(mine & there & right & ((size < limit) if low else (size > limit)), F.lit(f"{arg}:{'below' if low else 'above'} {limit}")))
        keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
        extra = F.array_except(keys, F.array(*map(F.lit, args)) if args else F.array().cast("array<string>"))
        found.append(F.when(mine & (F.size(extra) > 0), F.concat(F.lit("unknown arguments:"), F.array_join(F.array_sort(extra), ","))))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: the longest way of dependencies below each call, by peeling calls whose dependencies
    are all done; calls on a cycle, or behind one, get no row. Used for conversations where a call depends on a later
    one. Every round takes at least one level off, so the longest way sets the number of rounds."""
    left = settle(calls.select("conv_id", "call_id").distinct())
    edges = settle(edges)
    done = None
    for level in count():
        waiting = edges.join(left.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi").select("conv_id", "call_id").distinct()
        free = settle(left.join(waiting, ["conv_id", "call_id"], "left_anti"))
        if free.isEmpty():
            break
        now = free.withColumn("level", F.lit(level).cast("long"))
        done = now if done is None else done.unionByName(now)
        if level % 100 == 99:
            done = settle(done)  # a plan of many unions is slow to read
        left = settle(left.join(free, ["conv_id", "call_id"], "left_anti"))
        if left.isEmpty():
            break
    return done if done is not None else left.withColumn("level", F.lit(0).cast("long"))


def link(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row for each call, and one for each result without a call.

    Columns: ``conv_id, call_id, name, turn, result_turn, status`` (linked, unanswered, orphan), ``order_key`` (sorting a
    conversation by it puts every call behind those it depends on; null on a cycle), ``valid, violations`` and ``json``,
    the canonical record. Of several results of a call the first by turn counts; repeated calls are returned one by one.
    A dependency on a call that isn't there is a violation. Null identifiers never link. The calls of a conversation are
    never brought together: dependencies that point backwards make the place in the conversation a valid order, and
    only conversations with others are peeled round by round.
    """
    schemas = SCHEMAS if schemas is None else schemas
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    deps = calls.select("conv_id", "call_id", "turn", "idx", F.explode("after").alias("on"))
    places = calls.groupBy("conv_id", F.col("call_id").alias("on")).agg(F.min(F.struct("turn", "idx")).alias("at"))
    # a dependency of a plain conversation is looked up in a hash join as any other
    looked = deps.join(places, ["conv_id", "on"], "left")
    lost = looked.where("at IS NULL").select("conv_id", "call_id", F.lit(True).alias("lost")).distinct()
    forward = settle(looked.where(F.col("at") >= F.struct("turn", "idx")).select("conv_id").distinct())
    odd = calls.join(forward, "conv_id", "left_semi")
    peeled = levels(odd, looked.where("at IS NOT NULL").join(forward, "conv_id", "left_semi").select("conv_id", "call_id", "on")) if not forward.isEmpty() else None
    out = calls.join(first, ["conv_id", "call_id"], "full_outer").join(lost, ["conv_id", "call_id"], "left")
    place = F.format_string("%012d.%06d", F.col("turn").cast("long"), F.col("idx").cast("long"))
    if peeled is None:
        key = F.when(F.col("turn").isNotNull(), F.concat(F.lit("000000."), place))
    else:
        out = out.join(forward.withColumn("odd", F.lit(True)), "conv_id", "left").join(peeled, ["conv_id", "call_id"], "left")
        key = F.when(F.col("turn").isNotNull() & (F.col("odd").isNull() | F.col("level").isNotNull()), F.concat(F.format_string("%06d.", F.coalesce("level", F.lit(0)).cast("long")), place))
    is_call = F.col("turn").isNotNull()
    wrong = F.when(is_call, F.array_sort(F.concat(violations(F.col("name"), F.col("arguments"), schemas), F.when(F.col("lost"), F.array(F.lit("after:missing"))).otherwise(F.array().cast("array<string>"))))).otherwise(F.array(F.lit("call:missing")))
    record = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("call_id"), "name", F.col("r.content").alias("result")))
    return out.select(
        "conv_id",
        "call_id",
        "name",
        "turn",
        F.col("r.turn").alias("result_turn"),
        F.when(~is_call, "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        key.alias("order_key"),
        (F.size(wrong) == 0).alias("valid"),
        F.array_join(wrong, "; ").alias("violations"),
        record.alias("json"),
    )


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """``link`` of the turns of the whole table ``conversations``, read as calls and results; see there for odd rows."""
    return link(*turns_as_calls(read_table(spark, sf_dir, "conversations")))


ORACLE = """
WITH asks AS (SELECT conv_id, turn, concat(conv_id, ':', turn) AS call_id, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, text,
  CASE WHEN role = 'user' AND turn >= 2 THEN concat(conv_id, ':', turn - 2) END AS needs FROM conversations WHERE role IN ('user', 'system')),
answers AS (SELECT conv_id, concat(conv_id, ':', turn - 1) AS call_id, min(turn) AS result_turn, arg_min(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
both_sides AS (SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id, a.name, a.turn, r.result_turn, a.text, r.content, a.needs
  FROM asks a FULL OUTER JOIN answers r ON a.conv_id = r.conv_id AND a.call_id = r.call_id),
checked AS (SELECT *, CASE WHEN turn IS NULL THEN 'call:missing' ELSE concat_ws('; ',
  CASE WHEN needs IS NOT NULL AND needs NOT IN (SELECT call_id FROM asks) THEN 'after:missing' END,
  CASE WHEN name = 'reply' AND length(text) > 400 THEN 'prompt:above 400' END,
  CASE WHEN length(text) < 1 THEN 'prompt:below 1' END,
  CASE WHEN text IS NULL THEN 'prompt:missing' END,
  CASE WHEN name = 'configure' AND turn > 0 THEN 'turn:above 0' END,
  CASE WHEN turn < 0 THEN 'turn:below 0' END) END AS violations FROM both_sides)
SELECT conv_id, call_id, name, turn, result_turn, CASE WHEN turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN turn IS NOT NULL THEN format('000000.{:012d}.000000', turn) END AS order_key, violations = '' AS valid, violations,
  concat('{', CASE WHEN turn IS NOT NULL THEN concat('"arguments":', CASE WHEN text IS NULL THEN json_object('turn', turn) ELSE json_object('prompt', text, 'turn', turn) END, ',') ELSE '' END,
    '"call_id":', to_json(call_id), CASE WHEN name IS NOT NULL THEN concat(',"name":', to_json(name)) ELSE '' END, CASE WHEN content IS NOT NULL THEN concat(',"result":', to_json(content)) ELSE '' END, '}') AS json
FROM checked
"""
