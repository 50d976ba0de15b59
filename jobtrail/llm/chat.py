"""Chat formatting: tool calls linked to results (DataFrame functions only).

Messages of a conversation carry calls and results as JSON. A call is
``{"tool_calls": [{"id", "name", "arguments", "after": [ids]}]}``, where ``after`` names calls whose results
it needs; a result is ``{"tool_call_id", "content"}``. Calls and results meet in a hash join on
conversation and identifier; calls are ordered topologically by rounds of joins (one round for each level of
dependence), arguments are checked against tool schemas, and each call is written as one line
of canonical JSON: keys sorted at every depth, no blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.tables import keep

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"
#: Turns that are ranked together.
CHUNK = 1024


def parse_calls(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> one row per call: ``(conv_id, turn, nth, call_id, name, arguments, after)``.
    Texts that are no such JSON, and calls without an id, give no row."""
    calls = F.from_json("text", CALLS, {"mode": "PERMISSIVE"})["tool_calls"]
    return (messages.filter(F.col("role") == "assistant").select("conv_id", "turn", F.posexplode(calls).alias("nth", "call"))
            .select("conv_id", "turn", "nth", F.col("call.id").alias("call_id"), "call.name", "call.arguments", "call.after").filter("call_id is not null"))


def parse_results(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, call_id, content)`` of messages with role ``tool``."""
    found = F.from_json("text", RESULT, {"mode": "PERMISSIVE"})
    return (messages.filter(F.col("role") == "tool").select("conv_id", "turn", found.alias("r"))
            .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), "r.content").filter("call_id is not null"))


def argument_errors(value: Column, params: Column) -> Column:
    """Errors of a call's arguments (variant, null if no JSON) against ``array<struct<param,type,required>>`` (null: unknown tool)."""
    given = F.try_variant_get(value, "$", "map<string,variant>")

    def wrong(p: Column) -> Column:
        kind = F.schema_of_variant(F.element_at(given, p["param"]))
        fits = (F.when(p["type"] == "string", kind == "STRING").when(p["type"] == "integer", kind == "BIGINT").when(p["type"] == "boolean", kind == "BOOLEAN")
                .when(p["type"] == "number", (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"))
                .when(p["type"] == "object", kind.startswith("OBJECT")).when(p["type"] == "array", kind.startswith("ARRAY")).otherwise(F.lit(False)))
        return F.map_contains_key(given, p["param"]) & ~fits

    name = lambda prefix: lambda p: F.concat(F.lit(prefix), p["param"])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.map_contains_key(given, p["param"])), name("missing "))
    kinds = F.transform(F.filter(params, wrong), name("type "))
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.array_contains(F.transform(params, lambda p: p["param"]), k)), lambda k: F.concat(F.lit("unknown "), k))
    return (F.when(params.isNull(), F.array(F.lit("unknown tool"))).when(given.isNull(), F.array(F.lit("no object")))
            .otherwise(F.array_sort(F.concat(missing, kinds, unknown))))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``occurrence``: 1, 2, ... among the rows of one conversation and call id by ``turn`` and ``order``.

    Counts per ``CHUNK`` of turns are summed up first, so an id that is used again and again is not ranked in one task.
    """
    chunk = F.floor(F.coalesce("turn", F.lit(0)) / CHUNK)
    rows = rows.withColumn("chunk", chunk)
    keys = ["conv_id", "call_id"]
    cells = rows.groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
    before = cells.select(*keys, "chunk", (F.sum("n").over(Window.partitionBy(*keys).orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("turn", *order))
    return rows.withColumn("within", within).join(before, [*keys, "chunk"]).withColumn("occurrence", F.col("before") + F.col("within")).drop("chunk", "within", "before")


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, occurrence, after)``, one row per call -> ``(conv_id, call_id, occurrence, level)``: 0 for a call
    that needs no other, else one more than the highest level it needs. Null on or behind a cycle. ``after`` names
    the first call of an id; names of unknown calls are ignored.

    Each round settles one level and writes the calls that were still waiting, with their open needs.
    """
    node, need = ["conv_id", "call_id", "occurrence"], ["conv_id", "need"]
    nodes = calls.select(*node)
    firsts = nodes.filter("occurrence = 1").select("conv_id", F.col("call_id").alias("need"))
    needs = calls.select(*node, F.explode(F.array_distinct("after")).alias("need"))
    needs = keep(needs.join(firsts, need, "left_semi"), "needs")
    count = needs.groupBy(*node).agg(F.count("*").alias("open"))
    state = keep(nodes.join(count, node, "left").withColumn("open", F.coalesce("open", F.lit(0))), "levels")
    level, done = 0, []
    while True:
        settled, waiting = state.filter("open = 0"), state.filter("open > 0")
        done.append(settled.select(*node, F.lit(level).alias("level")))
        n = state.agg(F.count_if(F.col("open") == 0).alias("settled"), F.count_if(F.col("open") > 0).alias("waiting")).first()
        if not n.settled or not n.waiting:
            return nodes.join(reduce(DataFrame.unionByName, done), node, "left")
        met = (needs.join(settled.filter("occurrence = 1").select("conv_id", F.col("call_id").alias("need")), need)
               .groupBy(*node).agg(F.count("*").alias("met")))
        state = keep(waiting.join(met, node, "left").select(*node, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "levels")
        level += 1


def link_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """``messages (conv_id, turn, role, text)``, ``schemas (tool, param, type, required)`` -> one row per call and per
    result that no call claims: ``(conv_id, call_id, name, turn, level, position, status, errors, json)``.

    * ``status``: ``ok``, ``invalid`` (errors not empty), ``no_result``, ``cycle``, or ``no_call`` for a result alone. Where a
      conversation uses an id again, its n-th call (by turn and place) is linked with its n-th result; what is over
      on either side is reported as ``no_result`` or ``no_call``. Repeated rows count once. ``after`` means the first call of an id.
    * ``position``: place of a call among those of its conversation by level, turn and place; null for cycles and results alone.
    * ``json``: ``{"arguments", "content", "id", "name"}``, null where the status is ``no_call``.

    A null conversation is one of its own; null turns come first; null or malformed texts hold no call; empty
    tables give an empty table; further columns are ignored. A parameter of a type that is none of JSON's is an error.
    """
    messages = messages.select("conv_id", "turn", "role", "text").withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    calls = keep(numbered(parse_calls(messages).distinct(), ["nth", "name", "arguments", "after"]), "calls")
    results = numbered(parse_results(messages).distinct(), ["content"])
    results = results.select("conv_id", "call_id", "occurrence", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    linked = calls.withColumn("called", F.lit(True)).join(results.hint("shuffle_hash"), ["conv_id", "call_id", "occurrence"], "full_outer")

    tools = schemas.groupBy("tool").agg(F.sort_array(F.collect_set(F.struct("param", "type", "required"))).alias("params"))
    checked = linked.join(tools, linked.name == tools.tool, "left").withColumn("value", F.try_parse_json("arguments"))
    checked = checked.withColumn("errors", argument_errors(F.col("value"), F.col("params")))

    depth = levels(calls)
    placed = calls.join(depth, ["conv_id", "call_id", "occurrence"]).filter("level is not null").select("conv_id", "call_id", "occurrence", "level", "turn", "nth", F.floor(F.coalesce("turn", F.lit(0)) / CHUNK).alias("chunk"))
    cells = placed.groupBy("conv_id", "level", "chunk").agg(F.count("*").alias("n"))
    before = cells.select("conv_id", "level", "chunk", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "chunk")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "level", "chunk").orderBy("turn", "nth", "call_id", "occurrence"))
    placed = placed.withColumn("within", within).join(before, ["conv_id", "level", "chunk"]).select("conv_id", "call_id", "occurrence", "level", (F.col("before") + F.col("within") - 1).alias("position"))

    status = (F.when(F.col("called").isNull(), "no_call").when(F.col("position").isNull(), "cycle").when(F.size("errors") > 0, "invalid")
              .when(F.col("answered").isNull(), "no_result").otherwise("ok"))
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(F.col(c)))), F.lit("[null]"))
    bare = lambda c: F.expr(f"substring(q_{c}, 2, length(q_{c}) - 2)")
    out = checked.join(placed, ["conv_id", "call_id", "occurrence"], "left")
    out = out.withColumns({"q_content": quoted("content"), "q_call_id": quoted("call_id"), "q_name": quoted("name")})
    line = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("value"), F.lit("null")), F.lit(',"content":'), bare("content"), F.lit(',"id":'), bare("call_id"), F.lit(',"name":'), bare("name"), F.lit("}"))
    return out.select("conv_id", "call_id", "name", F.coalesce("turn", "result_turn").alias("turn"), "level", "position", status.alias("status"),
                      F.when(F.col("called"), F.array_join("errors", "; ")).alias("errors"), F.when(F.col("called"), line).alias("json"))
