"""Chat formatting with tool-call linking, built-in functions alone.

A message whose text is a JSON object may carry calls, ``{"tool_calls": [{"id", "name",
"arguments", "after": [ids]}]}`` (also in the nested form ``{"function": {"name",
"arguments": "<json>"}}``), or a result, ``{"tool_call_id", "content"}``.  Everything
else is plain text.

* Calls and results are hash-joined by conversation and identifier; a call has the
  earliest of its results, a result the earliest of its calls.
* Messages with calls are ordered topologically by ``after``: the level of a message is
  one more than the highest level among the messages it waits for.  Each round settles
  the messages that wait for nothing any more and lowers the counts of those that wait
  for them, so a round costs as much as what still waits; what never settles is on or
  behind a cycle and is reported.  There are as many rounds as the longest chain has
  messages.  A call that waits for another call of its own message waits for nothing.
* Arguments are validated against schemas: those that a system message of the
  conversation declares, ``{"tools": [{"name", "parameters": <JSON schema>}]}`` (also
  under ``function``), or else a table (tool, param, type, required).  Where a
  conversation has neither, its calls are unchecked.
* Messages are serialised as canonical JSON: keys sorted, no optional white space.  What
  the assistant says beside its calls stays; what is wrong with a call is in the column
  ``errors``, never in the message.

Sorting a conversation by (anchor, level, is_result, turn) puts every result after its
call and every call after what it waits for.

Edge cases: null or empty text is empty content; a null conversation is one of its
own; a null identifier links nothing; several calls or results with one identifier
link to the earliest turn; several declarations of a parameter count as the least;
equal rows get equal results; texts of any length are parsed whole; an empty table
gives an empty result; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peergraph.llm.common import BROADCAST_ROWS, Scratch

SCHEMA_DDL = "tool string, param string, type string, required boolean"
#: JSON types by the name of a variant's schema (fixed values).
JSON_TYPES = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number"}


def no_schemas(spark: SparkSession) -> DataFrame:
    """An empty table of schemas, without a Python worker."""
    return spark.sql("select cast(null as string) as tool, cast(null as string) as param, cast(null as string) as type, false as required where false")


def _type_of(value: Column) -> Column:
    name = F.schema_of_variant(value)
    out = F.when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").when(name.startswith("DECIMAL"), "number")
    for spark_name, json_name in JSON_TYPES.items():
        out = out.when(name == spark_name, json_name)
    return out.otherwise("string")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _said(v: Column, path: str) -> Column:
    """A string as it is, any other JSON value as its text; null where there is none."""
    other = F.to_json(F.try_variant_get(v, path, "variant"))
    return F.coalesce(_text(v, path), F.when(other != "null", other))


def parsed(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, content, said, calls, tools, result_of, result, mark of every message."""
    body = F.coalesce(F.col(text), F.lit(""))
    v = F.when(F.rlike(body, F.lit(r"^\s*\{")), F.try_parse_json(body))
    call = lambda c: F.struct(
        _text(c, "$.id").alias("id"),
        F.coalesce(_text(c, "$.function.name"), _text(c, "$.name")).alias("name"),
        F.coalesce(
            F.try_parse_json(_text(c, "$.function.arguments")), F.try_variant_get(c, "$.function.arguments", "variant"),
            F.try_variant_get(c, "$.arguments", "variant"), F.parse_json(F.lit("{}")),
        ).alias("arguments"),
        F.coalesce(F.try_variant_get(c, "$.after", "array<string>"), F.expr("cast(array() as array<string>)")).alias("after"),
    )
    rows = messages.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("content"), v.alias("v")
    )
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    return rows.select(
        "conv", "turn", "role", "content", _said(F.col("v"), "$.content").alias("said"), F.transform(calls, call).alias("calls"),
        F.when(F.col("role") == "system", F.try_variant_get("v", "$.tools", "array<variant>")).alias("tools"),
        _text(F.col("v"), "$.tool_call_id").alias("result_of"),
        F.xxhash64("turn", "role", "content").alias("mark"),
    )


def declared(rows: DataFrame) -> DataFrame:
    """(conv, tool, param, types, required) of the tools that system messages declare; a tool without parameters has a null one."""
    tool = F.col("t")
    part = lambda path, kind: F.coalesce(
        F.try_variant_get(tool, f"$.function.{path}", kind), F.try_variant_get(tool, f"$.{path}", kind)
    )
    tools = rows.where(F.size("tools") > 0).select("conv", F.explode("tools").alias("t")).select(
        "conv", part("name", "string").alias("tool"), part("parameters.properties", "map<string,variant>").alias("properties"),
        F.coalesce(part("parameters.required", "array<string>"), F.expr("cast(array() as array<string>)")).alias("needed"),
    )
    kinds = lambda v: F.coalesce(F.try_variant_get(v, "$.type", "array<string>"), F.array(_text(v, "$.type")))
    return tools.select("conv", "tool", "needed", F.explode_outer("properties").alias("param", "about")).select(
        "conv", "tool", "param", F.filter(kinds(F.col("about")), lambda x: x.isNotNull()).alias("types"), F.array_contains("needed", F.col("param")).alias("required")
    )


def _params(schemas: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``params``: parameter -> (types, required); one row to a tool, whatever is repeated."""
    each = schemas.groupBy(*keys, "param").agg(F.min(F.struct("types", F.coalesce("required", F.lit(False)).alias("required"))).alias("about"))
    entries = F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "about")))
    return each.groupBy(*keys).agg(F.map_from_entries(entries).alias("params"))


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, id, level, anchor of every node (a message with calls) that is on or behind no cycle.

    ``calls`` has conv, id (unique in its conversation), turn, done (turn of the result
    or null) and after.  Identifiers that name no node of the conversation are not waited for.
    """
    names = calls.select(F.col("conv").alias("c2"), F.col("id").alias("i2"))
    waits = calls.select("conv", "id", F.explode(F.array_distinct("after")).alias("dep"))
    waits = scratch.table(waits.join(names, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("dep") == F.col("i2"))).select("conv", "id", "dep"), "waits")
    same = lambda c, i: F.col("conv").eqNullSafe(F.col(c)) & (F.col("id") == F.col(i))
    need = waits.groupBy(F.col("conv").alias("wc"), F.col("id").alias("wi")).agg(F.count(F.lit(1)).alias("left"))
    state = scratch.table(
        calls.join(need, same("wc", "wi"), "left").select(
            "conv", "id", "done", F.coalesce("left", F.lit(0)).alias("left"), F.lit(-1).alias("top"), F.col("turn").cast("long").alias("at")
        ), "state0",
    )
    settled, step = [], 0
    while True:
        new = scratch.table(state.where("left = 0").select("conv", "id", (F.col("top") + 1).alias("level"), F.col("at").alias("anchor"), "done"), f"settled{step}")
        settled.append(f"{scratch.root}/settled{step}")
        if new.isEmpty():
            break
        seen = new.select(F.col("conv").alias("nc"), F.col("id").alias("ni"), "level", F.greatest("anchor", F.coalesce("done", "anchor")).alias("ready"))
        met = waits.join(seen, F.col("conv").eqNullSafe(F.col("nc")) & (F.col("dep") == F.col("ni"))).groupBy(
            F.col("conv").alias("mc"), F.col("id").alias("mi")
        ).agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level"), F.max("ready").alias("ready"))
        state = scratch.table(
            state.where("left > 0").join(met, same("mc", "mi"), "left").select(
                "conv", "id", "done", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("top", "level").alias("top"), F.greatest("at", "ready").alias("at")
            ), f"state{step + 1}",
        )
        scratch.drop(f"state{step}")
        step += 1
    return scratch.spark.read.schema(new.schema).parquet(*settled).drop("done")


def _errors(calls: DataFrame, schemas: DataFrame, own: DataFrame, n_tools: int, n_own: int) -> DataFrame:
    """``calls`` with ``checked`` and ``errors``: unknown_tool, missing:p, unknown:p, type:p, in sorted order."""
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    general = schemas.where("tool is not null").select("tool", "param", F.when(F.col("type").isNotNull(), F.array("type")).alias("types"), "required")
    general = _params(general, "tool").select(F.col("tool").alias("gt"), F.col("params").alias("gp"))
    local = _params(own.where("tool is not null"), "conv", "tool").select(F.col("conv").alias("oc"), F.col("tool").alias("ot"), F.col("params").alias("op"))
    has = own.select(F.col("conv").alias("hc"), F.lit(True).alias("has")).distinct()
    args = F.coalesce(F.try_variant_get("arguments", "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    joined = (
        calls.withColumn("args", args)
        .join(small(local, n_own), F.col("conv").eqNullSafe(F.col("oc")) & (F.col("name") == F.col("ot")), "left")
        .join(small(has, n_own), F.col("conv").eqNullSafe(F.col("hc")), "left")
        .join(small(general, n_tools), F.col("name") == F.col("gt"), "left")
        .withColumn("params", F.coalesce("op", "gp")).withColumn("checked", F.coalesce("has", F.lit(n_tools > 0)))
    )
    given = F.map_keys("args")
    wanted = F.map_keys("params")
    missing = F.transform(
        F.filter(wanted, lambda p: F.element_at("params", p)["required"] & ~F.array_contains(given, p)), lambda p: F.concat(F.lit("missing:"), p)
    )
    unknown = F.transform(F.array_except(given, wanted), lambda p: F.concat(F.lit("unknown:"), p))

    def wrong(p: Column) -> Column:
        is_, want = _type_of(F.element_at("args", p)), F.element_at("params", p)["types"]
        fits = F.array_contains(want, is_) | (F.array_contains(want, "number") & (is_ == "integer"))
        return F.coalesce((F.size(want) > 0) & ~fits, F.lit(False))

    types = F.transform(F.filter(F.array_intersect(given, wanted), wrong), lambda p: F.concat(F.lit("type:"), p))
    found = F.when(~F.col("checked"), F.expr("cast(array() as array<string>)")).when(F.col("params").isNull(), F.array(F.lit("unknown_tool")))
    return joined.withColumn("errors", found.otherwise(F.array_sort(F.concat(missing, unknown, types)))).drop(
        "args", "params", "oc", "ot", "op", "hc", "has", "gt", "gp"
    )


def format_chat(
    messages: DataFrame, schemas: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: conv_id, turn, role, anchor, level, is_result, n_calls, n_answered, n_invalid, status, errors, message.

    ``errors`` is ``identifier:error`` of the message's calls, comma-joined in their order.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "toolcalls")
    schemas = no_schemas(spark) if schemas is None else schemas
    rows = parsed(messages, conv_id, turn, role, text)
    own = scratch.table(declared(rows), "declared")
    # calls and results, one row per identifier: few beside the messages
    raised = rows.where(F.size("calls") > 0).select("conv", "turn", "mark", F.posexplode("calls").alias("nth", "call"))
    raised = scratch.table(
        raised.select("conv", "turn", "mark", "nth", "call.id", "call.name", F.to_json("call.arguments").alias("arguments"), "call.after").distinct(), "calls"
    )
    given = rows.where("result_of is not null").groupBy(F.col("conv").alias("gc"), F.col("result_of").alias("gi")).agg(F.min("turn").cast("long").alias("done"))
    given = scratch.table(given, "results")
    first = raised.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "mark")).alias("m"))
    first = scratch.table(
        first.join(given, F.col("conv").eqNullSafe(F.col("gc")) & (F.col("id") == F.col("gi")), "left").select(
            F.col("conv").alias("lc"), F.col("id").alias("li"), F.col("m.mark").alias("by"), "done"
        ), "first",
    )
    mine = first.select("lc", "li", F.col("by").alias("dep"))
    waits = raised.select("conv", "mark", "id", F.explode("after").alias("wait"))
    waits = (
        waits.join(mine, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("wait") == F.col("li")))
        .where((F.col("dep") != F.col("mark")) | (F.col("wait") == F.col("id")))
        .groupBy(F.col("conv").alias("wc"), F.col("mark").alias("wm")).agg(F.collect_set(F.col("dep").cast("string")).alias("after"))
    )
    checked = _errors(raised.withColumn("arguments", F.parse_json("arguments")), schemas, own, schemas.count(), own.count())
    each = checked.join(first, F.col("conv").eqNullSafe(F.col("lc")) & (F.col("id") == F.col("li")), "left")
    asking = each.groupBy("conv", "mark").agg(
        F.min("turn").alias("turn"), F.max("done").alias("done"), F.count("done").alias("n_answered"), F.count_if(F.size("errors") > 0).alias("n_invalid"),
        F.count_if("checked").alias("n_checked"),
        F.array_sort(F.collect_list(F.struct(
            "nth", F.to_json(F.struct(F.when(F.size("after") > 0, F.col("after")).alias("after"), "arguments", "id", "name")).alias("json"),
            F.array_join(F.transform("errors", lambda e: F.concat(F.coalesce("id", F.lit("")), F.lit(":"), e)), ",").alias("errors"),
        ))).alias("json_calls"),
    )
    asking = asking.join(waits, F.col("conv").eqNullSafe(F.col("wc")) & (F.col("mark") == F.col("wm")), "left").drop("wc", "wm")
    none = F.expr("cast(array() as array<string>)")
    asking = scratch.table(asking.withColumn("id", F.col("mark").cast("string")).withColumn("after", F.coalesce("after", none)), "asking")
    order = levels(asking, scratch).select(F.col("conv").alias("oc"), F.col("id").alias("oi"), "level", "anchor")
    per_message = scratch.table(
        asking.join(order, F.col("conv").eqNullSafe(F.col("oc")) & (F.col("id") == F.col("oi")), "left").select(
            F.col("conv").alias("pc"), F.col("mark").alias("pm"), "n_answered", "n_invalid", "n_checked", "json_calls",
            F.col("level").alias("call_level"), F.col("anchor").alias("call_anchor"),
        ), "per_message",
    )
    results = scratch.table(
        first.join(per_message, F.col("lc").eqNullSafe(F.col("pc")) & (F.col("by") == F.col("pm"))).select(
            F.col("lc").alias("rc"), F.col("li").alias("ri"), F.col("call_level").alias("result_level"), F.col("call_anchor").alias("result_anchor")
        ), "answers",
    )
    n_calls, n_linked = per_message.count(), results.count()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    joined = rows.join(small(per_message, n_calls), F.col("conv").eqNullSafe(F.col("pc")) & (F.col("mark") == F.col("pm")), "left").join(
        small(results, n_linked), F.col("conv").eqNullSafe(F.col("rc")) & (F.col("result_of") == F.col("ri")), "left"
    )
    is_call, is_result = F.coalesce(F.size("calls") > 0, F.lit(False)), F.col("result_of").isNotNull()
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} as x)), 6, length(to_json(struct({c} as x))) - 6)")
    plain = F.concat(F.lit('{"content":'), quoted("content"), F.lit(',"role":'), quoted("role"), F.lit("}"))
    answer = F.concat(
        F.lit('{"content":'), quoted("coalesce(said, '')"), F.lit(',"role":'), quoted("role"), F.lit(',"tool_call_id":'), quoted("result_of"), F.lit("}")
    )
    words = F.when(F.col("said").isNull(), "").otherwise(F.concat(F.lit('"content":'), quoted("said"), F.lit(",")))
    asked = F.concat(
        F.lit("{"), words, F.lit('"role":'), quoted("role"), F.lit(',"tool_calls":['), F.array_join(F.transform("json_calls", lambda x: x["json"]), ","), F.lit("]}")
    )
    at = F.col("turn").cast("long")
    status = (
        F.when(is_call & F.col("call_level").isNull(), "cycle").when(is_call & (F.col("n_invalid") > 0), "invalid")
        .when(is_call & (F.col("n_checked") < F.size("calls")), "unchecked")
        .when(is_call & (F.col("n_answered") < F.size("calls")), "unanswered").when(is_call, "answered")
        .when(is_result & F.col("ri").isNull(), "orphan").when(is_result, "linked").otherwise("plain")
    )
    return joined.select(
        F.col("conv").alias("conv_id"), "turn", "role",
        F.when(is_call, F.coalesce("call_anchor", at)).when(is_result, F.greatest(F.coalesce("result_anchor", at), at)).otherwise(at).alias("anchor"),
        F.when(is_call, F.coalesce("call_level", F.lit(0))).when(is_result, F.coalesce("result_level", F.lit(0))).otherwise(0).alias("level"),
        is_result.alias("is_result"),
        F.when(is_call, F.size("calls")).otherwise(0).cast("long").alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        F.coalesce("n_invalid", F.lit(0)).cast("long").alias("n_invalid"),
        status.alias("status"),
        F.when(is_call, F.array_join(F.filter(F.transform("json_calls", lambda x: x["errors"]), lambda e: e != ""), ",")).otherwise("").alias("errors"),
        F.when(is_call, asked).when(is_result, answer).otherwise(plain).alias("message"),
    )
