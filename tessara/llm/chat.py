"""Chat formatting: tool-call linking and canonical JSON, in DataFrame operations.

An assistant message whose text is a JSON object with ``tool_calls`` makes
calls: ``{"content": ..., "tool_calls": [{"id", "name", "arguments"}]}``, where
the arguments are an object or its JSON text. A message of role ``tool`` whose
text is ``{"tool_call_id": ..., "content": ...}`` is a result. A system message
whose text is ``{"tools": [{"name", "parameters"}]}`` declares the tools of its
conversation, each plain or as the ``function`` of an object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small

#: Turns in a part of a conversation.
PART_TURNS = 512
_MESSAGE = "struct<content:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:variant>>>"
_TOOL = "name:string,parameters:variant"
#: JSON Schema's types by the types of variant values.
_TYPES = r"CASE WHEN t IN ('BIGINT') THEN array('integer', 'number') WHEN t IN ('DOUBLE', 'FLOAT') OR t LIKE 'DECIMAL%' THEN array('number') WHEN t = 'STRING' THEN array('string') WHEN t = 'BOOLEAN' THEN array('boolean') WHEN t LIKE 'ARRAY%' THEN array('array') WHEN t LIKE 'OBJECT%' THEN array('object') ELSE array('null') END"


def _messages(conversations: DataFrame) -> DataFrame:
    m = conversations.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    m = m.withColumn("p", F.when(F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{"), F.from_json("text", _MESSAGE)))
    m = m.withColumns({"calls": F.when(F.col("role") == "assistant", F.col("p.tool_calls")), "result_of": F.when(F.col("role") == "tool", F.col("p.tool_call_id"))})
    return m.select("conv_id", "turn", "role", F.when(F.col("calls").isNotNull() | F.col("result_of").isNotNull(), F.col("p.content")).otherwise(F.col("text")).alias("content"), F.expr("transform(calls, c -> named_struct('arguments', if(schema_of_variant(c.arguments) = 'STRING', coalesce(try_parse_json(variant_get(c.arguments, '$', 'string')), c.arguments), c.arguments), 'id', c.id, 'name', c.name))").alias("calls"), "result_of")


def declared_tools(conversations: DataFrame) -> DataFrame:
    """(conv_id, name, parameters) of the tools that system messages declare; a tool without parameters takes any object."""
    m = conversations.select("conv_id", "role", F.col("text").cast("string").alias("text")).where("conv_id is not null and role = 'system' and startswith(ltrim(text), '{') and contains(text, '\"tools\"')")
    m = m.select("conv_id", F.explode(F.from_json("text", f"struct<tools:array<struct<{_TOOL},function:struct<{_TOOL}>>>>")["tools"]).alias("t"))
    schema = "coalesce(t.parameters, t.function.parameters)"
    return m.select("conv_id", F.expr("coalesce(t.name, t.function.name)").alias("name"), F.expr(f"if({schema} is null, '{{}}', to_json({schema}))").alias("parameters"))


def _calls(messages: DataFrame) -> DataFrame:
    return messages.where(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("at", "call")).select("conv_id", "turn", "at", "call.*")


def _accepts(c: str, levels: int, level: int = 0) -> str:
    """SQL that holds ``c``, a struct of a value ``v``, its type ``t`` and its schema ``s``, against the schema, ``levels`` deep."""
    number = f"({c}.t IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {c}.t LIKE 'DECIMAL%')"
    size, json = f"try_variant_get({c}.v, '$', 'double')", f"coalesce(to_json({c}.v), 'null')"
    fields = f"if({c}.t LIKE 'OBJECT%', from_json(to_json({c}.v), 'map<string,variant>'), NULL)"
    kinds = f"aggregate(array({c}.t), array(''), (acc, t) -> {_TYPES})"
    wanted = f"coalesce(try_variant_get({c}.s, '$.type', 'array<string>'), array(try_variant_get({c}.s, '$.type', 'string')))"
    rules = [
        f"(try_variant_get({c}.s, '$.type') IS NULL OR arrays_overlap({kinds}, {wanted}))",
        f"coalesce(exists(try_variant_get({c}.s, '$.enum', 'array<variant>'), e -> coalesce(to_json(e), 'null') = {json}), true)",
        f"coalesce(to_json(try_variant_get({c}.s, '$.const')) = {json}, true)",
        f"(NOT {number} OR (coalesce({size} >= try_variant_get({c}.s, '$.minimum', 'double'), true) AND coalesce({size} <= try_variant_get({c}.s, '$.maximum', 'double'), true)))",
        f"coalesce(forall(try_variant_get({c}.s, '$.required', 'array<string>'), r -> map_contains_key({fields}, r)), true)",
    ]
    if level < levels:
        d = f"c{level + 1}"
        pair = "named_struct('v', {0}, 't', schema_of_variant({0}), 's', {1})".format
        known = f"from_json(to_json(try_variant_get({c}.s, '$.properties')), 'map<string,variant>')"
        own, every = f"coalesce({known}[e.key], try_variant_get({c}.s, '$.additionalProperties'))", f"try_variant_get({c}.s, '$.items')"
        members = f"transform(map_entries({fields}), e -> {pair('e.value', own)})"
        items = f"transform(try_variant_get({c}.v, '$', 'array<variant>'), e -> {pair('e', every)})"
        rules.append(f"forall(CASE WHEN {c}.t LIKE 'OBJECT%' THEN {members} WHEN {c}.t LIKE 'ARRAY%' THEN {items} ELSE array() END, {d} -> {_accepts(d, levels, level + 1)})")
    return f"CASE WHEN {c}.s IS NULL THEN true WHEN schema_of_variant({c}.s) = 'BOOLEAN' THEN variant_get({c}.s, '$', 'boolean') ELSE {' AND '.join(rules)} END"


def _levels(schemas: DataFrame) -> int:
    """How deep the objects of the schemas' JSON are nested at most; None without schemas."""
    plain = F.regexp_replace(F.regexp_replace("parameters", r'"(?:[^"\\]++|\\.)*+"', ""), r"[^{}]", "")
    depth = F.aggregate(F.split(plain, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda x, c: F.struct((x["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("at"), F.greatest(x["most"], x["at"] + F.when(c == "{", 1).otherwise(0)).alias("most")))
    return schemas.agg(F.max(F.coalesce(depth["most"], F.lit(0)))).first()[0]


def _judged(calls: DataFrame, schemas: DataFrame, own: bool) -> DataFrame:
    """Adds ``valid``: the call has an id, the tool is known, and its schema accepts the arguments, an object.

    With ``own`` schemas are those of their conv_id, and a call in a conversation without any needs a name and an id only.
    """
    keys, named = ["conv_id", "name"] if own else ["name"], F.col("name").isNotNull() & F.col("id").isNotNull()
    s = schemas.select(*keys, F.col("parameters").cast("string").alias("parameters")).where("name is not null").groupBy(*keys).agg(F.min("parameters").alias("parameters"))
    levels = _levels(s)
    if own and levels is None:
        return calls.withColumn("valid", named)
    levels = levels or 0
    s = s.withColumn("s", F.expr("try_parse_json(parameters)")).drop("parameters")
    unknown = calls.join(s.select(*keys), keys, "left_anti").withColumn("valid", F.lit(False))
    if own:
        declaring = s.groupBy("conv_id").agg(F.lit(True).alias("declares"))
        unknown = unknown.join(declaring, "conv_id", "left").withColumn("valid", named & F.col("declares").isNull()).drop("declares")
    accepted = F.expr(f"forall(array(named_struct('v', arguments, 't', schema_of_variant(arguments), 's', s)), c0 -> {_accepts('c0', levels)})")
    known = join_small(calls, s, keys)
    known = known.withColumn("valid", F.coalesce(F.expr("schema_of_variant(arguments) LIKE 'OBJECT%'") & accepted, F.lit(False)) & F.col("id").isNotNull())
    return known.select(*unknown.columns).unionByName(unknown)


def format_chats(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per part of a conversation: conv_id, part, n_messages, n_calls, n_linked, n_orphans, n_invalid, json.

    Messages are ordered by turn, but a result comes after the message that
    calls it, in the order of its calls, wherever it stood; ties are ordered by
    role, then content. ``json`` has sorted keys and no blanks; keys of null
    values are left out, and arguments are sorted at every depth. A result
    without a call of its identifier in the conversation is an orphan and
    stays at its turn. An identifier used twice means its first call.

    Calls are held against ``schemas`` (name, parameters: JSON Schema) when
    given; otherwise against the tools that their conversation declares in its
    system messages, and where it declares none (or has no id), a call needs a
    name and an id only. Schemas count at every depth: ``type`` (one or a list), ``enum``, ``const``,
    ``minimum``, ``maximum``, ``required``, ``properties``,
    ``additionalProperties`` and ``items`` (boolean or a schema); other
    keywords ask nothing, nor does a schema that is no JSON. Values are equal
    when their canonical JSON is. Of schemas of one name the first by text counts.

    A conversation is cut into parts of PART_TURNS turns, so that a very long
    one is not gathered in one place; null turns come last, in part 0. Text
    that is no such JSON is content. Null ids and roles are kept as they are,
    repeated rows are repeated messages, other columns are not read, and an
    empty table gives no rows.
    """
    messages = _messages(conversations)
    calls = _calls(messages)
    first = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "at")).alias("call"))
    first = first.select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "call")
    results = messages.where("result_of is not null").join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("result_of") == F.col("i")), "left").drop("c", "i")
    others = messages.where("result_of is null").withColumn("call", F.lit(None).cast(first.schema["call"].dataType))
    m = others.unionByName(results)
    linked = F.col("call").isNotNull()
    m = m.withColumns({"place": F.when(linked, F.col("call.turn")).otherwise(F.col("turn")), "sub": F.when(linked, F.col("call.at") + 1).otherwise(F.lit(0))})
    body = F.to_json(F.struct("content", "role", F.col("result_of").alias("tool_call_id"), F.col("calls").alias("tool_calls")))
    m = m.select("conv_id", F.coalesce(F.expr(f"place div {PART_TURNS}"), F.lit(0)).cast("bigint").alias("part"), F.struct(F.col("place").isNull().alias("n"), "place", "sub", "turn", "role", "content", body.alias("json")).alias("m"), F.coalesce(F.size("calls"), F.lit(0)).alias("calls"), linked.alias("linked"), (F.col("result_of").isNotNull() & ~linked).alias("orphan"))
    out = m.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.greatest("calls", F.lit(0))).cast("bigint").alias("n_calls"),
        F.count_if("linked").alias("n_linked"),
        F.count_if("orphan").alias("n_orphans"),
        F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["json"]), ",").alias("said"),
    )
    bad = _judged(calls, declared_tools(conversations) if schemas is None else schemas, schemas is None).where(~F.col("valid")).groupBy(F.col("conv_id").alias("c"), F.coalesce(F.expr(f"turn div {PART_TURNS}"), F.lit(0)).cast("bigint").alias("p")).agg(F.count(F.lit(1)).alias("n_invalid"))
    out = out.join(bad, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    text = F.concat(F.lit('{"conv_id":'), F.coalesce(F.to_json(F.struct(F.col("conv_id").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("conv_id").alias("x")))) - 6), F.lit("")), F.lit(',"messages":['), F.col("said"), F.lit('],"part":'), F.col("part").cast("string"), F.lit("}"))
    text = F.when(F.col("conv_id").isNull(), F.concat(F.lit('{"messages":['), F.col("said"), F.lit('],"part":'), F.col("part").cast("string"), F.lit("}"))).otherwise(text)
    return out.select("conv_id", "part", "n_messages", "n_calls", "n_linked", "n_orphans", F.coalesce("n_invalid", F.lit(0)).cast("bigint").alias("n_invalid"), text.alias("json"))
