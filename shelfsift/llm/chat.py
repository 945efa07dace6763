"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.session import stage

#: tool: {parameter: (type, required)}; types string, integer, number, boolean, array, object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

REPLY: Schemas = {"reply": {"text": ("string", True), "turn": ("integer", True), "language": ("string", False)}}

_TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*",
}


def _valid(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether variant ``arguments`` is an object with all required parameters, right types and no unknown ones."""
    by_name = F.try_variant_get(arguments, "$", "map<string,variant>")
    rules = []
    for name, parameters in schemas.items():
        names = F.coalesce(F.map_keys(by_name), F.array().cast("array<string>"))
        known = F.size(F.array_except(names, F.array(*[F.lit(p) for p in parameters]).cast("array<string>"))) == 0
        checks = [by_name.isNotNull(), known]
        for parameter, (kind, required) in parameters.items():
            value = F.try_element_at(by_name, F.lit(parameter))
            given = F.array_contains(names, parameter)
            fits = F.coalesce(F.schema_of_variant(value).rlike(f"^({_TYPES[kind]})$"), F.lit(False))
            checks.append((given & fits) if required else (~given | fits))
        rules.append(F.when(tool == name, reduce(lambda a, b: a & b, checks)))
    return F.coalesce(*rules, F.lit(False))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of the first call of each id.

    A call whose needs all name earlier calls of its conversation stands right already: the turns are a
    topological order, and its level is 0. Where a conversation holds a need that names a later call, its
    calls are taken level by level, as many rounds as the longest chain of needs; what never gets ready
    lies on a cycle or behind one and has no level.
    """
    needs = calls.select("_conv", "_id", "_place", F.explode("_needs").alias("_need"))
    needed = calls.select(F.col("_conv").alias("_c"), F.col("_id").alias("_need_id"), F.col("_place").alias("_need_place"))
    edges = needs.join(needed, needs["_conv"].eqNullSafe(needed["_c"]) & (needs["_need"] == needed["_need_id"])).select("_conv", "_id", "_need", "_place", "_need_place")
    edges = stage(edges)
    tangled = stage(edges.where("_need_place >= _place").select("_conv").distinct())
    plain = calls.select("_conv", "_id", F.lit(0).alias("_level"))
    if tangled.isEmpty():
        return plain

    def of_tangled(df: DataFrame, how: str) -> DataFrame:
        other = tangled.select(F.col("_conv").alias("_t"))
        return df.join(other, df["_conv"].eqNullSafe(other["_t"]), how)

    done = of_tangled(plain, "left_anti")
    left = stage(of_tangled(plain, "left_semi").select("_conv", "_id"))
    waiting = stage(of_tangled(edges, "left_semi").select("_conv", "_id", "_need").distinct())
    level = 0
    while not left.isEmpty():
        blocked = waiting.select(F.col("_conv").alias("_c"), F.col("_id").alias("_i")).distinct()
        same = left["_conv"].eqNullSafe(blocked["_c"]) & (left["_id"] == blocked["_i"])
        ready = stage(left.join(blocked, same, "left_anti"))
        if ready.isEmpty():
            done = done.unionByName(left.select("_conv", "_id", F.lit(None).cast("int").alias("_level")))
            break
        done = done.unionByName(ready.select("_conv", "_id", F.lit(level).alias("_level")))
        settled = ready.select(F.col("_conv").alias("_c"), F.col("_id").alias("_r"))
        waiting = stage(waiting.join(settled, waiting["_conv"].eqNullSafe(settled["_c"]) & (waiting["_need"] == settled["_r"]), "left_anti"))
        left = stage(left.join(settled, left["_conv"].eqNullSafe(settled["_c"]) & (left["_id"] == settled["_r"]), "left_anti"))
        level += 1
    return done


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, call_id, turn, level, status, json): one row per call, and one per result without a call.

    ``calls`` has conv_id, turn, call_id, tool, arguments (JSON text) and needs (ids of calls whose results
    it uses); ``results`` has conv_id, turn, call_id and content. Order by (level, turn, call_id) inside a
    conversation puts every call behind those it needs. ``json`` has sorted keys and no white space;
    arguments that are no JSON are null in it.

    status, the first that holds: ``no_id``; ``repeated`` (another call of that id stands earlier; it gets no
    result); ``cyclic``; ``invalid`` (unknown tool, or arguments against its schema); ``unanswered`` (no
    result); ``ok``; and ``orphan`` for results. Of several results of a call the earliest counts; calls
    and results meet by a hash join on (conversation, id), null conversations being one. Needs without a call are
    ignored. Equal rows are told apart as repeats; empty tables give no rows; other columns are not read.
    """
    made = calls.select(
        F.col("conv_id").alias("_conv"), F.col("call_id").alias("_id"), F.col("turn").alias("_place"), F.col("tool").alias("_tool"),
        F.try_parse_json("arguments").alias("_arguments"), F.coalesce("needs", F.array().cast("array<string>")).alias("_needs"),
        F.to_json(F.struct("tool", "arguments", "needs")).alias("_text"))
    # Arguments travel as text: a variant is neither ordered nor compared.
    named = made.where("_id IS NOT NULL")
    ranked = named.groupBy("_conv", "_id").agg(
        F.min(F.struct(F.coalesce("_place", F.lit((1 << 62))).alias("_place"), "_text")).alias("_first"), F.count(F.lit(1)).alias("_times"))
    first = stage(ranked.select("_conv", "_id", F.col("_first._place").alias("_place"), F.from_json("_first._text", "tool string, arguments string, needs array<string>").alias("_c"), "_times"))
    first = first.select("_conv", "_id", "_place", F.col("_c.tool").alias("_tool"), F.try_parse_json("_c.arguments").alias("_arguments"), F.coalesce("_c.needs", F.array().cast("array<string>")).alias("_needs"), "_times")

    answer = results.where("call_id IS NOT NULL").groupBy(F.col("conv_id").alias("_rc"), F.col("call_id").alias("_ri")).agg(
        F.min(F.struct(F.coalesce("turn", F.lit((1 << 62))).alias("turn"), "content")).alias("_answer"))
    levels = _levels(first.select("_conv", "_id", "_place", "_needs")).select(F.col("_conv").alias("_lc"), F.col("_id").alias("_li"), "_level")
    placed = first.join(levels, F.col("_conv").eqNullSafe(F.col("_lc")) & (F.col("_id") == F.col("_li")), "left")
    linked = placed.join(answer, F.col("_conv").eqNullSafe(F.col("_rc")) & (F.col("_id") == F.col("_ri")), "full")

    none, nothing = F.col("_id").isNull(), F.lit(None).cast("string")
    status = (
        F.when(none, "orphan").when(F.col("_level").isNull(), "cyclic").when(~_valid(F.col("_tool"), F.col("_arguments"), schemas), "invalid")
        .when(F.col("_ri").isNull(), "unanswered").otherwise("ok"))
    conv, id_ = F.when(none, F.col("_rc")).otherwise(F.col("_conv")), F.coalesce("_id", "_ri")
    turn = F.when(none, F.col("_answer.turn")).otherwise(F.col("_place"))
    rows = linked.select(
        conv.alias("conv_id"), id_.alias("call_id"), F.nullif(turn, F.lit((1 << 62))).alias("turn"), F.col("_level").alias("level"), status.alias("status"),
        _canonical(id_, F.col("_tool"), F.col("_arguments"), F.col("_answer.content")).alias("json"))
    # All calls but the first of an id, told by their place among equals without sorting any group.
    others = named.join(ranked.where("_times > 1").select(F.col("_conv").alias("_rc"), F.col("_id").alias("_ri"), "_first"), F.col("_conv").eqNullSafe(F.col("_rc")) & (F.col("_id") == F.col("_ri")))
    place = F.coalesce("_place", F.lit((1 << 62)))
    equal = (place == F.col("_first._place")) & (F.col("_text") == F.col("_first._text"))
    counted = others.withColumn("_p", place).groupBy("_conv", "_id", "_p", "_text", equal.alias("_equal")).agg(F.count(F.lit(1)).alias("_n"))
    extra = counted.withColumn("_n", F.col("_n") - F.col("_equal").cast("int")).where("_n > 0").withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    parts = F.from_json("_text", "tool string, arguments string, needs array<string>")
    repeated = extra.withColumn("_c", parts).select(
        F.col("_conv").alias("conv_id"), F.col("_id").alias("call_id"), F.nullif(F.col("_p"), F.lit((1 << 62))).alias("turn"), F.lit(None).cast("int").alias("level"), F.lit("repeated").alias("status"),
        _canonical(F.col("_id"), F.col("_c.tool"), F.try_parse_json("_c.arguments"), nothing).alias("json"))
    nameless = made.where("_id IS NULL").select(
        F.col("_conv").alias("conv_id"), F.col("_id").alias("call_id"), F.col("_place").alias("turn"), F.lit(None).cast("int").alias("level"), F.lit("no_id").alias("status"),
        _canonical(F.col("_id"), F.col("_tool"), F.col("_arguments"), nothing).alias("json"))
    lost = results.where("call_id IS NULL").select(
        "conv_id", "call_id", "turn", F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"),
        _canonical(F.col("call_id"), nothing, F.try_parse_json(nothing), F.col("content")).alias("json"))
    return rows.unionByName(repeated).unionByName(nameless).unionByName(lost)


def _canonical(id_: Column, tool: Column, arguments: Column, result: Column) -> Column:
    """``{"arguments":..,"id":..,"result":..,"tool":..}``: keys sorted at every level, null where there is nothing."""

    def quoted(value: Column) -> Column:
        whole = F.to_json(F.struct(value.alias("v")))  # {"v":...}
        return F.when(value.isNull(), "null").otherwise(whole.substr(F.lit(6), F.length(whole) - 6))

    return F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(arguments), F.lit("null")), F.lit(',"id":'), quoted(id_), F.lit(',"result":'), quoted(result), F.lit(',"tool":'), quoted(tool), F.lit("}"))


LINK_SQL = """
WITH calls AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, text FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn,
  CASE WHEN c.call_id IS NOT NULL THEN 0 END AS level,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN c.text IS NULL THEN 'invalid' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
  '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' WHEN c.text IS NULL THEN '{"turn":' || c.turn || '}'
    ELSE '{"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '}' END
  || ',"id":"' || coalesce(c.call_id, r.call_id) || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null')
  || ',"tool":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END || '}' AS json
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
