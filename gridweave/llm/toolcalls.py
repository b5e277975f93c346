"""Chat formatting: tool calls linked with their results. DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier). Arguments are checked against the tool's schema, and each
call becomes one line of canonical JSON: keys in order, no blanks, absent values left out.

Order: a call comes after those it names in ``after``. Where every named call has an earlier turn, turns are such an
order already, and ``level`` is 0. Only conversations with a call before one it needs are levelled round by round (a call
gets its level once all it needs have theirs); calls on a cycle get none. Sorting a conversation by (level, turn) is
a topological order, so no conversation has to meet in one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

#: Tools that conversations without explicit calls are written with: name, required arguments and their types.
SCHEMAS = {"reply": {"text": "STRING", "turn": "BIGINT"}}

CALL = ["conv_id", "turn", "call_id", "name", "arguments", "after"]
RESULT = ["conv_id", "turn", "call_id", "content"]


def messages(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, others) of ``turns`` (conv_id, turn, role, text).

    Explicit: an assistant's text that is a JSON object with ``tool_calls`` (objects with id, name, arguments and perhaps
    ``after``, a list of ids), and a tool's text that is one with ``tool_call_id`` and ``content``. Else a user's turn is a call of
    ``reply`` with the identifier ``turn``, after the user's turn two before, and an assistant's turn is the result for the
    turn before it. Other turns are ``others``, as are turns without conv_id or turn.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    rows = rows.withColumn("body", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    listed = F.expr("try_variant_get(body, '$.tool_calls', 'array<variant>')")
    answered = F.expr("try_variant_get(body, '$.tool_call_id', 'string')")
    kind = (
        F.when(~named, "other")
        .when((F.col("role") == "assistant") & listed.isNotNull(), "calls")
        .when((F.col("role") == "tool") & answered.isNotNull(), "answer")
        .when(F.col("role") == "user", "user")
        .when(F.col("role") == "assistant", "assistant")
        .otherwise("other")
    )
    rows = rows.withColumn("kind", kind)
    each = rows.where("kind = 'calls'").select("conv_id", "turn", F.explode(listed).alias("call"))
    get = lambda path, kind: F.expr(f"try_variant_get(call, '$.{path}', '{kind}')")
    explicit = each.select(
        "conv_id",
        "turn",
        get("id", "string").alias("call_id"),
        get("name", "string").alias("name"),
        F.coalesce(F.when(get("arguments", "string").startswith("{"), get("arguments", "string")), F.to_json(get("arguments", "variant"))).alias("arguments"),
        F.coalesce(get("after", "array<string>"), F.array().cast("array<string>")).alias("after"),
    )
    turn_id = F.col("turn").cast("string")
    implied = rows.where("kind = 'user'").select(
        "conv_id",
        "turn",
        turn_id.alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array((F.col("turn") - 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = rows.where("kind = 'answer'").select("conv_id", "turn", answered.alias("call_id"), F.expr("try_variant_get(body, '$.content', 'string')").alias("content"))
    results = results.union(rows.where("kind = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).cast("string"), "text"))
    return explicit.union(implied), results, rows.where("kind = 'other'").select("conv_id", "turn", "role", "text")


def _levels(calls: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, call_id, level) of the calls of conversations where a call stands before one it needs."""
    needs = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("after")).alias("needed"))
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("needed_id"), F.col("turn").alias("needed_turn"))
    needs = needs.join(known, (F.col("conv_id") == F.col("c")) & (F.col("needed") == F.col("needed_id")))
    turned = needs.where("needed_turn >= turn").select("conv_id").distinct()
    nodes = shelf.put(calls.join(turned, "conv_id", "left_semi").select("conv_id", "call_id"))
    edges = shelf.put(needs.join(turned, "conv_id", "left_semi").select("conv_id", "call_id", "needed"))
    done, left, level = None, nodes, 0
    while not left.isEmpty():
        held = edges.select("conv_id", "call_id").distinct()
        free = shelf.put(left.join(held, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break  # what is left stands on a cycle or behind one
        done = free if done is None else done.union(free)
        left = shelf.put(left.join(free, ["conv_id", "call_id"], "left_anti"))
        gone = free.select("conv_id", F.col("call_id").alias("needed"))
        edges = shelf.put(edges.join(gone, ["conv_id", "needed"], "left_anti").select("conv_id", "call_id", "needed"))
        level += 1
    cyclic = left.withColumn("level", F.lit(None).cast("int"))
    return cyclic if done is None else done.union(cyclic)


def tool_lines(turns: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, kind, call_id, level, status, errors, result_turn, json): a row for each call, unlinked result and other turn.

    ``status``: ``ok``, ``invalid`` (errors name the unknown tool, unreadable arguments, missing or mistyped ones), ``open`` (a
    valid call without result), ``cycle``, ``orphan`` (a result without call) or ``context``. Of calls or results that
    repeat an identifier in a conversation the first by (turn, text) counts and the others are ``repeated``. Turns without
    conv_id or turn are context. Each call without an identifier is a row of its own. Null texts miss their argument. Other columns are ignored; an empty table gives an
    empty one.
    """
    shelf = Shelf(turns.sparkSession, "calls")
    calls, results, others = messages(turns)
    calls, results = shelf.put(calls), shelf.put(results)
    key = ["conv_id", "call_id"]
    named = calls.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("first"), F.count(F.lit(1)).alias("times"))
    # A call without an identifier is a call of its own that nothing can answer or need.
    nameless = calls.where("call_id is null").select(*key, "turn", "name", "arguments", "after", F.lit(1).cast("long").alias("times"))
    first_call = shelf.put(named.select(*key, "first.*", "times").unionByName(nameless))
    first_result = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("first"), F.count(F.lit(1)).alias("times"))
    first_result = shelf.put(first_result.select("conv_id", "call_id", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("result"), F.col("times").alias("result_times")))

    own = first_call.join(first_result, key, "left").join(_levels(first_call.where("call_id is not null"), shelf).withColumn("turned", F.lit(True)), key, "left")
    own = own.withColumn("body", F.try_parse_json("arguments"))
    found = [F.when(~F.coalesce(F.col("name").isin(*schemas), F.lit(False)), F.lit("unknown tool"))]
    found.append(F.when(F.col("body").isNull(), F.lit("unreadable arguments")))
    for tool, fields in schemas.items():
        for field, kind in fields.items():
            value = F.expr(f"try_variant_get(body, '$.{field}', 'variant')")
            here = (F.col("name") == tool) & F.col("body").isNotNull()
            missing = value.isNull() | F.expr(f"is_variant_null(try_variant_get(body, '$.{field}', 'variant'))")
            found.append(F.when(here & missing, F.lit(f"missing {field}")))
            found.append(F.when(here & ~missing & (F.schema_of_variant(value) != kind), F.lit(f"{field} is not {kind}")))
    own = own.withColumn("errors", F.array_compact(F.array(*found)))
    status = (
        F.when(F.size("errors") > 0, "invalid")
        .when(F.col("turned") & F.col("level").isNull(), "cycle")
        .when(F.col("result_turn").isNull(), "open")
        .otherwise("ok")
    )
    line = F.to_json(F.struct(F.col("body").alias("arguments"), "call_id", F.lit("call").alias("kind"), "name", "result"))
    linked = own.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.when(F.col("turned"), F.col("level")).otherwise(0).alias("level"), status.alias("status"), F.array_join("errors", "; ").alias("errors"), "result_turn", line.alias("json")
    )

    def alone(rows: DataFrame, kind: str, status: str, text: str) -> DataFrame:
        line = F.to_json(F.struct(F.col(text).alias("content"), F.lit(kind).alias("kind")))
        return rows.select("conv_id", "turn", F.lit(kind).alias("kind"), "call_id", F.lit(0).alias("level"), F.lit(status).alias("status"), F.lit("").alias("errors"), F.lit(None).cast("long").alias("result_turn"), line.alias("json"))

    def again(rows: DataFrame, firsts: DataFrame, turn: str, value: str, times: str) -> DataFrame:
        """The rows that repeat an identifier, but for one copy of the first."""
        firsts = firsts.where(f"{times} > 1").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col(turn).alias("t"), F.col(value).alias("v"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("call_id").eqNullSafe(F.col("i"))
        counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).join(firsts, same)
        column = "arguments" if value == "arguments" else "content"
        is_first = F.col("turn").eqNullSafe(F.col("t")) & F.col(column).eqNullSafe(F.col("v"))
        return counted.withColumn("n", F.col("n") - F.when(is_first, 1).otherwise(0)).where("n > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))

    orphans = first_result.join(first_call.select(*key), key, "left_anti").select("conv_id", F.col("result_turn").alias("turn"), "call_id", "result")
    others = others.withColumn("call_id", F.lit(None).cast("string"))
    return (
        linked.union(alone(orphans, "result", "orphan", "result"))
        .union(alone(others, "context", "context", "text"))
        .union(alone(again(calls, first_call, "turn", "arguments", "times"), "call", "repeated", "arguments"))
        .union(alone(again(results, first_result, "result_turn", "result", "result_times"), "result", "repeated", "content"))
    )


def oracle() -> str:
    """The same in DuckDB for conversations of user, assistant and other turns without explicit calls or repeated turns."""
    line = "json_object({})::VARCHAR"
    call = line.format("'arguments', json_object('text', c.text, 'turn', c.turn), 'call_id', CAST(c.turn AS VARCHAR), 'kind', 'call', 'name', 'reply', 'result', r.text")
    bare = line.format("'arguments', json_object('text', c.text, 'turn', c.turn), 'call_id', CAST(c.turn AS VARCHAR), 'kind', 'call', 'name', 'reply'")
    return f"""WITH c AS (SELECT * FROM conversations WHERE role = 'user'), r AS (SELECT * FROM conversations WHERE role = 'assistant')
    SELECT c.conv_id, c.turn, 'call' AS kind, CAST(c.turn AS VARCHAR) AS call_id, 0 AS level, CASE WHEN r.turn IS NULL THEN 'open' ELSE 'ok' END AS status, '' AS errors,
        r.turn AS result_turn, CASE WHEN r.text IS NULL THEN {bare} ELSE {call} END AS json FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND r.turn = c.turn + 1
    UNION ALL SELECT r.conv_id, r.turn, 'result', CAST(r.turn - 1 AS VARCHAR), 0, 'orphan', '', NULL, {line.format("'content', r.text, 'kind', 'result'")}
        FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND r.turn = c.turn + 1 WHERE c.turn IS NULL
    UNION ALL SELECT conv_id, turn, 'context', NULL, 0, 'context', '', NULL, {line.format("'content', text, 'kind', 'context'")} FROM conversations WHERE role NOT IN ('user', 'assistant')"""
