"""Chat formatting: link tool calls with results, order, validate, serialise.

Calls are rows (conv_id, turn, call_id, name, arguments, after), results rows
(conv_id, turn, call_id, content); ``calls_of`` and ``results_of`` read them
from messages.  ``link`` joins both by (conv_id, call_id), both sides reduced
to one row per identifier before: the earliest call, and the earliest result
that follows it.  Order: calls of an earlier turn come first; within a turn, a
call comes after those it refers to (``after``, or "$id" in its arguments).
Levels within a turn grow round by round: each round peels the calls all of whose
references have a level, so there are as many rounds as the longest chain has
calls; what is never peeled hangs on a cycle and has no level.  A reference to a
later turn or an unknown call is an error.

Arguments are parsed as variants and held against a schema table
(name, field, type, required): errors name missing, unknown and wrongly typed
fields.  Canonical JSON has sorted keys, no white space and the shortest forms,
so equal calls give equal bytes.

The plan joins on identifiers, which no hot conversation shares, keeps one row
per call, and never gathers a conversation in one row or task.

Edge cases: null or empty texts hold no call; a text that is not JSON is no
call; a null identifier links with nothing; repeated rows count once; ties go
to the lesser content; an empty table gives an empty result; other columns
pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradelta.llm.common import stored

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULTS = "tool_call_id string, content string"
#: Type of a schema: what schema_of_variant may say.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*", "null": "VOID"}
SCHEMA = "name string, field string, type string, required boolean"


def calls_of(messages: DataFrame) -> DataFrame:
    """Calls in the texts of assistant messages: {"tool_calls": [{"id", "name", "arguments", "after"}]}."""
    m = messages.where("role = 'assistant' and startswith(ltrim(text), '{')").select("conv_id", "turn", F.from_json("text", CALLS).alias("m"))
    m = m.select("conv_id", "turn", F.explode("m.tool_calls").alias("c"))
    return m.select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))


def results_of(messages: DataFrame) -> DataFrame:
    """Results in the texts of tool messages: {"tool_call_id", "content"}."""
    m = messages.where("role = 'tool' and startswith(ltrim(text), '{')").select("conv_id", "turn", F.from_json("text", RESULTS).alias("m"))
    return m.select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), "m.content")


def ordered(calls: DataFrame) -> DataFrame:
    """calls, one per identifier, with level (null on a cycle) and bad_refs."""
    calls = calls.where("call_id is not null and conv_id is not null")
    refs = F.array_distinct(F.concat("after", F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit('"\\$([^"]+)"'), F.lit(1))))
    one = calls.withColumn("after", refs).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c")).select("conv_id", "call_id", "c.*")
    one, _ = stored(one, "chat-calls")
    edges = one.select("conv_id", "call_id", "turn", F.explode("after").alias("dep"))
    known = one.select(F.col("conv_id").alias("kc"), F.col("call_id").alias("ki"), F.col("turn").alias("kt"))
    edges = edges.join(known, (F.col("conv_id") == F.col("kc")) & (F.col("dep") == F.col("ki")), "left")
    edges, _ = stored(edges.select("conv_id", "call_id", "turn", "dep", "kt"), "chat-edges")
    bad = edges.where("kt is null or kt > turn").groupBy("conv_id", "call_id").agg(F.count("*").alias("bad_refs"))
    inner = edges.where("kt = turn").select("conv_id", "call_id", "dep")
    one = one.join(bad, ["conv_id", "call_id"], "left").withColumn("bad_refs", F.coalesce("bad_refs", F.lit(0)))
    if inner.isEmpty():
        return one.withColumn("level", F.lit(0).cast("long"))
    own = ["conv_id", "call_id"]
    level, _ = stored(one.select(*own).join(inner, own, "left_anti").withColumn("level", F.lit(0).cast("long")), "chat-level")
    last, waiting, k = level, inner, 0
    while not waiting.isEmpty():
        k += 1
        met = last.select("conv_id", F.col("call_id").alias("dep"))
        left, _ = stored(waiting.join(met, ["conv_id", "dep"], "left_anti"), "chat-waiting")
        last, _ = stored(waiting.select(*own).distinct().join(left, own, "left_anti").withColumn("level", F.lit(k).cast("long")), "chat-level")
        if last.isEmpty():
            break
        level, waiting = level.unionByName(last), left
    return one.join(level, own, "left")


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with errors: an array of words on arguments that the tool's schema refuses."""
    fields = schemas.groupBy(F.col("name").alias("tool")).agg(F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    d = calls.join(fields, F.col("name") == F.col("tool"), "left").withColumn("v", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False))
    d = d.withColumn("got", F.when(is_object, F.transform(F.map_entries(F.expr("cast(v as map<string, variant>)")), lambda e: F.struct(e["key"].alias("field"), F.schema_of_variant(e["value"]).alias("type")))))

    def problem(f: Column) -> Column:
        mine = F.get(F.filter("got", lambda g: g["field"] == f["field"]), F.lit(0))
        fits = F.lit(False)
        for name, pattern in TYPES.items():
            fits = fits | ((f["type"] == name) & mine["type"].rlike(f"^{pattern}$"))
        return F.when(mine.isNull(), F.when(f["required"], F.concat(F.lit("missing "), f["field"]))).when(~fits, F.concat(F.lit("type "), f["field"]))

    wrong = F.filter(F.transform("fields", problem), lambda x: x.isNotNull())
    unknown = F.transform(F.filter("got", lambda g: ~F.exists("fields", lambda f: f["field"] == g["field"])), lambda g: F.concat(F.lit("unknown "), g["field"]))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("no such tool"))).when(F.col("got").isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(wrong, unknown))
    return d.withColumn("errors", errors).drop("tool", "fields", "got")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without one.

    (conv_id, call_id, turn, level, status, result_turn, errors, json): status is
    answered, unanswered or orphan; json is canonical.  Order by conv_id, turn,
    level and call_id is topological.
    """
    c = validated(ordered(calls), schemas)
    r = results.where("call_id is not null and conv_id is not null")
    near = r.join(c.select("conv_id", "call_id", F.col("turn").alias("ct")), ["conv_id", "call_id"], "left").withColumn("late", F.coalesce(F.col("turn") > F.col("ct"), F.lit(False)))
    first = near.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("late"), F.struct(F.col("turn").alias("result_turn"), "content"))).alias("r"), F.min(F.when(~F.col("late"), F.struct(F.col("turn").alias("result_turn"), "content"))).alias("o"))
    d = c.join(first.where("r is not null").select("conv_id", "call_id", "r.*", F.lit(True).alias("has")), ["conv_id", "call_id"], "left")
    d = d.select("conv_id", "call_id", "turn", "level", F.when(F.col("has"), "answered").otherwise("unanswered").alias("status"), "result_turn", "errors", "bad_refs", "name", "v", "content")
    errors = F.concat("errors", F.when(F.col("bad_refs") > 0, F.array(F.lit("bad reference"))).otherwise(F.array().cast("array<string>")), F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("errors", errors).drop("bad_refs")
    lone = first.where("r is null").select("conv_id", "call_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("level"), F.lit("orphan").alias("status"), F.col("o.result_turn"), F.array().cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("name"), F.expr("cast(null as variant)").alias("v"), F.col("o.content"))
    d = d.unionByName(lone)
    # keys in order, no white space; the variant's own objects are ordered by key
    part = lambda key, value: F.concat(F.lit(f'"{key}":'), F.coalesce(value, F.lit("null")))
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    json = F.concat(F.lit("{"), F.concat_ws(",", part("arguments", F.to_json("v")), part("content", F.when(F.col("content").isNotNull(), text("content"))), part("id", text("call_id")), part("name", F.when(F.col("name").isNotNull(), text("name")))), F.lit("}"))
    return d.select("conv_id", "call_id", "turn", "level", "status", "result_turn", "errors", json.alias("json"))


#: Tools of the stand-in calls; ``note`` is none of them.
TOOLS = [("reply", "text", "string", True), ("reply", "turn", "integer", True), ("score", "of", "string", True), ("score", "weight", "number", True)]


def stand_ins(m: DataFrame) -> DataFrame:
    """Messages with tool calls and results, (conv_id, turn, role, text), from plain ones.

    The conversations hold none, so a user's turn makes two calls: a ``reply`` and a
    ``score`` that refers to it.  The next assistant's turn answers these.  All other
    roles but ``tool`` make a call of ``note``.  By the number of the conversation some
    calls refer to each other, to a later turn or an unknown call, have a field
    that the tool doesn't know or one of the wrong type, stay without a result, or
    have two results.
    """
    name = lambda turn, kind: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"), F.lit(kind))
    k, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    none = F.array().cast("array<string>")
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    call = lambda i, n, a, after: F.struct(i.alias("id"), F.lit(n).alias("name"), a.alias("arguments"), after.alias("after"))
    reply = call(name(turn, "a"), "reply", json(F.struct("text", "turn")), F.when(k % 5 == 2, F.array(name(turn, "b"))).otherwise(none))
    of = F.concat(F.lit("$"), name(turn, "a")).alias("of")
    plain, heavy = json(F.struct(of, turn.alias("weight"))), json(F.struct(of, F.lit("heavy").alias("weight")))
    arguments = F.when(turn % 3 == 0, heavy).otherwise(plain)
    arguments = F.when(k % 4 == 1, F.concat(F.lit('{"extra":true,'), F.substring(arguments, 2, 1 << 20))).otherwise(arguments)
    score = call(name(turn, "b"), "score", arguments, F.when(k % 7 == 3, F.array(name(turn + 2, "a"))).otherwise(none))
    note = call(name(turn, "n"), "note", json(F.struct("text")), none)
    made = F.when(F.col("role") == "user", F.array(reply, score)).when(~F.col("role").isin("assistant", "tool"), F.array(note))
    calls = m.select("conv_id", "turn", F.lit("assistant").alias("role"), F.when(made.isNotNull(), F.to_json(F.struct(made.alias("tool_calls")))).alias("text")).where("text is not null")
    result = lambda kind, c: F.struct(name(turn - 1, kind).alias("tool_call_id"), c.alias("content"))
    results = F.concat(F.array(result("a", text)), F.when(k % 3 != 1, F.array(result("b", F.length(text).cast("string")))).otherwise(F.array()), F.when(k % 6 == 5, F.array(result("a", F.lit("~ again")))).otherwise(F.array()))
    answers = m.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), F.explode(results).alias("r"))
    return calls.unionByName(answers.select("conv_id", "turn", "role", F.to_json("r").alias("text")))


def op7_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and results of the table, and those that its plain turns stand for."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    real = F.coalesce(F.size(F.from_json("text", CALLS)["tool_calls"]), F.lit(0)) > 0
    real = (F.col("role") == "assistant") & F.coalesce(F.startswith(F.ltrim("text"), F.lit("{")) & real, F.lit(False))
    messages = m.where(real | (F.col("role") == "tool")).unionByName(stand_ins(m.where(~F.coalesce(real, F.lit(False)))))
    d = link(calls_of(messages), results_of(messages), spark.createDataFrame(TOOLS, SCHEMA))
    return d.select("conv_id", "call_id", "turn", "level", "status", "result_turn", F.size("errors").cast("long").alias("n_errors"), "json")


ORACLE = """
with m as (select conv_id, turn::bigint turn, role, text from conversations where conv_id is not null),
c as (select conv_id, turn, 'a' kind, 'reply' as name, json_object('text', text, 'turn', turn)::varchar args, case when text is null then 1 else 0 end + case when conv_id % 5 = 2 then 1 else 0 end errors, case when conv_id % 5 <> 2 then 0 end lv from m where role = 'user'
union all select conv_id, turn, 'b', 'score', '{' || case when conv_id % 4 = 1 then '"extra":true,' else '' end || '"of":"$' || conv_id || ':' || turn || ':a","weight":' || case when turn % 3 = 0 then '"heavy"' else turn::varchar end || '}',
case when conv_id % 4 = 1 then 1 else 0 end + case when turn % 3 = 0 then 1 else 0 end + case when conv_id % 7 = 3 then 1 else 0 end + case when conv_id % 5 = 2 then 1 else 0 end, case when conv_id % 5 <> 2 then 1 end from m where role = 'user'
union all select conv_id, turn, 'n', 'note', json_object('text', text)::varchar, 1, 0 from m where role not in ('user', 'assistant', 'tool')),
u as (select conv_id, turn, kind, min(struct_pack(name := name, args := args, errors := errors, lv := lv)) c from c group by all),
r as (select conv_id, turn - 1 as turn, 'a' kind, turn rt, text content from m where role = 'assistant'
union all select conv_id, turn - 1, 'b', turn, length(text)::varchar from m where role = 'assistant' and conv_id % 3 <> 1
union all select conv_id, turn - 1, 'a', turn, '~ again' from m where role = 'assistant' and conv_id % 6 = 5),
f as (select conv_id, turn, kind, min(struct_pack(rt := rt, content := content)) r from r group by all),
j as (select conv_id, turn t, kind, u.c, f.r, u.conv_id is not null has from u full join f using (conv_id, turn, kind))
select conv_id, conv_id || ':' || t || ':' || kind as call_id, case when c is not null then t end as turn, c.lv::bigint as level,
case when c is null then 'orphan' when r is null then 'unanswered' else 'answered' end as status, r.rt as result_turn, case when c is null then 0 else c.errors end::bigint as n_errors,
'{"arguments":' || coalesce(c.args, 'null') || ',"content":' || coalesce(to_json(r.content)::varchar, 'null') || ',"id":' || to_json(conv_id || ':' || t || ':' || kind)::varchar || ',"name":' || coalesce('"' || c.name || '"', 'null') || '}' as json
from j
"""
