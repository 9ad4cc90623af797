"""Chat formatting: tool-call linking, by DataFrame functions alone (operator 5).

Calls and results are JSON objects in `<tool_call>...</tool_call>` and `<tool_result>...</tool_result>` marks of a message:
{"id", "name", "arguments"} and {"id", "content"}. A message whose role is tool and which has no mark is itself a result if its
text is such an object. Calls and results are hash-joined by (conversation, identifier). A call whose arguments name another
call's result as "$id" depends on it; the level of a call is one more than the greatest level it depends on, so sorting by
level orders a conversation's calls topologically. Arguments are checked against the schemas: a known name, every required
argument, no unknown argument, the stated JSON types. Each message is written as canonical JSON (keys sorted, no white space,
as the variant type writes them), with its calls in their topological order and the results linked to them.

One row a message leaves, never a whole conversation, so that a conversation of any length is spread over all tasks.

Defined cases: null text counts as empty; a null role stays null; a mark ends at its first close; call marks
that hold no JSON object, or none with an identifier, a name and JSON arguments, are listed (as `malformed` where identifier or
name lacks) and stay in the text, as do result marks without an identifier or valid JSON; the first call (by turn, then place) of an identifier is the one that results link to, later ones are `repeated`; a
result without a call is an `orphan`; a call without a result has none; calls in a cycle of references, and calls that depend on
those, have level -1 and come last; repeated rows give repeated messages; null conversations link to nothing; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.llm.common import materialise, shared_path

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
RESULT = r"(?s)<tool_result>(.*?)</tool_result>"


def default_schemas(spark: SparkSession) -> DataFrame:
    """The tools that `op5` knows: name, argument, JSON type, whether it is required."""
    return spark.sql(
        """VALUES ('search', 'query', 'string', true), ('search', 'limit', 'bigint', false), ('calculate', 'expression', 'string', true),
        ('fetch', 'url', 'string', true), ('fetch', 'headers', 'object', false) AS t(name, argument, type, required)"""
    )


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text, null where it is none."""
    return F.to_json(F.try_parse_json(text))


def _kind(value: Column) -> Column:
    """JSON type of a JSON text: object, array, string, bigint, double, boolean, null; null where it is no JSON."""
    form = F.schema_of_variant(F.try_parse_json(value))
    return F.when(form.startswith("OBJECT"), "object").when(form.startswith("ARRAY"), "array").when(form == "VOID", "null").when(form.startswith("DECIMAL"), "double").otherwise(F.lower(form))


def messages(chats: DataFrame) -> DataFrame:
    """Messages with an identity of their own, so that repeated rows stay apart."""
    return chats.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.monotonically_increasing_id())


def marked(found: DataFrame, pattern: str, bare_role: str | None) -> DataFrame:
    """One row a mark: message, conv_id, turn, place (from 0), body, and where the mark starts and stops in the text."""
    wholes, bodies = (F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (0, 1))
    parts = F.arrays_zip(F.split("text", pattern).alias("gap"), wholes.alias("whole"), bodies.alias("body"))
    spot = lambda p, at: F.struct(p["body"].alias("body"), at.alias("start"), (at + F.length(p["whole"])).alias("stop"))
    none = F.array().cast("array<struct<body:string,start:int,stop:int>>")
    step = lambda acc, p: F.when(p["whole"].isNull(), acc).otherwise(F.struct((acc["at"] + F.length(p["gap"]) + F.length(p["whole"])).alias("at"), F.concat(acc["spots"], F.array(spot(p, acc["at"] + F.length(p["gap"])))).alias("spots")))
    spots = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spots")), step)["spots"]
    if bare_role:
        bare = (F.size(bodies) == 0) & (F.col("role") == bare_role) & F.get_json_object("text", "$.id").isNotNull()
        spots = F.when(bare, F.array(F.struct(F.col("text").alias("body"), F.lit(0).alias("start"), F.length("text").alias("stop")))).otherwise(spots)
    can = found.where(F.col("text").contains("<tool_") | (F.col("role") == F.lit(bare_role or "")))
    return can.select("message", "conv_id", "turn", F.posexplode(spots).alias("place", "spot")).select("message", "conv_id", "turn", "place", "spot.*")


def without(text: Column, cuts: Column) -> Column:
    """The text without the stretches (start, stop) of `cuts`, which may overlap."""
    cut = lambda acc, c: F.struct(F.greatest(acc["at"], c["stop"]).alias("at"), F.concat(acc["kept"], F.when(c["start"] > acc["at"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"])).otherwise("")).alias("kept"))
    return F.aggregate(F.array_sort(cuts), F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")), cut, lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.length(text))))


def calls_of(found: DataFrame) -> DataFrame:
    at = lambda k: F.get_json_object("body", f"$.{k}")
    calls = marked(found, CALL, None).select("message", "conv_id", "turn", "place", "body", "start", "stop", at("id").alias("id"), at("name").alias("name"), canonical(F.coalesce(at("arguments"), F.lit("{}"))).alias("arguments"))
    # the mark leaves the text only where the call holds what it says
    return calls.withColumn("told", F.coalesce(canonical(F.col("body")).startswith("{"), F.lit(False)) & F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("arguments").isNotNull())


def results_of(found: DataFrame) -> DataFrame:
    return marked(found, RESULT, "tool").select("message", "conv_id", "turn", "place", "body", "start", "stop", F.get_json_object("body", "$.id").alias("id"), canonical("body").alias("result"))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `problem`: null, or the least of what is wrong with a call's name and arguments."""
    given = calls.where("arguments like '{%'").select("call", "name", F.explode(F.from_json("arguments", "map<string,variant>")).alias("argument", "value"))
    given = given.select("call", "name", "argument", _kind(F.to_json("value")).alias("kind"))
    names = schemas.select("name").distinct().withColumn("known", F.lit(True))
    typed = given.join(names, "name").join(schemas, ["name", "argument"], "left").select("call", F.when(F.col("type").isNull(), F.concat(F.lit("unknown argument "), "argument")).when((F.col("type") != F.col("kind")) & ~((F.col("type") == "double") & (F.col("kind") == "bigint")), F.concat(F.lit("type of argument "), "argument")).alias("problem"))
    needed = calls.select("call", "name").join(schemas.where("required").select("name", "argument"), "name")
    missing = needed.join(given.select("call", "argument"), ["call", "argument"], "left_anti").select("call", F.concat(F.lit("missing argument "), "argument").alias("problem"))
    wrong = typed.where("problem is not null").unionByName(missing).groupBy("call").agg(F.min("problem").alias("wrong"))
    return calls.join(names, "name", "left").join(wrong, "call", "left").withColumn(
        "problem",
        F.when(F.col("id").isNull() | F.col("name").isNull(), "malformed").when(F.col("arguments").isNull() | ~F.col("arguments").startswith("{"), "arguments are no object").when(F.col("known").isNull(), "unknown tool").otherwise(F.col("wrong")),
    ).drop("known", "wrong")


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """(call, level): 0 without references, else one more than the greatest level referred to; -1 in or behind a cycle.

    An open call has references to open calls (`needs`, `steps` away) and a `floor`, the level that its settled references give. Each
    round settles the calls without open references, and a reference to a call with just one open reference skips to that one, so a
    chain halves with each round. Rounds go on until none settles a call: what is open then is in or behind a cycle.
    """
    firsts = calls.where("first").select("conv_id", F.col("id").alias("ref"), F.col("call").alias("needs"))
    refs = calls.select("call", "conv_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$([^"]+)"'), F.lit(1)))).alias("ref")).join(firsts, ["conv_id", "ref"]).select("call", "needs")
    open_ = materialise(spark, refs.withColumn("steps", F.lit(1).cast("long")).withColumn("floor", F.lit(0).cast("long")), "references")
    ready = calls.select("call").join(open_.select("call").distinct(), "call", "left_anti").withColumn("level", F.lit(0).cast("long"))
    path, turn, own = shared_path(spark, "levels"), 0, Window.partitionBy("call")
    while True:
        ready.write.parquet(f"{path}/round={turn}")
        ready = spark.read.schema("call long, level long").parquet(f"{path}/round={turn}")
        if open_.isEmpty() or ready.isEmpty():
            break
        met = open_.join(ready.withColumnRenamed("call", "needs"), "needs", "left")
        met = met.select("call", "needs", "steps", F.max(F.greatest("floor", F.col("level") + F.col("steps"))).over(own).alias("floor"), F.col("level").isNull().alias("is_open"), F.count_if(F.col("level").isNull()).over(own).alias("n_open"))
        met = materialise(spark, met, "references")
        ready = met.where("n_open = 0").groupBy("call").agg(F.max("floor").alias("level"))
        skips = met.where("is_open and n_open = 1").select(F.col("call").alias("needs"), F.col("needs").alias("via"), F.col("steps").alias("more"), F.col("floor").alias("via_floor"))
        # round a cycle the steps would double without end; no chain is as long as the bound
        skipped = met.where("is_open").join(skips, "needs", "left").select(
            "call", F.coalesce("via", "needs").alias("needs"), F.least(F.col("steps") + F.coalesce("more", F.lit(0)), F.lit(1 << 60)).alias("steps"), F.greatest("floor", F.when(F.col("via").isNotNull(), F.least(F.col("via_floor") + F.col("steps"), F.lit(1 << 60)))).alias("floor")
        )
        open_ = materialise(spark, skipped.groupBy("call", "needs").agg(F.max("steps").alias("steps"), F.max("floor").alias("floor")), "references")
        turn += 1
    done = spark.read.schema("call long, level long").parquet(*(f"{path}/round={k}" for k in range(turn + 1)))
    return done.unionByName(open_.select("call").distinct().withColumn("level", F.lit(-1).cast("long"))).withColumn("level", F.col("level").cast("int"))


def link(spark: SparkSession, chats: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid, n_orphans, message_json of every message."""
    schemas = default_schemas(spark) if schemas is None else schemas
    found = materialise(spark, messages(chats), "messages")
    calls = calls_of(found).withColumn("call", F.monotonically_increasing_id())
    calls = materialise(spark, calls, "calls")
    firsts = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min_by("call", F.struct("turn", "place", "call")).alias("first_call"))
    calls = materialise(spark, calls.join(firsts, ["conv_id", "id"], "left").withColumn("first", F.col("call") == F.col("first_call")).drop("first_call"), "calls")
    results = results_of(found)
    linked = results.where("id is not null and result is not null").join(calls.where("first").select("conv_id", "id", "call"), ["conv_id", "id"], "left")
    linked = materialise(spark, linked.withColumn("result_key", F.struct("turn", "place", "message")), "results")
    answers = linked.where("call is not null").groupBy("call").agg(F.min_by("result", "result_key").alias("result"), F.count("*").alias("answers"))
    facts = validate(calls, schemas).join(levels(spark, calls), "call", "left").join(answers, "call", "left").withColumn("problem", F.when(~F.coalesce("first", F.lit(True)), F.coalesce("problem", F.lit("repeated"))).otherwise(F.col("problem")))
    piece = F.struct(
        F.when(F.col("level") < 0, 2**31 - 1).otherwise(F.col("level")).alias("order"), F.col("place"), F.col("id"), F.col("name"), F.col("arguments"), F.col("result"), F.col("problem"),
    )
    by_message = facts.groupBy("message").agg(F.array_sort(F.collect_list(piece)).alias("calls"), F.count("*").alias("n_calls"), F.count("result").alias("n_linked"), F.count("problem").alias("n_invalid"), F.collect_list(F.when(F.col("told"), F.struct("start", "stop"))).alias("call_cuts"))
    orphans = linked.groupBy("message").agg(F.count(F.when(F.col("call").isNull(), 1)).alias("n_orphans"), F.array_sort(F.collect_list(F.struct("place", "id", "result", F.col("call").isNull().alias("orphan")))).alias("results"), F.collect_list(F.struct("start", "stop")).alias("result_cuts"))
    # only messages that can hold a mark meet their calls and results; all others stay where they are
    can = F.coalesce(F.col("text").contains("<tool_") | (F.col("role") == "tool"), F.lit(False))
    joined = found.where(can).join(by_message, "message", "left").join(orphans, "message", "left").unionByName(found.where(~can), allowMissingColumns=True)
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    string = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(quoted(c), r"(?s)^\[(.*)\]$", "$1"))
    none = F.array().cast("array<string>")
    call_text = F.coalesce(F.transform("calls", lambda x: F.concat(F.lit('{"arguments":'), F.coalesce(x["arguments"], F.lit("null")), F.lit(',"id":'), string(x["id"]), F.lit(',"level":'), F.when(x["order"] == 2**31 - 1, "-1").otherwise(x["order"].cast("string")), F.lit(',"name":'), string(x["name"]), F.lit(',"problem":'), string(x["problem"]), F.lit(',"result":'), F.coalesce(x["result"], F.lit("null")), F.lit("}"))), none)
    result_text = F.coalesce(F.transform("results", lambda x: F.concat(F.lit('{"id":'), string(x["id"]), F.lit(',"orphan":'), x["orphan"].cast("string"), F.lit(',"result":'), x["result"], F.lit("}"))), none)
    no_cuts = F.array().cast("array<struct<start:int,stop:int>>")
    cuts = F.concat(F.coalesce("call_cuts", no_cuts), F.coalesce("result_cuts", no_cuts))
    content = F.when(F.size(cuts) > 0, F.trim(without(F.col("text"), cuts))).otherwise(F.col("text"))
    message = F.concat(F.lit('{"calls":['), F.concat_ws(",", call_text), F.lit('],"content":'), string(content), F.lit(',"results":['), F.concat_ws(",", result_text), F.lit('],"role":'), string(F.col("role")), F.lit("}"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", "turn", "role", zero("n_calls"), zero("n_linked"), zero("n_invalid"), zero("n_orphans"), message.alias("message_json"))
