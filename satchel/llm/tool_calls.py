"""Tool calls of conversations: linked with their results, ordered by their references, validated, in canonical JSON.

Everything here is DataFrame and SQL functions. Calls and results meet in a shuffled hash join on conversation and call
identifier, so that a conversation of any length is spread over the tasks. A call may name earlier calls in its
arguments (a string ``$identifier``); its depth is one more than that of the deepest call it names. Chains of calls with
one reference are shortened by pointer doubling, so that rounds grow with the logarithm of a chain's length; what is left,
calls with several references, is settled in rounds of their nesting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.store import materialize

#: Type names of a schema and the variant types that satisfy them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
KEY = ["conv_id", "call_id"]


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written in messages (conv_id, turn, role, text).

    An assistant's text that is a JSON object with ``tool_calls`` (a list of id, name, arguments) makes calls; the text of
    a ``tool`` message with ``tool_call_id`` and ``content`` is a result. Other texts, also broken JSON, are neither.
    """
    shape = "tool_calls array<struct<id string, name string, arguments variant>>, tool_call_id string, content string"
    read = messages.select("conv_id", "turn", "role", F.from_json(F.when(F.try_parse_json("text").isNotNull(), F.col("text")), shape).alias("m"))
    calls = read.where("role = 'assistant'").select("conv_id", "turn", F.inline("m.tool_calls")).select("conv_id", "turn", F.col("id").alias("call_id"), "name", F.to_json("arguments").alias("arguments"))
    results = read.where("role = 'tool' and m.tool_call_id is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls.where("call_id is not null"), results


def _references(calls: DataFrame) -> DataFrame:
    """Pairs (conv_id, call_id, dep) of calls and the existing calls that they name; no call names itself."""
    texts = F.filter(F.map_values(F.from_json("arguments", "map<string,string>")), lambda v: v.startswith("$"))
    named = calls.select(*KEY, F.explode(F.array_distinct(F.transform(texts, lambda v: F.substring(v, 2, 1 << 30)))).alias("dep"))
    there = calls.select("conv_id", F.col("call_id").alias("dep"))
    return named.join(there, ["conv_id", "dep"], "left_semi").select(*KEY, "dep")


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and ``depth`` (from 1; null in a cycle or behind one). Identifiers are unique here."""
    links = materialize(_references(calls), "references")
    counts = links.groupBy(*KEY).agg(F.count("*").alias("deps"), F.first("dep").alias("dep"))
    nodes = calls.select(*KEY).join(counts, KEY, "left").select(*KEY, F.coalesce("deps", F.lit(0)).alias("deps"), "dep")
    # pointers of calls with one reference lead to the first call up the chain that has none or several
    nodes = materialize(nodes.select(*KEY, "deps", F.when(F.col("deps") == 1, F.col("dep")).otherwise(F.col("call_id")).alias("head"), F.when(F.col("deps") == 1, 1).otherwise(0).cast("long").alias("steps")), "nodes")
    longest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    ends = nodes.where("deps != 1").select("conv_id", F.col("call_id").alias("end"), F.lit(True).alias("settled"))
    chains, reach = nodes.where("deps = 1").drop("deps"), 1
    settled = []
    while reach <= 2 * longest:
        state = materialize(chains.join(ends, (chains["conv_id"] == ends["conv_id"]) & (chains["head"] == ends["end"]), "left").select(chains["conv_id"], "call_id", "head", "steps", F.coalesce("settled", F.lit(False)).alias("settled")), "chains")
        done, open_ = state.where("settled").drop("settled"), state.where("not settled").drop("settled")
        settled.append(done)
        if open_.isEmpty():
            break
        # an open call's head has one reference itself: step on by what that head, open or settled, has covered
        ahead = state.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        for earlier in settled[:-1]:
            ahead = ahead.unionByName(earlier.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more")))
        chains = open_.join(ahead, ["conv_id", "head"]).select(*KEY, F.col("next").alias("head"), (F.col("steps") + F.col("more")).alias("steps"))
        reach *= 2
    heads = nodes.where("deps != 1").select(*KEY, "head", "steps")
    for part in settled:
        heads = heads.unionByName(part)
    heads = materialize(heads, "heads")
    known = materialize(nodes.where("deps = 0").select(*KEY, F.lit(1).cast("long").alias("depth")), "known")
    several = nodes.where("deps > 1").select(*KEY, "deps")
    if not several.isEmpty():
        of_dep = heads.select("conv_id", F.col("call_id").alias("dep"), "head", "steps")
        needs = materialize(links.join(several, KEY).join(of_dep, ["conv_id", "dep"], "left").select(*KEY, "deps", "head", "steps"), "needs")
        while True:
            at = known.select("conv_id", F.col("call_id").alias("head"), "depth")
            ready = needs.join(at, ["conv_id", "head"]).groupBy(*KEY, "deps").agg(F.count("*").alias("n"), (F.max(F.col("depth") + F.col("steps")) + 1).alias("depth")).where("n = deps")
            new = materialize(ready.select(*KEY, "depth").join(known.select(*KEY), KEY, "left_anti"), "ready")
            if new.isEmpty():
                break
            known = known.unionByName(new)
    at = known.select("conv_id", F.col("call_id").alias("head"), "depth")
    reached = heads.join(at, ["conv_id", "head"]).select(*KEY, (F.col("depth") + F.col("steps")).alias("depth"))
    return calls.select(*KEY).join(reached, KEY, "left")


def _problems(arguments, fields):
    """Names of schema fields that are missing or of another type, and of arguments that no field allows, in order."""
    kinds = F.transform_values(F.from_json(arguments, "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    kinds = F.coalesce(kinds, F.create_map().cast("map<string,string>"))
    pattern = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))

    def wrong(f):
        kind = F.try_element_at(kinds, f["field"])
        absent = kind.isNull() | (kind == "VOID")
        return F.when(absent, f["required"]).otherwise(~F.coalesce(F.regexp_like(kind, F.concat(F.lit("^("), F.try_element_at(pattern, f["type"]), F.lit(")$"))), F.lit(False)))

    bad = F.transform(F.filter(fields, wrong), lambda f: f["field"])
    unknown = F.filter(F.map_keys(kinds), lambda k: ~F.exists(fields, lambda f: f["field"] == k))
    return F.array_sort(F.array_distinct(F.concat(bad, unknown)))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: conv_id, call_id, turn, name, depth, n_results, valid, problems, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text). results: conv_id, turn, call_id, content. schemas: name,
    field, type (of TYPES), required. Of calls of one identifier in a conversation the earliest counts, of results too
    (n_results counts all). A call is valid if its arguments are a JSON object, its tool has a schema, and no argument is
    missing, unknown or of another type. Order calls of a conversation by depth, turn and identifier: none then comes
    before a call it names. json has keys in order, no white space and no null members. Calls with a null conversation or
    identifier are dropped, results without a call too; repeated rows count once as calls and each as results. Tables
    without rows give no rows.
    """
    calls = calls.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", "name", F.to_json(F.try_parse_json("arguments")).alias("arguments"))).alias("c")).select(*KEY, "c.*")
    calls = materialize(calls, "calls")
    first = results.groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")).select(*KEY, F.col("r.content").alias("result"), "n_results")
    fields = schemas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    linked = calls.hint("shuffle_hash").join(first, KEY, "left").join(depths(calls), KEY).join(fields, "name", "left")
    problems = F.when(F.col("fields").isNull(), F.array(F.lit("schema"))).when(F.from_json("arguments", "map<string,variant>").isNull(), F.array(F.lit("arguments"))).otherwise(_problems(F.col("arguments"), F.col("fields")))
    linked = linked.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0).withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))
    json = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "depth", F.col("call_id").alias("id"), "name", "result", "valid"))
    return linked.select(*KEY, "turn", "name", "depth", "n_results", "valid", "problems", json.alias("json"))
