"""Tool-call linking for chat formatting, on DataFrame functions alone.

Calls and results are joined by (conversation, identifier). Calls are put in a
topological order of what they depend on: a conversation whose dependencies all
point backwards is ordered by position at once; calls of the others are ordered
by their level (the longest chain of dependencies below them), then by position,
and those on or behind a cycle come last, marked. Chains of calls with one
dependency each are followed by pointer doubling, so rounds grow with the
logarithm of a chain's length; only calls with several dependencies are peeled,
one round for each level of those.
Arguments are checked against the tool's schema (a subset of JSON Schema) and
every call is written as canonical JSON: keys sorted, no blanks.

Results for odd input: arguments that are null, no JSON or hold a key twice are
invalid and written as null; a call or result without identifier links with
nothing; of calls with one identifier the earliest counts (ties: smallest name,
then arguments) and the others are ``repeated``; of several results the earliest
counts and the others are dropped as repeats (``n_results`` tells how many there
were); a result whose call is missing returns as a row of its own, ``orphan``;
a call to a tool without schema is invalid (``unknown tool``); dependencies that
name no call are counted in ``n_missing`` and order nothing; a null position
counts as the earliest; other columns are not read, whatever their names; empty
tables give an empty table.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.prefix import prefix_sums
from quadrille.storage import materialize

#: Most tools a registry may hold: the checks of all tools become one expression.
MAX_TOOLS = 500
#: Keywords of a schema that are checked, and those that say nothing about validity; others are refused.
CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern",
    "minItems", "maxItems", "items", "properties", "required", "additionalProperties",
}
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated"}


def quoted(c: Column) -> Column:
    """A string as a JSON string; null as null."""
    s = F.to_json(F.array(c))
    return F.substring(s, F.lit(2), F.length(s) - 2)


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text: sorted keys, no blanks; null where it is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def _kind(v: Column) -> Column:
    """JSON type of a variant; null for an absent value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(s == "VOID", "null")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
    )


def _is_kind(v: Column, kind: str) -> Column:
    if kind == "number":
        return _kind(v).isin("number", "integer")
    if kind == "integer":
        d = F.try_variant_get(v, "$", "double")
        return (_kind(v) == "integer") | ((_kind(v) == "number") & (d == F.floor(d)))
    return _kind(v) == kind


def _steps(path: tuple[str, ...]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in path)


def schema_errors(v: Column, schema: dict, path: tuple[str, ...] = ()) -> list[Column]:
    """One column for each rule of ``schema``: the rule's message where ``v`` (a variant) breaks it, else null.

    A schema with a keyword that is neither in CHECKED nor in NOTES is refused,
    and so is ``additionalProperties`` other than true or false.
    """
    if unknown := set(schema) - CHECKED - NOTES:
        raise ValueError(f"schema keywords that are not supported: {sorted(unknown)}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties must be true or false")
    here = v if not path else F.try_variant_get(v, _steps(path), "variant")
    name = ".".join(path) or "arguments"
    out: list[Column] = []

    def rule(broken: Column, text: str) -> None:
        out.append(F.when(F.coalesce(broken & here.isNotNull(), F.lit(False)), F.lit(f"{name}: {text}")))

    as_string, as_number = F.try_variant_get(here, "$", "string"), F.try_variant_get(here, "$", "double")
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        rule(~reduce(lambda a, b: a | b, [_is_kind(here, k) for k in kinds]), "type")
    is_text, is_number = _kind(here) == "string", _kind(here).isin("integer", "number")
    if "enum" in schema:
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in schema["enum"]]
        rule(~F.to_json(here).isin(*allowed), "enum")
    if "const" in schema:
        rule(F.to_json(here) != json.dumps(schema["const"], ensure_ascii=False, separators=(",", ":"), sort_keys=True), "const")
    if "exclusiveMinimum" in schema:
        rule(is_number & (as_number <= F.lit(float(schema["exclusiveMinimum"]))), "exclusiveMinimum")
    if "exclusiveMaximum" in schema:
        rule(is_number & (as_number >= F.lit(float(schema["exclusiveMaximum"]))), "exclusiveMaximum")
    if "minimum" in schema:
        rule(is_number & (as_number < F.lit(float(schema["minimum"]))), "minimum")
    if "maximum" in schema:
        rule(is_number & (as_number > F.lit(float(schema["maximum"]))), "maximum")
    if "minLength" in schema:
        rule(is_text & (F.length(as_string) < schema["minLength"]), "minLength")
    if "maxLength" in schema:
        rule(is_text & (F.length(as_string) > schema["maxLength"]), "maxLength")
    if "pattern" in schema:
        rule(is_text & ~as_string.rlike(schema["pattern"]), "pattern")
    items = F.try_variant_get(here, "$", "array<variant>")
    is_list = _kind(here) == "array"
    if "minItems" in schema:
        rule(is_list & (F.size(items) < schema["minItems"]), "minItems")
    if "maxItems" in schema:
        rule(is_list & (F.size(items) > schema["maxItems"]), "maxItems")
    if schema.get("items"):
        broken = lambda x: reduce(lambda a, b: a | b, [e.isNotNull() for e in schema_errors(x, schema["items"])], F.lit(False))
        rule(is_list & F.exists(items, broken), "items")
    is_object = _kind(here) == "object"
    for p in schema.get("required", []):
        rule(is_object & F.try_variant_get(v, _steps((*path, p)), "variant").isNull(), f"required {p}")
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>")
        keys = F.json_object_keys(F.to_json(here))
        rule(is_object & (F.size(F.array_except(keys, known)) > 0), "additionalProperties")
    for p, inner in schema.get("properties", {}).items():
        out += schema_errors(v, inner, (*path, p))
    return out


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Array of broken rules; empty for valid arguments."""
    if len(schemas) > MAX_TOOLS:
        raise ValueError(f"{len(schemas)} tools; a registry holds {MAX_TOOLS} at most")
    v = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    found = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        rules = schema_errors(v, schema)
        found = F.when(name == tool, F.array_compact(F.array(*rules)) if rules else none).otherwise(found)
    return F.when(v.isNull(), F.array(F.lit("malformed arguments"))).otherwise(found)


def _follow(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, anchor, distance) for calls with one dependency each (conv_id, call_id, after_id).

    The anchor is the first call of the chain that is not among them; null on or
    behind a cycle. Pointers double each round, so after as many rounds as the
    number of calls has binary digits only cycles are left.
    """
    keys = ["conv_id", "call_id"]
    inner = single.select("conv_id", F.col("call_id").alias("after_id"), F.lit(False).alias("ended"))
    now = single.join(inner, ["conv_id", "after_id"], "left").select(
        *keys, F.col("after_id").alias("anchor"), F.lit(1).cast("long").alias("distance"), F.coalesce("ended", F.lit(True)).alias("ended")
    )
    now = materialize(now, "chains")
    most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        there = now.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("distance").alias("more"), F.col("ended").alias("end"))
        moved = now.where("not ended").join(there, ["conv_id", "anchor"]).select(*keys, F.col("next").alias("anchor"), (F.col("distance") + F.col("more")).alias("distance"), F.col("end").alias("ended"))
        now = materialize(now.where("ended").unionByName(moved), "chains")
        if now.where("not ended").isEmpty():
            break
    return now.select(*keys, F.when(F.col("ended"), F.col("anchor")).alias("anchor"), "distance")


def _peel(links: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for calls with several dependencies; calls on or behind a cycle are left out.

    ``links``: conv_id, call_id, anchor (null: cyclic), weight, root (the anchor depends on nothing).
    """
    keys = ["conv_id", "call_id"]
    left = materialize(links.select(*keys, "anchor", "weight", F.when(F.col("root"), F.col("weight")).alias("base")), "joins")
    done: list[DataFrame] = []
    while True:
        state = left.groupBy(*keys).agg(F.max("base").alias("level"), F.count_if(F.col("base").isNull()).alias("open"))
        ready = materialize(state.where("open = 0").select(*keys, "level"), "level")
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, done) if done else ready
        done.append(ready)
        if len(done) > 8:
            done = [materialize(reduce(DataFrame.unionByName, done), "levels")]
        settled = ready.select("conv_id", F.col("call_id").alias("anchor"), "level")
        rest = left.join(ready.select(*keys), keys, "left_anti").join(settled, ["conv_id", "anchor"], "left")
        left = materialize(rest.select(*keys, "anchor", "weight", F.coalesce("base", F.col("level") + F.col("weight")).alias("base")), "joins")


def topological_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) for calls of conversations in which some dependency points forward.

    ``calls`` has conv_id, call_id, position; ``edges`` has conv_id, call_id,
    after_id, late. The level is the length of the longest chain of dependencies,
    null for calls on or behind a cycle.
    """
    keys = ["conv_id", "call_id"]
    late = edges.where("late").select("conv_id").distinct()
    nodes = materialize(calls.join(late, "conv_id", "left_semi").select(*keys), "unordered")
    if nodes.isEmpty():
        return nodes.withColumn("level", F.lit(0).cast("long")).withColumn("cyclic", F.lit(False))
    links = edges.join(late, "conv_id", "left_semi").select(*keys, "after_id")
    needs = links.groupBy(*keys).agg(F.count("*").alias("needs"), F.min("after_id").alias("after_id"))
    needs = materialize(nodes.join(needs, keys, "left"), "needs")
    chains = _follow(needs.where("needs = 1").select(*keys, "after_id"))
    several = links.join(needs.where("needs > 1").select(*keys), keys, "left_semi")
    over = chains.select("conv_id", F.col("call_id").alias("after_id"), "anchor", "distance", F.lit(True).alias("chained"))
    roots = needs.where("needs is null").select("conv_id", F.col("call_id").alias("anchor"), F.lit(True).alias("root"))
    joins = several.join(over, ["conv_id", "after_id"], "left").select(
        *keys,
        F.when(F.col("chained"), F.col("anchor")).otherwise(F.col("after_id")).alias("anchor"),
        (F.coalesce("distance", F.lit(0)) + 1).cast("long").alias("weight"),
    )
    tops = _peel(joins.join(roots, ["conv_id", "anchor"], "left").withColumn("root", F.coalesce("root", F.lit(False))))
    base = tops.unionByName(roots.select("conv_id", F.col("anchor").alias("call_id"), F.lit(0).cast("long").alias("level")))
    chained = chains.join(base.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"], "left").select(
        *keys, (F.col("level") + F.col("distance")).alias("level")
    )
    found = nodes.join(base.unionByName(chained), keys, "left")
    return found.withColumn("cyclic", F.col("level").isNull())


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], dependencies: DataFrame | None = None) -> DataFrame:
    """Link, order, validate and serialise.

    ``calls``: conv_id, call_id, position, name, arguments (JSON text).
    ``results``: conv_id, call_id, position, content. ``dependencies``: conv_id,
    call_id, after_id. Returns conv_id, position, kind (call or result), call_id,
    status (linked, unanswered, repeated, unidentified, orphan), step (place in
    its conversation's order, from 0), cyclic, n_results, n_missing, valid,
    errors, json.
    """
    keys = ["conv_id", "call_id"]
    c = calls.select("conv_id", "call_id", F.col("position").cast("long").alias("position"), "name", "arguments")
    r = results.select("conv_id", "call_id", F.col("position").cast("long").alias("position"), "content")
    by_key = c.where("conv_id is not null and call_id is not null").groupBy(*keys).agg(
        F.min(F.struct("position", "name", "arguments")).alias("first"), F.count("*").alias("n_calls")
    )
    answers = r.where("conv_id is not null and call_id is not null").groupBy(*keys).agg(
        F.min(F.struct("position", "content")).alias("answer"), F.count("*").alias("n_results")
    )
    linked = by_key.join(answers, keys, "full")
    first = materialize(linked.where("first is not null").select(*keys, "first.*", "answer", "n_results", "n_calls"), "calls")
    orphans = r.join(by_key.select(*keys), keys, "left_anti").select(*keys, "position", "content")

    ids = first.select(*keys, "position")
    if dependencies is None:
        spark = calls.sparkSession
        dependencies = spark.createDataFrame([], "conv_id long, call_id string, after_id string")
    parents = ids.select("conv_id", F.col("call_id").alias("after_id"), F.col("position").alias("after_position"), F.lit(True).alias("found"))
    asked = dependencies.select("conv_id", "call_id", "after_id").where("after_id is not null").distinct()
    edges = (
        asked.join(ids, keys)
        .join(parents, ["conv_id", "after_id"], "left")
        .withColumn("missing", F.col("found").isNull())
        # in the order of positions a null one is the first, and equal ones follow the identifier
        .withColumn("late", F.struct("after_position", "after_id") >= F.struct("position", "call_id"))
    )
    edges = materialize(edges.select(*keys, "after_id", "missing", "late"), "dependencies")
    known = edges.where("not missing")
    levels = topological_levels(ids, known)
    n_missing = edges.where("missing").groupBy(*keys).agg(F.count("*").alias("n_missing"))
    ordered = ids.join(levels, keys, "left").withColumn("__last", F.coalesce(F.col("cyclic").cast("int"), F.lit(0)))
    ordered = ordered.withColumn("__level", F.coalesce("level", F.lit(0)))
    steps = prefix_sums(ordered, ["__last", "__level", "position", "call_id"], F.lit(1), group="conv_id", out="step")
    steps = steps.select(*keys, "step", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))

    full = first.join(steps, keys).join(n_missing, keys, "left")
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    # the keys in sorted order
    body = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(canonical_json(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'),
        quoted(F.col("call_id")),
        F.lit(',"name":'),
        quoted(F.col("name")),
        F.lit(',"result":'),
        quoted(F.col("answer.content")),
        F.lit("}"),
    )
    rows = full.select(
        "conv_id",
        "position",
        F.lit("call").alias("kind"),
        "call_id",
        F.when(F.col("answer").isNull(), "unanswered").otherwise("linked").alias("status"),
        "step",
        "cyclic",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
        errors.alias("__errors"),
        body.alias("json"),
    )
    rows = rows.withColumn("valid", F.size("__errors") == 0).withColumn("errors", F.array_join("__errors", "; ")).drop("__errors")
    return rows.unionByName(_loose_calls(c, first)).unionByName(_loose_results(orphans)).select(
        "conv_id", "position", "kind", "call_id", "status", "step", "cyclic", "n_results", "n_missing", "valid", "errors", "json"
    )


def _loose(rows: DataFrame, kind: str, status: Column, body: Column) -> DataFrame:
    return rows.select(
        "conv_id",
        "position",
        F.lit(kind).alias("kind"),
        "call_id",
        status.alias("status"),
        F.lit(None).cast("long").alias("step"),
        F.lit(False).alias("cyclic"),
        F.lit(0).cast("long").alias("n_results"),
        F.lit(0).cast("long").alias("n_missing"),
        F.lit(False).alias("valid"),
        F.lit("").alias("errors"),
        body.alias("json"),
    )


def _loose_calls(calls: DataFrame, first: DataFrame) -> DataFrame:
    """Calls without identifier, and those that repeat one."""
    nameless = calls.where("conv_id is null or call_id is null")
    several = first.where("n_calls > 1").select("conv_id", "call_id", "n_calls", F.struct("position", "name", "arguments").alias("first"))
    own = F.struct("position", "name", "arguments")
    # copies of the earliest call beyond one are counted, the later ones returned one by one
    repeats = calls.join(several, ["conv_id", "call_id"])
    same = repeats.where(own.eqNullSafe(F.col("first"))).groupBy("conv_id", "call_id", "position", "name", "arguments").agg((F.count("*") - 1).alias("n"))
    copies = same.where("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    later = repeats.where(~own.eqNullSafe(F.col("first"))).select(*calls.columns)
    rest = nameless.unionByName(later).unionByName(copies.select(*calls.columns))
    status = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unidentified").otherwise("repeated")
    return _loose(rest, "call", status, canonical_json(F.col("arguments")))


def _loose_results(orphans: DataFrame) -> DataFrame:
    status = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unidentified").otherwise("orphan")
    return _loose(orphans, "result", status, quoted(F.col("content")))


def from_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, dependencies) of explicit tool traffic in a chat.

    An assistant's text {"tool_calls": [{"id", "name", "arguments", "after"}]}
    holds calls, with arguments an object or a string of JSON and ``after`` an
    optional list of identifiers; a tool's text {"tool_call_id", "content"} is a
    result. Other texts are no tool traffic.
    """
    m = messages.select(
        messages[conv_col].alias("conv_id"), messages[turn_col].cast("long").alias("turn"), messages[role_col].alias("role"), F.try_parse_json(messages[text_col]).alias("v")
    )
    listed = F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>"))
    call = m.where("role = 'assistant'").select("conv_id", "turn", listed.alias("i", "c"))
    text = F.try_variant_get("c", "$.arguments", "variant")
    calls = call.select(
        "conv_id",
        F.try_variant_get("c", "$.id", "string").alias("call_id"),
        F.col("turn").alias("position"),
        F.try_variant_get("c", "$.name", "string").alias("name"),
        F.when(F.schema_of_variant(text) == "STRING", F.try_variant_get(text, "$", "string")).otherwise(F.to_json(text)).alias("arguments"),
        F.try_variant_get("c", "$.after", "array<string>").alias("after"),
    )
    results = m.where("role = 'tool'").select(
        "conv_id",
        F.try_variant_get("v", "$.tool_call_id", "string").alias("call_id"),
        F.col("turn").alias("position"),
        F.try_variant_get("v", "$.content", "string").alias("content"),
    )
    dependencies = calls.select("conv_id", "call_id", F.explode("after").alias("after_id"))
    return calls.drop("after"), results, dependencies


#: Tools that the turns of a plain conversation are read as.
SCHEMAS = {
    tool: {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
    for tool in ("ask", "configure")
}


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, dependencies) that plain turns stand for.

    A user's turn is a call of ``ask`` and a system's one of ``configure``, with
    identifier conversation:turn; any other turn is the result of the turn
    before. Of four calls, told apart by the length of their text modulo 4, one
    depends on the next call (the turn after if that is a call, else the one
    after that), two on the call before likewise, and one on nothing; so
    dependencies point both ways, and a call and the next may wait for each
    other. Rows without conversation or turn have no identifier.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    is_call = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    calls = m.where(is_call).select(
        "conv_id",
        ident(0).alias("call_id"),
        F.col("turn").alias("position"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"),
    )
    results = m.where(~is_call).select("conv_id", ident(1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    side = F.element_at(F.array(F.lit(1), F.lit(-1), F.lit(None).cast("int"), F.lit(-1)), (F.length("text") % 4 + 1).cast("int"))
    near = m.groupBy("conv_id", F.col("turn").alias("near")).agg(F.max(is_call).alias("near_call"))
    asked = m.where(is_call).withColumn("side", side).withColumn("near", F.col("turn") + F.col("side")).join(near, ["conv_id", "near"])
    after = F.when(F.col("near_call"), F.col("near")).otherwise(F.col("near") + F.col("side"))
    dependencies = asked.select("conv_id", ident(0).alias("call_id"), F.concat(F.col("conv_id").cast("string"), F.lit(":"), after.cast("string")).alias("after_id"))
    return calls, results, dependencies


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, dependencies = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_tool_calls(calls, results, SCHEMAS, dependencies).withColumnRenamed("position", "turn")


ORACLE_SQL = r"""
with recursive m as (select conv_id, turn, role, text, role in ('user', 'system') as is_call,
             conv_id || ':' || turn as own, conv_id || ':' || (turn - 1) as answers from conversations),
calls as (select conv_id, turn, own as call_id, case role when 'user' then 'ask' else 'configure' end as name, text,
            case length(text) % 4 when 0 then 1 when 2 then null else -1 end as side from m where is_call),
results as (select conv_id, answers as call_id, turn, text,
              count(*) over (partition by conv_id, answers) as n_results,
              row_number() over (partition by conv_id, answers order by turn) as k from m where not is_call),
asked as (select c.conv_id, c.call_id, c.turn, c.turn + c.side + case when b.is_call then 0 else c.side end as after_turn
         from calls c join m b on b.conv_id = c.conv_id and b.turn = c.turn + c.side),
needs as (select a.*, c.call_id is null as missing from asked a left join calls c on c.conv_id = a.conv_id and c.turn = a.after_turn),
-- each call waits for one other at most: walk from it until nothing is waited for, or for more steps than there are calls
most as (select conv_id, count(*) as n from calls group by conv_id),
walk(conv_id, start, here, steps) as (select conv_id, turn, turn, 0 from calls
  union all select w.conv_id, w.start, n.after_turn, w.steps + 1 from walk w
    join needs n on n.conv_id = w.conv_id and n.turn = w.here and not n.missing join most on most.conv_id = w.conv_id where w.steps <= most.n),
levels as (select w.conv_id, w.start as turn, max(w.steps) as level, max(w.steps) > any_value(most.n) as cyclic from walk w join most using (conv_id) group by all),
late as (select distinct conv_id from needs where not missing and after_turn >= turn),
ordered as (select c.*, l.cyclic, case when l.cyclic or t.conv_id is null then 0 else l.level end as level
  from calls c join levels l on l.conv_id = c.conv_id and l.turn = c.turn left join late t on t.conv_id = c.conv_id),
stepped as (select *, row_number() over (partition by conv_id order by cyclic, level, turn) - 1 as step from ordered),
missing as (select call_id, count(*) as n from needs where missing group by 1)
select c.conv_id, c.turn, 'call' as kind, c.call_id, case when r.call_id is null then 'unanswered' else 'linked' end as status,
  c.step, c.cyclic, coalesce(r.n_results, 0) as n_results, coalesce(x.n, 0) as n_missing,
  length(c.text) between 1 and 400 and c.turn >= 0 as valid,
  concat_ws('; ', case when length(c.text) < 1 then 'text: minLength' end, case when length(c.text) > 400 then 'text: maxLength' end,
    case when c.turn < 0 then 'turn: minimum' end) as errors,
  '{"arguments":{"text":' || to_json(c.text)::varchar || ',"turn":' || c.turn || '},"id":' || to_json(c.call_id)::varchar ||
    ',"name":' || to_json(c.name)::varchar || ',"result":' || coalesce(to_json(r.text)::varchar, 'null') || '}' as json
from stepped c left join results r on r.call_id = c.call_id and r.k = 1 left join missing x on x.call_id = c.call_id
union all
select r.conv_id, r.turn, 'result', r.call_id, 'orphan', null, false, 0, 0, false, '', to_json(r.text)::varchar
from results r left join calls c on c.call_id = r.call_id where c.call_id is null
"""
