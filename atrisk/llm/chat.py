"""Tool-call linking: calls meet their results, in order, with checked canonical arguments.

Calls and results are hash-joined by identifier. A call may name the call whose result
it consumes (``parent``); a call's level is the length of that chain, found by pointer
doubling, so that a conversation of n calls takes log2(n) joins and no group is
gathered. Calls on a cycle never reach a root and get no level. Arguments are parsed
and checked against their tool's schema and serialised as canonical JSON: keys in
ascending order, no blanks, absent values left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrisk.llm.common import written

#: The registered query's tools, in the columns of a table of schemas.
TOOLS = [
    ("calculate", "left", "integer", True, None, None),
    ("calculate", "right", "integer", True, None, None),
    ("lookup", "exact", "boolean", False, None, None),
    ("lookup", "key", "string", True, None, None),
    ("search", "limit", "integer", False, 1.0, 50.0),
    ("search", "query", "string", True, None, None),
]
SCHEMA = "tool string, argument string, type string, required boolean, low double, high double"
#: JSON types by how a parsed value's own type is spelt; integers are also numbers.
TYPES = {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "OBJECT": "object", "ARRAY": "array"}
#: Longer texts of arguments, in bytes, are not parsed.
LARGEST = 16 << 20


def schemas_of(tools: DataFrame) -> DataFrame:
    """``known, schema``: one row per tool with its arguments by name. ``tools`` has a row for each
    argument (tool, argument, type, required, low, high), with a null argument for a tool that takes
    none; repeated rows count once, of rows that differ the first by type and the rest."""
    rest = F.struct("type", F.coalesce("required", F.lit(False)).alias("required"), "low", "high")
    one = tools.filter("tool is not null").groupBy("tool", "argument").agg(F.min(rest).alias("r")).select("tool", "argument", "r.*")
    takes = F.when(F.col("argument").isNotNull(), F.struct("argument", "type", "required", "low", "high"))
    return one.groupBy(F.col("tool").alias("known")).agg(F.array_sort(F.collect_list(takes)).alias("schema"))


def _type(value: Column) -> Column:
    """The JSON type of a parsed value; null if it is absent or null."""
    spelt = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))[spelt]


def _fault(rule: Column, values: Column) -> Column:
    """What is wrong with one argument of a schema, or null."""
    value, name = values[rule["argument"]], rule["argument"]
    of, number = _type(value), F.try_variant_get(value, "$", "double")
    fits = (of == rule["type"]) | ((of == "integer") & (rule["type"] == "number"))
    within = F.coalesce(number >= rule["low"], F.lit(True)) & F.coalesce(number <= rule["high"], F.lit(True))
    return F.when(rule["required"] & of.isNull(), F.concat(F.lit("missing "), name)).when(of.isNotNull() & ~fits, F.concat(F.lit("type of "), name)).when(of.isin("integer", "number") & ~within, F.concat(F.lit("range of "), name))


def _quoted(value: Column) -> Column:
    """A JSON string: to_json of a one-element array, without its brackets."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def checked_arguments(raw: Column, schema: Column) -> Column:
    """``problem, canonical`` of a call's arguments (JSON text) against its tool's schema, null for
    an unknown tool: the first problem by argument, and without one the canonical JSON, whose
    inner objects have their keys in order too."""
    keys = F.json_object_keys(raw)
    unread = F.when(keys.isNotNull() & (F.size(keys) > F.size(F.array_distinct(keys))), "duplicate key").when(F.octet_length(raw) > LARGEST, "too large").otherwise("no object")
    parsed = F.when(F.octet_length(raw) <= LARGEST, F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"))

    def against(values: Column) -> Column:
        names = F.map_keys(values)
        faults = F.array_compact(F.transform(schema, lambda rule: _fault(rule, values)))
        extra = F.size(F.array_except(names, F.transform(schema, lambda rule: rule["argument"]))) > 0
        problem = F.when(schema.isNull(), "unknown tool").when(values.isNull(), unread).otherwise(F.coalesce(F.get(faults, F.lit(0)), F.when(extra, "unknown argument")))
        given = F.filter(F.array_sort(names), lambda k: _type(values[k]).isNotNull())
        text = F.concat(F.lit("{"), F.array_join(F.transform(given, lambda k: F.concat(_quoted(k), F.lit(":"), F.to_json(values[k]))), ","), F.lit("}"))
        return F.struct(problem.alias("problem"), text.alias("canonical"))

    # the parsed arguments are named often and are to be parsed once
    return F.get(F.transform(F.array(parsed), against), F.lit(0))


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level`` of calls (call_id, parent): 0 without a known parent, null on a cycle
    or behind one. One small checksum a round reaches the driver."""
    ids = calls.select("call_id").distinct()
    parents = calls.groupBy("call_id").agg(F.min("parent").alias("parent"))
    known = parents.join(ids.withColumnRenamed("call_id", "parent"), "parent", "left_semi")
    state = ids.join(known, "call_id", "left").select("call_id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    state = written(state, "call-levels")
    n, before = None, None
    while True:
        n = state.filter("up is not null").count()
        if not n or n == before:
            return state.select("call_id", F.when(F.col("up").isNull(), F.col("steps")).alias("level"))
        before = n
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        moved = state.filter("up is not null").join(above, "up").select("call_id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        state = written(state.filter("up is null").unionByName(moved), "call-levels")


def link(calls: DataFrame, results: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row per call identifier, with its result, level, problem and canonical record.

    ``tools`` is a table of schemas (see :func:`schemas_of`), by default the registered query's.
    It meets the calls by an equi-join, which Spark broadcasts where the table's size allows it and
    splits by skew where not. Types are string, boolean, integer, number, object and array.

    ``calls``: call_id, conv_id, turn, tool, arguments (JSON text), parent. ``results``:
    call_id, content. Rows without call_id are left out; of rows that repeat a call_id the
    first by (conv_id, turn, tool, arguments, parent) counts, of results the smallest content;
    ``copies`` and ``results`` tell how many there were. Within a conversation (level, turn,
    call_id) is a topological order. Results without a call are in :func:`orphans`.
    """
    columns = ("conv_id", "turn", "tool", "arguments", "parent")
    one = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct(*columns)).alias("c"), F.count("*").alias("copies")).select("call_id", "c.*", "copies")
    one = written(one, "calls")
    got = results.filter("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("results"))
    schemas = schemas_of(one.sparkSession.createDataFrame(TOOLS, SCHEMA) if tools is None else tools)
    known = one.join(schemas, F.col("tool") == F.col("known"), "left").withColumn("c", checked_arguments(F.col("arguments"), F.col("schema")))
    checked = known.join(levels(one), "call_id").join(got, "call_id", "left").select(
        "call_id", "conv_id", "turn", "tool", "level", "copies", F.coalesce("results", F.lit(0)).alias("results"), F.length("content").cast("long").alias("result_chars"), "c.problem", F.when(F.col("c.problem").isNull(), F.col("c.canonical")).alias("canonical")
    )
    record = F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"name":'), _quoted(F.col("tool")), F.lit("}"))
    return checked.withColumn("record", F.when(F.col("problem").isNull(), record)).drop("canonical")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call_id is null or that of no call."""
    return results.join(calls.select("call_id").distinct(), "call_id", "left_anti")


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from conversations without any: an assistant turn calls a tool chosen
    by its length with arguments from its text (some of them wrong or of a wrong type), consumes the result of
    the call two or four turns before, and the user's next turn is its result."""
    name = lambda turn: F.concat(F.lit("call-"), F.when(F.col("conv_id") % 10 == 3, '"').otherwise(""), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    n = F.length("text")
    word = F.get(F.split("text", " "), F.lit(0))
    limit = F.when(n % 11 == 5, F.concat(F.lit('"'), (n % 60).cast("string"), F.lit('"'))).otherwise((n % 60).cast("string"))
    raw = (
        F.when(n % 3 == 0, F.concat(F.lit('{"query": '), _quoted(word), F.lit(', "limit": '), limit, F.lit("}")))
        .when(n % 3 == 1, F.concat(F.lit('{"key": '), F.when(n % 11 == 4, '{"x": 1}').otherwise(_quoted(word)), F.when(n % 2 == 0, ', "exact": true').otherwise(""), F.lit("}")))
        .otherwise(F.concat(F.lit('{"right": '), n.cast("string"), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit(', "left": '), (n * 2).cast("string"))), F.lit("}")))
    )
    tool = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("calculate")
    calls = conversations.filter("role = 'assistant' and text is not null").select(name(F.col("turn")).alias("call_id"), "conv_id", "turn", tool.alias("tool"), raw.alias("arguments"), name(F.col("turn") - 2 - 2 * (n % 2)).alias("parent"))
    results = conversations.filter("role = 'user'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


ORACLE = r"""
with recursive a as (select *, length(text) as n, string_split(text, ' ')[1] as w, 'call-' || case when conv_id % 10 = 3 then '"' else '' end || conv_id || '-' || turn as call_id from conversations where role = 'assistant' and text is not null),
c0 as (select call_id, conv_id, turn, n, case n % 3 when 0 then 'search' when 1 then 'lookup' else 'calculate' end as tool,
    case n % 3 when 0 then '{"query": ' || to_json(w) || ', "limit": ' || case when n % 11 = 5 then '"' || (n % 60) || '"' else (n % 60)::varchar end || '}' when 1 then '{"key": ' || case when n % 11 = 4 then '{"x": 1}' else to_json(w) end || case when n % 2 = 0 then ', "exact": true' else '' end || '}' else '{"right": ' || n || case when n % 7 = 0 then '' else ', "left": ' || (n * 2) end || '}' end as arguments,
    'call-' || case when conv_id % 10 = 3 then '"' else '' end || conv_id || '-' || (turn - 2 - 2 * (n % 2)) as parent, w from a),
c as (select * from (select *, count(*) over (partition by call_id) as copies, row_number() over (partition by call_id order by conv_id, turn, tool, arguments, parent) as rn from c0) where rn = 1),
r as (select 'call-' || case when conv_id % 10 = 3 then '"' else '' end || conv_id || '-' || (turn - 1) as call_id, min(text) as content, count(*) as results from conversations where role = 'user' group by 1),
lv as (select call_id, 0::bigint as level from c where parent not in (select call_id from c) union all select c.call_id, lv.level + 1 from c join lv on c.parent = lv.call_id)
select c.call_id, c.conv_id, c.turn, c.tool, lv.level, c.copies, coalesce(r.results, 0) as results, length(r.content)::bigint as result_chars,
  case when tool = 'search' and n % 11 = 5 then 'type of limit' when tool = 'lookup' and n % 11 = 4 then 'type of key' when tool = 'search' and n % 60 not between 1 and 50 then 'range of limit' when tool = 'calculate' and n % 7 = 0 then 'missing left' end as problem,
  case when not (tool = 'search' and n % 11 = 5) and not (tool = 'lookup' and n % 11 = 4) and not (tool = 'search' and n % 60 not between 1 and 50) and not (tool = 'calculate' and n % 7 = 0) then
    '{"arguments":' || case tool when 'search' then '{"limit":' || (n % 60) || ',"query":' || to_json(w) || '}' when 'lookup' then '{' || case when n % 2 = 0 then '"exact":true,' else '' end || '"key":' || to_json(w) || '}' else '{"left":' || (n * 2) || ',"right":' || n || '}' end || ',"id":' || to_json(c.call_id) || ',"name":"' || tool || '"}' end as record
from c join lv using (call_id) left join r using (call_id)
"""
