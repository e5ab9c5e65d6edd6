"""Chat formatting by tool-call linking (operator 7), with DataFrame functions only.

Calls and results are hash-joined by conversation and call identifier; a call names the calls it depends on.  If all its
dependencies come before it, a conversation's calls are already in topological order by position.  In the other
conversations a call's level is the length of the longest chain of dependencies under it: chains of calls with one
dependency are shortened by pointer doubling (rounds grow with the logarithm of a chain's length), then calls with
several get their level once all of theirs have one (a round per such call on a path).  Calls on or behind a cycle get
none.  Numbers within a conversation come from one sort of narrow rows over ranges, so that no task orders a whole
conversation.  Arguments are parsed as variants and checked against the tool's schema; each call becomes one line of
canonical JSON: keys in order, no spaces, and one form for equal numbers (integers in digits, all others as the shortest
double; an integer written with a point or an exponent is an integer).

Defined cases: arguments that are null or no JSON object are ``malformed``; a call without a result has a null result and
``linked`` false; a result without a call is a row of its own with the problem ``orphan-result``; of several results of a
call the first by position counts, ``n_results`` tells how many there are; a call identifier that comes twice keeps its
first call; a dependency on an unknown call is ``unresolved`` and has no part in the order, one on the call itself is a
cycle; null identifiers link with nothing and give no row; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import few, stored

#: Tool name to parameters: name to (type, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r"-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def canonical(json: Column) -> Column:
    """JSON text, as a variant writes it, with each number in its one form; strings stay as they are."""

    def number(x: Column) -> Column:
        value = x.cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        digits = F.when(x.rlike("^-?0+$"), F.lit("0")).otherwise(x)
        return F.when(x.rlike("^-?[0-9]+$"), digits).when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))

    def between(piece: Column) -> Column:
        found = F.transform(F.regexp_extract_all(piece, F.lit(_NUMBER), 0), number)
        return F.array_join(F.zip_with(F.split(piece, _NUMBER, -1), F.concat(found, F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")

    pieces = F.transform(F.split(json, _STRING, -1), between)
    return F.array_join(F.zip_with(pieces, F.concat(F.regexp_extract_all(json, F.lit(_STRING), 0), F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")


def _violations(name: Column, args: Column, text: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with the arguments of a call."""
    found = F.when(args.isNull(), F.array(F.lit("malformed")))
    top = F.schema_of_variant(args)
    found = found.when(~top.startswith("OBJECT<"), F.array(F.lit("malformed")))
    for tool, params in schemas.items():
        checks = []
        for p, (kind, required) in sorted(params.items()):
            value = F.try_variant_get(args, f"$.{p}", "variant")
            seen = F.schema_of_variant(value)
            numeric = seen.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$")
            size = F.try_variant_get(args, f"$.{p}", "double")
            good = {"string": seen == "STRING", "integer": numeric & (size == F.floor(size)), "number": numeric, "boolean": seen == "BOOLEAN"}[kind]
            missing = value.isNull() | (seen == "VOID")
            checks.append(F.when(missing, F.lit(f"missing:{p}") if required else F.lit(None).cast("string")).when(~good, F.lit(f"type:{p}")))
        allowed = F.array(*(F.lit(p) for p in sorted(params))) if params else _none()
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(text), allowed)), lambda k: F.concat(F.lit("unknown:"), k))
        found = found.when(name == tool, F.concat(F.array_compact(F.array(*checks)) if checks else _none(), F.coalesce(extra, _none())))
    return found.otherwise(F.array(F.lit("unknown-tool")))


_NODE = ["conv_id", "call_id"]


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of the calls of ``nodes`` by distinct ``edges(conv_id, call_id, dep)`` among them; none on or behind a cycle."""
    out = edges.groupBy(*_NODE).agg(F.count("*").alias("_n"), F.min("dep").alias("_to"))
    single = stored(out.where("_n = 1").select(*_NODE, "_to", F.lit(1).cast("bigint").alias("_w")), "pointers")
    most = nodes.groupBy("conv_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    for _ in range(most.bit_length()):
        step = single.select("conv_id", F.col("call_id").alias("_to"), F.col("_to").alias("_far"), F.col("_w").alias("_more"))
        jumped = stored(single.join(step, ["conv_id", "_to"], "left").select(*_NODE, F.coalesce("_far", "_to").alias("_to"), (F.col("_w") + F.coalesce("_more", F.lit(0))).alias("_w"), F.col("_far").isNotNull().alias("_moved")), "pointers")
        done = not jumped.where("_moved").limit(1).count()
        single = jumped.drop("_moved")
        if done:
            break
    # What each dependency of a call with several leads to: the end of its chain, and how far off that is.
    several = edges.join(out.where("_n > 1").select(*_NODE), _NODE, "left_semi")
    ends = single.select("conv_id", F.col("call_id").alias("dep"), "_to", "_w")
    wide = stored(several.join(ends, ["conv_id", "dep"], "left").select(*_NODE, F.coalesce("_to", "dep").alias("_to"), F.coalesce("_w", F.lit(0)).alias("_w")), "several")
    known = stored(nodes.join(edges.select(*_NODE).distinct(), _NODE, "left_anti").select(*_NODE, F.lit(0).cast("bigint").alias("level")), "known")
    while True:
        at = known.select("conv_id", F.col("call_id").alias("_to"), "level")
        ready = wide.join(known.select(*_NODE), _NODE, "left_anti").join(at, ["conv_id", "_to"], "left").groupBy(*_NODE).agg(F.max(F.col("level") + F.col("_w") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("_open"))
        ready = stored(ready.where("_open = 0").drop("_open"), "ready")
        if not ready.limit(1).count():
            break
        known = known.unionByName(ready)
    ended = single.join(known.select("conv_id", F.col("call_id").alias("_to"), "level"), ["conv_id", "_to"]).select(*_NODE, (F.col("level") + F.col("_w")).alias("level"))
    return known.unionByName(ended)


def _numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, call_id, topo``: rows numbered from 0 within each conversation by level, position and identifier.

    One sort over ranges gives each row its partition and place there; the counts of the partitions before and of the
    conversation's first row make that its number.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "level", "pos", "call_id"]
    low = F.shiftleft(F.lit(1).cast("bigint"), 33) - 1
    sorted_ = stored(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).select("conv_id", "call_id", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(low).alias("_i")), "sorted")
    # One row per partition of the sort.
    counts = {r["_p"]: r["c"] for r in sorted_.groupBy("_p").agg(F.count("*").alias("c")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    shift = F.broadcast(spark.createDataFrame(before, "_p int, _before bigint"))
    placed = sorted_.join(shift, "_p").select("conv_id", "call_id", (F.col("_i") + F.col("_before")).alias("_at"))
    first = stored(placed.groupBy("conv_id").agg(F.min("_at").alias("_first")), "first")
    return placed.join(few(first, first.count()), "conv_id").select("conv_id", "call_id", (F.col("_at") - F.col("_first")).cast("int").alias("topo"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call of ``calls(conv_id, call_id, pos, name, arguments, depends_on)``, linked with ``results(conv_id, call_id, pos, content)``, and per result without a call.

    Returns ``conv_id, call_id, pos, topo, name, valid, problems, linked, n_results, json``; ``topo`` counts from 0 within
    the conversation and is null on a cycle and for results.
    """
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*_NODE, "pos", "name", "arguments", "depends_on").where(keyed)
    calls = stored(calls.groupBy(*_NODE).agg(F.min_by(F.struct("pos", "name", "arguments", "depends_on"), F.struct("pos", "name", "arguments", "depends_on")).alias("_c")).select(*_NODE, "_c.*"), "calls")
    answers = results.select(*_NODE, "pos", "content").where(keyed).groupBy(*_NODE).agg(F.min_by(F.struct("pos", "content"), F.struct("pos", "content")).alias("_r"), F.count("*").alias("n_results"))
    edges = calls.select(*_NODE, F.col("pos").alias("_at"), F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep is not null")
    known = stored(edges.join(calls.select("conv_id", F.col("call_id").alias("dep"), F.col("pos").alias("_dep_at")), ["conv_id", "dep"], "left"), "edges")
    state = known.groupBy(*_NODE).agg(F.count_if(F.col("_dep_at").isNull()).alias("_unresolved"))
    odd = stored(known.where("_dep_at >= _at").select("conv_id").distinct(), "forward")
    n_odd = odd.count()
    flat = calls.select(*_NODE, "pos").join(few(odd, n_odd), "conv_id", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    if n_odd:
        mixed = calls.select(*_NODE, "pos").join(few(odd, n_odd), "conv_id", "left_semi")
        levels = _levels(mixed, known.where("_dep_at is not null").join(few(odd, n_odd), "conv_id", "left_semi").select(*_NODE, "dep"))
        flat = flat.unionByName(mixed.join(levels, _NODE))
    joined = calls.join(_numbered(flat), _NODE, "left").join(state, _NODE, "left").join(answers, _NODE, "full").withColumn("_call", F.col("pos").isNotNull() | F.col("topo").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull())
    some = lambda c, what: F.when(c, F.array(F.lit(what))).otherwise(_none())
    problems = F.when(~F.col("_call"), F.array(F.lit("orphan-result"))).otherwise(F.concat(_violations(F.col("name"), F.col("_args"), F.col("arguments"), schemas), some(F.col("_unresolved") > 0, "unresolved"), some(F.col("topo").isNull(), "cycle")))
    out = joined.withColumn("_args", F.try_parse_json("arguments")).withColumn("problems", problems)
    # Keys in alphabetical order; a variant holds its own keys in order.
    quoted = lambda c: F.coalesce(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    line = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.to_json("_args")), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("_r.content")), F.lit("}"))
    return out.select(*_NODE, F.coalesce("pos", "_r.pos").alias("pos"), "topo", "name", (F.size("problems") == 0).alias("valid"), F.array_join("problems", ",").alias("problems"), (F.col("_call") & F.col("_r").isNotNull()).alias("linked"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), line.alias("json"))


RESPOND: Schemas = {"respond": {"prompt": ("string", True), "turn": ("integer", True), "system": ("boolean", False)}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool traffic with faults: a user or system turn calls ``respond``, the assistant turn after it is the result.

    A call is named by its turn.  By ``(conv_id + turn) % 11`` its arguments lack the prompt (0), have a text for the turn
    (1) or an unknown key with a number in another form (2), are cut off (3), write the turn as a double (4), go to an
    unknown tool (5), or the call comes twice (6).  By ``conv_id % 5`` a call depends on the one two turns before (0) or
    after (1), on both (2, a cycle), on a call that is not there (3), or, in the first half of each eight turns, on the two
    after it (4).  The result is lost to another identifier where ``(conv_id + turn) % 13`` is 0, and comes twice where it is 1.
    """
    name = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    turn, kind, way = F.col("turn"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)), F.pmod("conv_id", F.lit(5))
    asks = conversations.where(F.col("role").isin("user", "system"))
    prompt = F.concat(F.lit('"prompt":'), F.expr("substr(to_json(array(coalesce(text, ''))), 2, length(to_json(array(coalesce(text, '')))) - 2)"))
    system = F.when(F.col("role") == "system", F.lit('"system":true'))
    number = F.when(kind == 1, F.concat(F.lit('"'), turn, F.lit('"'))).when(kind == 4, F.concat(turn, F.lit("e0"))).otherwise(turn.cast("string"))
    body = F.concat_ws(", ", F.concat(F.lit('"turn": '), number), F.when(kind != 0, prompt), system, F.when(kind == 2, F.lit('"extra":[15.0, 1.50e1, {"b":-0, "a":1e-7}]')))
    args = F.when(kind == 3, F.concat(F.lit("{"), body)).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    deps = F.when(way == 0, F.when(turn > 1, F.array(name(turn - 2)))).when(way == 1, F.array(name(turn + 2))).when(way == 2, F.array(name(turn - 2), name(turn + 2))).when(way == 3, F.array(F.lit("call-x"))).when(turn % 8 < 4, F.array(name(turn + 2), name(turn + 4)))
    calls = asks.select("conv_id", name(turn).alias("call_id"), turn.alias("pos"), F.when(kind == 5, "search").otherwise("respond").alias("name"), args.alias("arguments"), deps.alias("depends_on"), kind.alias("_k"))
    again = calls.where("_k = 6").withColumns({"pos": F.col("pos") + 1000, "arguments": F.lit("{}")})
    lost = F.pmod(F.col("conv_id") + turn, F.lit(13))
    results = conversations.where("role = 'assistant'").select("conv_id", F.when(lost == 0, F.concat(F.lit("lost-"), turn)).otherwise(name(turn - 1)).alias("call_id"), turn.alias("pos"), F.col("text").alias("content"), lost.alias("_l"))
    twice = results.where("_l = 1").withColumns({"pos": F.col("pos") + 1000, "content": F.lit("late")})
    return calls.unionByName(again).drop("_k"), results.unionByName(twice).drop("_l")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_tool_calls(calls, results, RESPOND)


#: What the faults must lead to, told from conversation and turn alone.
ORACLE = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 11 AS k, conv_id % 5 AS way FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, text, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'lost-' || turn ELSE 'call-' || (turn - 1) END AS call_id, CASE WHEN (conv_id + turn) % 13 = 1 THEN 2 ELSE 1 END AS n FROM conversations WHERE role = 'assistant'),
e AS (SELECT c.*, EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.turn = c.turn - 2) AS p2, EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 2) AS n2,
  EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 4) AS n4, EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.turn = c.turn + 6) AS n6 FROM c),
l AS (SELECT *, CASE WHEN way = 1 THEN (SELECT count(*) FROM c o WHERE o.conv_id = e.conv_id AND o.turn > e.turn AND (o.turn - e.turn) % 2 = 0)
  WHEN way = 4 AND turn % 8 IN (2, 3) THEN CAST(n2 OR n4 AS INTEGER) WHEN way = 4 AND turn % 8 IN (0, 1) THEN CASE WHEN n2 AND (n4 OR n6) THEN 2 WHEN n2 OR n4 THEN 1 ELSE 0 END ELSE 0 END AS level,
  way = 2 AND (p2 OR n2) AS cyc,
  CASE way WHEN 0 THEN turn > 1 AND NOT p2 WHEN 1 THEN NOT n2 WHEN 2 THEN NOT (p2 AND n2) WHEN 3 THEN true ELSE turn % 8 < 4 AND NOT (n2 AND n4) END AS un FROM e),
t AS (SELECT *, CASE WHEN NOT cyc THEN row_number() OVER (PARTITION BY conv_id, cyc ORDER BY level, turn) - 1 END AS topo FROM l),
q AS (SELECT *, list_filter([CASE k WHEN 0 THEN 'missing:prompt' WHEN 1 THEN 'type:turn' WHEN 2 THEN 'unknown:extra' WHEN 3 THEN 'malformed' WHEN 5 THEN 'unknown-tool' END, CASE WHEN un THEN 'unresolved' END, CASE WHEN cyc THEN 'cycle' END], lambda x: x IS NOT NULL) AS bad,
  CASE WHEN k = 3 THEN 'null' ELSE '{' || concat_ws(',', CASE WHEN k = 2 THEN '"extra":[15,15,{"a":1.0E-7,"b":0}]' END, CASE WHEN k <> 0 THEN '"prompt":' || CAST(to_json(text) AS VARCHAR) END, CASE WHEN role = 'system' THEN '"system":true' END, '"turn":' || CASE WHEN k = 1 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END) || '}' END AS args FROM t)
SELECT q.conv_id, 'call-' || q.turn AS call_id, q.turn AS pos, CAST(topo AS INTEGER) AS topo, CASE WHEN k = 5 THEN 'search' ELSE 'respond' END AS name, len(bad) = 0 AS valid, array_to_string(bad, ',') AS problems, r.conv_id IS NOT NULL AS linked, CAST(coalesce(r.n, 0) AS BIGINT) AS n_results,
  '{"arguments":' || args || ',"id":"call-' || q.turn || '","name":"' || CASE WHEN k = 5 THEN 'search' ELSE 'respond' END || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
FROM q LEFT JOIN r ON r.conv_id = q.conv_id AND r.call_id = 'call-' || q.turn
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, NULL, NULL, false, 'orphan-result', false, n, '{"arguments":null,"id":"' || r.call_id || '","name":null,"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND 'call-' || c.turn = r.call_id)"""
