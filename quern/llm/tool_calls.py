"""Chat formatting with tool-call linking (DataFrame functions only).

Calls and results meet in a hash join on their identifier. A call may name
calls that it depends on; within a message they are ordered by levels, found
in rounds of joins, each cut by a written table. Between messages the turn
decides, as a dependency must lie in an earlier turn. Arguments are validated
against each tool's schema, and every message becomes one line of canonical
JSON: keys in the order of their UTF-16 units, no white space, no nulls.

Tables (further columns are ignored):
    messages   conv_id long, turn long, role string, text string
    calls      conv_id long, turn long, pos int, call_id string, name string,
               arguments string (a JSON object), depends_on array<string>
    results    conv_id long, turn long, call_id string

Defined results: a null text, role or identifier stays null and is left out of
the JSON; null identifiers never link. If several results carry one
identifier, the one of the smallest turn links and the others are orphans; if
several calls do, each links. Arguments that are no JSON object are invalid, as
are those with a number beyond the doubles and those with a string of over 20
million characters, which Spark does not parse: they are null when canonical.
`chat_lines` validates and makes canonical texts over `PIECE` characters piece
by piece, so none is lost.
A call in a dependency cycle has level null; a dependency that is missing or
in a later turn does not count but marks the call `unmet`. Repeated rows come
out as often as they went in. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import discard, materialize

#: A tool's schema: property -> (type, required); types as JSON names them.
Schema = dict[str, tuple[str, bool]]


def _typed(value: Column, kind: str) -> Column:
    """Whether a variant holds a JSON type; absent values are not of any type."""
    text = F.schema_of_variant(value)
    return {
        "string": text == "STRING",
        "boolean": text == "BOOLEAN",
        "integer": text == "BIGINT",
        "number": (text == "BIGINT") | (text == "DOUBLE") | text.startswith("DECIMAL") | (text == "FLOAT"),
        "object": text.startswith("OBJECT"),
        "array": text.startswith("ARRAY"),
    }[kind]


def valid(name: Column, arguments: Column, tools: dict[str, Schema]) -> Column:
    """Whether the arguments are an object with all required properties, each of its type, and no unknown ones; false for unknown tools."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    good = F.lit(False)
    for tool, schema in sorted(tools.items()):
        fits = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in schema]).cast("array<string>"))) == 0
        for key, (kind, required) in sorted(schema.items()):
            value = F.try_variant_get(parsed, f"$['{key}']", "variant")
            here = F.array_contains(keys, key)
            fits = fits & F.when(here, F.coalesce(_typed(value, kind), F.lit(False))).otherwise(F.lit(not required))
        good = F.when(name == tool, fits).otherwise(good)
    return F.coalesce(good & _typed(parsed, "object") & canonical(arguments).isNotNull(), F.lit(False))


def canonical(arguments: Column) -> Column:
    """A JSON text with sorted keys and no white space; null for texts that are no JSON or hold a number beyond the doubles."""
    text = F.to_json(F.try_parse_json(arguments))
    # Such a number comes back as this word, which the text did not hold so often.
    times = lambda c: F.length(c) - F.length(F.replace(c, F.lit("Infinity"), F.lit("nfinity")))
    return F.when(times(text) <= times(arguments), text)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, unmet of each identified call: level 0 depends on no call of its own turn, level n on one of level n - 1.

    There is a round, and a table, for each step of the longest chain within a turn.
    """
    spark = calls.sparkSession
    nodes = calls.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    wanted = calls.select("conv_id", "call_id", F.explode("depends_on").alias("parent")).filter(F.col("parent").isNotNull()).distinct()
    child = nodes.join(wanted, ["conv_id", "call_id"])
    parents = nodes.select("conv_id", F.col("call_id").alias("parent"), F.col("turn").alias("parent_turn"))
    edges = child.join(parents, ["conv_id", "parent"], "left")
    late = F.col("parent_turn").isNull() | (F.col("parent_turn") > F.col("turn"))
    unmet = edges.groupBy("conv_id", "call_id").agg(F.max(late).alias("unmet"))
    same, same_path = materialize(edges.filter(F.col("parent_turn") == F.col("turn")).select("conv_id", "call_id", "parent"), "call-edges")
    if same.isEmpty():
        discard(spark, same_path)
        return nodes.join(unmet, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.lit(0).alias("level"), F.coalesce("unmet", F.lit(False)).alias("unmet"))
    done = nodes.join(same.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    done, path = materialize(done, "call-levels")
    left, round_ = same.select("conv_id", "call_id").distinct().count(), 0
    while left:
        round_ += 1
        open_ = same.join(done.select("conv_id", F.col("call_id").alias("parent"), "level"), ["conv_id", "parent"], "left")
        ready = open_.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("known"), F.max("level").alias("most")).filter("n = known")
        fresh = ready.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", (F.col("most") + 1).alias("level"))
        after, new_path = materialize(done.union(fresh), "call-levels")
        still = same.join(after.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id").distinct().count()
        discard(spark, path)
        done, path = after, new_path
        if still == left:
            break
        left = still
    return nodes.join(done, ["conv_id", "call_id"], "left").join(unmet, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "level", F.coalesce("unmet", F.lit(False)).alias("unmet"))


def located(calls: DataFrame, results: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """All calls with result_turn (null: none), level and unmet, and the further columns to carry."""
    first = results.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    known = calls.select("conv_id", "turn", "pos", "call_id", "depends_on", *carry)
    linked = known.join(first, ["conv_id", "call_id"], "left").join(levels(known), ["conv_id", "call_id"], "left")
    return linked.select("conv_id", "turn", "pos", "call_id", "result_turn", "level", F.coalesce("unmet", F.lit(False)).alias("unmet"), *carry)


def link(calls: DataFrame, results: DataFrame, tools: dict[str, Schema], carry: tuple[str, ...] = ()) -> DataFrame:
    """All calls with result_turn (null: none), level, unmet, valid and canonical arguments, and the further columns to carry."""
    name, arguments = F.col("name"), F.col("arguments")
    return located(calls, results, ("name", "arguments", *carry)).select(
        "conv_id", "turn", "pos", "call_id", "name", "result_turn", "level", "unmet",
        valid(name, arguments, tools).alias("valid"), canonical(arguments).alias("arguments"), *carry,
    )


def answers(calls: DataFrame, results: DataFrame) -> DataFrame:
    """results with `linked`: whether a call has their identifier and they are the first result of it; the others are orphans."""
    asked = calls.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.lit(True).alias("asked"))
    first = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first_turn"))
    met = results.join(first, ["conv_id", "call_id"], "left").join(asked, ["conv_id", "call_id"], "left")
    return met.withColumn("linked", F.coalesce(F.col("asked") & (F.col("turn") == F.col("first_turn")), F.lit(False))).drop("asked", "first_turn")


#: The tools that a user's turn calls in a plain conversation, in the order in which it lists them, and their schemas.
TOOLS: dict[str, Schema] = {
    "reply": {"prompt": ("string", True), "turn": ("integer", True)},
    "count": {"text": ("string", True), "chars": ("integer", True)},
    "split": {"text": ("string", True)},
}


def _arguments(tool: str, text: Column, length: Column, conv: Column, turn: Column) -> Column:
    """What a call is given, spaced and in the order of its schema, nulls left out: every fifth count lacks chars, every seventh reply has a property too many."""
    given = {
        "reply": F.struct(text.alias("prompt"), turn.alias("turn"), F.when((conv + turn) % 7 == 3, F.lit(True)).alias("draft")),
        "count": F.struct(text.alias("text"), F.when((conv + turn) % 5 != 0, length).alias("chars")),
        "split": F.struct(text.alias("text")),
    }
    return F.to_json(given[tool], {"pretty": "true"})


#: Characters up to which a text is parsed in one; a longer one is parsed in pieces of so many.
PIECE = 5_000_000


def _pieces(text: Column) -> Column:
    """A text as canonical JSON, each piece by itself; null if one cannot be parsed."""
    starts = F.sequence(F.lit(1), F.length(text), F.lit(PIECE))
    made = F.transform(starts, lambda i: canonical(F.to_json(F.struct(F.substr(text, i, F.lit(PIECE)).alias("t")), {"pretty": "true"})))
    inside = F.array_join(F.transform(made, lambda c: F.regexp_extract(c, r'(?s)^\{\s*"t"\s*:\s*"(.*)"\s*\}$', 1)), "")
    return F.when(F.forall(made, lambda c: c.isNotNull()), F.concat(F.lit('"'), inside, F.lit('"')))


def _checked(tool: str, text: Column, conv: Column, turn: Column) -> Column:
    """Whether the arguments of a call are valid, and their canonical form."""
    # An empty string, of which arguments have no others, keeps a long text's place until its pieces are canonical.
    long = F.coalesce(F.length(text) > PIECE, F.lit(False))
    given = _arguments(tool, F.when(long, F.lit("")).otherwise(text), F.length(text), conv, turn)
    form, fits = canonical(given), valid(F.lit(tool), given, TOOLS)
    whole = F.when(long, F.replace(form, F.lit('""'), _pieces(text))).otherwise(form)
    return F.struct((fits & whole.isNotNull()).alias("valid"), whole.alias("arguments"))


def chat_lines(messages: DataFrame) -> DataFrame:
    """One row per message of plain conversations: conv_id, turn, role, call_id, linked, valid, unmet, level, line.

    A user's turn t makes three calls, listed as reply, count, split and named
    `<conv_id>-<t>-<tool>`. count needs split; reply needs count and the reply
    of turn t - 2, but for turn 0; in every eleventh turn count needs reply too, a cycle. The
    assistant's turn t + 1 is the result of reply. line is canonical JSON, with
    the calls in topological order (those of a cycle last) and their arguments
    made canonical from the whole texts, valid or not. call_id and linked are those of reply
    or of the result; valid, unmet and level (the greatest; null for a cycle)
    are null but for turns with calls.
    """
    base, _ = materialize(messages.select("conv_id", "turn", "role", "text").withColumn("rid", F.monotonically_increasing_id()), "messages")
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))

    def name_of(turn: Column, tool: str) -> Column:
        return F.concat(conv.cast("string"), F.lit("-"), turn.cast("string"), F.lit(f"-{tool}"))

    needs = {
        "reply": F.array_compact(F.array(name_of(turn, "count"), F.when(turn > 0, name_of(turn - 2, "reply")))),
        "count": F.array_compact(F.array(name_of(turn, "split"), F.when((conv + turn) % 11 == 4, name_of(turn, "reply")))),
        "split": F.array().cast("array<string>"),
    }
    listed = [F.struct(F.lit(pos).alias("pos"), F.lit(tool).alias("name"), name_of(turn, tool).alias("call_id"), needs[tool].alias("depends_on")) for pos, tool in enumerate(TOOLS)]
    calls = base.filter(role == "user").select("conv_id", "turn", "rid", F.explode(F.array(*listed)).alias("c")).select("conv_id", "turn", "rid", "c.*")
    results = base.filter(role == "assistant").select("conv_id", "turn", name_of(turn - 1, "reply").alias("call_id"), "role", "text")
    others = base.filter(~F.coalesce(role.isin("user", "assistant"), F.lit(False)))
    reply = F.col("name") == "reply"
    placed = located(calls, results, ("rid", "name")).groupBy("rid").agg(
        F.max(F.when(reply, F.col("call_id"))).alias("call_id"), F.coalesce(F.bool_or(reply & F.col("result_turn").isNotNull()), F.lit(False)).alias("linked"),
        F.bool_or("unmet").alias("unmet"), F.when(F.count("level") == F.count(F.lit(1)), F.max("level")).alias("level"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("level", F.lit(1 << 30)).alias("l"), "pos", "call_id", "name"))).alias("calls"),
    )
    # Arguments are checked where their text lies, which moves once.
    met = base.join(placed, "rid").withColumn("checked", F.array(*[_checked(tool, text, conv, turn) for tool in TOOLS]))
    content = F.col("text").alias("content")

    def call(c: Column) -> Column:
        arguments = F.get("checked", c["pos"])["arguments"]
        named = F.to_json(F.struct(c["call_id"].alias("id"), c["name"].alias("name")))
        return F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"arguments":'), arguments, F.lit(",")), F.lit("")), F.substr(named, F.lit(2)))

    line = F.concat(F.lit('{"calls":['), F.array_join(F.transform("calls", call), ","), F.lit("],"), F.substr(F.to_json(F.struct(content, role, turn)), F.lit(2)))
    called = met.select("conv_id", "turn", "role", "call_id", "linked", F.forall("checked", lambda c: c["valid"]).alias("valid"), "unmet", "level", line.alias("line"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("valid", "boolean"), ("unmet", "boolean"), ("level", "int"))]
    result_of = F.when(F.col("linked"), F.col("call_id")).alias("result_of")
    answered = answers(calls, results).select("conv_id", "turn", "role", "call_id", "linked", *nothing, F.to_json(F.struct(content, result_of, role, turn)).alias("line"))
    plain = others.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"), *nothing, F.to_json(F.struct(content, role, turn)).alias("line"))
    return called.union(answered).union(plain)
