"""Completion of command lines over a command tree: segments, flags, values.

The tree is a table of nodes, one per prefix of a command's path. A typed line walks it without a
loop: every prefix of its leading tokens is looked up at once, and the longest that is a node is
the context. What is completed then depends on the tokens before the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.catalog import flag_candidates, prefix_suggest, segment_candidates, value_hints

# Stands between the segments of a node's key; no token holds it.
_SEP = "\u0000"
ROOT = ""


def _key(segments: Column) -> Column:
    """Key of a path; segments are matched without regard to case."""
    return F.lower(F.array_join(segments, _SEP))


def tree(commands: DataFrame) -> DataFrame:
    """Nodes (node, parent, name, short, hidden, alias_target, alias_description, job, ord).

    ``commands`` is (path array<string>, short, hidden, alias_target, alias_description, ord). Every
    prefix of a path is a node; the last one is a job or alias and has the command's texts. Of
    commands with one path the first by ``ord`` counts; a group shows the spelling of the first
    command below it. Paths with blank segments have no node.
    """
    blank = F.exists("path", lambda s: F.coalesce(F.trim(s), F.lit("")) == "")
    depth = F.size("path")
    prefixes = commands.filter((depth > 0) & ~blank).select(
        "*", depth.alias("__depth"), F.explode(F.sequence(F.lit(1), depth)).alias("__level")
    )
    path = F.slice("path", F.lit(1), F.col("__level"))
    leaf = F.col("__level") == F.col("__depth")
    text = lambda name: F.when(leaf, F.col(name)).alias(name)
    nodes = prefixes.select(
        _key(path).alias("node"),
        _key(F.slice("path", F.lit(1), F.col("__level") - 1)).alias("parent"),
        F.element_at(path, -1).alias("name"),
        text("short"),
        F.when(leaf, F.coalesce("hidden", F.lit(False))).otherwise(False).alias("hidden"),
        text("alias_target"),
        text("alias_description"),
        leaf.alias("job"),
        "ord",
    )
    # fixed-width first, so groups of a hot prefix are combined per task
    first = nodes.groupBy("node", "job").agg(F.min("ord").alias("ord"))
    rows = nodes.join(first, ["node", "job", "ord"]).dropDuplicates(["node", "job"])
    group, command = rows.filter("NOT job"), rows.filter("job")
    return command.unionByName(group.join(command.select("node"), "node", "left_anti"))


def _pending(before: Column) -> Column:
    """The flag that waits for its value: read backwards, words are taken by the flag before them,
    and the first flag that takes none is it."""
    start = F.struct(F.lit(False).alias("word"), F.lit("").alias("flag"))

    def step(state: Column, token: Column) -> Column:
        flag, open_ = token.startswith("-"), state["flag"] == ""
        return F.struct(
            F.when(flag, F.lit(False)).otherwise(True).alias("word"),
            F.when(open_ & flag & ~state["word"], token).otherwise(state["flag"]).alias("flag"),
        )

    return F.aggregate(F.reverse(before), start, step)["flag"]


def contexts(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(request, node, job, current, pending, kind) of command lines (request, tokens array<string>).

    The last token is being typed, those before it lead from the root to ``node``: up to the first
    flag or the first that is no child. ``kind`` is value behind a flag that waits for one, flag
    when a flag is typed or the node is a job, else segment. Null tokens count as empty.
    """
    tokens = F.transform(F.coalesce("tokens", F.array()), lambda t: F.coalesce(t, F.lit("")))
    rows = lines.select("request", tokens.alias("tokens"))
    size = F.greatest(F.size("tokens") - 1, F.lit(0))
    rows = rows.select(
        "request",
        F.coalesce(F.try_element_at("tokens", F.lit(-1)), F.lit("")).alias("current"),
        F.slice("tokens", F.lit(1), size).alias("before"),
    ).withColumn("pending", _pending(F.col("before")))
    lead = F.array_position(F.transform("before", lambda t: t.startswith("-")), True)
    lead = F.when(lead > 0, lead - 1).otherwise(F.size("before")).cast("int")
    walked = rows.filter(lead > 0).select(
        "request", "before", F.explode(F.sequence(F.lit(1), lead)).alias("level")
    )
    # a node's parents are nodes too, so the longest path found is the end of the walk
    steps = walked.select("request", "level", _key(F.slice("before", F.lit(1), F.col("level"))).alias("node"))
    reached = (
        steps.join(nodes.select("node", "job"), "node")
        .groupBy("request")
        .agg(F.max(F.struct("level", "node", "job")).alias("at"))
        .select("request", "at.node", "at.job")
    )
    found = rows.drop("before").join(reached, "request", "left").withColumns(
        {"node": F.coalesce("node", F.lit(ROOT)), "job": F.coalesce("job", F.lit(False))}
    )
    kind = (
        F.when(F.col("pending") != "", "value")
        .when(F.col("current").startswith("-") | F.col("job"), "flag")
        .otherwise("segment")
    )
    return found.withColumn("kind", kind)


def _placed(found: DataFrame, *order: str) -> DataFrame:
    """Numbered per request, from 1; a request's suggestions are its own answer."""
    by = Window.partitionBy("request").orderBy(*order)
    return found.withColumn("place", F.row_number().over(by)).select(
        "request", "kind", "place", "insert", "display"
    )


def segments(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Children of each segment context whose name starts with what is typed, by (insert, display).

    Hidden children are left out, names that start with ``:`` unless one is typed.
    """
    children = segment_candidates(nodes, "parent")
    wanted = asked.filter("kind = 'segment'").select("request", "kind", F.col("node").alias("parent"), "current")
    return _placed(prefix_suggest(children, wanted, "current", on=["parent"]), "insert", "display")


def flags_of(flags: DataFrame, asked: DataFrame) -> DataFrame:
    """Flags of each flag context that start with what is typed, by (insert, display).

    ``flags`` is (node, name, usage, shorthand, hidden, type, is_arg, enum, items_enum).
    """
    forms = flag_candidates(flags, "node")
    wanted = asked.filter("kind = 'flag'").select("request", "kind", "node", "current")
    return _placed(prefix_suggest(forms, wanted, "current", on=["node"]), "insert", "display")


def values(flags: DataFrame, asked: DataFrame) -> DataFrame:
    """Values of each pending flag that start with what is typed, in declaration order.

    A flag is found by its name, cut at ``=``, or, if it is one letter, by its shorthand. An
    argument gives the choices of its type; any other flag gives true and false if it is ``bool``.
    """
    token = F.col("pending")
    name = F.regexp_extract(token, "^-*([^=]*)", 1)
    wanted = asked.filter("kind = 'value'").select(
        "request", "kind", "node", "current", name.alias("__name"),
        F.when(F.length(token) == 2, F.substring(token, 2, 1)).alias("__short"),
    ).filter("__name <> ''")
    known = flags.select("node", F.col("name").alias("__flag"), "shorthand", "type", "is_arg", "enum", "items_enum")
    by_name = wanted.join(known, (wanted["node"] == known["node"]) & (F.col("__name") == F.col("__flag")))
    by_name = by_name.select("request", "kind", "current", "type", "is_arg", "enum", "items_enum")
    missed = wanted.join(by_name.select("request"), "request", "left_anti").filter("__short IS NOT NULL")
    by_short = missed.join(
        known, (missed["node"] == known["node"]) & (F.col("__short") == F.col("shorthand"))
    ).select(
        # found by its letter, a flag is no argument
        "request", "kind", "current", "type", F.lit(False).alias("is_arg"), "enum", "items_enum",
    )
    arg = F.struct("type", "enum", "items_enum")
    truth = F.array(F.lit("true"), F.lit("false"))
    choices = F.when(F.col("is_arg"), value_hints(arg)).when(F.col("type") == "bool", truth)
    found = by_name.unionByName(by_short).select("request", "kind", "current", F.posexplode(choices).alias("ord", "insert"))
    low = F.lower(F.col("insert")).startswith(F.lower("current"))
    return _placed(found.filter(low).withColumn("display", F.col("insert")), "ord")


def complete(nodes: DataFrame, flags: DataFrame, lines: DataFrame) -> DataFrame:
    """(request, kind, place, insert, display) for command lines (request, tokens)."""
    asked = contexts(nodes, lines)
    return segments(nodes, asked).unionByName(flags_of(flags, asked)).unionByName(values(flags, asked))
