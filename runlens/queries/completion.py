"""Completion of command lines over a command tree made of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import tables
from runlens.operators import completion as CP


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a command: brand, then the words of its name."""
    key = F.col("p_partkey")
    return tables.load(spark, sf, "part").select(
        key.alias("ord"),
        F.concat(F.array("p_brand"), F.split("p_name", " ")).alias("path"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise("").alias("short"),
        (F.col("p_size") % 7 == 0).alias("hidden"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("parts/"), key.cast("string"))).otherwise("").alias("alias_target"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("alias_description"),
    )


def _lines(spark: SparkSession, sf: str, typed: dict[int, list]) -> DataFrame:
    """Customers type lines about a part; the balance, size and key decide how far they are."""
    parts = tables.load(spark, sf, "part")
    top = parts.agg(F.max("p_partkey") + 1).scalar()
    asked = tables.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("request"), (F.col("c_custkey") * 7 % top).alias("p_partkey"),
        "c_nationkey", "c_mktsegment",
    ).join(parts, "p_partkey")
    tokens = F.array()
    for number, line in typed.items():
        tokens = F.when(F.col("request") % len(typed) == number, F.array(*line)).otherwise(tokens)
    return asked.select("request", tokens.alias("tokens"))


def _flags(nodes: DataFrame, nations: DataFrame) -> DataFrame:
    """Flags of every command: an argument with the nations as choices, one of the command's own
    kind, and two flags that are no arguments."""
    names = nations.agg(F.array_sort(F.collect_list("n_name"))).scalar()
    none = F.lit(None).cast("array<string>")

    def flag(name, usage, short, kind, is_arg, enum=none, items=none, hidden=False):
        fields = {"name": name, "usage": usage, "shorthand": short, "type": kind}
        texts = [F.lit(v).alias(k) for k, v in fields.items()]
        return F.struct(*texts, F.lit(hidden).alias("hidden"), F.lit(is_arg).alias("is_arg"), enum.alias("enum"), items.alias("items_enum"))

    listed = F.array(
        flag("nation", "Nation", "n", "string", True, enum=names),
        flag("kinds", "", "", "array", True, items=F.array(F.col("name"), F.upper("name"), F.lit("all"))),
        flag("verbose", "More output", "v", "bool", False),
        flag("trace", "", "", "string", False, hidden=True),
    )
    return nodes.filter("job").select("node", F.inline(listed))


def _words():
    return F.col("p_brand"), F.split("p_name", " ")[0], F.split("p_name", " ")[1]


def segment_suggest(spark: SparkSession, sf: str) -> DataFrame:
    """Children of what is typed so far, from the root down to the last word."""
    brand, one, two = _words()
    typed = {
        0: [F.lit("")],
        1: [F.substring(F.upper(brand), 1, 7)],
        2: [F.upper(brand), F.substring(one, 1, 2)],
        3: [brand, one, F.substring(two, 1, 1)],
        4: [brand, F.lit("unknown"), F.substring(one, 1, 1)],
        5: [brand, F.upper(one), F.lit("")],
    }
    nodes = CP.tree(_commands(spark, sf))
    asked = CP.contexts(nodes, _lines(spark, sf, typed))
    return CP.segments(nodes, asked)


def value_suggest(spark: SparkSession, sf: str) -> DataFrame:
    """Flags and values of commands: a nation's prefix, a flag by its letter, choices of a command's own."""
    brand, one, two = _words()
    nation = F.concat(F.lit("nation_"), (F.col("c_nationkey") % 3).cast("string"))
    typed = {
        0: [brand, one, two, F.lit("--nation"), nation],
        1: [brand, one, two, F.lit("-v"), F.lit("")],
        2: [brand, F.upper(one), two, F.lit("--nation"), F.lit("x"), F.lit("--kinds=a"), F.substring(F.upper(two), 1, 1)],
        3: [brand, one, two, F.lit("--V")],
        4: [brand, one, two, F.lit("--verbose"), F.lit("--nation"), F.lit("x"), F.lit("t")],
        5: [brand, one, two, F.lit("")],
        6: [brand, one, two, F.lit("-n"), F.lit("")],
    }
    nodes = CP.tree(_commands(spark, sf))
    flags = _flags(nodes, tables.load(spark, sf, "nation"))
    return CP.complete(nodes, flags, _lines(spark, sf, typed))


QUERIES = {f.__name__: f for f in (segment_suggest, value_suggest)}

_TYPED = """cmds AS (
          SELECT p_partkey AS ord, p_brand AS b, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
                 p_type, p_size, p_name FROM part
        ), asked AS (
          SELECT c_custkey AS request, c_nationkey, cmds.*
          FROM customer JOIN cmds ON cmds.ord = c_custkey * 7 % ((SELECT max(p_partkey) FROM part) + 1)
        ), leaf AS (
          SELECT * FROM cmds QUALIFY row_number() OVER (PARTITION BY lower(b), lower(w1), lower(w2) ORDER BY ord) = 1
        )"""

SQL = {
    "segment_suggest": f"""
        WITH {_TYPED}, nodes AS (
          SELECT '' AS parent, min_by(b, ord) AS name, false AS hidden, min_by(b, ord) AS display FROM cmds GROUP BY lower(b)
          UNION ALL
          SELECT lower(b), min_by(w1, ord), false, min_by(w1, ord) FROM cmds GROUP BY lower(b), lower(w1)
          UNION ALL
          SELECT lower(b) || '/' || lower(w1), w2, p_size % 7 = 0,
                 CASE WHEN p_type = 'PROMO' AND p_size % 2 = 0 THEN w2 || ' (alias -> parts/' || ord || ', ' || p_name || ')'
                      WHEN p_type = 'PROMO' THEN w2 || ' (alias -> parts/' || ord || ')'
                      WHEN p_size % 3 > 0 THEN p_type ELSE w2 END
          FROM leaf
        ), lines AS (
          SELECT request,
                 CASE WHEN request % 6 IN (0, 1) THEN '' WHEN request % 6 IN (2, 4) THEN lower(b)
                      ELSE lower(b) || '/' || lower(w1) END AS parent,
                 CASE request % 6 WHEN 1 THEN left(lower(b), 7) WHEN 2 THEN left(w1, 2) WHEN 3 THEN left(w2, 1)
                      WHEN 4 THEN left(w1, 1) ELSE '' END AS cur
          FROM asked
        )
        SELECT request, 'segment' AS kind,
               CAST(row_number() OVER (PARTITION BY request ORDER BY name, display) AS INTEGER) AS place,
               name AS "insert", display
        FROM lines JOIN nodes USING (parent)
        WHERE NOT hidden AND starts_with(lower(name), lower(cur))""",
    "value_suggest": f"""
        WITH {_TYPED}, nations AS (SELECT list(n_name ORDER BY n_name) AS names FROM nation),
        offered AS (
          SELECT request, 'value' AS kind, unnest(names) AS "insert", unnest(names) AS display,
                 generate_subscripts(names, 1) AS o, 'nation_' || c_nationkey % 3 AS cur
          FROM asked, nations WHERE request % 7 = 0
          UNION ALL
          SELECT request, 'value', x, x, o, '' FROM asked, (VALUES (1, 'true'), (2, 'false')) v(o, x) WHERE request % 7 = 1
          UNION ALL
          SELECT a.request, 'value', CASE o WHEN 1 THEN l.w2 WHEN 2 THEN upper(l.w2) ELSE 'all' END,
                 CASE o WHEN 1 THEN l.w2 WHEN 2 THEN upper(l.w2) ELSE 'all' END, o, left(a.w2, 1)
          FROM asked a JOIN leaf l ON lower(a.b) = lower(l.b) AND lower(a.w1) = lower(l.w1) AND lower(a.w2) = lower(l.w2),
               (VALUES (1), (2), (3)) v(o) WHERE request % 7 = 2
          UNION ALL
          SELECT request, 'flag', f, d, o, CASE WHEN request % 7 = 3 THEN '--v' ELSE '' END
          FROM asked, (VALUES (1, '--kinds', 'kinds'), (2, '--nation', 'Nation'), (3, '--verbose', 'More output'),
                              (4, '-n', 'Nation'), (5, '-v', 'More output')) v(o, f, d) WHERE request % 7 IN (3, 5)
          UNION ALL
          SELECT request, 'value', x, x, o, 't' FROM asked, (VALUES (1, 'true'), (2, 'false')) v(o, x) WHERE request % 7 = 4
        )
        SELECT request, kind, CAST(row_number() OVER (PARTITION BY request ORDER BY o) AS INTEGER) AS place, "insert", display
        FROM offered WHERE starts_with(lower("insert"), lower(cur))""",
}
