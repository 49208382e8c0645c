"""Step graphs: lint per config, unknown ``needs`` as a table job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.quantities import step_image
from runlens.functions.text import is_blank, trim_ws

# Problem codes.
CONFIG_ERROR = "E_CONFIG"
POLICY_ERROR = "E_POLICY"

_PROBLEM = "struct<code:string,detail:string>"


def is_step_graph(composition: Column, steps: Column) -> Column:
    return (F.coalesce(F.size(steps), F.lit(0)) > 0) & F.coalesce(
        F.lower(trim_ws(composition)) == "steps", F.lit(False)
    )


def _problem(code: str, *parts: str | Column) -> Column:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.struct(F.lit(code).alias("code"), text.alias("detail"))


def has_container_settings(c: Column) -> Column:
    def filled(text: Column) -> Column:
        return ~is_blank(text)

    def some(items: Column) -> Column:
        return F.coalesce(F.size(items), F.lit(0)) > 0

    return c.isNotNull() & (
        filled(c["image"]) | filled(c["resources"]["cpu"]) | filled(c["resources"]["memory"])
        | filled(c["network"]) | F.coalesce(c["rootfs_writable"], F.lit(False))
        | some(c["capabilities"]) | some(c["extra_args"]) | some(c["entrypoint"])
    )


def graph_problem(
    interpreter: Column, executor: Column, composition: Column, container: Column, steps: Column
) -> Column:
    """First problem of a step graph config, null when fine or no step graph.

    A config is one row, so its steps are checked in place. Step problems are found step by
    step; ``needs`` are looked at once every step is fine by itself.
    """
    run_by = F.lower(trim_ws(F.coalesce(executor, F.lit(""))))
    ids = F.transform(steps, lambda s: F.coalesce(trim_ws(s["id"]), F.lit("")))

    def step_problem(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("steps["), i.cast("string"), F.lit("]: "))
        own = F.coalesce(trim_ws(s["id"]), F.lit(""))
        seen = F.array_contains(F.slice(ids, F.lit(1), i), own)
        return (
            F.when(is_blank(s["script"]), _problem(CONFIG_ERROR, at, "script is required"))
            .when(
                ~is_blank(s["executor"]),
                _problem(POLICY_ERROR, at, "step-level executor is not permitted; set executor on job"),
            )
            .when((own != "") & seen, _problem(CONFIG_ERROR, at, "duplicate step id"))
            .when(
                (run_by == "proc") & has_container_settings(s["container"]),
                _problem(CONFIG_ERROR, at, "container settings are not allowed when executor is proc"),
            )
            .when(
                (run_by == "container") & (step_image(s["container"]["image"], container["image"]) == ""),
                _problem(CONFIG_ERROR, at, "container image must be specified at job or step level"),
            )
        )

    def need_problems(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("steps["), i.cast("string"), F.lit("]: "))
        needs = F.transform(F.coalesce(s["needs"], F.array().cast("array<string>")), lambda n: trim_ws(n))
        lost = F.filter(needs, lambda n: (n != "") & ~F.array_contains(ids, n))
        return F.when(
            F.size(lost) > 0,
            _problem(CONFIG_ERROR, at, "needs references unknown step: ", F.get(lost, F.lit(0))),
        )

    def first(check) -> Column:
        return F.get(F.array_compact(F.transform(steps, check)), F.lit(0))

    whole = (
        F.when(
            F.lower(trim_ws(F.coalesce(interpreter, F.lit("")))).startswith("container:"),
            _problem(CONFIG_ERROR, "interpreter container form is not allowed in DAG composition"),
        )
        .when(run_by == "", _problem(CONFIG_ERROR, "executor is required for DAG jobs"))
        .when(
            ~run_by.isin("proc", "container"),
            _problem(CONFIG_ERROR, "executor must be proc or container for DAG jobs"),
        )
    )
    return F.when(
        is_step_graph(composition, steps), F.coalesce(whole, first(step_problem), first(need_problems))
    )


def missing_needs(needs: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """``needs(keys, step, need)`` without a matching ``steps(keys, step)``; blanks are skipped."""
    targets = steps.select(*keys, F.col("step").alias("need"))
    asked = needs.filter(F.col("need").isNotNull() & (F.trim(F.col("need").cast("string")) != ""))
    return asked.join(targets, [*keys, "need"], "left_anti")
