"""CPU and memory quantities, image references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import as_col, non_blank, quoted, trim_ws, whole_match

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"

# Memory suffixes, longest first, all binary multiples.
MEMORY_UNITS = {
    "gib": 1 << 30, "gi": 1 << 30, "g": 1 << 30,
    "mib": 1 << 20, "mi": 1 << 20, "m": 1 << 20,
    "kib": 1 << 10, "ki": 1 << 10, "k": 1 << 10,
}
DEFAULT_REGISTRY = "docker.io"


def _decimal(text: Column) -> Column:
    return F.when(whole_match(text, _DECIMAL), text.try_cast("double"))


def _milli(value: Column) -> tuple[Column, Column, Column]:
    text = F.lower(trim_ws(F.coalesce(value, F.lit(""))))
    milli = text.endswith("m")
    number = F.when(milli, trim_ws(F.regexp_replace(text, "m$", ""))).otherwise(text)
    return text, milli, number


def cpu_millicores(value: str | Column) -> Column:
    """``500m`` or cores to millicores, rounded half away from zero; null when invalid."""
    _, milli, number = _milli(as_col(value))
    whole = F.when(whole_match(number, _INTEGER), number.try_cast("bigint"))
    cores = F.round(_decimal(number) * 1000).cast("bigint")
    amount = F.when(milli, whole).otherwise(cores)
    return F.when(amount >= 0, amount)


def cpu_error(value: str | Column) -> Column:
    """Why a CPU text is refused (null when it is fine)."""
    v = as_col(value)
    text, milli, number = _milli(v)
    whole = F.when(whole_match(number, _INTEGER), number.try_cast("bigint"))
    cores = _decimal(number)
    return (
        F.when(text == "", "empty cpu value")
        .when(milli & (number == ""), F.concat(F.lit("invalid millicores value "), quoted(v)))
        .when(milli & whole.isNull(), F.concat(F.lit("parse millicores "), quoted(v)))
        .when(~milli & cores.isNull(), F.concat(F.lit("parse cores "), quoted(v)))
        .when((milli & (whole < 0)) | (~milli & (cores < 0)), "cpu value must be positive")
    )


def _memory(value: Column) -> tuple[Column, Column, Column]:
    text = F.lower(trim_ws(F.coalesce(value, F.lit(""))))
    unit = F.regexp_extract(text, "(gib|gi|g|mib|mi|m|kib|ki|k)$", 1)
    number = F.when(unit != "", trim_ws(F.regexp_replace(text, "(gib|gi|g|mib|mi|m|kib|ki|k)$", "")))
    pairs = [F.lit(x) for suffix, scale in MEMORY_UNITS.items() for x in (suffix, scale)]
    scale = F.coalesce(F.element_at(F.create_map(*pairs), unit), F.lit(1))
    return text, F.coalesce(number, text), scale


def memory_bytes(value: str | Column) -> Column:
    """Memory text to bytes; null when invalid or negative."""
    _, number, scale = _memory(as_col(value))
    amount = F.round(_decimal(number) * scale).cast("bigint")
    return F.when(_decimal(number) >= 0, amount)


def memory_error(value: str | Column) -> Column:
    v = as_col(value)
    text, number, _ = _memory(v)
    return (
        F.when(text == "", "empty memory value")
        .when(number == "", F.concat(F.lit("invalid memory value "), quoted(v)))
        .when(_decimal(number).isNull(), F.concat(F.lit("parse memory "), quoted(v)))
        .when(_decimal(number) < 0, "memory value must be positive")
    )


def memory_text(size: str | Column) -> Column:
    b = as_col(size)
    mib = 1 << 20
    return F.when(
        b % mib == 0, F.concat((b / mib).cast("bigint").cast("string"), F.lit("Mi"))
    ).otherwise(F.concat(b.cast("string"), F.lit(" bytes")))


def image_error(image: str | Column) -> Column:
    text = trim_ws(F.coalesce(as_col(image), F.lit("")))
    return (
        F.when(text == "", "empty image reference")
        .when(text.contains("://"), "image reference must not include scheme")
        .when(text.startswith("/"), "image reference must not start with slash")
    )


def image_registry(image: str | Column) -> Column:
    """Registry host of an image reference; null when the reference is invalid."""
    text = trim_ws(as_col(image))
    first = F.split_part(text, F.lit("/"), F.lit(1))
    named = first.contains(".") | first.contains(":") | (first == "localhost")
    return F.when(
        image_error(image).isNull(), F.when(named, F.lower(first)).otherwise(DEFAULT_REGISTRY)
    )


def pin_digest(ref: str | Column, digest: str | Column) -> Column:
    base = trim_ws(F.substring_index(as_col(ref), "@", 1))
    return F.concat(base, F.lit("@"), as_col(digest))


def container_image(image: Column, interpreter: Column) -> Column:
    """Configured image, else what follows ``container:`` in the interpreter, else empty."""
    inline = F.when(
        interpreter.startswith("container:"), trim_ws(F.substr(interpreter, F.lit(11)))
    )
    return F.coalesce(non_blank(image), inline, F.lit(""))


def step_image(step: Column, job: Column) -> Column:
    return F.coalesce(non_blank(step), trim_ws(job), F.lit(""))


def executor_mode(executor: Column, interpreter: Column) -> Column:
    """Configured executor, else ``container`` for such an interpreter, else ``shell``."""
    return F.coalesce(
        F.when(executor != "", F.lower(executor)),
        F.when(interpreter.startswith("container:"), "container"),
        F.lit("shell"),
    )


def quantity_facts(cpu: Column, memory: Column) -> Column:
    """Both quantities of a request, parsed once: amounts, errors, and whether they are asked."""
    cpu_asked, memory_asked = non_blank(cpu).isNotNull(), non_blank(memory).isNotNull()
    return F.struct(
        cpu_asked.alias("cpu_asked"),
        F.when(cpu_asked, cpu_millicores(cpu)).alias("cpu"),
        F.when(cpu_asked, cpu_error(cpu)).alias("cpu_error"),
        memory_asked.alias("memory_asked"),
        F.when(memory_asked, memory_bytes(memory)).alias("memory"),
        F.when(memory_asked, memory_error(memory)).alias("memory_error"),
    )


def image_facts(image: Column) -> Column:
    """Registry and error of an image reference, worked out once."""
    return F.struct(image_registry(image).alias("registry"), image_error(image).alias("error"))
