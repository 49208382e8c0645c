"""JSON payloads: compaction, canonical form, envelopes, redaction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.json_text import ESCAPES, as_double, rewrite, written_string
from runlens.functions.text import as_col

# Fixed value: what a hidden value is replaced by.
SECRET = "[secret]"


def escape_markup(text: Column) -> Column:
    """These characters can only occur inside strings of valid JSON."""
    for char, escape in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def _valid(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        rewrite(text)
    except ValueError:
        return False
    return True


def _valid_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_valid)


def is_json(payload: str | Column) -> Column:
    """Whether a text is exactly one JSON value; repeated keys are fine.

    A text that reads as the only item of an array and as the only member of an object is one.
    Only texts that fail there (repeated keys, deep nesting, very large numbers, or no JSON) go
    through the reader in Python.
    """
    text = as_col(payload)
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    plain = in_array.isNotNull() & in_object.isNotNull()
    read = F.pandas_udf(_valid_batches, "boolean")(F.when(~plain, text))
    return F.when(text.isNotNull(), F.coalesce(read, plain)).otherwise(False)


def compact_json(payload: str | Column) -> Column:
    """Drop white space outside strings; number and string text stay as written."""
    bare = F.regexp_replace(as_col(payload), r'("(?:[^"\\]++|\\.)*+")|[ \t\r\n]+', "$1")
    return escape_markup(bare)


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return rewrite(text, rest=True)[0]
    except ValueError:
        return None


def _canonical_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_canonical)


def canonical_json(body: str | Column) -> Column:
    """Keys sorted at every level, no spaces, number text as written; null when invalid.

    VARIANT would rewrite ``1.50`` as ``1.5``, so this one step runs in Arrow batches.
    """
    return F.pandas_udf(_canonical_batches, "string")(as_col(body))


def canonical_hash(body: str | Column) -> Column:
    return F.sha2(canonical_json(body), 256)


def _enveloped(run_id: str | None, payload: str | None) -> str | None:
    if not run_id or payload is None:
        return payload
    try:
        fields = rewrite(payload, as_double)[1]
    except ValueError:
        fields = None
    if fields is None:
        fields = {"data": written_string(payload)}
    fields["run_id"] = written_string(run_id)
    return "{" + ",".join(f"{written_string(k)}:{fields[k]}" for k in sorted(fields, key=str.encode)) + "}"


def _enveloped_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for run_ids, payloads in batches:
        pairs = zip(run_ids, payloads, strict=True)
        yield pd.Series([_enveloped(r, p) for r, p in pairs], dtype=object)


def global_envelope(run_id: str | Column, payload: str | Column) -> Column:
    """Put ``run_id`` into an event object; a payload that is no object is wrapped.

    Keys come out sorted, the last of repeated ones counts, and numbers are read as 64-bit floats
    (one out of range makes the payload text). A null payload stays null.
    """
    wrap = F.pandas_udf(_enveloped_batches, "string")
    return wrap(as_col(run_id).cast("string"), as_col(payload))


def redact_args(args: str | Column, secret_names: str | Column) -> Column:
    """Hide the values of secret-named keys in MAP<STRING,STRING> arguments."""
    names = as_col(secret_names)
    return F.transform_values(
        as_col(args),
        lambda k, v: F.when(F.array_contains(names, k), F.lit(SECRET)).otherwise(v),
    )


def redact_line(line: str | Column, secrets: str | Column) -> Column:
    """Replace every non-empty secret in a line, in list order."""
    return F.aggregate(
        F.filter(F.coalesce(as_col(secrets), F.array().cast("array<string>")), lambda s: s != ""),
        as_col(line),
        lambda text, secret: F.replace(text, secret, F.lit(SECRET)),
    )
