"""JSON texts read token by token: any nesting up to a limit, no recursion.

Values are rewritten as text straight away, so numbers can stay as they are written. Lone
surrogate escapes become U+FFFD, of repeated keys the last one counts.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

# Fixed value: deeper documents are refused.
MAX_DEPTH = 10_000

# Characters that are written as escapes inside JSON strings.
ESCAPES = (
    ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
    ("\u2028", "\\u2028"), ("\u2029", "\\u2029"),
)

_TOKEN = re.compile(
    r"[ \t\r\n]*(?:"
    r'(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    r"|(?P<word>true|false|null)"
    r"|(?P<mark>[\[\]{}:,])"
    r")"
)
_SURROGATE = re.compile("[\ud800-\udfff]")


def written_string(text: str) -> str:
    out = json.dumps(_SURROGATE.sub("�", text), ensure_ascii=False)
    for char, escape in ESCAPES:
        out = out.replace(char, escape)
    return out


def as_written(number: str) -> str:
    return number


def as_double(number: str) -> str:
    """The number as a 64-bit float prints: plain from 1e-6 up to 1e21, else with an exponent."""
    value = float(number)
    if math.isinf(value):
        raise ValueError(f"{number} is out of range")
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    digits, _, power = f"{value!r}".partition("e")
    if 1e-6 <= abs(value) < 1e21:
        if power:
            sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            whole, _, rest = digits.partition(".")
            move = int(power)
            if move < 0:
                return f"{sign}0.{'0' * (-move - 1)}{whole}{rest}"
            return f"{sign}{whole}{rest}{'0' * (move - len(rest))}"
        return digits.removesuffix(".0")
    if not power:  # Python prints these plainly
        whole, _, rest = f"{value:.17e}".partition("e")
        digits, power = f"{float(whole)!r}", rest
    shown = int(power)
    return f"{digits.removesuffix('.0')}e{'-' if shown < 0 else '+'}{abs(shown):02d}".replace("e-0", "e-")


def _object(fields: dict[str, str]) -> str:
    ordered = sorted(fields, key=lambda k: k.encode("utf-8"))
    return "{" + ",".join(f"{written_string(k)}:{fields[k]}" for k in ordered) + "}"


def rewrite(
    text: str, number: Callable[[str], str] = as_written, *, rest: bool = False
) -> tuple[str, dict[str, str] | None]:
    """(canonical text, its fields if it is an object): keys sorted, no spaces.

    Raises ValueError for anything else than one JSON value; with ``rest``, text may follow it.
    """
    open_: list[tuple[dict | list, str | None]] = []
    here: dict | list | None = None
    key: str | None = None
    state, at = "value", 0  # value | first (value or end) | key | firstkey | colon | more
    while True:
        token = _TOKEN.match(text, at)
        if not token:
            raise ValueError(f"no JSON at {at}")
        at, kind, part = token.end(), token.lastgroup, token[token.lastgroup]
        done: str | None = None
        fields: dict[str, str] | None = None
        if state in ("value", "first") and kind != "mark":
            done = part if kind == "word" else number(part) if kind == "number" else written_string(json.loads(part))
        elif state in ("value", "first") and part in "[{":
            if len(open_) >= MAX_DEPTH:
                raise ValueError("nested too deeply")
            open_.append((here, key))
            here, key, state = ([], None, "first") if part == "[" else ({}, None, "firstkey")
            continue
        elif state in ("key", "firstkey") and kind == "string":
            key, state = _SURROGATE.sub("�", json.loads(part)), "colon"
            continue
        elif state == "colon" and part == ":":
            state = "value"
            continue
        elif state == "more" and part == ",":
            state = "value" if isinstance(here, list) else "key"
            continue
        elif part == "]" and isinstance(here, list) and state in ("first", "more"):
            done = "[" + ",".join(here) + "]"
            here, key = open_.pop()
        elif part == "}" and isinstance(here, dict) and state in ("firstkey", "more"):
            done, fields = _object(here), here
            here, key = open_.pop()
        else:
            raise ValueError(f"unexpected {part} at {at}")
        if here is None:
            if not rest and text[at:].strip(" \t\r\n"):
                raise ValueError(f"text behind the value at {at}")
            return done, fields
        if isinstance(here, list):
            here.append(done)
        else:
            here[key] = done
        state = "more"
