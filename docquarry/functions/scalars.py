"""Dynamic values in plain Python: text rendering, comparison and literals.

Numbers compare as doubles; everything else compares by its text.  This module is what the column
expressions of ``values`` are tested against, and what plan-time constants go through.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal
from typing import Any

MISSING = "<nil>"


def is_number(v: Any) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


def number_text(x: float) -> str:
    """Shortest digits; scientific from 1e+06 up and below 1e-04, with at least two exponent digits."""
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    point = len(digits) + exponent  # digits before the decimal point
    body = "".join(map(str, digits))
    if -4 <= point - 1 < 6:
        if point <= 0:
            text = "0." + "0" * -point + body
        elif point >= len(body):
            text = body + "0" * (point - len(body))
        else:
            text = f"{body[:point]}.{body[point:]}"
    else:
        e = point - 1
        text = body[0] + ("." + body[1:] if len(body) > 1 else "") + f"e{'-' if e < 0 else '+'}{abs(e):02d}"
    return "-" * sign + text


def text(v: Any) -> str:
    """The value as text: null and missing as <nil>, lists in brackets, maps with sorted keys."""
    if v is None:
        return MISSING
    if isinstance(v, bool):
        return "true" if v else "false"
    if is_number(v):
        return number_text(v)
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{text(x)}" for k, x in sorted(v.items())) + "]"
    if isinstance(v, (list, tuple)):
        return "[" + " ".join(map(text, v)) + "]"
    return str(v)


def compare(a: Any, b: Any) -> int:
    if is_number(a) and is_number(b):
        x, y = float(a), float(b)
    else:
        x, y = text(a).encode(), text(b).encode()
    return (x > y) - (x < y)


def equal(a: Any, b: Any) -> bool:
    if is_number(a) and is_number(b):
        return float(a) == float(b)
    return text(a) == text(b)


def literal(value: Any) -> Any:
    """A filter's value: JSON text is parsed, other text stands for itself, other values are taken as they are."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except ValueError:
        return value
