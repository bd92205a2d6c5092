"""Regular expressions of linear-time syntax, rewritten for java.util.regex.

Constructs that need backtracking are invalid, as they are in linear-time engines, though Java's matcher, which takes the rest, has no
such bound on its time; ``$`` without
the m flag is the end of the text, a dot leaves out line feeds only, and the i flag folds Unicode.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


def translate(pattern: str) -> str | None:
    """The Java pattern, or None if the pattern is invalid."""
    out, i, inside, multi = [], 0, False, False
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            if len(rest) < 2 or (not inside and re.match(r"\\[1-9kGZXRhHC]", rest)):
                return None
            if rest.startswith("\\Q"):
                end = rest.find("\\E")
                word = rest[2:] if end < 0 else rest[2:end]
                out.append(re.escape(word))
                i += len(word) + (2 if end < 0 else 4)
                continue
            out.append(rest[:2])
            i += 2
        elif inside:
            if m := re.match(r"\[:(\^?)(\w+):\]", rest):
                if m[2] not in _POSIX and m[2] != "word":
                    return None
                name = "\\w" if m[2] == "word" else f"\\p{{{_POSIX[m[2]]}}}"
                out.append((name.replace("\\w", "\\W").replace("\\p", "\\P")) if m[1] else name)
                i += len(m[0])
                continue
            if c == "]" and not pattern[:i].endswith(("[", "[^")):
                inside = False
            out.append("\\" + c if c in "[&~" or (c == "]" and inside) else c)
            i += 1
        elif c == "[":
            inside = True
            m = re.match(r"\[\^?", rest)
            out.append(m[0])
            i += len(m[0])
        elif rest.startswith("(?"):
            if m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest):
                out.append(f"(?<{m[1].replace('_', 'U')}>")
            elif m := re.match(r"\(\?([ims]*)(-[ims]+)?([:)])", rest):
                multi |= "m" in m[1]
                out.append(f"(?{m[1].replace('i', 'iu')}{m[2] or ''}{m[3]}")
            else:
                return None
            i += len(m[0])
        elif c == "$":
            out.append("$" if multi else "\\z")
            i += 1
        elif m := re.match(r"([*+?]|\{\d+(?:,\d*)?\})(\??)([*+])?", rest):
            if m[3]:
                return None
            out.append(m[1] + m[2])
            i += len(m[0])
        else:
            out.append(c)
            i += 1
    return None if inside else "(?d)" + "".join(out)


def compiled(spark: SparkSession, pattern: str) -> str | None:
    """A pattern that Java accepts, or None."""
    java = translate(pattern)
    if java is None:
        return None
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # noqa: BLE001  PatternSyntaxException through the gateway
        return None
    return java


def found(spark: SparkSession, pattern: str, text: str) -> bool:
    """Whether the pattern occurs in one text; an invalid one doesn't."""
    java = compiled(spark, pattern)
    return java is not None and spark.sparkContext._jvm.java.util.regex.Pattern.compile(java).matcher(text).find()
