"""Regular expressions of linear-time engines, written for Java's.

The dialect has no look-around and no back references; its classes are Unicode's, a dot excludes only a line feed, and ``$`` is the end of
the text. What Java would read otherwise is rewritten, and what only Java knows is refused.
"""

from __future__ import annotations

import re

#: The named ASCII classes.
ASCII_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_SAME_ESCAPES = frozenset("dDwWsSbBAznrtfa") | frozenset(r"\.+*?()|[]{}^$-/#&~ '\"<>%,:;=@!`")
_TOKEN = re.compile(r"\\p\{\^?[^}]*\}|\\P\{[^}]*\}|\\x\{[0-9A-Fa-f]+\}|\\u\{[0-9A-Fa-f]+\}|\\.|\[:\^?\w+:\]|\(\?P?<[A-Za-z_][\w.\[\]]*>|\(\?[A-Za-z-]*[:)]|\(\?|.", re.S)


def _escape(t: str) -> str:
    c = t[1]
    if c in "pP" and t[2:3] == "{":
        name, negative = t[3:-1], c == "P"
        if name.startswith("^"):
            name, negative = name[1:], not negative
        if "=" not in name and len(name) > 2 and not name.startswith("Is"):
            name = f"Is{name}"
        return f"\\{'P' if negative else 'p'}{{{name}}}"
    if c in "xu" and t[2:3] == "{":
        return f"\\x{t[2:]}"
    if c == "v":
        return r"\x0B"
    if c in "xupP" or c in _SAME_ESCAPES:
        return t
    raise ValueError(f"unrecognized escape sequence {t}")


def java_pattern(pattern: str) -> str:
    """The same expression for ``rlike``; raises ValueError where the dialect has no such expression."""
    out, depth, multiline = [], 0, re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    for m in _TOKEN.finditer(pattern):
        t = m[0]
        if t[0] == "\\":
            if len(t) < 2:
                raise ValueError("incomplete escape sequence")
            out.append(_escape(t))
        elif depth and t.startswith("[:"):
            name = t[2:-2]
            if (known := ASCII_CLASSES.get(name.removeprefix("^"))) is None:
                raise ValueError(f"unrecognized class {t}")
            out.append(f"[^{known}]" if name.startswith("^") else known)
        elif depth:
            depth += (t == "[") - (t == "]" and not _opening(out))
            out.append(r"\]" if t == "]" and _opening(out) else t)
        elif t[0] == "[":
            depth = 1
            out.append("[")
            out += list(t[1:])
        elif t.startswith("(?"):
            if t == "(?":
                raise ValueError("look-around is not supported")
            out.append("(" if "<" in t else _flags(t))
        elif t == "$" and not multiline:
            out.append(r"\z")
        elif t == "+" and out and out[-1] in ("*", "+"):
            continue  # repeated again, not possessive
        elif t == "+" and out and out[-1] in ("?", "}"):
            raise ValueError("a repetition of a repetition needs a group")
        else:
            out.append(t)
    return "(?dU)" + "".join(out)


def _opening(out: list[str]) -> bool:
    """Whether the class has only begun, so that a closing bracket is one of its characters."""
    return out[-1] == "[" or out[-1] == "^" and out[-2] == "["


def _flags(t: str) -> str:
    """Of an inline group of flags: swapped greed has no counterpart, the Unicode flag holds anyway, R is the default."""
    flags = t[2:-1]
    if "U" in flags or "x" in flags:
        raise ValueError(f"flags {flags} are not supported")
    kept = flags.replace("u", "").replace("R", "")
    return f"(?{kept}{t[-1]}" if kept or t[-1] == ":" else ""


def checked_pattern(pattern: str) -> str:
    """``java_pattern``, compiled once by the engine that will run it."""
    from pyspark.sql import SparkSession

    made = java_pattern(pattern)
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(made)
        except Exception as e:  # noqa: BLE001  any refusal of the compiler
            raise ValueError(f"{pattern}: {str(e).splitlines()[0][:200]}") from e
    return made
