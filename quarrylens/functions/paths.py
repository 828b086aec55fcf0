"""Path and text helpers as columns, and the small languages (globs, windows, patterns) that become them."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def dir_of(path: Column) -> Column:
    """Everything before the last slash; "" for a file at the root."""
    base = base_of(path)
    return F.when(base == path, "").otherwise(F.substring(path, F.lit(1), F.length(path) - F.length(base) - 1))


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """From the last dot of the name, in lower case; a name that is all extension is one."""
    base = base_of(path)
    tail = F.substring_index(base, ".", -1)
    return F.when(tail == base, "").otherwise(F.lower(F.concat(F.lit("."), tail)))


def stem_of(path: Column) -> Column:
    base = base_of(path)
    tail = F.substring_index(base, ".", -1)
    return F.when(tail == base, base).otherwise(F.substring(base, F.lit(1), F.length(base) - F.length(tail) - 1))


def top_segment(path: Column) -> Column:
    """First segment, or "." for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def under(path: Column, directory: str) -> Column:
    """Subtree membership; "" and "." are the whole tree."""
    clean = directory.strip("/")
    return F.lit(True) if clean in ("", ".") else path.startswith(clean + "/")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def all_tokens_in(text: Column, query: str) -> Column:
    """Whether every white-space token of the query is a substring, ignoring case."""
    cond = F.lit(True)
    for token in query.lower().split():
        cond = cond & F.lower(text).contains(token)
    return cond


def soft_cap(score: Column) -> Column:
    """Sums up to 0.8 stay; the rest approaches 1."""
    return F.when(score <= 0.8, score).otherwise(0.8 + 0.2 * (1 - F.exp(-(score - 0.8) / 1.5)))


def soft_cap_value(score: float) -> float:
    return score if score <= 0.8 else 0.8 + 0.2 * (1 - math.exp(-(score - 0.8) / 1.5))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path pattern; `**` crosses slashes, `*` and `?` don't."""
    out, i = ["^"], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.+/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out.append("[^" + inner[1:] + "]" if inner[0] == "!" else f"[{inner}]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out) + "$"


def since_start(since: str, now: dt.datetime) -> dt.datetime:
    """Start of a window: "" is a week; 3d, 2w, 6m and 1y count back; else an ISO date."""
    if not since:
        return now - dt.timedelta(days=7)
    m = re.fullmatch(r"(\d+)([dwmy])", since)
    if not m:
        return dt.datetime.fromisoformat(since)
    n, unit = int(m[1]), m[2]
    if unit in "dw":
        return now - dt.timedelta(days=n * (7 if unit == "w" else 1))
    months = now.year * 12 + now.month - 1 - n * (12 if unit == "y" else 1)
    year, month = divmod(months, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


META = set(r".*+?()[]{}|^$\\")


class BadPattern(ValueError):
    """A pattern that is empty, broken, or outside the shared regular expression subset."""


def has_upper(pattern: str) -> bool:
    """An upper-case letter that isn't part of an escape such as \\W."""
    return any(c.isupper() for c in re.sub(r"\\.", "", pattern))


def matcher(pattern: str, case: str = "smart") -> tuple[str, str, bool]:
    """("literal" or "regex", pattern for Spark, whether case counts).

    Lookaround and back references are refused, as they have no linear-time matcher.
    """
    if not pattern:
        raise BadPattern("empty pattern")
    if case not in ("smart", "sensitive", "insensitive"):
        raise BadPattern(f"unknown case mode {case}")
    sensitive = case == "sensitive" or (case == "smart" and has_upper(pattern))
    if not META & set(pattern):
        return "literal", pattern, sensitive
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+", pattern):
        raise BadPattern("lookaround, back references and possessive quantifiers aren't supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise BadPattern(str(e)) from e
    end = re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\z", pattern)
    return "regex", end if sensitive else f"(?iu){end}", sensitive


def whole_text_form(pattern: str, sensitive: bool) -> str | None:
    """A pattern that holds for every text with a matching line, "" free of line anchors' meaning; None where there is none."""
    if re.search(r"\\[AZzG]|\(\?[a-zA-Z]*-", pattern):
        return None
    return f"(?{'md' if sensitive else 'mdiu'}){pattern}"


def matches(text: Column, pattern: str, case: str = "smart") -> Column:
    kind, form, sensitive = matcher(pattern, case)
    if kind == "regex":
        return text.rlike(form)
    return text.contains(form) if sensitive else F.lower(text).contains(form.lower())
