"""Glob patterns and path queries as Column predicates.

`*` and `?` cross slashes, letters match in either ASCII case. A pattern becomes the cheapest predicate that decides it:
equality, a prefix, a suffix or an infix over the lower-cased path where its only wildcards are stars at its ends, and a
regular expression otherwise (one that Java and RE2 read alike).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = frozenset("*?{[")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class BadPattern(ValueError):
    """A glob that can't be read."""


class NotFound(LookupError):
    """A literal path that names neither a folder nor a file."""


def ascii_lower(path: Column) -> Column:
    return F.translate(path, _UPPER, _UPPER.lower())


def is_glob(text: str) -> bool:
    return not WILD.isdisjoint(text)


def anchored(query: str) -> str:
    """A pattern that matches at any depth, unless it starts with a slash or says so itself."""
    if query.startswith("/"):
        return query.lstrip("/")
    return query if query.startswith("**/") else f"**/{query}"


def _class(pattern: str, at: int) -> tuple[str, int]:
    """The regular expression of the class that opens at `at`, and where it ends."""
    k = at + 1
    negated = pattern[k : k + 1] in ("!", "^")
    k += negated
    items, first = [], True
    while True:
        if k >= len(pattern):
            raise BadPattern(f"a class isn't closed: {pattern}")
        c = pattern[k]
        if c == "]" and not first:
            break
        first = False
        if pattern[k + 1 : k + 2] == "-" and pattern[k + 2 : k + 3] not in ("", "]"):
            low, high = c, pattern[k + 2]
            if low > high:
                raise BadPattern(f"a range runs backwards: {pattern}")
            items.append(f"{re.escape(low)}-{re.escape(high)}")
            k += 3
        else:
            items.append(re.escape(c))
            k += 1
    return f"[{'^' if negated else ''}{''.join(items)}]", k + 1


def to_regex(pattern: str) -> str:
    """A whole-path regular expression, of the subset that Java and RE2 share."""
    out, k, depth = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**", k):
            start, end = k == 0 or pattern[k - 1] == "/", k + 2
            if start and k == 0 and pattern[end : end + 1] == "/":
                out.append("(?:/?|.*/)")
                k = end + 1
            elif start and k > 0 and pattern[end : end + 1] == "/":
                out[-1] = "(?:/|/.*/)"
                k = end + 1
            elif start and end == len(pattern) and k > 0:
                out[-1] = "/.*"
                k = end
            else:
                out.append(".*")
                k = end
        elif c == "*":
            out.append(".*")
            k += 1
        elif c == "?":
            out.append(".")
            k += 1
        elif c == "[":
            piece, k = _class(pattern, k)
            out.append(piece)
        elif c == "{":
            depth += 1
            out.append("(?:")
            k += 1
        elif c == "}":
            if not depth:
                raise BadPattern(f"an alternation isn't open: {pattern}")
            depth -= 1
            out.append(")")
            k += 1
        elif c == "," and depth:
            out.append("|")
            k += 1
        elif c == "\\":
            if k + 1 == len(pattern):
                raise BadPattern(f"a dangling escape: {pattern}")
            out.append(re.escape(pattern[k + 1]))
            k += 2
        else:
            out.append(re.escape(c))
            k += 1
    if depth:
        raise BadPattern(f"an alternation isn't closed: {pattern}")
    return f"(?is)^{''.join(out)}$"


def glob(path: Column, pattern: str) -> Column:
    """Whether a path matches; null where the path is."""
    low = ascii_lower(path)
    body = pattern.lower() if pattern.isascii() else None
    if body is not None and "\\" not in body:
        inner = body.strip("*")
        deep = body.startswith("**/") and not is_glob(body[3:])
        if deep:  # a name at any depth
            return (low == body[3:]) | low.endswith(f"/{body[3:]}")
        if not is_glob(inner) and "/**" not in body and "**/" not in body and "}" not in body:
            head, tail = body.startswith("*"), body.endswith("*")
            if not head and not tail:
                return low == body
            if not inner:
                return path.isNotNull()
            return F.contains(low, F.lit(inner)) if head and tail else low.endswith(inner) if head else low.startswith(inner)
        if body.startswith("**/*") and not is_glob(body[4:]) and "}" not in body:
            return low.endswith(body[4:])
    return path.rlike(to_regex(pattern))


@dataclass(frozen=True)
class PathQuery:
    """A parsed query: a glob, or a literal path that is a folder or else a file."""

    text: str
    pattern: str | None

    @classmethod
    def parse(cls, query: str) -> PathQuery:
        if not is_glob(query):
            return cls(query, None)
        pattern = anchored(query)
        to_regex(pattern)  # bad patterns are told here
        return cls(query, pattern)

    @property
    def glob(self) -> bool:
        return self.pattern is not None

    def parts(self) -> list[str]:
        return [p for p in re.split(r"[/\\]", self.text.lower()) if p]

    def folder(self, folder_key: Column) -> Column:
        """Whether a file's folder (lower-cased components) is this one or lies in it; no components: the whole tree."""
        want = self.parts()
        return F.slice(folder_key, 1, len(want)) == F.array(*map(F.lit, want)) if want else F.lit(True)

    def file(self, path: Column) -> Column:
        return F.translate(F.lower(path), "\\", "/") == self.text.lower().replace("\\", "/")


def hex_range(prefix: str) -> tuple[int, int]:
    """The signed 64-bit values whose 16 upper-case hex digits start with a prefix of 1 to 16 digits, as a range."""
    if not re.fullmatch(r"[0-9A-Fa-f]{1,16}", prefix):
        raise ValueError(f"not a prefix of hex digits: {prefix}")
    low, high = int(prefix.ljust(16, "0"), 16), int(prefix.ljust(16, "F"), 16)
    return tuple(v - (1 << 64) if v >= 1 << 63 else v for v in (low, high))


def hash_prefix(h: Column, prefix: str) -> Column:
    """A hex prefix of a hash as a range over its bits, which the scan's statistics can use; a prefix never spans the sign."""
    if not prefix:
        return h.isNotNull()
    if not re.fullmatch(r"[0-9A-Fa-f]{1,16}", prefix):
        return F.lit(False)
    low, high = hex_range(prefix)
    return h.between(low, high)
