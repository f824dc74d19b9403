"""The name that a source line declares: a scan over words with state, so an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists in alphabetical order.
MODIFIERS = frozenset(
    "abstract async const constexpr data declare default export extern final inline internal open override partial private protected pub public readonly sealed static unsafe virtual".split()
)
KEYWORDS = frozenset(
    "class const def defn enum fn func function impl interface macro_rules! mod module namespace object proc protocol record static struct sub trait type typedef union".split()
)
CONTROL = frozenset(
    "await case catch defer do elif else except for foreach function go if loop match new return select sizeof super switch this throw try typeof unless until while with yield".split()
)
_LEAD = re.compile(r"^[^\W]*")


def _named(word: str) -> str | None:
    name = _LEAD.match(word).group()
    return name if _is_name(name) else None


def _is_name(name: str) -> bool:
    first = name[:1]
    return len(name.encode()) >= 2 and (first == "_" or first.isalpha()) and all(c == "_" or c.isalnum() for c in name)


def declared_name(line: str | None) -> str | None:
    """The declared identifier, or None for comments, calls and control flow."""
    text = (line or "").lstrip()
    if text.startswith(("//", "#", "*")):
        return None
    words = text.split()
    bare = [w.partition("(")[0] for w in words]
    i = 0
    while i < len(words) and bare[i] in MODIFIERS:
        follows = i + 1 < len(words) and (bare[i + 1] in KEYWORDS or bare[i + 1] in MODIFIERS)
        if not follows and bare[i] in KEYWORDS:
            break  # `const NAME`: the word is the keyword itself
        i += 1
    if i >= len(words):
        return None
    head, rest = words[i], words[i + 1 :]
    keyword = re.split(r"[<(]", head, maxsplit=1)[0]
    if keyword == "impl":
        if "for" in rest:
            target = rest[rest.index("for") + 1 :]
        else:
            skip = 0
            if "<" in head and not head.endswith(">"):  # bounds spread over several words
                skip = next((k + 1 for k, w in enumerate(rest) if w.endswith(">")), 0)
            target = rest[skip:]
        return _named(target[0]) if target else None
    if keyword in KEYWORDS:
        target = rest[:1] if rest and rest[0] != "mut" else rest[1:2]
        return _named(target[0]) if target else None
    if text.endswith("{"):
        for word in words[i : i + 2]:
            if "(" in word:
                name = word.partition("(")[0].partition("<")[0]
                return name if _is_name(name) and name not in CONTROL else None
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def declared_names(rows: pd.Series) -> pd.Series:
    """Names declared on the lines of each text, in order, repeats kept."""
    return rows.map(lambda text: [n for line in (text or "").split("\n") if (n := declared_name(line))])
