"""Shell-style globs as regular expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def glob_regex(glob: str) -> str:
    """The Java and Python regex of one glob: * (also across /), ?, [set], [!set]; nothing else is special."""
    out, i = [], 0
    while i < len(glob):
        ch, i = glob[i], i + 1
        if ch == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body, i = glob[i:end], end + 1
            inverse, body = body[0] == "!", body.removeprefix("!")
            out.append("[" + "^" * inverse + re.sub(r"([\\\[\]^&~|])", r"\\\1", body) + "]")
        else:
            out.append(re.sub(r"([^\w/ -])", r"\\\1", ch, flags=re.ASCII) if ord(ch) < 128 else ch)
    return "".join(out)


def globs_regex(globs: Column | str) -> Column:
    """One regex for an array of globs, anchored at both ends; null where there are none."""

    def one(g: list[str] | None) -> str | None:
        known = sorted({x for x in g if x}) if g is not None else []
        return "(?s)^(?:" + "|".join(map(glob_regex, known)) + ")$" if known else None

    def each(part: pd.Series) -> pd.Series:
        return part.map(one)

    each.__annotations__ = {"part": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, T.StringType())(globs)


def split_by_globs(paths: Column, regex: Column) -> Column:
    """struct(included, excluded): the paths that no glob covers, and the others; a null regex covers none."""
    hit = lambda p: F.coalesce(F.rlike(p, regex), F.lit(False))
    return F.struct(F.filter(paths, lambda p: ~hit(p)).alias("included"), F.filter(paths, hit).alias("excluded"))
