"""Header normalising and header-to-column rules, on the driver and as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin1_folding() -> tuple[str, str]:
    """Latin-1 letters that decompose to one ASCII character, and that character."""
    pairs = [
        (chr(c), base)
        for c in range(0xA0, 0x100)
        if len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c))
                               if not unicodedata.combining(x))) == 1
        and base != chr(c) and base.isascii()
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _latin1_folding()


def fold(text: str) -> str:
    """Driver side: strip accents and outer blanks, lower case."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).strip().lower()


def fold_col(text: Column) -> Column:
    """Column twin of :func:`fold` for Latin-1 text."""
    return F.lower(F.trim(F.translate(text, _FROM, _TO)))


def _holds(name: str, test: str) -> bool:
    if test.startswith("^^"):
        return name.replace(".", "").replace(" ", "").startswith(test[2:])
    kind, token = test[0], test[1:]
    return {"^": name.startswith(token), "~": token in name, "=": name == token}[kind]


def _holds_col(name: Column, test: str) -> Column:
    if test.startswith("^^"):
        return F.regexp_replace(name, "[. ]", "").startswith(test[2:])
    kind, token = test[0], test[1:]
    if kind == "^":
        return name.startswith(token)
    return name.contains(token) if kind == "~" else name == F.lit(token)


def map_headers(names: list[str], rules) -> dict[str, str]:
    """Driver side: raw column -> target; each target is given once, in column order."""
    out: dict[str, str] = {}
    for raw in names:
        name = fold(raw)
        free = (t for t, alts in rules
                if t not in out.values() and any(all(_holds(name, x) for x in alt) for alt in alts))
        if (target := next(free, None)) is not None:
            out[raw] = target
    return out


def map_headers_col(fields: Column, rules) -> Column:
    """Column twin: array of folded header fields -> array of targets ('' = unused)."""

    def matches(name: Column) -> Column:
        hits = []
        for target, alternatives in rules:
            hit = reduce(or_, [reduce(and_, [_holds_col(name, x) for x in alt])
                               for alt in alternatives])
            hits.append(F.when(hit, F.lit(target)))
        return F.array_compact(F.array(*hits))

    def assign(done: Column, candidates: Column) -> Column:
        free = F.get(F.filter(candidates, lambda t: ~F.array_contains(done, t)), F.lit(0))
        return F.concat(done, F.array(F.coalesce(free, F.lit(""))))

    return F.aggregate(F.transform(fields, matches), F.array().cast("array<string>"), assign)


def slug(text: Column) -> Column:
    """File-name form of a basin name."""
    return F.translate(F.lower(text), " -", "__")
