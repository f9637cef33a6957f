"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked until the sums by source, by
language and by topic meet their targets; documents are then sampled with probabilities
calibrated so that the expected tokens have these margins and the wanted total.

Cells lie in one row per source. Sources may be many; languages and topics are few, at most
``MOST_VALUES`` each (checked). A round scales every source inside its own row, adds the
result up by (language, topic) and scales that small table by language and by topic, so it
is one aggregation. Only that table and its factors come to the driver.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.session import join_small

from .common import stored

MOST_VALUES = 1000
MET = 1e-6      # margins that the last round changed by no more are met
DIMENSIONS = ("source", "lang", "topic")
# Exponents: a target share is in proportion to tokens to this power; below one it lifts the small.
TEMPERED = {"source": 0.7, "lang": 0.5, "topic": 0.5}


class UnattainableMargins(ValueError):
    """Targets that the non-empty cells cannot meet."""


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def form_topic(text: Column, words: Column) -> Column:
    """A topic for tables that have none: tables, marked-up text, or prose by length."""
    def times(c: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(c)))

    marks = times("#") + times("*") + times("$") + times("%") + times("&")
    return (F.when(times("|") * 10 > words, "table").when(marks * 4 > words, "marked").when(words < 100, "brief")
            .when(words < 500, "article").otherwise("long"))


def described(text: Column, source: Column, lang: Column, topic: Column | None = None) -> Column:
    """Struct of source, lang, topic (null as empty) and tokens."""
    text = F.coalesce(text, F.lit(""))
    words = count_words(text)
    topic = form_topic(text, words) if topic is None else topic
    named = (("source", source), ("lang", lang), ("topic", topic))
    return F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in named], words.cast("long").alias("tokens"))


def _shares(sums: dict[str, float], wanted: dict[str, float] | float) -> dict[str, float]:
    """Target share of each value with tokens: tempered, or as given; they add up to one."""
    raw = {v: (s ** wanted if isinstance(wanted, int | float) else wanted.get(v, 0.0)) if s > 0 else 0.0 for v, s in sums.items()}
    total = sum(raw.values())
    if sums and not total:
        raise ValueError("no value with tokens has a target")
    return {v: x / total for v, x in raw.items()}


def _map(values: dict) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,double>")


def rake(cells: DataFrame, targets: dict | None = None, rounds: int = 200, tolerance: float = 1e-10) -> tuple[DataFrame, float]:
    """(source, lang, topic, tokens, weight) with sum(tokens * weight) by margin at its target, and the residual.

    ``cells`` has distinct (source, lang, topic) with ``tokens``. ``targets`` gives by dimension
    shares by value, or an exponent. The residual is the largest relative change of the last
    round: targets that the non-empty cells cannot meet leave it above ``tolerance``.
    """
    targets = TEMPERED | (targets or {})
    rows = stored(cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", F.col("tokens").cast("double").alias("tokens"))).alias("cells"),
                                              F.sum("tokens").cast("double").alias("total")), "mix-sources")
    table = {(r.lang, r.topic): r.tokens for r in rows.select(F.inline("cells")).groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()}
    total = float(sum(table.values()))
    sums = {d: {} for d in (1, 2)}
    for key, tokens in table.items():
        for d in (1, 2):
            sums[d][key[d - 1]] = sums[d].get(key[d - 1], 0.0) + tokens
    if max(map(len, sums.values()), default=0) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} languages or topics")
    share = {d: _shares(sums[d], targets[DIMENSIONS[d]]) for d in (1, 2)}
    factor = {d: dict.fromkeys(sums[d], 1.0) for d in (1, 2)}
    by_source = targets["source"]
    raw = F.pow("total", F.lit(float(by_source))) if isinstance(by_source, int | float) else F.coalesce(_map(by_source)[F.col("source")], F.lit(0.0))
    rows = rows.withColumn("raw", F.when(F.col("total") > 0, raw).otherwise(0.0))
    norm = rows.agg(F.sum("raw")).first()[0] or 1.0
    rows = stored(rows.select("source", "cells", (F.col("raw") / norm * total).alias("wanted")), "mix-targets")

    def scaled() -> DataFrame:
        here = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["tokens"] * F.col("fl")[c["lang"]] * F.col("ft")[c["topic"]])
        by = (rows.withColumn("fl", _map(factor[1])).withColumn("ft", _map(factor[2]))
              .withColumn("fs", F.when(here > 0, F.col("wanted") / here).otherwise(0.0)))
        return by.select("source", "fs", "fl", "ft", F.inline("cells")).withColumn("weight", F.col("fs") * F.col("fl")[F.col("lang")] * F.col("ft")[F.col("topic")])

    residual = 0.0
    for _ in range(rounds if total else 0):
        now = {(r.lang, r.topic): r.w for r in scaled().groupBy("lang", "topic").agg(F.sum(F.col("tokens") * F.col("weight")).alias("w")).collect()}
        residual = 0.0
        for d in (1, 2):
            have: dict[str, float] = {}
            for key, w in now.items():
                have[key[d - 1]] = have.get(key[d - 1], 0.0) + w
            change = {v: share[d][v] * total / h if h > 0 else 0.0 for v, h in have.items()}
            for v, c in change.items():
                factor[d][v] *= c
                residual = max(residual, abs(c - 1) if share[d][v] else 0.0)
            now = {key: w * change[key[d - 1]] for key, w in now.items()}
        if residual < tolerance:
            break
    return stored(scaled().select(*DIMENSIONS, "tokens", "weight"), "mix-weights"), residual


def calibrate(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with ``probability`` = least(1, scale * weight), so that expected tokens are ``keep`` of all.

    Cells that reach one are full; the scale of the others is raised to make up for them until
    no further cell gets full. Where too little is left to reach the total, all with weight are full.
    """
    scale, full = None, -1
    while True:
        capped = F.lit(False) if scale is None else F.col("weight") * scale >= 1
        mass = F.col("tokens") * F.col("weight")
        now = cells.agg(F.sum("tokens").alias("all"), F.sum(F.when(capped, F.col("tokens"))).alias("full"), F.sum(F.when(~capped, mass)).alias("rest"),
                        F.count_if(capped).alias("n")).first()
        if now["n"] == full or not now["rest"]:
            scale = (scale or 0.0) if now["rest"] or scale is None else float("inf")
            break
        full = now["n"]
        scale = max(0.0, keep * now["all"] - (now["full"] or 0.0)) / now["rest"]
    p = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("weight") * scale)) if scale != float("inf") else (F.col("weight") > 0).cast("double")
    return stored(cells.withColumn("probability", p), "mix-probabilities")


def chance(seed: str, id_col: str = "doc_id") -> Column:
    """Between 0 and 1 by 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cells(mixed: DataFrame, targets: dict | None, keep: float) -> DataFrame:
    cells = mixed.groupBy("mix.source", "mix.lang", "mix.topic").agg(F.sum("mix.tokens").alias("tokens"))
    raked, residual = rake(stored(cells, "mix-cells"), targets)
    if residual > MET:
        # given margins must be met; the tempered ones follow from the data, and are met as nearly as its cells allow
        missed = f"the cells cannot meet the margins: after the last round one is off by {residual:.3g} of itself"
        if targets:
            raise UnattainableMargins(missed)
        warnings.warn(missed, stacklevel=3)
    return calibrate(raked, keep).select(F.struct(*DIMENSIONS).alias("cell"), "weight", "probability")


def mix(docs: DataFrame, targets: dict | None = None, keep: float = 0.6, seed: str = "mix-1", topic: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight, probability, sampled.

    Defined results: a null source, language or topic is the empty one; null and empty texts have
    no tokens; cells without tokens, or without a target, have weight and probability zero;
    equal ids are sampled together; an empty table gives no rows. ``targets`` that the non-empty cells
    cannot meet raise ``UnattainableMargins``; without targets, margins that a sparse table of cells cannot meet
    are fitted as nearly as they can be, with a warning that names how far one is off.
    """
    slim = stored(docs.select("doc_id", _described(docs, topic).alias("mix")), "mix-documents")
    return (join_small(slim.withColumn("cell", _cell("mix")), _cells(slim, targets, keep), "cell")
            .select("doc_id", "cell.*", "mix.tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"),
                    (chance(seed) < F.col("probability")).alias("sampled")))


def _described(docs: DataFrame, topic: Column | None) -> Column:
    return described(docs["text"], docs["source"], docs["lang"], topic)


def _cell(mix: str) -> Column:
    return F.struct(*[F.col(f"{mix}.{d}").alias(d) for d in DIMENSIONS])


def keep_mixed(docs: DataFrame, targets: dict | None = None, keep: float = 0.6, seed: str = "mix-1", topic: Column | None = None) -> DataFrame:
    """The sampled documents, columns unchanged; the texts stay where they are unless there are very many cells."""
    mixed = docs.select(_described(docs, topic).alias("mix"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    cells = _cells(docs.select(_described(docs, topic).alias("mix")), targets, keep)
    return join_small(mixed.withColumn("cell", _cell("mix")), cells, "cell").where(chance(seed, "doc.doc_id") < F.col("probability")).select("doc.*")


def oracle_sql(words: str, keep: float = 0.6, seed: str = "mix-1", rounds: int = 40, steps: int = 12) -> str:
    """Every margin of a round as a window over all cells; both loops unrolled."""
    def times(c: str) -> str:
        return f"(length(text) - length(replace(text, '{c}', '')))"

    ctes = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text, len({words})::BIGINT AS tokens FROM documents)""",
            f"""t AS (SELECT doc_id, source, lang, tokens, CASE WHEN {times('|')} * 10 > tokens THEN 'table'
                WHEN ({' + '.join(map(times, '#*$%&'))}) * 4 > tokens THEN 'marked' WHEN tokens < 100 THEN 'brief' WHEN tokens < 500 THEN 'article' ELSE 'long' END AS topic FROM d)""",
            "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM t GROUP BY ALL)", "total AS (SELECT sum(tokens) AS n FROM c)"]
    for dim in DIMENSIONS:
        ctes.append(f"g_{dim} AS (SELECT {dim}, sum(tokens) ^ {TEMPERED[dim]} / sum(sum(tokens) ^ {TEMPERED[dim]}) OVER () * any_value(n) AS goal FROM c, total GROUP BY {dim})")
    ctes.append("w0 AS MATERIALIZED (SELECT c.*, g_source.goal AS gs, g_lang.goal AS gl, g_topic.goal AS gt, tokens AS w FROM c "
                "JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    for r in range(rounds):
        inner = f"w{r}"
        for dim, goal in zip(DIMENSIONS, ("gs", "gl", "gt"), strict=True):
            inner = f"(SELECT source, lang, topic, tokens, gs, gl, gt, w * {goal} / nullif(sum(w) OVER (PARTITION BY {dim}), 0) AS w FROM {inner})"
        ctes.append(f"w{r + 1} AS MATERIALIZED (SELECT * FROM {inner})")
    ctes.append(f"x AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(w / nullif(tokens, 0), 0) AS weight FROM w{rounds})")
    ctes.append(f"k0 AS (SELECT {keep}::DOUBLE AS scale)")
    for s in range(steps):
        ctes.append(f"k{s + 1} AS MATERIALIZED (SELECT greatest(0, {keep} * sum(tokens) - sum(CASE WHEN weight * scale >= 1 THEN tokens ELSE 0 END)) "
                    f"/ sum(CASE WHEN weight * scale < 1 THEN tokens * weight END) AS scale FROM x, k{s})")
    return f"""WITH {', '.join(ctes)}
        SELECT doc_id, source, lang, topic, t.tokens, round(weight, 6) AS weight, round(least(1, weight * scale), 6) AS probability,
               ('0x' || substr(md5('{seed}' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 < least(1, weight * scale) AS sampled
        FROM t JOIN x USING (source, lang, topic), k{steps}"""
