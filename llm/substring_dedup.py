"""Substring dedup by seed and extend.

A window is a run of ``length`` words. Winnowing gives each window one anchor, the least
hashed 12-gram inside it (the leftmost of equals), which depends on the window's words
only. So equal windows have equal anchors at equal places, and an anchor that occurs once
rules out all windows it belongs to. Neighbouring windows of one anchor form a run.

1. Seed: anchors that occur at least twice anywhere; the rest of the corpus is done with.
2. Extend over whole runs: runs of one anchor with equal words on both sides are repeated as
   they stand, however many copies there are.
3. Extend word by word, only where runs of one anchor differ: each distinct run gives its
   windows once, and windows found in two runs, or twice, are repeated.
4. Overlapping repeated windows join to maximal repeats, which are cut.

Work follows distinct runs, never pairs of documents. Counts combine before they are
shuffled; joins that meet a frequent anchor have plain shuffles on both sides, so Spark can
split them. Anchors and runs (or windows) are compared by 128 bits of hashes together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lists, stored, utf8

ANCHOR = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_CACHE = 200_000


class _WordHash(dict):
    """Hash of each word met; emptied when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits: multiplication carries upwards only."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes], known: _WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, built from runs of doubling length."""
    power = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(size):
            power.append(power[-1] * _BASE)
        n, out, done, span, now, left = len(words) - size + 1, np.uint64(0), 0, 1, words, size
        while left:
            if left & 1:
                out = out + now[done:done + n] * power[done]
                done += span
            left >>= 1
            if left:
                now = now[:-span] + now[span:] * power[span]
                span *= 2
        return _mix(out)


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the place of its least one, the leftmost of equals."""
    best, span, n = np.arange(len(grams)), 1, len(grams) - width + 1
    while span * 2 <= width:
        left, right = best[:-span], best[span:]
        best = np.where(grams[left] <= grams[right], left, right)
        span *= 2
    left, right = best[:n], best[width - span:width - span + n]
    return np.where(grams[left] <= grams[right], left, right)


def runs_of(text: bytes, length: int, known: _WordHash) -> list[np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, hashes of anchor and run."""
    words = text.split()
    if len(words) < length:
        return [np.empty(0, np.int64)] * 4
    hashed = word_hashes(words, known)
    grams, windows = gram_hashes(hashed, ANCHOR), gram_hashes(hashed, length)
    anchor = window_anchors(grams, length - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(anchor)))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(windows, dtype=np.uint64)])
        run = _mix(total[first + count] - total[first] + count.astype(np.uint64) * _BASE)
    return [first, count, grams[anchor[first]].view(np.int64), run.view(np.int64)]


def _lists(each: list[list[np.ndarray]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """One list of structs per row from its columns; no Python object per struct."""
    offsets = np.concatenate([[0], np.cumsum([len(c[0]) for c in each])]).astype(np.int32)
    columns = [pa.array(np.concatenate([c[i] for c in each]) if each else [], type=kind) for i, (_, kind) in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in fields]))


def cut_repeats(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[int, int, list[bytes]]:
    """(words, words removed, words kept) when windows ``at`` .. ``at + n - 1`` of each span go."""
    words = text.split()
    keep = np.ones(len(words), bool)
    for at, n in spans:
        keep[at:at + n + length - 1] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), kept


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text, copies): one row per distinct key.

    Where ids are unique the key is the id. Else equal rows become one row that counts as
    ``copies`` documents, and the key is a digest of id and text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    again = rows.groupBy("id").count().where("count > 1 OR id IS NULL")
    if again.isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "text", F.lit(1).alias("copies"))
    key = F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" "), "text"), 256)
    return rows.groupBy("id", "text").agg(F.count("*").alias("copies")).select(key.alias("key"), "id", "text", "copies")


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(key, spans): for each row with a repeated window the runs of repeated windows (at, n)."""
    @F.arrow_udf("array<struct<at: int, n: int, anchor: long, run: long>>")
    def runs(texts: pa.Array) -> pa.Array:
        known = _WordHash()
        return _lists([runs_of(t.as_py(), length, known) for t in texts],
                      [("at", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64())])

    found = stored(rows.select("key", "copies", F.explode(runs(utf8("text"))).alias("r")).select("key", "copies", "r.*"), "runs")
    seeds = stored(found.groupBy("anchor").agg(F.sum("copies").alias("c")).where("c > 1").select("anchor"), "seeds")
    seeded = stored(found.join(seeds, "anchor"), "seeded")
    kinds = stored(seeded.groupBy("anchor", "run").agg(F.sum("copies").alias("c"), F.min(F.struct("key", "at", "n")).alias("first")), "kinds")
    mixed = stored(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "mixed")
    whole = seeded.join(kinds.where("c > 1").select("anchor", "run"), ["anchor", "run"]).select("key", "at", "n")
    return _merge(whole.unionByName(_extended(rows, kinds.join(mixed, "anchor"), length)))


def _extended(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """Windows (key, at, n = 1) of runs that occur once whose words another run of their anchor has too."""
    wanted = kinds.groupBy("first.key").agg(F.collect_list(F.struct("first.at", "first.n", "anchor", "c")).alias("wanted"))

    @F.arrow_udf("array<struct<anchor: long, window: long, at: int, c: long>>")
    def windows(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        known, out = _WordHash(), []
        for text, runs in zip(texts, wanted, strict=True):
            runs = runs.as_py()
            grams = gram_hashes(word_hashes(text.as_py().split(), known), length).view(np.int64)
            spread = lambda field: np.repeat(np.array([r[field] for r in runs], np.int64), [r["n"] for r in runs])  # noqa: B023, E731
            at = np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in runs])
            out.append([spread("anchor"), grams[at], at, spread("c")])
        return _lists(out, [("anchor", pa.int64()), ("window", pa.int64()), ("at", pa.int32()), ("c", pa.int64())])

    each = stored(join_lists(rows.select("key", "text"), wanted, "key", "wanted")
                  .select("key", F.explode(windows(utf8("text"), F.col("wanted"))).alias("w")).select("key", "w.*"), "windows")
    again = stored(each.groupBy("anchor", "window").agg(F.sum("c").alias("c")).where("c > 1").select("anchor", "window"), "again")
    return each.where("c = 1").join(again, ["anchor", "window"]).select("key", "at", F.lit(1).alias("n"))


def _merge(spans: DataFrame) -> DataFrame:
    """Per row its spans as one array; adjacent ones are joined, so the array stays short."""
    @F.arrow_udf("array<struct<at: int, n: int>>")
    def joined(lists: pa.Array) -> pa.Array:
        out = []
        for spans in lists:
            mine: list[dict] = []
            for s in sorted(spans.as_py(), key=lambda s: s["at"]):
                if mine and s["at"] <= mine[-1]["at"] + mine[-1]["n"]:
                    mine[-1]["n"] = max(mine[-1]["n"], s["at"] + s["n"] - mine[-1]["at"])
                else:
                    mine.append(dict(s))
            out.append(mine)
        return pa.array(out, type=pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))

    return spans.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("all")).select("key", joined("all").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text``, ``repeats``.

    ``repeats`` lists the maximal repeats as (first word, words). Without ``texts`` the column
    ``kept_text`` is null.

    Defined results: null and empty texts have no words and the digest of the empty string;
    texts shorter than ``length`` keep all words; repeated rows are documents of their own, so
    they remove each other; windows are judged on the input; an empty table gives no rows.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be above {ANCHOR}")
    rows = _rows(docs, id_col, text_col)
    spans = repeated_spans(rows, length)

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string, kept_text: string>")
    def cut(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, mine in zip(bodies, spans, strict=True):
            n, gone, kept = cut_repeats(text.as_py(), [(s["at"], s["n"]) for s in mine.as_py() or ()], length)
            body = b" ".join(kept)
            out.append({"n_words": n, "n_removed": gone, "kept_sha256": hashlib.sha256(body).hexdigest(), "kept_text": body.decode(errors="replace") if texts else None})
        return pa.array(out, type=pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))

    done = (join_lists(rows, spans, "key", "spans", "left")
            .select("id", "copies", cut(utf8("text"), F.col("spans")).alias("r"),
                    F.transform("spans", lambda s: F.struct(s["at"].alias("word"), (s["n"] + length - 1).alias("words"))).alias("repeats")))
    return (done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(F.col("id").alias(id_col), "r.*", F.coalesce("repeats", F.array().cast("array<struct<word: int, words: int>>")).alias("repeats")))
