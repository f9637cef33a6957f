"""Trie of conversation prefixes by sorted sequences, their LCPs and range minima.

Distinct sequences of turns (as digests) are sorted; the LCP of a sequence is the number of
turns it shares with the one before it. A prefix of depth d first seen at sequence i (its LCP is
below d) is a node, and its members are the sequences around i as far as no LCP falls below d. Each
candidate prefix finds its two extents by itself, by binary search over a sparse table of range minima,
so there is no stack and no order among candidates.

Sorted sequences are cut into blocks of ``SPAN``. A block's candidates are answered together with numpy.
The few prefixes of a block's last sequence that go on in the next one are asked of the level
above, where a block is one entry with its least LCP and its totals; levels nest until one block is left.
Copies of a sequence are one entry with a count from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ranks import ranked

SPAN = 1024                       # entries of a block
IDS = 4096                        # ids in one piece of a node's list
DIGEST = 16                       # bytes of a turn
NOTHING = hashlib.sha256(b"").hexdigest()
_LAST = (1 << 63) - 1
_IDENTITY = {"sum": 0, "min": _LAST}


# ---- one block --------------------------------------------------------------------------

def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: row k holds the least of the 2^k values from each place on."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        step = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
    return rows


def extent_right(table: list[np.ndarray], at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The first place after ``at`` whose value is below ``d``, or the length of the block."""
    n, at = len(table[0]), np.array(at, np.int64)
    for k in reversed(range(len(table))):
        fits = at + (1 << k) < n
        ahead = table[k][np.where(fits, at + 1, 0)]
        at += np.where(fits & (ahead >= d), 1 << k, 0)
    return at + 1


def extent_left(table: list[np.ndarray], at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The last place up to ``at`` whose value is below ``d``, or -1."""
    at = np.array(at, np.int64)
    for k in reversed(range(len(table))):
        first = at - (1 << k) + 1
        back = table[k][np.maximum(first, 0)]
        at -= np.where((first >= 0) & (back >= d), 1 << k, 0)
    return at


def least(table: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least value in each non-empty range."""
    k = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), np.int64)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(table[level][start[m]], table[level][stop[m] - (1 << int(level))])
    return out


def totals(payload: list[np.ndarray], kinds: tuple[str, ...], start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Sum or least of each payload over each range; the identity over empty ones."""
    out = []
    for values, kind in zip(payload, kinds, strict=True):
        if kind == "sum":
            run = np.concatenate([[0], np.cumsum(values)])
            out.append(run[stop] - run[start])
        else:
            got, some = np.full(len(start), _LAST, np.int64), stop > start
            got[some] = least(minima(values), start[some], stop[some])
            out.append(got)
    return out


def common_turns(keys: list[bytes]) -> list[int]:
    """Turns that each key shares with the one before it."""
    out = []
    for a, b in zip(keys, keys[1:]):
        low, high = 0, min(len(a), len(b)) // DIGEST
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[:mid * DIGEST] == b[:mid * DIGEST] else (low, mid - 1)
        out.append(low)
    return out


# ---- levels of blocks -------------------------------------------------------------------

def _level(entries: DataFrame, width: int) -> DataFrame:
    """Entries (idx, low, p0, p1, ...) in blocks: block, low (array), p0 (array), ..."""
    names = ["low", *[f"p{j}" for j in range(width)]]
    packed = entries.withColumn("block", F.expr(f"idx div {SPAN}")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("idx", *names))).alias("rows"))
    return stored(packed.select("block", *[F.col("rows")[n].alias(n) for n in names]), "trie-level")


def _levels(first: DataFrame, kinds: tuple[str, ...]) -> list[DataFrame]:
    """The blocks (block, low, p0, ...) and the levels above them, up to one of a single block."""
    found = [first]
    while found[-1].count() > 1:
        parts = [F.aggregate(f"p{j}", F.lit(0).cast("long"), lambda a, x: a + x) if kind == "sum" else F.array_min(f"p{j}") for j, kind in enumerate(kinds)]
        entries = found[-1].select(F.col("block").alias("idx"), F.array_min("low").alias("low"), *[p.alias(f"p{j}") for j, p in enumerate(parts)])
        found.append(_level(entries, len(kinds)))
    return found


def _walk(level: DataFrame, asked: DataFrame, kinds: tuple[str, ...], left: bool) -> DataFrame:
    """For questions (block, at, d): ``found``, the entry's number or null, and totals of the entries before it.

    The search runs from the entry after ``at`` (-1: from the first); to the left, from the one before it (null: from the last).
    """
    names = [f"p{j}" for j in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low = batch["low"][i].values.to_numpy().astype(np.int64)
                payload = [batch[n][i].values.to_numpy().astype(np.int64) for n in names]
                asks = batch["asks"][i].as_py()
                d = np.array([a["d"] for a in asks], np.int64)
                table, start = minima(low), np.array([(len(low) if a["at"] is None else a["at"]) for a in asks], np.int64)
                if left:
                    stop = extent_left(table, start - 1, d)
                    missed, sums = stop < 0, [np.zeros(len(d), np.int64) for _ in names]
                else:
                    stop = extent_right(table, start, d)
                    missed, sums = stop >= len(low), totals(payload, kinds, start + 1, stop)
                block = batch["block"][i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(d), pa.int64()), pa.array([a["at"] for a in asks], pa.int64()), pa.array(d),
                                                  pa.array(stop + block * SPAN, mask=missed), *[pa.array(s) for s in sums]],
                                                 names=["block", "at", "d", "found", *names])

    asks = asked.groupBy("block").agg(F.collect_set(F.struct("at", "d")).alias("asks"))
    schema = "block long, at long, d long, found long" + "".join(f", {n} long" for n in names)
    return stored(level.join(asks, "block").select("block", "low", *names, "asks").mapInArrow(run, schema), "trie-walk")


def _plus(kinds: tuple[str, ...], *sides: str) -> list[Column]:
    """Totals p0, ... of several sides, whose columns have a prefix; a missing side counts as nothing."""
    out = []
    for j, kind in enumerate(kinds):
        parts = [F.coalesce(F.col(f"{s}p{j}"), F.lit(_IDENTITY[kind])) for s in sides]
        total = F.least(*parts) if kind == "min" and len(parts) > 1 else sum(parts[1:], parts[0])
        out.append(total.alias(f"p{j}"))
    return out


def _as(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def beyond(levels: list[DataFrame], kinds: tuple[str, ...], asked: DataFrame, left: bool = False, k: int = 0) -> DataFrame:
    """For questions (block, d) of level ``k``: the first entry after that block (or the last before it)
    whose value is below ``d``, as ``found`` (null: none), and the totals of the entries between."""
    keys = ("block", "d")
    if k + 1 == len(levels) or asked.isEmpty():
        return asked.select(*keys, F.lit(None).cast("long").alias("found"), *[F.lit(_IDENTITY[kind]).cast("long").alias(f"p{j}") for j, kind in enumerate(kinds)])
    up = asked.select("d", "block", F.expr(f"block div {SPAN}").alias("up"))
    near = _walk(levels[k + 1], up.select(F.col("up").alias("block"), (F.col("block") - F.col("up") * SPAN).alias("at"), "d"), kinds, left)
    near = near.select("d", (F.col("block") * SPAN + F.col("at")).alias("block"), F.col("block").alias("up"), "found", *[f"p{j}" for j in range(len(kinds))])
    near = near.withColumn("up", F.when(F.col("found").isNull(), F.col("up")))     # only what is still open goes further
    far = beyond(levels, kinds, near.where("up IS NOT NULL").select(F.col("up").alias("block"), "d").distinct(), left, k + 1)
    far = _as(far.withColumnRenamed("block", "up"), "f_", ("up", "d"))
    # a found entry is a block of this level that holds a value below d: its place is searched from the block's edge
    spot = stored(near.join(far, ["up", "d"], "left").select(*keys, F.coalesce("found", "f_found").alias("spot"),
                                                             *_plus(kinds, "", "f_")), "trie-spots")
    inside = _walk(levels[k], spot.where("spot IS NOT NULL").select(F.col("spot").alias("block"), F.lit(None if left else -1).cast("long").alias("at"), "d").distinct(), kinds, left)
    inside = _as(inside.drop("at").withColumnRenamed("block", "spot"), "i_", ("spot", "d"))
    return stored(spot.join(inside, ["spot", "d"], "left").select(*keys, F.col("i_found").alias("found"), *_plus(kinds, "", "i_")), "trie-beyond")


# ---- the trie ---------------------------------------------------------------------------

def _candidates(blocks: DataFrame) -> DataFrame:
    """A row for each prefix first seen in its block, with extents and totals as far as the block goes.

    ``stop`` is null where the prefix goes on in the next block, ``above`` (the start of the parent)
    where the parent starts in an earlier one; totals then end with the block.
    """
    kinds = ("sum", "sum", "min")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch[n][i] for n in batch.schema.names}
                low, depth = row["low"].values.to_numpy().astype(np.int64), row["depth"].values.to_numpy().astype(np.int64)
                payload = [row[n].values.to_numpy().astype(np.int64) for n in ("p0", "p1", "p2")]
                words = row["words"].as_py()
                ends, base, after = row["ends"].as_py(), row["block"].as_py() * SPAN, row["after"].as_py()
                new = depth - low                               # nodes first seen at each sequence
                at = np.repeat(np.arange(len(low)), new)
                d = np.arange(len(at)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(low + 1, new)
                table = minima(low)
                start, stop = extent_left(table, at, d), extent_right(table, at, d)
                open_right = (stop == len(low)) & (d <= after)
                first = d == low[at] + 1
                parent = np.where(first, extent_left(table, at, np.maximum(d - 1, 0)), at)
                open_left = first & (parent < 0) & (d > 0)
                sums = totals(payload, kinds, start, stop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"].as_py()] * len(at), pa.int64()), pa.array(start + base), pa.array(d), pa.array(stop + base, mask=open_right),
                     pa.array(parent + base, mask=open_left | (d == 0)), *[pa.array(s) for s in sums],
                     pa.array([words[a][e - 1] if e else 0 for a, e in zip(at.tolist(), d.tolist())], pa.int64()),
                     pa.array([ends[a] if e == n else NOTHING for a, e, n in zip(at.tolist(), d.tolist(), depth[at].tolist())], pa.string())],
                    names=["block", "start", "d", "stop", "above", "p0", "p1", "p2", "words", "ends"])

    return blocks.mapInArrow(run, "block long, start long, d long, stop long, above long, p0 long, p1 long, p2 long, words long, ends string")


def _own_and_after(nodes: DataFrame) -> DataFrame:
    """Nodes grouped by block (block, n, rows) give each node its tokens and those of its subtree within the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, base, n = batch["rows"][i].values, batch["block"][i].as_py() * SPAN, batch["n"][i].as_py()
                start, d, stop, own = (rows.field(f).to_numpy().astype(np.int64) for f in ("start", "d", "stop", "own"))
                place = start - base
                each = np.zeros(n, np.int64)
                np.add.at(each, place, own)
                run_sum = np.concatenate([[0], np.cumsum(own)])           # rows are ordered by start and depth
                last = np.cumsum(np.bincount(place, minlength=n))[place]     # end of the rows of the same sequence
                later = np.concatenate([[0], np.cumsum(each)])
                inside = run_sum[last] - run_sum[np.arange(len(own))] + later[np.minimum(stop - base, n)] - later[place + 1]
                yield pa.RecordBatch.from_arrays([pa.array([batch["block"][i].as_py()], pa.int64()), pa.array([each], pa.list_(pa.int64())),
                                                  pa.array([[{"start": a, "d": b, "inside": c} for a, b, c in zip(start.tolist(), d.tolist(), inside.tolist())]],
                                                           pa.list_(pa.struct([("start", pa.int64()), ("d", pa.int64()), ("inside", pa.int64())])))],
                                                 names=["block", "each", "rows"])

    return nodes.mapInArrow(run, "block long, each array<long>, rows array<struct<start: long, d: long, inside: long>>")


def _id_lists(sequences: DataFrame) -> DataFrame:
    """(name, ends): SHA-256 of the ascending decimal ids of each sequence (name, conv), joined by commas.

    Ids become pieces of a few thousand, ordered without a group in one task; a digest must read its
    pieces in order, so these stream through one task per sequence and only its state is held.
    """
    pieces = (ranked(sequences.select("name", "conv"), "name", ["conv"]).withColumn("piece", F.expr(f"idx div {IDS}"))
              .groupBy("name", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = state = None
        for batch in batches:
            done = []
            for n, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if n == name:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], names=["name", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends"])

    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInArrow(run, "name string, ends string")


def turn_digest(role: str, text: str) -> Column:
    """Sixteen bytes of a turn as hex digits; the role's length keeps it apart from the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv, digests, words): each conversation with the first h turns of the first of its group of ids.

    h is CRC-32 of the decimal id modulo ``heads``. Turns are ordered by ``turn``, null first,
    equal ones by digest. Words are runs of characters other than space and 0x09-0x0D.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), turn_digest("role", "text").alias("digest"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).alias("words"))
    whole = stored(turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))
                   .select("conv", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")), "conversations")
    first = whole.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.slice("digests", 1, heads).alias("a"), F.slice("words", 1, heads).alias("b"))
    own = whole.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", (F.crc32(F.col("conv").cast("string")) % heads).cast("int"))

    def joined(head: str, tail: str) -> Column:
        return F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array()), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail), F.lit(1))))

    return own.join(first, "base", "left").select("conv", joined("a", "digests").alias("digests"), joined("b", "words").alias("words"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv, digests, words): ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    A node is a distinct sequence of first turns, the root the empty one; a sequence without turns is a member
    of the root alone. Members are counted with copies. ``saved_tokens`` adds up, over the node's
    subtree, members but one times the words of the last turn. ``ends_sha256`` digests the ids of members that end here.

    Defined results: null roles and texts count as empty; equal turns are told apart by their place
    alone; long texts enter as digests; ``conv`` must be unique and not null; an empty table has no nodes, not even a
    root. A conversation's digests and word counts are held in one row, some thirty bytes a turn.
    """
    named = stored(sequences.select("conv", F.array_join("digests", "").alias("path"), "words").select(
        "conv", F.md5("path").alias("name"), F.unhex("path").alias("path"), "words"), "sequences")
    distinct = named.groupBy("name").agg(F.min("conv").alias("first"), F.count("*").alias("n"), F.min_by(F.struct("path", "words"), "conv").alias("s"))
    distinct = distinct.join(_id_lists(named), "name").select(F.lit("").alias("all"), F.col("s.path").alias("path"), F.col("s.words").alias("words"), "first", "n", "ends")
    rows = ranked(distinct, "all", ["path"]).drop("all")
    packed = stored(rows.withColumn("block", F.expr(f"idx div {SPAN}")).groupBy("block")
                    .agg(F.sort_array(F.collect_list(F.struct("idx", "path", "words", "first", "n", "ends"))).alias("rows")), "trie-packed")
    edges = packed.select("block", F.col("rows")[0]["path"].alias("head"), F.element_at("rows", -1)["path"].alias("foot"))
    blocks = stored(_with_lcps(packed.join(edges.select((F.col("block") + 1).alias("block"), F.col("foot").alias("prior")), "block", "left")
                               .join(edges.select((F.col("block") - 1).alias("block"), F.col("head").alias("next")), "block", "left")), "trie-blocks")
    kinds = ("sum", "sum", "min")
    names = [f"p{j}" for j in range(3)]
    levels = _levels(blocks.select("block", "low", *names), kinds)
    nodes = stored(_candidates(blocks), "trie-candidates")
    end = rows.count()
    right = beyond(levels, kinds, nodes.where("stop IS NULL").select("block", "d").distinct())
    left = beyond(levels, kinds, nodes.where("above IS NULL AND d > 0").select("block", (F.col("d") - 1).alias("d")).distinct(), left=True)
    nodes = (nodes.withColumn("tail", F.when(F.col("stop").isNull(), F.col("d"))).withColumn("lead", F.when(F.col("above").isNull() & (F.col("d") > 0), F.col("d") - 1))
             .join(_as(right, "r_", ("block",)).withColumnRenamed("r_d", "tail"), ["block", "tail"], "left")
             .join(left.select("block", F.col("d").alias("lead"), F.col("found").alias("l_found")), ["block", "lead"], "left"))
    nodes = stored(nodes.select("block", "start", "d", F.coalesce("stop", "r_found", F.lit(end)).alias("stop"), F.coalesce("above", "l_found").alias("above"),
                                "words", "ends", *_plus(kinds, "", "r_")).withColumn("own", (F.col("p0") - 1) * F.col("words")), "trie-nodes")
    saved = _subtree_sums(nodes, blocks)
    children = nodes.where("d > 0").groupBy(F.col("above").alias("start"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    full = stored(nodes.join(saved, ["start", "d"]).join(children, ["start", "d"], "left"), "trie-full")
    parents = full.where("n_children > 0").select(F.col("start").alias("above"), (F.col("d") + 1).alias("d"), F.col("p2").alias("parent_conv_id"))
    return full.join(parents, ["above", "d"], "left").select(
        F.col("p2").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("p0").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("p1").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def _with_lcps(packed: DataFrame) -> DataFrame:
    """Blocks with ``low`` (LCPs; -1 for the first of all), ``depth``, ``after`` (the next block's first LCP or -1),
    and per sequence p0 (members), p1 (1 for a leaf) and p2 (smallest member)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                rows, paths = row["rows"], [r["path"] for r in row["rows"]]
                low = [-1 if row["prior"] is None else common_turns([row["prior"], paths[0]])[0], *common_turns(paths)]
                after = -1 if row["next"] is None else common_turns([paths[-1], row["next"]])[0]
                depth = [len(p) // DIGEST for p in paths]
                leaf = [int(x < n) for x, n in zip([*low[1:], after], depth, strict=True)]
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "low": low, "depth": depth, "after": after, "words": [r["words"] for r in rows],
                                                   "ends": [r["ends"] for r in rows], "p0": [r["n"] for r in rows], "p1": leaf, "p2": [r["first"] for r in rows]}], schema=kind)

    longs = pa.list_(pa.int64())
    kind = pa.schema([("block", pa.int64()), ("low", longs), ("depth", longs), ("after", pa.int64()), ("words", pa.list_(longs)),
                      ("ends", pa.list_(pa.string())), ("p0", longs), ("p1", longs), ("p2", longs)])
    return packed.mapInArrow(run, "block long, low array<long>, depth array<long>, after long, words array<array<long>>, ends array<string>, "
                                  "p0 array<long>, p1 array<long>, p2 array<long>")


def _subtree_sums(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(start, d, saved): the sum of ``own`` over each node's subtree."""
    grouped = (nodes.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("start", "d", "stop", "own"))).alias("rows"))
               .join(blocks.select("block", F.size("low").alias("n")), "block"))
    local = stored(_own_and_after(grouped), "trie-sums")
    levels = _levels(stored(blocks.select("block", "low").join(local.select("block", F.col("each").alias("p0")), "block"), "trie-level"), ("sum",))
    spans = nodes.select("block", "start", "d", "stop").join(blocks.select("block", (F.col("block") * SPAN + F.size("low")).alias("limit")), "block")
    after = beyond(levels, ("sum",), spans.where("stop > limit").select("block", "d").distinct())
    inside = local.select("block", F.inline("rows"))
    far = spans.where("stop > limit").select("start", "d", "block").join(after.select("block", "d", F.col("p0").alias("more")), ["block", "d"]).drop("block")
    return inside.drop("block").join(far, ["start", "d"], "left").select("start", "d", (F.col("inside") + F.coalesce("more", F.lit(0))).alias("saved"))


def oracle_sql(words: str) -> str:
    """The trie of the rebuilt conversations in DuckDB SQL: prefixes as text, subtrees by pairs within a conversation."""
    crc = ("xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv::VARCHAR, ''), "
           "lambda ch: list_transform(range(8), lambda k: ((ascii(ch) >> k) & 1)::UBIGINT)))), "
           "lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))))")
    return f"""
        WITH t AS (SELECT conv_id AS conv, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len({words}) AS w
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv, list(g ORDER BY turn NULLS FIRST, g) AS g, list(w ORDER BY turn NULLS FIRST, g) AS w FROM t GROUP BY conv),
        h AS (SELECT *, ({crc} % 4)::BIGINT AS h FROM c),
        r AS (SELECT h.conv, coalesce(b.g[:h], []) || h.g[h + 1:] AS g, coalesce(b.w[:h], []) || h.w[h + 1:] AS w
              FROM h LEFT JOIN c b ON b.conv = h.conv - h.conv % 20),
        p AS (SELECT conv, d, array_to_string(g[:d], '') AS pre, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(g) AS n FROM (SELECT *, unnest(range(len(g) + 1)) AS d FROM r)),
        nodes AS (SELECT pre, d, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
                  sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY pre, d),
        kids AS (SELECT substr(pre, 1, 32 * (d - 1)) AS pre, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
        pairs AS (SELECT DISTINCT a.pre AS top, b.pre AS pre FROM p a JOIN p b ON a.conv = b.conv AND b.d >= a.d),
        sums AS (SELECT top, sum(own)::BIGINT AS saved, sum((k.n IS NULL)::INT)::BIGINT AS leaves FROM pairs JOIN nodes USING (pre) LEFT JOIN kids k USING (pre) GROUP BY top)
        SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves,
               saved AS saved_tokens, nodes.ends_sha256
        FROM nodes JOIN sums ON top = nodes.pre LEFT JOIN kids k ON k.pre = nodes.pre
             LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.pre = substr(nodes.pre, 1, 32 * (nodes.d - 1))"""
