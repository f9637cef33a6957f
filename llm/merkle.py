"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

A tree of arity 16 is cut into blocks: aligned subtrees of three levels of hashing, 4096
leaves. A block is one row that holds its digests in van Emde Boas order: the levels are split at
half their number, the top part comes first, then each part below it, all laid out in the same
way. ``addresses`` finds any node's place by arithmetic alone, also in a block that is not full
(only its last subtrees are short), and both the construction and the retrieval of siblings go
through it. The roots of the blocks are the leaves of the next round, until a tree has
one block; so rounds grow with log 4096 of the rows, and no task sees more than one block at a
time, however many rows a source holds.

Proofs come down the other way: each block hands to its children the siblings above them.
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

ARITY = 16
LEVELS = 3                    # levels of hashing in a block
SPAN = ARITY ** LEVELS        # leaves of a block

TAIL = "array<struct<left: string, right: string>>"
_ROWS = "array<struct<idx: long, doc_id: long, leaf: binary, changed: binary>>"


# ---- layout -----------------------------------------------------------------------------

def height_of(n: int) -> int:
    """Levels of hashing above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def tree_size(n, height: int):
    """Nodes of a subtree of this height with ``n`` leaves (a number or an array)."""
    return sum(-(-n // ARITY ** k) for k in range(height + 1))


def addresses(n: int, height: int, depth: int, nodes: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of the ``nodes`` (numbers from the left) at a depth below the root."""
    nodes = np.asarray(nodes, np.int64)
    leaves = np.full(len(nodes), n, np.int64)
    at = np.zeros(len(nodes), np.int64)
    while height:
        top = (height + 1) // 2            # node levels of the top part: depths 0 to top - 1
        below = height - top               # height of the parts under it
        cap = ARITY ** below               # leaves of a full one
        tops = -(-leaves // (cap * ARITY))   # lowest nodes of the top part
        if depth < top:
            leaves, height = tops, top - 1
            continue
        part, nodes = np.divmod(nodes, ARITY ** (depth - top))
        at += tree_size(tops, top - 1) + part * tree_size(cap, below)
        leaves = np.minimum(cap, leaves - part * cap)
        height, depth = below, depth - top
    return at


def digest(*hexes: str) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


class Block:
    """One block: ``n`` leaves under ``height`` levels of hashing, digests in van Emde Boas order."""

    def __init__(self, n: int, height: int, nodes: np.ndarray):
        self.n, self.height, self.nodes, self._runs = n, height, nodes, {}

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        n = len(leaves)
        block = cls(n, height, np.empty((tree_size(n, height), 32), np.uint8))
        block._put(height, b"".join(leaves))
        for depth in range(height, 0, -1):
            parents = (block._run(depth, k) for k in range(-(-block.count(depth) // ARITY)))
            block._put(depth - 1, b"".join(hashlib.sha256(run.encode()).digest() for run in parents))
        block._runs.clear()
        return block

    def count(self, depth: int) -> int:
        return -(-self.n // ARITY ** (self.height - depth))

    def _put(self, depth: int, digests: bytes) -> None:
        self.nodes[addresses(self.n, self.height, depth, np.arange(self.count(depth)))] = np.frombuffer(digests, np.uint8).reshape(-1, 32)

    def _run(self, depth: int, k: int) -> str:
        """The digests of the k-th run of siblings at a depth, as hex text."""
        if (depth, k) not in self._runs:
            among = np.arange(ARITY * k, min(ARITY * (k + 1), self.count(depth)))
            self._runs[depth, k] = self.nodes[addresses(self.n, self.height, depth, among)].tobytes().hex()
        return self._runs[depth, k]

    @property
    def root(self) -> bytes:
        return self.nodes[addresses(self.n, self.height, 0, [0])].tobytes()

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """Siblings left and right of the path from a leaf to the block's root."""
        found = []
        for depth in range(self.height, 0, -1):
            k, place = divmod(leaf, ARITY)
            run = self._run(depth, k)
            found.append((run[:64 * place], run[64 * (place + 1):]))
            leaf = k
        return found


def fold(leaf: str, path: list[tuple[str, str]], known: dict) -> str:
    """The root that follows from a leaf and the siblings of its path; ``known`` spares equal steps."""
    for step in path:
        key = (leaf, step)
        if key not in known:
            known[key] = digest(step[0], leaf, step[1])
        leaf = known[key]
    return leaf


# ---- construction -----------------------------------------------------------------------

def _height(n: int, whole: int) -> int:
    return LEVELS if whole > SPAN else height_of(n)


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """Blocks of the trees over ``leaves`` (key, idx, doc_id, leaf, changed), a table for each round.

    Columns: key, block, whole (the tree's nodes in this round), rows (ordered leaves), nodes, root.
    """
    def layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for rows, whole in zip(batch["rows"], batch["whole"], strict=True):
                block = Block.build([d.as_py() for d in rows.values.field("leaf")], _height(len(rows), whole.as_py()))
                made.append((block.nodes.tobytes(), block.root))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())],
                                             names=[*batch.schema.names, "nodes", "root"])

    found = []
    while True:
        whole = leaves.groupBy("key").agg(F.count("*").alias("whole"))
        blocks = (leaves.withColumn("block", F.expr(f"idx div {SPAN}")).groupBy("key", "block")
                  .agg(F.sort_array(F.collect_list(F.struct("idx", "doc_id", "leaf", "changed"))).alias("rows"))
                  .join(whole, "key").select("key", "block", "whole", "rows"))
        blocks = stored(blocks.mapInArrow(layout, f"key string, block long, whole long, rows {_ROWS}, nodes binary, root binary"), "merkle-blocks")
        found.append(blocks)
        more = blocks.where(F.col("whole") > SPAN)
        if more.isEmpty():
            return found
        leaves = more.select("key", F.col("block").alias("idx"), F.lit(None).cast("long").alias("doc_id"),
                             F.col("root").alias("leaf"), F.lit(None).cast("binary").alias("changed"))


def tops(blocks: list[DataFrame]) -> DataFrame:
    """(key, root) of each tree."""
    one = [b.where(F.col("whole") <= SPAN).select("key", "root") for b in blocks]
    found = one[0]
    for b in one[1:]:
        found = found.unionByName(b)
    return found


# ---- proofs -----------------------------------------------------------------------------

def _block(row: dict) -> Block:
    n = len(row["rows"])
    return Block(n, _height(n, row["whole"]), np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32))


def _tail(steps: list) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in steps]


def _below(blocks: DataFrame) -> DataFrame:
    """(key, block, tail): what each leaf of these blocks hands to the block under it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, above = _block(row), _tail(row["tail"])
                paths = [[{"left": a, "right": b} for a, b in block.path(k) + above] for k in range(block.n)]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * block.n, pa.string()), pa.array([r["idx"] for r in row["rows"]], pa.int64()),
                                                  pa.array(paths, kind)], names=["key", "block", "tail"])

    return blocks.mapInArrow(run, f"key string, block long, tail {TAIL}")


def with_tails(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``tail``: the siblings over a block's root, up to the whole root.

    ``above`` (key, tail) has those over the root of each tree.
    """
    down = None
    for table in reversed(blocks):
        tails = table.where(F.col("whole") <= SPAN).select("key", "block").join(above, "key")
        if down is not None:
            tails = tails.unionByName(down)
        full = table.join(tails, ["key", "block"])
        if table is not blocks[0]:
            down = stored(_below(full), "merkle-tails")
    return full


def _proved(blocks: DataFrame) -> DataFrame:
    """One row per leaf of the blocks (key, rows, nodes, tail, subroot, top): the columns of ``manifest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, tail, known, made = _block(row), _tail(row["tail"]), {}, []
                subroot, top = row["subroot"].hex(), row["top"].hex()
                for k, r in enumerate(row["rows"]):
                    path = block.path(k) + tail
                    folded = fold((r["changed"] or r["leaf"]).hex(), path, known)
                    proof = digest(*[side for step in path for side in step])
                    made.append((r["doc_id"], r["leaf"].hex(), subroot, top, proof, folded, folded == top))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*made), [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


# ---- the manifest -----------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its number of bytes, a colon and itself, or ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``subroot`` of its source, ``root`` of all, ``proof_sha256``
    over the siblings of its path, and ``folded_root`` and ``verified`` after tampering.

    Tampering lower-cases A-Z in the texts of every document whose id's CRC-32 five divides; where that
    changes nothing, the proof still holds.

    Defined results: nulls are fields of their own (``-``), so a null text differs from an
    empty one; a null source is a source and comes first; rows without an id are leaves, before the
    others, and are never tampered with; repeated rows are leaves of their own, side by side, so equal
    rows may differ in their proof; ties of an id are ordered by leaf hash; long texts are hashed whole
    in the JVM; an empty table gives no rows. Columns beyond the five fields are not read.
    """
    fields = [F.col(c) for c in FIELDS]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = leaf_hash([*fields[:-1], F.translate("text", upper, upper.lower())])
    # the empty key is the null source; others carry a mark, so that bytes keep their order
    leaves = stored(docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
                                F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(fields).alias("leaf"),
                                F.when(picked, lowered).alias("changed")), "merkle-leaves")
    trees = rounds(ranked(leaves, "key", ["doc_id", "leaf", "changed"]))
    subroots = stored(tops(trees), "merkle-subroots")
    sources = ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("leaf")), "key", ["name"])
    crown = rounds(sources.select("key", "idx", F.lit(None).cast("long").alias("doc_id"), "leaf", F.lit(None).cast("binary").alias("changed")))
    paths = _below(with_tails(crown, docs.sparkSession.createDataFrame([("", [])], f"key string, tail {TAIL}")))
    above = stored(sources.join(paths.select(F.col("block").alias("idx"), "tail"), "idx").select(F.col("name").alias("key"), "tail"), "merkle-above")
    top = tops(crown).first()
    full = with_tails(trees, above).join(subroots.withColumnRenamed("root", "subroot"), "key")
    return _proved(full.select("whole", "rows", "nodes", "tail", "subroot", F.lit(bytes(top["root"]) if top else None).cast("binary").alias("top")))


def oracle_sql() -> str:
    """``manifest`` in DuckDB SQL: each level of each tree by grouping, a proof by ordered siblings of all levels."""
    crc = ("xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda ch: list_transform(range(8), lambda k: ((ascii(ch) >> k) & 1)::UBIGINT)))), "
           "lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))))")

    def leaf(text: str) -> str:
        fields = [*FIELDS[:-1], text]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in fields) + "))"

    def climb(name: str, start: str) -> str:
        # (k, level, i, h): nodes of every level of the tree of each key
        return f"""{name}(k, level, i, h, n) AS (
            {start}
            UNION ALL
            SELECT k, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + {ARITY - 1}) // {ARITY}
            FROM {name} WHERE n > 1 GROUP BY k, level, i // {ARITY})"""

    def steps(tree: str, leaves: str, level_shift: int) -> str:
        return f"""SELECT l.id, {level_shift} + s.level AS level, string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.i) AS lt,
                   string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.i) AS rt
            FROM {leaves} l JOIN {tree} p ON p.k IS NOT DISTINCT FROM l.k AND p.i = l.i // ({ARITY} ** p.level)::BIGINT
            JOIN {tree} s ON s.k IS NOT DISTINCT FROM l.k AND s.level = p.level AND s.i // {ARITY} = p.i // {ARITY}
            WHERE p.n > 1 GROUP BY l.id, s.level"""

    return f"""
        WITH RECURSIVE d AS (SELECT *, {leaf('text')} AS leaf,
                CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
        o AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS k, leaf, changed,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
        {climb('t', "SELECT k, 0, i, leaf, n FROM o")},
        s AS (SELECT k AS name, h AS subroot, row_number() OVER (ORDER BY k) AS id, '' AS k, row_number() OVER (ORDER BY k) - 1 AS i,
                count(*) OVER () AS n FROM t WHERE n = 1),
        {climb('c', "SELECT k, 0, i, subroot, n FROM s")},
        up AS (SELECT * FROM ({steps('t', 'o', 0)}) UNION ALL
               SELECT o.id, 100 + x.level, x.lt, x.rt FROM ({steps('c', 's', 0)}) x JOIN s ON s.id = x.id JOIN o ON o.k = s.name),
        proofs AS (SELECT id, sha256(string_agg(coalesce(lt, '') || coalesce(rt, ''), '' ORDER BY level)) AS proof_sha256,
                list({{'lt': coalesce(lt, ''), 'rt': coalesce(rt, '')}} ORDER BY level) AS steps FROM up GROUP BY id),
        f(id, pos, h) AS (SELECT id, 1, coalesce(changed, leaf) FROM o
               UNION ALL SELECT f.id, pos + 1, sha256(p.steps[pos].lt || h || p.steps[pos].rt) FROM f JOIN proofs p USING (id) WHERE pos <= len(p.steps)),
        folded AS (SELECT id, arg_max(h, pos) AS folded_root FROM f GROUP BY id),
        top AS (SELECT h AS root FROM c WHERE n = 1)
        SELECT o.doc_id, o.leaf, s.subroot, top.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = top.root AS verified
        FROM o JOIN s ON s.name = o.k LEFT JOIN proofs p ON p.id = o.id JOIN folded ON folded.id = o.id CROSS JOIN top"""
