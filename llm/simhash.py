"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two of them at most three bits apart differ by at most one bit
in one of their halves. Anchors of a half are the 2^26 codewords of the Hamming code on 31 of
its bits, which covers all words with radius one: each word has one anchor at distance at
most one, its home. A word at distance one or less from it lies within two of that home, so
a fingerprint is replicated to all anchors within radius plus threshold (one, or sixteen,
per half) and compared, per anchor, with the fingerprints at home there.

Equal fingerprints are one point. Comparison is a join on (half, anchor) whose condition is
the distance, so only true links leave it; Spark splits a hot anchor.
"""

from __future__ import annotations

from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.session import join_small

from .common import BROADCAST_ENTRIES, per_text, stored, utf8
from .components import components
from .ranks import ranked
from .substring_dedup import _mix

# Bits of a position (1 to 31) that stand at each place of a 31-bit word: the code's parity masks.
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
_HALF = (1 << 31) - 1


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined shingles, repeats included; a shorter text is one shingle."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    start, at = [], 0
    for w in words:
        start.append(at)
        at += len(w) + 1
    start.append(at)
    return [joined[i:j - 1] for i, j in zip(start, start[size:])]


def fold_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):   # bounds the memory of very long texts
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def hashes(parts: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of a text's shingles after A-Z were lower-cased (bytes.lower changes no others)."""
    return fold_bits(hashes(shingles(text.lower().split(), size), seed))


def _with_syndrome(points: DataFrame, fingerprints: list[str]) -> DataFrame:
    """One row per half of each fingerprint: ``half``, its 31 bits ``word``, the code's ``syndrome``."""
    pieces = [f"struct({2 * k + h} AS half, shiftright({c}, {32 * h}) & {_HALF}L AS word)"
              for k, c in enumerate(fingerprints) for h in (0, 1)]
    parity = " | ".join(f"shiftleft(bit_count(word & {m}L) & 1, {k})" for k, m in enumerate(_PARITY))
    return (points.withColumn("piece", F.explode(F.expr(f"array({', '.join(pieces)})")))
            .select("*", "piece.half", "piece.word").drop("piece").withColumn("syndrome", F.expr(parity)))


# Flip the bit at the position that the syndrome names; zero is a codeword.
_HOME = "IF(syndrome = 0, word, word ^ shiftleft(1L, syndrome - 1))"
# Codewords at distance two: flip two positions whose numbers combine to the syndrome.
_NEAR = (f"IF(syndrome = 0, array(word), array_append(transform(filter(sequence(1, 31), i -> i < (i ^ syndrome) AND i != syndrome), "
         f"i -> word ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ syndrome) - 1)), {_HOME}))")


def at_home(points: DataFrame, fingerprints: list[str]) -> DataFrame:
    """Each point at the one anchor within the covering radius, per half."""
    return _with_syndrome(points, fingerprints).withColumn("anchor", F.expr(_HOME)).drop("word", "syndrome")


def replicated(points: DataFrame, fingerprints: list[str]) -> DataFrame:
    """Each point at all anchors within covering radius plus one, per half."""
    return _with_syndrome(points, fingerprints).withColumn("anchor", F.explode(F.expr(_NEAR))).drop("word", "syndrome")


def simhash_links(points: DataFrame) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints ``fp`` at most three bits apart; a pair may come once per half."""
    left = at_home(points.select(F.col("fp").alias("a"), "fp"), ["fp"]).drop("fp")
    right = replicated(points.select(F.col("fp").alias("b"), "fp"), ["fp"]).drop("fp")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    return left.join(right, (left.half == right.half) & (left.anchor == right.anchor) & near).select("a", "b")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``, ``n_links``.

    ``component_id`` is the least id reachable over links of at most three bits; ``n_links``
    counts the other fingerprints linked to the document's own.

    Defined results: null and empty texts have fingerprint zero and link like any other; null
    ids never become a component id unless a component has no other; repeated rows share a
    fingerprint; an empty table gives no rows.
    """
    def one(text: bytes) -> tuple[int]:
        return (signed(fingerprint(text, size, seed)),)

    prints = stored(docs.select(F.col(id_col).alias("id"), per_text(one, "fp long")(utf8(text_col)).alias("r"))
                    .select("id", "r.fp"), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "points")
    links = stored(simhash_links(points).distinct(), "links")
    found = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    placed = stored(points.join(found.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("component", F.coalesce("component", "fp")).join(degree, "fp", "left"), "placed")
    ids = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = stored(placed.join(ids, "component").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return (prints.join(known, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"))


# ---- one document of each group -------------------------------------------------------

SIGNATURE = tuple(f"s{i}" for i in range(4))     # SimHash of shingles of five words: preselects
BANDS, BAND_ROWS = 25, 5                         # least hashes of the shingles: sets of similarity s meet with 1 - (1 - s^5)^25
CROWD = 16                                       # with more texts than this left at a key, only links leave the comparison
_ORDERS = np.array([xxhash.xxh64_intdigest(b"order", i) for i in range((BANDS * BAND_ROWS + 1) // 2)], np.uint64)


def shingle_hashes(text: bytes) -> np.ndarray:
    """The text's set of five-word shingles as sorted hashes."""
    return np.unique(hashes(shingles(text.lower().split(), 5), 0))


def least_hashes(grams: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of ``BANDS * BAND_ROWS`` orders, two of 32 bits from one of 64."""
    low, high = (np.full(len(_ORDERS), 0xFFFFFFFF, np.uint32) for _ in range(2))
    for i in range(0, len(grams), 1 << 12):   # bounds the memory of very long texts
        mixed = _mix(grams[i:i + (1 << 12)] ^ _ORDERS[:, None])
        np.minimum(low, mixed.astype(np.uint32).min(axis=1), out=low)
        np.minimum(high, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=1), out=high)
    return np.concatenate([low, high])[:BANDS * BAND_ROWS]


def band_keys(grams: np.ndarray) -> list[int]:
    """A key for each band; an empty set has none."""
    if not len(grams):
        return []
    rows = least_hashes(grams).reshape(BANDS, BAND_ROWS)
    return [signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)]


def signature(text: bytes) -> tuple:
    """Digest of the shingle set (two longs), its size, its SimHashes and its bands."""
    grams = shingle_hashes(text)
    digest = xxhash.xxh3_128_intdigest(grams.tobytes())
    prints = (signed(fold_bits(_mix(grams ^ o))) for o in _ORDERS[:len(SIGNATURE)])
    return signed(digest >> 64), signed(digest & (1 << 64) - 1), len(grams), *prints, band_keys(grams)


def most_bits(similarity: float, bits: int = 256) -> int:
    """Differing bits of sets of equal size and this Jaccard similarity: expectation and seven standard deviations."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return min(bits, ceil(bits * p + 7 * sqrt(bits * p * (1 - p))))


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, grams): the sets of shingle hashes of the texts in ``docs`` (id, text) with these ids."""
    @F.arrow_udf("array<long>")
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t.as_py()).view(np.int64) for t in texts], type=pa.list_(pa.int64()))

    return stored(join_small(docs, ids.distinct(), "id").select("id", grams("text").alias("grams")).distinct(), "shingle-sets")


def _similar(x: str, y: str, similarity: float) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common / (F.size(x) + F.size(y) - common) >= similarity


def alike(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ids (a, b) whose texts in ``docs`` (id, text) have this exact Jaccard similarity of shingle sets."""
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    entries = sets.agg(F.sum(F.size("grams") + 1)).first()[0] or 0
    side = F.broadcast(sets) if entries <= BROADCAST_ENTRIES else sets
    both = (pairs.join(side.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
            .join(side.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b"))
    return both.where(_similar("x", "y", similarity)).select("a", "b")


def _distance(a: str, b: str) -> Column:
    """Differing signature bits of columns ``a`` and ``b``, each a prefix of the signature's names."""
    return sum((F.bit_count(F.col(a + s).bitwiseXOR(F.col(b + s))) for s in SIGNATURE), F.lit(0))


def _named(spots: DataFrame, prefix: str) -> DataFrame:
    """The spots with all columns but ``key`` prefixed."""
    return spots.select("key", *[F.col(c).alias(prefix + c) for c in spots.columns if c != "key"])


def _split(spots: DataFrame, found: DataFrame) -> DataFrame:
    """The spots with their points' ``component``, where a key has more than one."""
    now = spots.drop("component").join(found.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    now = stored(now, "spots")
    keys = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    return stored(join_small(now, keys, "key"), "split-spots")


def _anchored(points: DataFrame) -> DataFrame:
    """Pairs (a > b) of points whose first SimHash is equal, or at most three bits apart by the anchors of the covering code."""
    prints = points.where("n > 0").select("point", F.col(SIGNATURE[0]).alias("fp"))
    firsts = stored(prints.groupBy("fp").agg(F.min("point").alias("first")), "fingerprints")
    equal = prints.join(firsts, "fp").where("point != first").select(F.col("point").alias("a"), F.col("first").alias("b"))
    near = simhash_links(firsts.select("fp")).distinct()
    for c in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_point")), c)
    return equal.unionByName(near.select(F.greatest("a_point", "b_point").alias("a"), F.least("a_point", "b_point").alias("b")))


def linked(points: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(node, component) of the graph of all ``points`` that meet and whose ``texts`` (id, text) are alike.

    Points meet by the anchors of their fingerprints first. Then those that share a band do: two rounds compare every text with one
    text per key, the first and one by a hash, so a group of copies becomes one component with as many pairs as members. Then all texts of
    a key are compared that are not in one component yet: a pair left out is connected already. Where these are many, as in a
    family of unlike variants, the sets come along and are compared in the join, so that only links leave it.
    Sets of unlike sizes cannot be similar and are not compared.
    """
    limit = most_bits(similarity)

    def meet(live: DataFrame, others: DataFrame, condition: Column) -> DataFrame:
        left, right = _named(live, "a_"), _named(others, "b_").withColumnRenamed("key", "b_key")
        sizes = F.least("a_n", "b_n") / F.greatest("a_n", "b_n") >= similarity
        near = (F.col("key") == F.col("b_key")) & (F.col("a_component") != F.col("b_component")) & sizes & (_distance("a_", "b_") <= limit)
        pairs = left.join(right, near & condition).select(F.greatest("a_point", "b_point").alias("a"), F.least("a_point", "b_point").alias("b")).distinct()
        return stored(pairs, "pairs")

    links = stored(alike(stored(_anchored(points), "anchored-pairs"), texts, similarity), "links")
    found = stored(components(links), "components")
    # only keys and points are shuffled until it is known which keys hold more than one component
    spots = (points.join(found.withColumnRenamed("node", "point"), "point", "left")
             .select(F.explode("bands").alias("key"), "point", F.coalesce("component", "point").alias("component")))
    keys = spots.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    live = stored(join_small(spots, keys, "key").join(points.select("point", "n", *SIGNATURE), "point"), "spots")
    for rank in (F.col("point"), F.xxhash64("point")):
        hubs = live.join(live.groupBy("key").agg(F.min_by("point", rank).alias("hub")), "key").where("point = hub").drop("hub")
        links = stored(links.unionByName(alike(meet(live, hubs, F.lit(True)), texts, similarity)), "links")
        found = stored(components(links), "components")
        live = _split(live, found)
    crowded = live.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > CROWD).select("key")
    crowd, few = join_small(live, crowded, "key"), join_small(live, crowded, "key", "left_anti")
    once = F.col("a_point") < F.col("b_point")
    sets = shingle_sets(texts, crowd.select(F.col("point").alias("id")))
    crowd = stored(crowd.join(sets.withColumnRenamed("id", "point"), "point"), "crowd")
    links = links.unionByName(meet(crowd, crowd, once & _similar("a_grams", "b_grams", similarity))).unionByName(alike(meet(few, few, once), texts, similarity))
    return stored(components(stored(links, "links")), "components")


def duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (``id``) of documents that copy, exactly or nearly, another one with a smaller id.

    Texts are alike if the exact Jaccard similarity of their sets of five-word shingles (as 64-bit
    hashes) is ``similarity`` or more. Candidates meet by the anchors of ``simhash_links``, or share a band of least hashes of
    these sets: at 0.8 all but one pair in 20,000 do, wherever the edits lie. All texts of a band
    meet, unless links connect them already; a 256-bit SimHash only preselects, seven standard
    deviations wide. Texts with equal sets are one point from the start.
    Rows without an id are never reported; an id with several texts is alike where one of them is.
    """
    run = per_text(signature, "d0 long, d1 long, n long, " + ", ".join(f"{c} long" for c in SIGNATURE) + ", bands array<long>")
    prints = stored(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), run(utf8(text_col)).alias("r"))
                    .select("id", "r.*"), "signatures")
    firsts = stored(prints.groupBy("d0", "d1").agg(F.min("id").alias("point")), "points")
    marked = stored(prints.join(firsts, ["d0", "d1"]).drop("d0", "d1"), "marked")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    # a point's first document goes if the point does; its others go in any case
    inside = marked.where("id != point").select("id")
    found = linked(marked.where("id = point").drop("id"), texts, similarity)
    inside = inside.unionByName(found.where("node != component").select(F.col("node").alias("id")))
    return stored(inside.distinct(), "duplicates")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents without near duplicates of a smaller ``doc_id``, columns unchanged.

    Repeated rows of equal id and text become one row. Rows of one id with unlike texts are
    documents of their own, ordered by a hash of the text: each stays unless it is alike one before it.
    Rows without an id stay. Long texts are compared whole; an empty table gives no rows.
    """
    texts = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id IS NOT NULL")
    unlike = named.groupBy("doc_id").agg(F.min(texts).alias("low"), F.max(texts).alias("high"), F.count("*").alias("n")).where("n > 1")
    repeated = unlike.agg(F.count("*").alias("ids"), F.count_if(F.col("low") != F.col("high")).alias("unlike")).first()
    if repeated["unlike"]:
        # a number of its own for each row, in the order of ids, stands in for the id
        rows = named.select(F.lit("").alias("all"), F.col("doc_id").alias("first"), texts.alias("second"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        placed = stored(ranked(rows, "all", ["first", "second"]).select("idx", "row"), "numbered")
        gone = duplicates(placed.select(F.col("idx").alias("doc_id"), "row.text"), similarity)
        kept = join_small(placed, gone.withColumnRenamed("id", "idx"), "idx", "left_anti").select("row.*")
    else:
        gone = duplicates(named, similarity).withColumnRenamed("id", "doc_id")
        kept = join_small(named, gone, "doc_id", "left_anti")
        if repeated["ids"]:
            kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))
