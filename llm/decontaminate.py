"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. Seeds of a test item are all its 3-grams,
whatever number of items share them, and in each window of four 2-grams the one that fewest items have,
so seeds cover all of an item. Where a seed occurs in a
document, the item is aligned with the words around it, so edited and paraphrased copies
count by what is left of them. A document matches an item if the best local alignment
reaches ``least`` of the score of the whole item. Places where words in common, in any order,
cannot add up to that score are not aligned; this loses nothing.

A copy whose words are replaced only, by fewer than a third, has three words in a row left, hence a seed. Copies with
a word put in after every second one, or with every third one replaced, meet by 2-grams. A copy
without two words in a row that are seeds is not found.

The test items are a stated query set: they are taken in blocks of bounded size, and each
block goes over all documents, whole texts, where they lie. Nothing is shuffled, and a
passage that a third of the documents share costs no more than any other.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8
from .substring_dedup import _WordHash, gram_hashes, word_hashes

WORD = re.compile(r"\w+")
BLOCK_WORDS = 200_000     # words of test items in one block
MATCH, MISMATCH, GAP = 2, -1, -1
_MEMO = 20_000
_AREAS = 4096             # areas looked at together


@dataclass(frozen=True)
class Rules:
    whole_words: int = 3     # items of no more words are one seed
    sizes: tuple[tuple[int, int], ...] = ((3, 1), (2, 4))   # words of a seed; of so many in a row the rarest is one
    least: float = 0.5       # share of an item's own score


_NO_WORD = bytes(c if c < 128 and WORD.match(chr(c)) else 32 for c in range(256))   # ASCII that is in no word becomes a space


def _words(text: bytes) -> list[bytes] | list[str]:
    """The words; those of a text that is not ASCII stay decoded, as they hash alike."""
    if text.isascii():
        return text.lower().translate(_NO_WORD).split()
    return WORD.findall(text.decode(errors="replace").lower())


def normal_words(text: bytes) -> list[bytes]:
    return [w if isinstance(w, bytes) else w.encode() for w in _words(text)]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, last word in the item, last word in the passage) of the best local alignment.

    Row by row; a gap along a row costs GAP a word, so it is a running maximum.
    """
    slope = -GAP * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), (0, -1, -1)
    for i, word in enumerate(item):
        fresh = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP, out=fresh[1:])
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + slope) - slope
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j - 1)
    return best


def aligned_span(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last word in the passage): the start is the end of the reversed alignment."""
    score, i, j = align(item, passage)
    if not score:
        return 0, 0, -1
    _, _, back = align(item[:i + 1][::-1], passage[:j + 1][::-1])
    return score, j - back, j


class Items:
    """A block of test items with an index of their seeds, by seed length."""

    def __init__(self, rows: list, rules: Rules):
        self.rules = rules
        self.words = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
        self.known, self.sizes = [np.unique(w) for w in self.words], np.array([len(w) for w in self.words])
        # words of documents that are in no item are all alike: nothing they take part in can match
        self.hash_of: dict[bytes | str, int] = {}
        for r, words in zip(rows, self.words, strict=True):
            self.hash_of |= zip(r["spelled"], words.tolist(), strict=True)
        self.hash_of |= {w.encode(): h for w, h in self.hash_of.items()}
        # words of all items, and the pairs (item, word) as one ascending number each
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.pairs = np.concatenate([k * len(self.vocabulary) + np.searchsorted(self.vocabulary, w) for k, w in enumerate(self.known)])
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, r in enumerate(rows):
            for s in r["seeds"]:
                by_size.setdefault(s["size"], []).append((s["gram"] & (1 << 64) - 1, k, s["at"]))
        for size, found in by_size.items():
            found.sort()
            self.seeds[size] = (np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found]), np.array([f[2] for f in found]))

    def encode(self, text: bytes) -> np.ndarray:
        words = _words(text)
        return np.fromiter(map(self.hash_of.get, words, repeat(0)), np.uint64, len(words))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places where they would begin, ascending."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for size, (grams, items, at) in self.seeds.items():
            if len(words) < size:
                continue
            mine = gram_hashes(words, size)
            first = np.searchsorted(grams, mine)
            here = np.flatnonzero(grams[np.minimum(first, len(grams) - 1)] == mine)
            if not len(here):
                continue
            first = first[here]
            count = np.searchsorted(grams, mine[here], "right") - first
            k = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append((items[k], np.repeat(here, count) - at[k]))
        items, places = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((places, items))
        return items[order], places[order]

    def enough(self, words: np.ndarray, items: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Areas that hold as many of their item's words as an alignment needs: other words only cost."""
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == words
        total = np.concatenate([[0], np.cumsum(known)])
        need = self.rules.least * self.sizes[items]
        fit = np.flatnonzero(total[end] - total[first] >= need)
        kept = []
        for i in range(0, len(fit), _AREAS):
            part = fit[i:i + _AREAS]
            sizes = end[part] - first[part]
            starts = np.cumsum(sizes) - sizes
            at = np.repeat(first[part] - starts, sizes) + np.arange(sizes.sum())
            keys = np.repeat(items[part], sizes) * len(self.vocabulary) + place[at]
            shared = known[at] & (self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys)
            kept.append(part[np.add.reduceat(shared.astype(np.int64), starts) >= need[part]])
        return np.concatenate([*kept, np.empty(0, np.int64)]).astype(np.int64)

    def bound(self, item: int, passage: np.ndarray) -> int:
        """No alignment scores more: each word of an aligned span, on either side, costs or gains its own part at most."""
        def most(words: np.ndarray, known: np.ndarray) -> int:
            shared = known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words
            total = np.concatenate([[0], np.cumsum(np.where(shared, MATCH, max(MISMATCH, GAP)))])
            return int((total - np.minimum.accumulate(total)).max())

        here = most(passage, self.known[item])
        if here < self.rules.least * MATCH * len(self.words[item]):
            return here
        return min(here, most(self.words[item], np.unique(passage)))

    def matches(self, words: np.ndarray, memo: dict) -> list[dict]:
        """Best match of each item that reaches the least share."""
        out: dict[int, dict] = {}
        items, places = self.hits(words)
        if not len(items):
            return []
        sizes = self.sizes[items]
        slack = sizes // 2 + 4
        first, end = np.maximum(0, places - slack), np.minimum(len(words), places + sizes + slack)
        # overlapping places of one item are one area
        starts = np.flatnonzero(np.concatenate([[True], (items[1:] != items[:-1]) | (first[1:] > end[:-1])]))
        stops = np.append(starts[1:], len(items)) - 1
        items, first, end = items[starts], first[starts], end[stops]
        some = self.enough(words, items, first, end)
        for item, a, b in zip(items[some].tolist(), first[some].tolist(), end[some].tolist(), strict=True):
            if self.bound(item, words[a:b]) < self.rules.least * MATCH * len(self.words[item]):
                continue
            key = (item, words[a:b].tobytes())
            if (found := memo.get(key)) is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                found = memo[key] = aligned_span(self.words[item], words[a:b])
            share = found[0] / (MATCH * len(self.words[item]))
            if share >= self.rules.least and share > out.get(item, {"score": 0})["score"]:
                out[item] = {"item": item, "score": share, "first_word": a + found[1], "n_words": found[2] - found[1] + 1}
        return list(out.values())


def item_table(items: DataFrame, rules: Rules, id_col: str, text_col: str) -> DataFrame:
    """(no, item_id, spelled, words, seeds): words of each item that has any, as text and hashed, and its seeds (size, gram, at)."""
    @F.arrow_udf("struct<spelled: array<string>, words: array<long>, grams: array<struct<size: int, stride: int, at: int, gram: long>>>")
    def run(texts: pa.Array) -> pa.Array:
        known, out = _WordHash(), []
        for t in texts:
            spelled, grams = normal_words(t.as_py()), []
            words = word_hashes(spelled, known)
            sizes = rules.sizes if len(words) > rules.whole_words else ((len(words), 1),) if len(words) else ()
            for size, stride in sizes:
                grams += [{"size": size, "stride": stride, "at": k, "gram": g} for k, g in enumerate(gram_hashes(words, size).view(np.int64).tolist())]
            out.append({"spelled": [w.decode() for w in spelled], "words": words.view(np.int64), "grams": grams})
        gram = pa.struct([("size", pa.int32()), ("stride", pa.int32()), ("at", pa.int32()), ("gram", pa.int64())])
        return pa.array(out, type=pa.struct([("spelled", pa.list_(pa.string())), ("words", pa.list_(pa.int64())), ("grams", pa.list_(gram))]))

    rows = stored(items.select(F.monotonically_increasing_id().alias("no"), F.col(id_col).alias("item_id"), run(utf8(text_col)).alias("r"))
                  .select("no", "item_id", "r.*").where(F.size("words") > 0), "items")
    grams = rows.select("no", F.inline("grams"))
    shared = grams.groupBy("size", "gram").agg(F.count_distinct("no").alias("items"))
    marked = grams.join(shared, ["size", "gram"])
    # a gram is a seed if it is the rarest, of equal ones the first, of some ``stride`` in a row
    listed = marked.groupBy("no", "size", "stride").agg(F.array_sort(F.collect_list(F.struct("at", "items", "gram"))).alias("row"))
    start = F.expr("transform(sequence(0, greatest(size(row) - stride, 0)), i -> array_min(transform(slice(row, i + 1, stride), "
                   "g -> struct(g.items AS items, g.at AS at, g.gram AS gram))))")
    seeds = (listed.select("no", "size", F.explode(F.array_distinct(start)).alias("s"))
             .groupBy("no").agg(F.collect_list(F.struct("size", "s.gram", "s.at")).alias("seeds")))
    return stored(rows.join(seeds, "no").select("no", "item_id", "spelled", "words", "seeds"), "item-seeds")


def _blocks(items: DataFrame, rules: Rules) -> list[tuple[list, Items]]:
    """Item ids and index of each block; a block's rows are read to the driver one block at a time."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == k).collect()
        if rows:
            yield [r["item_id"] for r in rows], Items(rows, rules)


_MATCHES = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def _matches(docs: DataFrame, index: Items, text: Column) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))   # by value: workers need no copy of this package
    held: list[Items] = []

    @F.arrow_udf("array<struct<item: int, score: double, first_word: long, n_words: long>>")
    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(pickle.loads(sent.value))
        memo: dict = {}
        return pa.array([held[0].matches(held[0].encode(t.as_py()), memo) for t in texts], type=_MATCHES)

    return run(text)


def contamination(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Matches: document id, item id, ``score`` (share of the item's own score), ``first_word``, ``n_words``.

    One row per document row and item row that match, with the best place.

    Defined results: null and empty texts, and items without a word, match nothing; an item of
    at most three words is one seed; repeated rows, of either table, each give their rows;
    among places of equal score the first counts; empty tables give no rows.
    """
    out = None
    for ids, index in _blocks(item_table(items, rules, item_col, item_text), rules):
        kind = items.schema[item_col].dataType
        names = docs.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], f"item int, item_id {kind.simpleString()}")
        found = (docs.select(F.col(id_col).alias("id"), F.explode(_matches(docs, index, utf8(text_col))).alias("m")).select("id", "m.*")
                 .join(F.broadcast(names), "item").select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.round("score", 6).alias("score"),
                                                           "first_word", "n_words"))
        out = found if out is None else out.unionByName(found)
    if out is None:   # no item has a word
        kinds = (f"`{n}` {t.schema[n].dataType.simpleString()}" for n, t in ((id_col, docs), (item_col, items)))
        return docs.sparkSession.createDataFrame([], f"{', '.join(kinds)}, score double, first_word long, n_words long")
    return out


def without_benchmark(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that match no item, columns unchanged."""
    for _, index in _blocks(item_table(items, rules, "item_id", "text"), rules):
        docs = docs.where(F.size(_matches(docs, index, utf8(text_col))) == 0)
    return docs
