"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and repeated three-word windows. Texts
that pass them are judged by zstandard ratios (compressed over raw bytes): of the whole
text, whose band depends on its length, and of fixed chunks, which finds a repetitive or
incompressible stretch that the whole hides.

Defined results: null and empty texts have zero counts and fail the base rules; a text of
one endless word has one word; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, utf8

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)


@dataclass(frozen=True)
class Bands:
    """``whole``: (longest text in bytes, least ratio, greatest ratio), by length.

    Below a ratio a text is repetitive, above it incompressible. ``chunk_share``: share of chunks
    outside ``chunk`` that rejects. The limits are fixed values, set from ratios of the 17,000
    good texts (quality 1) among the labels of a corpus of 51,000 documents in four languages: from 1 to
    64 KiB some four hundredths outside their least and greatest ratio at that length. Shorter texts, of few
    repeats, and longer ones, of which there were few, get wider bands.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (512, 0.35, 0.85), (1024, 0.35, 0.73), (2048, 0.443, 0.64), (4096, 0.43, 0.59),
        (8192, 0.408, 0.55), (65536, 0.375, 0.52), (float("inf"), 0.20, 0.52))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.28, 0.56)
    chunk_share: float = 0.25


@dataclass(frozen=True)
class BaseRules:
    min_words: int = 50
    repeat_percent: int = 50


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:   # three ids would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    hit = count[place] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows)."""
    words = text.split()
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - byte[0x80:0xC0].sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(points - byte[SPACES].sum()), int(byte[SYMBOLS].sum()),
            len(lines) - len(set(lines)), repeated_window_words(words))


def compression(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole, share of chunks outside their band, verdict)."""
    if not text:
        return 0.0, 0.0, False
    ratio = len(packer.compress(text)) / len(text)
    low, high = next((b[1], b[2]) for b in bands.whole if len(text) <= b[0])
    # the last chunk takes the rest, so that no chunk is shorter than the others
    starts = range(0, max(1, len(text) // bands.chunk_bytes) * bands.chunk_bytes, bands.chunk_bytes)
    view = memoryview(text)
    outside = 0
    if len(starts) > 1:
        for i in starts:
            part = view[i:] if i == starts[-1] else view[i:i + bands.chunk_bytes]
            outside += not bands.chunk[0] <= len(packer.compress(part)) / len(part) <= bands.chunk[1]
    share = outside / len(starts)
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  base: BaseRules = BaseRules(), bands: Bands = Bands()) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``kept``, ``ratio``, ``chunks_outside``."""

    def judge(text: bytes) -> tuple:
        counts = base_counts(text)
        failed = counts[0] < base.min_words or 100 * counts[4] > base.repeat_percent * counts[0]
        ratio, share, good = compression(text, bands, zstandard.ZstdCompressor(level=bands.level))
        return (*counts, failed, not failed and good, ratio, share)

    run = per_text(judge, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                          "base_failed boolean, kept boolean, ratio double, chunks_outside double")
    return docs.select(F.col(id_col).alias("id"), run(utf8(text_col)).alias("r")).select(F.col("id").alias(id_col), "r.*")
