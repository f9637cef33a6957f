"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1 in the training folds; every document is
unlabelled text. With squared loss the unbiased risk

    prior * E_pos[(1-f)^2]/4  +  max(0, E_all[(1+f)^2]/4 - prior * E_pos[(1+f)^2]/4)

depends on the data only through first and second moments of the features. One pass over
all documents adds them up, and the non-negative risk is minimised on those sums, whose
size is that of the feature list and not of the corpus. Negative labels serve only to
estimate the class prior.

Features are counts and shares of a text's characters, words and lines, each spread over
hinges whose knots are quantiles over all documents. Labels, ids, language and source are
never features.

Defined results: null and empty texts are scored as the text with zero counts; a document
with conflicting label rows is no positive; labels of unknown documents do nothing; without
any positive every score is the prior; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8

STATS = ("log_bytes", "log_words", "log_lines", "word_length", "long_words", "short_words", "upper_words", "title_words",
         "plain_words", "upper", "digits", "symbols", "marks", "stops", "brackets", "beyond_ascii", "spaces", "distinct_words",
         "top_word", "runs", "repeated_lines", "longest_line", "ratio")
QUANTILES = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)


def _set(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, np.uint8)


UPPER, DIGITS, SYMBOLS = _set(bytes(range(65, 91))), _set(b"0123456789"), _set(b"#*$%&|<>@^~_=+\\")
MARKS, STOPS, BRACKETS, SPACES = _set(b"!?"), _set(b".,;:'\"-"), _set(b"()[]{}/"), _set(b" \t\n\v\f\r")


def text_stats(text: bytes) -> list[float]:
    """The values of STATS for one text; all finite."""
    words, size = text.split(), max(1, len(text))
    n = max(1, len(words))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    length = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    share = lambda group: byte[group].sum() / size
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), length.sum() / n, (length > 12).sum() / n,
        (length <= 3).sum() / n, sum(map(bytes.isupper, words)) / n, sum(map(bytes.istitle, words)) / n,
        sum(map(bytes.isalpha, words)) / n, share(UPPER), share(DIGITS), share(SYMBOLS), share(MARKS), share(STOPS),
        share(BRACKETS), byte[128:].sum() / size, share(SPACES), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(max(map(len, lines), default=0)), min(2.0, len(zstandard.ZstdCompressor(level=1).compress(text)) / size)]


@dataclass(frozen=True)
class Model:
    knots: np.ndarray        # by statistic, ascending, distinct ones only
    weights: np.ndarray | None
    prior: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        return basis(stats, self.knots)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.clip((1 + self.features(stats) @ self.weights) / 2, 0, 1)


def basis(stats: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    """One, and for each statistic a ramp between every two neighbouring knots, from 0 to 1."""
    columns = [np.ones((len(stats), 1))]
    for j, at in enumerate(knots):
        if len(at) > 1:
            columns.append(np.clip((stats[:, j:j + 1] - at[:-1]) / np.diff(at), 0, 1))
    return np.hstack(columns)


def stats_column(text: str | Column) -> Column:
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.asarray(text_stats(t.as_py()), np.float32) for t in texts], type=pa.list_(pa.float32()))

    return run(utf8(text))


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), len(STATS))


def training_labels(labels: DataFrame, training: Column, id_col: str = "doc_id") -> DataFrame:
    """One row per labelled document of the training folds; its least label counts."""
    return (labels.where(training & F.col("quality").isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id")).agg((F.min("quality") == 1).alias("positive")))


def class_prior(known: DataFrame) -> float:
    """Share of positives among labelled training documents, with one pseudo-count each."""
    n, positive = known.agg(F.count("*"), F.count_if("positive")).first()
    return (positive + 1) / (n + 2)


def _moments(stats: DataFrame, knots: list[np.ndarray]) -> dict[bool, np.ndarray]:
    """Sums of products of all feature pairs, over all documents (False) and the positives (True)."""

    def partial(batches):
        sums = {}
        for batch in batches:
            x = basis(_matrix(batch.column("stats")), knots)
            sums[False] = sums.get(False, 0) + x.T @ x
            if (mine := batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)).any():
                sums[True] = sums.get(True, 0) + x[mine].T @ x[mine]
        for side, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({"side": [side] * len(i), "i": i, "j": j, "v": m[i, j]})

    rows = (stats.mapInArrow(partial, "side boolean, i long, j long, v double")
            .groupBy("side", "i", "j").agg(F.sum("v").alias("v")).collect())   # one row per pair of features
    size = 1 + sum(max(0, len(k) - 1) for k in knots)
    out = {s: np.zeros((size, size)) for s in (False, True)}
    for r in rows:
        out[r.side][r.i, r.j] = out[r.side][r.j, r.i] = r.v
    return out


def minimise(m_all: np.ndarray, m_pos: np.ndarray, prior: float, ridge: float, steps: int = 3000, rate: float = 0.5) -> np.ndarray:
    """Weights of least non-negative risk; ``m_*`` are mean products, feature 0 is constant one.

    Steps are preconditioned by the moments of all text. Where the bracketed part of the risk
    turns negative, a step raises it again instead of following the rest.
    """
    size = len(m_all)
    penalty = ridge * np.eye(size)
    penalty[0, 0] = 0
    condition = np.linalg.inv(m_all / 2 + 2 * penalty + 1e-9 * np.eye(size))
    w = np.zeros(size)
    w[0] = 2 * prior - 1
    for _ in range(steps):
        all_w, pos_w = m_all @ w, m_pos @ w
        rest = ((1 + 2 * all_w[0] + w @ all_w) - prior * (1 + 2 * pos_w[0] + w @ pos_w)) / 4
        rest_slope = (m_all[0] + all_w - prior * (m_pos[0] + pos_w)) / 2
        slope = prior * (pos_w - m_pos[0]) / 2 + rest_slope + 2 * penalty @ w if rest >= 0 else -rest_slope
        step = rate * condition @ slope
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
        prior: float | None = None) -> tuple[Model, DataFrame]:
    """The model, and the statistics of all documents (id, stats) as a stored table."""
    known = stored(training_labels(labels, training, id_col), "quality-labels")
    stats = stored(docs.select(F.col(id_col).alias("id"), stats_column(text_col).alias("stats")), "quality-stats")
    prior = class_prior(known) if prior is None else prior
    marks = stats.agg(*[F.percentile_approx(F.col("stats")[i].cast("double"), list(QUANTILES), 2000).alias(s)
                        for i, s in enumerate(STATS)],
                      *[F.array(F.min(F.col("stats")[i].cast("double")), F.max(F.col("stats")[i].cast("double"))).alias(f"{s}_ends")
                        for i, s in enumerate(STATS)]).first()
    knots = [np.unique([v for v in (*(marks[s] or ()), *marks[f"{s}_ends"]) if v is not None]) for s in STATS]
    marked = stats.join(known.where("positive"), "id", "left").select("stats", F.coalesce("positive", F.lit(False)).alias("positive"))
    sums = _moments(marked, knots)
    n_all, n_pos = sums[False][0, 0], sums[True][0, 0]
    # few positives have noisy moments: the penalty shrinks as they grow in number
    weights = minimise(sums[False] / n_all, sums[True] / n_pos, prior, 1e-3 + 3 / n_pos) if n_all and n_pos else None
    return Model(knots, weights, prior), stats


def score_column(model: Model, stats: Column) -> Column:
    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(np.round(model.score(_matrix(values)), 9))

    return run(stats)


def score_texts(model: Model, text: str | Column) -> Column:
    """Score straight from the text, for filters that keep all columns and shuffle nothing."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        stats = np.array([text_stats(t.as_py()) for t in texts], np.float32).reshape(len(texts), len(STATS))
        return pa.array(np.round(model.score(stats.astype(np.float64)), 9))

    return run(utf8(text))


def fold(id_col: str | Column = "doc_id") -> Column:
    """0 to 3 by the checksum of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")).cast("binary")) % 4


def classify(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model, stats = fit(docs, labels, fold() != held_out_fold)
    return (stats.select(F.col("id").alias("doc_id"), (fold("id") == held_out_fold).alias("held_out"),
                         score_column(model, F.col("stats")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_quality(docs: DataFrame, labels: DataFrame, held_out_fold: int = 2, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, unchanged."""
    model, _ = fit(docs, labels, fold() != held_out_fold)
    return docs.where(score_texts(model, "text") >= threshold)
