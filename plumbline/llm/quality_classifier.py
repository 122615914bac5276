"""Quality classifier: a factorisation machine over words and structure statistics.

The score is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` through the logistic
function. The pairwise sum costs time linear in the number of features, as
``(square of sum - sum of squares) / 2`` in each factor.

Inputs of a score are the text alone: hashed words, structure statistics, and the text's
length in bytes and words as its metadata. Each text's word weights sum to one in square,
so a long text is not surer than a short one by its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import texts_of
from plumbline.llm.quality_rules import base_counts
from plumbline.llm.ragged import offsets_of
from plumbline.llm.texts import Hashes, Part, parts, words

BUCKETS = 1 << 15
FACTORS = 8
#: Most labelled documents that training looks at, chosen by a hash of the identifier.
TRAINING_DOCUMENTS = 5000
EPOCHS = 8
BATCH = 64
LEARNING_RATE = 0.05
PENALTY = 1e-5
SEED = 7

#: The statistics, in the order of their features.
STATISTICS = (
    "log_bytes", "log_words", "word_chars", "upper", "digits", "signs", "exclamations",
    "symbols", "line_feeds", "duplicate_lines", "repeated_words", "distinct_words", "non_ascii",
)


def _share(mask: np.ndarray, part: Part) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    sums = total[part.offsets[1:]] - total[part.offsets[:-1]]
    return sums / np.maximum(np.diff(part.offsets), 1)


def features(part: Part, buckets: int = BUCKETS):
    """Word features as ragged (bucket, weight), and the statistics: texts x statistics."""
    found, hashes = words(part), Hashes(part.data)
    word_hashes = hashes.of(found.starts, found.ends)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    keys = (found.text_of.astype(np.int64) * buckets) + (word_hashes >> shift).astype(np.int64)
    distinct, counts = np.unique(keys, return_counts=True)
    text, bucket = distinct // buckets, distinct % buckets
    weights = np.sqrt(counts)
    norms = np.sqrt(np.bincount(text, weights=weights**2, minlength=len(part)))
    weights = weights / norms[text]
    offsets = offsets_of(np.bincount(text, minlength=len(part)))
    data = part.data
    base = base_counts(part, found, hashes)
    n_words = np.maximum(base["n_words"], 1)
    letter_upper = (data >= 0x41) & (data <= 0x5A)
    digit = (data >= 0x30) & (data <= 0x39)
    sign = (data > 0x20) & (data < 0x7F) & ~digit & ~letter_upper & ~((data >= 0x61) & (data <= 0x7A))
    statistics = np.column_stack(
        [
            np.log1p(np.diff(part.offsets)),
            np.log1p(base["n_words"]),
            np.log1p(base["word_chars"] / n_words),
            _share(letter_upper, part),
            _share(digit, part),
            _share(sign, part),
            _share(data == 0x21, part),
            base["n_symbols"] / n_words,
            _share(data == 0x0A, part),
            np.log1p(base["n_dup_lines"]),
            base["n_repeat_words"] / n_words,
            np.diff(offsets) / n_words,
            _share(data >= 0x80, part),
        ]
    )
    return bucket, weights.astype(np.float32), offsets, statistics.astype(np.float32)


def _sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The values' sum for each of n texts; numbers also where no text has any."""
    return np.bincount(text, weights=values, minlength=n).astype(np.float64)


@dataclass
class Model:
    """Weights and factors: words first, then statistics (standardised)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    means: np.ndarray
    spreads: np.ndarray

    def standardised(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.means) / self.spreads, -6, 6) / np.sqrt(len(STATISTICS))

    def raw_scores(self, bucket, weights, offsets, statistics) -> np.ndarray:
        """Scores before the logistic function, in time linear in the features."""
        n = len(offsets) - 1
        text = np.repeat(np.arange(n), np.diff(offsets))
        x = self.standardised(statistics)
        first = len(self.linear) - x.shape[1]
        scores = self.bias + x @ self.linear[first:]
        scores += _sums(text, self.linear[bucket] * weights, n)
        for f in range(self.factors.shape[1]):
            of_words = self.factors[bucket, f] * weights
            of_statistics = x * self.factors[first:, f]
            total = _sums(text, of_words, n) + of_statistics.sum(axis=1)
            squares = _sums(text, of_words**2, n) + (of_statistics**2).sum(axis=1)
            scores += (total**2 - squares) / 2
        return scores


def logistic(scores: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], buckets: int = BUCKETS) -> Model:
    """Fit by Adagrad in fixed order; without examples every score is one half."""
    size = buckets + len(STATISTICS)
    generator = np.random.default_rng(SEED)
    model = Model(
        0.0,
        np.zeros(size, dtype=np.float32),
        generator.normal(0, 0.01, (size, FACTORS)).astype(np.float32),
        np.zeros(len(STATISTICS), dtype=np.float32),
        np.ones(len(STATISTICS), dtype=np.float32),
    )
    if not examples:
        model.factors[:] = 0
        return model
    statistics = np.stack([e[2] for e in examples])
    model.means = statistics.mean(axis=0)
    model.spreads = np.maximum(statistics.std(axis=0), 1e-3)
    scaled = model.standardised(statistics).astype(np.float32)
    labels = np.array([e[3] for e in examples], dtype=np.float32)
    tail = np.arange(buckets, size)
    seen = [np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6]
    for _ in range(EPOCHS):
        order = generator.permutation(len(examples))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            ids = np.concatenate([np.append(examples[r][0], tail) for r in rows])
            x = np.concatenate([np.append(examples[r][1], scaled[r]) for r in rows])
            counts = [len(examples[r][0]) + len(tail) for r in rows]
            starts = np.cumsum([0, *counts[:-1]])
            text = np.repeat(np.arange(len(rows)), counts)
            weighted = model.factors[ids] * x[:, None]
            sums = np.add.reduceat(weighted, starts)
            squares = np.add.reduceat(weighted**2, starts)
            raw = model.bias + np.add.reduceat(model.linear[ids] * x, starts)
            raw += ((sums**2 - squares) / 2).sum(axis=1)
            error = (logistic(raw) - labels[rows]) / len(rows)
            used, place = np.unique(ids, return_inverse=True)
            by_linear = error[text] * x
            gradient = np.bincount(place, weights=by_linear, minlength=len(used))
            gradient += PENALTY * model.linear[used]
            seen[0][used] += gradient**2
            model.linear[used] -= LEARNING_RATE * gradient / np.sqrt(seen[0][used])
            by_factor = by_linear[:, None] * (sums[text] - weighted)
            folded = np.zeros((len(used), FACTORS), dtype=np.float32)
            np.add.at(folded, place, by_factor)
            folded += PENALTY * model.factors[used]
            seen[1][used] += folded**2
            model.factors[used] -= LEARNING_RATE * folded / np.sqrt(seen[1][used])
            step = float(error.sum())
            seen[2] += step * step
            model.bias -= LEARNING_RATE * step / np.sqrt(seen[2])
    return model


def training_examples(
    docs: DataFrame, labels: DataFrame, identifier: str, text: str, label: str, limit: int
) -> list[tuple]:
    """Features and labels of at most ``limit`` labelled documents, in a fixed order.

    The choice is by a hash of the identifier. At most ``limit`` identifiers are
    broadcast, and texts become features where they lie.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(identifier).isNotNull())
        .groupBy(identifier)
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64(identifier), identifier)
        .limit(limit)
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(1)):
                bucket, weights, offsets, statistics = features(part)
                low = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        batch.column(2).slice(part.first, len(part)),
                        pa.ListArray.from_arrays(low, pa.array(bucket, pa.int32())),
                        pa.ListArray.from_arrays(low, pa.array(weights, pa.float32())),
                        pa.FixedSizeListArray.from_arrays(
                            pa.array(statistics.reshape(-1)), statistics.shape[1]
                        ).cast(pa.list_(pa.float32())),
                    ],
                    names=["id", "label", "buckets", "weights", "statistics"],
                )

    source = texts_of(docs, identifier, text).join(F.broadcast(chosen), identifier)
    kind = source.schema[identifier].dataType.simpleString()
    found = source.select(identifier, text, "_label").mapInArrow(
        extract,
        f"id {kind}, label int, buckets array<int>, weights array<float>, statistics array<float>",
    )
    rows = found.toArrow().sort_by("id")
    return [
        (np.array(b.values), np.array(w.values), np.array(s.values), y)
        for b, w, s, y in zip(
            rows["buckets"], rows["weights"], rows["statistics"], rows["label"].to_pylist()
        )
    ]


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the ``score`` (0 to 1) of every text, in one pass without a shuffle.

    A column that is called like the score is replaced.
    """
    docs = docs.drop(score)
    place = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                logistic(sent.value.raw_scores(*features(part))) for part in parts(batch.column(place))
            ]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score]
            )

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def is_held_out(identifier: str):
    """Whether a document is kept from training: crc32 of the identifier as text, mod 5."""
    return F.coalesce(F.crc32(F.col(identifier).cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    limit: int = TRAINING_DOCUMENTS,
) -> Model:
    """A model from labelled documents that are not held out.

    A document labelled more than once has the larger label; null labels and identifiers
    are left out.
    """
    usable = labels.where(~is_held_out(identifier)).select(identifier, label)
    return train(training_examples(docs, usable, identifier, text, label, limit))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float,
    identifier: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """One row per document: the identifier, ``held_out``, ``score``, ``predicted``.

    A null text is an empty one and has a score like any other. Rows with a null or
    repeated identifier come out as they went in. Without labels all scores are one half.
    """
    model = fit(docs, labels, identifier, text, label)
    scored = with_scores(texts_of(docs, identifier, text), model, text, "score")
    return scored.select(
        identifier,
        is_held_out(identifier).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
