"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs, one of a trusted
target and one of the whole raw corpus; a document's score is the mean over its n-grams,
and one threshold decides about every document, without chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts_of
from plumbline.llm.texts import Hashes, Part, SliceHashes, Words, paired, parts, windows, words

BUCKETS = 1 << 16
#: Added to every bucket's count.
SMOOTHING = 1.0
#: Documents whose mean ratio is below this are dropped.
THRESHOLD = -0.25
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def ngram_buckets(part: Part, found: Words, hashes: Hashes | SliceHashes, buckets: int):
    """Buckets of all words and word pairs, and the text of each."""
    word_hashes = hashes.of(found.starts, found.ends)
    first, pair_text = windows(found, 2)
    pairs = paired(word_hashes[first], word_hashes[first + 1])
    all_hashes = np.concatenate([word_hashes, pairs])
    # the upper bits: buckets is a power of two
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return (all_hashes >> shift).astype(np.int64), np.concatenate([found.text_of, pair_text])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal key is in the same text at all, and whether in an earlier place."""
    key = paired(keys, text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[order][1:] == key[order][:-1]
    later = np.zeros(len(key), dtype=bool)
    later[order] = same
    shared = same.copy()
    shared[:-1] |= same[1:]
    anywhere = np.zeros(len(key), dtype=bool)
    anywhere[order] = shared
    return anywhere, later


def base_counts(part: Part, found: Words, hashes: Hashes | SliceHashes) -> dict[str, np.ndarray]:
    """The base counts of every text of a part."""
    data = part.data
    n_words = found.counts
    leads = (data & 0xC0) != 0x80
    code_points = np.concatenate([[0], np.cumsum(leads)])
    word_chars = np.concatenate([[0], np.cumsum(code_points[found.ends] - code_points[found.starts])])
    # lines: texts and line feeds end them
    feeds = np.flatnonzero(data == 0x0A)
    stops = np.sort(np.concatenate([feeds, part.offsets[1:]]), kind="stable")
    text = np.repeat(np.arange(len(part)), _per_text(data == 0x0A, part.offsets) + 1)
    starts = np.empty_like(stops)
    starts[1:] = stops[:-1] + 1
    is_first = np.concatenate([[True], text[1:] != text[:-1]])
    starts[is_first] = part.offsets[:-1]
    has_word = np.searchsorted(found.starts, stops) > np.searchsorted(found.starts, starts)
    starts, stops, text = starts[has_word], stops[has_word], text[has_word]
    _, later = _repeated(hashes.of(starts, stops), text)
    # words in three-word windows that occur twice or more
    word_hashes = hashes.of(found.starts, found.ends)
    first, window_text = windows(found, 3)
    triples = paired(paired(word_hashes[first], word_hashes[first + 1]), word_hashes[first + 2])
    again, _ = _repeated(triples, window_text)
    covered = np.zeros(len(found.starts), dtype=bool)
    for step in range(3):
        covered[first[again] + step] = True
    return {
        "n_words": n_words,
        "word_chars": np.diff(word_chars[found.offsets]),
        "n_symbols": _per_text(_IS_SYMBOL[data], part.offsets),
        "n_dup_lines": np.bincount(text[later], minlength=len(part)),
        "n_repeat_words": _per_text(covered, found.offsets),
    }


def corpus_counts(docs: DataFrame, trusted: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: n-grams of all texts, and of those where ``trusted`` holds.

    Each task adds up its texts first, so it sends at most ``buckets`` rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(buckets, dtype=np.int64)
        target = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            for part in parts(batch.column(0)):
                found = words(part)
                bucket, of = ngram_buckets(part, found, SliceHashes(part.data), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                wanted = chosen[part.first : part.first + len(part)][of].astype(bool)
                target += np.bincount(bucket[wanted], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(raw[used]), pa.array(target[used])],
            names=["bucket", "raw", "target"],
        )

    source = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(trusted), F.lit(False))
    )
    counted = source.mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw): as many numbers as buckets.

    Without any target text the ratios are all 0.
    """
    raw = np.full(buckets, smoothing)
    target = np.full(buckets, smoothing)
    for row in counts.toPandas().itertuples():
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if (target == smoothing).all():
        return np.zeros(buckets, dtype=np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``score``, ``kept``.

    ``trusted`` holds the identifiers of the target's documents; the raw corpus is all
    of ``docs``. A null text is an empty one: no words, base_failed, score 0. Rows with a
    null or repeated identifier come out as they went in (a repeated one is trusted as
    often as it occurs). Two passes over the texts; the first one's join with the
    identifiers is the only shuffle of texts.
    """
    source = texts_of(docs, identifier, text)
    marks = trusted.select(identifier).distinct().withColumn("_trusted", F.lit(True))
    # the same plan at every size: a broadcast of the identifiers would not last
    marked = source.join(marks.hint("shuffle_hash"), identifier, "left")
    ratios = log_ratios(corpus_counts(marked, "_trusted", text, buckets), buckets)
    sent = source.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch.column(1)):
                found, hashes = words(part), SliceHashes(part.data)
                counts = base_counts(part, found, hashes)
                bucket, of = ngram_buckets(part, found, hashes, buckets)
                total = np.bincount(of, weights=sent.value[bucket], minlength=len(part))
                mean = total / np.maximum(np.bincount(of, minlength=len(part)), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        *(pa.array(c, pa.int64()) for c in counts.values()),
                        pa.array(mean, pa.float64()),
                    ],
                    names=[identifier, *counts, "score"],
                )

    kind = source.schema[identifier].dataType.simpleString()
    scored = source.mapInArrow(
        score,
        f"`{identifier}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint, score double",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= threshold)
    )
