"""Token counts, and byte-level BPE encoding and decoding of whole texts.

A null text is an empty one: no bytes, no tokens. Rows keep their identifier whatever it
is (null or repeated), one row out per row in; other columns are not read. Both
operators are one pass over the texts without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import array_merging, segment_tree
from plumbline.llm.common import texts_of
from plumbline.llm.pretokens import split
from plumbline.llm.ragged import take
from plumbline.llm.texts import Part, parts
from plumbline.llm.vocabulary import Vocabulary, broadcast_file, from_json, from_ranks

_parsed: dict[tuple, Vocabulary] = {}


def vocabulary_in_task(read: Callable[[bytes], Vocabulary], raw: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, parsed once per Python worker."""
    key = (read.__name__, hashlib.sha1(raw).digest())
    if key not in _parsed:
        _parsed.clear()
        _parsed[key] = read(raw)
    return _parsed[key]


def token_ids(vocabulary: Vocabulary, part: Part, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the part's texts and the texts' offsets in them."""
    found = split(part, vocabulary.special)
    ids, offsets = encode(vocabulary, found.distinct)
    ids, offsets = take(ids, offsets, found.index)
    return ids, offsets[found.offsets]


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int, identifier: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    Counts are those of the tokenizers library for a byte-level BPE .json file, without
    added tokens; the file's special string inside a text is one token, as is the
    library's default. Distinct pre-tokens of about two megabytes of text are merged
    together, rank by rank, and each text sums the counts of its pre-tokens.
    """
    raw = broadcast_file(docs.sparkSession, vocabulary_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_in_task(from_json, raw.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for part in parts(batch.column(1)):
                found = split(part, vocabulary.special)
                _, offsets = array_merging.encode(vocabulary, found.distinct)
                counts = np.diff(offsets)[found.index]
                total = np.concatenate([[0], np.cumsum(counts)])
                n_tokens.append(np.diff(total[found.offsets]))
                n_bytes.append(np.diff(part.offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(_joined(x), pa.int64()) for x in (n_bytes, n_tokens))],
                names=[identifier, "n_bytes", "n_tokens"],
            )

    source = texts_of(docs, identifier, text)
    kind = source.schema[identifier].dataType.simpleString()
    counted = source.mapInArrow(count, f"`{identifier}` {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def encode_and_decode(
    docs: DataFrame, vocabulary_path: str, identifier: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token ids of every text, and the bytes that these ids spell again.

    ``ids`` are little-endian unsigned 32-bit integers in one binary, ``decoded`` the
    text's bytes from the ids alone. Ids are those of the tiktoken library for the rank
    file without special tokens.
    """
    raw = broadcast_file(docs.sparkSession, vocabulary_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_in_task(from_ranks, raw.value)
        for batch in batches:
            for part in parts(batch.column(1)):
                ids, offsets = token_ids(vocabulary, part, segment_tree.encode)
                spelled, places = segment_tree.decode(vocabulary, ids, offsets)
                names = batch.column(0).slice(part.first, len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        pa.array(np.diff(offsets), pa.int64()),
                        binaries(ids.astype("<u4").view(np.uint8), offsets * 4),
                        binaries(spelled, places),
                    ],
                    names=[identifier, "n_tokens", "ids", "decoded"],
                )

    source = texts_of(docs, identifier, text)
    kind = source.schema[identifier].dataType.simpleString()
    return source.mapInArrow(
        encode, f"`{identifier}` {kind}, n_tokens bigint, ids binary, decoded binary"
    )


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow binary column."""
    rows = pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )
    return rows.cast(pa.binary())


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
