"""A corpus pipeline over ``documents``: five operators, one after the other.

Documents that the quality classifier rejects go; of equal texts one stays; of each group
of near duplicates one stays; passages that an earlier document has are cut out; what is
left is packed into sequences. Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, near_dedup, quality_classifier, substring_dedup
from plumbline.llm.common import prepare, stored, table
from plumbline.llm.queries import PREDICTED_FROM, packing_of


def _of_kept(docs: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``docs`` whose keys are among ``kept``; missing keys equal each other."""
    right = kept.select([F.col(key).alias(f"_kept_{key}") for key in keys])
    same = [F.col(key).eqNullSafe(F.col(f"_kept_{key}")) for key in keys]
    return docs.join(right, same, "left_semi")


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose predicted quality is at least ``PREDICTED_FROM``."""
    model = quality_classifier.fit(docs, table(spark, folder, "labels"))
    score = _unused(docs, "score")
    scored = quality_classifier.with_scores(docs, model, score=score)
    return scored.where(F.col(score) >= PREDICTED_FROM).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with equal texts the one with the largest identifier."""
    prepare(spark)
    found = exact_dedup.exact_duplicates(docs)
    digest = _unused(docs, "digest")
    named = docs.withColumn(digest, exact_dedup.sha256(F.coalesce("text", F.lit(""))))
    kept = found.where("kept").withColumnRenamed("digest", digest)
    return _of_kept(named, kept, ["doc_id", digest]).drop(digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents that share at least 80 % of their five-word shingles, one."""
    prepare(spark)
    return _of_kept(docs, near_dedup.near_duplicates(docs).where("kept"), ["doc_id"])


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without what an earlier document has too; a document of nothing else goes.

    A character that a cut would part goes as a whole.
    """
    prepare(spark)
    # the other columns come along as one, whatever they are called
    rest = [name for name in docs.columns if name not in ("doc_id", "text", "n_chars")]
    others = F.struct(*[F.col(f"`{name}`") for name in rest], F.lit(0).alias(_unused(docs, "none")))
    found = substring_dedup.remove_repeats(
        docs.select("doc_id", "text", others.alias("others")),
        carry=["others"],
        whole_characters=True,
    )
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    columns |= {name: F.col(f"others.`{name}`") for name in rest}
    return found.where("n_removed < n_bytes or n_bytes = 0").select(
        *[columns[name].alias(name) for name in docs.columns]
    )


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    prepare(spark)
    return packing_of(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL has no factorisation machine, no MinHash and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the table ``documents`` of a folder."""
    docs = table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, folder)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
