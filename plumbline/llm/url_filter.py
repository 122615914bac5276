"""URL filter by DataFrame functions alone: rules first, then a list of blocked URLs.

The listed canonical URLs make a blocked Bloom filter: a URL's hash picks one block of
eight 32-bit words and sets one bit in each. Pages look only at their block; those whose
bits are all set go on to an exact hash join with the list, which removes the false
positives. The filter has at most ``MAX_BLOCKS`` rows whatever the list's length, so it
may be broadcast; a list beyond that size lets more pages through to the exact join and
changes no verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import attach, stored, translate_lower

WORDS = 8
#: Listed URLs per block of 256 bits: 16 bits each, about one false positive in 2000.
URLS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 17


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")


def parse_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``path`` and ``canonical`` to ``pages``.

    Host: after the first ``://`` up to ``/ ? #``, A-Z in lower case. Path: from there up
    to ``? #``. A null URL or one without ``://`` has neither. Canonical: host, path
    (at least ``/``) and query, without scheme and fragment; empty without a host.
    """
    rest = pages.withColumn("_url", F.col(url).cast("string")).withColumn("_rest", _rest(F.col("_url")))
    host = translate_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1))
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)?", 1)
    parsed = rest.withColumn("host", F.coalesce(host, F.lit(""))).withColumn(
        "path", F.coalesce(path, F.lit(""))
    )
    slash = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    return parsed.withColumn(
        "canonical",
        F.when(F.col("host") == "", "").otherwise(
            F.concat("host", slash, F.coalesce(query, F.lit("")))
        ),
    ).drop("_url", "_rest")


def rule_column(rules: Sequence[tuple[str, str]], wanted: str) -> Column:
    """The ``rule`` or its ``verdict`` for ``host`` and ``path``; null where none fits.

    A rule such as ``example.com/en/`` fits its host and all subdomains if the path
    begins with the rule's. The longest wins, of equal ones that with the longer host. The
    rules are a short list that becomes one expression; long lists go to the filter.
    """
    found = None
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].find("/"), r[1]))
    for verdict, rule in ordered:
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        if slash:
            fits &= F.col("path").startswith("/" + path)
        value = rule if wanted == "rule" else verdict
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("string") if found is None else found


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("canonical"), F.lit(blocks)).cast("int")


def _bits() -> list[Column]:
    """One bit in each word, from five bits each of the second hash, ``_other``."""
    return [
        F.expr(f"shiftleft(1, cast(shiftright(_other, {6 * word}) & 31 as int))")
        for word in range(WORDS)
    ]


def _second_hash() -> Column:
    return F.xxhash64("canonical", F.lit("bits"))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows ``block, word0..word7`` of the listed ``canonical`` URLs."""
    words = [F.bit_or(b).alias(f"word{i}") for i, b in enumerate(_bits())]
    return (
        listed.withColumn("_other", _second_hash())
        .groupBy(_block(blocks).alias("block"))
        .agg(*words)
    )


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    listed: DataFrame,
    identifier: str = "page_id",
    url: str = "url",
    listed_url: str = "url",
) -> DataFrame:
    """One row per page: the identifier, ``host``, ``path``, ``rule``, ``verdict``.

    A page that a rule fits gets the rule's verdict; any other is ``block`` if its
    canonical URL is that of a listed URL, else ``allow``. A URL without a host matches
    nothing and is allowed, and a listed one without a host lists nothing. Repeated rows
    come out as often as they go in; an empty list or table is fine. Other columns are
    not read.
    """
    blocked = stored(
        parse_urls(listed.select(F.col(listed_url).alias("url")))
        .where(F.col("canonical") != "")
        .select("canonical")
        .distinct()
    )
    blocks = min(MAX_BLOCKS, max(1, -(-blocked.count() // URLS_PER_BLOCK)))
    judged = (
        parse_urls(pages.select(F.col(identifier), F.col(url).alias("url")))
        .withColumn("rule", rule_column(rules, "rule"))
        .withColumn("verdict", rule_column(rules, "verdict"))
        .withColumn("_other", _second_hash())
        .withColumn("block", _block(blocks))
        .join(F.broadcast(bloom_filter(blocked, blocks)), "block", "left")
    )
    all_set = reduce(
        lambda a, b: a & b, [F.col(f"word{i}").bitwiseAND(b) == b for i, b in enumerate(_bits())]
    )
    possible = F.col("verdict").isNull() & (F.col("canonical") != "") & F.coalesce(all_set, F.lit(False))
    judged = judged.withColumn("_possible", possible)
    columns = [identifier, "host", "path", "rule"]
    sure = judged.where(~F.col("_possible")).select(
        *columns, F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
    hits = stored(judged.where(F.col("_possible")).select(*columns, "canonical"))
    # a URL that many pages share is one row here, folded before the shuffle
    confirmed = stored(
        hits.groupBy("canonical").agg(F.count(F.lit(1)).alias("_size")).join(blocked, "canonical")
    )
    checked = attach(hits, confirmed, "canonical", "_size").select(
        *columns, F.when(F.col("_size").isNull(), "allow").otherwise("block").alias("verdict")
    )
    return sure.unionByName(checked)
