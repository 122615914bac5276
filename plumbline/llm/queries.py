"""The queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    conversation_repair,
    exact_dedup,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    tokens,
    url_filter,
    warc,
    whitening,
)
from plumbline.llm.common import shared_path, stored, table

SEQUENCE = 2048
END_ID = 1
TOKEN_LIMIT = 512
PREDICTED_FROM = 0.3
COMPONENTS = 4
SHARDS = 24
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packing_of(docs: DataFrame) -> DataFrame:
    pieces = packing.cut(docs, vocabulary("byte_bpe_50k.json"), SEQUENCE, END_ID)
    return packing.place(
        pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), SEQUENCE
    )


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_of(table(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list: URLs of pages whose number a person marked as toxic."""
    pages = table(spark, folder, "pages")
    toxic = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    listed = pages.join(toxic, "page_id", "left_semi")
    return url_filter.filter_urls(pages, URL_RULES, listed)


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    coded = tokens.encode_and_decode(docs, vocabulary("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=2)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    path = shared_path(spark)
    types = warc.with_record_types(pages, warc.archive_count(pages))
    warc.write_archives(types, path, warc.train_dictionary(pages, "page_id", "payload"))
    number = r"^<urn:page:(-?\d+)>$"
    return warc.read_archives(spark, path, blocks=False).select(
        F.expr(f"try_cast(regexp_extract(record_id, r'{number}', 1) as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(f"try_cast(regexp_extract(refers_to_id, r'{number}', 1) as bigint)").alias("refers_to"),
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, folder, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_classifier.classify(docs, labels, PREDICTED_FROM)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokens.count_tokens(docs, vocabulary("byte_bpe_50k.json"), TOKEN_LIMIT)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The trusted target: documents that a person marked as good."""
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality_rules.quality_rules(table(spark, folder, "documents"), trusted)


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(table(spark, folder, "embeddings"), COMPONENTS)
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Near equal bytes; one more shard would move rows between old ones, so no growth."""
    found = sharding.in_shards(table(spark, folder, "documents"), SHARDS)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults planted by a checksum of conversation and turn: see the cases below."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    damage, text = F.col("_damage"), F.col("text")
    return (
        conversations.select(
            "conv_id",
            "turn",
            F.coalesce("role", space).alias("role"),
            F.coalesce("text", space).alias("text"),
            (F.crc32(key.cast("binary")) % 20).alias("_damage"),
        )
        .where(damage != 0)
        .select(
            "conv_id",
            "turn",
            F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(damage == 1, "")
            .when(damage == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(damage == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    repaired = stored(conversation_repair.repair(damaged(turns)).drop("text"))
    return conversation_repair.summaries(turns, repaired)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_sharding": op12_sharding,
    "op13_conversation_repair": op13_conversation_repair,
}

#: One byte of a CRC-32: the table's entry is the sum of those of its bits.
CRC32_STEP = "c >> 8"
for bit, entry in enumerate(
    [1996959894, 3993919788, 124634137, 249268274, 498536548, 997073096, 1994146192, 3988292384]
):
    CRC32_STEP = f"xor({CRC32_STEP}, ((xor(c, b) >> {bit}) & 1) * {entry})"

SQL = {
    "op2_url_filter": r"""
        with rests as (
          select page_id, case when strpos(url, '://') > 0
                               then substr(url, strpos(url, '://') + 3) else '' end as rest
          from pages
        ), split as (
          select page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
                 regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) as query
          from rests
        ), named as (
          select page_id, host, path,
                 case when host = '' then ''
                      else host || case when path = '' then '/' else path end || query end as canonical
          from split
        ), judged as (
          select *, case
            when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/')
              then 'www.example.com/en/'
            when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/')
              then 'example.com/en/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
            when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
            when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
          from named
        ), listed as (
          select canonical from named
          where canonical <> '' and page_id in (select doc_id from labels where toxic = 1)
        )
        select page_id, host, path, rule,
               case when rule in ('www.example.com/en/', 'com/') then 'allow'
                    when rule is not null then 'block'
                    when canonical in (select canonical from listed) then 'block'
                    else 'allow' end as verdict
        from judged""",
    "op4_near_dedup": r"""
        with recursive worded as (
          select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as w
          from documents
        ), shingles as (
          select distinct doc_id, s from (
            select doc_id, unnest(
              case when len(w) > 1
                then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                else w end) as s
            from worded)
        ), sizes as (
          select doc_id, count(*) as n from shingles group by doc_id
        ), pairs as (
          select a.doc_id as x, b.doc_id as y, count(*) as c
          from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
        ), links as (
          select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y
          where 100 * c >= 80 * (p.n + q.n - c)
        ), reached(doc_id, other) as (
          select doc_id, doc_id from documents
          union
          select r.doc_id, l.y from reached r
          join (select x, y from links union all select y, x from links) l on l.x = r.other
        )
        select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id,
               d.doc_id = min(other) as kept
        from documents d join reached using (doc_id) left join sizes using (doc_id)
        group by d.doc_id""",
    "op5_warc": """
        with sized as (
          select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages
        ), judged as (
          select *, max(page_id) over (partition by body) as last from sized
        )
        select page_id, n as payload_bytes, sha1(body) as payload_digest,
               case when n < 1000 or page_id = last then 'response' else 'revisit' end as record_type,
               case when n >= 1000 and page_id <> last then last end as refers_to
        from judged""",
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op10_suffix_dedup": """
        with texts as (
          select doc_id, hex(encode(coalesce(text, ''))) as h from documents
        ), starts as (
          select doc_id, h, unnest(range(0, length(h) // 2, 64)) as start from texts
        ), blocks as (
          -- 64 bytes and the 49 after them
          select doc_id, start, substr(h, 2 * start + 1, 226) as block from starts
        ), places as (
          select doc_id, start, block, unnest(range(0, least(64, length(block) // 2))) as i from blocks
        ), windows as (
          select doc_id, start + i as p, substr(block, 2 * i + 1, 2) as b,
                 case when 2 * i + 100 <= length(block) then md5(substr(block, 2 * i + 1, 100)) end as w
          from places
        ), firsts as (
          select w, min(doc_id) as first_id from windows where w is not null group by w
        ), marked as (
          select doc_id, p, b, coalesce(first_id < doc_id, false)::int as hit
          from windows left join firsts using (w)
        ), covered as (
          select doc_id, p, b, max(hit) over (
            partition by doc_id order by p rows between 49 preceding and current row) as gone
          from marked
        ), runs as (
          select *, lag(gone, 1, 0) over (partition by doc_id order by p) as before from covered
        ), cut as (
          select doc_id, count(*) as n_bytes, count(*) filter (gone = 1) as n_removed,
                 count(*) filter (gone = 1 and before = 0) as n_spans,
                 string_agg(b, '' order by p) filter (gone = 0) as kept
          from runs group by doc_id
        )
        select doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed,
               coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
        from documents left join cut using (doc_id)""",
    "op12_sharding": """
        with recursive texts as (
          select doc_id, coalesce(text, '') as body, hex(encode(coalesce(text, ''))) as raw from documents
        ), checked as materialized (
          select doc_id, sha256(body) as digest, strlen(raw) // 2 + 8 as size,
                 xor(list_reduce(
                   list_transform(regexp_extract_all(raw, '..'), lambda x: ('0x' || x)::bigint),
                   lambda c, b: CRC32_STEP, 4294967295),
                 4294967295) as text_crc32
          from texts
        ), placed as materialized (
          select *, row_number() over (order by digest, doc_id) - 1 as place from checked
        ), groups as (
          select digest, sum(size) as size, count(*) as n from placed group by digest
        ), running as (
          select sum(size) over (order by digest)::bigint as e,
                 sum(n) over (order by digest)::bigint as r from groups
        ), line as (
          select list(e order by e) as ends, max(e) as total from running
        ), search(low, top) as (
          select (total + 23) // 24 - 1, total from line
          union all
          select case when reached >= total then low else middle end,
                 case when reached >= total then middle else top end
          from (
            select low, top, middle, total,
                   list_reduce(list_prepend(0::bigint, range(24)), lambda pos, k:
                     coalesce(list_max(list_filter(ends, lambda e: e <= pos + middle)), 0)) as reached
            from (select low, top, (low + top) // 2 as middle from search where top - low > 1), line)
        ), capacity as (
          select min(top) as c from search
        ), latest(k, pos) as (
          select 23, total from line
          union all
          select k - 1, case when pos - c <= 0 then 0
                             else list_min(list_filter(ends, lambda e: e >= pos - c)) end
          from latest, capacity, line where k > 0
        ), cuts(k, pos) as (
          select -1, 0::bigint
          union all
          select cuts.k + 1, least(
            greatest(latest.pos, coalesce(list_min(list_filter(ends, lambda e: e > cuts.pos)), total),
              coalesce(list_max(list_filter(ends, lambda e: e <= cuts.pos + (total - cuts.pos + 23 - cuts.k - 1) // (23 - cuts.k))), 0)),
            coalesce(list_max(list_filter(ends, lambda e: e <= cuts.pos + c)), 0))
          from cuts join latest on latest.k = cuts.k + 1, capacity, line
        ), starts as (
          select k + 1 as shard, case when pos = 0 then 0 else (select r from running where e = pos) end as start
          from cuts where k < 23
        )
        select doc_id, size, text_crc32, 'bytes' as law, shard::int as shard,
               place - start as slot, null::int as grown_shard
        from placed asof join (select start, max(shard) as shard from starts group by start) s
          on placed.place >= s.start""",
    "op13_conversation_repair": r"""
        with recursive keyed as (
          select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as raw
          from conversations
        ), checked as (
          select *, xor(list_reduce(
                   list_transform(regexp_extract_all(raw, '..'), lambda x: ('0x' || x)::bigint),
                   lambda c, b: CRC32_STEP, 4294967295),
                 4294967295) % 20 as damage
          from keyed
        ), damaged as (
          select conv_id, turn, case when damage = 4 then 'user' else role end as role,
                 case when damage = 1 then '' when damage = 2 then regexp_replace(text, '[.!?]', '', 'g')
                      else text end as text,
                 unnest(range(case when damage = 3 then 2 else 1 end)) as copy
          from checked where damage <> 0
        ), numbered as materialized (
          select *, row_number() over (
                   partition by conv_id order by turn nulls first, role, text, copy) as i,
                 row_number() over (
                   partition by conv_id, role, text order by turn nulls first, copy) as seen,
                 substr(role, 1, 1) as initial
          from damaged
        ), judged as materialized (
          select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                         when seen > 1 then 'duplicate'
                         when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' end as fault,
                 lag(initial) over (partition by conv_id order by i) as initial_before,
                 count(*) over (partition by conv_id) as n
          from numbered
        ), rows as materialized (
          select conv_id, i, n, role, text, initial,
                 coalesce(fault in ('blank', 'duplicate'), false) as must_go,
                 case when fault = 'truncated' then 1 else 0 end as more
          from judged
        ),
        -- what was last: 0 nothing, 1 system, 2 user, 3 assistant
        inserted(state, after, lines, letters) as (
          select * from (values (0, 0, [], ''), (0, 2, ['user:'], 'I'), (0, 3, ['user:', 'assistant:'], 'II'),
            (1, 1, [], ''), (1, 2, ['user:'], 'I'), (1, 3, ['user:', 'assistant:'], 'II'),
            (2, 2, [], ''), (2, 3, ['assistant:'], 'I'), (3, 3, [], ''), (3, 2, ['user:'], 'I'))
        ),
        kept(state, initial, after) as (
          select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))
        ),
        made(state, role, after) as (
          select * from (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2))
        ),
        edits as materialized (
          select conv_id, i, n, state, after, 0 + more as cost, 'K' as letter, [role || ':' || text] as lines
          from rows join kept using (initial) where not must_go
          union all
          select conv_id, i, n, state, after, 2 + more, 'R', [made.role || ':' || text]
          from rows, made where not must_go
          union all
          select conv_id, i, n, state, state, 3, 'D', [] from rows, (select distinct state from made)
        ),
        steps as materialized (
          select conv_id, i, n, g.state, e.after, 2 * len(g.lines) + cost as cost,
                 g.letters || letter as letters, list_concat(g.lines, e.lines) as lines
          from edits e join inserted g on g.after = e.state
        ),
        ways(conv_id, i, n, state, way) as (
          select distinct conv_id, 0::bigint, n, 0,
                 {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} from rows
          union all
          select w.conv_id, w.i + 1, w.n, s.after, min({'cost': (way).cost + s.cost,
                   'audit': (way).audit || s.letters, 'lines': list_concat((way).lines, s.lines)})
          from ways w join steps s
            on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1 and s.state = w.state
          group by all
        ),
        ended as (
          select conv_id, min({'cost': (way).cost + 2 * len(lines), 'audit': (way).audit || letters,
                               'lines': list_concat((way).lines, inserted.lines)}) as way
          from ways join inserted on inserted.state = ways.state and inserted.after in (0, 3)
          where ways.i = ways.n group by conv_id
        ),
        counted as (
          select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                 count(*) filter (fault = 'blank') as blank,
                 count(*) filter (fault = 'duplicate') as duplicate,
                 count(*) filter (fault = 'truncated') as truncated,
                 count(*) filter (initial_before is not null
                   and initial_before || initial not in ('su', 'ua', 'au')) as illegal
          from judged group by conv_id
        )
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank,
               coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, coalesce((way).cost, 0)::bigint as cost,
               coalesce((way).audit, '') as audit,
               sha256(coalesce(array_to_string((way).lines, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o
        left join counted c on c.conv_id is not distinct from o.conv_id
        left join ended e on e.conv_id is not distinct from o.conv_id""",
}
SQL = {name: sql.replace("CRC32_STEP", CRC32_STEP) for name, sql in SQL.items()}
