"""Registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tallyscope.llm import (
    byte_bpe,
    conversation_repair,
    language,
    lexical_search,
    line_chunks,
    merkle,
    neighbours,
    ngram_join,
    passages,
    personal_data,
    secret_scan,
    simhash_trees,
    string_tiling,
)
from tallyscope.llm.tokens import in_small_batches
from tallyscope.session import settle

VOCABULARY = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _digest(joined) -> F.Column:
    return F.sha2(joined.cast("binary"), 256)


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, their digest, and all spans."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin("email", "ip", "card", "phone"))
    counts = [personal_data.count_of(spans, kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return personal_data.scan(_documents(spark, folder)).select(
        "doc_id",
        *counts,
        _digest(personal_data.joined(base)).alias("base_sha256"),
        personal_data.joined(spans).alias("spans"),
    )


def op2_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that a document shares with another one: both places, anchors and share of aligned words."""
    return passages.repeated_passages(_documents(spark, folder))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return ngram_join.near_duplicates(_documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "set_id")


def op4_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, how many of them repeated chunks took away, and a digest of what is left."""
    done = line_chunks.dedupe(_documents(spark, folder), counts=("n_lines", "n_removed"))
    return done.select("doc_id", "n_lines", "n_removed", _digest(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def op5_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Contaminated documents with the benchmark items they cover."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    covered = F.transform("matches", lambda m: F.round(m["covered"] / m["words"], 6))
    return string_tiling.contamination(_documents(spark, folder), items).select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_items"),
        F.array_sort(F.transform("matches", lambda m: m["item_id"].cast("bigint"))).alias("item_ids"),
        F.array_max(covered).alias("coverage"),
    )


#: Pages of one archive file, and the damage of the second replica: pages with these remainders of a changed byte or gone.
FILE_PAGES, FLIPPED, LOST = 4096, (97, 5), (101, 7)


def op6_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Damage of a replica of the page archive, found by descending only where the trees differ.

    The pages lie in archive files of 4096 page numbers. The second replica is the same archive with the first byte of some
    pages overwritten and some records gone; the audit sees both archives only.
    """
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    page = F.col("page_id")
    record = merkle.warc_record(F.col("url"), page, F.col("html"))
    flipped = merkle.warc_record(F.col("url"), page, F.concat(F.lit("#"), F.expr("substring(html, 2)")))
    damaged = F.when(page % FLIPPED[0] == FLIPPED[1], flipped).otherwise(record)
    hashed = pages.select(
        "page_id",
        F.octet_length(record).alias("size"),
        merkle.record_hash(record).alias("leaf"),
        merkle.record_hash(damaged).alias("replica_leaf"),
    )
    file = F.format_string("pages-%05d.warc", F.expr(f"page_id div {FILE_PAGES}"))
    archive = settle(merkle.laid_out(hashed, file, page, F.col("size")))
    replica = archive.filter(page % LOST[0] != LOST[1]).select("file", "offset", F.col("replica_leaf").alias("leaf"))
    return merkle.compare(
        merkle.merged_leaves(archive.select("file", "offset", "leaf")), merkle.merged_leaves(replica)
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(_documents(spark, folder))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every 20th embedding."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.search(vectors, F.col("vec_id") % 20 == 0)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    encode, decode = byte_bpe.encoder(path, pattern), byte_bpe.decoder(path, pattern)
    encoded = in_small_batches(_documents(spark, folder)).select("doc_id", encode("text").alias("ids"))
    return encoded.select("doc_id", "ids", decode("ids").alias("decoded")).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; the source is the owner, its languages are its repositories."""
    docs = _documents(spark, folder).withColumn("repository", F.concat_ws("/", "source", "lang"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    counts = [personal_data.count_of(spans, kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return secret_scan.scan(docs, "repository", "source").select(
        "doc_id",
        *counts,
        secret_scan.live_count(spans).alias("n_live"),
        _digest(personal_data.joined(base)).alias("base_sha256"),
        personal_data.joined(spans).alias("spans"),
    )


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-copy component of every document."""
    return simhash_trees.near_copies(_documents(spark, folder))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversation_repair.damage_and_repair(spark.read.parquet(f"{folder}/conversations.parquet"))


def op13_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return lexical_search.search(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_passages": op2_passages,
    "op3_ngram_join": op3_ngram_join,
    "op4_line_chunks": op4_line_chunks,
    "op5_string_tiling": op5_string_tiling,
    "op6_fixity": op6_fixity,
    "op7_language": op7_language,
    "op8_neighbours": op8_neighbours,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_secrets": op10_secrets,
    "op11_simhash": op11_simhash,
    "op12_conversations": op12_conversations,
    "op13_ranking": op13_ranking,
    "pipeline": corpus_pipeline.run,
}

_WARC = (
    "concat(E'WARC/1.1\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <urn:record:', page_id::varchar, "
    "E'>\\r\\nWARC-Target-URI: ', coalesce(url, ''), E'\\r\\nContent-Length: ', strlen({html})::varchar, "
    "E'\\r\\n\\r\\n', {html}, E'\\r\\n\\r\\n')"
)
_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
_RANKING_SQL = f"""
    with texts as (
        select row_number() over () as doc, doc_id, {_TERMS} as terms from documents
    ), sizes as (
        select doc, doc_id, len(terms)::bigint as n from texts
    ), totals as (
        select count(*) filter (where n > 0) as docs, sum(n)::bigint as length from sizes
    ), wanted as (
        select item_id, text, term, count(*) as times
        from (select item_id, text, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark))
        group by all
    ), held as (
        select doc, term, count(*) as tf from (select doc, unnest(terms) as term from texts)
        where term in (select term from wanted) group by all
    ), weights as (
        select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as weight
        from held, totals group by term, docs
    ), scores as (
        select item_id, text, doc_id,
            sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::bigint as score
        from held join weights using (term) join wanted using (term) join sizes using (doc), totals
        group by item_id, text, doc, doc_id
    ), ranked as (
        select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last)::integer as rank
        from scores where score > 0
    )
    select item_id, rank, doc_id, score from ranked where rank <= 20
"""
#: The checksum goes bit by bit; the repair relaxes the four states of each conversation row by row. Two inserts in a row are
#: enough: a third one would only undo the first.
_REPAIR_SQL = r"""
    with recursive keyed as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
        from conversations
    ), summed as (
        select * exclude (name), xor(list_reduce(
            list_concat([4294967295::ubigint], [unicode(c)::ubigint for c in string_split(name, '')]),
            lambda c, b: list_reduce(
                list_concat([xor(c, b)], [0::ubigint for x in range(8)]),
                lambda v, z: xor(v >> 1, 3988292384::ubigint * (v & 1::ubigint)))), 4294967295::ubigint) % 20 as kind
        from keyed
    ), damaged as (
        select conv_id, turn, case when kind = 4 then 'user' else role end as role,
            case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
            unnest(case when kind = 3 then [1, 2] else [1] end) as copy
        from summed where kind <> 0
    ), placed as (
        select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place,
            regexp_replace(text, '[ 	-
]+$', '') as ending
        from damaged
    ), faults as (
        select *, left(role, 1) as initial,
            lag(left(role, 1)) over (partition by conv_id order by place) as previous,
            case when ending = '' then 'blank'
                when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
                when right(ending, 1) not in ('.', '!', '?') then 'truncated' end as fault
        from placed
    ), rows_by_conversation as (
        select conv_id, max(place) as size, list(struct_pack(role := role, text := text, initial := initial, fault := fault) order by place) as rows,
            (coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0))::bigint as gaps,
            count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
            count(*) filter (where fault = 'truncated') as truncated,
            count(*) filter (where previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal
        from faults group by conv_id
    ), states as (
        -- From, letter, fixed cost, next state: 0 nothing yet, 1 after the system row, 2 user next, 3 assistant next.
        select * from (values
            (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 3), (1, 'K', 'u', 0, 3), (2, 'K', 'u', 0, 3), (3, 'K', 'a', 0, 2),
            (0, 'R', null, 1, 3), (1, 'R', null, 1, 3), (2, 'R', null, 1, 3), (3, 'R', null, 1, 2),
            (0, 'D', null, 2, 0), (1, 'D', null, 2, 1), (2, 'D', null, 2, 2), (3, 'D', null, 2, 3)
        ) as t(state, edit, needs, price, next)
    ), inserts as (
        select * from (values
            (0, '', 0, 0, []::varchar[]), (1, '', 0, 1, []), (2, '', 0, 2, []), (3, '', 0, 3, []),
            (0, 'I', 5, 3, ['user:']), (1, 'I', 5, 3, ['user:']), (2, 'I', 5, 3, ['user:']), (3, 'I', 5, 2, ['assistant:']),
            (0, 'II', 10, 2, ['user:', 'assistant:']), (1, 'II', 10, 2, ['user:', 'assistant:']),
            (2, 'II', 10, 2, ['user:', 'assistant:']), (3, 'II', 10, 3, ['assistant:', 'user:'])
        ) as t(state, letters, price, next, lines)
    ), walk as (
        select conv_id, 0::bigint as place, next as state, price::bigint as cost, letters as audit, lines
        from rows_by_conversation, inserts where inserts.state = 0
        union all
        select conv_id, place, state, (best).cost, (best).audit, (best).lines from (
            select w.conv_id, w.place + 1 as place, i.next as state, min(struct_pack(
                cost := w.cost + s.price + i.price + case when r.fault = 'truncated' and s.edit <> 'D' then 5 else 0 end,
                audit := w.audit || s.edit || i.letters,
                lines := list_concat(w.lines, case s.edit when 'K' then [r.role || ':' || r.text]
                    when 'R' then [case when w.state = 3 then 'assistant:' else 'user:' end || r.text] else [] end, i.lines))) as best
            from walk w
            join faults r on r.conv_id is not distinct from w.conv_id and r.place = w.place + 1
            join states s on s.state = w.state and (s.needs is null or s.needs = r.initial)
                and (s.edit = 'D' or r.fault is null or r.fault = 'truncated')
            join inserts i on i.state = s.next
            group by w.conv_id, w.place, i.next)
    ), repaired as (
        select w.conv_id, min(struct_pack(cost := w.cost, audit := w.audit, lines := w.lines)) as best
        from walk w join rows_by_conversation c on c.conv_id is not distinct from w.conv_id and c.size = w.place
        where w.state in (0, 2) group by w.conv_id
    )
    select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate,
        coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal, coalesce((p.best).cost, 0) as cost,
        coalesce((p.best).audit, '') as audit, sha256(coalesce(array_to_string((p.best).lines, chr(10)), '')) as repaired_sha256
    from (select distinct conv_id from conversations) o
    left join rows_by_conversation c on c.conv_id is not distinct from o.conv_id
    left join repaired p on p.conv_id is not distinct from o.conv_id
"""
ORACLES: dict[str, str] = {
    "op6_fixity": f"""
        with archive as (
            select page_id, {_WARC.format(html="coalesce(html, '')")} as record,
                   {_WARC.format(html="('#' || substr(html, 2))")} as flipped
            from pages
        ), placed as (
            select *, printf('pages-%05d.warc', page_id // {FILE_PAGES}) as file,
                   coalesce(sum(strlen(record)) over (
                       partition by page_id // {FILE_PAGES} order by page_id
                       rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
            from archive
        )
        select file, "offset", 'missing' as status, sha256(record) as left_hash, null as right_hash
        from placed where page_id % {LOST[0]} = {LOST[1]}
        union all
        select file, "offset", 'changed', sha256(record), sha256(flipped)
        from placed where page_id % {FLIPPED[0]} = {FLIPPED[1]} and page_id % {LOST[0]} <> {LOST[1]}
    """,
    "op12_conversations": _REPAIR_SQL,
    "op13_ranking": _RANKING_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
