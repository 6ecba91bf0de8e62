"""The registered queries of the corpus operators and the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.alignment import align
from runledger.llm.decontaminate import flag_leaks
from runledger.llm.exact_dedup import content_groups
from runledger.llm.html_text import extract_main_text
from runledger.llm.labelled import fold, labelled_sample
from runledger.llm.language import identify_language, train_language_model
from runledger.llm.merkle import fold_proof, leaf_digest, manifest, proof_digest
from runledger.llm.mixing import MIX_SHARE, document_margins, draw_documents
from runledger.llm.near_dedup import near_groups
from runledger.llm.quality import SAMPLE_PER_CLASS as QUALITY_SAMPLE
from runledger.llm.quality import judge_quality, score_quality, train_network
from runledger.llm.sharding import shard_documents
from runledger.llm.tokens import token_counts
from runledger.llm.toxicity import learn_toxic_field, score_toxicity
from runledger.llm.url_filter import judge_urls

CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CORPUS_SQL: dict[str, str] = {}


def corpus_query(name: str, sql: str | None = None):
    """Register a function of (spark, folder of tables) and its SQL if it has one."""

    def wrap(run):
        assert name not in CORPUS_QUERIES, name
        CORPUS_QUERIES[name] = run
        if sql is not None:
            CORPUS_SQL[name] = sql
        return run

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The rules the url query judges by, as (verdict, host, path).
LISTED_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@corpus_query(
    "op1_url_filter",
    r"""
    with u as (select page_id, coalesce(url, '') as url from pages),
    h as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(?s)\?([^#]*)', 1) as q from u),
    f as (select *, case when (host = 'www.example.com' or suffix(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
                         when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
                         when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
                         when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
                         when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/') then 'com/' end as rule,
                 list_filter(string_split(host, '.'), lambda x: x <> '') as labels from h),
    j as (select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as listed,
                 list_distinct(list_transform(range(1, len(labels) + 1), lambda i: concat('domain:', array_to_string(labels[i:], '.')))
                   || list_transform(labels, lambda x: concat('label:', x)) || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: concat('path:', x))
                   || list_transform(list_filter(list_transform(string_split(q, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: concat('key:', x))) as tokens from f),
    l as (select tokens, listed from j where listed is not null),
    least as (select ceil(0.02 * count(*)) as n from l),
    frequent as (select t from (select unnest(tokens) as t from l) x group by t having count(*) >= (select n from least)),
    kept as (select listed, list_sort(list_intersect(tokens, ft)) as ts from l, (select list(t) as ft from frequent) x),
    sets as (select listed, list_filter(ts, lambda x, i: (mask >> (i - 1)) & 1 = 1) as s from (select listed, ts, unnest(range(1, 1 << len(ts))) as mask from kept) x),
    totals as (select s, count(*) as total from sets group by s),
    rules as (select s, listed, hits, total from (select s, listed, count(*) as hits from sets group by s, listed) x join totals using (s)
              where hits >= (select n from least) and hits >= total * 0.8),
    parts as (select s, listed, hits, total, list_filter(s, lambda x: x <> left_out) as part from (select *, unnest(s) as left_out from rules) x),
    pruned as (select s, listed, hits, total from rules where (s, listed) not in
               (select p.s, p.listed from parts p join rules r on r.s = p.part and r.listed = p.listed where r.hits * p.total >= p.hits * r.total)),
    mined as (select j.page_id, arg_max(p.listed, (p.hits / p.total, p.hits, p.listed)) as verdict from j join pruned p on list_has_all(j.tokens, p.s) where j.listed is null group by 1)
    select j.page_id, host, path, rule, coalesce(listed, mined.verdict, 'allow') as verdict from j left join mined using (page_id)""",
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), LISTED_RULES).select("page_id", "host", "path", "rule", "verdict")


@corpus_query(
    "op3_exact_dedup",
    """
    with d as (select doc_id, coalesce(text, '') as t from documents),
         g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256
    from d join g on d.t = g.t""",
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"), keep="max")


@corpus_query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16)


@corpus_query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@corpus_query(
    "op2_html_text",
    # The article and its blocks by the elements the given pages use; the operator knows none of this.
    r"""
    with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as article from pages),
    b as (select page_id, url, list_transform(regexp_split_to_array(article, '</?(?:p|h1|br)>'),
            lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as blocks from a)
    select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text,
           length(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10))) as n_chars from b""",
)
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@corpus_query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn_toxic_field(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans")
    )


@corpus_query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train_network(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", fold(F.col("k"), 5) != 0, QUALITY_SAMPLE))
    return judge_quality(score_quality(docs, net), 0.3).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), "predicted")


@corpus_query(
    "op6_near_dedup",
    """
    with recursive w as (
      select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
      from documents),
    s as (
      select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                                          else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh
      from w),
    n as (select w.doc_id, count(s.sh) as n from w left join s on w.doc_id = s.doc_id group by w.doc_id),
    pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
    links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
    both_ways as (select a, b from links union select b, a from links),
    reach as (select doc_id as node, doc_id as other from n union select r.node, e.b from reach r join both_ways e on e.a = r.other),
    least as (select node, min(other) as component_id from reach group by node)
    select n.doc_id, n.n as n_shingles, component_id, n.doc_id = component_id as kept from n join least on node = n.doc_id""",
)
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@corpus_query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@corpus_query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draw_documents(table(spark, sf_dir, "documents"), document_margins(), MIX_SHARE)
    return drawn.select("doc_id", F.array_join("mix_cell", "/").alias("cell"), F.col("mix_tokens").alias("tokens"), F.col("mix_probability").alias("probability"), F.col("mix_drawn").alias("drawn"))


#: Columns of a document that its leaf holds, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@corpus_query(
    "op11_merkle_manifest",
    # crc32 bit by bit: each character is followed by eight shifts, written as -1.
    r"""
    with recursive d as (
      select doc_id, lang, text, concat(coalesce(concat(strlen(cast(doc_id as varchar)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
               coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(cast(n_chars as varchar)), ':', n_chars), '-')) as head,
             list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''),
               lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384::bigint * (c & 1)) end) as crc
      from documents),
    l as (
      select doc_id, lang, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) as leaf,
             sha256(concat(head, coalesce(concat(strlen(text), ':', case when xor(crc, 4294967295) % 3 = 0
               then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end), '-'))) as shown,
             row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n
      from d),
    nodes as (
      select lang, 0 as lvl, pos as idx, leaf as h, n from l
      union all
      select lang, lvl + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (n + 7) // 8 from nodes where n > 1 group by lang, lvl, idx // 8, n),
    subs as (select lang, h as subroot, lvl as depth, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
    tops as (
      select 0 as lvl, pos as idx, subroot as h, n from subs
      union all
      select lvl + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (n + 7) // 8 from tops where n > 1 group by lvl, idx // 8, n),
    below as (
      select l.doc_id, a.lvl, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as lft, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as rgt
      from l join nodes a on a.lang is not distinct from l.lang and a.n > 1 and a.idx = l.pos // (1 << (3 * a.lvl))
             join nodes b on b.lang is not distinct from a.lang and b.lvl = a.lvl and b.idx // 8 = a.idx // 8 group by 1, 2),
    above as (
      select s.lang, a.lvl, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as lft, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as rgt
      from subs s join tops a on a.n > 1 and a.idx = s.pos // (1 << (3 * a.lvl)) join tops b on b.lvl = a.lvl and b.idx // 8 = a.idx // 8 group by 1, 2),
    steps as (
      select doc_id, lvl, lft, rgt from below
      union all
      select l.doc_id, s.depth + a.lvl, lft, rgt from l join subs s on s.lang is not distinct from l.lang join above a on a.lang is not distinct from l.lang),
    folded as (
      select doc_id, 0 as lvl, shown as h from l
      union all
      select f.doc_id, f.lvl + 1, sha256(concat(lft, h, rgt)) from folded f join steps s on s.doc_id = f.doc_id and s.lvl = f.lvl),
    ends as (select doc_id, arg_max(h, lvl) as folded_root from folded group by doc_id),
    proofs as (select doc_id, sha256(string_agg(concat(lft, rgt), '' order by lvl)) as proof_sha256 from steps group by doc_id)
    select l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
    from l join subs s on s.lang is not distinct from l.lang join ends using (doc_id) left join proofs using (doc_id) cross join (select h as root from tops where n = 1) r""",
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(fold(F.col("doc_id"), 3) == 0, lowered).otherwise(F.col("text"))
    leaves = docs.select(
        "doc_id", "lang", leaf_digest([F.col(c) for c in LEAF_COLUMNS]).alias("leaf"), leaf_digest([shown if c == "text" else F.col(c) for c in LEAF_COLUMNS]).alias("shown")
    )
    folded = manifest(leaves, "leaf", "lang", "doc_id").withColumn("folded_root", fold_proof(F.col("shown"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@corpus_query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


@corpus_query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs, public_tokenizers.path("piece_bpe_32k.model"), fold(F.col("k"), 4) != 2)
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@corpus_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
