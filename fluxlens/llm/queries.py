"""The registered queries of this subpackage, thin over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.llm import fim, lines, lm, media, mixing, mtree, neardup, packing, passages, quality, tokens, toxicity, whitening
from fluxlens.llm.common import crc_of_id

TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP1_SQL = """
with whole as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2, cycle=(5, 2, 1), block_words=64))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


OP4_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as s
  from words where len(w) > 1
  union all
  select doc_id, w[1] from words where len(w) = 1
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), alike as (
  select a.doc_id as u, b.doc_id as v, count(*) as shared
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id
), links as (
  select u, v from alike join sizes x on x.doc_id = u join sizes y on y.doc_id = v
  where 100 * shared >= 80 * (x.n + y.n - shared)
), both_ways as (
  select u, v from links union all select v, u from links
), reached as (
  select doc_id as start, doc_id as node from documents
  union
  select r.start, l.v from reached r join both_ways l on l.u = r.node
), least as (
  select start as doc_id, min(node) as component_id from reached group by start
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id join least l on l.doc_id = d.doc_id
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), percent=80, min_words=40)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_columns(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP7_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), frequent as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
), marked as (
  select k.*, f.key is not null as gone from keyed k left join frequent f on k.key = f.key
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count_if(gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_bilinear_scores(table(spark, sf_dir, "documents"), crc_of_id() % 7 == 2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), fit_rows=4000, held_out_part=1, parts=3)
    return quality.score_quality(docs, model).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048, end_id=1)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.component_rows(vectors, whitening.fit_whitening(vectors, k=32, scale=64.0, shift=1_000_000))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"), seed="1", plain_percent=10, spm_percent=20).drop("runs")


OP12_SQL = r"""
with drawn as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), numbers as (
  select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
         cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from drawn
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from numbers
), parts as (
  select *, substring(t, 1, low) as prefix, substring(t, low + 1, high - low) as middle, substring(t, high + 1) as suffix
  from cut
)
select doc_id, n, form,
       case when form <> 'plain' then cast(low as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(high - low as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fit_rows=6000, held_out_part=1, parts=3)
    return toxicity.score_toxicity(docs, model, least=0.7).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_top_k, op2_mixing, op3_token_counts, op4_minhash, op5_substring_dedup, op6_media_columns, op7_line_dedup, op8_lm_scoring, op9_quality, op10_packing, op11_whitening, op12_fill_in_middle, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1_SQL, "op4_minhash": OP4_SQL, "op7_line_dedup": OP7_SQL, "op12_fill_in_middle": OP12_SQL}
