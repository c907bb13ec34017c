"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    decontamination, hard_negatives, language_id, lm_scores, mixing, near_dups, nearest, periodic_runs, quality_classifier, quality_rules, sharding,
    substrings, token_counts,
)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"  # any sentencepiece model file with piece scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of doubles depend on their order in the last bits: compared are rounded values."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query
def op1_lm_scores(spark, sf_dir):
    return rounded(lm_scores.score_documents(documents(spark, sf_dir)), log_score=4, mean_log_score=6)


SQL["op1_lm_scores"] = """
with words as (
  select doc_id, w, i from (
    select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i
    from (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') ws from documents)
  )
), pairs as (
  select a.doc_id, a.w, b.w as before, a.i from words a left join words b on a.doc_id = b.doc_id and a.i = b.i + 1
), one as (select w, count(*) n from words group by w),
two as (select before, w, count(*) n from pairs where before is not null group by 1, 2),
scored as (
  select p.doc_id,
    case when p.before is null then ln(o.n::double / t.n) when two.n >= 2 then ln(two.n::double / c.n)
      else ln(0.4) + ln(o.n::double / t.n) end s,
    case when p.before is not null and two.n < 2 then 1 else 0 end backed
  from pairs p join one o on p.w = o.w left join two on p.before = two.before and p.w = two.w
    left join one c on p.before = c.w, (select count(*) n from words) t
), summed as (select doc_id, count(*) n, sum(backed) b, sum(s) s from scored group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_words, coalesce(b, 0)::bigint n_backed_off,
  round(coalesce(s, 0), 4) log_score, round(s / n, 6) mean_log_score
from documents d left join summed using (doc_id)
"""


@query
def op2_quality_rules(spark, sf_dir):
    return quality_rules.rate_documents(documents(spark, sf_dir))


@query
def op3_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(documents(spark, sf_dir))


SQL["op3_substring_dedup"] = """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) ws from documents),
windows as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') win
  from (select doc_id, ws, unnest(range(1, len(ws) - 33)) i from d where len(ws) >= 35)
), repeated as (select doc_id, i from (select *, count(*) over (partition by win) n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) p from repeated),
words as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) p from d),
kept as (select doc_id, string_agg(w, ' ' order by p) t from words anti join gone using (doc_id, p) group by 1),
counted as (select doc_id, count(*) n from gone group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id) left join counted using (doc_id)
"""


@query
def op4_language_id(spark, sf_dir):
    return language_id.learn_and_identify(documents(spark, sf_dir))


@query
def op5_decontaminate(spark, sf_dir):
    return decontamination.flag_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op6_mix_sources(spark, sf_dir):
    return mixing.mix_amounts(documents(spark, sf_dir))


@query
def op7_shard(spark, sf_dir):
    return sharding.shard_by_bytes(documents(spark, sf_dir), 8, carry=["doc_id"])


@query
def op8_near_duplicates(spark, sf_dir):
    return near_dups.near_duplicates(documents(spark, sf_dir), least_percent=85)


SQL["op8_near_duplicates"] = """
with recursive d as (
  select doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) ws from documents
), shingles as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from d where len(ws) > 0)
), sizes as (select doc_id, count(*) n from shingles group by 1),
shared as (
  select a.doc_id a, b.doc_id b, count(*) k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
), steps as (select a, b from links union all select b, a from links),
reached as (select doc_id, doc_id r from d union select reached.doc_id, steps.b from reached join steps on reached.r = steps.a),
least as (select doc_id, min(r) c from reached group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, c component_id, doc_id = c kept
from least left join sizes using (doc_id)
"""


@query
def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.learn_and_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.Vocabulary.load(VOCABULARY))


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL["op11_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, [floor(256 * x::double) for x in embedding] q
  from embeddings
  where label is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id a, b.vec_id b, a.l = b.l alike, list_inner_product(a.q, b.q)::bigint s
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select a, b, s from scored where alike qualify row_number() over (partition by a order by s desc, b) <= 5
), negatives as (
  select p.a, p.b, p.s, n.b nb, n.s ns, row_number() over (partition by p.a, p.b order by n.s desc, n.b) r
  from positives p join scored n on p.a = n.a and not n.alike where 80 * p.s <= 100 * n.s and 100 * n.s <= 100 * p.s
)
select a anchor_id, b positive_id, r::int "rank", nb negative_id, s positive_score, ns negative_score from negatives where r <= 5
"""


@query
def op12_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return periodic_runs.find_runs(docs.select("doc_id", periodic_runs.planted_text(docs["doc_id"], docs["text"]).alias("text")))


@query
def op13_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
