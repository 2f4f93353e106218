"""The registered query of each operator: the operator with production parameters, in the digest columns agreed on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), g as (
  select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1
)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
from d join g using (text_sha256)
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), s as (
  select doc_id, list_distinct(case when len(words) = 0 then cast([] as varchar[])
    when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) end) as shingles
  from w
), n as (select doc_id, cast(len(shingles) as bigint) as n_shingles from s),
x as (select doc_id, unnest(shingles) as shingle from s),
heavy as (select a.doc_id as a, b.doc_id as b, count(*) as n_both from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from heavy join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * n_both >= 75 * (na.n_shingles + nb.n_shingles - n_both)
), edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as id, doc_id as low from documents union select e.b, r.low from reach r join edges e on e.a = r.id),
c as (select id as doc_id, min(low) as component_id from reach group by 1)
select n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join c using (doc_id)
"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.toxicity import held_out, score_toxicity

    labels = _table(spark, sf_dir, "labels").where(~held_out())
    scored = score_toxicity(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.secrets import BASE_KINDS, scan_secrets

    def listed(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.curves import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages")).drop("pattern")


OP3_SQL = r"""
with p as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), h as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from p
), u as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h
), r(rule, verdict) as (
  values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), s as (
  select rule, verdict, split_part(rule, '/', 1) as rhost, substr(rule, instr(rule, '/')) as rpath from r
), m as (
  select u.page_id, s.rule, s.verdict, row_number() over (partition by u.page_id order by length(s.rule) desc, s.rule) as n
  from u join s on (u.host = s.rhost or ends_with(u.host, '.' || s.rhost)) and starts_with(u.path, s.rpath)
)
select u.page_id, u.host, u.path, m.rule,
  coalesce(m.verdict, case when regexp_matches(u.host, '(^|[^a-z0-9])(casino|pills|spam|viagra|porn|xxx|warez|payday)([^a-z0-9]|$)') then 'block' else 'allow' end) as verdict
from u left join m on m.page_id = u.page_id and m.n = 1
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.language import identify_languages, learn_prototypes
    from switchyard.llm.toxicity import held_out

    docs = _table(spark, sf_dir, "documents")
    learned = learn_prototypes(docs.where(~held_out(folds=3, fold=1)))
    return identify_languages(docs, learned).select("doc_id", held_out(folds=3, fold=1).alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.unigram_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from switchyard.llm.piece_bpe import digest_pieces

    return digest_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
