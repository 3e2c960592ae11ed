"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, common, jaccard, merkle, mixing, neardup, packing, quality, secrets, substring, support, tokens, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derivatives(warc.page_responses(_read(spark, sf_dir, "pages")))
    return out.withColumns({"n_bytes": F.length("block").cast("long"), "block": F.decode("block", "UTF-8")})


def op2_pruned_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(_read(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "documents").select("doc_id", "source", common.word_array(F.col("text")).alias("_w"))
    df = df.select("doc_id", "source", F.size("_w").cast("long").alias("size"), mixing.lexical_weight(F.col("_w")).alias("weight"))
    df = common.saved(df, "sizes")
    return mixing.apply_mix(df, mixing.plan_mix(df)).select("doc_id", "size", "source_size", "target", "taken")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "documents").select("doc_id", common.word_count(F.col("text")).alias("n_words"))
    return packing.pack(df)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op6_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_neural_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"), redact=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_neural", "probabilities")


def op8_debruijn_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(*toxicity.sample(docs, _read(spark, sf_dir, "labels")))
    df = toxicity.score(docs, model)
    return df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    df = support.score(docs, support.fit(*support.sample(docs, _read(spark, sf_dir, "labels"))))
    return df.select("doc_id", support.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_pruned_graph_dedup": op2_pruned_graph_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_neural_secret_scan": op4_neural_secret_scan,
    "op5_token_counts": op5_token_counts,
    "op6_partenum_jaccard": op6_partenum_jaccard,
    "op7_line_first_quality": op7_line_first_quality,
    "op8_debruijn_repeats": op8_debruijn_repeats,
    "op9_subword_toxicity": op9_subword_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_nbsvm_quality": op13_nbsvm_quality,
}
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_CLOSURE = "reach(r, m) as (select r, r from {} union select p.r, reach.m from pairs p join reach on reach.r = p.s)"
ORACLE = {
    "op2_pruned_graph_dedup": f"""with recursive e as (select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings),
g as (select r, label, v, list_dot_product(v, v) as q from e where label is not null and len(v) > 0 and list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x))) and list_dot_product(v, v) > 0),
pairs as materialized (select a.r, b.r as s from g a join g b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r where list_dot_product(a.v, b.v) / sqrt(a.q * b.q) >= 0.93),
{_CLOSURE.format("e")}, c as (select reach.r, min(vec_id) as component_id from reach join e on e.r = m group by reach.r), n as (select r, count(*) as n from pairs group by r)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept from e join c using (r) left join n using (r)""",
    "op3_mix_sources": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_filter_audit": audit.ORACLE,
    "op6_partenum_jaccard": f"""with recursive t as (select row_number() over () as r, doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
g as materialized (select distinct r, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select r, w, unnest(range(1, greatest(2, len(w) - 3))) as i from t where len(w) > 0)),
n as materialized (select r, count(*) as n from g group by r),
pairs as materialized (select a.r, b.r as s from g a join g b on a.g = b.g and a.r <> b.r group by a.r, b.r having 100 * count(*) >= 75 * ((select n from n where n.r = a.r) + (select n from n where n.r = b.r) - count(*))),
{_CLOSURE.format("t")}
select t.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(o.doc_id) as component_id from t join reach using (r) join t o on o.r = m left join n on n.r = t.r group by t.r, t.doc_id""",
    "op7_line_first_quality": quality.oracle(),
    "op8_debruijn_repeats": f"""with t as (select row_number() over () as r, doc_id, {_WORDS.format("text")} as w from documents),
g as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as g from (select r, w, unnest(range(1, len(w) - 33)) as i from t where len(w) >= 35)),
d as (select r, i from (select r, i, count(*) over (partition by g) as c from g) where c > 1),
c as (select distinct r, i + k as p from d cross join range(35) x(k)),
x as (select r, unnest(w) as w, unnest(range(1, len(w) + 1)) as p from t where len(w) > 0),
k as (select r, string_agg(w, ' ' order by p) as s, count(*) as n from x anti join c using (r, p) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from t left join k using (r)""",
}
