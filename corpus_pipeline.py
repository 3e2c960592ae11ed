"""A corpus pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and is
written as Parquet and read again before the next. All but the last return the columns of
documents. Models and plans are made from the rows that reach the stage.

Defined results: null and empty texts pass the first three stages, add no words to the mix and are no
piece; null ids and sources are kept as they are; rows that repeat an id and text count as near copies of each
other, so one stays; ties are broken by the other columns; columns beyond those of documents pass through
under any name; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisloom.llm import common, jaccard, mixing, packing, secrets, toxicity


#: Columns that the stages know; any other one takes a name of its own meanwhile, so that none of theirs can clash with it.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        return stage(spark, docs.toDF(*(c if c in KNOWN else f"extra_{i}" for i, c in enumerate(names))), sf_dir).toDF(*names)

    return run


@apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; empty ones stay."""
    model = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxicity.score(docs, model, column="_score")
    return scored.where("_score < 0.5").select(*docs.columns)


@apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the least id stays (null ids last); of rows that repeat its id and
    text the one whose other columns come first as JSON. Rows without words stay."""
    found = jaccard.jaccard_join(docs)
    stays = found.where("stays").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"))
    stays = common.saved(stays.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), ((F.col("rows") > 1) & (F.col("n") > 0)).alias("_repeats")), "stays")
    keyed = jaccard.row_keys(docs.withColumns({"_id": F.col("doc_id").cast("long"), "_t": F.coalesce("text", F.lit(""))}), "_id", "_t")
    rows = lambda which: keyed.join(common.dealt(stays.where(which)), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    out = rows("not _repeats").select(*docs.columns)
    if not stays.where("_repeats").isEmpty():
        one = rows("_repeats").groupBy("k1", "k2").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("one"))
        out = out.unionByName(one.select("one.*"))
    return out


@apart
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret found in a text gives way to its kind in brackets. Texts without any stay as they are, null ones too."""
    found = secrets.find_secrets(docs)
    text = F.when(F.col("spans") == "", F.col("text")).otherwise(F.col("redacted"))
    chars = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return found.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat or lose documents until they have their target of words; a document cut by the budget keeps its first words."""
    words = docs.withColumn("_w", common.word_array(F.col("text"))).withColumns({"_words": F.size("_w").cast("long"), "_weight": mixing.lexical_weight(F.col("_w"))}).drop("_w")
    sizes = common.saved(words.select("doc_id", "source", "_words", "_weight"), "sizes")
    cuts = mixing.plan_mix(sizes, size="_words", weight="_weight")
    mixed = mixing.apply_mix(words, cuts, size="_words", weight="_weight").where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("_words")).cast("int"), F.pmod("taken", "_words").cast("int")
    mixed = mixed.withColumns({"_whole": whole, "_rest": rest}).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole") + (F.col("_rest") > 0).cast("int"))))
    cut = F.col("_copy") > F.col("_whole")
    mixed = mixed.withColumn("text", F.when(cut, F.array_join(F.slice(common.word_array(F.col("text")), F.lit(1), F.col("_rest")), " ")).otherwise(F.col("text")))
    return mixed.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix in sequences of permitted lengths: a row per piece."""
    return packing.pack(docs.select("doc_id", common.word_count(F.col("text")).alias("n_words")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: The first and third stage apply trained models, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, name)
    return docs
