import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axisloom.llm import common, mixing, secrets, toxicity

from .test_operators import brute_groups, brute_secrets, brute_sets, split


#: Names that operators give to columns of their own.
CLASHES = ["spans", "redacted", "n_neural", "_score", "_words", "_weight", "_copy", "k1", "_k1", "taken", "_size", "extra_5", "c0"]


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """Documents with toxic ones among them, an extra column, and labels."""
    d = tmp_path_factory.mktemp("sf")
    bad = [(2000 + i, f"{w} lonar mipos blortface kather {w} supor grumwit nares {i} lopor", "src1", "x", 10) for i, w in enumerate(["blortface", "grumwit"] * 30)]
    fine = [(3000 + i, f"kanar lopor {i} mirithe suris nothing wrong at all here {i * 7}", "src2", "x", 10) for i in range(60)]
    some = [(4000, "password = hunter22 kanar lopor mirithe", "src0", "x", 10)]
    spark.createDataFrame(bad + fine + some, docs.schema).unionByName(docs).withColumn("spare", F.col("doc_id") % 3).withColumns({c: F.lit("mine") for c in CLASHES}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2000 + i, 1) for i in range(60)] + [(3000 + i, 0) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    key = lambda r: tuple(r[c] for c in columns)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]

    clean = common.saved(stages["toxicity"](spark, docs, tables))
    assert clean.columns == columns
    model = toxicity.fit(*toxicity.sample(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    rows = docs.collect()
    p = toxicity.scores([r["text"] or "" for r in rows], model)
    assert collections.Counter(map(key, clean.collect())) == collections.Counter(key(r) for r, x in zip(rows, p) if x < 0.5)
    assert clean.where("doc_id between 2000 and 2999").count() == 0 and clean.where("doc_id between 3000 and 3999").count() == 60

    rows = clean.collect()
    sets = brute_sets(rows)
    groups = collections.defaultdict(list)
    for r, s, g in zip(rows, sets, brute_groups(rows, sets)):
        groups[g].append((r, s))
    single = common.saved(stages["near_duplicates"](spark, clean, tables))
    got = collections.Counter(map(key, single.collect()))
    assert sum(got.values()) == sum(1 if v[0][1] else len(v) for v in groups.values())
    for v in groups.values():
        ids = [r["doc_id"] for r, _ in v if r["doc_id"] is not None]
        assert any(got[key(r)] for r, _ in v if not ids or r["doc_id"] == min(ids))

    masked = common.saved(stages["secrets"](spark, single, tables))
    assert masked.columns == columns and masked.count() == single.count()
    assert not any(brute_secrets(r["text"]) for r in masked.collect())
    assert masked.where("doc_id = 4000").first()["text"].startswith("[assign] kanar")
    net = secrets.trained()
    same = [r for r in single.collect() if not secrets.scan([r["text"] or ""], net)[0][1]]
    assert not collections.Counter(map(key, same)) - collections.Counter(map(key, masked.collect()))

    assert {tuple(r) for r in masked.select(*CLASHES).distinct().collect()} == {("mine",) * len(CLASHES)}
    mix = common.saved(stages["mixing"](spark, masked, tables))
    assert mix.columns == columns
    size = collections.Counter()
    for r in masked.collect():
        size[r["source"]] += len(split(r["text"]))
    got = collections.Counter()
    for r in mix.collect():
        got[r["source"]] += len(split(r["text"]))
    w = masked.select("doc_id", "source", common.word_array(F.col("text")).alias("_w")).select("doc_id", "source", F.size("_w").cast("long").alias("size"), mixing.lexical_weight(F.col("_w")).alias("weight"))
    target = {r["source"]: r["target"] for r in mixing.apply_mix(w, mixing.plan_mix(w)).collect()}
    assert all(abs(got[s] - target[s]) <= 5 for s in target) and set(got) <= set(size)

    packed = stages["packing"](spark, mix, tables).collect()
    assert sum(r["length"] for r in packed) == sum(got.values())


def test_run_applies_the_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and all(r["bin_used"] <= r["bin_capacity"] for r in rows)


def test_empty_table(spark, tables, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
