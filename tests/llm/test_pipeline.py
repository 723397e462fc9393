"""The pipeline's stages on planted documents."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    n_words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    assert 0 < kept.count() < docs.count() and kept.filter(n_words < 50).count() == 0
    kept.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    twice = kept.union(kept.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    once = corpus_pipeline.near_dedup(spark, twice, SF)
    assert once.columns == docs.columns and once.filter("doc_id >= 1000000").count() == 0 and 0 < once.count() <= kept.count()
    once.write.parquet(f"{tmp_path}/once")
    once = spark.read.parquet(f"{tmp_path}/once")
    mixed = corpus_pipeline.source_mixing(spark, once, SF)
    assert mixed.columns == docs.columns and mixed.count() == mixed.select("doc_id").distinct().count()
    size = lambda df: df.agg(F.sum(F.ceil(F.octet_length("text") / 4))).first()[0]
    assert 0.7 * size(once) < size(mixed) <= 0.9 * size(once)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    packed = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.filter("n <> end OR n > 1024").count() == 0 and got.count() > 0


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, empty texts, names that stages use themselves, maps; and tables without rows."""
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"word{i} of a longer text, number {i * i};" for i in range(40))
    data = [(1, good, "en", "src1", "p", {"k": 1}, 1.5, 7), (1, good, "en", "src1", "p", {"k": 1}, 1.5, 7), (2, good.upper(), None, None, None, None, None, None), (None, good + " and an end", "de", "src3", "q", {"k": 4}, 2.5, 8), (4, None, "en", "src1", "r", {}, 0.0, 9), (5, "", "en", "src1", "r", {}, 0.0, 9), (6, "few words", "en", "src1", "r", {}, 0.0, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, __epoch string, m map<string,int>, `a.b` double, __n_tokens int")
    for rows in (docs, docs.limit(0)):
        left = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, str(tmp_path))
            assert left.columns == docs.columns, name
            left.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            left = spark.read.parquet(f"{tmp_path}/{name}")
        kept = [(r["doc_id"], r["__epoch"], r["m"], r["a.b"], r["__n_tokens"]) for r in left.collect()]
        assert set(kept_ids := [k[0] for k in kept]) <= {1, None} and len(kept_ids) == len(set(kept_ids))
        assert all(k in [(1, "p", {"k": 1}, 1.5, 7), (None, "q", {"k": 4}, 2.5, 8)] for k in kept)
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == (6 if rows is docs else 0)
    # 2 and the one without an id resemble 1; null and empty texts are copies of each other
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [1, 4, 6]
