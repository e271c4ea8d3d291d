"""What reaches the driver comes in small portions."""

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from ostinato.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_first_rows_are_those_of_a_sort(spark):
    rows = spark.range(500).select((F.col("id") % 37).alias("h"), F.lit(1).alias("y"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("x"))
    for n in (1, 100, 499, 900):
        want = [(r.h, r.x) for r in rows.orderBy("h", "x").limit(n).collect()]
        assert [(r.h, r.x) for r in toxicity.first_rows(rows, n)] == want
    assert list(toxicity.first_rows(rows.filter("1 = 0"), 10)) == []


def test_the_toxicity_sample_comes_in_parts(spark, monkeypatch):
    seen, plain = [], DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda df, *a, **k: seen.append(df.rdd.getNumPartitions()) or plain(df, *a, **k))
    docs, labels = queries.read(spark, SF, "documents"), queries.read(spark, SF, "labels")
    assert toxicity.learn(docs, labels).bias
    assert len(seen) == 2 and min(seen) >= 8
