import corpus_pipeline
import pytest

from ostinato.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.count() > 0.5 * before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(*columns), none.select(*columns), odd):
        assert stage(spark, docs, SF).count() >= (0 if docs is not odd else 1)
