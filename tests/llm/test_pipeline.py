import collections
import random
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from tessella.llm import queries
from test_corpus_operators import brute_one_of_each, prose, words_deduped
from test_text_operators import check_sequences, crc, library_ids, measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_whole_table(spark, sf, name, texts):
    assert {r["doc_id"] for r in queries.QUERIES[name](spark, sf).select("doc_id").collect()} == set(texts)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())


def test_stages_one_by_one(spark, documents, tmp_path):
    """Each stage against brute force on its own input, as written and read again."""
    r = random.Random(2)
    copy = documents.limit(3).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    passage = prose(r, 70)
    more = spark.createDataFrame([(200000 + k, prose(r, 50) + "\n" + passage, "en", "src0", 0) for k in range(4)], documents.schema)
    docs = documents.unionByName(copy).unionByName(more)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        path = str(tmp_path / str(k))
        stage(spark, docs, None).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[k] = (given, docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS, name
    given, out = seen[0]
    assert {x["doc_id"] for x in out} == {x["doc_id"] for x in given if not measures(x["text"])[5]}
    given, out = seen[1]
    want = words_deduped({x["doc_id"]: x["text"] for x in given})
    assert {x["doc_id"]: x["text"].split() for x in out} == want and all(x["n_chars"] == len(x["text"]) for x in out)
    given, out = seen[2]
    assert sorted(x["doc_id"] for x in out) == brute_one_of_each({x["doc_id"]: x["text"] for x in given})
    given, out = seen[3]
    times = collections.Counter(x["doc_id"] for x in out)
    assert set(times) == {x["doc_id"] for x in given} and max(times.values()) <= 2
    given, out = seen[4]
    ids = {x["doc_id"]: library_ids(x["text"]) for x in given}
    assert sum(x["length"] for x in out) == sum(len(ids[x["doc_id"]]) for x in given)
    assert all(x["ids_crc32"] == crc(ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]) for x in out)
    check_sequences(out)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_nulls_and_nothing(spark, documents):
    for name, stage in corpus_pipeline.STAGES:
        nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0)], documents.schema)
        stage(spark, nulls, None).collect()
        assert stage(spark, documents.where("doc_id < 0"), None).count() == 0, name
