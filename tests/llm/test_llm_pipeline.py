"""The pipeline's stages on the smallest table, each on its own input, and the registered queries with SQL."""

import pytest

import corpus_pipeline
from admira.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    cols, counts = docs.columns, [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir)
        assert docs.columns == cols
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[1] >= 0.97 * counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("length > 1024").count() == 0 and packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    tidy = lambda v: round(v, 3) if isinstance(v, float) else v
    got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(tidy(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want
