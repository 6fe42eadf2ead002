"""The pipeline's stages against the operators' decisions, and the registered queries with SQL against DuckDB."""

import duckdb
import pytest

from cohortry.llm import queries
from cohortry.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


def test_stages(spark):
    import corpus_pipeline as pipeline
    from cohortry.llm.decontaminate import brute_force

    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    docs = table(spark, FOLDER, "documents")
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    out = pipeline.drop_contaminated(spark, docs, FOLDER)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in brute_force(list(kept.items()), items) if not r[5]}
    for stage in (pipeline.drop_copies, pipeline.drop_near_copies):
        once = stage(spark, docs, FOLDER)
        assert once.columns == docs.columns and once.count() == stage(spark, once, FOLDER).count() < docs.count()
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_no_rejected_row_stays_where_identifiers_repeat(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, "a"), (3, "b"), (4, "c"), (4, "c"), (None, "d"), (None, "d"), (None, "e")], "doc_id long, text string").repartition(3)

    def left(stage, rows):
        return sorted(map(str, (tuple(r) for r in stage(spark, rows, FOLDER).collect())))

    assert left(pipeline.drop_copies, docs) == ["(1, 'a')", "(2, 'b')", "(4, 'c')", "(None, 'd')", "(None, 'e')"]
    near = left(pipeline.drop_near_copies, docs)
    assert len(near) == 5 and near == sorted(set(near))
    item = next(r.text for r in table(spark, FOLDER, "benchmark").collect() if len((r.text or "").split()) > 13)
    two = spark.createDataFrame([(9, item), (9, "clean words only"), (None, item), (None, None)], "doc_id long, text string")
    assert left(pipeline.drop_contaminated, two) == ["(9, 'clean words only')", "(None, None)"]


def test_toxic_rows_go_one_by_one(spark, monkeypatch):
    import corpus_pipeline as pipeline
    from cohortry.llm import toxicity

    monkeypatch.setattr(toxicity, "fitted_lexicon", lambda *_: toxicity.Lexicon({" idiot ": 5.0}, (), 4.0, -3.0))
    rows = spark.createDataFrame([(9, "you 1diot"), (9, "fine"), (None, "idiot"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in pipeline.drop_toxic(spark, rows, FOLDER).collect()))) == ["(9, 'fine')", "(None, None)"]
