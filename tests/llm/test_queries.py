"""The registered queries: SQL where there is some, and columns and rows of the contract for the rest."""

import pytest

from evigraph.llm import catalog
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf_dir, duck, name):
    found, wanted = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"pipeline"}))
def test_one_row_a_document(spark, sf_dir, docs, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    assert found.select("doc_id").distinct().count() == docs.count()


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline as c

    kept = c.good_quality(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    unique = c.without_near_copies(spark, kept, sf_dir).cache()
    assert unique.columns == docs.columns and 0 < unique.count() <= kept.count()
    clean = c.without_personal_data(spark, unique, sf_dir)
    assert clean.columns == docs.columns and clean.count() == unique.count()
    assert not clean.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count()
    assert not clean.filter("n_chars <> length(text)").count()
    out = c.run(spark, sf_dir).toPandas()
    assert len(out) and set(out.doc_id) <= {r["doc_id"] for r in unique.collect()}
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
