import pytest
from notelith.llm import queries as llm
from tests.oracle import connect, spark_rows, sql_rows

WITH_SQL = sorted(llm.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(spark, sf, name):
    assert spark_rows(llm.queries()[name](spark, sf)) == sql_rows(connect(sf), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(WITH_SQL)))
def test_runs(spark, sf, name):
    assert llm.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("sf_dir, least", [("/root/testdata/sf0.01", 0.9), ("/root/testdata/sf0.1", 0.98)])
def test_kinds_agree_with_held_out_labels(spark, sf_dir, least):
    """The labels of one half start the mixture and name its components, those of the other half are compared."""
    from notelith.llm import quality
    from notelith.runtime import table

    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "doc_labels"))
    found = quality.document_kinds(docs, labels.where("doc_id % 2 = 0"))
    held = found.join(labels.where("doc_id % 2 = 1").withColumnRenamed("kind", "label"), "doc_id").toPandas()
    assert len(held) > 20 and (held["kind"] == held["label"]).mean() >= least


def test_labels_decide(spark):
    """With all labels saying one kind, every document has it; with two names exchanged, the documents change theirs."""
    from notelith.llm import quality
    from notelith.runtime import table
    from pyspark.sql import functions as F

    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "doc_labels"))
    kinds = lambda x: {r.doc_id: r.kind for r in quality.document_kinds(docs, x).collect()}
    assert set(kinds(labels.withColumn("kind", F.lit("prose"))).values()) == {"prose"}
    swapped = F.when(F.col("kind") == "list", "table").when(F.col("kind") == "table", "list").otherwise(F.col("kind"))
    a, b = kinds(labels), kinds(labels.withColumn("kind", swapped))
    lists = [i for i, k in a.items() if k == "list"]
    assert len(lists) > 50 and sum(b[i] == "table" for i in lists) >= 0.9 * len(lists)
