"""Every training-data query that has SQL, on whole tables; the labelled shapes."""

import pytest

from tailrace.io import table
from tailrace.llm import quality
from tailrace.llm import queries as llm
from tests.oracle import DATA, connect, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(llm.QUERIES[name](spark, str(DATA)), duck, llm.SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_query_runs(spark, name):
    assert llm.QUERIES[name](spark, str(DATA)).count() > 0


def test_labelled_shapes(spark):
    docs = table(spark, str(DATA), "documents")
    labels = {r.doc_id: r.shape for r in table(spark, str(DATA), "doc_label").collect()}
    got = {r.doc_id: r.shape for r in quality.document_statistics(docs, table(spark, str(DATA), "common_word")).collect()}
    right = sum(got.get(d) == s for d, s in labels.items())
    assert right >= 0.95 * len(labels)
