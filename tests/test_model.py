"""What the adapters of the driver's tables move."""

import re

import pytest

from pressloom.sources.model import Model


@pytest.mark.parametrize("wanted", [["title", "dek"], ["article_id", "canonical_url", "fetched_at"]])
def test_articles_leave_whole_texts_where_they_are_read(spark, wanted):
    """Only what is asked for meets the vectors, which is a shuffle of large tables."""
    plan = Model(spark, "/root/testdata/sf0.001").articles().select(*wanted)._jdf.queryExecution().optimizedPlan().toString()
    joined = re.search(r"Join LeftOuter.*\n\s*:- Project \[(.*)\]\n", plan).group(1)
    assert not re.search(r"(^|, )text#\d+($|, )", joined)
