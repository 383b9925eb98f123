import os

import pytest

from tessera.plans import catalog
from tessera.plans.lead_queries import _identities

from .test_lead_grouping import FIELDS, by_hand

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_preview_counts_the_groups_of_the_rules(spark):
    """E12 against the rules read one by one; no block is gathered in one place."""
    preview = catalog.QUERIES["e12_identity_preview"](spark, SF)
    assert "InPandas" not in preview._jdf.queryExecution().executedPlan().toString()
    rows = sorted(tuple(v or "" if k else v for k, v in enumerate(r)) for r in _identities(spark, SF).select("row_idx", *FIELDS).collect())
    groups = by_hand(rows)
    has = lambda text: sum(text in reasons for _, reasons in groups.values())
    assert preview.collect() == [(len(rows), len({first for first, _ in groups.values()}), has("bridge"), has("conflicting"), has("ambiguous"))]
