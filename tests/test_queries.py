"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from compare import rows

from namewake.plans import registry

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    found = registry.queries()[name](spark, sf).toPandas()
    if sql := registry.oracle_sql().get(name):
        wanted = duck.execute(sql).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0


def test_candidate_state_by_hand(spark):
    from namewake.streaming.events import candidate_state

    kinds = {"a": ["view", "purchase", "view", "click", "signup"], "b": ["purchase", "error"], "c": ["error", "view"], "d": ["purchase", "error", "purchase"]}
    data = [(label, i, i, kind) for label, all_ in kinds.items() for i, kind in enumerate(all_)]
    got = {r.label: r.state for r in candidate_state(spark.createDataFrame(data, "label string, ts long, event_id long, kind string")).collect()}
    assert got == {"a": "detected", "b": "dropped", "c": "", "d": "exited"}
