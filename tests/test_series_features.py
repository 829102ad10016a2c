from __future__ import annotations

import pytest

from barloom.operators.indicators import INDICATORS
from barloom.plans import load, models


@pytest.mark.parametrize("name", ["sequence_fit", "sequence_regression", "backtest_series", "arimax_fit"])
def test_series_queries_use_all_features(spark, tables, name, monkeypatch):
    class Seen(Exception):
        pass

    def seen(rows, features, **_):
        raise Seen(*features)

    monkeypatch.setattr(models, "series_table", seen)
    with pytest.raises(Seen) as caught:
        load().QUERIES[name](spark, tables)
    assert list(caught.value.args) == ["open", "volume", *INDICATORS]
