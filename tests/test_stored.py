"""Training with a held-out part, stored models, addresses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.config import SHORT
from barloom.models import stored
from barloom.models.design import Design
from barloom.models.windows import Folds, Holdout
from barloom.models.backtest import backtest
from barloom.sources import store
from helpers import HOUR
from test_models import DESIGN, FEATURES, frame, simulate


@pytest.fixture(scope="module")
def rows(spark):
    both = frame(spark, simulate(1, 400), "a").unionByName(frame(spark, simulate(2, 250), "b"))
    return both.unionByName(frame(spark, simulate(3, 4), "tiny")).cache()


@pytest.fixture(scope="module")
def trained(rows):
    return stored.train(rows, DESIGN, SHORT)


def test_held_out_rows_do_not_take_part(spark, rows, trained):
    """Other values in the last fifth change neither the selection nor any fit."""
    other = rows.withColumns({c: F.when((F.col("symbol") == "a") & (F.col("_pos") > 320), F.lit(7.0)).otherwise(F.col(c)) for c in DESIGN.columns})
    again = stored.train(other, DESIGN, SHORT)
    assert trained.selected.orderBy("symbol").collect() == again.selected.orderBy("symbol").collect()
    for model in ("arimax", "sequence"):
        a, b = (t.fitted[model].filter("symbol = 'a'").orderBy("target").toPandas() for t in (trained, again))
        for x, y in zip(a["coef"], b["coef"]):
            np.testing.assert_allclose(x, y, rtol=1e-6, atol=1e-9)


def test_fits_are_those_of_the_first_rows(spark, rows, trained):
    part = rows.filter("symbol = 'a' AND _pos <= 320")
    folds = Folds(319, 1, 1)  # one window of 319 rows, so its own fit is a check on 320 - 1 rows
    direct = backtest(part, DESIGN, folds, top_k=20, var_limit=20, sequence_steps=3, models=["arimax"])
    assert direct.metrics(["symbol"], step_seconds=HOUR).filter("n = 1").count() == 2
    data = simulate(1, 400)
    from test_models import brute_arma

    b, phi, theta, u, e = brute_arma(data, 320)
    fit = trained.fitted["arimax"].filter("symbol = 'a' AND target = 'close'").first()
    np.testing.assert_allclose(fit["coef"], b, rtol=1e-6)
    np.testing.assert_allclose([fit["phi"], fit["theta"], fit["u_last"], fit["e_last"]], [phi, theta, u, e], rtol=1e-5)


def test_every_model_has_a_row_and_failed_ones_hold_nulls(trained):
    got = trained.result.metrics(["symbol"], step_seconds=HOUR).collect()
    n = {(r["symbol"], r["model"]): r["n"] for r in got if r["target"] == "close"}
    assert len(got) == 3 * 4 * 2
    assert all(n["a", m] == 80 and n["b", m] == 50 for m in ("arimax", "var", "additive", "sequence"))
    failed = [r for r in got if r["symbol"] == "tiny" and r["model"] != "additive"]
    assert len(failed) == 6 and all(r["n"] == 0 and r["mae"] is None and r["dir_acc"] is None for r in failed)


def test_loaded_models_forecast_what_fitted_ones_do(spark, rows, trained, tmp_path):
    path = str(tmp_path / "models")
    big = rows.filter("symbol <> 'tiny'")
    store.save_models(stored.packed(trained, SHORT, "v1"), path)
    store.save_models(stored.packed(trained, SHORT, "v2").withColumn("numbers", F.col("numbers")), path)
    loaded = store.load_models(spark, path, horizon="short")
    assert {r["version"] for r in loaded.select("version").distinct().collect()} == {"v2"}
    assert store.load_models(spark, path, horizon="short", version="v1").count() == loaded.count()
    from_store = stored.StoredForecaster(big, DESIGN, SHORT, loaded)
    fresh = stored.FittedForecaster(big, trained, SHORT, future=from_store.future())
    keys = ["symbol", "model", "target", "k"]
    a, b = (f.all().select(*keys, "ts", "yhat").orderBy(*keys).collect() for f in (fresh, from_store))
    assert a == b and len(a) == 2 * 4 * 2 * SHORT.steps
    with pytest.raises(FileNotFoundError):
        store.load_models(spark, path, horizon="long")


def test_a_feature_that_is_gone_counts_as_zero(spark, rows, trained, tmp_path):
    path = store.save_models(stored.packed(trained, SHORT, "v1"), str(tmp_path / "models"))
    loaded = store.load_models(spark, path, horizon="short")
    less = rows.filter("symbol <> 'tiny'").drop("x2_rsi")
    design = Design(DESIGN.targets, ("x1_close",), HOUR, ("symbol",))
    got = stored.StoredForecaster(less, design, SHORT, loaded)
    assert got.design.features == FEATURES
    assert got.arimax().filter("yhat IS NOT NULL").count() == 2 * 2 * SHORT.steps


def test_a_holdout_without_series(spark):
    rows = frame(spark, simulate(1, 200)).drop("symbol")
    design = Design(DESIGN.targets, FEATURES, HOUR)
    done = stored.train(rows, design, SHORT)
    assert {(r["model"], r["n"]) for r in done.result.metrics(step_seconds=HOUR).collect()} == {(m, 40) for m in ("arimax", "var", "additive", "sequence")}
    assert done.ends.first()["train_rows"] == 160
    cut = Holdout(share=0.5)
    assert cut.windows(rows, []).first()["train_rows"] == 100 and cut.tests(rows, cut.windows(rows, []), []).count() == 100


def test_addresses():
    assert store.address("24H", "Bayesian VAR") == ("short", "var") and store.address("1M", "bvar") == ("long", "var")
    assert store.address(None, "ALL") == ("long", None) and store.address("1w", "all_models") == ("short", None)
    assert store.address("1H", "long_prophet") == ("long", "additive") and store.address("6M", "short_lstm") == ("short", "sequence")
    for label in ("", None, "oracle", "long_oracle"):
        with pytest.raises(ValueError):
            store.address("1H", label)


