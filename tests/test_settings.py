"""Registered queries fit with the published settings."""

import inspect

import pytest

from tracewell.operators import decide, explain, learn
from tracewell.plans.sections import decisions, learning

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.fixture
def settings(monkeypatch):
    def of(module, name, call):
        real = inspect.signature(getattr(module, name))

        def spy(*args, **named):
            bound = real.bind(*args, **named)
            bound.apply_defaults()
            raise Seen(bound.arguments)

        monkeypatch.setattr(module, name, spy)
        with pytest.raises(Seen) as e:
            call()
        return e.value.args[0]

    return of


def test_published_settings(spark, settings, monkeypatch):
    x = settings(learn, "fit_boosted", lambda: learning.ml_04(spark, SF))
    assert (x["iterations"], x["depth"]) == (180, 4)
    assert settings(learn, "fit_forest_regressor", lambda: learning.ml_06(spark, SF))["trees"] == 300
    monkeypatch.setattr(learn, "fit_forest_regressor", lambda *a, **k: None)
    monkeypatch.setattr(learn, "regress", lambda *a, **k: None)
    assert settings(learn, "fit_boosted_regressor", lambda: learning.ml_06(spark, SF))["iterations"] == 200
    x = settings(learn, "evaluate_grid", lambda: learning.ml_13(spark, SF))
    assert len(x["splits"]) == 10
    assert settings(learn, "fit_forest", lambda: x["models"]["forest"](None))["trees"] == 200
    assert settings(decide, "fit_bundle", lambda: decisions.dec_01(spark, SF))["iterations"] == 100
    monkeypatch.setattr(decisions, "_model", lambda *a: (None, None, None))
    assert settings(explain, "permutation_importance", lambda: decisions.exp_01(spark, SF))["repeats"] == 8
