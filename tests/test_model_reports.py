"""Reports on a model's predictions against numpy, and several surrogates of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tests.conftest import SF
from tidemark.operators import features, ratios
from tidemark.plans import base
from tidemark.plans.frames import query

SCHEMA = "source string, symbol string, timeframe string, bar_idx int, direction int, ts_sec bigint, fold int, y double, prediction double"


@pytest.fixture(scope="module")
def tables(spark):
    dice = np.random.default_rng(3)
    y = dice.normal(size=400)

    def table(noise):
        rows = [("t", "AB"[i % 2], "1d", i, 1 if i % 3 else -1, i * 86_400, i // 100, float(v), float(v + noise * dice.normal())) for i, v in enumerate(y)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    one, other = table(3.0), table(0.5)
    return one, other, spark.createDataFrame(one, SCHEMA), spark.createDataFrame(other, SCHEMA)


def rho(t):
    by_fold = t.groupby("fold").apply(lambda g: g.prediction.rank().corr(g.y.rank()), include_groups=False)
    return float(by_fold.mean())  # folds are equal in size


def test_feature_sets(tables):
    one, other, trend, both = tables
    (found,) = query(features.FEATURE_SETS, trend=trend, both=both).collect()
    tops = [t.y[t.prediction >= np.percentile(t.prediction, 90)] for t in (one, other)]
    t = (tops[1].mean() - tops[0].mean()) / np.sqrt(sum(x.var(ddof=1) / len(x) for x in tops))
    assert found.n == 400 and found.t == pytest.approx(t) and found.difference > 0.5
    assert (found.rho_trend, found.rho_both) == (pytest.approx(rho(one)), pytest.approx(rho(other)))
    assert query(features.FEATURE_SETS, trend=trend.limit(0), both=both.limit(0)).count() == 0


def test_controls(tables):
    one, _, trend, _ = tables
    found = {(r.control, r.part): r for r in query(features.controls_sql(("A",), 5), predicted=trend).collect()}
    top = one[one.prediction >= np.percentile(one.prediction, 90)]
    for key, mine, all_ in ((("direction", "long"), top[top.direction > 0], one[one.direction > 0]), (("class", "other"), top[top.symbol != "A"], one[one.symbol != "A"])):
        r = found[key]
        assert (r.n, r.n_top) == (len(all_), len(mine)) and r.lift == pytest.approx(mine.y.mean() - all_.y.mean())
        assert r.t == pytest.approx(r.lift / np.sqrt(mine.y.var(ddof=1) / len(mine) + all_.y.var(ddof=1) / len(all_)))
    assert len(found) == 4 and query(features.controls_sql(("A",), 1000), predicted=trend).count() == 0


def test_surrogates_of_a_series_differ(spark):
    bars = base.frame(spark, SF, "bars", "walk_h")
    made = query(ratios.surrogates_sql(3), bars=bars).toPandas()
    assert len(made) == 3 * bars.count() and made.source.nunique() == 3 * bars.select("source").distinct().count()
    paths = made[made.bar_idx > 60].pivot_table(index=["symbol", "bar_idx"], columns="source", values="close").dropna()
    assert not np.allclose(paths.iloc[:, 0], paths.iloc[:, 1]) and not np.allclose(paths.iloc[:, 1], paths.iloc[:, 2])
