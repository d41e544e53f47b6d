"""Reports on trades against plain loops over a few hundred made-up rows."""

from __future__ import annotations

import random
from statistics import mean, variance

import pytest

from tidemark.operators import execution, integrity
from tidemark.operators.signals import NAMES
from tidemark.plans.frames import query


def _rows(n=300):
    rng = random.Random(5)
    return [(rng.choice(["1h", "4h"]), rng.randrange(10), rng.choice([-1.0, -1.0, 3.0, round(rng.gauss(0, 1), 3)]), *(rng.random() < (i + 1) / 10 for i in range(len(NAMES)))) for _ in range(n)]


def _mean_ranks(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def _corr(a, b):
    ma, mb = mean(a), mean(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5


def _scored(spark, rows):
    return spark.createDataFrame(rows, f"timeframe string, score int, r double, {', '.join(f'{n} boolean' for n in NAMES)}")


def test_rank_correlation_by_timeframe(spark):
    rows = _rows()
    for found in query(execution.spearman_sql("timeframe"), scored=_scored(spark, rows)).collect():
        part = [x for x in rows if x[0] == found.part]
        assert found.n == len(part)
        assert found.rho == pytest.approx(_corr(_mean_ranks([x[1] for x in part]), _mean_ranks([x[2] for x in part])), abs=1e-6)


def test_what_each_guideline_adds(spark):
    rows = _rows()
    found = query(execution.effects_sql(), guided=_scored(spark, rows)).collect()
    assert len(found) == len(NAMES)
    for x in found:
        at = 3 + NAMES.index(x.guideline)
        yes, no = [t[2] for t in rows if t[at]], [t[2] for t in rows if not t[at]]
        assert (x.n_yes, x.n_no) == (len(yes), len(no))
        assert x.t == pytest.approx((mean(yes) - mean(no)) / (variance(yes) / len(yes) + variance(no) / len(no)) ** 0.5, abs=1e-5)
    placed = sorted(found, key=lambda x: x.place)
    assert [abs(x.t) for x in placed] == sorted((abs(x.t) for x in found), reverse=True)
    assert placed[0].t_needed == pytest.approx(2.77, abs=0.01)  # nine tests at 5 % in all


def test_scores_with_few_trades_are_left_out(spark):
    rows = [("1h", 1, 1.0, *[True] * 9)] * 10 + [("1h", 2, -1.0, *[True] * 9)] * 9
    (found,) = query(execution.BY_SCORE, scored=_scored(spark, rows)).collect()
    assert (found.score, found.n, found.win_rate, found.total_r) == (1, 10, 1.0, 10.0)


def test_first_three_examples_of_an_issue(spark):
    bars = [("s", "x", "1h", 3600 * i, i, 10.0, 9.0 if i in (2, 4, 5, 7) else 11.0, 9.0, 10.0, 1.0) for i in range(9)]
    raw = spark.createDataFrame(bars, "source string, symbol string, timeframe string, ts_sec long, ingest_seq int, open double, high double, low double, close double, volume double")
    found = [(x.nth, x.ts_sec) for x in integrity.examples(raw).filter("code = 'OHLC_INCONSISTENT'").orderBy("nth").collect()]
    assert found == [(1, 7200), (2, 14400), (3, 18000)]
