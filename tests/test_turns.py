"""One position at a time, against a plain loop, in small and large blocks."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.turns import with_turns

ROW = "source string, symbol string, timeframe string, begins int, ends int, context_scale int, note string"


def loop(rows):
    busy, taken = {}, []
    for r in sorted(rows, key=lambda r: (r[:3], r[3], r[5], r[3] - 1 if r[4] is None else r[4])):
        if r[3] > busy.get(r[:3], -1):
            taken.append(r)
            busy[r[:3]] = r[3] - 1 if r[4] is None else r[4]
    return sorted(taken, key=str)


def some(n, series, furthest, seed):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        begins = dice.randrange(0, 400)
        ends = None if dice.random() < 0.2 else begins + dice.randrange(0, furthest)
        rows.append(("t", dice.choice(series), "1d", begins, ends, dice.randrange(3, 6), str(k)))
    # rows that begin at one bar on one scale end at different ones
    return list({(r[:3], r[3], r[5]): r for r in rows}.values())


@pytest.mark.parametrize(("bits", "furthest"), [(2, 6), (3, 90), (12, 20)])
def test_as_a_loop_does_it(spark, bits, furthest):
    rows = some(500, ["A", "A", "A", "B", "C"], furthest, bits) + [("t", "D", "1d", 0, 0, 3, "alone"), ("t", "E", "1d", 7, None, 3, "waits"), ("t", "E", "1d", 7, None, 4, "waits too")]
    found = with_turns(spark.createDataFrame(rows, ROW), "begins", "ends", bits=bits).collect()
    assert len(found) == len(rows)
    assert sorted((tuple(r)[:-1] for r in found if r.taken), key=str) == loop(rows)


def test_nothing_and_no_beginning(spark):
    assert with_turns(spark.createDataFrame([], ROW), "begins", "ends").collect() == []
    rows = [("t", "A", "1d", None, None, 3, "x"), ("t", "A", "1d", 4, 9, 3, "y"), ("t", "A", "1d", 9, 9, 3, "z")]
    found = with_turns(spark.createDataFrame(rows, ROW), "begins", "ends", bits=1).collect()
    assert {r.note: r.taken for r in found} == {"x": False, "y": True, "z": False}


def test_many_blocks_need_few_rounds(spark, monkeypatch):
    """A chain through 60 blocks: links reach twice as far each round."""
    from tidemark.plans import base

    writes, stored = [], base.stored
    monkeypatch.setattr(base, "stored", lambda df: writes.append(1) or stored(df))
    rows = [("t", "A", "1d", 4 * k, 4 * k + 1, 3, str(k)) for k in range(60)]
    found = with_turns(spark.createDataFrame(rows, ROW), "begins", "ends", bits=2).filter("taken")
    assert found.count() == 60 and len(writes) <= 2 + 2 * 7
