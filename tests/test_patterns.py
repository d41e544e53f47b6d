"""Rules on price sequences with known outcomes."""

from __future__ import annotations

import pytest

from tidemark.operators import rules

#: prices, pattern, expected violations ("" for a fit), a note that must be there
CASES = [
    ((100, 120, 110, 160, 145, 180), "impulse", "", "extension_w3"), ((200, 180, 190, 140, 155, 120), "impulse", "", ""), ((100, 120, 95, 160, 145, 180), "impulse", "W2_RETRACE", ""),
    ((100, 120, 110, 118, 112, 140), "impulse", "W3_BEYOND_W1", ""), ((100, 140, 130, 145, 138, 178), "impulse", "W3_SHORTEST", ""), ((100, 200, 180, 400, 360, 700), "impulse", "", ""),
    ((100, 120, 110, 160, 115, 180), "impulse", "W4_OVERLAP", ""), ((100, 120, 110, 160, 145, 155), "impulse", "", "truncated_fifth"), ((100, 150, 120, 155, 132, 158), "ending_diagonal", "", ""),
    ((100, 120, 110, 160, 145, 180), "ending_diagonal", "NO_OVERLAP", ""), ((100, 130, 115, 155, 118, 200), "ending_diagonal", "NOT_CONTRACTING", ""), ((200, 150, 175, 120), "zigzag", "", ""),
    ((200, 150, 205, 120), "zigzag", "B_EXCEEDS_A_START", ""), ((200, 150, 175, 160), "zigzag", "C_SHORT_OF_A", ""), ((200, 150, 197, 140), "flat", "", "regular"), ((200, 150, 197, 140), "zigzag", "B_TOO_DEEP", ""),
    ((200, 150, 165, 120), "flat", "B_TOO_SHALLOW", ""), ((200, 150, 210, 130), "flat", "", "expanded"), ((200, 150, 212, 160), "flat", "", "running"), ((200, 140, 185, 150, 175, 158), "triangle", "", "contracting"),
    ((100, 110, 120, 130, 140, 150), "impulse", "STRUKTUR", ""), ((100, 110, 120, 130), "zigzag", "STRUKTUR", ""), ((100, 120, 110, 160), "impulse", "STRUKTUR", ""),
    ((200, 150, 175, 140, 160, 110, 158, 130), "double_three", "", "zigzag-flat"), ((200, 150, 175, 140, 170, 120, 140, 100), "double_three", "ZWEI_ZIGZAGS", ""),
]


def _row(number, prices):
    kinds = [1 if prices[1] < prices[0] else -1] + [1 if b > a else -1 for a, b in zip(prices, prices[1:])]
    pad = lambda xs: list(xs) + [None] * (8 - len(xs))
    return (number, len(prices), *pad([float(p) for p in prices]), *pad([10 * i for i in range(len(prices))]), *pad(kinds))


def _checked(spark, config=rules.Config()):
    columns = ", ".join(["id int", "n int", *(f"p{i} double" for i in range(8)), *(f"i{i} int" for i in range(8)), *(f"k{i} int" for i in range(8))])
    windows = spark.createDataFrame([_row(i, c[0]) for i, c in enumerate(CASES)], columns)
    return {(r.id, r.pattern): r for r in rules.check(windows, "id", config).collect()}


def test_cases(spark):
    found = _checked(spark)
    for i, (prices, pattern, violation, note) in enumerate(CASES):
        r = found[i, pattern]
        assert r.ok == (violation == ""), (prices, pattern, r)
        assert violation in r.violations.split(",") if violation else not r.violations
        assert not note or note in r.notes.split(",")


def test_leverage_tolerates_overlap(spark):
    global CASES
    kept = CASES
    CASES = [((100, 120, 110, 160, 119, 180), "impulse", "", "")]
    try:
        assert not _checked(spark)[0, "impulse"].ok and _checked(spark, rules.Config.leveraged())[0, "impulse"].ok
    finally:
        CASES = kept


@pytest.mark.parametrize("pattern", ["leading_diagonal", "ending_diagonal"])
def test_diagonals_match_together(spark, pattern):
    found = _checked(spark)
    assert all(found[i, pattern].ok == found[i, "leading_diagonal"].ok for i in range(len(CASES)))
