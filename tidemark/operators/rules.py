"""Wave patterns as rules on a window of turning points.

A window is a row with prices p0..p7, bars i0..i7 and known-at bars c0..c7 of consecutive points, n of them
(further ones null). A rule rejects; notes describe. All patterns that a window fits are reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.plans.frames import KEY, query

#: The patterns with how many waves they have and into how many sub-waves these divide.
PATTERNS = {
    "impulse": (5, 3, 5, 3, 5), "leading_diagonal": (5, 3, 5, 3, 5), "ending_diagonal": (3, 3, 3, 3, 3), "zigzag": (5, 3, 5), "flat": (3, 3, 5),
    "triangle": (3, 3, 3, 3, 3), "double_three": (3, 3, 3, 3, 3, 3, 3),
}


@dataclass(frozen=True)
class Config:
    overlap: float = 0.0
    flat_b: float = 0.90
    expanded_b: float = 1.05
    eps: float = 1e-9

    @classmethod
    def leveraged(cls) -> Config:
        return cls(overlap=0.05)


def beyond(a: str, b: str, d: str = "d") -> str:
    return f"({d} * ({a} - {b}) > 0)"


def length(i: int) -> str:
    return f"abs(p{i + 1} - p{i})"


def log_length(i: int, last: int) -> str:
    """In logarithms, unless a price of the window isn't positive."""
    prices = ", ".join(f"p{k}" for k in range(last + 1))
    return f"(CASE WHEN least({prices}) > 0 THEN abs(ln(p{i + 1}) - ln(p{i})) ELSE {length(i)} END)"


def _direction(first: int = 0) -> str:
    return f"(CASE WHEN p{first + 1} > p{first} THEN 1 ELSE -1 END)"


def _structure(points: int, exact: bool) -> list[tuple[str, str]]:
    stands = [f"i{k + 1} <= i{k}" for k in range(points - 1)]
    kinds = [f"k{k + 1} = k{k}" for k in range(points - 1)]
    return [("STRUKTUR", (f"n <> {points} OR " if exact else "") + " OR ".join(kinds)), ("STRUKTUR", " OR ".join(stands))]


def _motive() -> list[tuple[str, str]]:
    g0, g2, g4 = (log_length(i, 5) for i in (0, 2, 4))
    return [
        ("W2_RETRACE", f"NOT {beyond('p2', 'p0')}"), ("W3_BEYOND_W1", f"NOT {beyond('p3', 'p1')}"),
        ("W3_SHORTEST", f"{g2} < {g0} AND {g2} < {g4}"), ("W4_RETRACE", f"NOT {beyond('p4', 'p2')}"),
    ]


def overlap() -> str:
    """How far wave 4 reaches into wave 1, in parts of wave 1; null (read: without end) for a wave of no length."""
    return "(d * (p1 - p4) / nullif(abs(p1 - p0), 0))"


def converging() -> str:
    """Whether the lines p1-p3 and p2-p4 are nearer at p4 than at p1."""
    at4 = "abs(p1 + (p3 - p1) * (i4 - i1) / nullif(cast(i3 - i1 as double), 0) - p4)"
    at1 = "abs(p1 - (p2 + (p4 - p2) * (i1 - i2) / nullif(cast(i4 - i2 as double), 0)))"
    return f"coalesce({at4} / nullif({at1}, 0) < 1, false)"


def _zigzag(s: int, c: Config) -> str:
    a, b, e, f = (f"p{s + k}" for k in range(4))
    d = _direction(s)
    return f"(NOT {beyond(e, a, '-' + d)} AND coalesce(abs({e} - {b}) / nullif(abs({b} - {a}), 0) < {c.flat_b}, false) AND {beyond(f, b, d)})"


def _flat(s: int, c: Config) -> str:
    a, b, e = (f"p{s + k}" for k in range(3))
    return f"coalesce(abs({e} - {b}) / nullif(abs({b} - {a}), 0) >= {c.flat_b}, true)"


def _kind(s: int, c: Config) -> str:
    return f"(CASE WHEN {_zigzag(s, c)} THEN 'zigzag' WHEN {_flat(s, c)} THEN 'flat' END)"


def checks(c: Config = Config()) -> dict[str, tuple[list[tuple[str, str]], list[tuple[str, str]]]]:
    """Per pattern its violations and notes, as (name, condition)."""
    retrace = "(abs(p2 - p1) / nullif(abs(p1 - p0), 0))"
    deep, far = f"coalesce({retrace} >= {c.flat_b}, true)", f"coalesce({retrace} > {c.expanded_b}, true)"
    g0, g2, g4 = (log_length(i, 5) for i in (0, 2, 4))
    short5, longer = ("truncated_fifth", f"NOT {beyond('p5', 'p3')}"), beyond("p3", "p1")
    inside = [f"NOT {beyond(f'p{k}', f'p{k - 2}', 'd' if k % 2 else '-d')}" for k in (3, 4, 5)]
    wedge = [*_motive(), ("NO_OVERLAP", f"coalesce({overlap()} <= 0, false)"), ("NOT_CONTRACTING", f"NOT {converging()}")]
    w, y = _kind(0, c), _kind(4, c)
    sideways = "abs(p3 - p0) > 0 AND (p7 - p3) * (CASE WHEN p7 > p0 THEN 1 ELSE -1 END) / nullif(abs(p3 - p0), 0) > 1.5"
    return {
        "impulse": (
            [*_motive(), ("W4_OVERLAP", f"coalesce({overlap()} > {c.overlap + c.eps}, true)")],
            [short5, ("extension_w1", f"{g0} >= {g2} AND {g0} >= {g4}"), ("extension_w3", f"{g2} > {g0} AND {g2} >= {g4}"), ("extension_w5", f"{g4} > {g0} AND {g4} > {g2}")],
        ),
        "leading_diagonal": (wedge, [short5]),
        "ending_diagonal": (wedge, [short5]),
        "zigzag": ([("B_EXCEEDS_A_START", beyond("p2", "p0", "-d")), ("B_TOO_DEEP", deep), ("C_SHORT_OF_A", f"NOT {longer}")], []),
        "flat": ([("B_TOO_SHALLOW", f"NOT {deep}")], [("expanded", f"{far} AND {longer}"), ("running", f"{far} AND NOT {longer}"), ("regular", f"NOT {far}"), ("c_short", f"NOT {far} AND NOT {longer}")]),
        "triangle": (
            [
                ("NOT_OVERLAPPING", f"{converging()} AND NOT ({' AND '.join(inside)})"), ("NOT_EXPANDING", f"NOT {converging()} AND ({' OR '.join(inside)})"),
                ("NOT_MONOTONE_CONTRACTING", f"{converging()} AND NOT ({length(1)} > {length(3)} AND {length(2)} > {length(4)})"),
            ],
            [("contracting", converging()), ("expanding", f"NOT {converging()}"), ("running", beyond("p2", "p0", "-d"))],
        ),
        "double_three": (
            [("W_UNGUELTIG", f"{w} IS NULL"), ("Y_UNGUELTIG", f"{y} IS NULL"), ("ZWEI_ZIGZAGS", f"coalesce({w} = 'zigzag' AND {y} = 'zigzag', false)"), ("NICHT_SEITWAERTS", f"coalesce({sideways}, false)")],
            [("zigzag-zigzag", f"coalesce({w} = 'zigzag' AND {y} = 'zigzag', false)"), ("zigzag-flat", f"coalesce({w} = 'zigzag' AND {y} = 'flat', false)"), ("flat-zigzag", f"coalesce({w} = 'flat' AND {y} = 'zigzag', false)"), ("flat-flat", f"coalesce({w} = 'flat' AND {y} = 'flat', false)"), ("alternierend", f"coalesce({w} <> {y}, false)")],
        ),
    }


def _names(found: list[tuple[str, str]]) -> str:
    if not found:
        return "''"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in found) + ")"


def check_sql(windows: str, keep: str, c: Config = Config(), exact: bool = True) -> str:
    """A row for each window and pattern: keep, pattern, ok, violations, notes. A broken structure hides all else.

    exact: the window's n points must be the pattern's; else a pattern looks at as many as it needs.
    """
    bad_cases, note_cases = [], []
    for pattern, (bad, notes) in checks(c).items():
        broken, late = _structure(len(PATTERNS[pattern]) + 1, exact)
        unsound = f"coalesce({broken[1]}, true) OR coalesce({late[1]}, true)"
        bad_cases.append(f"WHEN '{pattern}' THEN CASE WHEN {unsound} THEN 'STRUKTUR' ELSE {_names(bad)} END")
        note_cases.append(f"WHEN '{pattern}' THEN CASE WHEN {unsound} THEN '' ELSE {_names(notes)} END")
    every = "(VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + ") AS e(pattern)"
    # all patterns in one pass over the windows; notes are worked out only for what is asked of them
    return f"""SELECT *, violations = '' AS ok FROM (
  SELECT {keep}, pattern, CASE pattern {" ".join(bad_cases)} END AS violations, CASE pattern {" ".join(note_cases)} END AS notes
  FROM (SELECT *, {_direction()} AS d FROM {windows}) AS w CROSS JOIN {every}) AS checked"""


def window_sql(pivots: str, points: int = 8) -> str:
    """Every run of consecutive points of a scale (first ones of a scale left out); n: as many as there are, 8 at most."""
    lead = ", ".join(f"lead({c}, {k}) OVER w AS {a}{k}" for k in range(1, points) for c, a in (("price", "p"), ("idx", "i"), ("kind", "k"), ("confirmed_idx", "c")))
    return f"SELECT {KEY}, scale, seq, price AS p0, idx AS i0, kind AS k0, confirmed_idx AS c0, {lead} FROM {pivots} WHERE NOT is_anchor WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)"


def check(windows: DataFrame, keep: str, c: Config = Config()) -> DataFrame:
    return query(check_sql("{windows}", keep, c), windows=windows)
