"""Two-sided p-values of Student's t, as an expression of built-in functions.

p is the regularised incomplete beta function of nu / (nu + t^2) with parameters nu / 2 and 1/2. It is worked out from
its continued fraction, from whichever side converges faster, with as many steps as the degrees of freedom ask for.
"""

from __future__ import annotations

from tidemark.plans.frames import form

#: The first coefficients of Stirling's series for the logarithm of the gamma function.
_STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188))
_SHIFT = 8


def _log_gamma(x: str) -> str:
    """Stirling's series at x + 8, less the logarithm of what lies between; for x > 0."""
    y = f"({x} + {_SHIFT})"
    series = " + ".join(f"({a}e0 / {b}) / power({y}, {2 * k + 1})" for k, (a, b) in enumerate(_STIRLING))
    between = " * ".join(f"({x} + {i})" for i in range(_SHIFT))
    return f"(({y} - 0.5e0) * ln({y}) - {y} + 0.5e0 * ln(2 * pi()) + {series} - ln({between}))"


def _coefficient(a: str, b: str, x: str, k: str) -> str:
    even, odd = f"floor({k} / 2)", f"floor(({k} - 1) / 2)"
    return f"(CASE WHEN {k} % 2 = 0 THEN {even} * ({b} - {even}) ELSE -({a} + {odd}) * ({a} + {b} + {odd}) END * {x} / (({a} + {k} - 1) * ({a} + {k})))"


def _spark_fraction(a: str, b: str, x: str, steps: str) -> str:
    e = _coefficient(a, b, x, "k")
    step = f"named_struct('c', 1 + {e} / s.c, 'd', 1 / (1 + {e} * s.d), 'f', s.f * (1 + {e} / s.c) / (1 + {e} * s.d))"
    return f"aggregate(sequence(1, {steps}), named_struct('c', 1e0, 'd', 0e0, 'f', 1e0), (s, k) -> {step}, s -> s.f)"


def _duck_fraction(a: str, b: str, x: str, steps: str) -> str:
    """From the last step backwards, so not by the same way."""
    return f"list_reduce(list_reverse(range(1, {steps} + 1)), lambda f, k: 1 + {_coefficient(a, b, x, 'k')} / f, 1e0)"


def _beta(fraction, log_gamma, a: str, b: str, x: str, rest: str, steps: str) -> str:
    front = f"exp({log_gamma(f'({a} + {b})')} - {log_gamma(a)} - {log_gamma(b)} + {a} * ln({x}) + {b} * ln({rest})) / {a}"
    return f"({front} / {fraction(a, b, x, steps)})"


def p_value(t: str, nu: str) -> str:
    """The chance of a t as far from 0 or farther with nu degrees of freedom, whole or not; null where either is missing or nu isn't positive.

    t, nu: columns of type double.
    """
    a, b, x, rest, steps = "v.a", "0.5e0", "v.x", "v.rest", "v.steps"

    def text(fraction, log_gamma) -> str:
        near, far = _beta(fraction, log_gamma, a, b, x, rest, steps), _beta(fraction, log_gamma, b, a, rest, x, steps)
        return f"CASE WHEN v.a IS NULL OR v.x IS NULL THEN NULL WHEN {rest} = 0 THEN 1e0 WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {near} ELSE 1 - {far} END"

    # both sides come from t itself, so that neither loses digits; they are bound once for the many places that name them
    bound = {"a": f"CASE WHEN {nu} > 0 THEN {nu} / 2 END", "x": f"CASE WHEN {nu} > 0 THEN {nu} / ({nu} + {t} * {t}) END", "rest": f"CASE WHEN {nu} > 0 THEN {t} * {t} / ({nu} + {t} * {t}) END", "steps": f"cast(80 + 4 * sqrt(CASE WHEN {nu} > 0 THEN {nu} ELSE 1e0 END) as int)"}
    in_spark = ", ".join(f"'{k}', {v}" for k, v in bound.items())
    in_duck = ", ".join(f"'{k}': {v}" for k, v in bound.items())
    return form(
        f"transform(array(named_struct({in_spark})), v -> {text(_spark_fraction, _log_gamma)})[0]",
        f"list_transform([{{{in_duck}}}], lambda v: {text(_duck_fraction, lambda y: f'lgamma({y})')})[1]",
    )
