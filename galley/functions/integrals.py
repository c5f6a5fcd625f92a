"""Antiderivatives of quotients of polynomials, exactly: the rational part by a linear system, logarithms by resultants.

With the denominator's repeated factors set apart (Horowitz and Ostrogradsky) one system of linear equations gives the rational part
and a quotient over the square-free rest.  Its logarithms with fractions as factors are those of Rothstein and Trager; what is then
left over a polynomial of degree two has a logarithm and an arcus tangens, or two logarithms with a root.
"""
from __future__ import annotations

import math
from fractions import Fraction

from . import roots
from .calc import CalcError
from .roots import Dense, at, common_divisor, derivative, exact_quotient, remainder, trimmed


def plus(a: Dense, b: Dense, factor: Fraction = Fraction(1)) -> Dense:
    size = max(len(a), len(b))
    return trimmed([(a[i] if i < len(a) else 0) + factor * (b[i] if i < len(b) else 0) for i in range(size)])


def times(a: Dense, b: Dense) -> Dense:
    out = [Fraction(0)] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return trimmed(out)


def _solved(rows: list[Dense]) -> Dense:
    """The solution of as many equations as unknowns, one equation a row with its right side last."""
    n = len(rows)
    for k in range(n):
        pick = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pick] = rows[pick], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [r[-1] for r in rows]


def rational_part(n: Dense, d: Dense) -> tuple[Dense, Dense, Dense, Dense]:
    """(b, d1, c, d2) with n/d = (b/d1)' + c/d2, d2 square-free; n is of lower degree than d."""
    d1 = common_divisor(d, derivative(d))
    d2 = exact_quotient(d, d1)
    if len(d1) == 1:
        return [Fraction(0)], [Fraction(1)], n, d
    k, m = len(d1) - 1, len(d2) - 1
    inner = exact_quotient(times(derivative(d1), d2), d1)  # d1 divides it, as each factor of d1 is one of d2
    columns = []
    for i in range(k):
        power = [Fraction(0)] * i + [Fraction(1)]
        columns.append(plus(times(derivative(power), d2), times(power, inner), Fraction(-1)))
    columns += [times([Fraction(0)] * i + [Fraction(1)], d1) for i in range(m)]
    value = lambda p, i: p[i] if i < len(p) else Fraction(0)
    found = _solved([[*(value(c, i) for c in columns), value(n, i)] for i in range(k + m)])
    return trimmed(found[:k]), d1, trimmed(found[k:] or [Fraction(0)]), d2


def logarithms(c: Dense, d: Dense) -> tuple[list[tuple[Fraction, Dense]], Dense, Dense]:
    """([(factor, argument)], rest, below): the logarithms of c/d with fractions as factors, and the quotient that is left; d is square-free."""
    slope, found = derivative(d), []
    size = max(len(c), len(slope))
    value = lambda p, i: p[i] if i < len(p) else Fraction(0)
    above = [trimmed([value(c, i), -value(slope, i)]) for i in range(size)]
    while len(above) > 1 and not any(above[-1]):
        above.pop()
    if len(d) == 2:
        residues = [c[0] / d[1]]
    else:
        r = roots.resultant(above, [[x] for x in d])
        residues = [z for z in roots.real_roots(r) if z and not at(r, z)]
    left, below = c, d
    for z in residues:
        v = common_divisor(plus(c, slope, -z), d)
        if len(v) > 1:
            found.append((z, v))
    for z, v in found:
        left = plus(left, times(derivative(v), exact_quotient(d, v)), -z)
    for _, v in found:
        below = exact_quotient(below, v)
        left = exact_quotient(left, v) if len(left) >= len(v) else left
    return found, left, below


def _text(p: Dense, x: str) -> str:
    from . import algebra

    return algebra.text({(((x, i),) if i else ()): c for i, c in enumerate(p) if c})


def _term(factor: Fraction, what: str) -> str:
    sign = "-" if factor < 0 else "+"
    top, bottom = abs(factor.numerator), factor.denominator
    return f" {sign} " + (f"{top}*" if top != 1 else "") + what + (f"/{bottom}" if bottom != 1 else "")


def _root(v: Fraction) -> tuple[Fraction, int]:
    """(factor, k) with sqrt(v) = factor * sqrt(k), k a whole number without squares of small numbers."""
    whole, factor = v.numerator * v.denominator, Fraction(1, v.denominator)
    for p in range(2, 1000):
        while whole % (p * p) == 0:
            whole, factor = whole // (p * p), factor * p
    r = math.isqrt(whole)
    return (factor * r, 1) if r * r == whole else (factor, whole)


def _quadratic(left: Dense, below: Dense, x: str) -> list[str]:
    """Terms of the antiderivative over an irreducible polynomial of degree two."""
    lead = below[2]
    c, b = below[0] / lead, below[1] / lead
    q, p = (left[0] / lead), (left[1] / lead if len(left) > 1 else Fraction(0))
    out = [_term(p / 2, f"log({_text([c, b, Fraction(1)], x)})")] if p else []
    rest, d = q - p * b / 2, b * b - 4 * c
    if not rest:
        return out
    factor, k = _root(abs(d))
    line = _text([b / factor, 2 / factor], x)
    if d < 0:
        said = f"atan({line})" if k == 1 else f"atan(({line})/sqrt({k}))/sqrt({k})"
        return [*out, _term(2 * rest / factor, said)]
    return [*out, _term(rest / factor, f"log(({line} - sqrt({k}))/({line} + sqrt({k})))/sqrt({k})")]


def quadratics(d: Dense) -> list[Dense]:
    """The factors of a square-free polynomial, if all are of degree two with fractions as coefficients: pairs of its roots, tried exactly."""
    left, out = [c / d[-1] for c in d], []
    pairs = [(2 * z.real, abs(z) ** 2) for z in roots.complex_roots(d) if z.imag > 0]
    real = [float(r) for r in roots.real_roots(d)]
    pairs += [(r + s, r * s) for i, r in enumerate(real) for s in real[i + 1 :]]
    for total, product in pairs:
        tried = [Fraction(product).limit_denominator(10**6), -Fraction(total).limit_denominator(10**6), Fraction(1)]
        if len(left) >= 3 and not any(remainder(left, tried)):
            left = exact_quotient(left, tried)
            out.append(tried)
    if len(left) > 1:
        raise CalcError("unsupported: the integral of a quotient whose denominator doesn't factor")
    return out


def _share(left: Dense, below: Dense, q: Dense) -> Dense:
    """The numerator over q, one of the factors of ``below``, where left/below is a sum over these."""
    other = remainder(exact_quotient(below, q), q)
    value = lambda p, i: p[i] if i < len(p) else Fraction(0)
    moved, want = remainder(times([Fraction(0), Fraction(1)], other), q), remainder(left, q)
    return trimmed(_solved([[value(other, i), value(moved, i), value(want, i)] for i in (0, 1)]))


def antiderivative(n: Dense, d: Dense, x: str) -> str:
    """Of n/d in lowest terms, written out; the whole and the rational part first, then logarithms by their factors."""
    whole = exact_quotient(n, d) if len(n) >= len(d) else [Fraction(0)]
    b, d1, c, d2 = rational_part(remainder(n, d) if len(n) >= len(d) else n, d)
    terms: list[str] = []
    if any(whole):
        powers = [Fraction(0)] + [k / (i + 1) for i, k in enumerate(whole)]
        said = _text(powers, x)
        terms.append(f" - {said[1:]}" if said.startswith("-") else f" + {said}")
    if any(b):
        sign = "-" if b[-1] < 0 else "+"
        top, bottom = _text([abs(b[-1]) / b[-1] * c for c in b], x), _text(d1, x)
        terms.append(f" {sign} " + (f"({top})" if sum(map(bool, b)) > 1 or "/" in top else top) + (f"/{bottom}" if bottom.isidentifier() else f"/({bottom})"))
    if any(c):
        shared = common_divisor(c, d2)  # what the rational part has taken whole
        found, left, below = logarithms(exact_quotient(c, shared), exact_quotient(d2, shared))
        terms += [_term(z, f"log({_text(v, x)})") for z, v in sorted(found, key=lambda f: (-len(f[1]), f[0]))]
        if any(left):
            for q in sorted(quadratics(below)):
                share = _share(left, below, q)
                terms += _quadratic(share, q, x) if any(share) else []
    if not terms:
        return "0"
    first = terms[0]
    return ("-" if first.startswith(" - ") else "") + first[3:] + "".join(terms[1:])
