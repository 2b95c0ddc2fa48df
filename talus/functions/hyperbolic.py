"""Hyperbolic geometry of the unit disc as column expressions; vectors are pairs of columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus.functions.geometry import clamp, dot, norm

#: Least norm, and the distance that points keep from the border.
MIN_NORM, BORDER = 1e-15, 1e-5


def artanh(x: Column) -> Column:
    return F.atanh(clamp(x, -1 + 1e-5, 1 - 1e-5))


def arcosh(x: Column) -> Column:
    return F.acosh(F.greatest(x, F.lit(1 + 1e-7)))


def arsinh(x: Column) -> Column:
    return F.asinh(x)


def tanh(x: Column) -> Column:
    return F.tanh(clamp(x, -15.0, 15.0))


def cosh(x: Column) -> Column:
    return F.cosh(clamp(x, -15.0, 15.0))


def sinh(x: Column) -> Column:
    return F.sinh(clamp(x, -15.0, 15.0))


def _at_least(x: Column) -> Column:
    return F.greatest(x, F.lit(MIN_NORM))


def conformal(x) -> Column:
    return F.lit(2.0) / _at_least(F.lit(1.0) - dot(x, x))


def inner(x, u, v=None) -> Column:
    scale = conformal(x)
    return scale * scale * dot(u, v if v is not None else u)


def riemannian(x, gradient):
    """Euclidean to Riemannian gradient."""
    scale = conformal(x)
    return [g / (scale * scale) for g in gradient]


def project(x, border: float = BORDER):
    """Points beyond the border are pulled back onto it."""
    n, most = norm(*x), 1 - border
    return [F.when(n > most, c / n * most).otherwise(c) for c in x]


def mobius_add(x, y):
    xy, xx, yy = dot(x, y), dot(x, x), dot(y, y)
    below = _at_least(F.lit(1.0) + 2 * xy + xx * yy)
    return [((F.lit(1.0) + 2 * xy + yy) * a + (F.lit(1.0) - xx) * b) / below for a, b in zip(x, y)]


def mobius_scale(t: float | Column, x):
    n = _at_least(norm(*x))
    k = tanh((t if isinstance(t, Column) else F.lit(float(t))) * artanh(n)) / n
    return [k * c for c in x]


def _divide(a, b):
    """Quotient of complex numbers given as pairs."""
    below = _at_least(b[0] * b[0] + b[1] * b[1])
    return [(a[0] * b[0] + a[1] * b[1]) / below, (a[1] * b[0] - a[0] * b[1]) / below]


def mobius(x, y):
    """(y - x) / (1 - conj(x) y): takes x to the origin."""
    return _divide([y[0] - x[0], y[1] - x[1]], [F.lit(1.0) - (x[0] * y[0] + x[1] * y[1]), -(x[0] * y[1] - x[1] * y[0])])


def mobius_inverse(x, y):
    """(y + x) / (1 + conj(x) y)."""
    return _divide([y[0] + x[0], y[1] + x[1]], [F.lit(1.0) + (x[0] * y[0] + x[1] * y[1]), x[0] * y[1] - x[1] * y[0]])


def gyration(u, v, w):
    uu, vv, uv, uw, vw = dot(u, u), dot(v, v), dot(u, v), dot(u, w), dot(v, w)
    a, b = -uw * vv + vw + 2 * uv * vw, -vw * uu - uw
    below = _at_least(F.lit(1.0) + 2 * uv + uu * vv)
    return [k + 2 * (a * p + b * q) / below for p, q, k in zip(u, v, w)]


def transport(x, y, u):
    """Parallel transport from x to y."""
    g, scale = gyration(y, [-c for c in x], u), conformal(x) / conformal(y)
    return [c * scale for c in g]


def exp_map(u, p):
    n = _at_least(norm(*u))
    k = tanh(conformal(p) * n / 2) / n
    return mobius_add(p, [k * c for c in u])


def to_origin(x) -> Column:
    """Distance to the origin."""
    return 2 * artanh(norm(*x))


def distance(x, y) -> Column:
    gap = [a - b for a, b in zip(x, y)]
    return arcosh(F.lit(1.0) + 2 * dot(gap, gap) / ((F.lit(1.0) - dot(x, x)) * (F.lit(1.0) - dot(y, y))))


def midpoint(x, y):
    m = mobius(x, y)
    n = _at_least(norm(*m))
    half = tanh(artanh(n) / 2) / n
    return mobius_inverse(x, [half * c for c in m])


def lca_depth(x, y) -> Column:
    """Least distance to the origin among both points and their geodesic midpoint."""
    return F.least(to_origin(x), to_origin(y), to_origin(midpoint(x, y)))


def reflect(centre, x):
    """Inversion of x in the circle about `centre` that is orthogonal to the disc's border."""
    r2 = dot(centre, centre) - 1.0
    u = [a - b for a, b in zip(x, centre)]
    k = r2 / _at_least(dot(u, u))
    return [k * a + b for a, b in zip(u, centre)]


def lca_point(a, b):
    """Projection of the origin onto the geodesic through a and b."""
    aa = _at_least(dot(a, a))
    centre = [c / aa for c in a]
    b_inv = reflect(centre, b)
    k = dot(a, b_inv) / _at_least(dot(b_inv, b_inv))
    mirrored = [2 * k * q - p for p, q in zip(a, b_inv)]
    o = reflect(centre, mirrored)
    half = F.lit(1.0) + F.sqrt(F.greatest(F.lit(1.0) - dot(o, o), F.lit(0.0)))
    return [c / half for c in o]


def rescale(x, scale: float, most: float = 1 - BORDER):
    """Points at one radius, between 1e-4 and `most`."""
    radius = min(max(scale, 1e-4), most)
    n = _at_least(norm(*x))
    return [c / n * F.lit(radius) for c in x]


def focal_loss(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-7) -> Column:
    """Binary focal loss of one prediction."""
    p = clamp(p, eps, 1 - eps)
    pt = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    weight = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return weight * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * -F.ln(pt)


def kl_gauss(m1, s1, m2, s2) -> Column:
    gap = m1 - m2
    return F.ln(s2 / s1) + (s1 * s1 + gap * gap) / (2 * s2 * s2) - 0.5


def kl_discrete(p: Column, q: Column) -> Column:
    """Aggregate: divergence of two discrete distributions, one row a value; values that `p` lacks add nothing."""
    return F.sum(F.when(p != 0, p * F.ln(p / q)).otherwise(F.lit(0.0)))
