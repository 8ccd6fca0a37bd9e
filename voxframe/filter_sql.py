"""SQL of filters and splines over 4x4x4 volumes, written out from their formulas and independent of the kernels.

A linear filter of such a volume is a table of weights from its 64 voxels to each output; separable ones are products
of tables of one axis. The tables are computed in SQL, and one join with the voxels gives the response.
"""

from __future__ import annotations

#: One axis: every output, input and distance.
_GRID = "ax AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(4) a, range(4) b)"
_MIRROR = "CASE WHEN ((({0}) % 8) + 8) % 8 < 4 THEN ((({0}) % 8) + 8) % 8 ELSE 7 - ((({0}) % 8) + 8) % 8 END"


def axis_table(name: str, taps: str, boundary: str, by: str = "") -> str:
    """CTE `name`(by, i, j, w): out[i] = sum of w * in[j]. taps: a query of (by, o, w), by which out[i] += w * in[i + o]."""
    key = f"{by}, " if by else ""
    at = _MIRROR.format("i.range + o") if boundary == "mirror" else "i.range + o"
    inside = "" if boundary == "mirror" else " WHERE i.range + o BETWEEN 0 AND 3"
    return f"{name} AS (SELECT {key}CAST(i.range AS INT) AS i, CAST({at} AS INT) AS j, sum(w) AS w FROM ({taps}) t, range(4) i{inside} GROUP BY ALL)"


def apply_weights(source: str, weights: str, out: str, value: str = "v") -> str:
    """CTE `out`(volume_id, x, y, z, v) from weights(xi, yi, zi, xj, yj, zj, w)."""
    return f"{out} AS (SELECT volume_id, xi AS x, yi AS y, zi AS z, sum(w * {value}) AS v FROM {source} JOIN {weights} ON x = xj AND y = yj AND z = zj GROUP BY ALL)"


def product(name: str, terms: list[tuple[str, str, str]]) -> str:
    """CTE of the sum over terms of the product of three axis tables."""
    each = " UNION ALL ".join(f"SELECT a.i AS xi, b.i AS yi, c.i AS zi, a.j AS xj, b.j AS yj, c.j AS zj, a.w * b.w * c.w AS w FROM {x} a, {y} b, {z} c" for x, y, z in terms)
    return f"{name} AS (SELECT xi, yi, zi, xj, yj, zj, sum(w) AS w FROM ({each}) GROUP BY ALL)"


def result(source: str, digits: int = 6) -> str:
    return f"SELECT volume_id, x, y, z, round(v, {digits}) + 0.0 AS v FROM {source}"


def log_ctes(source: str, out: str, boundary: str, sigma: float = 1.0, reach: int = 4) -> list[str]:
    """Laplacian of Gaussian: second derivative along one axis, smooth along the others, summed over axes."""
    raw = f"SELECT CAST(range AS INT) AS o, exp(-(range * range) / (2.0 * {sigma} * {sigma})) AS g FROM range(-{reach}, {reach + 1})"
    g = f"SELECT o, g / (SELECT sum(g) FROM ({raw})) AS w FROM ({raw})"
    second = f"SELECT o, w * (o * o / ({sigma} ** 4) - 1 / ({sigma} ** 2)) AS w FROM ({g})"
    return [
        axis_table("smooth", g, boundary), axis_table("second", second, boundary),
        product("logw", [("second", "smooth", "smooth"), ("smooth", "second", "smooth"), ("smooth", "smooth", "second")]), apply_weights(source, "logw", out),
    ]


def _shift_weights(name: str, kernel: str) -> str:
    """Circular: the weight depends on the distance only."""
    return f"{name} AS (SELECT p.i AS xi, q.i AS yi, r.i AS zi, p.j AS xj, q.j AS yj, r.j AS zj, h AS w FROM ax p, ax q, ax r JOIN {kernel} ON dx = ((p.i - p.j) + 4) % 4 AND dy = ((q.i - q.j) + 4) % 4 AND dz = ((r.i - r.j) + 4) % 4)"


_D = "(SELECT CAST(a.range AS INT) AS dx, CAST(b.range AS INT) AS dy, CAST(c.range AS INT) AS dz FROM range(4) a, range(4) b, range(4) c) d"


def riesz_ctes(source: str, out: str, order: tuple[int, int, int] = (1, 0, 0)) -> list[str]:
    """Riesz transform of odd order by its multipliers; the half spectrum along z counts its inner plane twice."""
    total = sum(order)
    if total % 2 == 0:
        raise ValueError("written for odd orders")
    import math

    scale = math.sqrt(math.factorial(total) / math.prod(map(math.factorial, order))) * (1 if total % 4 == 1 else -1)
    full, half = "(VALUES (0, 0.0), (1, 0.25), (2, -0.5), (3, -0.25))", "(VALUES (0, 0.0, 1), (1, 0.25, 2), (2, 0.5, 1))"
    top = " * ".join(f"f{c} ** {k}" for c, k in zip("xyz", order, strict=True))
    norm = "sqrt(fx * fx + fy * fy + fz * fz)"
    return [
        f"rk AS (SELECT dx, dy, dz, sum(times * {scale!r} * {top} / {norm} ** {total} * sin(2 * pi() * (kx * dx + ky * dy + kz * dz) / 4)) / 64 AS h FROM {_D}, {full} u(kx, fx), {full} v(ky, fy), {half} w(kz, fz, times) WHERE {norm} > 0 GROUP BY ALL)",
        _shift_weights("rw", "rk"), apply_weights(source, "rw", out),
    ]


def simoncelli_ctes(source: str, out: str, level: int = 1) -> list[str]:
    """Isotropic band: cosine in octaves around the band's middle; radii from the centre of the shifted grid."""
    top = 2.0 ** -(level - 1)
    at = "(VALUES (0, 1.0 / 3), (1, 1.0), (2, -1.0), (3, -1.0 / 3))"
    r = "sqrt(gx * gx + gy * gy + gz * gz)"
    gain = f"CASE WHEN {r} BETWEEN {top / 4} AND {top} THEN cos(pi() / 2 * log2(2 * {r} / {top})) ELSE 0 END"
    return [
        f"sk AS (SELECT dx, dy, dz, sum({gain} * cos(2 * pi() * (kx * dx + ky * dy + kz * dz) / 4)) / 64 AS h FROM {_D}, {at} u(kx, gx), {at} v(ky, gy), {at} w(kz, gz) GROUP BY ALL)",
        _shift_weights("sw", "sk"), apply_weights(source, "sw", out),
    ]


_PERMS = "(VALUES (0, 1, 2, 1), (0, 2, 1, -1), (1, 0, 2, -1), (1, 2, 0, 1), (2, 0, 1, 1), (2, 1, 0, -1)) p(a, b, c, parity)"
_SIGNS = "(VALUES (1), (-1)) {0}({0})"
#: The 24 right-angle rotations: which band each axis takes, and whether it is turned round.
_TURNS = f"turns AS (SELECT a, b, c, s, t, u FROM {_PERMS}, {_SIGNS.format('s')}, {_SIGNS.format('t')}, {_SIGNS.format('u')} WHERE parity * s * t * u = 1)"


def laws_energy_sql(vox: str) -> str:
    """L5E5E5 in all rotations, the greatest response, and the mean of its modulus over 15 voxels each way; mirrored ends."""
    level = "SELECT * FROM (VALUES (-2, 1 / sqrt(70.0)), (-1, 4 / sqrt(70.0)), (0, 6 / sqrt(70.0)), (1, 4 / sqrt(70.0)), (2, 1 / sqrt(70.0))) t(o, w)"
    edge = "SELECT * FROM (VALUES (-2, 1 / sqrt(10.0)), (-1, 2 / sqrt(10.0)), (1, -2 / sqrt(10.0)), (2, -1 / sqrt(10.0))) t(o, w)"
    mean = "SELECT CAST(range AS INT) AS o, 1 / 15.0 AS w FROM range(-7, 8)"
    ctes = [vox, axis_table("lv", level, "mirror"), axis_table("ed", edge, "mirror"), axis_table("av", mean, "mirror")]
    for k, (x, y, z) in enumerate((("lv", "ed", "ed"), ("ed", "lv", "ed"), ("ed", "ed", "lv"))):
        ctes += [product(f"w{k}", [(x, y, z)]), apply_weights("vox", f"w{k}", f"r{k}")]
    # Turning an axis round turns the sign of E5 alone, so each response comes with both signs.
    ctes.append("top AS (SELECT volume_id, x, y, z, greatest(abs(a.v), abs(b.v), abs(c.v)) AS v FROM r0 a JOIN r1 b USING (volume_id, x, y, z) JOIN r2 c USING (volume_id, x, y, z))")
    ctes += [product("wm", [("av", "av", "av")]), apply_weights("top", "wm", "out")]
    return f"WITH {', '.join(ctes)} {result('out')}"


def wavelet_rotated_sql(vox: str, low: tuple[float, ...], bands: str = "LHL") -> str:
    """Second level of the undecimated transform, averaged over rotations; the first level passes low; mirrored ends."""
    n = len(low)
    taps = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(low))
    both = f"SELECT * FROM (SELECT 'L' AS band, k, w FROM (VALUES {taps}) t(k, w) UNION ALL SELECT 'H', {n - 1} - k, w * CASE WHEN ({n - 1} - k) % 2 = 0 THEN -1 ELSE 1 END FROM (VALUES {taps}) t(k, w))"
    turned = f"SELECT band, s, CASE WHEN s = 1 THEN k ELSE {n - 1} - k END AS k, w FROM ({both}), (VALUES (1), (-1)) q(s)"
    one = f"SELECT s, {n // 2} - k AS o, w FROM ({turned}) WHERE band = 'L'"
    # A turned kernel is spread after it is turned: taps at even places of 2 n.
    two = f"SELECT band, s, {n} - 2 * k AS o, w FROM ({turned})"
    kinds = "(VALUES " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(bands)) + ")"
    ctes = [
        vox, _TURNS, axis_table("first", one, "mirror", "s"), axis_table("next", two, "mirror", "band, s"),
        "m AS (SELECT band, n.s, n.i, f.j, sum(n.w * f.w) AS w FROM next n JOIN first f ON n.s = f.s AND n.j = f.i GROUP BY ALL)",
        f"ww AS (SELECT x.i AS xi, y.i AS yi, z.i AS zi, x.j AS xj, y.j AS yj, z.j AS zj, sum(x.w * y.w * z.w) / 24 AS w FROM turns JOIN {kinds} ka(n, kind) ON ka.n = a JOIN {kinds} kb(n, kind) ON kb.n = b JOIN {kinds} kc(n, kind) ON kc.n = c JOIN m x ON x.band = ka.kind AND x.s = turns.s JOIN m y ON y.band = kb.kind AND y.s = turns.t JOIN m z ON z.band = kc.kind AND z.s = turns.u GROUP BY ALL)",
        apply_weights("vox", "ww", "out"),
    ]
    return f"WITH {', '.join(ctes)} {result('out')}"


def gabor_sql(vox: str, sigma: float = 1.0, wave: float = 2.0, angles: int = 8) -> str:
    """Modulus of the complex response in each slice, averaged over angles and over the three planes; mirrored ends."""
    r = 6
    a, b = "(u * cos(t) + v * sin(t))", "(-u * sin(t) + v * cos(t))"
    kern = f"SELECT k, CAST(u AS INT) AS u, CAST(v AS INT) AS v, exp(-({a} ** 2 + {b} ** 2) / {2 * sigma**2}) * cos(2 * pi() * {a} / {wave}) AS re, exp(-({a} ** 2 + {b} ** 2) / {2 * sigma**2}) * sin(2 * pi() * {a} / {wave}) AS im FROM (SELECT range AS k, range * 2 * pi() / {angles} AS t FROM range({angles})), (SELECT range AS u FROM range(-{r}, {r + 1})), (SELECT range AS v FROM range(-{r}, {r + 1}))"
    ctes = [
        vox, f"kern AS ({kern})",
        f"gw AS (SELECT k, p.range AS pi, q.range AS qi, {_MIRROR.format('p.range - u')} AS pj, {_MIRROR.format('q.range - v')} AS qj, sum(re) AS re, sum(im) AS im FROM kern, range(4) p, range(4) q GROUP BY ALL)",
    ]
    for p, q, s in (("x", "y", "z"), ("x", "z", "y"), ("y", "z", "x")):
        ctes.append(f"g{p}{q} AS (SELECT volume_id, pi AS {p}, qi AS {q}, {s}, avg(size) AS size FROM (SELECT volume_id, k, pi, qi, {s}, sqrt(sum(re * v) ** 2 + sum(im * v) ** 2) AS size FROM vox JOIN gw ON {p} = pj AND {q} = qj GROUP BY ALL) GROUP BY ALL)")
    out = "out AS (SELECT volume_id, x, y, z, (gxy.size + gxz.size + gyz.size) / 3 AS v FROM gxy JOIN gxz USING (volume_id, x, y, z) JOIN gyz USING (volume_id, x, y, z))"
    return f"WITH {', '.join([*ctes, out])} SELECT volume_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, round(v, 6) + 0.0 AS v FROM out"


def cubic_ctes(source: str, out: str, ratio: float = 0.8, size: int = 5) -> list[str]:
    """Cubic B-spline on a grid of the same centre. Coefficients by the filter's inverse on the mirrored period of six."""
    inverse = "(SELECT CAST(d.range AS INT) AS d, sum(cos(2 * pi() * k.range * d.range / 6) / ((4 + 2 * cos(2 * pi() * k.range / 6)) / 6)) / 6 AS h FROM range(6) d, range(6) k GROUP BY ALL)"
    # Inside the mirrored signal 0 1 2 3 2 1, sample j stands at j and, but for the ends, at 6 - j.
    coef = f"co AS (SELECT i, j, sum(h) AS w FROM (SELECT i, j, j AS spot FROM ax UNION ALL SELECT i, j, 6 - j FROM ax WHERE j IN (1, 2)) JOIN {inverse} ON d = ((i - spot) + 12) % 6 GROUP BY ALL)"
    x = f"least(greatest({ratio} * o.range + (1.5 - {ratio} * {(size - 1) / 2}), 0.0), 3.0)"
    f = "(x - floor(x))"
    taps = f"(VALUES (-1), (0), (1), (2)) t(s)"
    basis = f"CASE s WHEN -1 THEN (1 - {f}) ** 3 / 6 WHEN 0 THEN (4 - 6 * {f} ** 2 + 3 * {f} ** 3) / 6 WHEN 1 THEN (1 + 3 * {f} + 3 * {f} ** 2 - 3 * {f} ** 3) / 6 ELSE {f} ** 3 / 6 END"
    fold = "abs(((CAST(floor(x) AS INT) + s + 3 + 6) % 6) - 3)"
    return [
        coef, f"sp AS (SELECT o, CAST({fold} AS INT) AS i, sum({basis}) AS w FROM (SELECT CAST(o.range AS INT) AS o, {x} AS x FROM range({size}) o), {taps} GROUP BY ALL)",
        "cw AS (SELECT sp.o AS i, co.j, sum(sp.w * co.w) AS w FROM sp JOIN co ON co.i = sp.i GROUP BY ALL)",
        product("c3", [("cw", "cw", "cw")]), apply_weights(source, "c3", out),
    ]


def grid() -> str:
    return _GRID
