"""Angles, covariances and earth curvature as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A_M, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)


def wrap_bearing_deg(x: Column) -> Column:
    """[0, 360); a tiny negative angle does not become 360."""
    r = F.pmod(x, F.lit(360.0))
    return F.when(r >= 360.0, 0.0).otherwise(r)


def angle_difference_deg(a: Column, b: Column) -> Column:
    """a - b in (-180, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180.0, d - 360.0).otherwise(d)


def bearing_unit_en(b: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(b)), F.cos(F.radians(b))


def bearing_from_en(e: Column, n: Column) -> Column:
    return wrap_bearing_deg(F.degrees(F.atan2(e, n)))


def chi2_2dof(p: float) -> float:
    return -2 * math.log(1 - p)


def chi2_quantile(dof: Column, z: float) -> Column:
    """Wilson-Hilferty: z is 1.6449 for 95 %, 2.3263 for 99 %."""
    c = F.lit(2.0) / (9.0 * dof)
    return dof * F.pow(1 - c + z * F.sqrt(c), F.lit(3.0))


def rotate_covariance(ee: Column, en: Column, nn: Column, angle_deg: Column) -> tuple[Column, Column, Column]:
    """Covariance after all bearings grow by the angle."""
    s, c = F.sin(F.radians(angle_deg)), F.cos(F.radians(angle_deg))
    return c * c * ee + 2 * c * s * en + s * s * nn, -c * s * ee + (c * c - s * s) * en + c * s * nn, s * s * ee - 2 * c * s * en + c * c * nn


def covariance_to_ellipse(ee: Column, en: Column, nn: Column, scale: float) -> tuple[Column, Column, Column]:
    """Semi-axes and orientation [0, 180) from north, clockwise."""
    half, mean = (ee - nn) / 2, (ee + nn) / 2
    r = F.sqrt(half * half + en * en)
    angle = F.pmod(F.degrees(F.atan2(2 * en, nn - ee) / 2), F.lit(180.0))
    return scale * F.sqrt(mean + r), scale * F.sqrt(F.greatest(mean - r, F.lit(0.0))), F.when(angle >= 180.0, 0.0).otherwise(angle)


def ellipse_to_covariance(major: Column, minor: Column, orientation: Column, scale: float) -> tuple[Column, Column, Column]:
    s, c = F.sin(F.radians(orientation)), F.cos(F.radians(orientation))
    a, b = (major / scale) * (major / scale), (minor / scale) * (minor / scale)
    return a * s * s + b * c * c, (a - b) * s * c, a * c * c + b * s * s


def mahalanobis2(de: Column, dn: Column, ee: Column, en: Column, nn: Column) -> Column:
    det = ee * nn - en * en
    return (nn * de * de - 2 * en * de * dn + ee * dn * dn) / F.nullif(det, F.lit(0.0))


def earth_radius_m(lat: Column, azimuth: Column) -> Column:
    """Euler's radius of curvature in a direction."""
    s2 = F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    w = F.sqrt(1 - E2 * s2)
    prime, meridian = A_M / w, A_M * (1 - E2) / (w * w * w)
    ca, sa = F.cos(F.radians(azimuth)), F.sin(F.radians(azimuth))
    return 1 / (ca * ca / meridian + sa * sa / prime)


def height_from_elevation(sensor_alt: Column, ground: Column, elevation: Column, radius: Column) -> Column:
    return sensor_alt + ground * F.tan(F.radians(elevation)) + ground * ground / (2 * radius)


def bearing_normal_en(b: Column) -> tuple[Column, Column]:
    """The unit vector to the right of a bearing."""
    return F.cos(F.radians(b)), -F.sin(F.radians(b))


def chi2_2dof_scale(p: float) -> float:
    """Semi-axes of a region of probability ``p``, in standard deviations."""
    return math.sqrt(chi2_2dof(p))


#: A published rational form of the normal distribution function (highest power first).
PHI_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
PHI_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PHI_FAR = 7.07106781186547


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function to about 1e-15, without leaving the JVM."""
    x = F.abs(z)

    def polynomial(c: tuple[float, ...]) -> Column:
        value = F.lit(c[0])
        for one in c[1:]:
            value = value * x + one
        return value

    bell = F.exp(-x * x / 2)
    fraction = x + 0.65
    for i in (4.0, 3.0, 2.0, 1.0):
        fraction = x + i / fraction
    tail = F.when(x < PHI_FAR, bell * polynomial(PHI_ABOVE) / polynomial(PHI_BELOW)).otherwise(bell / fraction / math.sqrt(2 * math.pi))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def log_normal(d: Column, var: Column) -> Column:
    return -0.5 * (d * d / var + F.log(2 * math.pi * var))


def log_normal2(de: Column, dn: Column, ee: Column, en: Column, nn: Column) -> Column:
    """Log density of a normal distribution in the plane."""
    return -0.5 * (mahalanobis2(de, dn, ee, en, nn) + F.log(4 * math.pi**2 * (ee * nn - en * en)))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(-math.inf))


def logsumexp(*terms: Column) -> Column:
    """Log of the sum of exponentials; minus infinity where all terms are."""
    top = F.greatest(*terms)
    return F.when(top == -math.inf, top).otherwise(top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0))))


def _ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = A_M / F.sqrt(1 - E2 * s * s)
    return (n + alt) * c * F.cos(F.radians(lon)), (n + alt) * c * F.sin(F.radians(lon)), (n * (1 - E2) + alt) * s


def exact_elevation_deg(lat1: Column, lon1: Column, alt1: Column, lat2: Column, lon2: Column, alt2: Column) -> Column:
    """Elevation of the straight line from the first point to the second above the first's horizon."""
    (x1, y1, z1), (x2, y2, z2) = _ecef(lat1, lon1, alt1), _ecef(lat2, lon2, alt2)
    dx, dy, dz = x2 - x1, y2 - y1, z2 - z1
    up = dx * F.cos(F.radians(lat1)) * F.cos(F.radians(lon1)) + dy * F.cos(F.radians(lat1)) * F.sin(F.radians(lon1)) + dz * F.sin(F.radians(lat1))
    return F.degrees(F.asin(up / F.sqrt(dx * dx + dy * dy + dz * dz)))


def length_in_disc(px: Column, py: Column, radius: Column, ax: Column, ay: Column, ux: Column, uy: Column, length: Column) -> Column:
    """How much of the segment from a along the unit vector u lies in a disc."""
    rx, ry = ax - px, ay - py
    along = ux * rx + uy * ry
    disc = along * along - (rx * rx + ry * ry - radius * radius)
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(disc > 0, F.greatest(F.lit(0.0), F.least(root - along, length) - F.greatest(-along - root, F.lit(0.0)))).otherwise(0.0)


def gaussian_line_integral(px: Column, py: Column, ee: Column, en: Column, nn: Column, ax: Column, ay: Column, ux: Column, uy: Column, length: Column) -> Column:
    """Integral of a normal density around p along the segment from a: a difference of normal distribution functions."""
    det = ee * nn - en * en
    rx, ry = px - ax, py - ay
    quad = lambda x1, y1, x2, y2: (nn * x1 * x2 - en * (x1 * y2 + y1 * x2) + ee * y1 * y2) / det
    alpha, beta, gamma = quad(ux, uy, ux, uy), quad(ux, uy, rx, ry), quad(rx, ry, rx, ry)
    at = beta / alpha
    left = F.greatest(gamma - beta * at, F.lit(0.0))
    scale = F.exp(-0.5 * left) / (2 * math.pi * F.sqrt(det)) * F.sqrt(2 * math.pi / alpha)
    return scale * (normal_cdf(F.sqrt(alpha) * (length - at)) - normal_cdf(-F.sqrt(alpha) * at))


def range_likelihood(x: Column, sigma: Column, low: Column, high: Column, soft: Column) -> Column:
    """Density of a measurement with an error under a range with soft edges; a range without width is a normal density."""
    s = F.sqrt(soft * soft + sigma * sigma)
    z = (x - low) / s
    wide = F.greatest(normal_cdf((high - x) / s) - normal_cdf((low - x) / s), F.lit(1e-12)) / F.nullif(high - low, F.lit(0.0))
    return F.when(high - low <= 1e-12, F.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi))).otherwise(wide)


def log_scale(value: Column, sigma: Column) -> tuple[Column, Column]:
    """Decimal logarithm of a scale feature, and its error."""
    v = F.greatest(value, F.lit(1e-12))
    return F.log10(v), F.coalesce(sigma, F.lit(0.0)) / (v * math.log(10))


def four_digits(x: Column, digits: int = 4) -> Column:
    """A number to so many significant digits, without trailing zeros; for magnitudes from 1e-4 up to that many digits."""
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.abs(x))).cast("int"))
    text = F.format_string("%.3f", x)
    for n in (0, 1, 2, 4, 5, 6, 7):
        text = F.when(places == n, F.format_string(f"%.{n}f", x)).otherwise(text)
    return F.when(x == 0, "0").when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
