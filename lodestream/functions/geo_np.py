"""WGS84 geodesics and plane kernels, vectorised in numpy."""

from __future__ import annotations

import math

import numpy as np

A, F_ = 6378137.0, 1 / 298.257223563
B = A * (1 - F_)


def inverse(lat1, lon1, lat2, lon2):
    """Distance (m) and forward azimuth (degrees) by Vincenty's iteration."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    l = np.radians((np.asarray(lon2, float) - lon1 + 540) % 360 - 180)  # noqa: E741
    u1, u2 = np.arctan((1 - F_) * np.tan(p1)), np.arctan((1 - F_) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = l
    for _ in range(60):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_s = s1 * s2 + c1 * c2 * cl
        sig = np.arctan2(sin_s, cos_s)
        sin_a = np.where(sin_s == 0, 0, c1 * c2 * sl / np.where(sin_s == 0, 1, sin_s))
        cos2a = 1 - sin_a**2
        c2m = np.where(cos2a == 0, 0, cos_s - 2 * s1 * s2 / np.where(cos2a == 0, 1, cos2a))
        c = F_ / 16 * cos2a * (4 + F_ * (4 - 3 * cos2a))
        new = l + (1 - c) * F_ * sin_a * (sig + c * sin_s * (c2m + c * cos_s * (2 * c2m**2 - 1)))
        done = np.max(np.abs(new - lam)) < 1e-13
        lam = new
        if done:
            break
    k = cos2a * (A * A - B * B) / (B * B)
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    ds = small * sin_s * (c2m + small / 4 * (cos_s * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * sin_s**2 - 3) * (4 * c2m**2 - 3)))
    az = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))) % 360
    return B * big * (sig - ds), az


def direct(lat, lon, azimuth, distance):
    """Latitude and longitude at a distance along an azimuth."""
    a1, s = np.radians(azimuth), np.asarray(distance, float)
    u1 = np.arctan((1 - F_) * np.tan(np.radians(lat)))
    s1, c1, ca = np.sin(u1), np.cos(u1), np.cos(a1)
    sig1 = np.arctan2(np.tan(u1), ca)
    sin_a = c1 * np.sin(a1)
    cos2a = 1 - sin_a**2
    k = cos2a * (A * A - B * B) / (B * B)
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sig = s / (B * big)
    for _ in range(60):
        c2m, ss, cs = np.cos(2 * sig1 + sig), np.sin(sig), np.cos(sig)
        new = s / (B * big) + small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        done = np.max(np.abs(new - sig)) < 1e-13
        sig = new
        if done:
            break
    ss, cs, c2m = np.sin(sig), np.cos(sig), np.cos(2 * sig1 + sig)
    lat2 = np.arctan2(s1 * cs + c1 * ss * ca, (1 - F_) * np.hypot(sin_a, s1 * ss - c1 * cs * ca))
    lam = np.arctan2(ss * np.sin(a1), c1 * cs - s1 * ss * ca)
    c = F_ / 16 * cos2a * (4 + F_ * (4 - 3 * cos2a))
    l = lam - (1 - c) * F_ * sin_a * (sig + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))  # noqa: E741
    return np.degrees(lat2), (lon + np.degrees(l) + 540) % 360 - 180


def to_en(lat0, lon0, lat, lon):
    """East and north in the azimuthal-equidistant plane at an origin."""
    s, az = inverse(lat0, lon0, lat, lon)
    return s * np.sin(np.radians(az)), s * np.cos(np.radians(az))


def from_en(lat0, lon0, e, n):
    return direct(lat0, lon0, np.degrees(np.arctan2(e, n)) % 360, np.hypot(e, n))


def centroid(lat, lon):
    """Mean latitude and circular-mean longitude."""
    r = np.radians(lon)
    return float(np.mean(lat)), math.degrees(math.atan2(np.mean(np.sin(r)), np.mean(np.cos(r))))


def frame_bearing(lat0, lon0, lat, lon, azimuth, step=1000.0, at=None):
    """Bearing in the plane of a true azimuth at a point: the direction of a short step. ``at``: the point's east and north, if known."""
    lat2, lon2 = direct(lat, lon, azimuth, step)
    e1, n1 = to_en(lat0, lon0, lat, lon) if at is None else at
    e2, n2 = to_en(lat0, lon0, lat2, lon2)
    return np.degrees(np.arctan2(e2 - e1, n2 - n1)) % 360


_erf = np.frompyfunc(math.erf, 1, 1)


def earth_radius(lat, azimuth):
    """Euler's radius of curvature in a direction."""
    e2 = F_ * (2 - F_)
    w2 = 1 - e2 * np.sin(np.radians(lat)) ** 2
    c2 = np.cos(np.radians(azimuth)) ** 2
    return 1 / (c2 * w2**1.5 / (A * (1 - e2)) + (1 - c2) * np.sqrt(w2) / A)


def phi(x):
    """Standard normal distribution function."""
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)).astype(float))


def range_likelihood(x, sigma, low, high, soft):
    """Share of a soft-edged uniform range that a measurement with an error supports."""
    s = np.hypot(sigma, soft)
    return (phi((high - x) / s) - phi((low - x) / s)) / (high - low)
