"""Fixes from the bearings of a snapshot: weighted least squares, co-channel split, height, and what each bearing gave.

All groups of a batch are solved at once: rows are arrays, a group's sums are bin counts and
its 2 x 2 systems closed forms, so Python's work does not grow with the number of groups. The
co-channel split lists every assignment of every group as groups of its own and solves them
the same way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions import geo_np as G

#: Least crossing, greatest condition, rounds of weighing, least range; assignments of a split, and how much worse the next must be.
MIN_CROSSING_DEG, MAX_CONDITION, REWEIGHTS, MIN_RANGE_M = 10.0, 1e12, 3, 1.0
MOST_ASSIGNMENTS, AMBIGUOUS_CHI2 = 4096, 4.0
SCHEMA = (
    "group_id long, emitter int, reason string, basis string, lat double, lon double, ee double, en double, nn double, residual_deg double, crossing_deg double, n_bearings int, n_excluded int, "
    "t double, freq_hz double, bandwidth_hz double, height_m double, height_sigma_m double, height_basis string, n_heights int, "
    "bearings array<struct<observation_id: long, sensor: string, share: double, excluded: string>>"
)
#: What members may have besides what a fix needs; null where it is not given.
OPTIONAL = {"observation_id": "long", "t": "double", "freq_hz": "double", "bandwidth_hz": "double", "sensor_alt_m": "double", "elevation_deg": "double", "elevation_sigma_deg": "double", "elevation_basis": "string"}
EXCLUDED = "no sigma to weigh it by"
#: Least ground range and greatest elevation of a height.
MIN_GROUND_M, MAX_ELEVATION_DEG = 50.0, 85.0
_NUMBERS = ("lat", "lon", "ee", "en", "nn", "residual_deg", "crossing_deg")
#: Rows that are solved at once, but for single groups that are larger.
BATCH_ROWS = 1 << 17


def combine(bases: list[str]) -> str:
    if "unreported" in bases:
        return "unreported"
    return "mixed" if len(set(bases)) > 1 else bases[0]


def chi2_99(dof: np.ndarray | float) -> np.ndarray | float:
    return dof * (1 - 2 / (9 * dof) + 2.3263 * np.sqrt(2 / (9 * dof))) ** 3


def _sum(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, n)


def _sensors(of: np.ndarray, sensor: np.ndarray, n: int) -> np.ndarray:
    """How many different sensors each group has."""
    pairs = np.unique(np.stack([of, sensor]), axis=1)
    return np.bincount(pairs[0], minlength=n)


def _best_crossing(of: np.ndarray, theta: np.ndarray, n: int) -> np.ndarray:
    """The best crossing of each group's lines: of each line, that with the lines next to its right angle."""
    line = np.degrees(theta) % 180
    order = np.lexsort((line, of))
    line, group = line[order], of[order]
    count = np.bincount(group, minlength=n)
    first = np.cumsum(count) - count
    key = group * 1000.0 + line
    at = np.searchsorted(key, group * 1000.0 + (line + 90) % 180)
    best = np.zeros(n)
    for shift in (-1, 0):  # the lines on either side, round the half turn
        other = first[group] + (at + shift - first[group]) % count[group]
        apart = np.abs(line - line[other])
        np.maximum.at(best, group, np.minimum(apart, 180 - apart))
    return best


def fix_many(of: np.ndarray, lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, sigma: np.ndarray, sensor: np.ndarray, basis: np.ndarray, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """``fix_and_misses`` without the misses."""
    return fix_and_misses(of, lat, lon, bearing, sigma, sensor, basis, n)[:2]


def fix_and_misses(of: np.ndarray, lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, sigma: np.ndarray, sensor: np.ndarray, basis: np.ndarray, n: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Fixes of n groups, each row's share of the weight, and by how many degrees its bearing misses the fix (NaN: not used). ``of``: each row's group; ``sensor``: a number; ``basis``: its name. A reason stands where there is no fix."""
    out = {k: np.full(n, np.nan) for k in _NUMBERS}
    reason, misses = np.full(n, None, object), np.full(len(of), np.nan)
    known = ~np.isnan(sigma)
    weighted = _sensors(of[known], sensor[known], n) >= 2
    use = known | ~weighted[of]
    excluded = np.bincount(of, ~use, n).astype(int)
    reason[_sensors(of[use], sensor[use], n) < 2] = "too_few_sensors"
    alive = np.equal(reason, None)
    rows = np.flatnonzero(use & alive[of])
    g, la, lo, b, s, names = of[rows], lat[rows], lon[rows], bearing[rows], sigma[rows], basis[rows]
    count = np.maximum(np.bincount(g, minlength=n), 1)
    lat0 = _sum(g, la, n) / count
    lon0 = np.degrees(np.arctan2(_sum(g, np.sin(np.radians(lo)), n), _sum(g, np.cos(np.radians(lo)), n)))
    if len(rows):
        e, north = G.to_en(lat0[g], lon0[g], la, lo)
        theta = np.radians(G.frame_bearing(lat0[g], lon0[g], la, lo, b, at=(e, north)))
    else:
        e = north = theta = np.empty(0)
    out["crossing_deg"] = np.where(alive, _best_crossing(g, theta, n), np.nan)
    reason[alive & (out["crossing_deg"] < MIN_CROSSING_DEG)] = "poor_geometry"
    ne, nn = np.cos(theta), -np.sin(theta)
    offset, weight, p = ne * e + nn * north, np.ones(len(g)), np.zeros((2, n))
    for turn in range(REWEIGHTS + 1):
        if turn:
            reach = np.maximum(np.hypot(p[0][g] - e, p[1][g] - north), MIN_RANGE_M)
            weight = np.where(weighted[g], 1 / (reach * np.radians(np.where(weighted[g], s, 1.0))) ** 2, 1.0)
        a, c, d = (_sum(g, weight * x, n) for x in (ne * ne, ne * nn, nn * nn))
        x, y = _sum(g, weight * ne * offset, n), _sum(g, weight * nn * offset, n)
        half, spread = (a + d) / 2, np.hypot((a - d) / 2, c)
        with np.errstate(divide="ignore", invalid="ignore"):
            ill = (half + spread) / (half - spread)
            reason[np.equal(reason, None) & ~((ill > 0) & (ill <= MAX_CONDITION))] = "ill_conditioned"
            det = a * d - c * c
            p = np.nan_to_num(np.stack([(d * x - c * y) / det, (a * y - c * x) / det]))
    ahead = (p[0][g] - e) * np.sin(theta) + (p[1][g] - north) * np.cos(theta)
    reason[np.equal(reason, None) & (_sum(g, ahead < 0, n) > 0)] = "behind_sensor"
    ok = np.flatnonzero(np.equal(reason, None))
    kind = np.full(n, None, object)
    unreported, measured = _sum(g, names == "unreported", n) > 0, _sum(g, names == "measured", n) > 0
    mixed = measured & (_sum(g, names == "assumed", n) > 0)
    if len(ok):
        out["lat"][ok], out["lon"][ok] = G.from_en(lat0[ok], lon0[ok], p[0][ok], p[1][ok])
        kind[ok] = np.select([unreported[ok], mixed[ok], measured[ok]], ["unreported", "mixed", "measured"], "assumed")
        r = ok[weighted[ok] & ~unreported[ok]]
        if len(r):
            ee, en, vv = d[r] / det[r], -c[r] / det[r], a[r] / det[r]
            turn = -np.radians(G.frame_bearing(lat0[r], lon0[r], out["lat"][r], out["lon"][r], np.zeros(len(r))))
            si, co = np.sin(turn), np.cos(turn)
            out["ee"][r], out["nn"][r] = co * co * ee + 2 * co * si * en + si * si * vv, si * si * ee - 2 * co * si * en + co * co * vv
            out["en"][r] = -co * si * ee + (co * co - si * si) * en + co * si * vv
        mine = np.isin(g, ok)
        _, az = G.inverse(la[mine], lo[mine], out["lat"][g[mine]], out["lon"][g[mine]])
        off = (az - b[mine] + 180) % 360 - 180
        out["residual_deg"][ok] = np.sqrt(_sum(g[mine], off * off, n) / count)[ok]
        misses[rows[mine]] = off
    share = np.full(len(of), np.nan)
    with np.errstate(invalid="ignore"):
        share[rows] = weight / _sum(g, weight, n)[g]
    return out | {"reason": reason, "basis": kind, "n_excluded": excluded}, share, misses


def fix(lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, sigma: np.ndarray, sensor: np.ndarray, basis: list[str]) -> dict:
    """A position, its covariance where the bearings have one, or the reason why there is none."""
    found, _ = fix_many(np.zeros(len(lat), int), lat, lon, bearing, sigma, np.unique(sensor, return_inverse=True)[1].ravel(), np.array(basis, object), 1)
    return {k: v[0] for k, v in found.items() if not (isinstance(v[0], float) and math.isnan(v[0]))}


def _assignments(by_sensor: list[np.ndarray], k: int) -> Iterator[list[np.ndarray]]:
    """Every way to deal the sensors' bearings to k emitters of at least two bearings each."""
    first = max(range(len(by_sensor)), key=lambda i: len(by_sensor[i]))
    choices = [[tuple(range(k))] if i == first else list(itertools.permutations(range(k), len(r))) for i, r in enumerate(by_sensor)]
    for assignment in itertools.product(*choices):
        groups: list[list[int]] = [[] for _ in range(k)]
        for r, places in zip(by_sensor, assignment, strict=True):
            for row, place in zip(r, places, strict=True):
                groups[place].append(row)
        if all(len(x) >= 2 for x in groups):
            yield [np.array(x) for x in groups]


def locate_many(of: np.ndarray, lat: np.ndarray, lon: np.ndarray, bearing: np.ndarray, sigma: np.ndarray, sensor: np.ndarray, basis: np.ndarray, n: int) -> list[list[dict]]:
    """For each group one fix, or one for each emitter where a sensor has several bearings of one channel; each with its rows and their shares of the weight."""
    order = np.lexsort((sensor, of))
    of, lat, lon, bearing, sigma, sensor, basis = (x[order] for x in (of, lat, lon, bearing, sigma, sensor, basis))
    key = np.stack([of, sensor])
    again = np.concatenate(([False], (key[:, 1:] == key[:, :-1]).all(0))) if len(of) else np.empty(0, bool)
    several = np.bincount(of, again, n) > 0
    take = lambda found, i: {k: v[i] for k, v in found.items()}
    starts = np.searchsorted(of, np.arange(n + 1))
    result: list[list[dict]] = [[] for _ in range(n)]
    if not several.all():
        plain = ~several[of]
        got, shares = fix_many(of[plain], lat[plain], lon[plain], bearing[plain], sigma[plain], sensor[plain], basis[plain], n)
        inside = np.searchsorted(of[plain], np.arange(n + 1))
        for i in np.flatnonzero(~several):
            result[i] = [take(got, i) | {"rows": order[starts[i] : starts[i + 1]], "share": shares[inside[i] : inside[i + 1]]}]
    ways, parts = [], []  # (group, k, degrees of freedom), and the rows of each emitter of each way
    for i in np.flatnonzero(several):
        rows = np.arange(starts[i], starts[i + 1])
        rows = rows[~np.isnan(sigma[rows])]
        by_sensor = [rows[sensor[rows] == s] for s in np.unique(sensor[rows])]
        k = max(map(len, by_sensor), default=0)
        dof = len(rows) - 2 * k
        count = math.prod(math.perm(k, len(r)) for r in by_sensor) // math.factorial(k) if k else 0
        result[i] = [{"reason": "ambiguous"}]
        if k >= 2 and dof > 0 and count <= MOST_ASSIGNMENTS:
            result[i] = [{"reason": "inconsistent"}]
            for way in _assignments(by_sensor, k):
                ways.append((i, k, dof))
                parts += way
    if not ways:
        return result
    rows = np.concatenate(parts)
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    found, shares, misses = fix_and_misses(part, lat[rows], lon[rows], bearing[rows], sigma[rows], sensor[rows], basis[rows], len(parts))
    edges = np.searchsorted(part, np.arange(len(parts) + 1))
    good = np.equal(found["reason"], None)
    chi2 = np.full(len(parts), np.inf)
    mine = good[part]
    if mine.any():
        off = misses[mine] / sigma[rows[mine]]
        chi2[good] = np.bincount(part[mine], off * off, len(parts))[good]
    at = 0
    scored: dict[int, list[tuple[float, int]]] = {}
    for i, k, _ in ways:
        total = float(chi2[at : at + k].sum())
        if math.isfinite(total):
            scored.setdefault(i, []).append((total, at))
        at += k
    facts = {i: (k, dof) for i, k, dof in ways}
    for i, list_ in scored.items():
        list_.sort()
        k, dof = facts[i]
        if list_[0][0] > chi2_99(dof):
            continue
        close = len(list_) > 1 and list_[1][0] - list_[0][0] < AMBIGUOUS_CHI2
        chosen = [] if close else range(list_[0][1], list_[0][1] + k)
        result[i] = [take(found, j) | {"rows": order[rows[edges[j] : edges[j + 1]]], "share": shares[edges[j] : edges[j + 1]]} for j in chosen] or [{"reason": "ambiguous"}]
    return result


def locate(lat, lon, bearing, sigma, sensor, basis) -> list[dict]:
    """The fixes of one group."""
    code = np.unique(sensor, return_inverse=True)[1].ravel()
    made = locate_many(np.zeros(len(lat), int), lat, lon, bearing, sigma, code, np.array(basis, object), 1)[0]
    return [{k: v for k, v in f.items() if k not in ("rows", "share") and not (isinstance(v, float) and math.isnan(v))} for f in made]


def heights(of: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt: np.ndarray, elevation: np.ndarray, sigma: np.ndarray, basis: np.ndarray, fix: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A height for each fix from the elevations of its bearings: errors of angles average out, those of the range do not.

    ``of``: each row's fix; ``basis``: of the elevation, None where there is no statement of its
    uncertainty. Without a region, or without any sigma, there is a height but no sigma of it.
    """
    n = len(fix["lat"])
    ground, azimuth = G.inverse(lat, lon, fix["lat"][of], fix["lon"][of]) if len(of) else (np.empty(0), np.empty(0))
    stated = np.not_equal(basis, None)
    with np.errstate(invalid="ignore"):
        use = np.flatnonzero(stated & (np.abs(elevation) <= MAX_ELEVATION_DEG) & ~np.isnan(alt) & (ground >= MIN_GROUND_M))
    of, ground, azimuth, alt, sigma, basis = of[use], ground[use], azimuth[use], alt[use], sigma[use], basis[use]
    tan, radius = np.tan(np.radians(elevation[use])), G.earth_radius(lat[use], azimuth)
    one = alt + ground * tan + ground**2 / (2 * radius)
    known = ~np.isnan(sigma)
    some, all_ = np.bincount(of, known, n), np.bincount(of, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        by_angle = (ground * (1 + tan**2) * np.radians(sigma)) ** 2
        w = np.where(known, 1 / by_angle, np.where(some[of] > 0, 0.0, 1.0))
        e, north = np.sin(np.radians(azimuth)), np.cos(np.radians(azimuth))
        along = e * e * fix["ee"][of] + 2 * e * north * fix["en"][of] + north * north * fix["nn"][of]
        by_range = np.abs(tan + ground / radius) * np.sqrt(np.maximum(along, 0.0))
        total = np.bincount(of, w, n)
        height = np.bincount(of, w * one, n) / total
        spread = np.sqrt(1 / total + (np.bincount(of, w * np.where(w > 0, by_range, 0.0), n) / total) ** 2)
    whole = (some > 0) & ~np.isnan(fix["ee"])
    kinds = {k: np.bincount(of, known & np.equal(basis, k), n) + np.equal(fix["basis"], k) > 0 for k in ("unreported", "measured", "assumed", "mixed")}
    kind = np.select([kinds["unreported"], kinds["mixed"] | kinds["measured"] & kinds["assumed"], kinds["measured"]], ["unreported", "mixed", "measured"], "assumed").astype(object)
    kind[~whole] = "unreported"
    kind[all_ == 0] = None
    return {"height_m": np.where(all_ > 0, height, np.nan), "height_sigma_m": np.where(whole, spread, np.nan), "height_basis": kind, "n_heights": np.where(some > 0, some, all_).astype(int)}


def _records(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole fix records of all groups of a frame."""
    ids, of = np.unique(pdf["group_id"].to_numpy(), return_inverse=True)
    number = lambda c: pdf[c].to_numpy(float)
    columns = [number(c) for c in ("lat", "lon", "bearing_deg", "sigma_deg")]
    names = pdf["sensor"].to_numpy(str)
    made = locate_many(of.ravel(), *columns, np.unique(names, return_inverse=True)[1].ravel(), pdf["basis"].to_numpy(object), len(ids))
    size = np.bincount(of.ravel(), minlength=len(ids))
    found = [(g, i, f) for g, each in enumerate(made) for i, f in enumerate(each)]
    fix = {c: np.array([f.get(c, np.nan) if f["reason"] is None or c == "crossing_deg" else np.nan for _, _, f in found]) for c in _NUMBERS}
    fix["basis"] = np.array([f.get("basis") for _, _, f in found], object)
    held = [f["rows"] if f["reason"] is None else np.empty(0, int) for _, _, f in found]
    share = np.concatenate([np.empty(0), *(f["share"] for _, _, f in found if f["reason"] is None)])
    rows, part = np.concatenate([np.empty(0, int), *held]), np.repeat(np.arange(len(found)), [len(x) for x in held])
    used = ~np.isnan(share)
    stated = pdf["elevation_basis"].astype(object).where(pdf["elevation_basis"].notna(), None).to_numpy(object)
    solved = rows[used]
    up = heights(part[used], columns[0][solved], columns[1][solved], *(number(c)[solved] for c in ("sensor_alt_m", "elevation_deg", "elevation_sigma_deg")), stated[solved], fix)
    count = np.bincount(part, minlength=len(found))
    cuts = np.cumsum(count)[:-1]
    whole = np.full((3, len(found)), np.nan)
    filled = np.flatnonzero(count)
    if len(rows):
        first = (np.cumsum(count) - count)[filled]
        whole[0, filled] = np.maximum.reduceat(number("t")[rows], first)
        whole[1, filled] = np.add.reduceat(number("freq_hz")[rows], first) / count[filled]
        whole[2, filled] = np.maximum.reduceat(number("bandwidth_hz")[rows], first)
    observation = pdf["observation_id"].astype("Int64").astype(object).where(pdf["observation_id"].notna(), None).to_numpy(object)
    each = [{"observation_id": o, "sensor": n, "share": 0.0 if math.isnan(x) else x, "excluded": EXCLUDED if math.isnan(x) else None} for o, n, x in zip(observation[rows], names[rows], share, strict=True)]
    lists = [each[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True)]
    out = {
        "group_id": ids[[g for g, _, _ in found]],
        "emitter": [i for _, i, _ in found],
        "reason": [f["reason"] for _, _, f in found],
        **fix,
        "n_bearings": size[[g for g, _, _ in found]],
        "n_excluded": [int(f.get("n_excluded", 0)) for _, _, f in found],
        **dict(zip(("t", "freq_hz", "bandwidth_hz"), whole, strict=True)),
        **up,
        "bearings": lists,
    }
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")[:20]] + ["bearings"])


def fixes(members: DataFrame, by: str = "group_id") -> DataFrame:
    """Fix records of each group. ``members``: group_id, sensor, lat, lon, bearing_deg, sigma_deg (null: unreported), basis and any of ``OPTIONAL``; rows with one value of ``by`` go to one task.

    A record has its time, frequency and bandwidth from all bearings of the fix, also those
    excluded, each bearing with its share of the weight or why it has none, and a height where
    elevations give one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= BATCH_ROWS:
                rows = pd.concat(held)
                last = rows["group_id"] == rows["group_id"].iloc[-1]  # may go on in the next frame
                held = [rows[last]]
                if not last.all():
                    yield _records(rows[~last])
        if held and sum(map(len, held)):
            yield _records(pd.concat(held))

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = members.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in members.columns})
    made = full.repartition(parts, by).sortWithinPartitions("group_id", "sensor", "bearing_deg").mapInPandas(run, SCHEMA)
    return made.replace(float("nan"), None, [*_NUMBERS, "t", "freq_hz", "bandwidth_hz", "height_m", "height_sigma_m"])
