"""Multi-model tracking of fixes: one ``State`` for the batch and the streaming form.

A fix goes to the nearest track of its channel inside the gate, or starts one. A track that
has stayed put for long enough is an anchor: it keeps a point of its own, takes only fixes
that agree with staying there, and new tracks beside it are on probation. One that comes
apart from its anchor is a split (or undoes a merge); one that does not is folded back; and
if the anchor has fallen silent meanwhile, the anchor itself has moved. Two tracks
that keep together in place and speed are merged. Silent tracks coast, then retire. Each
source's frequency and clock are compared with those of the source heard most often, and
what is learned corrects the frequencies that the gate sees.

What all tracks have is held in arrays, so that a fix meets all tracks of its island at
once: bounds of a few numbers a track tell which ones it may reach, and only those are taken
to its time. Time moves in ticks of ``TICK_S``; a tick sees the fixes up to ``LATENCY_S`` before it, so
rows do not depend on how the fixes are cut into batches. An island is cut where nothing
is heard for ``CUT_S``: by then every track has retired, numbers start anew and what was learned
of the sources is forgotten (``learned`` gives it to a later run).
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators import imm
from lodestream.operators.lineage import cut_lineage
from lodestream.operators.runs import cut, spread

#: Gates by their probabilities, then the tracker's times, counts and distances.
GATE, ANCHOR_GATE, MERGE_GATE = (-2 * math.log(1 - p) for p in (0.999, 0.99, 0.99))
CONFIRM_HITS, COAST_S, RETIRE_S, TENTATIVE_S = 3, 90.0, 600.0, 180.0
SPLIT_RADIUS_M, SPLIT_MARGIN_M, SPLIT_WINDOW_S = 5000.0, 500.0, 600.0
ANCHOR_HITS, ANCHOR_AGE_S, ANCHOR_WINDOW_S, ANCHOR_HEARD, ANCHOR_STATIONARY, FOLD_S = 5, 120.0, 180.0, 2, 0.6, 180.0
CHECK_S, MERGE_CONFIDENCE, PROBATION_S, RECENT_S = 10.0, 0.8, 300.0, 60.0
LATENCY_S, TOLERANCE_HZ, BIAS_SAMPLES, SAME_TRANSMISSION_S = 3.0, 2500.0, 10, 2.0
SHOW_S, ORPHAN_S = 10.0, 30.0
RECENT, TIMES, SAMPLES = 200, 50, 2000
#: Bounds that only leave out what is far away are wider by this, for rounding; tracks without bounds until they are made.
WIDER, UNBOUNDED = 1 + 1e-6, 8

TICK_S = 1.0
CUT_S = 690.0

TENTATIVE, CONFIRMED, COASTING = range(3)
STATES = ("tentative", "confirmed", "coasting")
#: Seconds of silence after which a state ends.
SILENCE = np.array([TENTATIVE_S, COAST_S, RETIRE_S])

FIX = ["t", "fix_id", "e", "n", "ee", "en", "nn", "freq_hz", "bandwidth_hz", "sources"]
SCHEMA = (
    "island long, run long, track long, t double, fix_id long, kind string, state string, e double, n double, speed double, p_stationary double, hits int, "
    "other long, stayed long, anchor boolean, anchor_e double, anchor_n double, anchor_ee double, anchor_en double, anchor_nn double, source string, reference string, offset_hz double, offset_s double"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def same_channel(freq: np.ndarray | float, bandwidth: np.ndarray | float, freqs: np.ndarray, bandwidths: np.ndarray) -> np.ndarray:
    return np.abs(freqs - freq) <= np.maximum(TOLERANCE_HZ, (bandwidths + bandwidth) / 4)


def chi2_95(dof: int) -> float:
    """95 % quantile by Wilson and Hilferty."""
    a = 2 / (9 * dof)
    return dof * (1 - a + 1.6449 * math.sqrt(a)) ** 3


def one_point(z: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The point that all fixes together say, its covariance, and how badly they agree (chi-square)."""
    inverse = np.linalg.inv(r)
    cov = np.linalg.inv(inverse.sum(0))
    point = cov @ (inverse @ z[..., None])[..., 0].sum(0)
    return point, cov, float(imm.quadratic(z - point, r).sum())


class Samples:
    """The last samples of a source, also in order, for their median."""

    def __init__(self) -> None:
        self.last: deque = deque()
        self.ordered: list[float] = []

    def __len__(self) -> int:
        return len(self.last)

    def __getitem__(self, i: int) -> float:
        return self.last[i]

    def append(self, value: float) -> None:
        if len(self.last) == SAMPLES:
            del self.ordered[bisect.bisect_left(self.ordered, self.last.popleft())]
        self.last.append(value)
        bisect.insort(self.ordered, value)

    def median(self) -> float:
        half, odd = divmod(len(self.ordered), 2)
        return float(self.ordered[half] if odd else (self.ordered[half - 1] + self.ordered[half]) / 2)


def overlapping(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of intervals that meet."""
    order = np.argsort(low, kind="stable")
    upto = np.searchsorted(low[order], high[order], "right")
    count = np.maximum(upto - np.arange(len(order)) - 1, 0)
    first = np.repeat(np.arange(len(order)), count)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    one, other = order[first], order[second]
    return np.minimum(one, other), np.maximum(one, other)


@dataclass
class Held:
    """What only one track at a time is asked for."""

    parent: int | None = None
    apart: float = 0.0
    split: bool = False
    merged_at: float = -math.inf
    recent: deque = field(default_factory=lambda: deque(maxlen=RECENT))
    times: deque = field(default_factory=lambda: deque(maxlen=TIMES))
    freqs: dict[str, tuple[float, int]] = field(default_factory=dict)
    heard: dict[str, float] = field(default_factory=dict)


def _empty() -> dict[str, np.ndarray]:
    shapes = {"anchor_m": (2,), "anchor_c": (2, 2), "mu": (5,), "x": (5, 4), "p": (5, 4, 4), "middle": (2,), "limit": (2,)}
    numbers = {"number": np.int64, "hits": np.int64, "freq_n": np.int64, "state": np.int64, "probation": bool, "anchor": bool, "bounded": bool}
    names = ("number", "hits", "freq_n", "state", "probation", "anchor", "bounded", "wide", "born", "t", "heard", "updated", "shown", "freq", "bandwidth", "anchor_t", *shapes)
    return {n: np.zeros((0, *shapes.get(n, ())), numbers.get(n, np.float64)) for n in names}


@dataclass
class State:
    """All tracks of one island since its last long silence."""

    run: int = 0
    standard: str | None = None  # the reference source, if the whole input says which
    last: float = -math.inf
    made: int = 0
    c: dict[str, np.ndarray] = field(default_factory=_empty)
    held: list[Held] = field(default_factory=list)
    streak: dict[tuple[int, int], int] = field(default_factory=dict)
    orphans: list[tuple[float, int]] = field(default_factory=list)
    now: float = -math.inf  # the next tick
    check: float = -math.inf
    counts: dict[str, int] = field(default_factory=dict)
    hz: dict[tuple, Samples] = field(default_factory=dict)
    clock: dict[tuple, deque] = field(default_factory=dict)
    soon: float = -math.inf  # no tick before it is due
    horizon: float = -math.inf  # up to when the bounds of tracks hold
    queue: list[tuple] = field(default_factory=list)  # (track, t, z, r, row): what anchors took and their filters did not yet

    def row(self, i: int | None, kind: str, t: float, fix_id: int | None = None, **more) -> dict:
        if i is not None and self.queue:
            self.settle(int(self.c["number"][i]))
        out = self._row(i, kind, t, fix_id, **more)
        return out if i is None else out | self._filtered(self.c["mu"][i], self.c["x"][i])

    @staticmethod
    def _filtered(mu: np.ndarray, x: np.ndarray) -> dict:
        mean = mu @ x
        return {"e": mean[0], "n": mean[1], "speed": math.hypot(mean[2], mean[3]), "p_stationary": float(mu[0])}

    def _row(self, i: int | None, kind: str, t: float, fix_id: int | None = None, **more) -> dict:
        """All of a row but what the filter says."""
        out = {"run": self.run, "t": t, "fix_id": fix_id, "kind": kind, **more}
        if i is None:
            return out
        c = self.c
        out |= {"track": int(c["number"][i]), "state": STATES[c["state"][i]], "hits": int(c["hits"][i]), "anchor": bool(c["anchor"][i])}
        if out["anchor"]:
            m, a = c["anchor_m"][i], c["anchor_c"][i]
            out |= {"anchor_e": m[0], "anchor_n": m[1], "anchor_ee": a[0, 0], "anchor_en": a[0, 1], "anchor_nn": a[1, 1]}
        return out

    def settle(self, number: int | None = None) -> None:
        """Take what is queued into the filters, all tracks at once: if that of a track is needed, or in any case."""
        if not self.queue or number is not None and all(q[0] != number for q in self.queue):
            return
        turns: dict[int, int] = {}
        rounds: list[list[tuple]] = []
        for item in self.queue:
            turn = turns[item[0]] = turns.get(item[0], -1) + 1
            if turn == len(rounds):
                rounds.append([])
            rounds[turn].append(item)
        self.queue = []
        c = self.c
        for items in rounds:
            rows = c["number"].searchsorted([q[0] for q in items])
            t, z, r = (np.array([q[k] for q in items]) for k in (1, 2, 3))
            c["mu"][rows], c["x"][rows], c["p"][rows] = mu, x, _ = imm.updated_many(*imm.predicted(c["mu"][rows], c["x"][rows], c["p"][rows], t - c["t"][rows]), z, r)
            c["t"][rows] = np.maximum(c["t"][rows], t)
            for k, item in enumerate(items):
                item[4].update(self._filtered(mu[k], x[k]))

    def parted(self) -> tuple[dict[int, tuple], dict]:
        """Each track by its number, and all else."""
        self.settle()
        items = {int(n): ({k: v[i] for k, v in self.c.items()}, self.held[i]) for i, n in enumerate(self.c["number"])}
        return items, {k: v for k, v in self.__dict__.items() if k not in ("c", "held")}

    @classmethod
    def joined(cls, items: dict[int, tuple], rest: dict) -> State:
        out = cls(**rest)
        order = [items[n] for n in sorted(items)]
        if order:
            out.c = {k: np.stack([c[k] for c, _ in order]) for k in order[0][0]}
            out.held = [held for _, held in order]
        return out

    def index(self, number: int | None) -> int | None:
        numbers = self.c["number"]  # they rise
        at = int(numbers.searchsorted(number)) if number is not None else len(numbers)
        return at if at < len(numbers) and numbers[at] == number else None

    def drop(self, i: int) -> None:
        self.soon = -math.inf
        if self.queue:
            self.settle(int(self.c["number"][i]))
        self.c = {k: np.delete(v, i, axis=0) for k, v in self.c.items()}
        del self.held[i]

    def place(self, i: int) -> np.ndarray:
        return self.c["anchor_m"][i] if self.c["anchor"][i] else (self.c["mu"][i] @ self.c["x"][i])[:2]

    def filters(self, rows: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.c
        return imm.predicted(c["mu"][rows], c["x"][rows], c["p"][rows], t - c["t"][rows])

    # what is learned of the sources

    def reference(self) -> str | None:
        return self.standard or (max(self.counts, key=self.counts.get) if self.counts else None)

    def corrected(self, freq: float, sources: list[str], learned: dict[str, float]) -> float:
        """The frequency less the mean bias of the fix's sources."""
        if not sources:
            return freq
        reference, total = self.reference(), 0.0
        for s in sources:
            if s != reference:
                own = self.hz.get((s, reference), ())
                total += own.median() if len(own) >= BIAS_SAMPLES else learned.get(s, 0.0)
        return freq - total / len(sources)

    def _compare(self, i: int, t: float, freq: float, sources: list[str], out: list[dict]) -> None:
        """Differences of a fix to what the track's other sources gave; the reference's readings are the standard."""
        held, reference, own = self.held[i], self.reference(), dict.fromkeys(sources)

        def sample(source: str, hz: float | None, s: float | None) -> None:
            if hz is not None:
                self.hz.setdefault((source, reference), Samples()).append(hz)
            if s is not None:
                self.clock.setdefault((source, reference), deque(maxlen=SAMPLES)).append(s)
            out.append(self.row(None, "offset", t, track=int(self.c["number"][i]), source=source, reference=reference, offset_hz=hz, offset_s=s))

        close = lambda a: a is not None and abs(t - a) <= SAME_TRANSMISSION_S
        before = held.heard.get(reference)
        for s in own:
            hz = freq - held.freqs[reference][0] if reference in held.freqs else None
            if s != reference and (hz is not None or close(before)):
                sample(s, hz, t - before if close(before) else None)
        if reference in own:
            for s, at in held.heard.items():
                if s != reference and s not in own and close(at):
                    sample(s, None, at - t)
        for s in own:
            mean, n = held.freqs.get(s, (0.0, 0))
            held.freqs[s] = ((mean * n + freq) / (n + 1), n + 1)
            held.heard[s] = t

    # fixes

    def take(self, fix: tuple, learned: dict[str, float], out: list[dict]) -> None:
        """One fix (as ``FIX``), after the ticks that come before it."""
        t, fix_id, e, n, ee, en, nn, raw, bandwidth, sources = fix
        sources = list(sources) if sources is not None else []
        if t - self.last > CUT_S:
            self.__init__(math.floor(t), self.standard)
        self.last = max(self.last, t)
        self.advance(t + LATENCY_S, out)
        z, located = np.array([e, n]), not any(v is None or math.isnan(v) for v in (ee, en, nn))
        r = np.array([[ee, en], [en, nn]]) if located else np.zeros((2, 2))
        freq = self.corrected(raw, sources, learned)
        i, ahead = self._nearest(t, z, r, freq, bandwidth)
        if not located:
            if i is not None:
                self.c["heard"][i] = max(self.c["heard"][i], t)
            else:
                self.orphans.append((t, fix_id))
                self.soon = min(self.soon, t + ORPHAN_S)
            out.append(self.row(i, "orphan" if i is None else "support", t, fix_id))
            return
        for s in sources:
            self.counts[s] = self.counts.get(s, 0) + 1
        if i is None:
            self._birth(t, z, r, freq, raw, bandwidth, sources, fix_id, out)
            return
        c = self.c
        if not (later := bool(c["anchor"][i])):  # an anchor takes fixes by its own point: what its filter says is not asked for until there is a row or a check of it
            c["mu"][i], c["x"][i], c["p"][i] = imm.updated(*ahead, z, r)
            c["t"][i] = max(c["t"][i], t)
        c["bounded"][i] = False
        self._absorb(i, t, z, r, freq, raw, bandwidth, sources, out)
        if c["state"][i] == COASTING or c["state"][i] == TENTATIVE and c["hits"][i] >= CONFIRM_HITS:
            c["state"][i] = CONFIRMED
        self.soon = min(self.soon, float(c["heard"][i]) + COAST_S)
        number = int(c["number"][i])
        if later:
            out.append(self._row(i, "fix", t, fix_id))
            self.queue.append((number, t, z, r, out[-1]))
        else:
            out.append(self.row(i, "fix", t, fix_id))
        self._apart(self.index(number), t, out)

    def _bound(self, t: float) -> None:
        """Where fixes up to the horizon can be that a track may take: a middle, and on each axis the greatest square of the distance, which grows by ``wide`` times a fix's variance.

        Bounds of some time hold for all tracks, those that changed since have none until there are several.
        """
        c = self.c
        if t > self.horizon:
            self.horizon, c["bounded"][:] = t + imm.HORIZON_S, False
        new = np.flatnonzero(~c["bounded"])
        if len(new) <= UNBOUNDED and len(new) < len(c["bounded"]):
            return
        c["bounded"][new] = True
        anchor = c["anchor"][new]
        fixed, free = new[anchor], new[~anchor]
        if fixed.size:
            grown = np.maximum(self.horizon - c["anchor_t"][fixed], 0.0) * imm.Q_STATIONARY
            c["middle"][fixed], c["wide"][fixed] = c["anchor_m"][fixed], WIDER * ANCHOR_GATE
            c["limit"][fixed] = WIDER * ANCHOR_GATE * (c["anchor_c"][fixed][:, [0, 1], [0, 1]] + grown[:, None])
        if free.size:
            c["middle"][free], moment = imm.moments(c["mu"][free], c["x"][free], c["p"][free], self.horizon - c["t"][free])
            c["limit"][free], c["wide"][free] = WIDER * (1 + GATE) * moment, WIDER * (1 + GATE)

    def _nearest(self, t: float, z: np.ndarray, r: np.ndarray, freq: float, bandwidth: float) -> tuple[int | None, tuple | None]:
        """The track that takes a fix, and its filter at the fix's time if that was needed to tell."""
        self._bound(t)
        c = self.c
        near = same_channel(freq, bandwidth, c["freq"], c["bandwidth"])
        if t >= self.horizon - imm.HORIZON_S:  # not for a late one
            far = (z - c["middle"]) ** 2 > c["limit"] + c["wide"][:, None] * r[[0, 1], [0, 1]]
            near &= ~((far[:, 0] | far[:, 1]) & c["bounded"])
        near = np.flatnonzero(near)
        found, least, ahead = None, GATE, None
        anchor = c["anchor"][near]
        if (fixed := near[anchor]).size:
            grown = np.maximum(t - c["anchor_t"][fixed], 0.0)[:, None, None] * np.eye(2) * imm.Q_STATIONARY
            value = imm.quadratic(z - c["anchor_m"][fixed], c["anchor_c"][fixed] + grown + r)
            value = np.where(value <= ANCHOR_GATE, value, math.inf)
            if value.min() <= least:
                found, least = int(fixed[value.argmin()]), float(value.min())
        if (free := near[~anchor]).size:
            mu, x, p = self.filters(free, t)
            mean, cov = imm.combined(mu, x, p)
            value = imm.quadratic(z - mean[:, :2], cov[:, :2, :2] + r)
            at, best = int(value.argmin()), float(value.min())
            if best < least or best == least and (found is None or free[at] < found):
                found, ahead = int(free[at]), (mu[at], x[at], p[at])
        return found, ahead

    def _absorb(self, i: int, t: float, z: np.ndarray, r: np.ndarray, freq: float, raw: float, bandwidth: float, sources: list[str], out: list[dict]) -> None:
        c, held = self.c, self.held[i]
        c["hits"][i] += 1
        c["freq_n"][i] += 1
        c["freq"][i] += (freq - c["freq"][i]) / c["freq_n"][i]
        c["bandwidth"][i] = max(c["bandwidth"][i], bandwidth)
        c["updated"][i], c["heard"][i] = max(c["updated"][i], t), max(c["heard"][i], t)
        held.recent.append((t, z, r))
        held.times.append(t)
        if c["anchor"][i]:
            prior = c["anchor_c"][i] + np.eye(2) * imm.Q_STATIONARY * max(t - c["anchor_t"][i], 0.0)
            gain = prior @ np.linalg.inv(prior + r)
            c["anchor_m"][i] += gain @ (z - c["anchor_m"][i])
            c["anchor_c"][i] = (np.eye(2) - gain) @ prior
            c["anchor_t"][i] = max(c["anchor_t"][i], t)
        self._compare(i, t, raw, sources, out)
        if not c["anchor"][i] and c["hits"][i] >= ANCHOR_HITS and c["mu"][i, 0] >= ANCHOR_STATIONARY:
            self._latch(i)

    def _latch(self, i: int) -> None:
        """Make it an anchor if its last fixes agree with one point."""
        latest = self.held[i].recent[-1][0]
        last = [x for x in self.held[i].recent if latest - x[0] <= ANCHOR_WINDOW_S]
        if len(last) < ANCHOR_HITS or last[-1][0] - last[0][0] < ANCHOR_AGE_S:
            return
        point, cov, chi2 = one_point(np.array([x[1] for x in last]), np.array([x[2] for x in last]))
        if chi2 <= chi2_95(2 * (len(last) - 1)):
            c = self.c
            c["anchor"][i], c["anchor_m"][i], c["anchor_c"][i], c["anchor_t"][i] = True, point, cov, latest

    def _birth(self, t: float, z: np.ndarray, r: np.ndarray, freq: float, raw: float, bandwidth: float, sources: list[str], fix_id: int, out: list[dict]) -> None:
        self.made += 1
        mu, x, p = imm.born(z, r)
        values = {"number": self.made, "born": t, "t": t, "heard": -math.inf, "updated": -math.inf, "freq": freq, "bandwidth": bandwidth, "mu": mu, "x": x, "p": p}
        self.c = {k: np.concatenate((v, np.asarray(values.get(k, np.zeros(v.shape[1:])), v.dtype)[None])) for k, v in self.c.items()}
        self.held.append(Held())
        i, c = len(self.held) - 1, self.c
        self._absorb(i, t, z, r, freq, raw, bandwidth, sources, out)
        older = np.flatnonzero(~c["probation"][:i] & same_channel(freq, bandwidth, c["freq"][:i], c["bandwidth"][:i]) & (t - c["heard"][:i] <= SPLIT_WINDOW_S))
        about = np.where(c["anchor"][older, None], c["anchor_m"][older], np.einsum("km,kmd->kd", c["mu"][older], c["x"][older][:, :, :2]))
        older = older[np.hypot(*(about - z).T) <= SPLIT_RADIUS_M * WIDER + 1]
        away = [float(np.hypot(*(self.place(j) - z))) for j in older]
        near = [(not c["anchor"][j], d, j) for j, d in zip(older.tolist(), away, strict=True) if d <= SPLIT_RADIUS_M]
        if near:  # an anchor first: it is what others depart from
            _, self.held[i].apart, j = min(near)
            self.held[i].parent = int(c["number"][j])
            c["probation"][i] = c["anchor"][j]
        self.soon = min(self.soon, t + COAST_S)
        out.append(self.row(i, "candidate" if c["probation"][i] else "created", t, fix_id, other=self.held[i].parent))

    # tracks beside tracks

    def _apart(self, i: int, t: float, out: list[dict]) -> None:
        """Whether a track has come away from the one that it appeared beside."""
        c, child = self.c, self.held[i]
        if child.parent is None or child.split:
            return
        j = self.index(child.parent)
        if j is None or t - c["born"][i] > SPLIT_WINDOW_S:
            child.parent, self.soon = None, -math.inf
            return
        if c["hits"][i] < CONFIRM_HITS or float(np.hypot(*(self.place(j) - self.place(i)))) - child.apart < SPLIT_MARGIN_M:
            return
        parent, number = self.held[j], int(c["number"][i])
        if c["probation"][i]:
            if sum(at > c["born"][i] for at in parent.times) < ANCHOR_HEARD:
                self._relocate(i, j, t, out)
                return
            c["probation"][i] = False
            out.append(self.row(i, "created", float(c["born"][i]), other=child.parent))
        undone = c["born"][i] - parent.merged_at <= PROBATION_S
        self.settle()
        stays = j if c["anchor"][j] or c["mu"][j, 0] >= c["mu"][i, 0] else i
        child.parent, child.split = None, True
        out.append(self.row(j, "unmerged" if undone else "split", t, other=number, stayed=int(c["number"][stays])))

    def _relocate(self, i: int, j: int, t: float, out: list[dict]) -> None:
        """Nothing stayed behind, so the anchor is what moved: it goes on from where its candidate is."""
        self.settle()
        c = self.c
        for name in ("mu", "x", "p", "t"):
            c[name][j] = c[name][i]
        c["anchor"][j] = c["bounded"][j] = False
        c["updated"][j] = max(c["updated"][j], c["updated"][i])
        out.append(self.row(j, "relocated", t, other=int(c["number"][i])))
        self._fold(i, j, t, out)

    def _fold(self, i: int, j: int, t: float, out: list[dict]) -> None:
        """What a candidate has heard goes to its parent."""
        c = self.c
        c["hits"][j] += c["hits"][i]
        c["heard"][j] = max(c["heard"][j], c["heard"][i])
        out.append(self.row(i, "folded", t, other=int(c["number"][j])))
        self.drop(i)

    # ticks

    def _due(self) -> float:
        """The first tick at which silence or age changes a track, a coasting one is shown again, or an orphan expires."""
        c = self.c
        gone = min((t for t, _ in self.orphans), default=math.inf) + ORPHAN_S
        gone = max(self.now, (math.floor(gone / TICK_S) + 1) * TICK_S) if self.orphans else math.inf
        if not len(self.held):
            return gone
        limit = c["heard"] + np.where(c["probation"], TENTATIVE_S, SILENCE[c["state"]])
        limit = np.where(c["probation"], np.minimum(limit, c["born"] + FOLD_S), limit)
        alone = [i for i in np.flatnonzero(c["probation"]) if self.index(self.held[i].parent) is None]
        limit[alone] = -math.inf
        coasts = ~c["probation"] & (c["state"] == COASTING)
        again = math.ceil((float(c["shown"][coasts].min()) + SHOW_S) / TICK_S) * TICK_S if coasts.any() else math.inf
        first = float(limit.min())
        first = (math.floor(first / TICK_S) + 1) * TICK_S if math.isfinite(first) else self.now
        return max(self.now, min(first, again, gone))

    def _live(self, now: float) -> np.ndarray:
        return np.flatnonzero(~self.c["probation"] & (now - self.c["updated"] <= RECENT_S))

    def advance(self, to: float, out: list[dict]) -> None:
        """All ticks before ``to``."""
        while len(self.held) or self.orphans:
            check = max(self.check, math.ceil(self.now / CHECK_S) * CHECK_S)
            if check < to and len(self._live(check)) < 2:
                self.streak, check = {}, math.inf
            if min(self.soon, check) >= to:
                break
            self.soon = self._due()
            tick = min(self.soon, check)
            if tick >= to:
                break
            self.soon = -math.inf
            self._age(tick, out)
            if tick == check:
                self._merge(tick, out)
                self.check = tick + CHECK_S
            self.now = tick + TICK_S
        if math.isfinite(to):
            self.now = max(self.now, math.ceil(to / TICK_S) * TICK_S)

    def _age(self, now: float, out: list[dict]) -> None:
        c = self.c
        turn = c["probation"] | (now - c["heard"] > SILENCE[c["state"]]) | (c["state"] == COASTING) & (now - c["shown"] >= SHOW_S)
        for number in c["number"][turn].tolist():
            i = self.index(number)
            c, silent = self.c, now - self.c["heard"][i]
            if c["probation"][i]:
                j = self.index(self.held[i].parent)
                if j is None:
                    c["probation"][i] = False
                    out.append(self.row(i, "created", float(c["born"][i]), other=self.held[i].parent))
                elif now - c["born"][i] > FOLD_S or silent > TENTATIVE_S:
                    self._fold(i, j, now, out)
            elif silent > SILENCE[c["state"][i]]:
                if c["state"][i] == CONFIRMED:
                    c["state"][i], c["shown"][i] = COASTING, now
                    out.append(self.row(i, "coasting", now) | self._ahead(i, now))
                else:
                    out.append(self.row(i, "retired", now))
                    self.drop(i)
            elif c["state"][i] == COASTING and now - c["shown"][i] >= SHOW_S:
                c["shown"][i] = now
                out.append(self.row(i, "predicted", now) | self._ahead(i, now))
        expired = [x for x in self.orphans if now - x[0] > ORPHAN_S]
        if expired:
            self.orphans = [x for x in self.orphans if not now - x[0] > ORPHAN_S]
        for orphan in expired:
            out.append(self.row(None, "expired", now, orphan[1]))

    def _ahead(self, i: int, now: float) -> dict:
        """Where a silent track is by now."""
        self.settle(int(self.c["number"][i]))
        mean = imm.combined(*self.filters(np.array([i]), now))[0][0]
        return {"e": mean[0], "n": mean[1], "speed": math.hypot(mean[2], mean[3])}

    def _merge(self, now: float, out: list[dict]) -> None:
        """Count how long pairs have kept together; the first that has for long enough becomes one, and the rest wait for the next check."""
        self.settle()
        c, live = self.c, self._live(now)
        mu, x, p = self.filters(live, now)
        mean, cov = imm.combined(mu, x, p)
        half = [np.sqrt(WIDER * MERGE_GATE * cov[:, k, k]) + 1e-6 for k in (0, 1)]  # gates of sums are no wider than sums of gates
        a, b = overlapping(mean[:, 0] - half[0], mean[:, 0] + half[0])
        beside = np.abs(mean[a, 1] - mean[b, 1]) <= half[1][a] + half[1][b]
        a, b = a[beside], b[beside]
        alike = same_channel(c["freq"][live[a]], c["bandwidth"][live[a]], c["freq"][live[b]], c["bandwidth"][live[b]])
        a, b = a[alike], b[alike]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        d, s = mean[a] - mean[b], cov[a] + cov[b]
        together = np.flatnonzero((imm.quadratic(d[:, :2], s[:, :2, :2]) <= MERGE_GATE) & (imm.quadratic(d[:, 2:], s[:, 2:, 2:]) <= MERGE_GATE))
        before, self.streak = self.streak, {}
        for one, other in zip(a[together].tolist(), b[together].tolist(), strict=True):
            i, j = int(live[one]), int(live[other])
            key = (int(c["number"][i]), int(c["number"][j]))
            self.streak[key] = n = before.get(key, 0) + 1
            if n / (n + 2) >= MERGE_CONFIDENCE:
                del self.streak[key]
                self.streak |= {k: m for k, m in before.items() if k > key}
                c["mu"][i], c["x"][i], c["p"][i] = imm.updated(mu[one], x[one], p[one], mean[other, :2], cov[other, :2, :2])
                c["t"][i] = max(c["t"][i], now)
                c["bounded"][i] = False
                c["hits"][i] += c["hits"][j]
                for name in ("heard", "updated"):
                    c[name][i] = max(c[name][i], c[name][j])
                if c["hits"][i] >= CONFIRM_HITS:
                    c["state"][i] = CONFIRMED
                self.held[i].merged_at = now
                out.append(self.row(j, "merged", now, other=key[0]))
                self.drop(j)
                return

    def due(self) -> float:
        """When something will happen if nothing is heard until then."""
        check = max(self.check, math.ceil(self.now / CHECK_S) * CHECK_S) if len(self.held) > 1 else math.inf
        return min(self._due(), check if math.isfinite(check) and len(self._live(check)) > 1 else math.inf)

    def finish(self, now: float, out: list[dict]) -> None:
        """The end of the input: what never came away from its anchor was the anchor's."""
        self.advance(now, out)
        for number in self.c["number"][self.c["probation"]].tolist():
            i = self.index(number)
            if (j := self.index(self.held[i].parent)) is not None:
                self._fold(i, j, now, out)
        self.settle()


def frame(key: int, rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["island"] = key
    kinds = {"run": "int64", "island": "int64"} | dict.fromkeys(("track", "fix_id", "hits", "other", "stayed"), "Int64") | {"anchor": "boolean"}
    text = ("kind", "state", "source", "reference")
    return out.astype(kinds | dict.fromkeys(text, object) | {c: "float64" for c in COLUMNS if c not in kinds and c not in text})


def fix_rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Fixes by time and id."""
    yield from sorted(pdf[FIX].itertuples(index=False, name=None), key=lambda f: f[:2])


def tracks(fixes: DataFrame, learned: dict[str, float] | None = None, split: bool = True) -> DataFrame:
    """Rows of what happens to tracks. ``fixes``: island and the columns ``FIX``; ee, en, nn null for a fix without a region.

    An island's key is cut at silences unless ``split`` is false; the rows are the same.
    ``learned``: each source's frequency bias from an earlier run, used until a run has its own. The source
    with the most fixes is the reference of all islands.
    """
    end = fixes.agg(F.max("t")).first()[0]
    heard = fixes.where("ee IS NOT NULL").select(F.explode("sources").alias("source")).groupBy("source").count().orderBy(F.desc("count"), "source").first()
    bias, standard = learned or {}, heard["source"] if heard else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = State(standard=standard), []
        for fix in fix_rows(pdf):
            if fix[0] - state.last > CUT_S:
                state.finish(math.inf, out)
            state.take(fix, bias, out)
        state.finish(end + LATENCY_S + TICK_S if end - state.last <= CUT_S else math.inf, out)
        return frame(int(pdf["island"].iloc[0]), out)

    source = fixes.select("island", *FIX).dropna(subset=["island", "t", "fix_id", "e", "n", "freq_hz", "bandwidth_hz"])
    keys = ["island", "__run"] if split else ["island"]
    return spread(cut(source, "t", CUT_S, "__run", ["island"]) if split else source, *keys).groupBy(*keys).applyInPandas(lambda pdf: run(pdf), SCHEMA)


def nuisance(rows: DataFrame) -> DataFrame:
    """Each source's frequency bias and clock offset against its reference, with their errors, from the ``offset`` rows of ``tracks``.

    Medians by mergeable sketches, so a source's samples are not gathered; the median's error
    is 1.2533 / sqrt(n) times 1.4826 of the median distance from it.
    """
    samples = cut_lineage(rows.where("kind = 'offset'").select("source", "reference", "offset_hz", "offset_s"))
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    centre = samples.groupBy("source", "reference").agg(middle("offset_hz").alias("freq_bias_hz"), middle("offset_s").alias("clock_offset_s"))
    away = samples.join(F.broadcast(centre), ["source", "reference"])  # a row a source and reference
    error = lambda c, m: 1.2533 * 1.4826 * middle(F.abs(F.col(c) - F.col(m))) / F.sqrt(F.count(c))
    return away.groupBy("source", "reference", "freq_bias_hz", "clock_offset_s").agg(
        error("offset_hz", "freq_bias_hz").alias("freq_sigma_hz"), F.count("offset_hz").alias("freq_n"), error("offset_s", "clock_offset_s").alias("clock_sigma_s"), F.count("offset_s").alias("clock_n")
    )
