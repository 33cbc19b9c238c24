"""The tracker's rules once more, one track and one second at a time, as what the array form is held against."""

import math

import numpy as np

from lodestream.operators import imm

GATE, ANCHOR_GATE, MERGE_GATE = (-2 * math.log(1 - p) for p in (0.999, 0.99, 0.99))


class Modes:
    """Five Kalman filters, mode by mode."""

    def __init__(self, z, r):
        self.mu = np.maximum(imm.START, 1e-6) / np.maximum(imm.START, 1e-6).sum()
        self.x = [np.array([*z, 0.0, 0.0]) for _ in range(5)]
        self.p = [np.block([[r, np.zeros((2, 2))], [np.zeros((2, 2)), np.eye(2) * imm.SPEED_SIGMA**2]]) for _ in range(5)]

    def at(self, dt):
        dt, out = max(dt, 0.0), object.__new__(Modes)
        joint = self.mu[:, None] * imm.switching(dt)
        joint = joint / joint.sum()
        out.mu, out.x, out.p = joint.sum(0), [], []
        for j in range(5):
            w = joint[:, j] / out.mu[j]
            mean = sum(w[i] * self.x[i] for i in range(5))
            cov = sum(w[i] * (self.p[i] + np.outer(self.x[i] - mean, self.x[i] - mean)) for i in range(5))
            f, q = (a[0, j] for a in imm.motions(np.array([dt])))
            out.x.append(f @ mean)
            out.p.append(f @ cov @ f.T + q)
        return out

    def whole(self):
        mean = sum(m * x for m, x in zip(self.mu, self.x, strict=True))
        return mean, sum(m * (p + np.outer(x - mean, x - mean)) for m, x, p in zip(self.mu, self.x, self.p, strict=True))

    def measure(self, z, r):
        h, logs = np.eye(2, 4), []
        for j in range(5):
            s = h @ self.p[j] @ h.T + r
            d = z - h @ self.x[j]
            k = self.p[j] @ h.T @ np.linalg.inv(s)
            logs.append(math.log(max(self.mu[j], 1e-300)) - 0.5 * (d @ np.linalg.inv(s) @ d + math.log(np.linalg.det(s))))
            self.x[j] = self.x[j] + k @ d
            self.p[j] = (np.eye(4) - k @ h) @ self.p[j] @ (np.eye(4) - k @ h).T + k @ r @ k.T
        w = np.exp(np.array(logs) - max(logs))
        self.mu = w / w.sum()


def d2(d, c):
    return float(d @ np.linalg.inv(c) @ d)


def alike(f1, b1, f2, b2):
    return abs(f1 - f2) <= max(2500.0, (b1 + b2) / 4)


class Brute:
    def __init__(self, reference):
        self.reference, self.all, self.made, self.streak, self.hz, self.log, self.held_by = reference, {}, 0, {}, {}, [], {}

    def place(self, k):
        return k["am"] if k["anchor"] else k["f"].whole()[0][:2]

    def fix(self, t, fix_id, e, n, ee, en, nn, raw, bw, sources):
        z, r = np.array([e, n]), np.array([[ee, en], [en, nn]])
        shift = [np.median(self.hz[s][-2000:]) if s != self.reference and len(self.hz.get(s, [])) >= 10 else 0.0 for s in sources]
        freq, best = raw - sum(shift) / len(sources), None
        for k in self.all.values():
            if not alike(freq, bw, k["freq"], k["bw"]):
                continue
            if k["anchor"]:
                d = d2(z - k["am"], k["ac"] + np.eye(2) * imm.Q_STATIONARY * max(t - k["at"], 0) + r)
                if d > ANCHOR_GATE:
                    continue
            else:
                m, c = k["f"].at(t - k["t"]).whole()
                d = d2(z - m[:2], c[:2, :2] + r)
            if d <= GATE and (best is None or d < best[0]):
                best = (d, k)
        if best is None:
            self.made += 1
            k = dict(id=self.made, born=t, t=t, f=Modes(z, r), freq=freq, fn=0, bw=bw, hits=0, state="tentative", heard=-math.inf, upd=-math.inf, recent=[], times=[], anchor=False, parent=None, apart=0.0, prob=False, split=False, merged=-math.inf, sf={}, lh={})
            self.absorb(k, t, z, r, freq, raw, bw, sources)
            near = []
            for o in self.all.values():
                away = math.dist(self.place(o), z)
                if not o["prob"] and alike(freq, bw, o["freq"], o["bw"]) and t - o["heard"] <= 600 and away <= 5000:
                    near.append((not o["anchor"], away, o["id"]))
            if near:
                _, k["apart"], k["parent"] = min(near)
                k["prob"] = self.all[k["parent"]]["anchor"]
            self.all[k["id"]] = k
            self.log.append((t, "candidate" if k["prob"] else "created", k["id"], k["parent"]))
            self.held_by[fix_id] = k["id"]
            return
        k = best[1]
        k["f"] = k["f"].at(t - k["t"])
        k["f"].measure(z, r)
        k["t"] = max(k["t"], t)
        self.absorb(k, t, z, r, freq, raw, bw, sources)
        if k["state"] == "coasting" or k["state"] == "tentative" and k["hits"] >= 3:
            k["state"] = "confirmed"
        self.held_by[fix_id] = k["id"]
        self.apart(k, t)

    def absorb(self, k, t, z, r, freq, raw, bw, sources):
        k["hits"] += 1
        k["fn"] += 1
        k["freq"] += (freq - k["freq"]) / k["fn"]
        k["bw"], k["upd"], k["heard"] = max(k["bw"], bw), max(k["upd"], t), max(k["heard"], t)
        k["recent"] = [*k["recent"], (t, z, r)][-200:]
        k["times"] = [*k["times"], t][-50:]
        if k["anchor"]:
            c = k["ac"] + np.eye(2) * imm.Q_STATIONARY * max(t - k["at"], 0)
            g = c @ np.linalg.inv(c + r)
            k["am"], k["ac"], k["at"] = k["am"] + g @ (z - k["am"]), (np.eye(2) - g) @ c, max(k["at"], t)
        for s in set(sources):
            if s != self.reference and self.reference in k["sf"]:
                self.hz.setdefault(s, []).append(raw - np.mean(k["sf"][self.reference]))
        for s in set(sources):
            k["sf"].setdefault(s, []).append(raw)
        if not k["anchor"] and k["hits"] >= 5 and k["f"].mu[0] >= 0.6:
            last = [x for x in k["recent"] if k["recent"][-1][0] - x[0] <= 180]
            if len(last) >= 5 and last[-1][0] - last[0][0] >= 120:
                info = sum(np.linalg.inv(x[2]) for x in last)
                m = np.linalg.inv(info) @ sum(np.linalg.inv(x[2]) @ x[1] for x in last)
                dof = 2 * (len(last) - 1)
                if sum(d2(x[1] - m, x[2]) for x in last) <= dof * (1 - 2 / (9 * dof) + 1.6449 * math.sqrt(2 / (9 * dof))) ** 3:
                    k["anchor"], k["am"], k["ac"], k["at"] = True, m, np.linalg.inv(info), k["recent"][-1][0]

    def apart(self, k, t):
        if k["parent"] is None or k["split"]:
            return
        p = self.all.get(k["parent"])
        if p is None or t - k["born"] > 600:
            k["parent"] = None
        elif k["hits"] >= 3 and math.dist(self.place(p), self.place(k)) - k["apart"] >= 500:
            if k["prob"] and sum(x > k["born"] for x in p["times"]) < 2:
                p["f"], p["t"], p["anchor"], p["upd"] = k["f"], k["t"], False, max(p["upd"], k["upd"])
                self.log.append((t, "relocated", p["id"], k["id"]))
                self.fold(k, p, t)
                return
            if k["prob"]:
                k["prob"] = False
                self.log.append((k["born"], "created", k["id"], p["id"]))
            self.log.append((t, "unmerged" if k["born"] - p["merged"] <= 300 else "split", p["id"], k["id"]))
            k["parent"], k["split"] = None, True

    def fold(self, k, p, t):
        p["hits"] += k["hits"]
        p["heard"] = max(p["heard"], k["heard"])
        self.log.append((t, "folded", k["id"], p["id"]))
        del self.all[k["id"]]

    def tick(self, now):
        for k in list(self.all.values()):
            silent = now - k["heard"]
            if k["prob"]:
                p = self.all.get(k["parent"])
                if p is None:
                    k["prob"] = False
                    self.log.append((k["born"], "created", k["id"], k["parent"]))
                elif now - k["born"] > 180 or silent > 180:
                    self.fold(k, p, now)
            elif k["state"] == "confirmed" and silent > 90:
                k["state"] = "coasting"
                self.log.append((now, "coasting", k["id"], None))
            elif k["state"] == "tentative" and silent > 180 or k["state"] == "coasting" and silent > 600:
                self.log.append((now, "retired", k["id"], None))
                del self.all[k["id"]]
        if now % 10 == 0:
            self.merge(now)

    def merge(self, now):
        live = [k for k in self.all.values() if not k["prob"] and now - k["upd"] <= 60]
        seen = set()
        for i, a in enumerate(live):
            for b in live[i + 1 :]:
                key = (a["id"], b["id"])
                seen.add(key)
                fa, fb = a["f"].at(now - a["t"]), b["f"].at(now - b["t"])
                (ma, ca), (mb, cb) = fa.whole(), fb.whole()
                if alike(a["freq"], a["bw"], b["freq"], b["bw"]) and all(d2((ma - mb)[s], (ca + cb)[s, s]) <= MERGE_GATE for s in (slice(0, 2), slice(2, 4))):
                    self.streak[key] = self.streak.get(key, 0) + 1
                    if self.streak[key] / (self.streak[key] + 2) >= 0.8:
                        fa.measure(mb[:2], cb[:2, :2])
                        a["f"], a["t"], a["hits"], a["merged"] = fa, max(a["t"], now), a["hits"] + b["hits"], now
                        a["heard"], a["upd"] = max(a["heard"], b["heard"]), max(a["upd"], b["upd"])
                        if a["hits"] >= 3:
                            a["state"] = "confirmed"
                        self.log.append((now, "merged", b["id"], a["id"]))
                        del self.all[b["id"]], self.streak[key]
                        return
                else:
                    self.streak.pop(key, None)
        self.streak = {k: v for k, v in self.streak.items() if k in seen}


def run(fixes, reference, end):
    """Fixes as tuples of ``track.FIX``; seconds from the first to the end."""
    b, todo = Brute(reference), sorted(fixes, key=lambda f: f[:2])
    for now in range(math.floor(todo[0][0]), math.ceil(end + 5)):
        while todo and todo[0][0] <= now - 3:
            b.fix(*todo.pop(0))
        if now < end + 4:
            b.tick(now)
    for k in [k for k in b.all.values() if k["prob"]]:
        if k["parent"] in b.all:
            b.fold(k, b.all[k["parent"]], end + 4)
    return b
