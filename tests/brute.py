"""The clusterers and the whole runs once more, in plain loops over small inputs."""

import hashlib

import numpy as np


def average_linkage(dist, limit):
    """Clusters as lists of places: the closest pair by mean distance joins, while it is closer than ``limit``."""
    groups = [[i] for i in range(len(dist))]
    total = dist.astype(float).copy()  # of the distances between two groups
    while len(groups) > 1:
        size = np.array([len(g) for g in groups])
        mean = total / np.outer(size, size)
        np.fill_diagonal(mean, np.inf)
        a, b = sorted(np.unravel_index(mean.argmin(), mean.shape))
        if mean[a, b] >= limit:
            break
        groups[a] += groups.pop(b)
        total[a] += total[b]
        total[:, a] += total[:, b]
        total = np.delete(np.delete(total, b, 0), b, 1)
    return groups


def whispers(idx, sim, limit, sweeps, seed):
    """Labels over the whole graph; a node without a neighbour has none."""
    n = len(idx)
    near = [[j for j in range(n) if j != i and sim[i, j] > limit] for i in range(n)]
    label = list(range(n))
    for sweep in range(sweeps):
        before = list(label)
        for i in sorted(range(n), key=lambda i: hashlib.md5(f"{seed}|{sweep}|{idx[i]}".encode()).hexdigest()):
            votes = {}
            for j in near[i]:
                votes[label[j]] = votes.get(label[j], 0.0) + min(max(sim[i, j], 0.0), 1.0)
            if votes:
                label[i] = max(votes, key=votes.get)
        if label == before:
            break
    groups = {}
    for i in range(n):
        if near[i]:
            groups.setdefault(label[i], []).append(i)
    return list(groups.values())


def density(dist, k, least):
    """Density clusters by taking the largest edges of the spanning tree away, one by one."""
    n = len(dist)
    core = [sorted(np.delete(dist[i], i))[:k][-1] if n > 1 else 0.0 for i in range(n)]
    pairs = sorted((max(dist[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    group, tree = {i: {i} for i in range(n)}, []
    for d, i, j in pairs:
        if group[i] is not group[j]:
            tree.append((d, i, j))
            both = group[i] | group[j]
            for x in both:
                group[x] = both

    def reached(start, edges):
        seen, more = {start}, True
        while more:
            more = False
            for _, i, j in edges:
                if (i in seen) != (j in seen):
                    seen |= {i, j}
                    more = True
        return seen

    def grow(members, edges, birth):
        """(stability, own points, children) of a cluster; edges ascending."""
        stability, points = 0.0, []
        while edges:
            d, i, j = edges[-1]
            edges = edges[:-1]
            lam = 1.0 / max(d, 1e-12)
            sides = [reached(x, [e for e in edges if e[1] in members]) for x in (i, j)]
            parts = [(s, [e for e in edges if e[1] in s]) for s in sides]
            if all(len(s) >= least for s in sides):
                stability += (lam - birth) * len(members)
                return stability, points, [grow(s, e, lam) for s, e in parts]
            for s, _ in parts:
                if len(s) < least:
                    stability += (lam - birth) * len(s)
                    points += s
            kept = [x for x in parts if len(x[0]) >= least]
            if not kept:
                break
            members, edges = kept[0]
        return stability, points, []

    def every(c):
        return c[1] + [x for k in c[2] for x in every(k)]

    def best(c):
        """(excess of mass, chosen clusters as lists of points)"""
        below = [best(k) for k in c[2]]
        total = sum(b[0] for b in below)
        if not below or c[0] >= total:
            return c[0], [every(c)]
        return total, [g for b in below for g in b[1]]

    root = grow(set(range(n)), tree, 0.0)
    return [g for k in root[2] for g in best(k)[1]]


def groups_of(algorithm, idx, vec, cfg):
    sim = vec @ vec.T
    dist = np.clip(1.0 - sim, 0.0, 2.0)
    if algorithm == "agglomerative":
        return average_linkage(dist, cfg.distance_threshold)
    if algorithm == "chinese_whispers":
        return whispers(idx, sim, cfg.cw_threshold, cfg.cw_iterations, cfg.seed)
    return density(dist, cfg.min_samples, cfg.min_cluster_size)


class Rows:
    """Rows as arrays, and the phases on them."""

    def __init__(self, idx, face, body, has_face, has_body, cfg, label=None):
        self.idx, self.face, self.body, self.has_face, self.has_body, self.cfg = map(np.asarray, (idx, face, body, has_face, has_body, None))
        self.cfg = cfg
        self.label = np.full(len(self.idx), -1) if label is None else np.array(label)

    def clusters(self):
        return sorted(set(self.label.tolist()) - {-1})

    def cluster(self, mask, vec, offset):
        at = np.flatnonzero(mask)
        groups = groups_of(self.cfg.algorithm, self.idx[at].tolist(), vec[at], self.cfg)
        for k, g in enumerate(sorted(groups, key=min)):
            self.label[at[g]] = offset + k

    def phase1(self):
        if self.has_face.sum() >= 2:
            self.cluster(self.has_face, self.face, 0)

    def centroid(self, c, vec, has, eps=0.0):
        m = np.median(vec[(self.label == c) & has], axis=0)
        n = np.linalg.norm(m)
        return m / (n + eps) if eps else (m / n if n > 0 else m)

    def rescue(self):
        cfg, old = self.cfg, self.label.copy()
        faces = {c: self.centroid(c, self.face, self.has_face) for c in self.clusters() if ((old == c) & self.has_face).any()}
        members = {}
        for i in np.flatnonzero(self.has_body & (old != -1)):
            members.setdefault(old[i], []).append(i)
        for i in np.flatnonzero((old == -1) & self.has_body):
            best, mean = None, -1.0
            for c, m in members.items():
                s = self.body[m] @ self.body[i]
                if (s > cfg.body_rescue_threshold).sum() >= cfg.min_body_agreements and s.mean() > mean:
                    best, mean = c, s.mean()
            if best is None:
                continue
            if self.has_face[i] and np.linalg.norm(self.face[i]) > 0.1 and best in faces and self.face[i] @ faces[best] < cfg.face_veto_threshold:
                continue
            self.label[i] = best

    def phase2b(self):
        mask = (self.label == -1) & self.has_body
        if mask.sum() >= self.cfg.min_cluster_size:
            self.cluster(mask, self.body, max(self.clusters(), default=-1) + 1)

    def merge(self):
        cfg, cs = self.cfg, self.clusters()
        if len(cs) < 2:
            return
        own = lambda c, has: np.flatnonzero((self.label == c) & has)
        cent = {c: self.centroid(c, self.body, self.has_body, 1e-8) for c in cs if len(own(c, self.has_body))}
        links = []
        for a in cent:
            for b in cent:
                if a < b and cent[a] @ cent[b] > 0.7 * cfg.body_merge_threshold:
                    s = self.body[own(a, self.has_body)] @ self.body[own(b, self.has_body)].T
                    if s.mean() < cfg.body_merge_threshold or (s > cfg.body_merge_threshold).mean() < cfg.min_body_overlap_ratio:
                        continue
                    fa, fb = own(a, self.has_face), own(b, self.has_face)
                    face = (self.face[fa] @ self.face[fb].T).mean() if len(fa) and len(fb) else 1.0
                    if not face < cfg.face_contradiction_threshold:
                        links.append((-s.mean(), a, b))
        root = {c: c for c in cs}
        for _, a, b in sorted(links):
            ra, rb = root[a], root[b]
            root = {c: ra if r == rb else r for c, r in root.items()}
        self.label = np.array([root.get(x, -1) for x in self.label.tolist()])

    def renumber(self):
        names = {c: k for k, c in enumerate(self.clusters())}
        self.label = np.array([names.get(x, -1) for x in self.label.tolist()])
        return dict(zip(self.idx.tolist(), self.label.tolist(), strict=True))


def batch(rows):
    rows.phase1()
    rows.rescue()
    rows.phase2b()
    rows.merge()
    return rows.renumber()


def add(old, new):
    """``old`` with labels; ``new`` rows' idx follow those of ``old``."""
    cfg = old.cfg
    cents = {c: (old.centroid(c, old.face, old.has_face) if ((old.label == c) & old.has_face).any() else None, old.centroid(c, old.body, old.has_body) if ((old.label == c) & old.has_body).any() else None) for c in old.clusters()}
    for i in range(len(new.idx)):
        best, score = -1, -1.0
        for c, (f, b) in cents.items():
            sims = [(cfg.face_weight, new.face[i] @ f)] if new.has_face[i] and f is not None else []
            sims += [(1 - cfg.face_weight, new.body[i] @ b)] if new.has_body[i] and b is not None else []
            s = sims[0][1] if len(sims) == 1 else sum(w * x for w, x in sims)
            if sims and s > score:
                best, score = c, s
        if score > cfg.body_rescue_threshold:
            new.label[i] = best
    rest = np.flatnonzero(new.label == -1)
    if len(rest) >= cfg.min_cluster_size:
        sub = Rows(new.idx[rest], new.face[rest], new.body[rest], new.has_face[rest], new.has_body[rest], cfg)
        sub.phase1()
        if sub.clusters():
            sub.rescue()
        sub.phase2b()
        offset = max(old.clusters(), default=-1) + 1
        new.label[rest] = np.where(sub.label == -1, -1, sub.label + offset)
    both = Rows(*[np.concatenate([getattr(old, n), getattr(new, n)]) for n in ("idx", "face", "body", "has_face", "has_body")], cfg, np.concatenate([old.label, new.label]))
    both.merge()
    return both.renumber()
