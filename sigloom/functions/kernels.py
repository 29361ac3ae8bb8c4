"""Small numpy kernels that tasks call: factorisation, matching, clustering, non-negative fits, mixtures."""

from __future__ import annotations

import math

import numpy as np


def kl_loss(v: np.ndarray, w: np.ndarray, h: np.ndarray) -> float:
    r = np.maximum(w @ h, 1e-300).astype(np.float64)
    v = v.astype(np.float64)
    return float((np.where(v > 0, v * np.log(np.maximum(v, 1e-300) / r), 0) - v + r).sum())


def nndsvd(v: np.ndarray, k: int, fill: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative start from the singular vectors; ``fill`` of zeros: '' (none), 'a' (mean), 'ar' (small random), 'min' (least positive value)."""
    u, s, t = np.linalg.svd(v, full_matrices=False)
    w, h = np.zeros((v.shape[0], k)), np.zeros((k, v.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(t[0])
    for i in range(1, min(k, len(s))):
        parts = [(np.maximum(sign * u[:, i], 0), np.maximum(sign * t[i], 0)) for sign in (1, -1)]
        size = [np.linalg.norm(a) * np.linalg.norm(b) for a, b in parts]
        a, b = parts[int(size[1] > size[0])]
        scale = math.sqrt(s[i] * max(size))
        w[:, i], h[i] = scale * a / max(np.linalg.norm(a), 1e-300), scale * b / max(np.linalg.norm(b), 1e-300)
    mean = v.mean()
    for m in (w, h):
        zero = m < 1e-11
        if fill == "a":
            m[zero] = mean
        elif fill in ("ar", "min"):
            m[zero] = rng.random(int(zero.sum())) * mean / 100
        if fill == "min":
            np.maximum(m, v[v > 0].min(), out=m)
    return w, h


def start(v: np.ndarray, k: int, how: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    if how == "random":
        return rng.random((v.shape[0], k)), rng.random((k, v.shape[1]))
    fills = {"nndsvd": "", "nndsvda": "a", "nndsvdar": "ar", "nndsvd_min": "min"}
    if how not in fills:
        raise ValueError(f"unknown start {how!r}")
    return nndsvd(v.astype(np.float64), k, fills[how], rng)


def step(v: np.ndarray, w: np.ndarray, h: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """One pair of multiplicative updates: W then H for the divergence of beta 1, H then W for others."""
    tiny = np.finfo(w.dtype).tiny

    def of_w(w, h):
        r = np.maximum(w @ h, tiny)
        if beta == 1:  # the denominators are plain sums
            return w * ((v / r) @ h.T) / np.maximum(h.sum(1), tiny)
        return w * ((v * r ** (beta - 2)) @ h.T) / np.maximum(r ** (beta - 1) @ h.T, tiny)

    def of_h(w, h):
        r = np.maximum(w @ h, tiny)
        if beta == 1:
            return h * (w.T @ (v / r)) / np.maximum(w.sum(0)[:, None], tiny)
        return h * (w.T @ (v * r ** (beta - 2))) / np.maximum(w.T @ r ** (beta - 1), tiny)

    if beta == 1:
        w = of_w(w, h)
        return w, of_h(w, h)
    h = of_h(w, h)
    return of_w(w, h), h


def nmf(v: np.ndarray, k: int, rng: np.random.Generator, init: str = "random", beta: float = 1.0, precision: str = "single", min_iterations: int = 10_000, max_iterations: int = 1_000_000, test_conv: int = 10_000, tolerance: float = 1e-15) -> tuple[np.ndarray, np.ndarray, int]:
    """(W, H, iterations at convergence or 0). The loss is tested every ``test_conv`` rounds."""
    if precision not in ("single", "double"):
        raise ValueError(f"precision must be single or double, not {precision!r}")
    kind = np.float32 if precision == "single" else np.float64
    v = v.astype(kind)
    w, h = (m.astype(kind) for m in start(v, k, init, rng))
    first = last = kl_loss(v, w, h)
    for i in range(1, max_iterations + 1):
        w, h = step(v, w, h, beta)
        if i % test_conv == 0:
            now = kl_loss(v, w, h)
            if i > min_iterations and (last - now) / first < tolerance:
                return w, h, i
            last = now
    return w, h, 0


def match(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a matching of least cost (rows <= columns), by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        back = match(cost.T)
        out = np.full(cost.shape[0], -1)
        out[back] = np.arange(cost.shape[1])
        return out
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, here, base = row, -1, 0.0
        while True:
            reduced = base + cost[at] - u[at] - v
            better = ~done & (reduced < dist)
            dist[better], via[better] = reduced[better], here
            here = int(np.where(done, np.inf, dist).argmin())
            base = dist[here]
            done[here] = True
            if owner[here] < 0:
                break
            at = owner[here]
        u[row] += base
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                u[owner[j]] += base - dist[j]
            v[j] -= base - dist[j]
        while here >= 0:
            before = via[here]
            owner[here] = owner[before] if before >= 0 else row
            here = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def distances(a: np.ndarray, b: np.ndarray, how: str = "cosine") -> np.ndarray:
    """Between the columns of two matrices."""
    if how == "correlation":
        a, b = a - a.mean(0), b - b.mean(0)
    elif how != "cosine":
        raise ValueError(f"unknown distance {how!r}")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=0), 1e-300)
    return 1 - unit(a).T @ unit(b)


def silhouette(d: np.ndarray, label: np.ndarray) -> np.ndarray:
    """From all distances; one for every point where there is a single cluster or only clusters of one."""
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2 or len(names) == len(label):
        return np.ones(len(label))
    one = np.eye(len(names))[at]
    sums, count = d @ one, one.sum(0)
    own = count[at]
    a = sums[np.arange(len(at)), at] / np.maximum(own - 1, 1)
    other = sums / count
    other[np.arange(len(at)), at] = np.inf
    b = other.min(1)
    return np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)


def cluster(stack: np.ndarray, k: int, rng: np.random.Generator, how: str = "cosine", passes: int = 11, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and silhouettes of replicate columns (channels x k*R): each replicate gives one column to every cluster.

    ``far``: the columns' distances, where they are known already.
    """
    n = stack.shape[1]
    centre = rng.random((stack.shape[0], k))
    d, last = distances(stack, stack, how) if far is None else far, None
    for _ in range(passes):
        label = np.concatenate([match(distances(stack[:, i : i + k], centre, how)) for i in range(0, n, k)])
        centre = np.stack([stack[:, label == c].mean(1) for c in range(k)], 1)
        sil = silhouette(d, label)
        now = round(float(np.mean([sil[label == c].mean() for c in range(k)])), 2)
        if now == last:
            break
        last = now
    return label, sil


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with non-negative coefficients by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    for _ in range(3 * n + 10):
        grad = target - gram @ x
        if passive.all() or grad[~passive].max() <= 1e-10 * max(1.0, np.abs(target).max()):
            break
        passive[np.where(passive, -np.inf, grad).argmax()] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], target[passive], rcond=None)[0]
            bad = passive & (z <= 0)
            if not bad.any():
                break
            step_ = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x = x + step_ * (z - x)
            passive &= x > 1e-12
        x = z
    return x


def refit(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One sample's activities for fixed signatures, scaled to its total."""
    x = nnls(w, v)
    return x * (v.sum() / x.sum()) if x.sum() > 0 else x


def decompose(target: np.ndarray, known: np.ndarray, add: float = 0.05, remove: float = 0.01) -> np.ndarray:
    """A few known signatures that make up one: forward by at least ``add`` of relative error, then back where ``remove`` is not exceeded."""
    norm = np.linalg.norm(target)
    error = lambda s: np.linalg.norm(target - known[:, s] @ nnls(known[:, s], target)) / norm if s else 1.0
    chosen: list[int] = []
    while len(chosen) < known.shape[1]:
        e, c = min((error([*chosen, c]), c) for c in range(known.shape[1]) if c not in chosen)
        if error(chosen) - e < add and chosen:
            break
        chosen.append(c)
    while len(chosen) > 1:
        e, c = min((error([x for x in chosen if x != c]), c) for c in chosen)
        if e - error(chosen) > remove:
            break
        chosen.remove(c)
    x = np.zeros(known.shape[1])
    x[chosen] = nnls(known[:, chosen], target)
    return x / x.sum() if x.sum() else x


def two_groups(x: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, means and deviations of a mixture of two normals, started at the outer quartiles."""
    mean, sd, share = np.percentile(x, [25, 75]).astype(float), np.full(2, max(x.std(), 1e-6)), np.full(2, 0.5)
    for _ in range(rounds):
        log = np.log(share) - np.log(sd) - 0.5 * ((x[:, None] - mean) / sd) ** 2
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        n = np.maximum(p.sum(0), 1e-9)
        new = (p * x[:, None]).sum(0) / n
        sd, share = np.sqrt((p * (x[:, None] - new) ** 2).sum(0) / n + 1e-6), n / len(x)
        if np.abs(new - mean).max() < 1e-9:
            break
        mean = new
    return p.argmax(1), mean, sd


def hyper_cutoff(totals: np.ndarray, least: float) -> int:
    """Mean plus two deviations of the ordinary samples: the larger group is kept while two groups stay well apart."""
    x = np.asarray(totals, float)
    while len(x) > 2:
        label, mean, sd = two_groups(x)
        count = np.bincount(label, minlength=2)
        if count.min() == 0:
            break
        big = int(count[1] > count[0])
        if abs(mean[big] - mean[1 - big]) < 4 * sd[big]:
            break
        x = x[label == big]
    return max(int(x.mean() + 2 * x.std()), int(least)) if len(x) else int(least)


def rank_sum_p(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p of the rank-sum test, normal approximation."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    ranks = np.empty(len(both))
    ranks[order] = np.arange(1, len(both) + 1)
    values, inverse = np.unique(both, return_inverse=True)
    ranks = (np.bincount(inverse, ranks) / np.bincount(inverse))[inverse]
    n, m = len(a), len(b)
    z = (ranks[:n].sum() - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12)
    return math.erfc(abs(z) / math.sqrt(2))


def similarities(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Mean over samples of l1, l1 %, l2, l2 %, KL, correlation."""
    d = np.abs(v - q)
    l1, l2 = d.sum(0), np.sqrt((d * d).sum(0))
    pv, pq = v / v.sum(0), q / np.maximum(q.sum(0), 1e-300)
    kl = np.where(pv > 0, pv * np.log(np.maximum(pv, 1e-300) / np.maximum(pq, 1e-300)), 0).sum(0)
    cv, cq = v - v.mean(0), q - q.mean(0)
    corr = (cv * cq).sum(0) / np.maximum(np.sqrt((cv * cv).sum(0) * (cq * cq).sum(0)), 1e-300)
    return np.array([l1.mean(), (100 * l1 / v.sum(0)).mean(), l2.mean(), (100 * l2 / np.sqrt((v * v).sum(0))).mean(), kl.mean(), corr.mean()])
