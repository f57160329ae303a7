"""Dense numpy kernels that run inside Arrow workers on data Spark has partitioned."""

from __future__ import annotations

import numpy as np


def omega(beta: float) -> float:
    """Polynomial of the universal threshold's multiple of the median singular value."""
    return 0.56 * beta**3 - 0.95 * beta**2 + 1.43 + 1.82 * beta


def universal_rank(s: np.ndarray, m: int, n: int) -> int:
    """Singular values above omega(m/n) times their median, at least one."""
    return max(1, int((s > omega(m / n) * np.median(s)).sum())) if len(s) else 0


def spectral_rank(s: np.ndarray, t: float) -> int:
    """Least rank whose share of energy exceeds t; t = 1 keeps all."""
    if t >= 1:
        return len(s)
    share = np.cumsum(s**2) / max(np.sum(s**2), np.finfo(float).tiny)
    return int(np.argmax(share > t)) + 1


def choose_rank(s: np.ndarray, m: int, n: int, max_rank: int | None, spectral_t: float | None) -> int:
    if max_rank is not None:
        return min(max_rank, len(s))
    return spectral_rank(s, spectral_t) if spectral_t is not None else universal_rank(s, m, n)


def truncated_svd(x: np.ndarray, rank: int, least: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, s, V^T of at most ``rank`` components, those below ``least`` dropped."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    k = min(rank, int((s >= least).sum()))
    return u[:, :k], s[:k], v[:k]


def components_of(a: np.ndarray, max_rank: int | None, spectral_t: float | None, least: float, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, s, V^T of the principal components that a regression on the columns of a keeps; ``shape`` of what a stands for."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    kept = s * (s >= least)
    k = min(choose_rank(kept, *(shape or a.shape), max_rank, spectral_t), int((kept > 0).sum()))
    return u[:, :k], s[:k], v[:k]


def pcr(a: np.ndarray, y: np.ndarray, max_rank: int | None, spectral_t: float | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Principal component regression of y on the columns of a: (coefficients, right singular vectors)."""
    u, s, v = components_of(a, max_rank, spectral_t, least)
    return v.T @ ((u.T @ y) / s), v


def relative_error(residual: np.ndarray, of: np.ndarray) -> float:
    """Squared ratio of norms; NaN where there is nothing to compare with."""
    norm = float(of @ of)
    return float(residual @ residual) / norm if norm else float("nan")


def row_splits(rows: np.ndarray, k: int) -> list[np.ndarray]:
    """Contiguous near-equal parts; the first ones take what is left over."""
    return [p for p in np.array_split(rows, k) if len(p)]


def best_biclique(mask: np.ndarray, node_budget: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a fully observed submatrix with the greatest min(#rows, #columns); see search_biclique."""
    return search_biclique(mask, node_budget)[:2]


#: Bits of a row set up to which copies of rows have bits of their own: counting them is quicker than weighing.
PLAIN_BITS = 8192


def _weigher(weight: np.ndarray):
    """Sizes of bit sets whose bits weigh so much: set bits are counted in each binary digit of the weights."""
    digits = [(1 << b, _bits(weight >> b & 1)) for b in range(int(weight.max()).bit_length())]
    return lambda x: sum(v * (x & m).bit_count() for v, m in digits)


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags.astype(bool), bitorder="little").tobytes(), "little")


def search_biclique(mask: np.ndarray, node_budget: int | None = None, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(rows, columns, exact) of a fully observed submatrix with the greatest min(#rows, #columns).

    Columns that are alike are one column with a weight. Closed column sets are grown depth first over bit
    sets of rows, each one once, pruned by what they can still reach; among the best found the greater area
    wins, then the lexicographically least rows. The search is exact unless ``node_budget`` nodes are given
    and don't suffice: then the best found so far, greedy solution included, is returned with exact False.
    A row of the mask may stand for several ``copies`` of it; such rows come in the order of their first copies.
    """
    if copies is not None and (copies > 1).any():
        plain = copies // (unit := int(np.gcd.reduce(copies)))
        if plain.sum() <= PLAIN_BITS:
            rows, cols, exact = _search(np.repeat(mask, plain, axis=0), node_budget, lambda x: unit * x.bit_count())
            return np.unique(np.repeat(np.arange(len(mask)), plain)[rows]), cols, exact
        return _search(mask, node_budget, _weigher(copies))
    return _search(mask, node_budget, int.bit_count)


def _search(mask: np.ndarray, node_budget: int | None, size) -> tuple[np.ndarray, np.ndarray, bool]:
    """``search_biclique`` where ``size`` weighs sets of rows."""
    n, m = mask.shape
    nothing = np.zeros(0, int)
    if not mask.any():
        return nothing, nothing, True
    if mask.all():
        return np.arange(n), np.arange(m), True
    alike: dict[int, list[int]] = {}
    for j in range(m):
        alike.setdefault(_bits(mask[:, j]), []).append(j)
    alike.pop(0, None)
    sets = sorted(alike, key=lambda x: (-size(x), alike[x][0]))
    weight = [len(alike[x]) for x in sets]
    best: tuple = (0, 0, None)

    def closure(rows: int) -> int:
        return sum(w for x, w in zip(sets, weight, strict=True) if x & rows == rows)

    def consider(rows: int, cols: int) -> None:
        nonlocal best
        r = size(rows)
        score = (min(r, cols), r * cols)
        if score > best[:2] or (score == best[:2] and score[0] and _lexical(rows, best[2])):
            best = (*score, rows)

    # greedy start: add the columns that keep most rows
    rows, free = (1 << n) - 1, list(range(len(sets)))
    while free and rows:
        j = max(free, key=lambda c: size(sets[c] & rows))
        rows &= sets[j]
        if not rows:
            break
        consider(rows, closure(rows))
        free.remove(j)
    nodes, exact = 0, True

    def grow(rest: list[int], rows: int, done: list[int]) -> None:
        nonlocal nodes, exact
        done = list(done)
        for place, j in enumerate(rest):
            now = rows & sets[j]
            if size(now) > best[0] and not any(sets[d] & now == now for d in done):
                if node_budget is not None and nodes >= node_budget:
                    exact = False
                    return
                nodes += 1
                later, reach, least = [], 0, best[0]
                for k in rest[place + 1 :]:
                    common = sets[k] & now
                    if common != now and size(common) > least:
                        later.append(k)
                        reach += weight[k]
                cols = closure(now)
                if min(size(now), cols + reach) > best[0]:
                    consider(now, cols)
                    grow(later, now, done)
            done.append(j)

    grow(list(range(len(sets))), (1 << n) - 1, [])
    if best[2] is None:
        return nothing, nothing, exact
    rows = best[2]
    return np.flatnonzero(np.unpackbits(np.frombuffer(rows.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")), np.sort(np.array([j for x in sets if x & rows == rows for j in alike[x]])), exact


def _lexical(a: int, b: int | None) -> bool:
    """Whether row set a comes before b."""
    if b is None or a == b:
        return b is None
    low = (a ^ b) & -(a ^ b)
    return bool(a & low)


def masked_cp(index: list[np.ndarray], values: np.ndarray, shape: tuple[int, ...], rank: int, sweeps: int, ridge: float, tolerance: float, seed: int) -> list[np.ndarray]:
    """Factors of a tensor from its known cells by alternating ridge least squares."""
    rng = np.random.default_rng(seed)
    scale = float(np.abs(values).mean()) or 1.0 if len(values) else 1.0
    factors = [rng.uniform(0.5, 1.5, (n, rank)) for n in shape]
    factors[0] *= scale / rank
    weight = ridge * max(1.0, float(values @ values) / max(1, len(values))) ** (1 / len(shape))
    last, eye = np.inf, np.eye(rank)
    for _ in range(sweeps):
        for mode, n in enumerate(shape):
            z = np.ones((len(values), rank))
            for other in range(len(shape)):
                if other != mode:
                    z *= factors[other][index[other]]
            gram = np.zeros((n, rank, rank))
            for a in range(rank):
                for b in range(a, rank):
                    gram[:, a, b] = gram[:, b, a] = np.bincount(index[mode], z[:, a] * z[:, b], minlength=n)
            side = np.stack([np.bincount(index[mode], z[:, a] * values, minlength=n) for a in range(rank)], 1)
            lam = weight * np.maximum(1e-12, np.trace(gram, axis1=1, axis2=2) / rank)
            factors[mode] = np.linalg.solve(gram + (lam[:, None, None] + 1e-300) * eye + (lam == 0)[:, None, None] * eye, side[..., None])[..., 0]
        fit = np.ones((len(values), rank))
        for i, f in zip(index, factors, strict=True):
            fit *= f[i]
        error = float(((fit.sum(1) - values) ** 2).mean()) if len(values) else 0.0
        if last - error <= tolerance * max(error, 1e-12):
            break
        last = error
    return normalised(factors)


def upper_solve(gram: np.ndarray, side: np.ndarray, weight: float) -> np.ndarray:
    """Ridge solutions (n, rank) of normal equations given as upper halves (pairs, n) and sides (rank, n)."""
    rank, eye = len(side), np.eye(len(side))
    full = np.empty((side.shape[1], rank, rank))
    for (a, b), g in zip([(a, b) for a in range(rank) for b in range(a, rank)], gram, strict=True):
        full[:, a, b] = full[:, b, a] = g
    lam = weight * np.maximum(1e-12, np.trace(full, axis1=1, axis2=2) / rank)
    return np.linalg.solve(full + (lam[:, None, None] + 1e-300) * eye + (lam == 0)[:, None, None] * eye, side.T[..., None])[..., 0]


def row_factors(first: np.ndarray, other: np.ndarray, values: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(indices, factors by component) of the first mode's indices in a block of known cells sorted by them; z: (rank, others)."""
    starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    x = [c[other] for c in z]
    gram = [np.add.reduceat(x[a] * x[b], starts) for a in range(len(z)) for b in range(a, len(z))]
    side = np.array([np.add.reduceat(c * values, starts) for c in x])
    return first[starts], upper_solve(gram, side, weight).T


def _spread(ids: np.ndarray, vecs: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Components of the first mode's factors at each cell."""
    at = np.searchsorted(ids, first)
    return [v[at] for v in vecs]


def column_sums(first: np.ndarray, other: np.ndarray, values: np.ndarray, z: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's own factors u: sums of u u^T (upper half) and of u times value at each of the others' cells; squared norms."""
    ids, vecs = row_factors(first, other, values, z, weight)
    u, n = _spread(ids, vecs, first), z.shape[1]
    sums = [np.bincount(other, u[a] * u[b], n) for a in range(len(z)) for b in range(a, len(z))]
    return np.array(sums + [np.bincount(other, c * values, n) for c in u]), (vecs * vecs).sum(axis=1)


def factor_error(first: np.ndarray, other: np.ndarray, values: np.ndarray, before: np.ndarray, z: np.ndarray, weight: float) -> float:
    """Squared error of a block: the first mode's factors were solved for with ``before``, the others' now are ``z``."""
    u = _spread(*row_factors(first, other, values, before, weight), first)
    d = sum(a * c[other] for a, c in zip(u, z, strict=True)) - values
    return float(d @ d)


def normalised(factors: list[np.ndarray]) -> list[np.ndarray]:
    """Equal norms of each component in all modes, signs positive in all but the first."""
    out = [f.copy() for f in factors]
    norms = np.array([np.linalg.norm(f, axis=0) for f in out])
    norms[norms == 0] = 1
    even = np.prod(norms, axis=0) ** (1 / len(out))
    for f, n in zip(out, norms, strict=True):
        f *= even / n
    for f in out[1:]:
        sign = np.where(f.sum(axis=0) < 0, -1.0, 1.0)
        f *= sign
        out[0] *= sign
    return out


def hankel(ts: np.ndarray, L: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ts, len(ts) - L + 1).copy()


def unhankel(h: np.ndarray) -> np.ndarray:
    L, m = h.shape
    at = np.add.outer(np.arange(L), np.arange(m)).ravel()
    return np.bincount(at, h.ravel()) / np.bincount(at)


def page(ts: np.ndarray, L: int) -> np.ndarray:
    return ts[: len(ts) - len(ts) % L].reshape(-1, L).T.copy()


def ar_fit(x: np.ndarray, order: int) -> np.ndarray:
    """Autoregression without intercept by normal equations."""
    if not order or len(x) <= order:
        return np.zeros(order)
    lags = np.stack([x[order - k - 1 : len(x) - k - 1] for k in range(order)], 1)
    return np.linalg.lstsq(lags.T @ lags, lags.T @ x[order:], rcond=None)[0]


def mssa_fit(ts: np.ndarray, lags: int, rank: int | None, rule: str, energy: float, use_page: bool, nan_share: float, ar_order: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(lag coefficients oldest first, autoregression of residuals, rank, denoised series)."""
    lags = min(lags, max(1, len(ts) // 2))
    layout = page if use_page else hankel
    matrix = layout(ts, lags + 1)
    kept = matrix[:, np.isnan(matrix).mean(axis=0) < nan_share]
    if kept.shape[1] < 1:
        kept = matrix
    seen = lambda x: max(float((~np.isnan(x)).mean()), 1e-12)
    full, part = np.nan_to_num(matrix), np.nan_to_num(kept)
    s = np.linalg.svd(part, compute_uv=False)
    if rank is None:
        rank = {"donoho": lambda: universal_rank(s, *sorted(part.shape)), "energy": lambda: spectral_rank(s, energy), "fixed": lambda: 5}[rule]()
    rank = max(1, min(rank, len(s)))

    def denoise(x: np.ndarray, share: float) -> np.ndarray:
        u, sv, v = truncated_svd(x, rank, 0)
        return (u * sv) @ v / share

    d = denoise(part, seen(kept))
    coefs = np.linalg.lstsq(d[:-1].T, d[-1], rcond=None)[0]
    whole = denoise(full, seen(matrix))
    smooth = whole.T.ravel() if use_page else unhankel(whole)
    noise = np.nan_to_num(ts[: len(smooth)] - smooth)
    return coefs, ar_fit(noise, ar_order), rank, smooth


def mssa_predict(history: np.ndarray, coefs: np.ndarray, horizon: int, ar: np.ndarray | None = None, noise: np.ndarray | None = None) -> np.ndarray:
    """Recursive forecast over the last values; NaN in them gives NaN."""
    past, out = list(history[-len(coefs) :]), []
    e = list(noise[-len(ar) :]) if ar is not None and len(ar) and noise is not None else []
    for _ in range(horizon):
        y = float(np.dot(coefs, past[-len(coefs) :]))
        if e:
            e.append(float(np.dot(ar, e[::-1][: len(ar)])))
            y += e[-1]
        past.append(y)
        out.append(y)
    return np.array(out)


def spectral_labels(mask: np.ndarray, clusters: int, best: int, components: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column labels by spectral biclustering of a 0/1 matrix (log interactions, k-means)."""
    x = np.log1p(mask.astype(float))
    x = x - x.mean(axis=0) - x.mean(axis=1)[:, None] + x.mean()
    k = max(1, min(components, *x.shape))
    u, _, v = np.linalg.svd(x, full_matrices=False)
    u, v = u[:, :k].T, v[:k]

    def steps(vector: np.ndarray) -> float:
        """Distance of a vector to its piecewise constant form."""
        return float(np.linalg.norm(vector - kmeans(vector[:, None], clusters, seed)[1][:, 0]))

    pick = lambda vectors: vectors[np.argsort([steps(w) for w in vectors], kind="stable")[:best]]
    rows = kmeans(x @ pick(v).T, clusters, seed)[0]
    cols = kmeans(x.T @ pick(u).T, clusters, seed)[0]
    return rows, cols


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and each point's centre; seeded k-means++."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[rng.integers(len(x))])
    c = np.array(centres)
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        labels = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[labels == i].mean(0) if (labels == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return labels, c[labels]
