"""Gaussian mixtures from sums over rows: principal components, first centres, rounds, the best number of clusters."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

COMPONENTS = 10
MAX_CLUSTERS = 50
SEED = 42
RIDGE = 1e-6
ITERATIONS = 100
TOLERANCE = 1e-3
#: Rows of a group among which first centres are drawn, those with the smallest hashes of their ids.
SEED_ROWS = 1000
#: Rows looked at together, and numbers in an array over several groups.
ROWS = 1000
AT_ONCE = 2_000_000
_SCATTER = 2_654_435_761


@dataclass
class Sums:
    """Rows by cluster: how many, their sum, the sum of their outer products; and their log-likelihood."""

    size: np.ndarray
    total: np.ndarray
    outer: np.ndarray
    likelihood: float = 0.0

    @classmethod
    def of(cls, x: np.ndarray, member: np.ndarray, likelihood: float = 0.0) -> Sums:
        outer = np.stack([(x * m[:, None]).T @ x for m in member.T]) if member.shape[1] else np.zeros((0, x.shape[1], x.shape[1]))
        return cls(member.sum(axis=0), member.T @ x, outer, likelihood)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.size + other.size, self.total + other.total, self.outer + other.outer, self.likelihood + other.likelihood)

    def to_bytes(self) -> bytes:
        return np.concatenate([self.size, self.total.ravel(), self.outer.ravel(), [self.likelihood]]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, k: int) -> Sums:
        flat = np.frombuffer(data)
        # k * (1 + d + d * d) + 1 numbers
        d = int(round((np.sqrt(4 * (len(flat) - 1) / k - 3) - 1) / 2))
        return cls(flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : -1].reshape(k, d, d), float(flat[-1]))


def axes(sums: Sums, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal components, by column, of rows summed as one cluster: min(components, n - 2) of them.

    Fewer than one: the rows stay as they are. A component's largest coordinate is positive.
    """
    n, d = int(round(sums.size[0])), sums.total.shape[1]
    k = min(components, n - 2, d)
    if k < 1:
        return np.zeros(d), np.eye(d)
    mean = sums.total[0] / n
    _, v = np.linalg.eigh(sums.outer[0] / n - np.outer(mean, mean))
    v = v[:, ::-1][:, :k]
    return mean, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


def reduce(x: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """The rows along their principal components (``axes``)."""
    mean, v = axes(Sums.of(x, np.ones((len(x), 1))), components)
    return (x - mean) @ v


def reduced(x: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """``reduce`` of groups with equally many rows: by group, row, component.

    Groups with no more rows than columns take the axes from the products of their rows, a smaller matrix.
    """
    n, d = x.shape[1:]
    k = min(components, n - 2, d)
    if k < 1 or n > d:
        return np.stack([reduce(g, components) for g in x])
    x = x - x.mean(axis=1, keepdims=True)
    value, u = np.linalg.eigh(x @ x.transpose(0, 2, 1))
    value, u = value[:, None, ::-1][:, :, :k], u[:, :, ::-1][:, :, :k]
    v = x.transpose(0, 2, 1) @ u
    there = value > 1e-14 * value[:, :, :1]
    v = np.where(there, v / np.sqrt(np.where(there, value, 1.0)), 0.0)
    return x @ (v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0))


def scattered(ids: np.ndarray | Column) -> np.ndarray | Column:
    """Scattered order of node ids, in arrays and in columns of long."""
    return ids * _SCATTER % (1 << 32)


def seeds(x: np.ndarray, ids: np.ndarray, most: int, seed: int = SEED) -> np.ndarray:
    """First centres, the first k of them for k clusters: each next one drawn by its squared distance from those before.

    Of many rows, those with the ``SEED_ROWS`` smallest hashes of their ids are drawn from.
    """
    return seeds_of_all(x[None], ids[None], most, seed)[0]


def seeds_of_all(x: np.ndarray, ids: np.ndarray, most: int, seed: int = SEED) -> np.ndarray:
    """``seeds`` of groups with equally many rows."""
    # no two ids have one hash
    order = np.argsort(scattered(ids.astype(np.int64)), axis=1, kind="stable")[:, :SEED_ROWS]
    x = np.take_along_axis(x, order[:, :, None], axis=1)
    draw, group = np.random.default_rng(seed), np.arange(len(x))
    chosen = [np.full(len(x), draw.integers(x.shape[1]))]
    far = ((x - x[group, chosen[0]][:, None]) ** 2).sum(axis=2)
    for _ in range(1, most):
        at = draw.random() * far.sum(axis=1)
        chosen.append(np.minimum((np.cumsum(far, axis=1) <= at[:, None]).sum(axis=1), x.shape[1] - 1))
        far = np.minimum(far, ((x - x[group, chosen[-1]][:, None]) ** 2).sum(axis=2))
    return x[group[:, None], np.stack(chosen, axis=1)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Memberships in the nearest of the centres."""
    member = np.zeros((len(x), len(centres)))
    member[np.arange(len(x)), ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)] = 1.0
    return member


@dataclass
class Mixture:
    """Full-covariance Gaussians: log weights, means, inverse Cholesky factors, and log densities at the means."""

    weight: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, sums: Sums, n: int) -> Mixture:
        """The mixture that rows so summed make likeliest. Raises LinAlgError where a covariance has no factor."""
        size, d = sums.size + 1e-10, sums.total.shape[1]
        mean = sums.total / size[:, None]
        spread = sums.outer / size[:, None, None] - mean[:, :, None] * mean[:, None, :] * (sums.size / size)[:, None, None] + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(spread)
        top = -0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
        return cls(np.log(size / n), mean, np.linalg.inv(lower), top)

    def to_bytes(self) -> bytes:
        return np.concatenate([self.weight, self.top, self.mean.ravel(), self.inverse.ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, k: int) -> Mixture:
        flat = np.frombuffer(data)
        # k * (2 + d + d * d) numbers
        d = int(round((np.sqrt(4 * len(flat) / k - 7) - 1) / 2))
        return cls(flat[:k], flat[2 * k : 2 * k + k * d].reshape(k, d), flat[2 * k + k * d :].reshape(k, d, d), flat[k : 2 * k])

    def memberships(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Memberships of rows, and their log-likelihood."""
        log = np.stack([w + t - 0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) for w, m, i, t in zip(self.weight, self.mean, self.inverse, self.top, strict=True)], axis=1)
        high = log.max(axis=1, keepdims=True)
        whole = high[:, 0] + np.log(np.exp(log - high).sum(axis=1))
        return np.exp(log - whole[:, None]), float(whole.sum())

    def sums(self, x: np.ndarray) -> Sums:
        """Sums of rows by their memberships, some rows at a time."""
        out = None
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            now = Sums.of(part, *self.memberships(part))
            out = now if out is None else out + now
        return out


class Fit:
    """The rounds of one mixture, from sums to the next mixture, until the likelihood stays."""

    def __init__(self, first: Sums, n: int) -> None:
        self.n, self.last, self.rounds, self.done = n, -np.inf, 0, False
        self.likelihood = -np.inf
        self.mixture: Mixture | None = None
        self._step(first)

    @classmethod
    def at(cls, n: int, last: float, rounds: int, done: bool, likelihood: float, mixture: Mixture | None) -> Fit:
        """A fit as far as it has come."""
        fit = cls.__new__(cls)
        fit.n, fit.last, fit.rounds, fit.done, fit.likelihood, fit.mixture = n, last, rounds, done, likelihood, mixture
        return fit

    def _step(self, sums: Sums) -> None:
        try:
            self.mixture = Mixture.of(sums, self.n)
        except np.linalg.LinAlgError:
            self.done, self.likelihood = True, -np.inf

    def add(self, sums: Sums) -> None:
        """Takes a round's sums under the present mixture."""
        self.rounds += 1
        self.likelihood = sums.likelihood
        now = sums.likelihood / self.n
        if abs(now - self.last) < TOLERANCE or self.rounds == ITERATIONS:
            self.done = True
        else:
            self.last = now
            self._step(sums)


def least_bic(n: int, d: int, k: int) -> float:
    """No mixture of k clusters has a smaller BIC, as the ridge bounds every density."""
    return bic(-0.5 * d * np.log(2 * np.pi * RIDGE) * n, n, d, k)


def bic(likelihood: float, n: int, d: int, k: int) -> float:
    return -2 * likelihood + (k * d + k * d * (d + 1) / 2 + k - 1) * np.log(n)


def best_mixture(x: np.ndarray, ids: np.ndarray | None = None, most: int = MAX_CLUSTERS) -> np.ndarray:
    """Memberships with the number of clusters of the smallest BIC, the smaller number on ties; failed fits don't count.

    The ridge bounds every density, so numbers whose BIC can't be smaller aren't fitted.
    """
    ids = np.arange(len(x)) if ids is None else ids
    return best_mixtures(x[None], ids[None], most)[0]


def best_mixtures(x: np.ndarray, ids: np.ndarray, most: int = MAX_CLUSTERS) -> list[np.ndarray]:
    """``best_mixture`` of groups with equally many rows, which advance together: small ones cost their arithmetic, not a call each."""
    groups, n, d = x.shape
    most = min(most, n - 1)
    out = [np.ones((n, 1))] * groups
    if most < 2:
        return out
    first, best, going = seeds_of_all(x, ids, most), np.full(groups, np.inf), np.arange(groups)
    for k in range(1, most + 1):
        going = going[least_bic(n, d, k) < best[going]]
        if not len(going):
            break
        together = max(1, AT_ONCE // (k * n * d))
        for at in range(0, len(going), together):
            part = going[at : at + together]
            likelihood, member = _fitted(x[part], first[part, :k])
            value = bic(likelihood, n, d, k)
            for i in np.flatnonzero(value < best[part]):
                best[part[i]], out[part[i]] = value[i], member[i].T.copy()
    return out


def _fitted(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods, -inf where a fit fails, and memberships (group, cluster, row) of mixtures from ``centres``: the rounds of ``Fit``."""
    groups, n, d = x.shape
    k = centres.shape[1]
    likelihood, members = np.full(groups, -np.inf), np.zeros((groups, k, n))
    near = np.stack([((x - c[:, None]) ** 2).sum(axis=2) for c in centres.transpose(1, 0, 2)], axis=1).argmin(axis=1)
    member = (near[:, None, :] == np.arange(k)[:, None]).astype(float)
    outer = (x[:, :, :, None] * x[:, :, None, :]).reshape(groups, n, d * d)
    going, last = np.arange(groups), np.full(groups, -np.inf)
    for rounds in range(1, ITERATIONS + 1):
        whole = member.sum(axis=2)
        size = whole + 1e-10
        mean = member @ x / size[:, :, None]
        spread = (member @ outer).reshape(-1, k, d, d) / size[:, :, None, None] - mean[..., :, None] * mean[..., None, :] * (whole / size)[..., None, None] + RIDGE * np.eye(d)
        lower, good = _factors(spread)
        if not good.all():
            going, last, x, outer, size, mean, lower = (a[good] for a in (going, last, x, outer, size, mean, lower))
            if not len(going):
                break
        top = np.log(size / n) - 0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(lower, axis1=2, axis2=3)).sum(axis=2)
        away = (x[:, None] - mean[:, :, None]) @ np.linalg.inv(lower).transpose(0, 1, 3, 2)
        log = top[:, :, None] - 0.5 * np.einsum("gknd,gknd->gkn", away, away)
        high = log.max(axis=1, keepdims=True)
        member = np.exp(log - high)
        total = member.sum(axis=1, keepdims=True)
        member /= total
        found = (high + np.log(total))[:, 0].sum(axis=1)
        done = (np.abs(found / n - last) < TOLERANCE) | (rounds == ITERATIONS)
        likelihood[going[done]], members[going[done]] = found[done], member[done]
        last = found / n
        if done.any():
            going, last, x, outer, member = (a[~done] for a in (going, last, x, outer, member))
            if not len(going):
                break
    return likelihood, members


def _factors(spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky factors by group and cluster, those of groups that have them all; and which groups have."""
    try:
        return np.linalg.cholesky(spread), np.ones(len(spread), bool)
    except np.linalg.LinAlgError:
        lower, good = np.zeros_like(spread), np.zeros(len(spread), bool)
        for i, s in enumerate(spread):
            try:
                lower[i], good[i] = np.linalg.cholesky(s), True
            except np.linalg.LinAlgError:
                pass
        return lower, good


def best_of_all(groups: Sequence[tuple[np.ndarray, np.ndarray]], most: int = MAX_CLUSTERS) -> list[np.ndarray]:
    """Memberships by the best mixture of each group's reduced rows, of ``rows, ids``; groups of one shape are fitted together."""
    out, alike = [], defaultdict(list)
    for i, (x, _) in enumerate(groups):
        out.append(np.ones((len(x), 1)))
        if len(x) > 2:
            alike[x.shape].append(i)
    for which in alike.values():
        found = best_mixtures(reduced(np.stack([groups[i][0] for i in which])), np.stack([groups[i][1] for i in which]), most)
        for i, member in zip(which, found, strict=True):
            out[i] = member
    return out
