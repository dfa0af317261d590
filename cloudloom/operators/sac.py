"""Sample consensus: seeded minimal samples, hypotheses scored in passes over all points.

The driver draws a bounded pool of points (by hash of idx), fits hypotheses to
minimal samples of it, and ranks them on the pool in blocks.  The first blocks
tell how many inliers good and bad hypotheses have; more hypotheses are then
fitted to inliers of the best one, dropped early by a sequential probability
ratio test, and the list is halved after each block.  The survivors are scored
on every row in one aggregate, each as one sum, and the best one's inliers come
back as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cloud import finite
from .models import MIN_SAMPLES, estimator, xyz
from .points import random_sample


def numeric_distance(model, p: np.ndarray) -> np.ndarray:
    """A model's distances in numpy: the column expression, on arrays."""
    from .models import Circle, Cone, Cylinder, Line, Plane, Sphere, Stick, any_normal

    def unit(v):
        v = np.asarray(v, float)
        return v / np.linalg.norm(v)

    def rim(c):
        n = unit(c.normal)
        d = p - np.asarray(c.centre)
        flat = d - np.outer(d @ n, n)
        size = np.linalg.norm(flat, axis=1, keepdims=True)
        return np.asarray(c.centre) + np.where(size > 1e-12, flat / np.maximum(size, 1e-300), np.asarray(any_normal(c.normal))) * c.radius

    def segment(a, b):
        d = b - a
        t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return np.linalg.norm(p - a - d * t[:, None], axis=1)

    if isinstance(model, Plane):
        return np.abs((p - np.asarray(model.centre)) @ unit(model.normal))
    if isinstance(model, Stick):
        a = np.broadcast_to(np.asarray(model.centre), p.shape)
        return segment(a, a + np.asarray(model.direction))
    if isinstance(model, Line):
        d = p - np.asarray(model.centre)
        return np.linalg.norm(d - np.outer(d @ unit(model.direction), unit(model.direction)), axis=1)
    if isinstance(model, Sphere):
        return np.abs(np.linalg.norm(p - np.asarray(model.centre), axis=1) - model.radius)
    if isinstance(model, Circle):
        d = p - np.asarray(model.centre)
        up = d @ unit(model.normal)
        off = np.linalg.norm(d - np.outer(up, unit(model.normal)), axis=1)
        return np.where(off <= model.radius, np.abs(up), np.linalg.norm(p - rim(model), axis=1))
    if isinstance(model, Cylinder):
        a = rim(model.circle)
        return np.minimum.reduce([numeric_distance(model.circle, p), numeric_distance(model.top(), p), segment(a, a + unit(model.circle.normal) * model.height)])
    if isinstance(model, Cone):
        return np.minimum.reduce([numeric_distance(model.circle, p), np.linalg.norm(p - np.asarray(model.apex()), axis=1), segment(rim(model.circle), np.broadcast_to(np.asarray(model.apex()), p.shape))])
    raise TypeError(type(model))


def unlikely(inlier: np.ndarray, good: float, bad: float, ratio: float) -> np.ndarray:
    """Which hypotheses (rows of inlier flags) a sequential probability ratio test drops.

    It goes through the flags in order and drops a row as soon as it is `ratio`
    times as likely for a share `bad` of inliers as for a share `good`.
    """
    good, bad = (min(max(x, 1e-6), 1 - 1e-6) for x in (good, bad))
    steps = np.where(inlier, np.log(bad / good), np.log((1 - bad) / (1 - good)))
    return steps.cumsum(1).max(1, initial=-np.inf) > np.log(ratio)


def consensus(
    df: DataFrame,
    kind: str | Callable,
    threshold: float,
    samples: int | None = None,
    constraint: tuple[float, float, float] | None = None,
    hypotheses: int = 256,
    blocks: int = 4,
    candidates: int = 64,
    estimations: int = 64,
    block: int = 64,
    ratio: float = 1e3,
    finalists: int = 16,
    pool: int = 2_000,
    seed: int = 0,
):
    """(model, DataFrame of idx of the inliers), or (None, None) with fewer points than a minimal sample.

    An inlier's distance is less than the threshold; for planes it is absolute.
    `constraint` is the vector that a constrained kind takes.  `hypotheses` are
    fitted at first and scored on `blocks` blocks of `block` points; `candidates`
    of them stay, half as many after each further block, for each of which
    `estimations` more are fitted to inliers of the best and dropped where the
    likelihood `ratio` is reached.  `finalists` are scored on all rows.  The same
    rows and seed give the same model however the rows are stored.
    """
    fit, need = (estimator(kind, constraint), MIN_SAMPLES[kind]) if isinstance(kind, str) else (kind, samples)
    points = finite(df).select("idx", "x", "y", "z")
    drawn = sorted(tuple(r) for r in random_sample(points, pool, seed)[0].collect())
    p = np.array([r[1:] for r in drawn], float).reshape(-1, 3)
    if len(p) < need:
        return None, None
    rng = np.random.default_rng(seed)
    p = p[rng.permutation(len(p))]
    first = p[: blocks * block]

    def fitted(n: int, among: np.ndarray) -> list:
        if len(among) < need:
            return []
        return [m for _ in range(n) for m in fit(among[rng.choice(len(among), need, replace=False)])]

    def flags(models: list, some: np.ndarray) -> np.ndarray:
        return np.array([numeric_distance(m, some) < threshold for m in models]).reshape(len(models), len(some))

    found = fitted(hypotheses, p)
    if not found:
        return None, None
    votes = flags(found, first).sum(1)
    good, bad = votes.max() / len(first), max(votes.min(), need) / len(first)

    def more(n: int, seen: np.ndarray) -> None:
        """New hypotheses from inliers of the best one, with their votes among the points seen so far."""
        nonlocal found, votes
        best = found[int(np.argmax(votes))]
        new = fitted(n, seen[numeric_distance(best, seen) < threshold])
        if new and good > bad:
            keep = ~unlikely(flags(new, first), good, bad, ratio)
            new = [m for m, k in zip(new, keep, strict=True) if k]
        if new:
            found, votes = [*found, *new], np.concatenate([votes, flags(new, seen).sum(1)])

    def shorten(n: int) -> None:
        nonlocal found, votes
        keep = np.argsort(-votes, kind="stable")[: max(n, finalists)]
        found, votes = [found[i] for i in keep], votes[keep]

    more(hypotheses, first)
    shorten(candidates)
    for k, lo in enumerate(range(len(first), len(p), block), 1):
        if candidates >> k < 1:
            break
        votes = votes + flags(found, p[lo : lo + block]).sum(1)
        more(estimations, p[: lo + block])
        shorten(candidates >> k)
    found = found[:finalists]
    counts = points.agg(*(F.sum((m.distance(xyz()) < threshold).cast("long")).alias(str(k)) for k, m in enumerate(found))).first()
    best = found[max(range(len(found)), key=lambda k: (counts[k], -k))]
    return best, points.where(best.distance(xyz()) < threshold).select("idx")


def inlier_projection(df: DataFrame, inliers: DataFrame | None, model) -> DataFrame:
    """The inliers moved onto the model, other attributes as they are; without inliers all points."""
    some = df if inliers is None else df.join(inliers.select("idx"), "idx", "left_semi")
    return some.withColumns(dict(zip("xyz", model.project(xyz()), strict=True)))
