"""Geometric models: distances and projections as columns, and fits of minimal samples in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[float, float, float]
Point = tuple[Column, Column, Column]


def xyz() -> Point:
    return F.col("x"), F.col("y"), F.col("z")


def minus(p: Point, q) -> Point:
    return tuple(a - b for a, b in zip(p, q, strict=True))


def plus(p, q) -> Point:
    return tuple(a + b for a, b in zip(p, q, strict=True))


def times(p, k) -> Point:
    return tuple(a * k for a in p)


def inner(p, q) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def length(p) -> Column:
    return F.sqrt(inner(p, p))


def chosen(test: Column, p, q) -> Point:
    return tuple(F.when(test, a).otherwise(b) for a, b in zip(p, q, strict=True))


def _vector(v) -> np.ndarray:
    return np.asarray(v, float)


def _unit(v) -> Vector:
    v = _vector(v)
    return tuple((v / np.linalg.norm(v)).tolist())


@dataclass(frozen=True)
class Plane:
    centre: Vector
    normal: Vector

    def signed(self, p: Point) -> Column:
        return inner(minus(p, self.centre), _unit(self.normal))

    def distance(self, p: Point) -> Column:
        return F.abs(self.signed(p))

    def squared(self, p: Point) -> Column:
        return self.signed(p) * self.signed(p)

    def same_side(self, p: Point) -> Column:
        return inner(minus(p, self.centre), self.normal) >= 0

    def project(self, p: Point) -> Point:
        return minus(p, times([F.lit(k) for k in _unit(self.normal)], self.signed(p)))


@dataclass(frozen=True)
class Line:
    centre: Vector
    direction: Vector

    def along(self, p: Point) -> Column:
        d = _vector(self.direction)
        return inner(minus(p, self.centre), tuple((d / (d @ d)).tolist()))

    def at(self, t: Column) -> Point:
        return tuple(F.lit(c) + t * d for c, d in zip(map(float, self.centre), map(float, self.direction), strict=True))

    def project(self, p: Point) -> Point:
        return self.at(self.along(p))

    def distance(self, p: Point) -> Column:
        return length(minus(p, self.project(p)))


@dataclass(frozen=True)
class Stick(Line):
    """The segment from centre to centre + direction."""

    def along(self, p: Point) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), super().along(p)))


def any_normal(normal: Vector) -> Vector:
    """A unit vector at right angles to the normal: where every direction is as near."""
    n = _vector(_unit(normal))
    axis = np.eye(3)[np.abs(n).argmin()]
    return _unit(np.cross(n, axis))


def _away(rho: Column, up: Column, to: tuple[Column, Column]) -> Column:
    return F.sqrt((rho - to[0]) * (rho - to[0]) + (up - to[1]) * (up - to[1]))


@dataclass(frozen=True)
class Circle:
    """A filled disc.

    Shapes around an axis are worked out in the half plane of a point: its
    distance from the axis, rho, and its height over the disc, up.
    """

    centre: Vector
    normal: Vector
    radius: float

    def profile(self, p: Point) -> tuple[Column, Column, Point]:
        """(rho, up, unit vector from the axis to the point; a fixed one for points on the axis)."""
        n = _unit(self.normal)
        d = minus(p, self.centre)
        up = inner(d, n)
        flat = minus(d, times([F.lit(k) for k in n], up))
        rho = length(flat)
        outward = chosen(rho > 1e-12, times(flat, F.lit(1.0) / F.greatest(rho, F.lit(1e-300))), [F.lit(k) for k in any_normal(self.normal)])
        return rho, up, outward

    def place(self, to: tuple[Column, Column], outward: Point) -> Point:
        """The point of the half plane in space."""
        n = _unit(self.normal)
        return tuple(F.lit(float(c)) + o * to[0] + to[1] * k for c, o, k in zip(self.centre, outward, n, strict=True))

    def rim(self, p: Point) -> Point:
        """The nearest point of the circumference; a fixed one for points on the axis."""
        return self.place((F.lit(float(self.radius)), F.lit(0.0)), self.profile(p)[2])

    def disc(self, rho: Column, height: float = 0.0) -> tuple[Column, Column]:
        return F.least(rho, F.lit(float(self.radius))), F.lit(float(height))

    def circumference_distance(self, p: Point) -> Column:
        rho, up, _ = self.profile(p)
        return _away(rho, up, (F.lit(float(self.radius)), F.lit(0.0)))

    def distance(self, p: Point) -> Column:
        rho, up, _ = self.profile(p)
        return _away(rho, up, self.disc(rho))

    def project(self, p: Point) -> Point:
        rho, _, outward = self.profile(p)
        return self.place(self.disc(rho), outward)


@dataclass(frozen=True)
class Sphere:
    centre: Vector
    radius: float

    def distance(self, p: Point) -> Column:
        return F.abs(length(minus(p, self.centre)) - float(self.radius))

    def project(self, p: Point) -> Point:
        d = minus(p, self.centre)
        size = length(d)
        out = chosen(size > 1e-12, times(d, float(self.radius) / F.greatest(size, F.lit(1e-300))), [F.lit(float(self.radius)), F.lit(0.0), F.lit(0.0)])
        return tuple(F.lit(float(c)) + o for c, o in zip(self.centre, out, strict=True))


class _Around:
    """A closed shape around the axis of its base circle, by the nearest of its parts; earlier parts win ties."""

    circle: Circle

    def parts(self, rho: Column, up: Column) -> list[tuple[Column, Column]]:
        """The nearest point of each part in the half plane."""
        raise NotImplementedError

    def distance(self, p: Point) -> Column:
        rho, up, _ = self.circle.profile(p)
        return F.least(*(_away(rho, up, to) for to in self.parts(rho, up)))

    def project(self, p: Point) -> Point:
        rho, up, outward = self.circle.profile(p)
        parts = self.parts(rho, up)
        far = [_away(rho, up, to) for to in parts]
        best = parts[-1]
        for k in reversed(range(len(parts) - 1)):
            wins = far[k] <= (F.least(*far[k + 1 :]) if k + 2 < len(parts) else far[k + 1])
            best = tuple(F.when(wins, a).otherwise(b) for a, b in zip(parts[k], best, strict=True))
        return self.circle.place(best, outward)


@dataclass(frozen=True)
class Cylinder(_Around):
    """Closed: the side, base disc and top disc."""

    circle: Circle
    height: float

    def top(self) -> Circle:
        n = _vector(_unit(self.circle.normal))
        return Circle(tuple((_vector(self.circle.centre) + n * self.height).tolist()), self.circle.normal, self.circle.radius)

    def parts(self, rho: Column, up: Column) -> list[tuple[Column, Column]]:
        side = F.lit(float(self.circle.radius)), F.greatest(F.lit(0.0), F.least(F.lit(float(self.height)), up))
        return [side, self.circle.disc(rho), self.circle.disc(rho, self.height)]


@dataclass(frozen=True)
class Cone(_Around):
    """Closed: the side, base disc and apex."""

    circle: Circle
    height: float

    def apex(self) -> Vector:
        return tuple((_vector(self.circle.centre) + _vector(_unit(self.circle.normal)) * self.height).tolist())

    def parts(self, rho: Column, up: Column) -> list[tuple[Column, Column]]:
        r, h = float(self.circle.radius), float(self.height)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (up * h - (rho - r) * r) / (r * r + h * h)))
        return [(F.lit(r) - t * r, t * h), self.circle.disc(rho), (F.lit(0.0), F.lit(h))]


# --- fits of minimal samples ------------------------------------------------------


def _tuple(v) -> Vector:
    return tuple(float(x) for x in v)


def fit_plane(p: np.ndarray, normal=None, direction=None) -> list[Plane]:
    """Three points; one and a normal; or two and a direction that the plane contains."""
    if normal is None:
        normal = np.cross(p[1] - p[0], p[2] - p[0]) if direction is None else np.cross(p[1] - p[0], direction)
    return [Plane(_tuple(p[0]), _unit(normal))] if np.linalg.norm(normal) > 1e-12 else []


def fit_line(p: np.ndarray, direction=None) -> list[Line]:
    """Two points, or one and a direction."""
    d = p[1] - p[0] if direction is None else np.asarray(direction, float)
    return [Line(_tuple(p[0]), _tuple(d))] if np.linalg.norm(d) > 1e-12 else []


def fit_stick(p: np.ndarray) -> list[Stick]:
    return [Stick(_tuple(p[0]), _tuple(p[1] - p[0]))] if np.linalg.norm(p[1] - p[0]) > 1e-12 else []


def fit_circle(p: np.ndarray) -> list[Circle]:
    """The circle through three points."""
    n = np.cross(p[1] - p[0], p[2] - p[0])
    if np.linalg.norm(n) < 1e-12:
        return []
    a = np.stack([2 * (p[1] - p[0]), 2 * (p[2] - p[0]), n])
    c = np.linalg.solve(a, [p[1] @ p[1] - p[0] @ p[0], p[2] @ p[2] - p[0] @ p[0], n @ p[0]])
    return [Circle(_tuple(c), _unit(n), float(np.linalg.norm(p[0] - c)))]


def fit_sphere(p: np.ndarray) -> list[Sphere]:
    """The sphere through four points."""
    a = 2 * (p[1:4] - p[0])
    if abs(np.linalg.det(a)) < 1e-12:
        return []
    c = np.linalg.solve(a, (p[1:4] ** 2).sum(1) - p[0] @ p[0])
    return [Sphere(_tuple(c), float(np.linalg.norm(p[0] - c)))]


def fit_cylinder(p: np.ndarray) -> list[Cylinder]:
    """Each of four points in turn is on the top; the others make the base: up to four cylinders."""
    out = []
    for k in range(4):
        for c in fit_circle(np.delete(p[:4], k, 0)):
            h = float((p[k] - _vector(c.centre)) @ _vector(c.normal))
            if abs(h) > 1e-12:
                out.append(Cylinder(Circle(c.centre, _tuple(np.sign(h) * _vector(c.normal)), c.radius), abs(h)))
    return out


def fit_cone(p: np.ndarray) -> list[Cone]:
    """Each of four points in turn is on the side; the others make the base: up to four cones."""
    out = []
    for k in range(4):
        for c in fit_circle(np.delete(p[:4], k, 0)):
            d = p[k] - _vector(c.centre)
            up = float(d @ _vector(c.normal))
            flat = float(np.linalg.norm(d - up * _vector(c.normal)))
            if abs(up) > 1e-12 and flat < c.radius:
                out.append(Cone(Circle(c.centre, _tuple(np.sign(up) * _vector(c.normal)), c.radius), abs(up) * c.radius / (c.radius - flat)))
    return out


#: Points that a minimal sample has.
MIN_SAMPLES = {"plane": 3, "perpendicular plane": 1, "parallel plane": 2, "line": 2, "stick": 2, "parallel line": 1, "circle": 3, "sphere": 4, "cylinder": 4, "cone": 4}
FITS = {
    "plane": fit_plane,
    "perpendicular plane": fit_plane,
    "parallel plane": fit_plane,
    "line": fit_line,
    "stick": fit_stick,
    "parallel line": fit_line,
    "circle": fit_circle,
    "sphere": fit_sphere,
    "cylinder": fit_cylinder,
    "cone": fit_cone,
}
#: What is given of a constrained model: a plane's normal, a direction that a plane contains, a line's direction.
CONSTRAINTS = {"perpendicular plane": "normal", "parallel plane": "direction", "parallel line": "direction"}


def estimator(kind: str, constraint: Vector | None = None) -> Callable[[np.ndarray], list]:
    """The fit of a kind of model, with the vector that a constrained one takes."""
    if kind not in CONSTRAINTS:
        return FITS[kind]
    if constraint is None or not np.linalg.norm(constraint) > 1e-12:
        raise ValueError(f"a {kind} takes a {CONSTRAINTS[kind]}")
    return partial(FITS[kind], **{CONSTRAINTS[kind]: np.asarray(constraint, float)})


def parameters(model) -> tuple[float, ...]:
    """A model as ten numbers: a place (a point of it, or its centre), a direction (or its axis, 0 for a sphere), radius and height (null for models without)."""
    circle = getattr(model, "circle", model)
    place = circle.centre
    direction = getattr(circle, "normal", None) or getattr(model, "direction", (0.0, 0.0, 0.0))
    return *place, *direction, getattr(circle, "radius", None), getattr(model, "height", None)


def fit_each(samples: DataFrame, kind: str, constraint: Vector | None = None) -> DataFrame:
    """sample, k, x, y, z, nx, ny, nz, radius, height: the models (k from 0) through each sample, a row of its number and an array of structs x, y, z of at least as many points as the kind takes.

    Samples without a model have no row.  Each is fitted where it is; however many
    there are, none meets another.
    """
    fit, need = estimator(kind, constraint), MIN_SAMPLES[kind]
    names = ["sample", "k", "x", "y", "z", "nx", "ny", "nz", "radius", "height"]

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten()
            at = np.column_stack([flat.field(a).to_numpy(zero_copy_only=False) for a in "xyz"])
            ends = np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)))).astype(int)
            rows = [(n, k, *parameters(m)) for n, lo, hi in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True) if hi - lo >= need for k, m in enumerate(fit(at[lo:hi]))]
            kinds = (pa.int64(), pa.int32(), *[pa.float64()] * 8)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return samples.select(F.col("sample").cast("long"), "points").mapInArrow(run, "sample long, k int, " + ", ".join(f"{n} double" for n in names[2:]))
