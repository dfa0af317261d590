"""Small linear algebra over columns: symmetric 3 x 3 matrices in closed form."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cloud import cross

ENTRIES = ("xx", "xy", "xz", "yy", "yz", "zz")
#: Below such a share of the largest entry, squared, a vector is rounding: eigenvalues are known to about a hundred-millionth where two are equal.
NONE = 1e-14
#: Eigenvalues below these shares of the largest count as zero where a system is solved: the smallest, and the middle one if the smallest is.
FLAT, THIN = 1e-9, 1e-7


def oriented(v: np.ndarray) -> np.ndarray:
    """Vectors turned so that the component of largest size becomes positive."""
    largest = np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1)[:, 0]
    return v * np.where(largest < 0, -1, 1)[:, None]


def across(u: tuple) -> tuple[Column, Column, Column]:
    """A vector at right angles to u: the cross product with the axis of u's smallest component (the first of equals)."""
    a = tuple(map(F.abs, u))
    first = (a[0] <= a[1]) & (a[0] <= a[2])
    second = ~first & (a[1] <= a[2])
    return cross(u, (F.when(first, 1.0).otherwise(0.0), F.when(second, 1.0).otherwise(0.0), F.when(first | second, 0.0).otherwise(1.0)))


# The rest is SQL text: nested bindings of some two thousand operations, which Spark parses at once.

_SUM = "({0}.x * {1}.x + {0}.y * {1}.y + {0}.z * {1}.z)"


def _let(name: str, values: dict[str, str], body: str) -> str:
    """body, where name has the values as fields: each is worked out once, however often body uses it and wherever the optimizer puts it."""
    return f"element_at(transform(array(named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())})), {name} -> {body}), 1)"


def _vector(x: str, y: str, z: str) -> str:
    return f"named_struct('x', {x}, 'y', {y}, 'z', {z})"


def _cross(a: str, b: str) -> str:
    return _vector(*(f"{a}.{p} * {b}.{q} - {a}.{q} * {b}.{p}" for p, q in ("yz", "zx", "xy")))


def _longest(*vectors: str) -> str:
    """The longest of the vectors, the first of equals."""
    *others, last = vectors
    text = last
    for k in range(len(others) - 1, -1, -1):
        more = ", ".join(_SUM.format(v, v) for v in vectors[k + 1 :])
        text = f"if({_SUM.format(others[k], others[k])} >= greatest({more}, 0D), {others[k]}, {text})"
    return text


def _across(k: str) -> str:
    """As across()."""
    second = f"if(abs({k}.y) <= abs({k}.z), {_vector(f'-{k}.z', '0D', f'{k}.x')}, {_vector(f'{k}.y', f'-{k}.x', '0D')})"
    return f"if(abs({k}.x) <= abs({k}.y) and abs({k}.x) <= abs({k}.z), {_vector('0D', f'{k}.z', f'-{k}.y')}, {second})"


def _axis_text(m: str, toward: tuple[float, float, float] | None) -> str:
    """struct(nx, ny, nz, curvature, l1, l2, l3) of the matrix m, a struct of ENTRIES."""
    side = "0D" if toward is None else " + ".join(f"h.n.{k} * ({float(v)!r}D)" for k, v in zip("xyz", toward, strict=True))
    largest = "if(abs(h.n.x) >= abs(h.n.y) and abs(h.n.x) >= abs(h.n.z), h.n.x, if(abs(h.n.y) >= abs(h.n.z), h.n.y, h.n.z))"
    low, total = "(v.b * g.s)", "(3 * a.q * g.s)"
    found = {f"n{k}": f"h.n.{k} * w.turn" for k in "xyz"} | {"curvature": f"if({total} > 0, greatest({low}, 0D) / {total}, 0D)", "l1": "v.a * g.s", "l2": "(3 * a.q - v.a - v.b) * g.s", "l3": low}
    out = f"named_struct({', '.join(f"'{k}', {v}" for k, v in found.items())})"
    out = _let("w", {"turn": f"if(if({side} <> 0, {side}, {largest}) < 0, -1D, 1D) / sqrt({_SUM.format('h.n', 'h.n')})"}, out)
    longest = _SUM.format("c.u", "c.u")
    out = _let("h", {"n": f"if({longest} > {NONE!r}D, c.u, if({_SUM.format('t.k', 't.k')} > {NONE!r}D, {_across('t.k')}, {_vector('1D', '0D', '0D')}))"}, out)
    out = _let("c", {"u": _longest("t.u", "t.v", "t.w")}, out)
    out = _let("t", {"u": _cross("r.x", "r.y"), "v": _cross("r.x", "r.z"), "w": _cross("r.y", "r.z"), "k": _longest("r.x", "r.y", "r.z")}, out)
    out = _let("r", {"x": _vector("e.xx - v.b", "e.xy", "e.xz"), "y": _vector("e.xy", "e.yy - v.b", "e.yz"), "z": _vector("e.xz", "e.yz", "e.zz - v.b")}, out)
    out = _let("v", {"a": "a.q + 2 * p.p * cos(f.r)", "b": f"a.q + 2 * p.p * cos(f.r + {2 * math.pi / 3!r}D)"}, out)
    out = _let("f", {"r": "if(p.p > 0, acos(greatest(-1D, least(1D, p.det / (2 * p.p * p.p * p.p)))) / 3, 0D)"}, out)
    det = "a.x * (a.y * a.z - e.yz * e.yz) - e.xy * (e.xy * a.z - e.yz * e.xz) + e.xz * (e.xy * e.yz - a.y * e.xz)"
    out = _let("p", {"p": f"sqrt(({_SUM.format('a', 'a')} + 2 * (e.xy * e.xy + e.xz * e.xz + e.yz * e.yz)) / 6)", "det": det}, out)
    third = "(e.xx + e.yy + e.zz) / 3"
    out = _let("a", {"q": third, "x": f"e.xx - {third}", "y": f"e.yy - {third}", "z": f"e.zz - {third}"}, out)
    out = _let("e", {k: f"if(g.s > 0, {m}.{k} / g.s, {m}.{k})" for k in ENTRIES}, out)
    return _let("g", {"s": f"greatest({', '.join(f'abs({m}.{k})' for k in ENTRIES)})"}, out)


def _known(names: list[str]) -> str:
    return " and ".join(f"`{n}` is not null" for n in names)


def least_axis(names: list[str], toward: tuple[float, float, float] | None = None) -> Column:
    """struct(nx, ny, nz, curvature, l1, l2, l3) of the symmetric matrix in the columns for xx, xy, xz, yy, yz, zz.

    n is the unit eigenvector of the smallest eigenvalue, turned to the side of
    `toward` or, where that doesn't tell, so that its largest component is positive.
    curvature is that eigenvalue's share of the trace (0 if the trace isn't positive), l1 to
    l3 are the eigenvalues from the largest.  They are the roots of the characteristic
    polynomial by the cosine of a third of an angle; the vector is at right angles to
    two rows of the matrix less the eigenvalue.  Where the two smallest eigenvalues
    are equal, it is across the third one's; for a multiple of the identity, and for
    zeros, the first axis.  A null in the matrix gives null.
    """
    m = {k: f"cast(`{n}` as double)" for k, n in zip(ENTRIES, names, strict=True)}
    return F.expr(f"if({_known(names)}, {_let('m', m, _axis_text('m', toward))}, null)")


def solution(names: list[str], right: list[str]) -> Column:
    """struct(x, y, z): the shortest least-squares solution of a symmetric system without negative eigenvalues; columns as in least_axis.

    Where the smallest eigenvalue vanishes (FLAT) its direction is filled up before
    Cramer's rule and gets no share; where two vanish (THIN) only the third has one;
    zeros give zeros, a null gives null.
    """
    adjugate = {"a": "f.yy * f.zz - f.yz * f.yz", "b": "f.xz * f.yz - f.xy * f.zz", "c": "f.xy * f.yz - f.yy * f.xz", "d": "f.xx * f.zz - f.xz * f.xz", "e": "f.xy * f.xz - f.xx * f.yz", "f": "f.xx * f.yy - f.xy * f.xy"}
    det = "(f.xx * j.a + f.xy * j.b + f.xz * j.c)"
    full = _vector(f"(j.a * f.x + j.b * f.y + j.c * f.z) / {det}", f"(j.b * f.x + j.d * f.y + j.e * f.z) / {det}", f"(j.c * f.x + j.e * f.y + j.f * f.z) / {det}")
    full = _let("j", adjugate, full)
    # A matrix of rank 1 is its largest eigenvalue times the axis of its longest column with itself.
    rank1 = _let("o", {"u": _longest("i.x", "i.y", "i.z")}, _vector(*(f"o.u.{k} * ({_SUM.format('o.u', 's')}) / ({_SUM.format('o.u', 'o.u')} * d.x.l1)" for k in "xyz")))
    rank1 = _let("i", {"x": _vector(*(f"s.{k} / d.x.l1" for k in ("xx", "xy", "xz"))), "y": _vector(*(f"s.{k} / d.x.l1" for k in ("xy", "yy", "yz"))), "z": _vector(*(f"s.{k} / d.x.l1" for k in ("xz", "yz", "zz")))}, rank1)
    flat = f"(d.x.l3 <= {FLAT!r}D * d.x.l1)"
    filled = {k: f"s.{k} / d.x.l1 + if({flat}, d.x.n{k[0]} * d.x.n{k[1]}, 0D)" for k in ENTRIES}
    filled |= {k: f"(s.{k} - if({flat}, (d.x.nx * s.x + d.x.ny * s.y + d.x.nz * s.z) * d.x.n{k}, 0D)) / d.x.l1" for k in "xyz"}
    body = f"if(d.x.l1 <= 0, {_vector('0D', '0D', '0D')}, if(d.x.l2 <= {THIN!r}D * d.x.l1, {rank1}, {_let('f', filled, full)}))"
    values = {k: f"cast(`{n}` as double)" for k, n in zip((*ENTRIES, *"xyz"), (*names, *right), strict=True)}
    return F.expr(f"if({_known([*names, *right])}, {_let('s', values, _let('d', {'x': _axis_text('s', None)}, body))}, null)")
