"""Integer distance functions as Column expressions; ``a`` and ``b`` are structs with x, y (and z)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pi of the DDD.MM norm, the sphere's radii, the crystal norm's turn.
GEO_PI, GEO_RADIUS, GEOM_RADIUS, CRYSTAL_TURN = 3.141592, 6378.388, 6378388.0, 2_880_000

_custom: dict[str, Callable[[Column, Column], Column]] = {}


def _d(a: Column, b: Column, c: str) -> Column:
    return a[c].cast("double") - b[c].cast("double")


def _trunc(x: Column) -> Column:
    return x.cast("long")


def max_2d(a: Column, b: Column) -> Column:
    return _trunc(F.greatest(F.abs(_d(a, b, "x")) + 0.5, F.abs(_d(a, b, "y")) + 0.5))


def man_2d(a: Column, b: Column) -> Column:
    return _trunc(F.abs(_d(a, b, "x")) + F.abs(_d(a, b, "y")) + 0.5)


def _squares(a: Column, b: Column, names: str = "xy") -> Column:
    parts = [_d(a, b, c) * _d(a, b, c) for c in names]
    return sum(parts[1:], parts[0])


def euc_2d(a: Column, b: Column) -> Column:
    return _trunc(F.sqrt(_squares(a, b)) + 0.5)


def ceil_2d(a: Column, b: Column) -> Column:
    return F.ceil(F.sqrt(_squares(a, b))).cast("long")


def euc_3d(a: Column, b: Column) -> Column:
    return _trunc(F.sqrt(_squares(a, b, "xyz")) + 0.5)


def att(a: Column, b: Column) -> Column:
    r = F.sqrt(_squares(a, b) / 10.0)
    return F.when(_trunc(r) < r, _trunc(r) + 1).otherwise(_trunc(r))


def geo(a: Column, b: Column) -> Column:
    def radians(c: Column) -> Column:
        whole = c.cast("double").cast("long")
        return GEO_PI * (whole + 5.0 * (c - whole) / 3.0) / 180.0

    q1, q2, q3 = (F.cos(radians(a["y"]) - radians(b["y"])), F.cos(radians(a["x"]) - radians(b["x"])), F.cos(radians(a["x"]) + radians(b["x"])))
    return _trunc(GEO_RADIUS * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 0.5 * ((1.0 + q1) * q2 - (1.0 - q1) * q3)))) + 1.0)


def geom(a: Column, b: Column) -> Column:
    """Great-circle metres between decimal degrees, by the arc tangent form that is exact for near and for opposite points."""
    lat1, lat2, half = F.radians(a["x"].cast("double")), F.radians(b["x"].cast("double")), F.radians(_d(a, b, "y")) / 2.0
    east = F.cos(lat2) * F.sin(2.0 * half)
    north = F.sin(lat1 + lat2) * F.sin(half) * F.sin(half) - F.sin(lat1 - lat2) * F.cos(half) * F.cos(half)
    toward = F.cos(lat1 - lat2) * F.cos(half) * F.cos(half) - F.cos(lat1 + lat2) * F.sin(half) * F.sin(half)
    return _trunc(GEOM_RADIUS * F.atan2(F.sqrt(east * east + north * north), toward) + 1.0)


#: Fixed values of the board norm: inches to machine units, and for each of seven stretches of 0.05 its slope and where it begins.
BOARD_UNIT, BOARD_FIRST, BOARD_LAST, BOARD_STEP = 25400.0, 0.01, 0.30, 0.05
BOARD_X = (15500.0, ((1062.5, 155.0, 0.01), (300.0, 197.5, 0.05), (300.0, 212.5, 0.10), (250.0, 227.5, 0.15), (300.0, 240.5, 0.20), (1000.0, 255.0, 0.25), (154.6, 305.0, 0.30)))
BOARD_Y = (15000.0, ((1062.5, 150.0, 0.01), (450.0, 192.5, 0.05), (350.0, 215.0, 0.10), (250.0, 232.5, 0.15), (300.0, 245.5, 0.20), (900.0, 250.0, 0.25), (157.7, 295.0, 0.30)))


def board(a: Column, b: Column) -> Column:
    """Drill times: the larger of two piecewise linear functions of the distances in x and in y."""

    def time(c: str, first: float, pieces: tuple) -> Column:
        d = F.abs(_d(a, b, c)) / BOARD_UNIT
        *inner, last = [(slope, begin - at * slope) for slope, begin, at in pieces]
        slope, base = (F.element_at(F.array(*[F.lit(p[k]) for p in (*inner, last)]), F.least((d / BOARD_STEP).cast("int"), F.lit(6)) + 1) for k in (0, 1))
        return F.when(d <= BOARD_FIRST, d * first).when(d >= BOARD_LAST, d * last[0] + last[1]).otherwise(d * slope + base)

    return _trunc(F.greatest(time("x", *BOARD_X), time("y", *BOARD_Y)))


def toroidal(grid: float) -> Callable[[Column, Column], Column]:
    def length(a: Column, b: Column) -> Column:
        dx, dy = (F.least(F.abs(_d(a, b, c)), grid - F.abs(_d(a, b, c))) for c in "xy")
        return _trunc(F.sqrt(dx * dx + dy * dy) + 0.5)

    return length


def crystal(a: Column, b: Column) -> Column:
    dy = F.abs(_d(a, b, "y"))
    folded = F.when(dy > CRYSTAL_TURN / 2, CRYSTAL_TURN - dy).otherwise(dy)
    return _trunc(F.greatest(F.abs(_d(a, b, "x")), folded, F.abs(_d(a, b, "z"))))


def mismatches(a: Column, b: Column) -> Column:
    """Vectors of 0, 1 and 2 (unknown): ten times the length times the mismatches over the known places, 0 if none."""
    both = F.zip_with(a["vec"], b["vec"], lambda p, q: F.when((p != 2) & (q != 2), (p != q).cast("int")))
    known = F.size(F.filter(both, lambda v: v.isNotNull()))
    wrong = F.size(F.filter(both, lambda v: v == 1))
    return F.when(known == 0, F.lit(0)).otherwise((10 * F.size(a["vec"]) * wrong / known).cast("long")).cast("long")


def _int32(v: Column) -> Column:
    """A product of two 32-bit integers as 32-bit arithmetic leaves it."""
    return (v + F.lit(2**31)).bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)


def dsjrand(maxdist: int, seed: int) -> Callable[[Column, Column], Column]:
    """A pseudo-random length below ``maxdist`` from the codes in x: products of 32 bits of their common and joint bits."""
    param = int((104 * seed + 1 + 2**31) % 2**32 - 2**31)

    def length(a: Column, b: Column) -> Column:
        p, q = a["x"].cast("long"), b["x"].cast("long")

        def mixed(state: Column) -> Column:
            x = _int32(state["x"] * state["z"])
            y = _int32(state["y"] * x)
            return F.struct(x.alias("x"), y.alias("y"), _int32(state["z"] * y).alias("z"))

        def step(state: Column, turn: Column) -> Column:
            flipped = F.struct(state["x"].alias("x"), state["y"].alias("y"), F.when(turn == 1, state["z"].bitwiseXOR(F.lit(param))).otherwise(state["z"]).alias("z"))
            return mixed(flipped)

        start = F.struct(p.bitwiseAND(q).alias("x"), p.bitwiseOR(q).alias("y"), F.lit(param).cast("long").alias("z"))
        last = F.aggregate(F.array(F.lit(0), F.lit(1)), start, step)["z"]
        return ((p + q).bitwiseXOR(last).bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(maxdist / 2147483648.0)).cast("long")

    return length


def _each(a: Column, b: Column, worth: Callable[[Column, Column], Column]) -> Column:
    """Sum over the places of two vectors of 0, 1 and 2 (unknown)."""
    return F.aggregate(F.zip_with(a["vec"], b["vec"], worth), F.lit(0.0), lambda s, v: s + v)


def rh_weighted(d00: int, d01: int, d02: int, d12: int, d22: int) -> Callable[[Column, Column], Column]:
    """Sum of a distance for each place, by the two symbols there; a null vector is at distance 0."""

    def worth(p: Column, q: Column) -> Column:
        known = F.when(p == q, F.lit(d00)).otherwise(F.lit(d01))
        half = F.when(F.least(p, q) == 0, F.lit(d02)).otherwise(F.lit(d12))
        return F.when((p == 2) & (q == 2), F.lit(d22)).when((p == 2) | (q == 2), half).otherwise(known).cast("double")

    return lambda a, b: F.coalesce(_each(a, b, worth).cast("long"), F.lit(0).cast("long"))


def rh_expected(p1: float) -> Callable[[Column, Column], Column]:
    """A hundred times the expected mismatches if an unknown symbol is 1 with chance ``p1``."""

    def worth(p: Column, q: Column) -> Column:
        half = F.when(F.least(p, q) == 0, F.lit(p1)).otherwise(F.lit(1 - p1))
        return F.when((p == 2) & (q == 2), F.lit(2 * p1 * (1 - p1))).when((p == 2) | (q == 2), half).otherwise((p != q).cast("double"))

    return lambda a, b: F.coalesce(_trunc(_each(a, b, worth) * 100.0 + 0.5), F.lit(0).cast("long"))


def rh_likelihood(p1: float, both_known: bool, cap: int = 1000) -> Callable[[Column, Column], Column]:
    """Ten times the negative decimal log-likelihood of a pair of vectors, at most ``cap``.

    Places count that are known in both vectors (``both_known``) or in one of them. Against a null
    vector only the symbol frequencies count; two null vectors are at distance 0.
    """
    q1 = 1.0 - p1

    def length(a: Column, b: Column) -> Column:
        def count(test: Callable[[Column, Column], Column]) -> Column:
            return _each(a, b, lambda p, q: test(p, q).cast("double"))

        def single(v: Column) -> Column:
            ones, zeros = (F.size(F.filter(v, lambda s: s == k)) for k in (1, 0))
            return F.pow(F.lit(p1**0.5), ones.cast("double")) * F.pow(F.lit(q1**0.5), zeros.cast("double"))

        n = count(lambda p, q: (p != 2) & (q != 2)) if both_known else count(lambda p, q: (p != 2) | (q != 2))
        same1, same0 = count(lambda p, q: (p == 1) & (q == 1)), count(lambda p, q: (p == 0) & (q == 0))
        apart = count(lambda p, q: ((p == 0) & (q == 1)) | ((p == 1) & (q == 0)))
        whole = n - same1 * p1 - same0 * q1
        term = 4.0 * n * p1 * q1 * apart
        theta = (whole - F.sqrt(whole * whole - term)) / (2.0 * n * p1 * q1)
        chance = F.pow(1.0 - theta * p1, same0) * F.pow(1.0 - theta * q1, same1) * F.pow(theta * (p1 * q1) ** 0.5, apart)
        pair = F.when((n == 0) | (term >= whole * whole), F.lit(cap)).when(theta >= 1.0, F.lit(cap)).otherwise(_trunc(-10.0 * F.log10(chance)))
        alone = _trunc(-10.0 * F.log10(single(F.coalesce(a["vec"], b["vec"]))))
        return F.when(a["vec"].isNull() & b["vec"].isNull(), F.lit(0)).when(a["vec"].isNull() | b["vec"].isNull(), alone).otherwise(pair).cast("long")

    return length


def weighted(length: Column, wi: Column, wj: Column) -> Column:
    """A length with both ends' weights."""
    return length + wi + wj


def with_depots(length: Column, i: Column, j: Column, cost_i: Column, cost_j: Column, first_depot: int) -> Column:
    """Ids from ``first_depot`` on are depots: two of them are at length 0, one costs what its other end's depot costs."""
    return F.when((i >= first_depot) & (j >= first_depot), F.lit(0)).when(i >= first_depot, cost_j).when(j >= first_depot, cost_i).otherwise(length).cast("long")


#: Norms that need parameters.
_MADE: dict[str, Callable[..., Callable[[Column, Column], Column]]] = {
    "TOROIDAL": lambda grid: toroidal(float(grid)), "DSJRAND": dsjrand, "RH1": rh_weighted, "RH2": rh_expected, "RH3": lambda p1: rh_likelihood(p1, False), "RH4": lambda p1: rh_likelihood(p1, True),
}

NORMS: dict[str, Callable[[Column, Column], Column]] = {
    "MAX_2D": max_2d, "MAN_2D": man_2d, "EUC_2D": euc_2d, "CEIL_2D": ceil_2d, "EUC_3D": euc_3d, "ATT": att, "GEO": geo, "GEOM": geom, "CRYSTAL": crystal, "RH5": mismatches, "BOARD": board,
}



#: The same lengths of arrays of coordinate differences, for the small groups that one task works on.
ARRAY_NORMS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "MAX_2D": lambda dx, dy: np.trunc(np.maximum(np.abs(dx), np.abs(dy)) + 0.5),
    "MAN_2D": lambda dx, dy: np.trunc(np.abs(dx) + np.abs(dy) + 0.5),
    "EUC_2D": lambda dx, dy: np.trunc(np.sqrt(dx * dx + dy * dy) + 0.5),
    "CEIL_2D": lambda dx, dy: np.ceil(np.sqrt(dx * dx + dy * dy)),
    "ATT": lambda dx, dy: np.ceil(np.sqrt((dx * dx + dy * dy) / 10.0)),
}


def register_norm(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """Make a norm of the user's known by name."""
    _custom[name] = fn


def length_col(norm: str, a: Column, b: Column, **params) -> Column:
    """The length between two point structs.

    ``TOROIDAL`` takes ``grid``; ``DSJRAND`` maxdist and seed; ``RH1`` d00, d01, d02, d12 and d22; ``RH2`` to ``RH4`` p1.
    """
    if norm in _MADE:
        return _MADE[norm](**params)(a, b)
    if norm not in NORMS and norm not in _custom:
        raise ValueError(f"norm {norm!r} isn't supported")
    return (_custom.get(norm) or NORMS[norm])(a, b)


def lookup_lengths(pairs: DataFrame, edges: DataFrame, default: int = 100_000) -> DataFrame:
    """i, j, len of ``pairs(i, j)`` from a matrix or sparse graph ``edges(i, j, len)``; pairs that it lacks cost ``default``, loops 0."""
    known = edges.select(F.least("i", "j").alias("_i"), F.greatest("i", "j").alias("_j"), "len").groupBy("_i", "_j").agg(F.min("len").alias("len"))
    found = pairs.select("i", "j", F.least("i", "j").alias("_i"), F.greatest("i", "j").alias("_j")).join(known, ["_i", "_j"], "left")
    return found.select("i", "j", F.when(F.col("i") == F.col("j"), 0).otherwise(F.coalesce("len", F.lit(default))).cast("long").alias("len"))
