"""Planar and geodesic geometry as column expressions; a ring is array<struct<x,y>>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed rectangular ring."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0), at(x1, y0))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, counter-clockwise positive."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2


def contains_xy(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast: whether (x, y) lies inside a closed ring."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]).otherwise(1.0) + a["x"]).otherwise(False)

    return F.aggregate(pairs, F.lit(0), lambda s, p: s + crosses(p).cast("int")) % 2 == 1


def web_mercator(lon: Column, lat: Column) -> Column:
    """EPSG:4326 to EPSG:3857; other pairs are not offered, so an unknown one fails."""
    return F.struct((F.radians(lon) * WGS84_A).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + F.lit(3.141592653589793) / 4)) * WGS84_A).alias("y"))


def affine_from_bounds(west: Column, south: Column, east: Column, north: Column, width: int, height: int) -> Column:
    """Pixel size and origin of a raster over bounds."""
    return F.struct(((east - west) / width).alias("a"), west.alias("c"), ((south - north) / height).alias("e"), north.alias("f"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Great-circle distance on a sphere; an approximation of the ellipsoidal geodesic."""
    d = F.sin((F.radians(lat2) - F.radians(lat1)) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin((F.radians(lon2) - F.radians(lon1)) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(d))


def geodesic_inverse():
    """A pandas UDF (lon1, lat1, lon2, lat2) -> forward azimuth, back azimuth, distance on WGS84 (Vincenty).

    Nearly antipodal pairs, where the iteration does not settle, give nulls.
    """
    @F.pandas_udf("forward double, back double, distance double")
    def inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
        a, f = WGS84_A, WGS84_F
        b = a * (1 - f)
        l1, p1, l2, p2 = (np.radians(s.to_numpy(float)) for s in (lon1, lat1, lon2, lat2))
        u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
        ln = lam = l2 - l1
        with np.errstate(all="ignore"):
            for _ in range(200):
                sl, cl = np.sin(lam), np.cos(lam)
                ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
                cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
                sig = np.arctan2(ss, cs)
                sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * sl / ss)
                ca2 = 1 - sa**2
                cm = np.where(ca2 == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / ca2)
                c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
                new = ln + (1 - c) * f * sa * (sig + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
                done = np.abs(new - lam) < 1e-12
                lam = new
                if done.all():
                    break
            k2 = ca2 * (a * a - b * b) / (b * b)
            big = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
            small = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
            ds = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
            dist = b * big * (sig - ds)
            sl, cl = np.sin(lam), np.cos(lam)
            fwd = np.degrees(np.arctan2(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl))
            back = np.degrees(np.arctan2(-np.cos(u1) * sl, np.sin(u1) * np.cos(u2) - np.cos(u1) * np.sin(u2) * cl))
        out = pd.DataFrame({"forward": fwd, "back": back, "distance": dist})
        out[~done] = np.nan
        return out

    return inverse
