"""Points, boxes and rings, as built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the earth in km; kilometres in a degree; the bounding box of the map.
EARTH_KM = 6371.0088
DEGREE_KM = 111.32
BOX = {"south": 7.6, "north": 48.9, "west": -10.9, "east": 71.4}
#: Places nearer than this are one place; landmarks with one slug nearer than this are one landmark.
SAME_PLACE_KM = 1.0
SAME_LANDMARK_KM = 5.0
PALETTE = 16


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, good for short ways."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return DEGREE_KM * F.sqrt(x * x + (lat2 - lat1) * (lat2 - lat1))


def in_box(lat: Column, lon: Column) -> Column:
    return lat.between(BOX["south"], BOX["north"]) & lon.between(BOX["west"], BOX["east"])


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over an array of structs ``lat, lon``; an odd number of crossings is inside."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + n - 1) % n)
        apart = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) + a["lon"]
        return F.coalesce(apart & (lon < at), F.lit(False)).cast("int")

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def ring_is_simple(ring: Column) -> Column:
    """Does no edge of a closed ring meet another but at shared ends?  Pairs of edges within one row."""
    n = F.size(ring) - 1  # the closing point repeats the first

    def side(p: Column, q: Column, r: Column) -> Column:
        v = (q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"])
        return F.when(v > 1e-9, 1).when(v < -1e-9, -1).otherwise(0)

    def meets(i: Column, j: Column) -> Column:
        a, b, c, d = F.get(ring, i), F.get(ring, i + 1), F.get(ring, j), F.get(ring, j + 1)
        return (side(a, b, c) != side(a, b, d)) & (side(c, d, a) != side(c, d, b))

    edges = F.sequence(F.lit(0), n - 1)
    crossing = F.exists(edges, lambda i: F.exists(edges, lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1)) & meets(i, j)))
    return (n >= 3) & ~crossing


def palette_slots(seeds: dict[str, int], size: int = PALETTE) -> dict[str, int]:
    """Colours by seed with linear probing over sorted ids; a small dimension, handled on the driver."""
    taken: set[int] = set()
    out: dict[str, int] = {}
    for key in sorted(seeds):
        slot = seeds[key] % size
        while slot in taken and len(taken) < size:
            slot = (slot + 1) % size
        taken.add(slot)
        out[key] = slot
    return out


def morph_rings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A ring between two rings on the sphere: columns ``id, ring_a, ring_b, share`` give ``id, ring``.

    Both are resampled to 128 points by length, the second is turned to the
    first one's winding and shifted to the least sum of angles, and points are
    interpolated along great circles.
    """
    import numpy as np

    def unit(ring):
        lat, lon = np.radians(np.array(ring, float).T)
        return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)

    def resampled(points, n=128):
        closed = np.vstack([points, points[:1]])
        at = np.r_[0, np.cumsum(np.linalg.norm(np.diff(closed, axis=0), axis=1))]
        want = np.linspace(0, at[-1], n, endpoint=False)
        out = np.stack([np.interp(want, at, closed[:, k]) for k in range(3)], 1)
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def winding(p):
        return np.sign(np.sum(np.cross(p, np.roll(p, -1, 0)) @ p.mean(0)))

    for frame in frames:
        rings = []
        for a, b, t in zip(frame["ring_a"], frame["ring_b"], frame["share"]):
            p, q = resampled(unit([tuple(x) for x in a])), resampled(unit([tuple(x) for x in b]))
            if winding(p) != winding(q):
                q = q[::-1]
            angle = np.arccos(np.clip(p @ q.T, -1, 1))
            n = len(p)
            shift = min(range(n), key=lambda s: angle[np.arange(n), (np.arange(n) + s) % n].sum())
            q = np.roll(q, -shift, 0)
            w = np.arccos(np.clip((p * q).sum(1), -1, 1))[:, None]
            s = np.where(w < 1e-12, 1, np.sin(w))
            m = np.where(w < 1e-12, p, (np.sin((1 - t) * w) * p + np.sin(t * w) * q) / s)
            lat, lon = np.degrees(np.arcsin(np.clip(m[:, 2], -1, 1))), np.degrees(np.arctan2(m[:, 1], m[:, 0]))
            rings.append([[float(x), float(y)] for x, y in zip(lat, lon)])
        yield pd.DataFrame({"id": frame["id"], "ring": rings})
