"""Path lengths by a join of rays with bricks of the volume.

The volume is a table of bricks, EDGE voxels on a side, one byte a voxel, keyed by
(bz, by, bx); bricks without a labelled voxel are not there. A leg's rays, one for each sample,
are parallel: legs meet blocks of samples, and a row is a leg and a block. Its rays are cut
where they enter another brick, and a row for each brick takes the segments there. Where both
meet, in a task, segments are looked up as arrays and leave as counts of each stretch of
labelled steps, mostly one a brick; a ray's stretches are put in order and added up to its vacuum.

So a row for a leg, a block and a brick is exchanged instead of a row a step, no voxel
passes the driver, and no process holds more of the volume than the brick at hand. A ray
meets a brick once, so dealing rows by a hash bounds what one group of a brick holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Voxels on a side of a brick; samples of a block; rays of which a group of a brick holds segments, about; segments that are laid out at once; segments and stretches of a batch that are handled at once, about.
EDGE, BLOCK, GROUP_RAYS, CHUNK, AT_ONCE = 32, 256, 500_000, 1 << 11, 1 << 20
RAY = ("refl_id", "sample_id", "leg")
KEY = ("bz", "by", "bx")
FACES = ("BACK", "FRONT", "TOP", "BOT", "LE", "RI")
SEGMENT = np.dtype([("sample", "<i8"), ("origin", "<i4", 3), ("k0", "<i4"), ("k1", "<i4")])
STRETCH = np.dtype([("sample", "<i8"), ("start", "<i4"), ("steps", "<i4"), ("counts", "<i4", 4), ("last", "<i4"), ("limit", "<i4"), ("total", "<f8")])


def voxel_at(axis: str, k: Column, half_even: bool = False) -> Column:
    """The voxel of step k along an axis: rounded down where the ray descends v2, else to the nearest; kept inside the volume."""
    at = F.col(axis) + k * F.col(f"d{axis}")
    nearest = F.rint(at) if half_even else F.when(at < 0, -F.floor(-at + 0.5)).otherwise(F.floor(at + 0.5))
    whole = F.when(F.col("down"), F.floor(at)).otherwise(nearest)
    return F.least(F.greatest(whole, F.lit(0)), F.col(f"n{axis}") - 1).cast("int")


def clip(rays: DataFrame, voxels: DataFrame, beyond: Column | int = 0) -> DataFrame:
    """rays with n cut a few steps after they leave the box of labelled voxels for good, and `beyond` steps more.

    All steps after that are vacuum, and at least beyond + 1 of them are left, so what
    is cut never counts. Where the box reaches the edge of the volume rays stay in it.
    """
    box = voxels.agg(*(f(a).alias(f"{n}_{a}") for a in "zyx" for n, f in (("low", F.min), ("high", F.max))))
    rows = rays.crossJoin(F.broadcast(box))
    out = []
    for a in "zyx":
        d, o, low, high = F.col(f"d{a}"), F.col(a), F.col(f"low_{a}"), F.col(f"high_{a}")
        up = F.when((d > 0) & (high < F.col(f"n{a}") - 1), (high + 1 - o) / d)
        down = F.when((d < 0) & (low > 0), (low - 1 - o) / d)
        steps = F.coalesce(up, down)
        out.append(F.when(steps > 0, steps).when(steps <= 0, 0.0))
    left = F.floor(F.least(*out)) + 3 + beyond
    return rows.withColumn("n", F.least("n", F.coalesce(left, F.col("n"))).cast("int")).select(*rays.columns)


def brick_table(voxels: DataFrame) -> DataFrame:
    """(bz, by, bx, cells): the labels of each brick that has any, as bytes in row-major order. A brick is at most EDGE^3 rows."""
    edge = EDGE

    def packed(rows: pa.Table) -> pa.Table:
        cells = np.zeros(edge**3, np.int8)
        cells[rows["cell"].to_numpy()] = rows["label"].to_numpy()
        return pa.table({k: rows[k].slice(0, 1) for k in KEY} | {"cells": pa.array([cells.tobytes()])})

    within = [F.pmod(F.col(a), F.lit(edge)) for a in "zyx"]
    keyed = voxels.select(*(F.floor(F.col(a) / edge).cast("int").alias(f"b{a}") for a in "zyx"), ((within[0] * edge + within[1]) * edge + within[2]).cast("int").alias("cell"), F.col("label").cast("tinyint").alias("label"))
    return keyed.groupBy(*KEY).applyInArrow(packed, "bz int, by int, bx int, cells binary")


@dataclass(frozen=True)
class Scene:
    """What all rays share: the volume's shape and voxel sizes, the box of labelled voxels, and the vacuum steps in a row that a ray passes, by exit face. All in (z, y, x)."""

    shape: tuple[int, int, int]
    sizes: tuple[float, float, float]
    low: tuple[int, int, int]
    high: tuple[int, int, int]
    limits: tuple[int, ...]

    @classmethod
    def of(cls, volume: DataFrame, voxels: DataFrame, limits: Sequence[int]) -> Scene:
        """From a volume and its voxels; only the measures and the box reach the driver."""
        meta = volume.first()
        box = voxels.agg(*(f(a).alias(f"{n}{a}") for a in "zyx" for n, f in (("l", F.min), ("h", F.max)))).first()
        place = lambda n: tuple(int(box[f"{n}{a}"] or 0) for a in "zyx")
        return cls(*((meta[f"{n}z"], meta[f"{n}y"], meta[f"{n}x"]) for n in "ns"), place("l"), place("h"), tuple(limits))


class Rays:
    """Rays as arrays: origin (rays x 3), step, down, n and limit. The same rays as `absorb.plan_rays` and `clip` make, from directions (v0, v1, v2)."""

    def __init__(self, v: np.ndarray, origin: np.ndarray, scene: Scene):
        heading, shape = v[:, [0, 2, 1]], np.array(scene.shape)
        rows = np.arange(len(v))
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.stack([(wall - origin[:, a]) / heading[:, a] for a in (2, 1, 0) for wall in (0, shape[a])], axis=1)
        at[~(at >= 0)] = np.inf
        face = at.argmin(axis=1)
        axis = np.array([2, 2, 1, 1, 0, 0])[face]
        self.origin, self.step, self.down = origin, heading / np.abs(heading[rows, axis])[:, None], heading[:, 1] < 0
        own = origin[rows, axis]
        n = np.where(face % 2 == 0, own + 1, shape[axis] - own) + ((face == 3) | (face == 5)) * (heading[:, 2] > 0)
        self.limit = np.array(scene.limits)[face]
        left = np.full(len(v), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            for a in range(3):
                d = self.step[:, a]
                if scene.high[a] < scene.shape[a] - 1:
                    left = np.minimum(left, np.where(d > 0, (scene.high[a] + 1 - origin[:, a]) / d, np.inf))
                if scene.low[a] > 0:
                    left = np.minimum(left, np.where(d < 0, (scene.low[a] - 1 - origin[:, a]) / d, np.inf))
        self.n = np.minimum(n, np.floor(np.maximum(left, 0)) + 3 + self.limit).astype(np.int64)
        self.shape = scene.shape

    def at(self, axis: int, k: np.ndarray, rows=slice(None)) -> np.ndarray:
        """voxel_at for arrays. Below 0 both roundings end in voxel 0, so halves need no care there."""
        wide = (lambda x: x[:, None]) if np.ndim(k) == 2 else (lambda x: x)
        at = wide(self.origin[rows, axis]) + k * wide(self.step[rows, axis])
        at += wide(np.where(self.down[rows], 0, 0.5))
        return np.clip(np.floor(at, out=at), 0, self.shape[axis] - 1, out=at).astype(np.int32)

    def cut(self, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ray, k0, k1) of each brick that a ray crosses, in order. The step at which a ray enters a brick is estimated by division and made exact by looking at the steps around it."""
        found = [np.arange(len(self.n), dtype=np.int64) << 32]
        for a in range(3):
            first, last = (self.at(a, k) // edge for k in (0, self.n - 1))
            times = np.abs(last - first)
            row = np.repeat(np.arange(len(times)), times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            up = (last > first)[row]
            border = np.where(up, first[row] + 1 + nth, first[row] - nth) * edge
            near = np.ceil((border - np.where(self.down[row], 0, 0.5) - self.origin[row, a]) / self.step[row, a]).astype(np.int64)
            before = lambda k: (self.at(a, k, row) < border) == up  # noqa: B023, E731
            found.append(row << 32 | (near - 1 + before(near - 1) + before(near)))
        keys = np.unique(np.concatenate(found))
        row, k0 = keys >> 32, keys & 0xFFFFFFFF
        ends = np.append(row[1:] != row[:-1], True)
        return row, k0, np.where(ends, self.n[row], np.append(k0[1:], 0)) - 1


def binaries(items: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array of records, each as bytes; slice i ends before item ends[i]."""
    if len(items) * items.itemsize >= 1 << 31:
        raise ValueError("too many rays at once; lower arrow batches or GROUP_RAYS")
    offsets = (np.concatenate([[0], ends]) * items.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(items.tobytes())])


def records(column: pa.ChunkedArray | pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a binary column, and how many each row has."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) // kind.itemsize for p in parts], np.int64)


def parts(batch: pa.RecordBatch, weights: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` by weight, a row at least."""
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(weights) - 1) // most)) + 1), batch.num_rows]
    return (batch.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i)


def sample_blocks(samples: DataFrame, n: int) -> DataFrame:
    """(block, points): samples in blocks of about BLOCK."""
    block = F.pmod(F.xxhash64("sample_id"), F.lit(max(1, -(-n // BLOCK)))).cast("int")
    point = F.struct(F.col("sample_id").cast("long").alias("sample_id"), *(F.col(c).cast("int").alias(c) for c in "zyx"))
    return samples.groupBy(block.alias("block")).agg(F.collect_list(point).alias("points"))


def routed(rows: DataFrame, scene: Scene, salts: int) -> DataFrame:
    """(refl_id, leg, block, v0, v1, v2, points) to a row for each brick that rays of it cross, with their segments there."""
    edge, segment, at_once = EDGE, SEGMENT, AT_ONCE
    crossed = sum((n - 1) // edge + 1 for n in scene.shape)

    def bounded(batches):
        for batch in batches:
            yield from parts(batch, np.diff(batch.column("points").offsets.to_numpy()).astype(np.int64) * crossed, at_once)

    def dealt(batches):
        for batch in bounded(batches):
            points = batch.column("points")
            sizes = np.diff(points.offsets.to_numpy())
            flat = points.flatten()
            sample, *origin = (flat.field(c).to_numpy() for c in ("sample_id", "z", "y", "x"))
            if not len(sample):
                continue
            whose = np.repeat(np.arange(batch.num_rows), sizes)
            v = np.stack([batch.column(f"v{k}").to_numpy() for k in range(3)], axis=1)[whose]
            rays = Rays(v, np.stack(origin, axis=1), scene)
            ray, k0, k1 = rays.cut(edge)
            at = [rays.at(a, k0, ray) // edge for a in range(3)]
            order = np.lexsort((*at[::-1], whose[ray]))
            ray, k0, k1, at = ray[order], k0[order], k1[order], [x[order] for x in at]
            out = np.zeros(len(ray), segment)
            out["sample"], out["origin"], out["k0"], out["k1"] = sample[ray], rays.origin[ray], k0, k1
            key = np.stack([whose[ray], *at])
            ends = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, len(ray))
            own = batch.select(["refl_id", "leg", "block", "v0", "v1", "v2", "salt"]).take(pa.array(key[0, ends - 1]))
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x[ends - 1], pa.int32()) for x in at), binaries(out, ends)], names=[*own.schema.names, *KEY, "segments"])

    salt = F.pmod(F.xxhash64("refl_id", "leg", "block"), F.lit(salts)).cast("int").alias("salt")
    rows = rows.select(F.col("refl_id").cast("long"), F.col("leg").cast("int"), "block", *(F.col(f"v{k}").cast("double") for k in range(3)), salt, "points")
    return rows.mapInArrow(dealt, "refl_id long, leg int, block int, v0 double, v1 double, v2 double, salt int, bz int, by int, bx int, segments binary")


def marched(rows: DataFrame, voxels: DataFrame, scene: Scene, salts: int) -> DataFrame:
    """Routed rows to (refl_id, leg, block, stretches): for each ray its stretches of labelled steps in a brick. `last` is the last step that counts and `total` the distance to it, if the ray ends with the stretch."""
    edge, chunk, segment, stretch = EDGE, CHUNK, SEGMENT, STRETCH
    schema = pa.schema([("refl_id", pa.int64()), ("leg", pa.int32()), ("block", pa.int32()), ("stretches", pa.binary())])

    def looked_up(v: np.ndarray, part: np.ndarray, cells: np.ndarray, corner: list[int]) -> tuple[np.ndarray, np.ndarray]:
        rays = Rays(v, part["origin"].astype(np.int64), scene)
        length = part["k1"] - part["k0"] + 1
        width = int(length.max())
        k = part["k0"][:, None] + np.arange(width)
        inside = np.arange(width) < length[:, None]
        cell = np.zeros(k.shape, np.int32)
        for a, low in enumerate(corner):
            cell = cell * edge + rays.at(a, k) - low
        label = np.where(inside, cells[np.where(inside, cell, 0)], 0)
        solid = label != 0
        new = solid.copy()
        new[:, 1:] &= ~solid[:, :-1]
        at = np.flatnonzero(new)
        held = np.bincount((np.cumsum(new) - 1)[solid.ravel()] * 5 + label[solid], minlength=5 * len(at)).reshape(-1, 5)
        row = at // width
        out = np.zeros(len(row), stretch)
        out["sample"], out["counts"], out["limit"] = part["sample"][row], held[:, 1:], rays.limit[row]
        out["start"], out["steps"] = part["k0"][row] + at % width, held.sum(axis=1)
        last = np.minimum(out["start"] + out["steps"] + out["limit"], rays.n[row]) - 1
        for a, size in enumerate(scene.sizes):
            out["total"] += ((rays.at(a, last, row) - rays.at(a, 0)[row]) * size) ** 2
        out["last"], out["total"] = last, np.sqrt(out["total"])
        return out, row

    def march(here: pa.Table, brick: pa.Table) -> pa.Table:
        if not here.num_rows or not brick.num_rows:
            return schema.empty_table()
        cells = np.frombuffer(brick["cells"][0].as_py(), np.int8)
        corner = [brick[b][0].as_py() * edge for b in ("bz", "by", "bx")]
        found, sizes = records(here["segments"], segment)
        whose = np.repeat(np.arange(here.num_rows), sizes)
        v = np.stack([here[f"v{k}"].to_numpy() for k in range(3)], axis=1)
        parts, counts = [np.zeros(0, stretch)], np.zeros(here.num_rows, np.int64)
        for at in range(0, len(found), chunk):
            mine = whose[at : at + chunk]
            out, row = looked_up(v[mine], found[at : at + chunk], cells, corner)
            parts.append(out)
            counts += np.bincount(mine[row], minlength=here.num_rows)
        return pa.table([*(here[c].combine_chunks() for c in ("refl_id", "leg", "block")), binaries(np.concatenate(parts), np.cumsum(counts))], schema=schema)

    dealt = brick_table(voxels).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = rows.groupBy(*KEY, "salt").cogroup(dealt.groupBy(*KEY, "salt"))
    return both.applyInArrow(march, "refl_id long, leg int, block int, stretches binary")


def added_up(found: DataFrame) -> DataFrame:
    """(ray, li, lo, cr, bu, last, total) from stretches, up to the first gap of more than `limit` vacuum steps. A leg and a block of samples, with all their bricks, are a row."""
    stretch, at_once = STRETCH, AT_ONCE

    def bounded(batches):
        for batch in batches:
            lists = batch.column("all")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            held = np.bincount(rows, weights=pc.binary_length(lists.flatten()).to_numpy(), minlength=batch.num_rows)
            yield from parts(batch, held.astype(np.int64) // stretch.itemsize, at_once)

    def totals(batches):
        for batch in bounded(batches):
            lists = batch.column("all")
            found, sizes = records(lists.flatten(), stretch)
            if not len(found):
                continue
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            row = np.repeat(rows, sizes)
            order = np.lexsort((found["start"], found["sample"], row))
            found, row = found[order], row[order]
            first = np.append(True, (row[1:] != row[:-1]) | (found["sample"][1:] != found["sample"][:-1]))
            ray = np.cumsum(first) - 1
            before = np.where(first, 0, np.roll(found["start"] + found["steps"], 1))
            gaps = np.cumsum(found["start"] - before > found["limit"])
            begin = np.flatnonzero(first)
            gaps -= (gaps[begin] - (found["start"][begin] > found["limit"][begin]))[ray]
            kept = gaps == 0
            ends = np.flatnonzero(kept & np.append(first[1:] | ~kept[1:], True))
            counts = [np.bincount(ray[kept], weights=found["counts"][kept, k], minlength=len(begin))[ray[ends]] for k in range(4)]
            own = batch.select(["refl_id", "leg"]).take(pa.array(row[ends]))
            arrays = [own.column("refl_id"), pa.array(found["sample"][ends]), own.column("leg"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(found["last"][ends]), pa.array(found["total"][ends])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*RAY, "li", "lo", "cr", "bu", "last", "total"])

    together = found.groupBy("refl_id", "leg", "block").agg(F.collect_list("stretches").alias("all"))
    return together.mapInArrow(totals, "refl_id long, sample_id long, leg int, li long, lo long, cr long, bu long, last int, total double")


def path_counts(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame, limits: Sequence[int], most_broadcast: int) -> DataFrame:
    """Counts of labelled steps of all rays, as `absorb.shares` takes them. Only the volume's measures, the box of labelled voxels and two counts reach the driver."""
    scene = Scene.of(volume, voxels, limits)
    n_samples, n_legs = samples.count(), legs.count()
    blocks = sample_blocks(samples, n_samples)
    salts = max(1, -(-n_legs * n_samples // GROUP_RAYS))
    if n_samples <= most_broadcast:
        rows = legs.crossJoin(F.broadcast(blocks))
    elif n_legs <= most_broadcast:
        rows = blocks.crossJoin(F.broadcast(legs))
    else:
        # Slices of the legs meet each block by a join.
        slices = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        mine = legs.withColumn("slice", F.pmod(F.xxhash64("refl_id", "leg"), F.lit(slices)).cast("int")).withColumn("block", every(max(1, -(-n_samples // BLOCK))))
        rows = mine.join(blocks.withColumn("slice", every(slices)), ["block", "slice"]).drop("slice")
    return added_up(marched(routed(rows, scene, salts), voxels, scene, salts))
