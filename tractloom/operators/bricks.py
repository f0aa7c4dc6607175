"""Voxel bricks: blocks of 8 x 8 x 8 voxels of a map or of region masks as one row.

A brick row has ``subject_id, bi, bj, bk`` (voxel index div 8), ``occ`` and packed values. ``occ`` is
eight 64-bit planes, one per i within the brick; bit 8 j + k of a plane says whether that voxel is
there. A map's values are an array of the occupied voxels in that order, so a voxel's place in it is
the number of set bits before its own; ``before`` counts those of earlier planes. Vertices then meet one row per brick instead of one per voxel,
and packing combines a task's voxels before anything is shuffled. Indices may be negative.

``halo`` makes bricks with a rim: each voxel is also written to the bricks of which it is a face
neighbour, so a stencil over the six neighbours takes a single exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tractloom import constants as C
from tractloom.functions.numeric import lit

EDGE = 8
AXES = ("i", "j", "k")
BRICK = ["subject_id", "bi", "bj", "bk"]
#: Voxels that a task packs at a time.
PACKED_ROWS = 1 << 18
#: Edge of a brick with its rim.
WIDE = EDGE + 2


def brick_of(axis: str) -> Column:
    return F.floor(F.col(axis) / EDGE).cast("int")


def _bit() -> Column:
    """Place of a voxel within its plane."""
    return (F.pmod("j", F.lit(EDGE)) * EDGE + F.pmod("k", F.lit(EDGE))).cast("int")


def _plane() -> Column:
    return F.pmod("i", F.lit(EDGE)).cast("int")


def _shift(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def with_brick(df: DataFrame) -> DataFrame:
    """Add the brick of each voxel."""
    return df.withColumns({f"b{a}": brick_of(a) for a in AXES})


def _planes(where: Column | None = None) -> Column:
    """Aggregate: the eight planes of a brick's voxels."""
    here = lambda p: (_plane() == p) if where is None else (_plane() == p) & where
    return F.array(*[F.coalesce(F.bit_or(F.when(here(p), _shift(_bit()))), F.lit(0).cast("bigint")) for p in range(EDGE)])


def _partial(scalars: tuple[str, ...]):
    """The voxels of one brick in one stretch of rows as one row: places and values."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        subject = t["subject_id"].chunk(0)
        code = subject.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.stack([t[a].to_numpy() for a in AXES]).astype(np.int64)
        brick, inner = at // EDGE, at % EDGE
        cell = (inner[0] * EDGE + inner[1]) * EDGE + inner[2]
        order = np.lexsort((cell, brick[2], brick[1], brick[0], code))
        keys = np.stack([code, *brick])[:, order]
        first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        ends, take = pa.array(np.r_[first, len(order)], pa.int32()), pa.array(order)
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(cell[order], pa.int32()), *[t[c].chunk(0).take(take) for c in scalars])]
        heads = pa.array(order[first])
        yield pa.RecordBatch.from_arrays([subject.take(heads), *[pa.array(k[first], pa.int32()) for k in keys[1:]], *lists], [*BRICK, "cells", *scalars])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED_ROWS:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return run


def _merged(scalars: tuple[str, ...]):
    """Bricks of their parts: planes, set bits before each plane, values in the order of the bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            flat, sizes = parts.flatten(), parts.value_lengths().to_numpy()
            cells = flat.field("cells")
            brick = np.repeat(np.repeat(np.arange(len(parts)), sizes), cells.value_lengths().to_numpy())
            cell = cells.flatten().to_numpy().astype(np.int64)
            order = np.lexsort((cell, brick))
            planes = np.zeros(len(parts) * EDGE, dtype=np.uint64)
            np.bitwise_or.at(planes, brick * EDGE + cell // EDGE ** 2, np.uint64(1) << (cell % EDGE ** 2).astype(np.uint64))
            counts = np.bitwise_count(planes).reshape(-1, EDGE).astype(np.int64)
            before = np.cumsum(counts, axis=1) - counts
            every, take = pa.array(np.arange(0, len(planes) + 1, EDGE), pa.int32()), pa.array(order)
            ends = pa.array(np.r_[0, np.cumsum(counts.sum(axis=1))], pa.int32())
            lists = [pa.ListArray.from_arrays(every, pa.array(planes.view(np.int64))), pa.ListArray.from_arrays(every, pa.array(before.reshape(-1), pa.int32())),
                     *[pa.ListArray.from_arrays(ends, flat.field(c).flatten().take(take)) for c in scalars]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in BRICK], *lists], [*BRICK, "occ", "before", *scalars])

    return run


def pack(maps: DataFrame, scalars: tuple[str, ...] = C.SCALARS) -> DataFrame:
    """Bricks of one map row per voxel (at most one): ``occ``, ``before`` and an array of doubles per map; a missing value stays null.

    Each task first packs its own voxels, so that parts of bricks are exchanged, not voxels.
    """
    key = f"subject_id {maps.schema['subject_id'].dataType.simpleString()}, bi int, bj int, bk int"
    values = ", ".join(f"{c} array<double>" for c in scalars)
    rows = maps.select("subject_id", *[F.col(a).cast("int").alias(a) for a in AXES], *[F.col(c).cast("double").alias(c) for c in scalars])
    parts = rows.mapInArrow(_partial(scalars), f"{key}, cells array<int>, {values}")
    whole = parts.groupBy(*BRICK).agg(F.collect_list(F.struct("cells", *scalars)).alias("parts"))
    return whole.mapInArrow(_merged(scalars), f"{key}, occ array<bigint>, before array<int>, {values}")


def pack_masks(voxels: DataFrame, rois: tuple[str, ...]) -> DataFrame:
    """Bricks of region voxels (``roi`` names the region; regions may overlap): planes per region."""
    return with_brick(voxels).groupBy(*BRICK).agg(*[_planes(F.col("roi") == r).alias(r) for r in rois])


def unpack(bricks: DataFrame, scalars: tuple[str, ...] = C.SCALARS) -> DataFrame:
    """One row per voxel again."""
    cells = F.filter(F.sequence(F.lit(0), F.lit(EDGE ** 3 - 1)), lambda c: F.getbit(F.get("occ", F.floor(c / EDGE ** 2).cast("int")), c % EDGE ** 2) == 1)
    rows = bricks.select(*BRICK, *scalars, F.posexplode(cells).alias("_n", "_c"))
    within = (F.floor(F.col("_c") / EDGE ** 2), F.floor(F.col("_c") / EDGE) % EDGE, F.col("_c") % EDGE)
    return rows.select("subject_id", *[(F.col(f"b{a}") * EDGE + w).cast("int").alias(a) for a, w in zip(AXES, within)], *[F.get(c, F.col("_n")).alias(c) for c in scalars])


def _with_places(df: DataFrame) -> DataFrame:
    """Add each voxel's brick, plane and bit, so that later expressions stay small enough to be compiled."""
    return with_brick(df).withColumns({"_plane": _plane(), "_bit": _bit()})


def holds(planes: str) -> Column:
    """Whether a voxel's bit is set in its brick's planes; null without a brick."""
    return F.getbit(F.get(planes, F.col("_plane")), F.col("_bit")) == 1


def _place() -> Column:
    """Place of a voxel in its brick's packed values (the set bits before its own), null if it is not there."""
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("_bit")))
    return F.when(holds("occ"), F.get("before", F.col("_plane")) + F.bit_count(F.get("occ", F.col("_plane")).bitwiseAND(below)))


def _maps(bricks: DataFrame, scalars: tuple[str, ...]) -> DataFrame:
    return bricks.select(*BRICK, "occ", "before", *[F.col(c).alias(f"_{c}") for c in scalars])


def sample(vox_points: DataFrame, bricks: DataFrame, scalars: tuple[str, ...] = C.SCALARS) -> DataFrame:
    """J1 on bricks: nearest-voxel value of each map at every in-bounds vertex (0 where a map is sparse)."""
    p = vox_points.where("inb").drop("inb", "x", "y", "z")
    s = _with_places(p).join(_maps(bricks, scalars), BRICK, "left").withColumn("_at", _place())
    return s.select(*p.columns, *[F.coalesce(F.get(f"_{c}", F.col("_at")), lit(0.0)).alias(c) for c in scalars])


def visit(vox_points: DataFrame, masks: DataFrame, rois: tuple[str, ...], maps: DataFrame | None = None, scalars: tuple[str, ...] = ()) -> DataFrame:
    """Region flags and map values (0 where a map is sparse) of every vertex, from one join by brick; false and null outside the grid."""
    info = masks if maps is None else _maps(maps, scalars).join(masks, BRICK, "full_outer")
    s = _with_places(vox_points).join(info, BRICK, "left")
    if maps is not None:
        s = s.withColumn("_at", _place())
    return s.select(*vox_points.columns, *[(F.col("inb") & F.coalesce(holds(r), F.lit(False))).alias(r) for r in rois],
                    *[F.when(F.col("inb"), F.coalesce(F.get(f"_{c}", F.col("_at")), lit(0.0))).alias(c) for c in scalars])


def passes(vox_points: DataFrame, masks: DataFrame, rois: tuple[str, ...], keys: list[str]) -> DataFrame:
    """J2 on bricks: per streamline, which regions any of its in-bounds vertices lies in."""
    return visit(vox_points, masks, rois).groupBy(*keys).agg(*[F.bool_or(r).alias(r) for r in rois])


def filter_by_roi(vox_points: DataFrame, masks: DataFrame, roi: str, keys: list[str]) -> DataFrame:
    """J2 on bricks: ids of streamlines with any vertex in the mask."""
    p = _with_places(vox_points.where("inb")).join(masks.select(*BRICK, roi), BRICK)
    return p.where(holds(roi)).select(*keys).distinct()


# ------------------------------------------------------------------------------------------ rims

def halo(voxels: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Bricks with a rim of one voxel across each face: ``cells`` (places in the wide brick) and an array per value.

    A voxel goes to its own brick and to those of which it is a face neighbour, 1.75 rows on average.
    Only bricks that hold voxels of their own have a meaning; others are rims alone.
    """
    def at(di: int, dj: int, dk: int) -> Column:
        """The voxel seen from its brick's neighbour in this direction."""
        inner = [F.pmod(a, F.lit(EDGE)) + 1 - EDGE * d for a, d in zip(AXES, (di, dj, dk))]
        cell = (inner[0] * WIDE + inner[1]) * WIDE + inner[2]
        return F.struct(*[(brick_of(a) + d).alias(f"b{a}") for a, d in zip(AXES, (di, dj, dk))], cell.cast("int").alias("cell"))

    copies = [at(0, 0, 0)]
    for n, a in enumerate(AXES):
        for d, edge in ((-1, 0), (1, EDGE - 1)):
            copies.append(F.when(F.pmod(a, F.lit(EDGE)) == edge, at(*[d if m == n else 0 for m in range(3)])))
    rows = voxels.select("subject_id", *values, F.inline(F.array_compact(F.array(*copies))))
    packed = rows.groupBy(*BRICK).agg(F.collect_list(F.struct("cell", *values)).alias("_v"))
    return packed.select(*BRICK, F.col("_v.cell").alias("cells"), *[F.col(f"_v.{v}").alias(v) for v in values])


def stencil(bricks: DataFrame, values: tuple[str, ...], compute: Callable[..., dict[str, np.ndarray]], out: tuple[str, ...]) -> DataFrame:
    """One row per voxel with the columns ``out`` (doubles), which ``compute`` makes of a brick with its rim.

    ``compute`` gets, for some bricks at once, whether a voxel is there and each value (NaN where it is
    not), as arrays of shape (bricks, 10, 10, 10), and returns arrays of shape (bricks, 8, 8, 8).
    """
    inner = np.arange(EDGE ** 3)
    wide = ((inner // EDGE ** 2 + 1) * WIDE + inner // EDGE % EDGE + 1) * WIDE + inner % EDGE + 1
    middle = (slice(None), *[slice(1, -1)] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                n, cells = part.num_rows, part.column("cells")
                flat = np.repeat(np.arange(n), cells.value_lengths().to_numpy()) * WIDE ** 3 + cells.flatten().to_numpy()
                there = np.zeros(n * WIDE ** 3, dtype=bool)
                there[flat] = True
                shape = (n, WIDE, WIDE, WIDE)
                dense = []
                for v in values:
                    a = np.full(n * WIDE ** 3, np.nan)
                    a[flat] = part.column(v).flatten().to_numpy(zero_copy_only=False).astype(float)
                    dense.append(a.reshape(shape))
                there = there.reshape(shape)
                result = compute(there, *dense)
                brick, cell = np.nonzero(there[middle].reshape(n, -1))
                index = np.stack([cell // EDGE ** 2, cell // EDGE % EDGE, cell % EDGE])
                corner = np.stack([part.column(f"b{a}").to_numpy() for a in AXES])[:, brick] * EDGE
                arrays = [part.column("subject_id").take(pa.array(brick)), *[pa.array(x, pa.int32()) for x in corner + index],
                          *[pa.array(result[c].reshape(n, -1)[brick, cell], pa.float64()) for c in out]]
                yield pa.RecordBatch.from_arrays(arrays, ["subject_id", *AXES, *out])

    kind = bricks.schema["subject_id"].dataType.simpleString()
    return bricks.mapInArrow(run, f"subject_id {kind}, i int, j int, k int, " + ", ".join(f"{c} double" for c in out))


def neighbours(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Values before and after each inner voxel along an axis (0 to 2) of arrays (bricks, 10, 10, 10)."""
    cut = [slice(None), *[slice(1, -1)] * 3]
    before, after = list(cut), list(cut)
    before[axis + 1], after[axis + 1] = slice(0, -2), slice(2, None)
    return a[tuple(before)], a[tuple(after)]


def jacobian(field: DataFrame, spacing: tuple[Column, Column, Column]) -> DataFrame:
    """W4 with a single exchange: (subject_id, i, j, k, det), the determinant of I + grad(u) per voxel.

    Central differences where both neighbours are there, one-sided where one is missing, no change
    along an axis without any; the field may be sparse. ``spacing`` is of the row's subject.
    """
    steps = ("_si", "_sj", "_sk")
    names = ("ux", "uy", "uz", *steps)
    bricks = halo(field.withColumns(dict(zip(steps, spacing))), names)

    def compute(there: np.ndarray, *dense: np.ndarray) -> dict[str, np.ndarray]:
        middle = (slice(None), *[slice(1, -1)] * 3)
        g = {}
        for u, a in zip("xyz", dense[:3]):
            here = a[middle]
            for axis, name in enumerate(AXES):
                before, after = neighbours(a, axis)
                step = dense[3 + axis][middle]
                back, on = ~np.isnan(before), ~np.isnan(after)
                g[u, name] = np.where(back & on, (after - before) / (step * 2.0), np.where(on, (after - here) / step, np.where(back, (here - before) / step, 0.0)))
        det = ((1 + g["x", "i"]) * ((1 + g["y", "j"]) * (1 + g["z", "k"]) - g["y", "k"] * g["z", "j"])
               - g["x", "j"] * (g["y", "i"] * (1 + g["z", "k"]) - g["y", "k"] * g["z", "i"])
               + g["x", "k"] * (g["y", "i"] * g["z", "j"] - (1 + g["y", "j"]) * g["z", "i"]))
        return {"det": det}

    return stencil(bricks, names, compute, ("det",))


def face_neighbours(voxels: DataFrame, flag: str) -> DataFrame:
    """Per voxel how many of its six neighbours are there with ``flag`` (a boolean column) set, and its own flag; one exchange."""
    bricks = halo(voxels.withColumn("_f", F.col(flag).cast("double")), ("_f",))

    def compute(there: np.ndarray, f: np.ndarray) -> dict[str, np.ndarray]:
        around = sum(np.nan_to_num(x) for axis in range(3) for x in neighbours(f, axis))
        return {"around": around, "own": np.nan_to_num(f[(slice(None), *[slice(1, -1)] * 3)])}

    return stencil(bricks, ("_f",), compute, ("around", "own"))
