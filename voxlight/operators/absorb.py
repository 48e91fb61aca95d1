"""Absorption factors: rays through a labelled volume, path lengths, transmission, mean.

Tables: legs(refl_id, leg, v0, v1, v2), samples(sample_id, z, y, x), voxels(z, y, x, label)
without vacuum, volume(nz, ny, nx, sz, sy, sx) of one row, coefficients(label, mu).
Region mode follows rays from end to end beside the bricks that they can reach (see `regions`).
Where these are too many, join mode expands rays into steps and looks labels up by an equi-join,
and brick mode, for more steps, joins rays with the bricks of the volume that they cross (see `bricks`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import scratch
from . import bricks, regions, sampling
from .bricks import RAY, clip, voxel_at

LABELS = {1: "li", 2: "lo", 3: "cr", 4: "bu"}
#: Vacuum steps in a row that a ray passes in full iteration, and where its exit face has another number (fixed values).
VACUUM_RUN, VACUUM_RUNS = 50, {"FRONT": 10}
#: Estimated steps up to which join mode is chosen.
JOIN_STEPS = 10_000_000
#: Samples that are broadcast at most, and about how many meet a leg in one place where there are more.
BROADCAST_SAMPLES, SAMPLE_BLOCK = sampling.BROADCAST_ROWS, 100_000


def with_samples(legs: DataFrame, samples: DataFrame) -> DataFrame:
    """Every leg with every sample. Up to BROADCAST_SAMPLES samples are broadcast; more are dealt in blocks that meet slices of the legs."""
    count = samples.count()
    if count <= BROADCAST_SAMPLES:
        return legs.crossJoin(F.broadcast(samples))
    blocks, slices = -(-count // SAMPLE_BLOCK), int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = legs.withColumn("slice", F.pmod(F.xxhash64("refl_id", "leg"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    dealt = samples.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    return mine.join(dealt, ["block", "slice"]).drop("block", "slice")


def plan_rays(legs: DataFrame, samples: DataFrame, volume: DataFrame) -> DataFrame:
    """One row for each leg and sample: exit face, step vector and number of steps. The volume is one row."""
    rays = with_samples(legs, samples).crossJoin(F.broadcast(volume))
    heading = g.to_volume([F.col("v0"), F.col("v1"), F.col("v2")])
    origin, shape = [F.col(c) for c in "zyx"], [F.col(c) for c in ("nz", "ny", "nx")]
    rays = rays.withColumn("face", g.exit_face(origin, heading, shape))
    step = g.step_vector(F.col("face"), heading)
    return rays.select(*RAY, "z", "y", "x", "nz", "ny", "nx", "sz", "sy", "sx", "face", *(s.alias(c) for s, c in zip(step, ("dz", "dy", "dx"), strict=True)), (F.col("v2") < 0).alias("down"), g.step_count(F.col("face"), origin, shape, F.col("v1") > 0).alias("n"))


def vacuum_limit(vacuum_run: int | dict[str, int] | None) -> dict[str, int]:
    """How many vacuum steps in a row a ray passes, by exit face: one number for all, or VACUUM_RUN where a face has none of its own."""
    if isinstance(vacuum_run, int):
        return dict.fromkeys(bricks.FACES, vacuum_run)
    return dict.fromkeys(bricks.FACES, VACUUM_RUN) | (VACUUM_RUNS if vacuum_run is None else vacuum_run)


def trace_steps(rays: DataFrame, half_even: bool = False) -> DataFrame:
    """Every step of every ray: ray keys, k, and its voxel (vz, vy, vx); the ray's limit too if it has one."""
    steps = rays.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = {f"v{a}": voxel_at(a, F.col("k"), half_even) for a in "zyx"}
    return steps.select(*RAY, "k", "n", *(["limit"] if "limit" in rays.columns else []), *(e.alias(c) for c, e in at.items()))


def label_steps(steps: DataFrame, voxels: DataFrame, full_iteration: bool = False, vacuum_run: int = VACUUM_RUN) -> DataFrame:
    """Steps with their label, cut at the first vacuum; with full_iteration only after a run of more vacuum steps than the step's `limit`, or than vacuum_run where steps have none."""
    labels = voxels.select(F.col("z").alias("vz"), F.col("y").alias("vy"), F.col("x").alias("vx"), F.col("label").cast("int").alias("label"))
    found = steps.join(labels, ["vz", "vy", "vx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    # Dealt by reflection and sample once: the cut, the lengths and the exponents keep to it, and a reflection with many samples is no large task.
    found = found.repartition("refl_id", "sample_id")
    ray = Window.partitionBy(*RAY)
    if not full_iteration:
        stop = F.min(F.when(F.col("label") == 0, F.col("k"))).over(ray)
        return found.withColumn("stop", stop).where("stop is null or k < stop").drop("stop", "limit")
    limit = F.col("limit") if "limit" in steps.columns else F.lit(vacuum_run)
    order = ray.orderBy("k")
    last_solid = F.max(F.when(F.col("label") != 0, F.col("k"))).over(order)
    run = F.col("k") - F.coalesce(last_solid, F.lit(-1))
    over = F.min(F.when(F.col("run") > limit, F.col("k"))).over(ray)
    return found.withColumn("run", run).withColumn("over", over).where("over is null or k < over").drop("run", "over", "limit")


def path_lengths(labelled: DataFrame, volume: DataFrame, normalize: str = "steps") -> DataFrame:
    """Length in each class of each ray: its share of steps times the straight distance from first to last voxel.

    normalize 'steps' divides by the steps less one, so that the classes add up to one
    voxel more than the distance; 'sum' divides by the steps in classes, so that they add
    up to the distance. A ray of one step has no length. A ray's voxels never turn back along
    an axis, so its ends lie as far apart as the least and the largest place on each: plain
    minima and maxima, and the aggregate stays a hash aggregate on the partitioning that the
    cut at the first vacuum already has.
    """
    ends = [f(f"v{a}").alias(f"{n}_{a}") for a in "zyx" for n, f in (("low", F.min), ("high", F.max))]
    counts = labelled.groupBy(*RAY).agg(F.max("k").alias("last"), *ends, *(F.count_if(F.col("label") == c).alias(name) for c, name in LABELS.items()))
    gap = [(F.col(f"high_{a}") - F.col(f"low_{a}")) * F.col(f"s{a}") for a in "zyx"]
    return shares(counts.crossJoin(F.broadcast(volume)).withColumn("total", F.sqrt(g.dot(gap, gap))), normalize)


def shares(counts: DataFrame, normalize: str) -> DataFrame:
    """Counts of steps, the last step and the distance to it, to lengths."""
    parts = F.col("last") if normalize == "steps" else F.col("li") + F.col("lo") + F.col("cr") + F.col("bu")
    return counts.select(*RAY, *(F.when((F.col("last") > 0) & (parts > 0), F.col("total") * F.col(c) / parts).otherwise(0.0).alias(c) for c in LABELS.values()))


def path_segments(labelled: DataFrame) -> DataFrame:
    """Run-length form: for each ray an ordered array of (start, label)."""
    order = Window.partitionBy(*RAY).orderBy("k")
    starts = labelled.withColumn("before", F.lag("label").over(order)).where("before is null or before <> label")
    return starts.groupBy(*RAY).agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("start"), "label"))).alias("segments"))


def exponent(paths: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Per reflection and sample the sum over legs and classes of coefficient times length. Coefficients: one row a class, at most four."""
    mu = F.broadcast(coefficients.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("label") == c, F.col("mu"))), F.lit(0.0)).alias(f"mu_{name}") for c, name in LABELS.items())))
    each = paths.crossJoin(mu)
    return each.groupBy("refl_id", "sample_id").agg(*(F.sum(F.col(c) * F.col(f"mu_{c}")).alias(f"e_{c}") for c in LABELS.values())).select("refl_id", "sample_id", (F.col("e_li") + F.col("e_lo") + F.col("e_cr") + F.col("e_bu")).alias("exponent"))


def transmission(paths: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Per reflection and sample what passes through."""
    return exponent(paths, coefficients).select("refl_id", "sample_id", F.exp(-F.col("exponent")).alias("transmission"))


def absorption_factor(rates: DataFrame) -> DataFrame:
    """The mean over samples of each reflection."""
    return rates.groupBy("refl_id").agg(F.avg("transmission").alias("factor"), F.count("*").alias("n_samples"))


def binned_quantiles(rates: DataFrame, wanted: Sequence[float], bins: int) -> DataFrame:
    """Per reflection the lower edge of the bin that holds each quantile (column q50 for 0.5), so a value at most 1 / bins below it.

    Samples are counted by bin before any exchange, and a reflection has `bins` counts at
    most, however many samples there are. The quantile is the smallest value that at least
    its share of samples does not exceed.
    """
    counts = rates.groupBy("refl_id", F.floor(F.col("transmission") * bins).cast("int").alias("bin")).agg(F.count("*").alias("k"))
    mine = Window.partitionBy("refl_id")
    summed = counts.withColumns({"upto": F.sum("k").over(mine.orderBy("bin")), "n": F.sum("k").over(mine)})
    return summed.groupBy("refl_id").agg(*((F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("bin"))) / float(bins)).alias(f"q{round(q * 100)}") for q in wanted))


def regional(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame, kind: str, full_iteration: bool = False, vacuum_run: int | dict[str, int] | None = None, coefficients: DataFrame | None = None, forced: bool = False) -> DataFrame | None:
    """What `regions` finds of all rays, or nothing where a block of samples needs more bricks than a task should hold."""
    limits = [vacuum_limit(vacuum_run)[face] if full_iteration else 0 for face in bricks.FACES]
    scene = bricks.Scene.of(volume, voxels, limits)
    # Samples are asked for several times, and few beside the voxels that they are drawn from.
    path = scratch(legs.sparkSession, "samples")
    samples.write.parquet(path)
    samples = legs.sparkSession.read.schema(samples.schema).parquet(path)
    n_samples, n_legs, far = samples.count(), legs.count(), regions.reach(legs, scene)
    # Bricks are asked for as often.
    path = scratch(legs.sparkSession, "bricks")
    regions.bars(voxels).write.parquet(path)
    held = legs.sparkSession.read.parquet(path)
    sizes = regions.block_sizes(n_legs, kind)
    size = sizes[0] if forced else next((n for n in sizes if regions.fits(samples, n_samples, n, far, scene, held)), None)
    if size is None:
        return None
    mu = {}
    if coefficients is not None:
        mu = {r["label"]: r["mu"] for r in coefficients.where(F.col("label").isin(*LABELS)).groupBy("label").agg(F.max("mu").alias("mu")).collect()}
    follow = lambda legs, n: regions.traced(legs, samples, held, scene, far, kind, n, n_samples, size, [mu.get(c) or 0.0 for c in LABELS])
    if kind != "passed":
        return follow(legs, n_legs)
    added = lambda found: found.groupBy("refl_id").agg(F.sum("passed").alias("passed"), F.sum("n").alias("n"))
    if n_samples <= regions.BLOCK:
        return added(follow(legs, n_legs))
    # A leg has many rays: of the reflections whose legs run the same way the first is followed, and the others take what it finds.
    each, firsts = (scratch(legs.sparkSession, name) for name in ("courses", "firsts"))
    regions.courses(legs).write.parquet(each)
    each = legs.sparkSession.read.parquet(each)
    each.groupBy("course").agg(F.min("refl_id").alias("first")).write.parquet(firsts)
    firsts = legs.sparkSession.read.parquet(firsts)
    own = regions.course_legs(firsts)
    found = added(follow(own, own.count())).withColumnRenamed("refl_id", "first")
    return each.join(firsts.join(found, "first"), "course").select("refl_id", "passed", "n")


def stepped(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame, full_iteration: bool, vacuum_run: int | dict[str, int] | None) -> DataFrame:
    """The labelled steps of all rays, a row each."""
    limit = F.element_at(F.create_map(*(F.lit(x) for item in vacuum_limit(vacuum_run).items() for x in item)), F.col("face")) if full_iteration else F.lit(0)
    rays = clip(plan_rays(legs, samples, volume).withColumn("limit", limit.cast("int")), voxels, F.col("limit"))
    return label_steps(trace_steps(rays if full_iteration else rays.drop("limit")), voxels, full_iteration)


def segments(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame, full_iteration: bool = False, vacuum_run: int | dict[str, int] | None = None) -> DataFrame:
    """Run-length form of all rays that start in a labelled voxel: how many steps count, and `path_segments`. Steps are rows only where regions do not fit."""
    found = regional(legs, samples, volume, voxels, "segments", full_iteration, vacuum_run)
    if found is not None:
        return found
    labelled = stepped(legs, samples, volume, voxels, full_iteration, vacuum_run)
    return labelled.groupBy(*RAY).agg(F.count("*").cast("int").alias("steps")).join(path_segments(labelled), list(RAY))


def bounds(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame) -> DataFrame:
    """`boundaries` of all rays, with their numbers of runs and of classes. Steps are rows only where regions do not fit."""
    found = regional(legs, samples, volume, voxels, "boundaries")
    if found is not None:
        return found
    labelled = stepped(legs, samples, volume, voxels, False, None)
    runs = path_segments(labelled).select(*RAY, F.size("segments").alias("runs"), F.size(F.array_distinct(F.transform("segments", lambda s: s["label"]))).alias("classes"))
    return boundaries(labelled).join(runs, list(RAY))


def trace(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame, full_iteration: bool = False, normalize: str = "steps", mode: str = "auto", vacuum_run: int | dict[str, int] | None = None) -> DataFrame:
    """Path lengths of all rays that start in a labelled voxel.

    Mode 'regions' follows rays beside the bricks they can reach, 'join' looks up a row for each step,
    'bricks' a row for each brick crossed; 'auto' takes regions where they fit, else join mode up to
    JOIN_STEPS steps, by an estimate. Rays end at their first vacuum, with full_iteration after more vacuum
    steps in a row than vacuum_run, which may differ by exit face. No mode sends voxels through the driver
    or holds the volume in one place.
    """
    if mode not in ("auto", "regions", "join", "bricks"):
        raise ValueError(f"no mode {mode}")
    if mode in ("auto", "regions"):
        found = regional(legs, samples, volume, voxels, "counts", full_iteration, vacuum_run, forced=mode == "regions")
        if found is not None:
            return shares(found, normalize)
    # A leg becomes many rays: legs are dealt evenly first, however few files they come from.
    legs = legs.repartition(int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "refl_id")
    if mode == "auto":
        meta = volume.first()
        mode = "bricks" if legs.count() * samples.count() * max(meta["nz"], meta["ny"], meta["nx"]) // 2 > JOIN_STEPS else "join"
    if mode == "bricks":
        limits = [vacuum_limit(vacuum_run)[face] if full_iteration else 0 for face in bricks.FACES]
        return shares(bricks.path_counts(legs, samples, volume, voxels, limits, BROADCAST_SAMPLES), normalize)
    return path_lengths(stepped(legs, samples, volume, voxels, full_iteration, vacuum_run), volume, normalize)


def boundaries(labelled: DataFrame) -> DataFrame:
    """Per ray where classes begin and end: first vacuum aside, the last step of crystal, and first and last of loop and bubble."""
    at = lambda f, c: f(F.when(F.col("label") == c, F.col("k")))
    return labelled.groupBy(*RAY).agg(F.max("k").alias("air"), at(F.max, 3).alias("cr_outer"), at(F.min, 2).alias("lo_inner"), at(F.max, 2).alias("lo_outer"), at(F.min, 4).alias("bu_inner"), at(F.max, 4).alias("bu_outer"))


def boundary_counts(bounds: DataFrame) -> DataFrame:
    """Steps of each class from boundaries alone, where each class but liquor is one run: crystal from the start, liquor what is left."""
    run = lambda a, b: F.coalesce(F.col(b) - F.col(a) + 1, F.lit(0))
    lo, bu = run("lo_inner", "lo_outer"), run("bu_inner", "bu_outer")
    inside = F.when(F.col("bu_outer") < F.col("cr_outer"), bu).otherwise(0)
    cr = F.coalesce(F.col("cr_outer") + 1, F.lit(0)) - inside - F.when(F.col("lo_outer") < F.col("cr_outer"), lo).otherwise(0)
    return bounds.select(*RAY, (F.col("air") + 1).alias("steps"), lo.alias("lo"), cr.alias("cr"), bu.alias("bu"), (F.col("air") + 1 - lo - cr - bu).alias("li"))


def method_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per reflection by how many per cent factors of a exceed those of b."""
    return a.select("refl_id", F.col("factor").alias("a")).join(b.select("refl_id", F.col("factor").alias("b")), "refl_id").select("refl_id", ((F.col("a") - F.col("b")) / F.col("b") * 100).alias("difference"))


def factors(legs: DataFrame, samples: DataFrame, volume: DataFrame, voxels: DataFrame, coefficients: DataFrame, mode: str = "auto", full_iteration: bool = False, vacuum_run: int | dict[str, int] | None = None) -> DataFrame:
    """Absorption factors of all reflections; the mode and the end of rays as in `trace`. Without samples there are none.

    In region mode both legs of a reflection meet in one place, so what its samples let pass is added up there,
    and with more samples than a block has reflections whose legs run the same way are followed once.
    """
    if mode in ("auto", "regions"):
        found = regional(legs, samples, volume, voxels, "passed", full_iteration, vacuum_run, coefficients, mode == "regions")
        if found is not None:
            return found.select("refl_id", (F.col("passed") / F.col("n")).alias("factor"), F.col("n").alias("n_samples"))
    return absorption_factor(transmission(trace(legs, samples, volume, voxels, full_iteration, mode=mode, vacuum_run=vacuum_run), coefficients))
