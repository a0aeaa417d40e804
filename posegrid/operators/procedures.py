"""User-supplied procedures as Arrow functions, and reports on whether they keep their word.

extract: rows of images to rows of keypoints; match: the keypoints of two images to
matches; verify: a pair's matches to a subset; map: a scene's views to results.
Each group (a pair, a scene) must fit one task, as the procedures' contract has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYPOINTS = "image_id string, idx long, x float, y float, score float, descriptor array<float>"
MATCHES = "image_a string, image_b string, m long, mode string, idx_a long, idx_b long, xa float, ya float, xb float, yb float, score float"
RESULTS = "scene string, view_idx int, r array<double>, t array<double>, convention string, dense boolean, scale string"


class ContractViolation(ValueError):
    """Traits or options that no procedure may have."""


def _check(condition: bool, rule: str, message: str) -> None:
    if not condition:
        raise ContractViolation(f"{rule}: {message}")


@dataclass(frozen=True)
class MapperTraits:
    requires_correspondences: bool = False
    accepts_calibration: bool = False
    accepts_pose_priors: bool = False
    accepts_depth_priors: bool = False
    emits_dense: bool = False
    metric_capable: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            _check(type(getattr(self, f.name)) is bool, "TRAITS.bool", f"{f.name} must be a bool")


@dataclass(frozen=True)
class MatcherTraits:
    detector_free: bool = False
    persistent_keypoints: bool = False

    def __post_init__(self) -> None:
        for f in fields(self):
            _check(type(getattr(self, f.name)) is bool, "TRAITS.bool", f"{f.name} must be a bool")


@dataclass(frozen=True)
class Options:
    """Options of a mapper or matcher; matchers leave max_views unset."""

    max_views: int | None = None
    seed: int | None = None
    extra: dict | None = None

    def __post_init__(self) -> None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        _check(self.max_views is None or (whole(self.max_views) and self.max_views >= 1), "OPT.max_views", "max_views must be an int of at least 1")
        _check(self.seed is None or whole(self.seed), "OPT.seed", "seed must be an int")
        _check(self.extra is None or isinstance(self.extra, dict), "OPT.extra", "extra must be a mapping")


def extract(images: DataFrame, extractor: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Keypoints of all images, batch by batch."""
    return images.mapInArrow(lambda batches: (extractor(b) for b in batches), KEYPOINTS)


def _renewed(df: DataFrame) -> DataFrame:
    """df with attributes of its own, as the two sides of a cogroup need."""
    return df.toDF(*df.columns).select(*(F.col(c).alias(c) for c in df.columns))


def match(pairs: DataFrame, operands: DataFrame, matcher: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Matches of every pair (image_a, image_b) whose images have operands; each pair is one group.

    operands has an image_id: keypoints for a matcher of features, image rows for one without a detector.
    """
    key = ["image_a", "image_b"]
    left = _renewed(pairs.join(operands.withColumnRenamed("image_id", "image_a"), "image_a"))
    right = _renewed(pairs.join(operands.withColumnRenamed("image_id", "image_b"), "image_b"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: matcher(a, b), MATCHES)


def verify(matches: DataFrame, verifier: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Verified matches of every pair."""
    return matches.groupBy("image_a", "image_b").applyInArrow(lambda t: verifier(t), MATCHES)


def map_views(views: DataFrame, mapper: Callable[..., pa.Table], correspondences: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Results of every scene's views (scene, view_idx, ...).

    With correspondences (scene, ...) the mapper gets the scene's matches, an empty
    table where it has none, as its second argument; without, it gets None if
    options are given. options come last. max_views bounds the views a scene may have.
    """
    more = () if options is None else (options,)
    if options is not None and options.max_views is not None:
        views = _bounded(views, options.max_views)
    if correspondences is not None:
        cogroup = _renewed(views).groupBy("scene").cogroup(_renewed(correspondences).groupBy("scene"))
        empty = _no_results()
        return cogroup.applyInArrow(lambda v, c: mapper(v, c, *more) if v.num_rows else empty, RESULTS)
    return views.groupBy("scene").applyInArrow(lambda t: mapper(t, None, *more) if more else mapper(t), RESULTS)


def _bounded(views: DataFrame, most: int) -> DataFrame:
    """views; reading fails at a scene of more than `most`."""
    large = views.groupBy("scene").agg(F.count("*").alias("_n"))
    fine = F.when(F.col("_n") <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("OPT.max_views: scene "), F.col("scene"))).cast("boolean"))
    return views.join(large, "scene").where(fine).drop("_n")


def _no_results() -> pa.Table:
    numbers = pa.list_(pa.float64())
    return pa.schema([("scene", pa.string()), ("view_idx", pa.int32()), ("r", numbers), ("t", numbers), ("convention", pa.string()), ("dense", pa.bool_()), ("scale", pa.string())]).empty_table()


def refusals(views: DataFrame, mapper: Callable[..., pa.Table]) -> DataFrame:
    """Per scene whether the mapper raises a ContractViolation when it gets no correspondences: scene, refused."""

    def run(t: pa.Table) -> pa.Table:
        try:
            mapper(t, None)
            refused = False
        except ContractViolation:
            refused = True
        return pa.table({"scene": t.column("scene").slice(0, 1), "refused": pa.array([refused])})

    return views.groupBy("scene").applyInArrow(run, "scene string, refused boolean")


def _report(df: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """One row per key and rule: keys, rule_id, holds."""
    table = F.explode(F.array(*(F.struct(F.lit(name).alias("rule_id"), F.coalesce(holds, F.lit(False)).alias("holds")) for name, holds in rules)))
    return df.select(*keys, table.alias("x")).select(*keys, "x.rule_id", "x.holds")


def mapper_report(views: DataFrame, results: DataFrame, traits: MapperTraits, refused: DataFrame | None = None) -> DataFrame:
    """Per scene: enough views, results for exactly the views, dense and metric claims kept.

    With `refused` (see `refusals`) also: a mapper refuses to work without correspondences
    exactly if it says that it requires them.
    """
    seen = views.groupBy("scene").agg(F.count("*").alias("n"), F.sum(F.xxhash64("view_idx").cast("decimal(38,0)")).alias("which"))
    got = results.groupBy("scene").agg(
        F.count("*").alias("m"),
        F.sum(F.xxhash64("view_idx").cast("decimal(38,0)")).alias("what"),
        F.count("r").alias("registered"),
        F.count_if(F.col("r").isNotNull() & ~F.coalesce("dense", F.lit(False))).alias("without_dense"),
        F.count_distinct(F.when(F.col("r").isNotNull(), F.col("convention"))).alias("conventions"),
        F.count_if(F.col("scale") == "metric").alias("metric"),
    )
    both = seen.join(got, "scene", "left")
    needs = []
    if refused is not None:
        both = both.join(refused, "scene", "left")
        needs = [("KIT.requires_correspondences", F.col("refused") == F.lit(traits.requires_correspondences))]
    return _report(
        both,
        ["scene"],
        needs
        + [
            ("KIT.two_views", F.col("n") >= 2),
            ("KIT.poses_align", (F.col("m") == F.col("n")) & (F.col("which") == F.col("what"))),
            ("RES.one_registered", F.col("registered") >= 1),
            ("RES.mixed_convention", F.col("conventions") <= 1),
            ("KIT.emits_dense", F.lit(not traits.emits_dense) | (F.col("without_dense") == 0)),
            ("KIT.metric_capable", F.lit(traits.metric_capable) | (F.col("metric") == 0)),
        ],
    )


def extractor_report(images: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Per image: an extractor gives every image keypoints of finite places and descriptors of one size, numbered from 0 without a gap."""
    finite = lambda c: F.abs(c) < F.lit(float("inf"))
    got = keypoints.groupBy("image_id").agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(finite("x") & finite("y"), F.lit(False))).alias("bad"),
        F.count_distinct(F.size("descriptor")).alias("sizes"),
        F.min("idx").alias("low"),
        F.max("idx").alias("high"),
        F.count_distinct("idx").alias("places"),
    )
    both = images.select("image_id").distinct().join(got, "image_id", "left")
    numbered = F.col("n").isNull() | ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("places") == F.col("n")))
    return _report(both, ["image_id"], [("KIT.extractor_places", F.coalesce("bad", F.lit(0)) == 0), ("KIT.extractor_descriptors", F.coalesce("sizes", F.lit(0)) <= 1), ("KIT.extractor_indices", numbered)])


def matcher_report(matches: DataFrame, keypoints: DataFrame, traits: MatcherTraits, verified: DataFrame | None = None) -> DataFrame:
    """Per pair: the mode its traits promise, indices within the keypoints, and a verifier that keeps mode and never grows."""
    counts = keypoints.groupBy("image_id").agg(F.count("*").alias("k"))
    pairs = matches.groupBy("image_a", "image_b").agg(
        F.count("*").alias("n"), F.min("mode").alias("mode"), F.max("mode").alias("other"), F.max("idx_a").alias("most_a"), F.max("idx_b").alias("most_b"), F.min(F.least("idx_a", "idx_b")).alias("least")
    )
    pairs = pairs.join(counts.select(F.col("image_id").alias("image_a"), F.col("k").alias("ka")), "image_a", "left").join(counts.select(F.col("image_id").alias("image_b"), F.col("k").alias("kb")), "image_b", "left")
    promised = "coordinates" if traits.detector_free else "indexed"
    in_range = F.lit(traits.detector_free) | ((F.col("least") >= 0) & (F.col("most_a") < F.col("ka")) & (F.col("most_b") < F.col("kb")))
    rules = [("KIT.mode", (F.col("mode") == promised) & (F.col("other") == promised)), ("KIT.index_range", in_range)]
    if verified is not None:
        after = verified.groupBy("image_a", "image_b").agg(F.count("*").alias("vn"), F.min("mode").alias("vmode"), F.max("mode").alias("vother"))
        pairs = pairs.join(after, ["image_a", "image_b"], "left")
        rules += [
            ("KIT.verifier_mode", F.col("vn").isNull() | ((F.col("vmode") == F.col("mode")) & (F.col("vother") == F.col("mode")))),
            ("KIT.verifier_never_grows", F.coalesce("vn", F.lit(0)) <= F.col("n")),
        ]
    return _report(pairs, ["image_a", "image_b"], rules)
