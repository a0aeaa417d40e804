"""Correspondence graphs: integrity, chains, tracks and the default matcher."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import type_compatible


def missing_featuresets(pairs: DataFrame, features: DataFrame, a: str = "image_a", b: str = "image_b", image: str = "image_id") -> DataFrame:
    """Images that pairs (of mode indexed) name but no feature set has: image_id, side."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col(a).alias("image_id"), F.lit("a").alias("side")), F.struct(F.col(b).alias("image_id"), F.lit("b").alias("side")))).alias("s"))
    named = sides.select("s.image_id", "s.side").distinct()
    return named.join(features.select(F.col(image).alias("image_id")), "image_id", "left_anti")


def index_range(matches: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Pairs whose largest index reaches beyond its image's keypoints.

    matches (image_a, image_b, idx_a, idx_b), keypoints (image_id, ...): both sides are
    aggregated before they meet, so the join's input is one row a pair and one an image.
    """
    most = matches.groupBy("image_a", "image_b").agg(F.max("idx_a").alias("most_a"), F.max("idx_b").alias("most_b"))
    sides = most.select(
        "image_a", "image_b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("image_a").alias("image_id"), F.col("most_a").alias("most")), F.struct(F.lit("b").alias("side"), F.col("image_b").alias("image_id"), F.col("most_b").alias("most")))).alias("s")
    ).select("image_a", "image_b", "s.*")
    counts = keypoints.groupBy("image_id").agg(F.count("*").alias("n"))
    return sides.join(counts, "image_id").where("most >= n")


def chain_consecutive(df: DataFrame, group: str, order: str, *more: str) -> DataFrame:
    """Pairs of neighbours in each group's order."""
    w = Window.partitionBy(group).orderBy(order, *more)
    return df.withColumn("next", F.lead(order).over(w)).where("next IS NOT NULL")


def registered_mask(views: DataFrame, run: str, view: str, pose: str) -> DataFrame:
    """Per run, in the order of its views: which have a pose, `mask`, and how many, `registered`."""
    nested = F.array_sort(F.collect_list(F.struct(F.col(view).alias("v"), F.col(pose).isNotNull().alias("ok"))))
    held = views.groupBy(run).agg(nested.alias("m"), F.count(pose).alias("registered"))
    return held.select(run, F.transform("m", lambda s: s["ok"]).alias("mask"), "registered")


def known_observations(observations: DataFrame, keypoints: DataFrame, image: str = "image_id", index: str = "keypoint_idx") -> DataFrame:
    """Track observations whose image has that keypoint; keypoints (image, n) holds their number."""
    return observations.join(keypoints.select(F.col(image), F.col("n").alias("_n")), image).where((F.col(index) >= 0) & (F.col(index) < F.col("_n"))).drop("_n")


def guard_types(pairs: DataFrame, sets: DataFrame, a: str = "image_a", b: str = "image_b", image: str = "image_id", kind: str = "type") -> DataFrame:
    """Add `compatible`: whether both images' descriptor sets come from the same extractor; null if one has none."""
    side = lambda c, t: sets.select(F.col(image).alias(c), F.col(kind).alias(t))
    typed = pairs.join(side(a, "_type_a"), a, "left").join(side(b, "_type_b"), b, "left")
    return typed.withColumn("compatible", type_compatible(F.col("_type_a"), F.col("_type_b"))).drop("_type_a", "_type_b")


def track_table(observations: DataFrame, point: str, *order: str) -> DataFrame:
    """Per point its track length and ordered observations (nested form)."""
    return observations.groupBy(point).agg(F.count("*").alias("track_len"), F.array_sort(F.collect_list(F.struct(*order))).alias("track"))


def nearest(queries: DataFrame, items: DataFrame, kind: str, key: str, vector: str, block: int = 1024) -> DataFrame:
    """For each query (key, kind, vector) its most similar other item of the same kind: a, b, score.

    Exact: queries and items of a kind are dealt to blocks of about `block` rows, and
    every pair of blocks is one group of bounded size, so a kind that holds most rows
    is spread over all tasks. A group yields only the best of each query in it.
    Scores count to nine decimals; ties go to the smaller id. Vectors of one kind have
    one length.
    """
    cast = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(kind).alias("kind"), F.col(vector).cast("array<double>").alias("v"))
    left, right = cast(queries), cast(items)
    blocks = lambda df, name: df.groupBy("kind").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(left, "nx").join(blocks(right, "ny"), "kind")  # one row a kind
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, "kind").select("kind", spot("nx").alias("x"), every("ny").alias("y"), "id", "v", F.lit(True).alias("asks"))
    right = right.join(sizes, "kind").select("kind", every("nx").alias("x"), spot("ny").alias("y"), "id", "v", F.lit(False).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        a, b, u, w = ids[asks], ids[~asks], flat[asks], flat[~asks]
        score = np.zeros((len(a), len(b)))
        for d in range(flat.shape[1]):  # summed in order, the same in every block
            score += u[:, d, None] * w[None, :, d]
        score[a[:, None] == b[None, :]] = -np.inf
        best = score.max(axis=1, initial=-np.inf)
        i, j = np.nonzero((score >= best[:, None] - 2e-9) & (score > -np.inf))
        return pa.table({"a": a[i], "b": b[j], "s": score[i, j]})

    scored = left.unionByName(right).groupBy("kind", "x", "y").applyInArrow(run, "a long, b long, s double")
    best = scored.groupBy("a").agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("b")).alias("nb"))).alias("best"))
    return best.select("a", (-F.col("best.nb")).alias("b"), F.col("best.s").alias("score"))


def mutual(matches: DataFrame) -> DataFrame:
    """Matches (a, b, score) that hold both ways, each once with a < b."""
    back = matches.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return matches.join(back, ["a", "b"]).where("a < b")


def align(left: DataFrame, right: DataFrame, keys: list[str], left_flag: str, right_flag: str) -> DataFrame:
    """Full outer join on positions: which side each key has."""
    a = left.select(*keys).distinct().withColumn(left_flag, F.lit(True))
    b = right.select(*keys).distinct().withColumn(right_flag, F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.coalesce(left_flag, F.lit(False)).alias(left_flag), F.coalesce(right_flag, F.lit(False)).alias(right_flag))
