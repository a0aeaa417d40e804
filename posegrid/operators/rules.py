"""Declarative validation: rules over rows, groups and references, all breaches at once.

A rule's predicate says what must hold; NULL counts as holding, so empty arrays and
aggregates of nothing pass. Element types are the schema's business: a typed
column cannot drift, and Spark has checked it before any rule runs. So these
checks have no rule of their own but a column type: CAL.types, PAIR.geometry,
GRAPH.feature_type, GRAPH.pair_type, VIEW.components, CLOUD.tracks_seq, CLOUD.obs_type,
IMG.type, PVS.typed, PVS.frame, RES.poses_typed, RES.frame, RES.geometry, RES.stats
(a string map) and RES.dense_seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..registry import CAMERA_MODELS, CORRESPONDENCE_MODES, POINTMAP_FRAMES, POSE_CONVENTIONS, ROTATION_TOLERANCE, SCALE_CLASSES, SCALE_PROVENANCES, UNIT_TOLERANCE
from ..schemas import MAX_NUM_IMAGES


@dataclass(frozen=True)
class Rule:
    """One condition; rules are checked in list order."""

    rule_id: str
    holds: Column
    message: str


def _breaches(rules: list[Rule]) -> Column:
    found = [
        F.when(~F.coalesce(r.holds, F.lit(True)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(k).alias("ordinal"), F.lit(r.message).alias("message")))
        for k, r in enumerate(rules)
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def violations(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """Every breach: keys, rule_id, ordinal, message. No shuffle."""
    return df.select(*keys, F.explode(_breaches(rules)).alias("v")).select(*keys, "v.*")


def group_violations(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """Breaches of rules whose predicates are aggregates over the rows of a key."""
    held = df.groupBy(*keys).agg(*(F.coalesce(r.holds, F.lit(True)).alias(f"_r{k}") for k, r in enumerate(rules)))
    return violations(held, [Rule(r.rule_id, F.col(f"_r{k}"), r.message) for k, r in enumerate(rules)], *keys)


def first_violation(df: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """Per key the breach that a fail-fast check would have reported."""
    per_row = df.select(*keys, F.get(_breaches(rules), F.lit(0)).alias("v")).where("v IS NOT NULL")
    least = per_row.groupBy(*keys).agg(F.min(F.struct("v.ordinal", "v.rule_id", "v.message")).alias("v"))
    return least.select(*keys, "v.rule_id", "v.ordinal", "v.message")


def enforce(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df itself; reading it fails at the first row that breaks a rule."""
    first = F.get(_breaches(rules), F.lit(0))
    text = F.concat(first["rule_id"], F.lit(": "), first["message"])
    kept = F.when(first.isNull(), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return df.where(kept)


# Helpers, in the order in which an array is checked: size, then finiteness.


def finite(x: Column) -> Column:
    """False for NaN and both infinities."""
    return F.abs(x) < F.lit(float("inf"))


def all_finite(a: Column) -> Column:
    return F.forall(a, finite)


def sized(a: Column, n: int) -> Column:
    return a.isNotNull() & (F.size(a) == n) & all_finite(a)


def sized_or_null(a: Column, n: int) -> Column:
    return a.isNull() | sized(a, n)


def natural(a: Column) -> Column:
    return F.forall(a, lambda x: x >= 0)


def positive(x: Column) -> Column:
    return x.isNotNull() & (x >= 1)


def chosen(x: Column, names: tuple[str, ...]) -> Column:
    return x.isNotNull() & x.isin(*names)


def named(x: Column) -> Column:
    return x.isNotNull() & (F.length(x) > 0)


def _c(name: str) -> Column:
    return F.col(name)


# Rule lists, each in the order of the fail-fast check.


def rotation_rules(r: str = "r") -> list[Rule]:
    return [
        Rule("ROT.orthonormal", G.orthonormal_error(_c(r)) <= ROTATION_TOLERANCE, "rotation is not orthonormal"),
        Rule("ROT.proper", F.abs(G.determinant(_c(r)) - 1.0) <= ROTATION_TOLERANCE, "rotation has no determinant of 1"),
    ]


def se3_rules(r: str = "r", t: str = "t", convention: str = "convention") -> list[Rule]:
    return [
        Rule("SE3.shape", sized(_c(r), 9) & sized(_c(t), 3), "rotation needs 9 and translation 3 finite values"),
        *rotation_rules(r),
        Rule("SE3.convention", chosen(_c(convention), POSE_CONVENTIONS), "unknown pose convention"),
    ]


def sim3_rules(scale: str = "scale", r: str = "r", t: str = "t", convention: str = "convention") -> list[Rule]:
    return [
        Rule("Sim3.scale", _c(scale).isNotNull() & finite(_c(scale)) & (_c(scale) > 0), "scale is not finite and positive"),
        Rule("Sim3.shape", sized(_c(r), 9) & sized(_c(t), 3), "rotation needs 9 and translation 3 finite values"),
        *rotation_rules(r),
        Rule("Sim3.convention", chosen(_c(convention), POSE_CONVENTIONS), "unknown pose convention"),
    ]


def quaternion_rules(q: str = "q", t: str = "t") -> list[Rule]:
    return [
        Rule("QUAT.unit", sized(_c(q), 4) & (F.abs(G.norm(_c(q), 4) - 1.0) <= UNIT_TOLERANCE), "quaternion is not of unit norm"),
        Rule("TVEC.shape", sized(_c(t), 3), "translation needs 3 finite values"),
    ]


def camera_rules(model: str = "model", width: str = "width", height: str = "height", params: str = "params") -> list[Rule]:
    sizes = F.create_map(*[F.lit(x) for name, p in CAMERA_MODELS for x in (name, len(p.split()))])
    return [
        Rule("CAM.model", chosen(_c(model), tuple(name for name, _ in CAMERA_MODELS)), "unknown camera model"),
        Rule("CAM.size", positive(_c(width)) & positive(_c(height)), "width and height must be at least 1"),
        Rule("CAM.params", _c(params).isNotNull() & all_finite(_c(params)) & (F.size(params) == F.try_element_at(sizes, _c(model))), "wrong number of parameters, or one is not finite"),
    ]


def ray_rules(ray: str = "ray") -> list[Rule]:
    return [
        Rule("RAY.shape", sized(_c(ray), 3), "a ray needs 3 finite values"),
        Rule("RAY.unit", F.abs(G.norm(_c(ray), 3) - 1.0) <= UNIT_TOLERANCE, "ray is not of unit norm"),
    ]


def calibration_rules(intrinsics: str = "intrinsics", rays: str = "rays") -> list[Rule]:
    return [Rule("CAL.xor", _c(intrinsics).isNotNull() != _c(rays).isNotNull(), "exactly one of intrinsics and rays is needed")]


def depth_rules(depth: str = "depth", valid: str = "valid") -> list[Rule]:
    """Per pixel; pixels that are not valid may hold anything, and a null mask means valid."""
    seen = F.coalesce(_c(valid), F.lit(True))
    return [
        Rule("DEPTH.finite", ~seen | (_c(depth).isNotNull() & finite(_c(depth))), "valid depth is not finite"),
        Rule("DEPTH.positive", ~seen | (_c(depth) > 0), "valid depth is not positive"),
    ]


def depth_map_rules(depth: str = "depth", valid: str = "valid", height: str = "height", width: str = "width") -> list[Rule]:
    """Per map: depth array<float> and valid array<boolean> or null, both row by row."""
    n = _c(height) * _c(width)
    seen = F.when(_c(valid).isNull(), _c(depth)).otherwise(F.filter(F.zip_with(_c(depth), _c(valid), lambda d, v: F.when(F.coalesce(v, F.lit(False)), d)), lambda d: d.isNotNull()))
    return [
        Rule("DEPTH.shape", _c(depth).isNotNull() & (F.size(depth) == n), "depth does not fill its size"),
        Rule("DEPTH.valid_shape", _c(valid).isNull() | (F.size(valid) == n), "the mask of valid pixels does not fill the depth's size"),
        Rule("DEPTH.finite", all_finite(seen), "valid depth is not finite"),
        Rule("DEPTH.positive", F.forall(seen, lambda d: d > 0), "valid depth is not positive"),
    ]


def pointmap_rules(xyz: str = "xyz", frame: str = "frame") -> list[Rule]:
    return [
        Rule("PMAP.shape", _c(xyz).isNotNull() & (F.size(xyz) == 3), "a point needs 3 values"),
        Rule("PMAP.frame", chosen(_c(frame), POINTMAP_FRAMES), "unknown pointmap frame"),
    ]


def confidence_rules(conf: str = "conf") -> list[Rule]:
    return [
        Rule("CONF.shape", _c(conf).isNotNull() & finite(_c(conf)), "confidence is not finite"),
        Rule("CONF.range", (_c(conf) >= 0) & (_c(conf) <= 1), "confidence is outside 0 to 1"),
    ]


def mask_rules(mask: str = "mask", height: str = "height", width: str = "width") -> list[Rule]:
    return [Rule("MASK.shape", _c(mask).isNotNull() & (F.size(mask) == _c(height) * _c(width)), "mask does not fill its size")]


def feature_rules(xy: str = "xy", descriptors: str = "descriptors", scores: str = "scores") -> list[Rule]:
    """Per image: xy array<array<float>>, descriptors array<array<float>> or null, scores array<float> or null."""
    n = F.size(xy)
    first = F.size(F.get(_c(descriptors), F.lit(0)))
    return [
        Rule("FEAT.keypoints", _c(xy).isNotNull() & F.forall(_c(xy), lambda p: (F.size(p) == 2) & F.forall(p, finite)), "keypoints need 2 finite values each"),
        Rule("FEAT.descriptors", _c(descriptors).isNull() | ((F.size(descriptors) == n) & F.forall(_c(descriptors), lambda d: F.size(d) == first)), "one descriptor of equal size per keypoint is needed"),
        Rule("FEAT.scores", _c(scores).isNull() | ((F.size(scores) == n) & all_finite(_c(scores))), "one finite score per keypoint is needed"),
    ]


def two_view_rules(prefix: str = "") -> list[Rule]:
    n = _c(f"{prefix}num_inliers")
    return [
        *(Rule("TVG.matrix", sized_or_null(_c(f"{prefix}{m}"), 9), f"{m} needs 9 finite values") for m in "EFH"),
        Rule("TVG.inliers", n.isNull() | (n >= 0), "number of inliers is negative"),
    ]


def pair_rules(mode: str = "mode", idx: str = "idx", a: str = "coords_a", b: str = "coords_b", scores: str = "scores") -> list[Rule]:
    """Per pair: idx array<array<long>>, coords_a and coords_b array<array<float>>, scores array<float>; null where absent."""
    indexed, coords = _c(mode) == "indexed", _c(mode) == "coordinates"
    flat = lambda c: F.forall(_c(c), lambda p: (F.size(p) == 2) & F.forall(p, finite))
    count = F.when(indexed, F.size(idx)).otherwise(F.size(a))
    return [
        Rule("PAIR.mode", chosen(_c(mode), CORRESPONDENCE_MODES), "unknown correspondence mode"),
        Rule("PAIR.indexed_excl", ~indexed | (_c(a).isNull() & _c(b).isNull()), "indexed matches may not carry coordinates"),
        Rule("PAIR.indexed_req", ~indexed | _c(idx).isNotNull(), "indexed matches need indices"),
        Rule("PAIR.indices", ~indexed | F.forall(_c(idx), lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x >= 0)), "indices must be pairs of natural numbers"),
        Rule("PAIR.coords_excl", ~coords | _c(idx).isNull(), "coordinate matches may not carry indices"),
        Rule("PAIR.coords_req", ~coords | (_c(a).isNotNull() & _c(b).isNotNull()), "coordinate matches need both sides"),
        Rule("PAIR.coords_shape", ~coords | (flat(a) & flat(b) & (F.size(a) == F.size(b))), "both sides need as many finite coordinate pairs"),
        Rule("PAIR.scores", _c(scores).isNull() | ((F.size(scores) == count) & all_finite(_c(scores))), "one finite score per match is needed"),
    ]


def graph_key_rules(a: str = "image_a", b: str = "image_b") -> list[Rule]:
    return [
        Rule("GRAPH.pair_key", named(_c(a)) & named(_c(b)), "a pair needs two image ids"),
        Rule("GRAPH.self_pair", _c(a) != _c(b), "an image cannot be paired with itself"),
    ]


def image_id_rules(image: str = "image_id") -> list[Rule]:
    return [Rule("GRAPH.image_id", named(_c(image)), "image id is empty")]


def observation_rules(image: str = "image_id", idx: str = "keypoint_idx") -> list[Rule]:
    return [
        Rule("OBS.image_id", named(_c(image)), "image id is empty"),
        Rule("OBS.keypoint_idx", _c(idx).isNotNull() & (_c(idx) >= 0), "keypoint index is negative"),
    ]


def cloud_rules(x: str = "x", y: str = "y", z: str = "z", rgb: tuple[str, str, str] = ("r", "g", "b")) -> list[Rule]:
    """Per point, long form; tracks are a table of their own."""
    byte = lambda c: _c(c).isNull() | _c(c).between(0, 255)
    return [
        Rule("CLOUD.xyz", finite(_c(x)) & finite(_c(y)) & finite(_c(z)) & _c(x).isNotNull() & _c(y).isNotNull() & _c(z).isNotNull(), "a point needs 3 finite values"),
        Rule("CLOUD.rgb", byte(rgb[0]) & byte(rgb[1]) & byte(rgb[2]), "a colour is outside 0 to 255"),
    ]


def track_rules(points: str = "points", tracks: str = "tracks") -> list[Rule]:
    """Per cloud, nested form."""
    return [
        Rule("CLOUD.tracks_len", _c(tracks).isNull() | (F.size(tracks) == F.size(points)), "one track per point is needed"),
        Rule("CLOUD.track_item", _c(tracks).isNull() | F.forall(_c(tracks), lambda t: t.isNotNull()), "a track may be empty but not null"),
    ]


def prior_rules(weight: str = "weight", covariance: str = "covariance", is_metric: str = "is_metric") -> list[Rule]:
    return [
        *(Rule(x.rule_id.replace("SE3.", "PRIOR.pose."), x.holds, x.message) for x in se3_rules()),
        Rule("PRIOR.weight", _c(weight).isNull() | (finite(_c(weight)) & (_c(weight) >= 0)), "weight is negative or not finite"),
        Rule("PRIOR.covariance", sized_or_null(_c(covariance), 36), "covariance needs 36 finite values"),
        Rule("PRIOR.is_metric", _c(is_metric).isNotNull(), "is_metric is missing"),
    ]


def frame_rules(world: str = "world_frame", scale: str = "scale", provenance: str = "scale_provenance") -> list[Rule]:
    return [
        Rule("FRAME.world_frame", named(_c(world)), "world frame is empty"),
        Rule("FRAME.scale", chosen(_c(scale), SCALE_CLASSES), "unknown scale class"),
        Rule("FRAME.scale_provenance", chosen(_c(provenance), SCALE_PROVENANCES), "unknown scale provenance"),
    ]


def image_rules(height: str = "h", width: str = "w", channels: str = "c", pixels: str = "pixels") -> list[Rule]:
    return [
        Rule("IMG.dtype", F.octet_length(pixels) == _c(height) * _c(width) * F.coalesce(_c(channels), F.lit(1)), "pixels do not fill the image with bytes"),
        Rule("IMG.shape", _c(channels).isNull() | (_c(channels) == 3), "an image has 3 channels or none"),
        Rule("IMG.nonempty", positive(_c(height)) & positive(_c(width)), "image has no pixel"),
    ]


def resolution_rule(*sizes: tuple[str, str]) -> Rule:
    """All known (height, width) pairs must agree; a pair with a null is unknown."""
    known = F.filter(F.array(*(F.when(_c(h).isNotNull() & _c(w).isNotNull(), F.struct(_c(h).alias("h"), _c(w).alias("w"))) for h, w in sizes)), lambda s: s.isNotNull())
    return Rule("VIEW.resolution", F.size(F.array_distinct(known)) <= 1, "parts of a view differ in size")


def view_rules(name: str = "name") -> list[Rule]:
    return [Rule("VIEW.name", _c(name).isNull() | (F.length(name) > 0), "a name may be missing but not empty")]


def option_rules(max_views: str = "max_views") -> list[Rule]:
    return [Rule("OPT.max_views", _c(max_views).isNull() | (_c(max_views) >= 1), "max_views must be at least 1")]


def format_rules() -> list[Rule]:
    return [
        Rule("FMT.id", named(_c("format_id")), "format id is empty"),
        Rule("FMT.kind", named(_c("kind")), "format kind is empty"),
        Rule("FMT.media_type", _c("media_type").isNull() | (F.length("media_type") > 0), "media type is empty"),
        Rule("FMT.description", named(_c("description")), "format description is empty"),
    ]


def sha_rules(sha: str = "sha") -> list[Rule]:
    """64 lower-case hexadecimal digits; the length guards against a final line end."""
    return [Rule("SHA.format", _c(sha).isNotNull() & (F.length(sha) == 64) & _c(sha).rlike("^[0-9a-f]{64}$"), "not a lower-case SHA-256")]


def pair_id_rules(a: str = "image_a", b: str = "image_b") -> list[Rule]:
    return [
        Rule("PAIRID.nonneg", (_c(a) >= 0) & (_c(b) >= 0), "image ids must not be negative"),
        Rule("PAIRID.cap", (_c(a) < MAX_NUM_IMAGES) & (_c(b) < MAX_NUM_IMAGES), "image id exceeds the cap"),
    ]


def version_rules() -> list[Rule]:
    return [Rule("DBVER.components", (_c("minor") < 100) & (_c("patch") < 100) & (_c("revision") < 100), "a version part is 100 or more")]


def dense_shape_rules(height: str = "h", width: str = "w", conf_height: str = "conf_h", conf_width: str = "conf_w") -> list[Rule]:
    """Long form: the sizes of a view's pointmap and confidence, where it has both."""
    return [Rule("RES.dense_shape", (_c(height) == _c(conf_height)) & (_c(width) == _c(conf_width)), "pointmap and confidence differ in size")]


def result_rules(poses: str = "poses", calibrations: str = "calibrations", dense: str = "dense") -> list[Rule]:
    """Per result, nested form: poses array<struct<convention>> and calibrations array, a null entry for a view without;
    dense array<array<struct<kind, h, w>>>, per view null or its pointmap and confidence. calibrations and dense may be null."""
    n = F.size(poses)
    there = F.filter(_c(poses), lambda p: p.isNotNull())
    each = lambda holds: F.forall(_c(dense), lambda d: d.isNull() | F.coalesce(holds(F.get(d, F.lit(0)), F.get(d, F.lit(1)), d), F.lit(False)))
    return [
        Rule("RES.nonempty", _c(poses).isNotNull() & (n >= 1), "a result needs at least one pose"),
        Rule("RES.one_registered", (n < 1) | (F.size(there) >= 1), "no view is registered"),
        Rule("RES.mixed_convention", F.size(F.array_distinct(F.transform(there, lambda p: p["convention"]))) <= 1, "poses mix conventions"),
        Rule("RES.calibrations_aligned", _c(calibrations).isNull() | (F.size(calibrations) == n), "one calibration per view is needed"),
        Rule("RES.dense_aligned", _c(dense).isNull() | (F.size(dense) == n), "one dense entry per view is needed"),
        Rule("RES.dense_pair", each(lambda a, b, d: F.size(d) == 2), "a dense entry is a pair"),
        Rule("RES.dense_member", each(lambda a, b, d: (F.size(d) != 2) | ((a["kind"] == "pointmap") & (b["kind"] == "confidence"))), "a dense entry is a pointmap and a confidence"),
        Rule("RES.dense_shape", each(lambda a, b, d: (F.size(d) != 2) | ((a["h"] == b["h"]) & (a["w"] == b["w"]))), "pointmap and confidence differ in size"),
    ]


# Aggregate rules, for group_violations.


def nonempty_rule(rule_id: str, member: str) -> Rule:
    """A group has a member; groups without one come from a left join, with a null member."""
    return Rule(rule_id, F.count(member) >= 1, "there is no member")


def pose_set_rules(pose: str = "r", convention: str = "convention") -> list[Rule]:
    """Per run: at least one registered pose, one convention among them."""
    return [
        Rule("RES.one_registered", F.count(pose) >= 1, "no view is registered"),
        Rule("RES.mixed_convention", F.count_distinct(F.when(_c(pose).isNotNull(), _c(convention))) <= 1, "poses mix conventions"),
    ]


def viewset_rules(pose: str = "r", convention: str = "convention") -> list[Rule]:
    """Per set: a pose for every view, one convention."""
    return [
        Rule("PVS.one_pose_per_view", F.count(pose) == F.count("*"), "a view has no pose"),
        Rule("PVS.mixed_convention", F.count_distinct(convention) <= 1, "poses mix conventions"),
    ]


def unique_rule(rule_id: str = "FMT.unique") -> Rule:
    return Rule(rule_id, F.count("*") == 1, "key is not unique")
