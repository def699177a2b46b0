"""Preference learning as a Spark ML stage: an estimator over past choices and a model that scores candidates, both saved and loaded like any other."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.scalars import is_finite
from seriesmill.operators.prefs import dedupe_pairs, fit_pairwise_ridge, gate_model, history_fingerprint, leave_one_group_out, pairwise_differences, score_preference, znorm_group
from seriesmill.operators.select import blend_preference
from seriesmill.sources.shared import discard, stored


class _Shared(Params):
    groupCols = Param(Params._dummy(), "groupCols", "columns of a group of candidates that were offered together", TypeConverters.toListString)
    featureCols = Param(Params._dummy(), "featureCols", "columns of numbers that the preference depends on", TypeConverters.toListString)
    structureCol = Param(Params._dummy(), "structureCol", "column of the score that the preference is blended with; empty: none", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "share of the preference in the blend", TypeConverters.toFloat)

    def _named(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in (self.groupCols, self.featureCols, self.structureCol, self.weight)}


class PreferenceModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds preference (0 to 1, 0.5 without an enabled model) and, with a structureCol, preference_score and quality_score. Everything that it has learned is a parameter."""

    weights = Param(Params._dummy(), "weights", "weight of each feature's z-score", TypeConverters.toListFloat)
    enabled = Param(Params._dummy(), "enabled", "whether the model passed its gate", TypeConverters.toBoolean)
    reason = Param(Params._dummy(), "reason", "why it did not; empty if it did", TypeConverters.toString)
    accuracy = Param(Params._dummy(), "accuracy", "share of held-out pairs in the right order; -1: not known", TypeConverters.toFloat)
    tracks = Param(Params._dummy(), "tracks", "tracks that were learned from", TypeConverters.toInt)
    pairs = Param(Params._dummy(), "pairs", "pairs that were learned from", TypeConverters.toInt)
    fingerprint = Param(Params._dummy(), "fingerprint", "SHA-256 over the pairs of all tracks", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(structureCol="", weight=0.15, weights=[], enabled=False, reason="not fitted", accuracy=-1.0, tracks=0, pairs=0, fingerprint="")

    def get(self, name: str):
        return self.getOrDefault(name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        on, features = self.get("enabled"), self.get("featureCols")
        out = score_preference(dataset, self.get("groupCols"), dict(zip(features, self.get("weights"))) if on else None, on)
        structure = self.get("structureCol")
        return blend_preference(out, F.col("preference"), F.lit(on), self.get("weight"), structure) if structure else out


class PreferenceEstimator(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Learns from groups of candidates of which one was chosen.

    z-scores within the group, differences chosen - rejected, repeated differences of a track (to eight digits) once, ridge weights from sums of all
    tracks, held-out accuracy track by track, and a gate on tracks and accuracy. A group with a value that isn't a finite number, without
    exactly one choice or without a track teaches nothing. An empty history gives a disabled model.
    """

    itemCol = Param(Params._dummy(), "itemCol", "column that tells a group's candidates apart", TypeConverters.toString)
    chosenCol = Param(Params._dummy(), "chosenCol", "boolean column of the choice", TypeConverters.toString)
    trackCol = Param(Params._dummy(), "trackCol", "column of the track, by which pairs are weighted and held out", TypeConverters.toString)
    ridge = Param(Params._dummy(), "ridge", "strength of the penalty", TypeConverters.toFloat)
    minTracks = Param(Params._dummy(), "minTracks", "least number of tracks", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "accuracy that must be exceeded", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, groupCols=None, featureCols=None, itemCol=None, chosenCol="chosen", trackCol="track", structureCol="", weight=0.15, ridge=4.0, minTracks=10, threshold=0.55):
        super().__init__()
        self._setDefault(chosenCol="chosen", trackCol="track", structureCol="", weight=0.15, ridge=4.0, minTracks=10, threshold=0.55)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PreferenceModel:
        get = self.getOrDefault
        features, track, item, chosen = get("featureCols"), get("trackCol"), get("itemCol"), get("chosenCol")
        group = [*[c for c in get("groupCols") if c != track], track]
        if get("ridge") <= 0 or get("minTracks") < 1:
            raise ValueError("ridge must be above 0 and minTracks at least 1")
        fine = F.coalesce(F.min(sum(is_finite(F.col(f"`{c}`")).cast("int") for c in features)), F.lit(0)) == len(features)
        whole = dataset.where(F.col(track).isNotNull()).groupBy(*group).agg(fine.alias("_fine")).where("_fine").drop("_fine")
        rows = dataset.select(*group, item, F.coalesce(F.col(chosen), F.lit(False)).alias(chosen), *features).join(whole, group)
        z = [f"d_z_{c}" for c in features]
        pairs = pairwise_differences(znorm_group(rows, features, group), group, item, chosen, [f"z_{c}" for c in features])
        pairs = stored(dedupe_pairs(pairs, track, z, [*group, item]))
        gate = gate_model(leave_one_group_out(pairs, track, z, get("ridge")), get("minTracks"), get("threshold")).first()
        learned = {r["feature"]: r["weight"] for r in fit_pairwise_ridge(pairs, track, z, get("ridge")).collect()}
        values = F.concat_ws(",", *[F.format_number(F.round(c, 8), 8) for c in z])
        each = history_fingerprint(pairs, track, values).select(F.lit(1).alias("all"), F.concat_ws(":", F.col(track).cast("string"), "fingerprint").alias("v"))
        print_ = history_fingerprint(each, "all", F.col("v")).first()
        discard(pairs)
        model = PreferenceModel()
        model._set(
            **self._named(), weights=[learned[c] for c in z], enabled=bool(gate["enabled"]), reason=gate["reason"] or "", accuracy=-1.0 if gate["accuracy"] is None else float(gate["accuracy"]),
            tracks=int(gate["tracks"]), pairs=int(gate["pairs"]), fingerprint=print_["fingerprint"] if print_ else "",
        )
        return model
