"""A decision bundle on disk: models, calibrators, cutoffs, distances, policy and regressor, sealed by a manifest."""

from __future__ import annotations

import json

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tracewell.operators import learn
from tracewell.operators.calibrate import Calibrated, Prior
from tracewell.operators.decide import Bundle, ClassDistance
from tracewell.sources import sinks

VERSION = "1"


def _matrix(v) -> list:
    return np.asarray(v, dtype=float).tolist()


def _pairs(table: dict, kind=_matrix) -> list:
    """A table as a list of pairs, since its keys need not be text."""
    return [[k, kind(v)] for k, v in table.items()]


def save(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Write every part below `path`/artifacts and then the manifest of their sizes and digests to `path`/manifest."""
    members = []
    for i, (model, platt) in enumerate(bundle.classifier.members):
        if isinstance(model, Prior):
            kind = {"prior": list(model.shares)}
        else:
            kind = {"models": len(model.models), "votes": list(model.votes)}
            for k, m in enumerate(model.models):
                m.write().overwrite().save(f"{path}/artifacts/model_{i}_{k}")
        members.append(kind | ({"slope": list(platt.slope), "offset": list(platt.offset)} if platt else {}))
    d, r = bundle.distance, bundle.regressor
    parts = {
        "classifier": {"members": members, "folds": bundle.classifier.folds, "status": bundle.classifier.status},
        "distance": {"mean": _matrix(d.mean), "scale": _matrix(d.scale), "centers": _pairs(d.centers), "precisions": _pairs(d.precisions)},
        "policy": {"version": VERSION, "labels": list(bundle.labels), "cutoff": bundle.cutoff, "distance_limit": bundle.distance_limit, "tiers": _pairs(bundle.tiers, str), "regressor_label": bundle.regressor_label},
        "regressor": r and {"mean": _matrix(r.mean), "scale": _matrix(r.scale), "weights": _matrix(r.weights), "intercept": r.intercept},
    }
    for name, part in parts.items():
        spark.createDataFrame([(json.dumps(part),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/artifacts/{name}")
    sinks.file_manifest(spark, f"{path}/artifacts").write.mode("overwrite").json(f"{path}/manifest")


def check(spark: SparkSession, path: str) -> DataFrame:
    """Every file of the bundle with ok, changed, missing or extra."""
    listed = spark.read.schema("file string, length long, sha256 string").json(f"{path}/manifest")
    return sinks.verify_manifest(listed, sinks.file_manifest(spark, f"{path}/artifacts"))


def load(spark: SparkSession, path: str) -> Bundle:
    """The bundle below `path`; refuses it with a ValueError unless every file is as the manifest says."""
    try:
        wrong = [f"{r['file']}: {r['status']}" for r in check(spark, path).where("status <> 'ok'").orderBy("file").collect()]  # a few files
    except (PySparkException, Py4JJavaError) as e:
        raise ValueError(f"a file of the bundle can not be read: {str(e)[:300]}") from e
    if wrong:
        raise ValueError("the bundle is not what its manifest says: " + "; ".join(wrong))

    def part(name: str):
        return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/artifacts/{name}").collect()))  # one line

    policy, c, d, r = (part(n) for n in ("policy", "classifier", "distance", "regressor"))
    if policy["version"] != VERSION:
        raise ValueError(f"bundle version {policy['version']}, this library reads {VERSION}")
    labels = tuple(policy["labels"])
    members = []
    for i, m in enumerate(c["members"]):
        model = Prior(labels, tuple(m["prior"])) if "prior" in m else learn.Classifier(labels, tuple(PipelineModel.load(f"{path}/artifacts/model_{i}_{k}") for k in range(m["models"])), tuple(m.get("votes", ())))
        members.append((model, learn.Platt(labels, tuple(m["slope"]), tuple(m["offset"])) if "slope" in m else None))
    array = lambda pairs: {k: np.array(v) for k, v in pairs}
    distance = ClassDistance(np.array(d["mean"]), np.array(d["scale"]), array(d["centers"]), array(d["precisions"]))
    ridge = r and learn.Ridge(np.array(r["mean"]), np.array(r["scale"]), np.array(r["weights"]), r["intercept"])
    return Bundle(labels, Calibrated(labels, tuple(members), c["folds"], c["status"]), policy["cutoff"], distance, policy["distance_limit"], dict(map(tuple, policy["tiers"])), ridge, policy["regressor_label"])
