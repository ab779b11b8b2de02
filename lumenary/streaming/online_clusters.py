"""Leader clustering of a face stream, in arrival order per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STATE = "centroid array<double>, members long"
OUT = "shard long, face_id long, label string, score double, created boolean"


class _Leader(StatefulProcessor):
    def __init__(self, thr: float, keep: float) -> None:
        self.thr, self.keep = thr, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "label string", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        labels, centroids, members = [], [], []
        for (label,), (centroid, count) in self.clusters.iterator():
            labels.append(label)
            centroids.append(np.asarray(centroid, dtype=float))
            members.append(count)
        touched: set[int] = set()
        faces = pd.concat(list(rows)).sort_values(["seq", "face_id"])
        out = []
        for face_id, vector in zip(faces["face_id"], faces["embedding"]):
            face = np.asarray(vector, dtype=float)
            scores = [float(c @ face / (np.linalg.norm(c) * np.linalg.norm(face))) for c in centroids]
            best = int(np.argmax(scores)) if scores else -1
            if scores and scores[best] >= self.thr:
                merged = self.keep * centroids[best] + (1 - self.keep) * face
                centroids[best] = np.round(merged / np.linalg.norm(merged), 6)
                members[best] += 1
                out.append((key[0], face_id, labels[best], round(scores[best], 6), False))
            else:
                best = len(labels)
                labels.append("face-" + hashlib.sha1(str(face_id).encode()).hexdigest()[:32])
                centroids.append(face)
                members.append(1)
                out.append((key[0], face_id, labels[best], 1.0, True))
            touched.add(best)
        for i in touched:
            self.clusters.updateValue((labels[i],), (centroids[i].tolist(), int(members[i])))
        yield pd.DataFrame(out, columns=["shard", "face_id", "label", "score", "created"])

    def close(self) -> None:
        pass


def stream_clusters(faces: DataFrame, thr: float = 0.5, keep: float = 0.7) -> DataFrame:
    """faces: shard, face_id, seq, embedding. Match-or-create with a moving centroid, per shard.

    Each shard keeps its clusters in the state store (set the RocksDB provider for large ones).
    """
    return faces.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_Leader(thr, keep), outputStructType=OUT, outputMode="Append", timeMode="None"
    )
