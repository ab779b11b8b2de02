"""Face boxes: suppression of overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _keep(boxes: np.ndarray, scores: np.ndarray, ids: np.ndarray, thr: float) -> np.ndarray:
    order = np.lexsort((-ids, -scores))
    left, top, right, bottom = boxes[order].T
    area = (right - left + 1) * (bottom - top + 1)
    alive = np.ones(len(order), dtype=bool)
    for i in range(len(order)):
        if not alive[i]:
            continue
        later = np.arange(i + 1, len(order))[alive[i + 1 :]]
        wide = np.minimum(right[i], right[later]) - np.maximum(left[i], left[later]) + 1
        high = np.minimum(bottom[i], bottom[later]) - np.maximum(top[i], top[later]) + 1
        common = np.maximum(0, wide) * np.maximum(0, high)
        alive[later[common / (area[i] + area[later] - common) > thr]] = False
    return order[alive]


def nms(detections: DataFrame, thr: float = 0.4, key: str = "media_id") -> DataFrame:
    """Per image: greedy by score, dropping boxes that overlap a kept one by more than thr.

    A group is one image; a detector proposes at most a few thousand boxes on it.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = _keep(
            pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), pdf["det_score"].to_numpy(), pdf["face_id"].to_numpy(), thr
        )
        return pdf.iloc[kept]

    return detections.groupBy(key).applyInPandas(one, detections.schema)
