"""Sets of document ids that are broadcast only while they are small."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Most ids that are sent to every worker at once (8 bytes each).
BROADCAST_IDS = 4_000_000


def small_ids(ids: DataFrame, limit: int = BROADCAST_IDS) -> np.ndarray | None:
    """The distinct non-null ids of a one-column DataFrame, sorted; None if there are more than ``limit``."""
    ids = ids.where(ids[0].isNotNull()).distinct()
    if ids.limit(limit + 1).count() > limit:
        return None
    return np.sort(ids.toPandas().iloc[:, 0].to_numpy(dtype=np.int64))


def member(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in the sorted ``ids``."""
    if not len(ids):
        return np.zeros(len(x), bool)
    i = np.searchsorted(ids, x)
    i[i == len(ids)] = 0
    return ids[i] == x
