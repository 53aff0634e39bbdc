"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Whether a vector takes part: not null, not empty, no null or non-finite components, not zero."""
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0) & (F.size(v) > 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
