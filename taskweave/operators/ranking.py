"""The best k of blocks of scores, inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd


def candidates(scores: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int, found: np.ndarray | None = None) -> pd.DataFrame:
    """Rows (query_id, id, score) that can still be among the k best of each query, for one block of scores.

    All scores tied (after rounding) with the k-th stay in, so ties are settled later by id. ``found`` marks the
    cells that count as results at all.
    """
    scores = np.round(scores, 6) + 0.0
    keep = np.ones(scores.shape, bool) if found is None else found
    if scores.shape[1] > k:
        open_ = scores if found is None else np.where(found, scores, -np.inf)
        bound = np.partition(open_, scores.shape[1] - k, axis=1)[:, -k]
        keep = keep & (scores >= bound[:, None])
    q, v = np.nonzero(keep)
    return pd.DataFrame({"query_id": names[q], "id": ids[v], "score": scores[q, v]})


def cut(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query, ties by id."""
    ordered = rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)
