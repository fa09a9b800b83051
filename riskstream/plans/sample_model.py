"""A small model given as data: what ``tree_score`` and ``stream_score_model`` score with."""

from __future__ import annotations

from ..operators.boosting import Tree

_CUTS = {
    "amount": [50.0, 500.0, 5000.0],
    "amount_zscore": [0.0, 1.0, 2.0, 3.0],
    "hour_of_day": [4.0, 21.0],
    "velocity_score": [0.1, 0.3, 0.7],
    "distance_from_last": [100.0, 1200.0],
    "time_since_last_txn": [60.0, 3600.0],
    "merchant_risk_score": [0.01, 0.1, 0.5],
}
_COLUMNS = list(_CUTS)


def _tree(splits: dict[int, tuple[str, float, bool]], leaves: dict[int, float]) -> Tree:
    """splits: node -> (column, cut, missing goes left); leaves: node -> value."""
    t = Tree.empty(3)
    for i, (c, cut, left) in splits.items():
        t.feature[i], t.cut[i], t.missing_left[i] = _COLUMNS.index(c), _CUTS[c].index(cut), left
    for i, v in leaves.items():
        t.value[i] = v
    return t


SAMPLE_MODEL = {"columns": _COLUMNS, "cuts": _CUTS, "trees": [
    _tree({0: ("merchant_risk_score", 0.1, True), 1: ("amount_zscore", 2.0, True), 2: ("velocity_score", 0.3, False),
           3: ("hour_of_day", 4.0, False)}, {4: 0.35, 5: 0.8, 6: 1.4, 7: -0.2, 8: -0.9}),
    _tree({0: ("distance_from_last", 1200.0, True), 1: ("amount", 500.0, False), 2: ("time_since_last_txn", 3600.0, True)},
          {3: -0.6, 4: 0.15, 5: 1.1, 6: 0.4}),
    _tree({0: ("amount_zscore", 3.0, True), 1: ("merchant_risk_score", 0.01, False)}, {2: 0.9, 3: -0.5, 4: 0.05}),
]}

#: The same trees over the columns of the point-in-time features.
_SERVED = {"distance_from_last": "distance_from_last_txn_km", "time_since_last_txn": "time_since_last_txn_seconds"}
STREAM_MODEL = {"columns": [_SERVED.get(c, c) for c in _COLUMNS], "cuts": {_SERVED.get(c, c): v for c, v in _CUTS.items()},
                "trees": SAMPLE_MODEL["trees"]}
