"""Sampled Shapley values of trees and forests without scoring a row for each step.

For a row and a permutation of the features, step j has the permutation's first j features at the
row's values and the others at the background's. A tree's leaf is reached by an interval of steps:
where a row and the background part at a node, the row's side is taken from the step that switches
the feature on, the other side before it. So one walk down the tree with an interval for each
(row, permutation) finds every leaf that any step reaches; a leaf adds its value where its interval
begins and takes it away where that ends. What the steps' outputs differ by is all that the
attributions need; it is summed over all trees and then read out by feature.
"""

from __future__ import annotations

import numpy as np

from retentio.operators.tree_shap import NodeTable


def orders_of(hashes: np.ndarray) -> np.ndarray:
    """Step from which each feature is on (rows x permutations x features), the features put in order of their hashes."""
    order = np.argsort(hashes, axis=-1, kind="stable")
    out = np.empty(order.shape, np.uint8 if order.shape[-1] < 255 else np.int32)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(1, order.shape[-1] + 1, dtype=out.dtype), order.shape), axis=-1)
    return out


def _some(open_: np.ndarray) -> np.ndarray:
    """Rows with any true value."""
    return open_.view(np.uint64).ravel() != 0 if open_.shape[1] == 8 else open_.any(1)


def sampled_values(table: NodeTable, x: np.ndarray, on_from: np.ndarray, background: np.ndarray | None = None) -> np.ndarray:
    """Mean change of the output (rows x features) as each feature goes from the background to the row's value.

    ``on_from`` has the step (1 to the number of features) that switches a feature on, for each row and permutation.
    """
    n, m, p = on_from.shape
    background = np.zeros(p) if background is None else background
    columns = np.ascontiguousarray(x.T)
    steps = np.ascontiguousarray(np.moveaxis(on_from, 2, 0))
    # Change of the output at each step; the last place takes what ends after all steps.
    change = np.zeros(n * m * (p + 2))
    cell = (np.arange(n * m) * (p + 2)).reshape(n, m)
    feature, left, right = (c.tolist() for c in (table.feature, table.left, table.right))
    threshold, value = table.threshold.tolist(), table.value.tolist()

    def add(v: float, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        reached = np.flatnonzero(begin < end)
        at = cell.take(rows, axis=0).ravel().take(reached)
        change[at + begin.ravel().take(reached)] += v
        change[at + end.ravel().take(reached)] -= v

    everyone = np.arange(n)
    for root in table.roots.tolist():
        stack = [(root, everyone, np.zeros((n, m), on_from.dtype), np.full((n, m), p + 1, on_from.dtype))]
        while stack:
            node, rows, begin, end = stack.pop()
            f = feature[node]
            if f < 0:
                if value[node]:
                    add(value[node], rows, begin, end)
                continue
            goes_left = columns[f].take(rows) <= threshold[node]
            if background[f] <= threshold[node]:
                away, alike, near, far = ~goes_left, goes_left, left[node], right[node]
            else:
                away, alike, near, far = goes_left, ~goes_left, right[node], left[node]
            part = np.flatnonzero(away)
            if not len(part):
                stack.append((near, rows, begin, end))
                continue
            who, b, e = rows.take(part), begin.take(part, axis=0), end.take(part, axis=0)
            switch = steps[f].take(who, axis=0)
            later, sooner = np.maximum(b, switch), np.minimum(e, switch)
            go = np.flatnonzero(_some(later < e))
            if len(go):
                stack.append((far, who.take(go), later.take(go, axis=0), e.take(go, axis=0)))
            stay = np.flatnonzero(_some(b < sooner))
            same = np.flatnonzero(alike)
            if len(same) + len(stay):
                stack.append((near, np.concatenate([rows.take(same), who.take(stay)]),
                              np.concatenate([begin.take(same, axis=0), b.take(stay, axis=0)]),
                              np.concatenate([end.take(same, axis=0), sooner.take(stay, axis=0)])))
    by_step = change.reshape(n, m, p + 2)
    return np.take_along_axis(by_step, on_from.astype(np.intp), axis=2).mean(axis=1)
