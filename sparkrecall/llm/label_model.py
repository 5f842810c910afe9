"""A generative model of yes-votes about a hidden two-valued class, for weak supervision.

A row's votes are the bits of a whole number (at most ``MOST_VOTERS``), so all rows fit
in a table of vote patterns whose size is bounded by the voters, not by the rows. The
model holds the class share and, for each class, how often each voter fires. It is
fitted by expectation maximisation, with the given labels as one more voter that is
right nearly always and mostly silent. Voters that still depend on each other within a
class (conditional mutual information) are joined into groups with one joint table, and
the fit is repeated, so correlated voters are not counted as separate evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Voters at most: their patterns number 65,536 at most.
MOST_VOTERS = 16
#: Conditional mutual information (nats) from which two voters are joined.
DEPENDENT = 0.005
#: Voters in a group at most (its table has two to that power of cells).
GROUP = 6
ROUNDS, SMOOTH = 60, 0.5
#: Labels count as this many earlier rows with this share of right ones.
LABEL_PRIOR = (50.0, 0.98)


@dataclass
class LabelModel:
    groups: list[list[int]]
    share: float                 # of class 1
    tables: list[np.ndarray]     # per group: 2 x cells
    annotator: np.ndarray        # P(label 1 | class 0), P(label 1 | class 1)

    def evidence(self, masks: np.ndarray) -> np.ndarray:
        """Log odds of class 1 by vote pattern."""
        odds = np.full(len(masks), np.log(self.share) - np.log1p(-self.share))
        for group, table in zip(self.groups, self.tables, strict=True):
            cells = _cells(masks, group)
            odds += np.log(table[1, cells]) - np.log(table[0, cells])
        return odds

    def posterior(self, masks: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """P(class 1) by vote pattern, and label where given (-1: none)."""
        odds = self.evidence(masks)
        if labels is not None:
            no, yes = np.log(self.annotator[1] / self.annotator[0]), np.log((1 - self.annotator[1]) / (1 - self.annotator[0]))
            odds = odds + np.where(labels == 1, no, 0.0) + np.where(labels == 0, yes, 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self, voters: int) -> np.ndarray:
        """P(class 1 | voter fires) of each voter."""
        out = np.zeros(voters)
        for group, table in zip(self.groups, self.tables, strict=True):
            for at, voter in enumerate(group):
                fires = (np.arange(table.shape[1]) >> at) & 1 == 1
                one, nil = self.share * table[1, fires].sum(), (1 - self.share) * table[0, fires].sum()
                out[voter] = one / (one + nil)
        return out


def _cells(masks: np.ndarray, group: list[int]) -> np.ndarray:
    return sum(((masks >> v) & 1) << at for at, v in enumerate(group))


def _fit(masks, labels, counts, start, groups) -> LabelModel:
    q = start
    model = None
    for _ in range(ROUNDS):
        w = np.stack([counts * (1 - q), counts * q])
        total = w.sum(1)
        tables = []
        for group in groups:
            cells, size = _cells(masks, group), 1 << len(group)
            table = np.stack([np.bincount(cells, weights=w[y], minlength=size) for y in (0, 1)]) + SMOOTH
            tables.append(table / table.sum(1, keepdims=True))
        rows, right = LABEL_PRIOR
        seen, yes = labels >= 0, labels == 1
        annotator = np.array([(w[y, yes].sum() + rows * (right if y else 1 - right)) / (w[y, seen].sum() + rows) for y in (0, 1)])
        model = LabelModel(groups, float((total[1] + 1) / (total.sum() + 2)), tables, annotator)
        after = model.posterior(masks, labels)
        done = float(np.abs(after - q).max(initial=0.0)) < 1e-6
        q = after
        if done:
            break
    return model


def _dependence(masks, counts, q, i, j) -> float:
    """Conditional mutual information of two voters, given the class."""
    cells, out, total = _cells(masks, [i, j]), 0.0, counts.sum()
    for w in (counts * (1 - q), counts * q):
        joint = np.bincount(cells, weights=w, minlength=4).reshape(2, 2)
        if joint.sum() > 0:
            p = joint / joint.sum()
            free = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
            held = p > 0
            out += joint.sum() / total * float((p[held] * np.log(p[held] / free[held])).sum())
    return out


def fit(masks: np.ndarray, labels: np.ndarray, counts: np.ndarray, yes: list[int], no: list[int]) -> LabelModel:
    """``counts`` rows per vote pattern and label (1, 0 or -1 for none); ``yes`` and
    ``no`` are the voters that speak for and against class 1."""
    if len(yes) + len(no) > MOST_VOTERS:
        raise ValueError(f"at most {MOST_VOTERS} voters")
    votes = sum((masks >> v) & 1 for v in yes) - sum((masks >> v) & 1 for v in no) if len(masks) else masks
    start = np.where(labels >= 0, labels, np.where(votes >= 2, 0.9, np.where(votes == 1, 0.5, 0.02))).astype(float)
    voters = sorted([*yes, *no])
    alone = _fit(masks, labels, counts, start, [[v] for v in voters])
    q = alone.posterior(masks, labels)
    links = sorted(((_dependence(masks, counts, q, i, j), i, j) for i in voters for j in voters if i < j), reverse=True)
    group_of = {v: [v] for v in voters}
    for strength, i, j in links:
        a, b = group_of[i], group_of[j]
        if strength >= DEPENDENT and a is not b and len(a) + len(b) <= GROUP:
            for v in b:
                group_of[v] = a
            a.extend(b)
    groups = sorted({tuple(sorted(g)) for g in group_of.values()})
    return _fit(masks, labels, counts, q, [list(g) for g in groups])
