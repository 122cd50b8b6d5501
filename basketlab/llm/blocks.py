"""Comparing all rows of a group in blocks of bounded size."""

from __future__ import annotations

import numpy as np


def star_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what `linked` (left x right, boolean) connects: every
    node of a connected part with the part's smallest id, not every pair."""
    rows, cols = linked.any(1), linked.any(0)
    seen_r, seen_c = ~rows, ~cols
    a, b = [], []
    for start in np.flatnonzero(rows):
        if seen_r[start]:
            continue
        part_r, part_c = [], []
        front = np.array([start])
        seen_r[start] = True
        while len(front):
            part_r.append(front)
            new_c = np.flatnonzero(linked[front].any(0) & ~seen_c)
            seen_c[new_c] = True
            part_c.append(new_c)
            front = np.flatnonzero(linked[:, new_c].any(1) & ~seen_r) if len(new_c) else new_c
            seen_r[front] = True
        ids = np.unique(np.concatenate([left[np.concatenate(part_r)], right[np.concatenate(part_c)]]))
        a.append(ids[1:])
        b.append(np.full(len(ids) - 1, ids[0]))
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
