"""Fixpoints of h-indices by blocks: a task settles all items of one block at once, with the values of items outside as they were; then blocks shift by half."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a half block; a task takes two halves.
HALF = 2_000_000
#: The same for triangles, counted at the lesser ends of their edges, two for each.
TRIPLES = 2_000_000
#: A value that bounds nothing.
FREE = 2**31 - 1


def halves(df: DataFrame, rows: int, key: str, half: int | None = None) -> DataFrame:
    """``df`` of ``rows`` rows with ``h``: ranges of ``key`` of about ``half`` rows each; all rows of one key are in one range."""
    return df.repartitionByRange(max(1, -(-rows // (half or HALF))), key).withColumn("h", F.spark_partition_id())


def tile(h: Column, turn: int) -> Column:
    """The block of a half: halves 0 and 1, 2 and 3, ... in even turns, 1 and 2, 3 and 4, ... in odd ones."""
    return F.floor((h + turn % 2) / 2).cast("int")


def peel(members: np.ndarray, least: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each item the largest k, at most its ``bound``, such that k groups hold it whose other items have k or more as well.

    ``members``: the items of each group, -1 for one outside; ``least``: the least value of those outside; ``weight``: how many such groups the row stands for.
    Levels rise; at each the items with fewer groups go, and with them their groups.
    """
    n, width = len(bound), members.shape[1]
    flat = members.ravel()
    start = np.cumsum(np.bincount(flat + 1, minlength=n + 1))  # those outside come first
    groups = (np.argsort(flat, kind="stable") // width).astype(np.int32)
    count = sum(np.bincount(members[:, i] + 1, weights=weight, minlength=n + 1) for i in range(width)).astype(np.int64)[1:]
    value, here, alive = np.zeros(n, np.int64), np.ones(n, bool), np.ones(len(members), bool)
    falling, fallen = np.argsort(least, kind="stable"), 0
    sorted_least, mark = least[falling], np.zeros(len(members), np.int32)

    def take(gone: np.ndarray) -> np.ndarray:
        """Takes groups away; the items that are left of them."""
        alive[gone] = False
        touched, w = members[gone].ravel(), np.repeat(weight[gone], width)
        keep = touched >= 0
        touched, w = touched[keep], w[keep]
        keep = here[touched]
        touched, where = np.unique(touched[keep], return_inverse=True)
        count[touched] -= np.bincount(where, weights=w[keep], minlength=len(touched)).astype(np.int64)
        return touched

    left = np.arange(n)
    while len(left):
        k = int(np.minimum(count[left], bound[left]).min()) + 1
        if fallen < len(falling):
            k = min(k, max(int(sorted_least[fallen]) + 1, 1))
        upto = int(np.searchsorted(sorted_least, k))
        gone = falling[fallen:upto]
        fallen = upto
        take(gone[alive[gone]])
        front = left[(count[left] < k) | (bound[left] < k)]
        while len(front):
            value[front], here[front] = k - 1, False
            size = start[front + 1] - start[front]
            at = np.repeat(start[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            gone = groups[at]
            gone = gone[alive[gone]]
            mark[gone] = np.arange(len(gone))
            touched = take(gone[mark[gone] == np.arange(len(gone))])  # each once
            front = touched[count[touched] < k]
        left = left[here[left]]
    return value


def settled_vertices(pdf: pd.DataFrame) -> pd.DataFrame:
    """``node, value`` of one block. ``kind`` 0: a vertex and its bound ``x``; 1: an edge inside the block, to ``o``; 2: ``o`` neighbours outside, of value ``x``."""
    s, o, x, kind = pdf.s.to_numpy(), pdf.o.to_numpy(), pdf.x.to_numpy(np.int64), pdf.kind.to_numpy()
    own, edge, far = (np.flatnonzero(kind == k) for k in range(3))
    own = own[np.argsort(s[own])]
    node = s[own]
    one, two, out = (np.searchsorted(node, ids).astype(np.int32) for ids in (s[edge], o[edge], s[far]))
    members = np.concatenate([np.column_stack([one, two]), np.column_stack([out, np.full(len(out), -1, np.int32)])])
    least = np.concatenate([np.full(len(one), FREE, np.int64), x[far]])
    weight = np.concatenate([np.ones(len(one), np.int64), o[far]])
    return pd.DataFrame({"node": node, "value": peel(members, least, weight, x[own])})


def settled_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """``u, v, value`` of the edges of one block. ``kind`` 0: a triangle x < y < z within it; 1: one whose edge yz, of value ``least``, is outside; 2: one of
    which only yz is inside; 3: the bound ``least`` of the edge xy."""
    x, y, z, least, kind = (pdf[c].to_numpy() for c in ("x", "y", "z", "least", "kind"))
    ids = np.unique(np.concatenate([x, y, z]))
    x, y, z = (np.searchsorted(ids, c) for c in (x, y, z))
    own, tri = kind == 3, kind < 3
    sides = ((x, y, kind[tri] < 2), (x, z, kind[tri] < 2), (y, z, kind[tri] != 1))
    edge = np.unique(np.concatenate([np.unique((p[tri] * len(ids) + q[tri])[inside]) for p, q, inside in sides]))
    members = np.column_stack([np.where(inside, np.searchsorted(edge, p[tri] * len(ids) + q[tri]), -1).astype(np.int32) for p, q, inside in sides])
    bound = np.full(len(edge), FREE, np.int64)
    bound[np.searchsorted(edge, x[own] * len(ids) + y[own])] = least[own]
    value = peel(members, np.where(kind[tri] == 0, FREE, least[tri]).astype(np.int64), np.ones(len(members), np.int64), bound)
    return pd.DataFrame({"u": ids[edge // len(ids)], "v": ids[edge % len(ids)], "value": value})


def _numbered(links: pd.DataFrame) -> tuple[np.ndarray, list[int], list[int]]:
    node, number = np.unique(np.concatenate([links.u.to_numpy(), links.v.to_numpy()]), return_inverse=True)
    return node, number[: len(links)].tolist(), number[len(links) :].tolist()


def _join(above: list[int], a: int, b: int) -> bool:
    """Joins the sets of a and b; whether they were apart."""
    while above[a] != a:
        above[a] = a = above[above[a]]
    while above[b] != b:
        above[b] = b = above[above[b]]
    above[a] = b
    return a != b


def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the links (u, v, k) of one task a spanning forest with the largest k: at every level it joins what the links of that level or higher join."""
    rows = list(batches)
    if rows:
        links = pd.concat(rows).sort_values("k", ascending=False, kind="stable")
        node, one, two = _numbered(links)
        above = list(range(len(node)))
        yield links[[_join(above, a, b) for a, b in zip(one, two)]]


def levels(batches: Iterator[pd.DataFrame], ks: list[int]) -> Iterator[pd.DataFrame]:
    """``k, node, component`` of the links (u, v, k) of one task at each level of ``ks``: what links of that level or higher join, named by the least id."""
    rows = list(batches)
    if not rows:
        return
    links = pd.concat(rows).sort_values("k", ascending=False, kind="stable")
    node, one, two = _numbered(links)
    above, seen, falling, done = list(range(len(node))), np.zeros(len(node), bool), -links.k.to_numpy(), 0
    for k in sorted(ks, reverse=True):
        upto = int(np.searchsorted(falling, -k, side="right"))
        for a, b in zip(one[done:upto], two[done:upto]):
            _join(above, a, b)
        seen[one[done:upto]], seen[two[done:upto]], done = True, True, upto
        root = np.array(above)
        while not np.array_equal(root, root[root]):
            root = root[root]
        here = np.flatnonzero(seen)
        root = root[here]
        least = np.full(len(node), len(node))
        np.minimum.at(least, root, here)
        yield pd.DataFrame({"k": k, "node": node[here], "component": node[least[root]]})
