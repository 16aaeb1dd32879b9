"""Minimum cuts of small graphs with terminals."""

from __future__ import annotations

from collections import deque

_EPS = 1e-12
#: Neighbours up to which a node looks for one that decides for it.
_FEW = 8


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source side of a minimum cut.

    ``source[i]`` is paid if node i ends on the sink side, ``sink[i]`` if on the
    source side, and an edge's weight if its ends part.  Two reductions that keep
    a minimum cut run until neither applies: a node whose own preference
    outweighs all its edges is settled and folded into its neighbours'
    terminals, and a node with one edge that outweighs all else joins that
    neighbour.  Maximum flow decides the rest.  Ties go to the sink side."""
    n = len(source)
    want = [s - t for s, t in zip(source, sink)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    total = [sum(x.values()) for x in near]
    joined = list(range(n))
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or joined[i] != i:
            continue
        if abs(want[i]) > total[i] or not near[i]:
            side[i] = want[i] > 0
            for j, w in near[i].items():
                want[j] += w if side[i] else -w
                total[j] -= w
                del near[j][i]
                queue.append(j)
            near[i] = {}
        elif len(near[i]) <= _FEW:
            j, w = max(near[i].items(), key=lambda x: x[1])
            if w >= abs(want[i]) + sum(near[i].values()) - w:
                keep, gone = (j, i) if len(near[j]) >= len(near[i]) else (i, j)
                joined[gone] = keep
                want[keep] += want[gone]
                del near[keep][gone], near[gone][keep]
                for k, v in near[gone].items():
                    del near[k][gone]
                    near[k][keep] = near[k].get(keep, 0.0) + v
                    near[keep][k] = near[keep].get(k, 0.0) + v
                    queue.append(k)
                total[keep] += total[gone] - 2 * w
                near[gone] = {}
                queue.append(keep)
    left = [i for i in range(n) if side[i] is None and joined[i] == i]
    if left:
        place = {i: k for k, i in enumerate(left)}
        for i, up in zip(left, _flow([want[i] for i in left], [{place[j]: w for j, w in near[i].items()} for i in left])):
            side[i] = up

    def top(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    return [bool(side[top(i)]) for i in range(n)]


def _flow(want: list[float], near: list[dict[int, float]]) -> list[bool]:
    """The source side by Dinic's algorithm: shortest paths level by level."""
    n = len(want)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c)

    for i, w in enumerate(want):
        if w > 0:
            edge(s, i, w, 0.0)
        elif w < 0:
            edge(i, t, -w, 0.0)
        for j, v in near[i].items():
            if i < j:
                edge(i, j, v, v)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if cap[e] > _EPS and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                full = next(k for k, e in enumerate(path) if cap[e] <= _EPS)
                i = to[path[full] ^ 1]
                del path[full:]
            elif turn[i] < len(out[i]):
                e = out[i][turn[i]]
                if cap[e] > _EPS and level[to[e]] == level[i] + 1:
                    path.append(e)
                    i = to[e]
                else:
                    turn[i] += 1
            elif i == s:
                break
            else:
                level[i] = -1
                i = to[path.pop() ^ 1]
                turn[i] += 1
