"""Edit scripts between schema trees.

A schema is a tree: file, columns, and below a column what it holds. Siblings have no order of
their own (place does not count). A script maps nodes to nodes so that ancestors stay ancestors; what is
not mapped is deleted or added, at a cost of 1 a node, and its children go to its parent or come from it.
Renaming costs what the caller's function says. The script found costs least: for every pair of mapped
nodes, ever more inner nodes below them are taken out on either side, as long as that can still pay, and
what then stands directly below is paired by a minimum-cost assignment. Schemas drift by few steps, so
few such sets are looked at; flat files need one assignment. A subtree that is deleted in one place and
added in another as it was is one move, at a cost of 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

INF = 1e9


@dataclass
class Node:
    label: str
    children: list["Node"] = field(default_factory=list)
    place: int = 0
    data: Any = None

    def weight(self) -> float:
        return 1 + sum(c.weight() for c in self.children)


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost perfect assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, done = [INF * 10] * (n + 1), [False] * (n + 1)
        while owner[col]:
            done[col], cur, delta, nxt = True, owner[col], INF * 10, 0
            for j in range(1, n + 1):
                if not done[j]:
                    slack = cost[cur - 1][j - 1] - u[cur] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, col
                    if least[j] < delta:
                        delta, nxt = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            col = nxt
        while col:
            owner[col], col = owner[way[col]], way[col]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


Op = tuple[str, Node | None, Node | None]


def _frontiers(nodes: list[Node], n: int) -> Iterator[tuple[list[Node], list[Node]]]:
    """(nodes that then stand on top, nodes taken out) for each way to take out n inner nodes from the top down."""
    if n == 0:
        yield nodes, []
        return
    for i, head in enumerate(nodes):
        if head.children:  # head is the first that goes
            for j in range(n):
                for below, out in _frontiers(head.children, j):
                    for after, more in _frontiers(nodes[i + 1 :], n - 1 - j):
                        yield nodes[:i] + below + after, [head, *out, *more]


def _signature(n: Node):
    return n.label, tuple(sorted(map(_signature, n.children), key=repr))


def _all(n: Node) -> Iterator[Node]:
    yield n
    for c in n.children:
        yield from _all(c)


def edit_script(a: Node, b: Node, relabel: Callable[[Node, Node], float], together: bool = False) -> tuple[float, list[Op]]:
    """(cost, operations) that turn tree a into tree b at least cost; the roots are mapped to each other.

    Operations are ("keep" | "rename" | "move", old, new), ("delete", old, None) and ("add", None, new).
    relabel(old, new) is 0 for the same node; a cost of 2 or more is never better than delete and add.
    With together, siblings of one label are mapped to each other whatever else would cost.
    """
    memo: dict[tuple[int, int], tuple[float, list[Op]]] = {}

    def gone(n: Node) -> list[Op]:
        return [("delete", x, None) for x in _all(n)]

    def new(n: Node) -> list[Op]:
        return [("add", None, x) for x in _all(n)]

    def paired(xs: list[Node], ys: list[Node]) -> tuple[float, list[Op]]:
        """Nodes that stand side by side: a minimum-cost assignment, the rest deleted or added as a whole."""
        total, ops, open_x, open_y = 0.0, [], list(xs), list(ys)
        if together:
            by_label: dict[str, list[Node]] = {}
            for x in xs:
                by_label.setdefault(x.label, []).append(x)
            open_y, taken = [], set()
            for y in ys:
                if same := by_label.get(y.label):
                    x = same.pop(0)
                    taken.add(id(x))
                    c, o = mapped(x, y)
                    total, ops = total + c, ops + o
                else:
                    open_y.append(y)
            open_x = [x for x in xs if id(x) not in taken]
        n, m = len(open_x), len(open_y)
        where = list(range(n + m))
        if n and m:
            cost = [[0.0] * (n + m) for _ in range(n + m)]
            for i in range(n + m):
                for j in range(n + m):
                    if i < n and j < m:
                        cost[i][j] = mapped(open_x[i], open_y[j])[0]
                    elif i < n:
                        cost[i][j] = open_x[i].weight() if j - m == i else INF
                    elif j < m:
                        cost[i][j] = open_y[j].weight() if i - n == j else INF
            where = assignment(cost)
        else:
            where = [m + i for i in range(n)] + list(range(m))
        for i, j in enumerate(where):
            if i < n and j < m:
                c, o = mapped(open_x[i], open_y[j])
            elif i < n:
                c, o = open_x[i].weight(), gone(open_x[i])
            elif j < m:
                c, o = open_y[j].weight(), new(open_y[j])
            else:
                continue
            total, ops = total + c, ops + o
        return total, ops

    def forest(xs: list[Node], ys: list[Node]) -> tuple[float, list[Op]]:
        best = paired(xs, ys)
        inner = sum(1 for n in (*xs, *ys) for z in _all(n) if z.children)
        for k in range(1, inner + 1):
            if k >= best[0]:  # taking out k nodes costs k already
                break
            for i in range(k + 1):
                for left, out in _frontiers(xs, i):
                    for right, put in _frontiers(ys, k - i):
                        if k + abs(sum(x.weight() for x in left) - sum(y.weight() for y in right)) >= best[0]:
                            continue  # as many nodes at least must go or come besides
                        c, o = paired(left, right)
                        if k + c < best[0]:
                            best = (k + c, [("delete", x, None) for x in out] + [("add", None, y) for y in put] + o)
        return best

    def mapped(x: Node, y: Node) -> tuple[float, list[Op]]:
        key = (id(x), id(y))
        if key not in memo:
            kind = "rename" if x.label != y.label else "move" if x.place != y.place else "keep"
            c, o = forest(x.children, y.children) if x.children or y.children else (0.0, [])
            memo[key] = (relabel(x, y) + c, [(kind, x, y)] + o)
        return memo[key]

    return _with_moves(*mapped(a, b))


def _with_moves(cost: float, ops: list[Op]) -> tuple[float, list[Op]]:
    """The script with each subtree that goes in one place and comes in another as it was as one move, largest first."""
    left = {id(x): x for k, x, _ in ops if k == "delete"}
    came = {id(y): y for k, _, y in ops if k == "add"}
    whole = lambda n, side: all(id(z) in side for z in _all(n))
    targets: dict = {}
    for y in came.values():
        if whole(y, came):
            targets.setdefault(_signature(y), []).append(y)
    moves: list[Op] = []
    for x in sorted(left.values(), key=lambda x: -x.weight()) if targets else ():
        if whole(x, left):
            y = next((y for y in targets.get(_signature(x), ()) if whole(y, came)), None)
            if y is not None:
                moves.append(("move", x, y))
                cost -= x.weight() + y.weight() - 1
                for z in _all(x):
                    del left[id(z)]
                for z in _all(y):
                    del came[id(z)]
    if not moves:
        return cost, ops
    return cost, [o for o in ops if o[0] not in ("delete", "add") or id(o[1] or o[2]) in (left if o[0] == "delete" else came)] + moves
