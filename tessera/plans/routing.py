"""Which tables to join how: graph search over tens of tables, at the driver.

Names are compared by code point wherever a tie has to be broken.
"""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass, field
from itertools import combinations

from .model import Join

FLOOR = {"declared": 0.0, "discovered": 0.02, "inferred-name": 0.3}
TRUST = 0.5


def squared_weight(j: Join) -> float:
    return 1.0 / max(j.confidence, 1e-6) ** 2


def floored_weight(j: Join, uniform: bool = False) -> float:
    return 1.0 if uniform else max(1.0 - j.confidence, FLOOR.get(j.provenance, 0.02))


@dataclass
class Path:
    tables: list[str]
    joins: list[Join]
    cost: float
    low_confidence: bool = False

    @property
    def score(self) -> float:
        return 1.0 / (1.0 + self.cost)

    @property
    def fan_out(self) -> bool:
        return any(j.cardinality != "one-to-one" for j in self.joins)


@dataclass
class Graph:
    """Undirected; of parallel joins the cheapest stays, a join of a table with itself or over a junction is left out."""

    joins: list[Join]
    weight: object = squared_weight
    near: dict[str, dict[str, tuple[float, Join]]] = field(default_factory=dict)

    def __post_init__(self):
        for j in self.joins:
            if j.source == j.target or not j.on:
                continue
            w = self.weight(j)
            for a, b in ((j.source, j.target), (j.target, j.source)):
                known = self.near.setdefault(a, {}).get(b)
                if known is None or (w, j.name) < (known[0], known[1].name):
                    self.near[a][b] = (w, j)

    def shortest(self, start: str, goal: str, without: frozenset[str] = frozenset(), cut: frozenset[tuple[str, str]] = frozenset()) -> Path | None:
        """Least cost, then fewest joins, then least names."""
        heap = [(0.0, 0, (start,))]
        done = set()
        while heap:
            cost, hops, tables = heapq.heappop(heap)
            at = tables[-1]
            if at == goal:
                return Path(list(tables), [self.near[a][b][1] for a, b in zip(tables, tables[1:])], cost)
            if at in done:
                continue
            done.add(at)
            for b, (w, _) in self.near.get(at, {}).items():
                if b not in done and b not in without and (at, b) not in cut:
                    heapq.heappush(heap, (cost + w, hops + 1, (*tables, b)))
        return None

    def k_shortest(self, start: str, goal: str, k: int) -> list[Path]:
        """Loopless paths in order of cost, by deviating from those found."""
        first = self.shortest(start, goal)
        if first is None:
            return []
        found, heap, known = [first], [], {tuple(first.tables)}
        while len(found) < k:
            last = found[-1].tables
            for i in range(len(last) - 1):
                cut = frozenset(e for p in found if p.tables[: i + 1] == last[: i + 1] for e in ((p.tables[i], p.tables[i + 1]),))
                rest = self.shortest(last[i], goal, frozenset(last[:i]), cut)
                if rest is not None and tuple(tables := last[:i] + rest.tables) not in known:
                    known.add(tuple(tables))
                    joins = [self.near[a][b][1] for a, b in zip(tables, tables[1:])]
                    heapq.heappush(heap, (sum(self.weight(j) for j in joins), len(joins), tuple(tables), Path(list(tables), joins, sum(self.weight(j) for j in joins))))
            if not heap:
                break
            found.append(heapq.heappop(heap)[3])
        return found


def co_references(joins: list[Join], confidence: float = 0.75) -> list[Join]:
    """Joins between tables that refer to two or more of the same parents and have no trusted join of their own."""
    parents: dict[str, dict[str, Join]] = {}
    direct = set()
    for j in joins:
        if j.confidence >= TRUST and len(j.on) == 1 and j.source != j.target:
            parents.setdefault(j.source, {}).setdefault(j.target, j)
            direct |= {(j.source, j.target), (j.target, j.source)}
    out = []
    for a, b in combinations(sorted(parents), 2):
        both = sorted(parents[a].keys() & parents[b].keys())
        if len(both) >= 2 and (a, b) not in direct:
            on = tuple((parents[a][p].on[0][0], parents[b][p].on[0][0]) for p in both)
            out.append(Join(a, b, on, "many-to-many", confidence, "co-reference"))
    return out


def join_path(joins: list[Join], tables: list[str], anchor: str | None = None) -> Path | None:
    """A tree that joins ``tables``: the closure of shortest paths, spanned from the anchor.

    Trusted joins only, unless all joins reach more; then the path is marked
    as of low confidence. The anchor is the given fact table, else the table
    with most joins.
    """

    def attempt(usable: list[Join]) -> tuple[int, Path]:
        g = Graph(usable)
        wanted = sorted(set(tables))
        start = anchor if anchor in wanted else max(wanted, key=lambda t: (len(g.near.get(t, {})), [-ord(c) for c in t]))
        inside, order, used, cost = {start}, [start], [], 0.0
        while set(wanted) - inside:
            best = None
            for goal in wanted:
                if goal in inside:
                    continue
                for t in sorted(inside):
                    p = g.shortest(t, goal)
                    if p and (best is None or (p.cost, len(p.joins), p.tables) < (best.cost, len(best.joins), best.tables)):
                        best = p
            if best is None:
                break
            for a, b in zip(best.tables, best.tables[1:]):
                if b not in inside:
                    w, j = g.near[a][b]
                    inside.add(b)
                    order.append(b)
                    used.append(j)
                    cost += w
        return len(set(wanted) & inside), Path(order, used, cost)

    reach, clean = attempt([j for j in joins if j.confidence >= TRUST])
    full_reach, full = attempt(joins)
    if full_reach > reach:
        full.low_confidence = True
        return full
    return clean if reach else None


def best_paths(joins: list[Join], start: str, goal: str, k: int = 3) -> list[Path]:
    """Up to k paths: from three times as many, those at most two joins longer than the best; clean ones first if there are any."""
    found = Graph(joins).k_shortest(start, goal, 3 * k)
    if not found:
        return []
    found = [p for p in found if len(p.joins) <= len(found[0].joins) + 2]
    for p in found:
        p.low_confidence = any(j.confidence < TRUST for j in p.joins)
    clean = [p for p in found if not p.low_confidence]
    return (clean or found)[:k]


@dataclass
class Subgraph:
    tables: list[str]
    joins: list[Join]
    bridges: list[str]
    cost: float
    confidence: float
    connected: bool


def steiner(joins: list[Join], terminals: list[str], uniform: bool = False) -> Subgraph:
    """A small tree over the terminals: spanning tree of their shortest paths, spanned again, leaves cut.

    Joins below trust are not used. Terminals that cannot be connected leave a
    forest, marked as not connected.
    """
    usable = [j for j in joins if j.confidence >= TRUST]
    g = Graph(usable, lambda j: floored_weight(j, uniform))
    paths = []
    for a, b in combinations(sorted(set(terminals)), 2):
        p = g.shortest(a, b)
        if p:
            paths.append((p.cost, len(p.joins), tuple(j.name for j in p.joins), p, a, b))
    chosen = _spanned([(c, h, n, a, b, p) for c, h, n, p, a, b in sorted(paths, key=lambda x: x[:3])])
    edges = {j.name: j for p in chosen for j in p.joins}
    tree = _spanned([(g.weight(j), 0, (n,), j.source, j.target, j) for n, j in sorted(edges.items(), key=lambda x: (g.weight(x[1]), x[0]))])
    while True:
        degree: dict[str, int] = {}
        for j in tree:
            degree[j.source] = degree.get(j.source, 0) + 1
            degree[j.target] = degree.get(j.target, 0) + 1
        bare = {t for t, d in degree.items() if d == 1 and t not in terminals}
        if not bare:
            break
        tree = [j for j in tree if j.source not in bare and j.target not in bare]
    tables = sorted(set(terminals) | {t for j in tree for t in (j.source, j.target)})
    return Subgraph(tables, sorted(tree, key=lambda j: j.name), [t for t in tables if t not in terminals], sum(g.weight(j) for j in tree), min([1.0, *(j.confidence for j in tree)]), len(tables) == len(tree) + 1)


def _spanned(edges: list[tuple]) -> list:
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for *_, a, b, what in edges:
        x, y = root(a), root(b)
        if x != y:
            up[x] = y
            out.append(what)
    return out


def reachable(joins: list[Join], start: str) -> set[str]:
    g, seen, line = Graph(joins), {start}, deque([start])
    while line:
        for b in g.near.get(line.popleft(), {}):
            if b not in seen:
                seen.add(b)
                line.append(b)
    return seen
