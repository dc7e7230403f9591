"""Copy numbers of nodes and edges of a small graph, as the flow that fits their coverage best."""

from __future__ import annotations

import numpy as np


def penalty(weight, length, copies, coverage) -> float:
    """Sum over elements of length times the squared distance from copies times coverage."""
    w, n, c = np.asarray(weight, float), np.asarray(length, float), np.asarray(copies, float)
    return float((n * (w - c * coverage) ** 2).sum())


def estimated(nodes: list[tuple[float, int]], edges: list[tuple[int, bool, int, bool, float]], coverage: float, rounds: int = 10_000) -> tuple[list[int], list[int]]:
    """(copies of nodes, copies of edges) of least penalty that moves of one unit reach from zero.

    nodes: (weight, length); edges: (a, a_head, b, b_head, weight), a port of either end. One unit enters
    a node by a port and leaves by the other, along a way from end to end or around a cycle; ends are
    ports without an edge. Each move is the cheapest way by Bellman and Ford, adding or taking one unit.
    """
    w, n = np.array([x[0] for x in nodes], float), np.array([x[1] for x in nodes], float)
    e = np.array([x[4] for x in edges], float)
    c, f = np.zeros(len(nodes), int), np.zeros(len(edges), int)
    ports: dict[tuple[int, bool], list[tuple[int, int, bool]]] = {(i, h): [] for i in range(len(nodes)) for h in (True, False)}
    for k, (a, ah, b, bh, _) in enumerate(edges):
        ports[a, ah].append((k, b, bh))
        if (a, ah) != (b, bh):
            ports[b, bh].append((k, a, ah))

    def cost(step):
        node = n * ((w - (c + step) * coverage) ** 2 - (w - c * coverage) ** 2)
        edge = (e - (f + step) * coverage) ** 2 - (e - f * coverage) ** 2
        return np.where(c + step < 0, np.inf, node), np.where(f + step < 0, np.inf, edge)

    def total():
        return penalty(w, n, c, coverage) + penalty(e, np.ones(len(e)), f, coverage)

    def cycle(node, edge):
        """[(node, edge it is entered by)] of a way that comes back on itself and lowers the penalty, if there is one."""
        cost_to, back, last = {}, {}, None
        for _ in range(2 * len(nodes) + 1):
            last = None
            for s, out in ports.items():
                for k, j, jh in out:
                    t, to = cost_to.get(s, 0.0) + edge[k] + node[j], (j, not jh)
                    if t < cost_to.get(to, 0.0) - 1e-9:
                        cost_to[to], back[to], last = t, (s, k), to
            if last is None:
                return None
        for _ in range(2 * len(nodes)):
            if last not in back:
                return None
            last = back[last][0]
        way, at = [], last
        while at in back:
            prev, k = back[at]
            way.append((at[0], k))
            at = prev
            if at == last:
                return way
        return None

    def moves(step):
        node, edge = cost(step)
        # state (i, h): inside node i, about to leave by port h; passing a node costs it once
        start = {(i, h): (node[i], None) for i in range(len(nodes)) for h in (True, False) if not ports[i, not h]}
        best = dict(start)
        for _ in range(len(nodes)):
            new = {}
            for (i, h), (v, _) in best.items():
                for k, j, jh in ports[i, h]:
                    t = v + edge[k] + node[j]
                    if t < best.get((j, not jh), (np.inf,))[0] - 1e-9 and t < new.get((j, not jh), (np.inf,))[0] - 1e-9:
                        new[j, not jh] = (t, (i, h, k))
            if not new:
                break
            best |= new
        ends = [(v, s) for s, (v, _) in best.items() if not ports[s]]
        for v, s in sorted(ends):
            if v >= -1e-9:
                break
            way, seen = [], set()
            while s is not None and s not in seen:
                seen.add(s)
                back = best[s][1]
                way.append((s[0], back[2] if back else None))
                s = (back[0], back[1]) if back else None
            if s is None:
                yield way
        around = cycle(node, edge)
        if around:
            yield around
        for k, (a, ah, b, bh, _) in enumerate(edges):  # cycles closed by one edge
            if a == b and ah != bh and edge[k] + node[a] < -1e-9:
                yield [(a, k)]
            if edge[k] < -1e-9 and step > 0 and f[k] + 1 <= min(c[a], c[b]):
                yield [(None, k)]

    now = total()
    for _ in range(rounds):
        for step, way in ((s, x) for s in (1, -1) for x in moves(s)):
            for i, k in way:
                if i is not None:
                    c[i] += step
                if k is not None:
                    f[k] += step
            after = total()
            if after < now - 1e-9 and (c >= 0).all() and (f >= 0).all():
                now = after
                break
            for i, k in way:
                if i is not None:
                    c[i] -= step
                if k is not None:
                    f[k] -= step
        else:
            break
    return c.tolist(), f.tolist()


#: Mean weight of an element without copies, as a share of the coverage of one; fixed value.
NONE_SHARE = 0.15


class Field:
    """Copy numbers of a graph as a random field: Poisson weights, and ports whose edges should sum to their node.

    nodes: weights; edges: (a, a_head, b, b_head, weight). A port without an edge is an end and free.
    """

    def __init__(self, nodes: list[float], edges: list[tuple[int, bool, int, bool, float]], coverage: float, strength: float = 1.0, most: int = 8) -> None:
        from longweave.operators.cluster import poisson_log

        rate = np.r_[NONE_SHARE, np.arange(1, most + 1)] * coverage
        own = lambda w: -np.asarray(poisson_log(np.round(w)[:, None], rate[None, :]), dtype=float)
        self.node = own(np.asarray(nodes, float)) if nodes else np.zeros((0, most + 1))
        self.edge = own(np.array([e[4] for e in edges], float)) if edges else np.zeros((0, most + 1))
        self.strength, self.most = strength, most
        ports = sorted({(e[0], e[1]) for e in edges} | {(e[2], e[3]) for e in edges})
        at = {p: i for i, p in enumerate(ports)}
        self.port_node = np.array([p[0] for p in ports], dtype=int)
        self.meets = np.zeros((len(ports), len(edges)))
        for k, e in enumerate(edges):
            for p in {(e[0], e[1]), (e[2], e[3])}:
                self.meets[at[p], k] += 1

    def energy(self, c: np.ndarray, f: np.ndarray) -> float:
        """Minus log-likelihood of the weights, and the squared disagreement of ports with their nodes."""
        off = self.meets @ f - c[self.port_node] if len(self.port_node) else np.zeros(0)
        return float(self.node[np.arange(len(c)), c].sum() + self.edge[np.arange(len(f)), f].sum() + self.strength * (off**2).sum())

    def _local(self, c: np.ndarray, f: np.ndarray, i: int) -> np.ndarray:
        """Energy of element i (nodes first) at each copy number, the others as they are."""
        k = np.arange(self.most + 1)
        if i < len(c):
            at = np.nonzero(self.port_node == i)[0]
            sums = self.meets[at] @ f
            return self.node[i] + self.strength * ((sums[:, None] - k[None, :]) ** 2).sum(axis=0)
        i -= len(c)
        at = np.nonzero(self.meets[:, i])[0]
        rest = self.meets[at] @ f - self.meets[at, i] * f[i] - c[self.port_node[at]]
        return self.edge[i] + self.strength * ((rest[:, None] + self.meets[at, i][:, None] * k[None, :]) ** 2).sum(axis=0)

    def sweep(self, c: np.ndarray, f: np.ndarray, rng: np.random.Generator, heat: float = 1.0) -> None:
        """Draw every element anew given the others."""
        for i in rng.permutation(len(c) + len(f)):
            e = self._local(c, f, int(i)) / heat
            p = np.exp(e.min() - e)
            x = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))
            x = min(x, self.most)
            if i < len(c):
                c[i] = x
            else:
                f[i - len(c)] = x

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        return self.node.argmin(axis=1), self.edge.argmin(axis=1)


def gibbs(field: Field, samples: int = 2000, burn: int = 2000, seed: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(copies of nodes, of edges): the most frequent value of each in a chain of sweeps, after two burn-ins."""
    rng = np.random.default_rng(seed)
    c, f = field.first()
    for heat in (2.0, 1.0):
        for _ in range(burn):
            field.sweep(c, f, rng, heat)
    n = np.zeros((len(c) + len(f), field.most + 1), dtype=int)
    at = np.arange(len(n))
    for _ in range(samples):
        field.sweep(c, f, rng)
        n[at, np.r_[c, f]] += 1
    mode = n.argmax(axis=1)
    return mode[: len(c)], mode[len(c) :]


def annealed_chain(field: Field, seed: int, sweeps: int = 200, hot: float = 8.0, cold: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """(energy, copies of nodes, of edges): the best state of one chain of falling heat."""
    rng = np.random.default_rng(seed)
    c, f = field.first()
    best = (field.energy(c, f), c.copy(), f.copy())
    for t in range(sweeps):
        field.sweep(c, f, rng, hot * (cold / hot) ** (t / max(1, sweeps - 1)))
        e = field.energy(c, f)
        if e < best[0]:
            best = (e, c.copy(), f.copy())
    return best


def annealed(spark, field: Field, chains: int = 56, seed: int = 0, sweeps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """The best of many chains, each a row that an executor works on; only results of the best come back."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def run(batches):
        for b in batches:
            got = [annealed_chain(field, s, sweeps) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[2].tolist() for g in got], pa.list_(pa.int64()))], ["energy", "c", "f"])

    rows = spark.range(seed, seed + chains, 1, chains).mapInArrow(run, "energy double, c array<long>, f array<long>")
    best = rows.agg(F.min(F.struct("energy", "c", "f")).alias("x")).select("x.*").first()
    return best["energy"], np.array(best["c"], dtype=int), np.array(best["f"], dtype=int)


def tree_penalty(weight: np.ndarray, copies: np.ndarray, coverage: float) -> float:
    """Sum of squared distances of weights from copies times coverage, over that expectation."""
    mean = np.where(copies > 0, copies, NONE_SHARE) * coverage
    return float(((weight - mean) ** 2 / mean).sum())


def tree_cycles(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    """Edges of the cycle that each edge off a spanning tree of heaviest-first edges closes; ends are joined at node ``n``."""
    root, near, off = list(range(n + 1)), {i: [] for i in range(n + 1)}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (a, b) in enumerate(edges):
        if find(a) == find(b):
            off.append(k)
        else:
            root[find(a)] = find(b)
            near[a].append((b, k))
            near[b].append((a, k))
    out = []
    for k in off:
        a, b = edges[k]
        back: dict[int, tuple[int, int]] = {a: (-1, -1)}
        front = [a]
        while front and b not in back:
            front = [y for x in front for y, e in near[x] if y not in back and not back.update({y: (x, e)})]
        way, x = [k], b
        while x != a:
            x, e = back[x]
            way.append(e)
        out.append(way)
    return out


def _signed(way: list[int], inside: list[bool], n: int) -> np.ndarray | None:
    """A move of one unit around a cycle of elements: what enters a place by one kind leaves by the other, or the sign turns; None if that doesn't close."""
    own, free = way, False
    for i, k in enumerate(way):
        if k >= n and way[i - 1] >= n:  # two joints of ends in a row: between them anything goes
            own, free = (way[i + 1 :] + way[: i - 1] if i else way[1:-1]), True
    step, sign = np.zeros(n, dtype=int), 1
    for i, k in enumerate(own):
        if i and inside[k] == inside[own[i - 1]]:
            sign = -sign
        step[k] += sign
    if not free and len(own) > 1 and (sign if inside[own[0]] != inside[own[-1]] else -sign) != 1:
        return None
    return step


def spanning_tree_copies(weights: list[float], places: list[tuple[int, int]], inside: list[bool], coverage: float, steps: int = 4000, seed: int = 7) -> np.ndarray:
    """Copies of elements between places (ports) by moves of one unit around cycles of a spanning tree, under falling heat.

    Elements are nodes (``inside``, between their two ports) and edges (between ports of nodes), with
    their weights and places. Moves keep the sum of the edges at a port equal to its node's copies. A
    place with one element is an end and joined to all others, so a way from end to end is a cycle too.
    """
    w = np.asarray(weights, float)
    names = sorted({p for e in places for p in e})
    at = {p: i for i, p in enumerate(names)}
    n, m = len(names), len(places)
    degree = np.bincount([at[p] for e in places for p in e], minlength=n)
    order = sorted(range(m), key=lambda k: (-w[k], k))
    edges = [(at[places[k][0]], at[places[k][1]]) for k in order] + [(i, n) for i in range(n) if degree[i] == 1]
    moves = []
    for way in tree_cycles(n, edges):
        step = _signed([order[k] if k < m else k for k in way], inside, m)
        if step is not None and step.any():
            moves.append(step)
    c = np.zeros(m, dtype=int)
    rng = np.random.default_rng(seed)
    now = tree_penalty(w, c, coverage)
    best, kept = now, c.copy()
    for t in range(steps if moves else 0):
        new = c + moves[rng.integers(len(moves))] * (1 if rng.random() < 0.5 else -1)
        if (new < 0).any():
            continue
        after = tree_penalty(w, new, coverage)
        if after <= now or rng.random() < np.exp((now - after) / max(1e-3, 5.0 * (1 - t / steps))):
            c, now = new, after
            if now < best:
                best, kept = now, c.copy()
    return kept


def regressed(weights: list[float], meets: np.ndarray, coverage: float, rounds: int = 2000, rate: float = 0.05, strength: float = 1.0) -> np.ndarray:
    """Real-valued copies of nodes and edges by gradient steps, kept at 0 or more.

    meets: a row for each port, +1 at its edges and -1 at its node; the squared sums are added to the
    squared distance from the weights.
    """
    w = np.asarray(weights, float) / coverage
    x = w.copy()
    pull = np.eye(len(w)) + strength * meets.T @ meets
    step = rate / max(1.0, float(np.linalg.eigvalsh(pull)[-1]) * rate)
    for _ in range(rounds):
        new = np.maximum(0.0, x - step * (pull @ x - w))
        if np.abs(new - x).max() < 1e-9:
            break
        x = new
    return x


def sampled(weights: np.ndarray, coverage: float, most: int = 8, samples: int = 2000, seed: int = 24) -> np.ndarray:
    """Most frequent copy number of each node in a chain over nodes without edges."""
    c, _ = gibbs(Field(list(map(float, weights)), [], coverage, most=most), samples, 200, seed)
    return np.maximum(c, 1)
