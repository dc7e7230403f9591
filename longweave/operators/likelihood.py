"""How likely a read is given a template, and how single edits of the template would change that.

A read arises from a template base by base: copied or mistaken, left out, or with bases put in between.
Likelihoods sum over all alignments. One forward and one backward table give the change for every edit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from longweave.operators.align import edit_align

BASES = "ACGT"
#: Edits at a position: another base (4), a base put in before (4), the base left out.
EDITS = [("sub", b) for b in BASES] + [("ins", b) for b in BASES] + [("del", "")]


@dataclass(frozen=True)
class Rates:
    """Chances per template base of a mistake, an insertion before it, and a deletion."""

    mismatch: float = 0.02
    insertion: float = 0.02
    deletion: float = 0.02

    @property
    def logs(self) -> tuple[float, float, float, float]:
        keep = 1 - self.deletion - self.insertion
        return float(np.log(keep * (1 - self.mismatch))), float(np.log(keep * self.mismatch / 3)), float(np.log(self.insertion / 4)), float(np.log(self.deletion))


def _insert(base: np.ndarray, gap: float) -> np.ndarray:
    """Row with any number of insertions after each entry: out[j] = logsum over i <= j of base[i] + (j - i) gap."""
    along = gap * np.arange(len(base))
    return np.logaddexp.accumulate(base - along) + along


def tables(read: str, template: str, rates: Rates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, forward, backward): rows by template bases used, columns by read bases used.

    entry is forward before insertions in its row, so each alignment enters a row once.
    """
    match, miss, gap, drop = rates.logs
    x = np.array(list(read))
    n, m = len(template), len(read)
    entry, fwd, bwd = (np.full((n + 1, m + 1), -np.inf) for _ in range(3))
    entry[0, 0] = 0.0
    fwd[0] = _insert(entry[0], gap)
    emit = {b: np.where(x == b, match, miss) for b in BASES}
    for i in range(1, n + 1):
        entry[i] = fwd[i - 1] + drop
        entry[i, 1:] = np.logaddexp(entry[i, 1:], fwd[i - 1, :-1] + emit[template[i - 1]])
        fwd[i] = _insert(entry[i], gap)
    last = np.full(m + 1, -np.inf)
    last[m] = 0.0
    bwd[n] = _insert(last[::-1], gap)[::-1]
    for i in range(n - 1, -1, -1):
        on = bwd[i + 1] + drop
        on[:-1] = np.logaddexp(on[:-1], bwd[i + 1, 1:] + emit[template[i]])
        bwd[i] = _insert(on[::-1], gap)[::-1]
    return entry, fwd, bwd


def log_likelihood(read: str, template: str, rates: Rates) -> float:
    return float(tables(read, template, rates)[1][-1, -1])


def _total(a: np.ndarray) -> float:
    top = a.max()
    return float(top + np.log(np.exp(a - top).sum())) if np.isfinite(top) else -np.inf


def edit_gains(read: str, template: str, rates: Rates) -> np.ndarray:
    """Change of the log-likelihood for each template position (rows) and edit (columns as EDITS)."""
    match, miss, gap, drop = rates.logs
    entry, fwd, bwd = tables(read, template, rates)
    x, now = np.array(list(read)), fwd[-1, -1]
    out = np.zeros((len(template), len(EDITS)))

    def through(row: np.ndarray, base: str, rest: np.ndarray) -> float:
        into = row + drop
        into[1:] = np.logaddexp(into[1:], row[:-1] + np.where(x == base, match, miss))
        return _total(into + rest)

    for i, own in enumerate(template):
        for k, (kind, b) in enumerate(EDITS):
            if kind == "sub":
                out[i, k] = 0.0 if b == own else through(fwd[i], b, bwd[i + 1]) - now
            elif kind == "ins":
                out[i, k] = through(fwd[i], b, bwd[i]) - now
            else:
                out[i, k] = _total(entry[i] + bwd[i + 1]) - now
    return out


def edited(template: str, at: int, kind: str, base: str) -> str:
    return template[:at] + base + template[at + (kind != "ins") :]


def fitted(reads: list[str], template: str, rounds: int = 3) -> Rates:
    """Rates from the best alignments of reads to a template, with one made-up count of each kind."""
    n = match = miss = ins = dele = 0
    for r in reads:
        ops, _, _, _ = edit_align(r, template)
        match, miss, ins, dele = match + ops.count("M"), miss + ops.count("X"), ins + ops.count("I"), dele + ops.count("D")
        n += len(template)
    return Rates((miss + 1) / (match + miss + 2), (ins + 1) / (n + 2), (dele + 1) / (n + 2))


def with_errors(template: str, rates: Rates, rng: np.random.Generator) -> str:
    out = []
    for b in template:
        while rng.random() < rates.insertion:
            out.append(BASES[rng.integers(4)])
        u = rng.random()
        if u < rates.deletion:
            continue
        out.append(BASES[(BASES.index(b) + rng.integers(1, 4)) % 4] if rng.random() < rates.mismatch else b)
    return "".join(out)


def expected_gain(rates: Rates, kind: str, homopolymer: int = 1, trials: int = 20, reads: int = 20, length: int = 40, seed: int = 0) -> float:
    """What a read of a variant gains on average if the template has it: a low quantile of trial medians."""
    rng = np.random.default_rng([seed, homopolymer, sum(map(ord, kind))])
    medians = []
    for _ in range(trials):
        half = length // 2
        t = "".join(BASES[i] for i in rng.integers(0, 4, half)) + "A" * homopolymer + "C" + "".join(BASES[i] for i in rng.integers(0, 4, half))
        v = edited(t, half, kind, {"sub": "G", "ins": "A", "del": ""}[kind])
        gains = [log_likelihood(r, v, rates) - log_likelihood(r, t, rates) for r in (with_errors(v, rates, rng) for _ in range(reads))]
        medians.append(sorted(gains)[reads // 2])
    return max(1e-9, sorted(medians)[trials // 10])


def variant_columns(gains: np.ndarray, coverage: float, most: int, least_gain: float = 1.0, margin: int = 7) -> list[int]:
    """Columns of gains (reads by positions times edits) that may tell haplotypes apart, best first.

    Small gains are noise; the ends of the template are left out; a column's sum must outweigh what
    its number of reads costs; neighbours and columns that say the same as a picked one are passed over.
    """
    from longweave.operators.cluster import poisson_log

    x = np.where(np.abs(gains) < 0.5 * least_gain, 0.0, gains)
    width = len(EDITS)
    n = x.shape[1] // width
    total, count = np.maximum(x, 0).sum(axis=0), (x > 0).sum(axis=0)
    cost = poisson_log(count, coverage) - poisson_log(np.zeros_like(count), 1e-3 * coverage)
    at = np.arange(x.shape[1]) // width
    ok = (at >= margin) & (at < n - margin) & (count >= max(2, coverage / 3)) & (total + cost > 0)
    picked: list[int] = []
    for c in np.argsort(-total, kind="stable"):
        if not ok[c] or len(picked) >= most:
            continue
        if any(abs(at[c] - at[p]) < margin for p in picked):
            continue
        picked.append(int(c))
    return picked


def phased(reads: list[str], template: str, coverage: float, most: int = 4, seed: int = 0, rates: Rates | None = None) -> tuple[np.ndarray, float]:
    """(labels, score): reads of a chunk in up to ``most`` clusters; one cluster where none pays."""
    from longweave.operators.cluster import clustered

    rates = rates or fitted(reads, template)
    gains = np.array([edit_gains(r, template, rates).ravel() for r in reads])
    cols = variant_columns(gains, coverage, max(2, 2 * most))
    best, score = np.zeros(len(reads), dtype=int), 0.0
    if not cols:
        return best, score
    x = gains[:, cols]
    for k in range(2, most + 1):
        labels, s = clustered(x, k, coverage, seed, restarts=5, flips=10)
        from longweave.operators.cluster import size_score

        s -= float(size_score(np.bincount(labels, minlength=k), coverage, k).sum())
        if s - score <= 0.8 * 1.0 * coverage + 0.1:
            break
        best, score = labels, s
    order = np.argsort(-np.bincount(best), kind="stable")
    return np.argsort(order)[best], score


def minimum_gain(rates: Rates, seeds: int = 1000, reads: int = 500, length: int = 100, nth: int = 3, seed: int = 0) -> float:
    """The ``nth`` least of the median gains of simulated single-base variants, 1 at least."""
    rng = np.random.default_rng(seed)
    medians = []
    for _ in range(seeds):
        t = "".join(BASES[i] for i in rng.integers(0, 4, length))
        at, kind = int(rng.integers(length)), ("sub", "ins", "del")[rng.integers(3)]
        base = BASES[(BASES.index(t[at]) + rng.integers(1, 4)) % 4]
        v = edited(t, at, kind, "" if kind == "del" else base)
        gains = [log_likelihood(r, v, rates) - log_likelihood(r, t, rates) for r in (with_errors(v, rates, rng) for _ in range(reads))]
        medians.append(sorted(gains)[reads // 2])
    return max(1.0, sorted(medians)[min(nth, seeds) - 1])


#: Copies from which on a chunk is clustered in steps, and the most clusters of a step; fixed values.
MANY_COPIES, STEP_CLUSTERS = 8, 4


def phased_in_steps(reads: list[str], template: str, coverage: float, copies: int, seed: int = 0, rates: Rates | None = None) -> tuple[np.ndarray, float]:
    """(labels, score) of a chunk of any number of copies.

    From MANY_COPIES on reads are split into STEP_CLUSTERS clusters at most, the copies are allotted to
    those by size, and each is clustered by itself along its own consensus.
    """
    from longweave.operators.align import consensus
    from longweave.operators.cluster import allotted

    if copies < 2 or len(reads) < 2:
        return np.zeros(len(reads), dtype=int), 0.0
    if copies < MANY_COPIES:
        return phased(reads, template, coverage, copies, seed, rates)
    first, score = phased(reads, template, coverage, STEP_CLUSTERS, seed, rates)
    k = int(first.max()) + 1
    if k < 2:
        return first, score
    share = allotted(np.bincount(first, minlength=k).astype(float), copies)
    labels, used = np.zeros(len(reads), dtype=int), 0
    for c in range(k):
        at = np.nonzero(first == c)[0]
        own = [reads[i] for i in at]
        sub, more = phased_in_steps(own, consensus(own) or template, coverage, int(share[c]), seed + c + 1, rates)
        labels[at] = sub + used
        used += int(sub.max()) + 1
        score += more
    order = np.argsort(-np.bincount(labels), kind="stable")
    return np.argsort(order)[labels], score
