"""Seeded haplotypes and reads for tests and trials."""

from __future__ import annotations

import numpy as np

from longweave.operators.likelihood import BASES, Rates, with_errors


def sequence(length: int, rng: np.random.Generator) -> str:
    return "".join(BASES[i] for i in rng.integers(0, 4, length))


def haplotypes(length: int, k: int, divergence: float, seed: int = 42) -> list[str]:
    """A random sequence and k - 1 variants of it, with substitutions only."""
    rng = np.random.default_rng(seed)
    first = sequence(length, rng)
    out = [first]
    for _ in range(k - 1):
        s = list(first)
        for at in rng.choice(length, max(1, round(length * divergence)), replace=False):
            s[at] = BASES[(BASES.index(s[at]) + rng.integers(1, 4)) % 4]
        out.append("".join(s))
    return out


def pileup(haps: list[str], coverage: int, error: float, seed: int = 42) -> tuple[list[str], list[int]]:
    """(reads, haplotype of each): ``coverage`` reads of each haplotype, errors split in thirds."""
    rng = np.random.default_rng(seed + 1)
    rates = Rates(error / 3, error / 3, error / 3)
    return [with_errors(h, rates, rng) for h in haps for _ in range(coverage)], [i for i, _ in enumerate(haps) for _ in range(coverage)]


def reads(haps: list[str], coverage: float, length: int, error: float, seed: int = 42) -> list[tuple[int, str, str, int, int, bool]]:
    """(read_id, name, seq, hap, start, is_forward) rows that cover each haplotype."""
    from longweave.operators.assembly import reverse_complement

    rng, rates, out = np.random.default_rng(seed + 2), Rates(error / 3, error / 3, error / 3), []
    for h, hap in enumerate(haps):
        for _ in range(round(coverage * len(hap) / length)):
            at = int(rng.integers(-length // 2, len(hap) - length // 2))
            part = with_errors(hap[max(0, at) : at + length], rates, rng)
            ahead = bool(rng.random() < 0.5)
            out.append((len(out), f"read_{len(out)}", part if ahead else reverse_complement(part), h, max(0, at), ahead))
    return out
