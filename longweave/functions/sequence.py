"""Scalar functions on sequences, CIGARs and log-probabilities, as Column builders.

A null argument gives null unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<op:string,len:int>>"


def reverse_complement(seq: Column) -> Column:
    """Case is kept; what is no base stays as it is."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def cap_homopolymers(seq: Column, most: int) -> Column:
    """Runs of one base cut down to ``most``."""
    for base in "ACGT":
        seq = F.regexp_replace(seq, f"({base}{{{most}}}){base}+", "$1")
    return seq


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; none of a sequence shorter than k. For short sequences: the work grows with the square."""
    n = F.length(seq) - F.lit(k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, F.lit(k)))).when(seq.isNotNull(), F.array().cast("array<string>"))


def homopolymer_lengths(seq: Column) -> Column:
    """For each position the length of the run of one base around it."""
    runs = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(F.length(r), F.length(r))))


def cigar_ops(cigar: Column) -> Column:
    """Structs of op (M, D, I) and len; an empty CIGAR has none."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDI]"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MDI])"), F.lit(1))
    return F.zip_with(op, n, lambda o, k: F.struct(o.alias("op"), k.cast("int").alias("len")))


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _length(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"].isin(*kinds), x["len"]).otherwise(0))


def query_length(ops: Column) -> Column:
    return _length(ops, "MI")


def reference_length(ops: Column) -> Column:
    return _length(ops, "MD")


def kadane(values: Column) -> Column:
    """Largest sum over a run of one value or more; null for none."""
    zero = F.struct(F.lit(None).cast("long").alias("here"), F.lit(None).cast("long").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        here = F.when(acc["here"] > 0, acc["here"] + x.cast("long")).otherwise(x.cast("long"))
        return F.struct(here.alias("here"), F.greatest(acc["best"], here).alias("best"))

    return F.aggregate(values, zero, step, lambda acc: acc["best"])


def max_indel(ops: Column, match_weight: int = 1, indel_weight: int = 1) -> Column:
    """Weight of the strongest stretch of insertions and deletions, matches counting against it; at least 0."""
    signed = F.transform(ops, lambda x: F.when(x["op"] == "M", -x["len"] * match_weight).otherwise(x["len"] * indel_weight))
    return F.greatest(F.coalesce(kadane(signed), F.lit(0).cast("long")), F.lit(0).cast("long"))


def identity(ops: Column, matches: Column) -> Column:
    """Matches over all columns of an alignment."""
    return matches / F.aggregate(ops, F.lit(0), lambda a, x: a + x["len"])


def logsumexp(xs: Column) -> Column:
    """Stable; 0 for an empty array."""
    top = F.array_max(xs)
    return F.when(F.size(xs) == 0, F.lit(0.0)).otherwise(top + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def posterior(xs: Column) -> Column:
    total = logsumexp(xs)
    return F.transform(xs, lambda x: x - total)


def is_biased(xs: Column, threshold: float = 0.2) -> Column:
    """Whether a cluster stands out by ``threshold`` over an even share; always for one cluster or none."""
    n = F.size(xs)
    return (n <= 1) | F.exists(xs, lambda x: F.exp(x) >= F.lit(1.0) / F.greatest(n, F.lit(1)) + threshold)


def poisson_log(x: Column, rate: Column) -> Column:
    logs = F.when(x >= 1, F.aggregate(F.sequence(F.lit(1), x.cast("int")), F.lit(0.0), lambda a, c: a + F.log(c.cast("double")))).otherwise(0.0)
    return x * F.log(rate) - rate - logs


def max_poisson_log(x: Column, rate: Column, most: int) -> Column:
    """Over one to ``most`` copies."""
    return F.greatest(*[poisson_log(x, rate * c) for c in range(1, most + 1)]) if most > 1 else poisson_log(x, rate)


def logit(lnp: Column) -> Column:
    """ln p - ln(1 - p), clamped to 80 either way."""
    return F.when(lnp < -80, F.lit(-80.0)).when(lnp > -1.8e-35, F.lit(80.0)).otherwise(lnp - F.log1p(-F.exp(lnp)))


def posterior_similarity(x: Column, y: Column, copies: Column) -> Column:
    """Logit of the chance that two reads are of one cluster, by their log-posteriors and copy numbers."""
    summed = F.zip_with(F.zip_with(x, y, lambda a, b: a + b), copies, lambda a, c: a - F.log(c.cast("double")))
    total = F.aggregate(copies, F.lit(0.0), lambda a, c: a + c)
    return F.when(F.size(copies) == 1, -F.log(F.greatest(total, F.lit(1.5)) - 1)).otherwise(logit(F.least(logsumexp(summed), F.lit(0.0))))


def gfa_tags(coverage: Column, copies: Column, length: Column) -> Column:
    return F.concat_ws("\t", F.concat(F.lit("cv:i:"), coverage.cast("long").cast("string")), F.concat(F.lit("cp:i:"), F.round(copies).cast("long").cast("string")), F.concat(F.lit("ln:i:"), length.cast("string")))


_SI = {"": 1, "k": 10**3, "K": 10**3, "m": 10**6, "M": 10**6, "g": 10**9, "G": 10**9}


def parse_si(text: str) -> int:
    """'1.5M' is 1500000; rounded to a whole number. A text of another form is a ValueError."""
    found = re.fullmatch(r"\s*([0-9.]+)\s*([kKmMgG]?)\s*", text)
    if not found:
        raise ValueError(f"not a number with k, M or G: {text!r}")
    return round(float(found[1]) * _SI[found[2]])


def register(spark) -> None:
    """The functions that need no parameter, by name, for SQL; and cigar_ops as a table function."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="at int, op string, len int, query int, reference int")
    class CigarOps:
        """One row for each operation of a CIGAR, with where it starts in query and reference."""

        def eval(self, cigar: str):
            query = reference = 0
            for at, (n, op) in enumerate(re.findall(r"(\d+)([MDI])", cigar or "")):
                yield at, op, int(n), query, reference
                query += int(n) * (op in "MI")
                reference += int(n) * (op in "MD")

    spark.udtf.register("cigar_ops", CigarOps)
    for text in (
        "reverse_complement(s STRING) RETURNS STRING RETURN translate(reverse(s), 'ACGTacgt', 'TGCAtgca')",
        "canonical_kmer(s STRING) RETURNS STRING RETURN least(s, translate(reverse(s), 'ACGTacgt', 'TGCAtgca'))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
