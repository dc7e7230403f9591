"""Schemas of the tables, the invariants that hold between them, and constants of sequencing platforms."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import types as T

READS = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("desc", T.StringType()), T.StructField("seq", T.StringType())])
CHUNKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("seq", T.StringType()), T.StructField("cluster_num", T.IntegerType()), T.StructField("copy_num", T.IntegerType()), T.StructField("score", T.DoubleType())])
NODES = T.StructType([
    T.StructField("node_id", T.LongType()), T.StructField("read_id", T.LongType()), T.StructField("idx", T.IntegerType()), T.StructField("pos", T.LongType()),
    T.StructField("chunk", T.LongType()), T.StructField("cluster", T.LongType()), T.StructField("seq", T.StringType()), T.StructField("is_forward", T.BooleanType()),
    T.StructField("cigar", T.StringType()), T.StructField("posterior", T.ArrayType(T.DoubleType())),
])
PAF = "qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, matches long, block long, mapq int, cigar string"
META = "coverage double, coverage_protected boolean, mask_k int, mask_thr long, read_type string"


@dataclass(frozen=True)
class ReadType:
    """Thresholds that follow from how reads were made."""

    homopolymer_cap: int
    overlap_identity: float
    sim_thr: float
    error_sd: float
    band_fraction: float
    min_span_reads: int
    min_llr: float
    weak_llr: float = 1.3
    weak_span_reads: int = 4

    def band_width(self, length: int) -> int:
        return ceil(length * self.band_fraction)


#: Fixed values by platform.
READ_TYPES = {
    "CCS": ReadType(100, 0.95, 0.05, 0.005, 0.01, 1, 0.1),
    "CLR": ReadType(40, 0.85, 0.20, 0.02, 0.05, 3, 1.0),
    "ONT": ReadType(100, 0.85, 0.15, 0.01, 0.03, 2, 0.7),
    "None": ReadType(100, 0.85, 0.20, 0.01, 0.05, 3, 1.0),
}
