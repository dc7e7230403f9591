"""The stages as verbs on a data set, a folder with the tables reads, chunks, nodes and meta, and the pipeline of them."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longweave import schema
from longweave.functions.sequence import parse_si
from longweave.plans import stages
from longweave.session import path_exists, replace_tables, scratch
from longweave.sources import sequences as Q


class Store:
    """A data set's folder; a table that is replaced is written beside the old one first."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.path}/{name}")

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def put(self, **tables: DataFrame) -> None:
        replace_tables({f"{self.path}/{name}": df for name, df in tables.items()})

    def meta(self) -> dict:
        return self.get("meta").first().asDict() if self.has("meta") else {}

    def note(self, **values) -> None:
        """Change the one row of the meta table; a protected coverage stays."""
        now = {"coverage": None, "coverage_protected": False, "mask_k": None, "mask_thr": None, "read_type": "None"} | self.meta()
        if now["coverage_protected"]:
            values.pop("coverage", None)
        row = now | values
        self.put(meta=self.spark.createDataFrame([tuple(row[n.split()[0]] for n in schema.META.split(", "))], schema.META))

    def coverage(self) -> float:
        """The haploid coverage noted, or half the median of the chunks'."""
        from longweave.operators.rewrite import haploid_coverage

        found = self.meta().get("coverage")
        return float(found) if found else max(1.0, float(haploid_coverage(self.get("nodes")).first()[0] or 1.0))

    def sim_thr(self) -> float:
        return schema.READ_TYPES[self.meta().get("read_type") or "None"].sim_thr


@dataclass(frozen=True)
class Verb:
    """What a verb does to a store, its options with defaults, and what it prints, if anything."""

    run: Callable
    options: dict[str, object] = field(default_factory=dict)


VERBS: dict[str, Verb] = {}


def verb(name: str, **options):
    def keep(f: Callable) -> Callable:
        VERBS[name] = Verb(f, options)
        return f

    return keep


@verb("entry", input="", read_type="CLR", coverage=0.0)
def entry(store: Store, o) -> None:
    store.put(reads=Q.entered(Q.numbered(Q.read_sequences(store.spark, o.input)), schema.READ_TYPES[o.read_type].homopolymer_cap))
    store.note(read_type=o.read_type, **({"coverage": float(o.coverage), "coverage_protected": True} if o.coverage else {}))


@verb("mask_repeats", k=12, freq=0.001, min_count=10)
def mask_repeats(store: Store, o) -> None:
    from longweave.operators import masking

    reads = store.get("reads")
    store.put(reads=masking.soft_masked(reads, masking.mask(reads, o.k, o.freq, o.min_count), o.k))
    store.note(mask_k=o.k)


@verb("select_chunks", chunk_len="2000", take_num="500", margin="500", exclude=0.8, purge_copy_num=8, seed=42, rounds=1)
def select_chunks(store: Store, o) -> None:
    """Chunks drawn and encoded; then, ``rounds`` times, gaps and tips filled and missing chunks put in."""
    length = parse_si(str(o.chunk_len))
    drawn = stages.select_chunks(store.get("reads"), length, parse_si(str(o.take_num)), parse_si(str(o.margin)), exclude=o.exclude, seed=o.seed)
    drawn = drawn.withColumns({"cluster_num": F.lit(1), "copy_num": F.lit(2), "score": F.lit(0.0)})
    store.put(chunks=drawn)
    store.put(chunks=stages.without_overlapping(store.get("chunks"), store.sim_thr()))
    encode(store, o)
    for _ in range(o.rounds):
        nodes, chunks = stages.fill_sparse(store.get("nodes"), store.get("chunks"), store.get("reads"), store.sim_thr(), length)
        store.put(nodes=nodes, chunks=chunks)
        polish_encoding(store, o)
    store.note(coverage=store.coverage())


@verb("encode")
def encode(store: Store, o) -> None:
    from longweave.operators.filling import corrected_deletions

    reads, chunks = store.get("reads"), store.get("chunks")
    store.put(nodes=stages.encode(reads, chunks, store.sim_thr()))
    store.put(nodes=corrected_deletions(store.get("nodes"), chunks, reads, store.sim_thr())[0])


@verb("polish_encoding")
def polish_encoding(store: Store, o) -> None:
    store.put(nodes=stages.polish_encoding(store.get("nodes"), store.get("chunks"), store.get("reads"), store.coverage()))


@verb("pick_components", component_num=1)
def pick_components(store: Store, o) -> None:
    nodes, chunks = stages.pick_components(store.get("nodes"), store.get("chunks"), o.component_num)
    store.put(nodes=nodes, chunks=chunks)


@verb("estimate_multiplicity", draft="", purge=0, coverage=0.0)
def estimate_multiplicity(store: Store, o) -> None:
    """Copy numbers by flow; chunks of ``purge`` copies or more go, if it is given; a draft of the graph as GFA."""
    from longweave.operators import rewrite

    nodes = store.get("nodes")
    coverage = float(o.coverage) or store.coverage()
    chunks, coverage = stages.estimate_multiplicity(nodes, store.get("chunks"), coverage)
    store.put(chunks=chunks)
    store.note(coverage=coverage)
    if o.draft:
        _, paths, links = stages.copy_numbers(nodes.withColumn("cluster", F.lit(0).cast("long")), coverage)
        Q.write_lines(stages.draft_lines(paths, links), o.draft)
    if o.purge:
        store.put(nodes=rewrite.purge_multiplicity(nodes, store.get("chunks"), o.purge))


@verb("partition_local")
def partition_local(store: Store, o) -> None:
    nodes, reads, chunks = store.get("nodes"), store.get("reads"), store.get("chunks")
    fresh = stages.cluster_locally(stages.node_sequences(nodes, reads), chunks, store.coverage())
    store.put(nodes=fresh.select(*nodes.columns))
    store.put(chunks=stages.with_cluster_numbers(store.get("nodes"), chunks))


@verb("purge_diverged", threshold=0.1)
def purge_diverged(store: Store, o) -> None:
    nodes = store.get("nodes")
    fresh, chunks = stages.recluster_diverged(nodes, store.get("chunks"), store.get("reads"), stages.node_errors(nodes), store.coverage(), o.threshold)
    store.put(nodes=fresh, chunks=chunks)


@verb("correct_deletion", re_cluster=False)
def correct_deletion(store: Store, o) -> None:
    nodes, chunks = stages.correct_deletion(store.get("nodes"), store.get("chunks"), store.get("reads"), store.sim_thr(), store.coverage(), o.re_cluster)
    store.put(nodes=nodes, chunks=chunks)


@verb("correct_clustering", least_ari=0.4)
def correct_clustering(store: Store, o) -> None:
    nodes, chunks = stages.correct_clustering(store.get("nodes"), store.get("chunks"), store.coverage(), least_ari=o.least_ari)
    store.put(nodes=nodes, chunks=chunks)


@verb("encode_densely", chunk_len="2000", least_gap=100, draft="")
def encode_densely(store: Store, o) -> None:
    """New chunks on edges between nodes of several copies; a draft of the graph before as GFA."""
    if o.draft:
        _, paths, links = stages.copy_numbers(store.get("nodes"), store.coverage())
        Q.write_lines(stages.draft_lines(paths, links), o.draft)
    nodes, chunks = stages.encode_densely(store.get("nodes"), store.get("chunks"), store.get("reads"), store.sim_thr(), store.coverage(), parse_si(str(o.chunk_len)), o.least_gap)
    store.put(nodes=nodes, chunks=chunks)


@verb("squish", ari=0.4, match_score=4.0, mismatch_score=-1.0, count=7)
def squish(store: Store, o) -> None:
    nodes, chunks = stages.squish(store.get("nodes"), store.get("chunks"), o.count, o.ari, o.match_score, o.mismatch_score)
    store.put(nodes=nodes, chunks=chunks)


@verb("assemble", output="", window_size=2000, no_polish=False, min_llr=1.0, min_span=2)
def assemble(store: Store, o) -> None:
    """Contigs as GFA at ``output``; polished by the reads' nodes unless told not to."""
    spark, nodes, chunks = store.spark, store.get("nodes"), store.get("chunks")
    g = stages.graph_of(nodes, chunks, store.coverage(), least_span=o.min_span, llrs=(10.0 * o.min_llr, 5.0 * o.min_llr, o.min_llr))
    contigs, links, _ = g.spell()
    seg = spark.createDataFrame(contigs or [("", "")], "name string, seq string").where("name <> ''")
    if not o.no_polish:
        from longweave.operators.align import mapped

        reads = store.get("reads").select("read_id", F.upper("seq").alias("seq"))
        hits = mapped(reads, seg.select(F.xxhash64("name").alias("chunk"), "seq"), store.sim_thr()).select("read_id", "chunk", "pos", "end", "is_forward", "cigar")
        own = hits.join(reads, "read_id").join(seg.select(F.xxhash64("name").alias("chunk"), F.col("name").alias("contig")), "chunk")
        own = own.select("contig", F.lit(0).alias("pos"), "cigar", F.substring("seq", (F.col("pos") + 1).cast("int"), (F.col("end") - F.col("pos")).cast("int")).alias("part"), "is_forward")
        from longweave.functions.sequence import reverse_complement

        seg = stages.polish(seg, own.select("contig", "pos", "cigar", F.when(F.col("is_forward"), F.col("part")).otherwise(reverse_complement(F.col("part"))).alias("seq")), o.window_size)
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(links)] or [(-1, "", "", "", "")], "at long, a string, a_end string, b string, b_end string").where("at >= 0")
    Q.write_lines(contig_lines(seg, rows), o.output)


def contig_lines(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, at, value): GFA lines of contigs (name, seq) and of links (at, a, a_end, b, b_end)."""
    head = contigs.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("H\tVN:Z:1.0").alias("value"))
    seg = contigs.select(F.lit(1).alias("kind"), F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("at"), F.concat_ws("\t", F.lit("S"), "name", "seq").alias("value"))
    out = links.select(F.lit(2).alias("kind"), "at", F.concat_ws("\t", F.lit("L"), "a", F.when(F.col("a_end") == "tail", "+").otherwise("-"), "b", F.when(F.col("b_end") == "head", "+").otherwise("-"), F.lit("0M")).alias("value"))
    return head.unionByName(seg).unionByName(out)


@verb("polish", reads="", contigs="", alignments="", output="", format="sam", window_size=2000)
def polish(store: Store, o) -> None:
    """Contigs (FASTA or GFA) polished by alignments (SAM or PAF) of reads, as FASTA at ``output``; needs no data set."""
    spark = store.spark
    if o.format == "sam":
        aligned = stages.sam_alignments(Q.read_sam(spark, o.alignments))
    elif o.format == "paf":
        aligned = stages.paf_alignments(Q.read_paf(spark, o.alignments), Q.read_sequences(spark, o.reads))
    else:
        raise ValueError(f"neither sam nor paf: {o.format}")
    Q.write_lines(Q.fasta_lines(stages.polish(Q.read_contigs(spark, o.contigs), aligned, o.window_size)), o.output)


@verb("stats")
def stats(store: Store, o) -> dict:
    """What a data set holds: numbers and lengths of reads, nodes a read, chunks."""
    out = {f"reads_{k}": v for k, v in stages.read_stats(store.get("reads")).first().asDict().items()}
    if store.has("nodes"):
        n = store.get("nodes")
        out |= n.agg(F.count("*").alias("nodes"), F.countDistinct("read_id").alias("reads_encoded"), F.countDistinct("chunk").alias("chunks_in_use")).first().asDict()
    if store.has("chunks"):
        out["chunks"] = store.get("chunks").count()
    return out


@verb("extract", output="")
def extract(store: Store, o) -> None:
    units = store.get("chunks").select("chunk", F.length("seq").cast("long").alias("length"), F.col("copy_num").cast("long").alias("copies"))
    stages.extracted(store.get("reads"), units).write.mode("overwrite").csv(o.output, sep="\t")


@dataclass
class Config:
    """Parameters of the pipeline, with defaults for all but the first three."""

    input_file: str
    read_type: str
    region_size: str
    out_dir: str = "./"
    prefix: str = "temp"
    threads: int = 1
    verbose: int = 0
    seed: int = 19090432890
    chunk_len: int = 2000
    margin: int = 500
    exclude: float = 0.85
    kmersize: int = 12
    top_freq: float = 0.001
    min_count: int = 10
    component_num: int = 1
    purge_copy_num: int = 8
    haploid_coverage: float = 0.0
    compress_contig: int = 15
    polish_window_size: int = 2000
    to_polish: bool = True
    min_span: int = 2
    min_llr: float = 1.0
    resume: bool = False
    supress_ari: float = 0.4
    match_ari: float = 4.0
    mismatch_ari: float = -1.0
    required_count: int = 7

    @classmethod
    def read(cls, path: str) -> Config:
        """From a TOML file; a key that is none of these is a ValueError, as is a missing one without default."""
        with open(path, "rb") as f:
            got = tomllib.load(f)
        known = {x.name for x in fields(cls)}
        if set(got) - known or not {"input_file", "read_type", "region_size"} <= set(got):
            raise ValueError(f"unknown keys {sorted(set(got) - known)} or missing ones {sorted({'input_file', 'read_type', 'region_size'} - set(got))}")
        return cls(**got)

    def steps(self) -> list[tuple[str, list[tuple[str, dict]]]]:
        """(checkpoint, verbs with options): the tables after each group of verbs are kept under the checkpoint's name."""
        stem = f"{self.out_dir.rstrip('/')}/{self.prefix}"
        take = 3 * parse_si(self.region_size) // self.chunk_len // 2
        again = ("correct_deletion", {"re_cluster": True})
        return [
            ("entry", [("entry", {"input": self.input_file, "read_type": self.read_type, "coverage": self.haploid_coverage})]),
            ("encoded", [
                ("mask_repeats", {"k": self.kmersize, "freq": self.top_freq, "min_count": self.min_count}),
                ("select_chunks", {"chunk_len": self.chunk_len, "take_num": take, "margin": self.margin, "exclude": self.exclude, "purge_copy_num": self.purge_copy_num, "seed": self.seed}),
                ("pick_components", {"component_num": self.component_num}), ("correct_deletion", {}), ("polish_encoding", {}),
                ("estimate_multiplicity", {"draft": f"{stem}.draft.gfa", "purge": self.purge_copy_num}),
            ]),
            ("clustered", [("partition_local", {})]),
            ("dense", [("purge_diverged", {}), ("purge_diverged", {}), again, ("encode_densely", {"chunk_len": self.chunk_len, "draft": f"{stem}.draft2.gfa"}), again]),
            ("corrected", [("squish", {"ari": self.supress_ari, "match_score": self.match_ari, "mismatch_score": self.mismatch_ari, "count": self.required_count}), ("correct_clustering", {})]),
        ]


class Options:
    """A verb's options: its defaults, and what is given."""

    def __init__(self, name: str, given: dict) -> None:
        unknown = set(given) - set(VERBS[name].options)
        if unknown:
            raise ValueError(f"{name} has no option {sorted(unknown)}")
        self.__dict__.update(VERBS[name].options | given)


def apply(store: Store, name: str, **given):
    """Run one verb; what it saves on the way is deleted at the end."""
    with scratch(store.spark):
        return VERBS[name].run(store, Options(name, given))


def run_pipeline(spark: SparkSession, config: Config) -> str:
    """All verbs in turn; returns the GFA's path.

    Tables after each group are kept in a folder of its own, with a mark once they are whole; ``resume``
    goes on from the last such folder.
    """
    stem = f"{config.out_dir.rstrip('/')}/{config.prefix}"
    last = None
    for name, verbs in config.steps():
        store = Store(spark, f"{stem}.{name}")
        if not (config.resume and store.has("done")):
            if last is not None:
                store.put(**{t: last.get(t) for t in ("reads", "chunks", "nodes", "meta") if last.has(t)})
            for v, options in verbs:
                apply(store, v, **options)
            store.put(done=spark.range(1))
        last = store
    apply(last, "assemble", output=f"{stem}.gfa", window_size=config.polish_window_size, no_polish=not config.to_polish, min_llr=float(config.min_llr), min_span=config.min_span)
    return f"{stem}.gfa"
