"""Recruiting reads that hold a known repeat: many patterns against all reads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

#: Patterns up to this number go into one automaton that is sent to the tasks; more are joined by k-mers.
MAX_AUTOMATON = 50_000


def both_strands(patterns: DataFrame) -> DataFrame:
    return patterns.select("pattern").unionByName(patterns.select(S.reverse_complement("pattern").alias("pattern"))).distinct()


def nonredundant(variants: DataFrame) -> DataFrame:
    """``(gid, pattern)``: the variants of each group that contain no shorter one of it on either strand, nor (of equal
    length) its own reverse complement's smaller form, with their reverse complements.  Empty variants are left out.

    What holds a pattern holds its first k bases on one strand, k being the shortest variant's length, so only variants
    that share such a k-mer are compared."""
    variants = variants.where("variant <> ''")
    k = variants.agg(F.min(F.length("variant"))).first()[0] or 1
    start = S.canonical(F.substring("variant", 1, k)).alias("kmer")
    cut = variants.select("gid", "variant", F.explode(F.array_distinct(F.transform(S.kmers("variant", k), S.canonical))).alias("kmer"))
    a, b = cut.alias("a"), variants.select("gid", "variant", start).distinct().alias("b")
    longer = (F.length("a.variant") > F.length("b.variant")) | ((F.length("a.variant") == F.length("b.variant")) & (F.col("a.variant") > F.col("b.variant")))
    met = (F.col("a.gid") == F.col("b.gid")) & (F.col("a.kmer") == F.col("b.kmer")) & longer
    lost = a.join(b, met & S.holds_either_strand(F.col("a.variant"), F.col("b.variant")), "left_semi").select("gid", "variant").distinct()
    kept = variants.join(lost, ["gid", "variant"], "left_anti")
    kept = kept.select("gid", F.col("variant").alias("pattern"))
    return kept.unionByName(kept.select("gid", S.reverse_complement("pattern").alias("pattern"))).distinct()


def matches(reads: DataFrame, patterns: DataFrame, limit: int = MAX_AUTOMATON) -> DataFrame:
    """``(read_id, pattern, start, seq)``: for each read the match that ends first, of those the longest.

    The size of the pattern set decides: a set within ``limit`` is an automaton and the reads aren't shuffled; a larger
    one is joined on the first k bases of each pattern, k being the shortest pattern's length.
    """
    known = [r[0] for r in patterns.select("pattern").where("pattern <> ''").distinct().limit(limit + 1).collect()]
    if not known:
        return reads.select("read_id", F.lit("").alias("pattern"), F.lit(0).alias("start"), "seq").where("false")
    return _by_automaton(reads, known) if len(known) <= limit else _by_kmers(reads, patterns)


def _by_automaton(reads: DataFrame, patterns: list[str]) -> DataFrame:
    patterns = sorted(patterns)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for batch in batches:
            rows, found, starts = [], [], []
            for row, seq in enumerate(batch.column(1).to_pylist()):
                best = None
                for end, p in automaton.iter(seq or ""):
                    if best and end > best[0]:
                        break
                    if not best or len(p) > len(best[1]):
                        best = (end, p)
                if best:
                    rows.append(row)
                    found.append(best[1])
                    starts.append(best[0] - len(best[1]) + 1)
            ids, seqs = batch.take(pa.array(rows, pa.int64())).columns
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string()), pa.array(starts, pa.int32()), seqs], names=["read_id", "pattern", "start", "seq"])

    return reads.select(F.col("read_id").cast("long"), "seq").mapInArrow(run, "read_id long, pattern string, start int, seq string")


def _by_kmers(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    patterns = patterns.select("pattern").where("pattern <> ''").distinct()
    k = patterns.agg(F.min(F.length("pattern"))).first()[0]
    keyed = patterns.select("pattern", F.substring("pattern", 1, k).alias("kmer"))
    cut = reads.select("read_id", "seq", F.posexplode(S.kmers("seq", k)).alias("start", "kmer"))
    found = cut.join(keyed, "kmer").where(F.expr("substring(seq, start + 1, length(pattern)) = pattern"))
    first = F.min(F.struct((F.col("start") + F.length("pattern")).alias("end"), "start", "pattern")).alias("m")
    return found.groupBy(F.col("read_id").cast("long").alias("read_id")).agg(first, F.any_value("seq").alias("seq")).select("read_id", "m.pattern", F.col("m.start").cast("int").alias("start"), "seq")


def not_found_before(reads: DataFrame, found: DataFrame) -> DataFrame:
    return reads.join(found.select("read_id"), "read_id", "left_anti")
