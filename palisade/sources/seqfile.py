"""FASTA and FASTQ files as DataFrames, and back.

``read`` streams each file through a Python data source: any store that Arrow opens, compressed files too, constant
memory.  ``read_fasta`` cuts plain FASTA natively, so that one large file is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, comment string, seq string, qual string, file string"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str | None, str, str | None]]:
    """``(name, comment, seq, qual)`` of each record.  Sequences run over lines up to the next record or ``+``; of them
    only visible characters count.  A record with a quality of another length than its sequence ends the file."""
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        head = line[1:].rstrip("\r\n").split(None, 1) if line[1:2].strip() else ["", line[1:].strip()]
        name, comment = (head + [""])[0] if head else "", head[1].strip() if len(head) > 1 else ""
        seq: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq.append("".join(c for c in line if "!" <= c <= "~"))
            line = next(lines, None)
        text = "".join(seq)
        if line is None or line[:1] != "+":
            yield name, comment or None, text, None
            continue
        qual = ""
        line = next(lines, None)
        while line is not None and len(qual) < len(text):
            qual += "".join(c for c in line if "!" <= c <= "\x7f")
            line = next(lines, None)
        if len(qual) != len(text):
            return
        yield name, comment or None, text, qual


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [_Part(p) for path in self.paths for p in _files(path)]

    def read(self, partition):
        import io

        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(partition.path)
        with store.open_input_stream(name, compression="detect") as raw:
            for r in records(iter(io.TextIOWrapper(raw, "latin-1"))):
                yield (*r, partition.path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    uri = path if "://" in path else f"file://{path}"
    store, name = fs.FileSystem.from_uri(uri)
    scheme = uri[: len(uri) - len(name)]
    info = store.get_file_info(name)
    if info.type == fs.FileType.Directory:
        return sorted(scheme + f.path for f in store.get_file_info(fs.FileSelector(name)) if f.is_file)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [uri]


class SequenceFiles(DataSource):
    """``spark.read.format("seqfile").load(path)``; several paths by commas."""

    @classmethod
    def name(cls):
        return "seqfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(SequenceFiles)
    return spark.read.format("seqfile").load(",".join(paths))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, comment, seq, file)`` of plain FASTA, cut where a line begins with ``>``; large files are split."""
    cut = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.input_file_name())
    body = F.regexp_replace("value", "^>", "")
    head = F.substring_index(body, "\n", 1)
    seq = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(F.substring(body, F.length(head) + 2, F.length(body)), r"[^\x21-\x7e]", "")).otherwise("")
    comment = F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1))
    return cut.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(comment != "", comment).alias("comment"), seq.alias("seq"), "file").where("name <> '' or seq <> ''")


def fasta(name, seq, comment=None):
    """A FASTA record as a column."""
    head = F.concat(F.lit(">"), name) if comment is None else F.concat(F.lit(">"), name, F.coalesce(F.concat(F.lit(" "), comment), F.lit("")))
    return F.concat(head, F.lit("\n"), seq)


def write_groups(reads: DataFrame, supported: DataFrame, path: str) -> None:
    """Per group, the FASTA records of the reads that support it; ``reads(read_id, seq)``, ``supported(gid, read_id)``."""
    held = supported.select("gid", "read_id").distinct().join(reads, "read_id")
    held.select("gid", fasta(F.col("read_id").cast("string"), F.col("seq")).alias("value")).write.partitionBy("gid").text(path)
