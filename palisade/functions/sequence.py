"""Column functions on sequences, in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import LOW_COMPLEXITY

# The complement of each letter of the nucleotide alphabet and of the letters beside it.
COMPLEMENT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
COMPLEMENT_TO = "TVGHEFCDIJMLKNOPQYSAABWXRZtvghefcdijmlknopqysaabwxrz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(_c(s), COMPLEMENT_FROM, COMPLEMENT_TO))


def canonical(s) -> Column:
    """The smaller, byte by byte, of a sequence and its reverse complement."""
    return F.least(_c(s), reverse_complement(s))


def first_occurrence(text, pattern) -> Column:
    """0-based place of the first exact occurrence, -1 if there is none or either is empty."""
    return F.when((F.length(_c(pattern)) == 0) | (F.length(_c(text)) == 0), F.lit(-1)).otherwise(F.instr(_c(text), _c(pattern)) - 1)


def all_occurrences(text, pattern) -> Column:
    """0-based places of all occurrences, overlapping ones too."""
    text, pattern = _c(text), _c(pattern)
    last = F.length(text) - F.length(pattern)
    places = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.length(pattern)) == pattern)
    return F.when((last < 0) | (F.length(pattern) == 0), F.array().cast("array<int>")).otherwise(places)


def stretch(seq, start, stop) -> Column:
    """``seq[start..stop]``, both inclusive and 0-based."""
    return F.substring(_c(seq), _c(start) + 1, _c(stop) - _c(start) + 1)


def kmers(s, k: int) -> Column:
    """All windows of length ``k``, in order; none if the string is shorter."""
    s = _c(s)
    return F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k))))


def squeezed(s) -> Column:
    """Runs of one character as one character."""
    return F.regexp_replace(_c(s), r"(.)\1+", "$1")


def run_lengths(s) -> Column:
    """``(character, length)`` of each run."""
    runs = F.regexp_extract_all(_c(s), F.lit(r"((.)\2*)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.substring(r, 1, 1).alias("base"), F.length(r).alias("n")))


def expanded(runs) -> Column:
    return F.array_join(F.transform(_c(runs), lambda r: F.repeat(r["base"], r["n"])), "")


def holds_either_strand(text, pattern) -> Column:
    return F.contains(_c(text), _c(pattern)) | F.contains(_c(text), reverse_complement(pattern))


def base_code(b) -> Column:
    """0 to 3 for A, C, G, T in either case, 4 for everything else."""
    place = F.instr(F.lit("ACGT"), F.upper(_c(b)))
    return F.when((place > 0) & (F.length(_c(b)) == 1), place - 1).otherwise(F.lit(4))


def base_counts(s) -> list[Column]:
    """How often A, C, G, T and other characters occur, whatever the case."""
    n = F.length(_c(s))
    named = [n - F.length(F.translate(_c(s), b + b.lower(), "")) for b in "ACGT"]
    return [*named, n - named[0] - named[1] - named[2] - named[3]]


def low_complexity(s) -> Column:
    return F.greatest(*base_counts(s)) > F.floor(F.length(_c(s)) * LOW_COMPLEXITY)


def trimer_share(s) -> Column:
    """Share of the most frequent 3-mer; the last 3-mer isn't counted."""
    s = _c(s)
    windows = F.transform(F.sequence(F.lit(1), F.length(s) - 3), lambda i: F.substring(s, i, F.lit(3)))
    most = F.array_max(F.transform(F.array_distinct(windows), lambda w: F.size(F.filter(windows, lambda x: x == w))))
    return F.when(F.length(s) > 3, most / (F.length(s) - 3)).otherwise(F.lit(0.0))


def edit_distance(a, b) -> Column:
    """Levenshtein distance with swaps of neighbours that reach past the first character of both."""
    a, b = _c(a), _c(b)
    first = F.sequence(F.lit(0), F.length(b))
    start = F.struct(first.alias("back"), first.alias("row"), F.lit(0).alias("i"))

    def row(acc, x):
        i = acc["i"] + 1

        def cell(out, j):
            y = F.substring(b, j, F.lit(1))
            plain = F.least(F.element_at(acc["row"], j + 1) + 1, F.element_at(out, -1) + 1, F.element_at(acc["row"], j) + (x != y).cast("int"))
            swap = F.element_at(acc["back"], j - 1) + 1 + (F.substring(a, i - 1, F.lit(1)) != y).cast("int") + (x != F.substring(b, j - 1, F.lit(1))).cast("int")
            return F.array_append(out, F.when((i > 2) & (j > 2), F.least(plain, swap)).otherwise(plain))

        return F.struct(acc["row"].alias("back"), F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell).alias("row"), i.alias("i"))

    done = F.aggregate(F.split(a, ""), start, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.length(a) + F.length(b)).otherwise(F.element_at(done["row"], -1))


def similarity(a, b) -> Column:
    n = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when((F.length(_c(a)) < 3) | (F.length(_c(b)) < 3), F.lit(0.0)).otherwise(1 - edit_distance(a, b) / n)


def mirrored(repeats, length) -> Column:
    """Repeats as they lie on the other strand of a read."""
    return F.reverse(F.transform(_c(repeats), lambda r: F.struct((_c(length) - 1 - r["stop"]).alias("start"), (_c(length) - 1 - r["start"]).alias("stop"))))


def interior_spacers(seq, repeats) -> Column:
    """The stretches between neighbouring repeats."""
    seq, repeats = _c(seq), _c(repeats)
    pairs = F.zip_with(F.slice(repeats, F.lit(1), F.size(repeats) - 1), F.slice(repeats, F.lit(2), F.size(repeats) - 1), lambda a, b: F.struct(a["stop"].alias("a"), b["start"].alias("b")))
    cut = F.transform(pairs, lambda p: F.substring(seq, p["a"] + 2, p["b"] - p["a"] - 1))
    return F.when(F.size(repeats) < 2, F.array().cast("array<string>")).otherwise(cut)


def spacer_without_last(seq, repeats, i: int) -> Column:
    """Spacer ``i`` as the short-read comparison takes it: without its last base."""
    return F.element_at(F.transform(interior_spacers(seq, repeats), lambda s: F.substring(s, F.lit(1), F.length(s) - 1)), i + 1)


def representative_repeat(seq, repeats) -> Column:
    """The repeat that stands for the read: of one, it; of two, the second if the first begins the read, else the longer
    (the second if equal); of more, the second."""
    seq, r = _c(seq), _c(repeats)
    size = lambda i: F.element_at(r, i)["stop"] - F.element_at(r, i)["start"]
    which = F.when(F.size(r) == 1, 1).when((F.size(r) == 2) & (F.element_at(r, 1)["start"] > 0) & (size(1) > size(2)), 1).otherwise(2)
    chosen = F.element_at(r, which)
    return F.substring(seq, chosen["start"] + 1, chosen["stop"] - chosen["start"] + 1)


# Fixed values of the colour scale.
COLOUR_PI, COLOUR_SHARE, COLOUR_LIFT = 3.1415927, 0.6666666666, 0.5
#: Phase of red, green and blue in units of a third turn (None: the channel is off), and the units that the scale spans.
COLOUR_SCHEMES = {
    "RED_BLUE": ((0, None, 1), 1),
    "RED_BLUE_GREEN": ((0, 2, 1), 2),
    "GREEN_BLUE_RED": ((2, 0, 1), 2),
    "BLUE_RED": ((1, None, 0), 1),
}


def heat_colour(value, low, high, steps, scheme: str = "BLUE_RED") -> Column:
    """RGB in hexadecimal: the value snaps to one of ``steps`` ticks, and each channel is a raised cosine around its
    phase.  000000 outside the bounds or without ticks."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    v, low, high, steps = _c(value).cast("double"), lit(low), lit(high), lit(steps)
    phases, span = COLOUR_SCHEMES.get(scheme, COLOUR_SCHEMES["BLUE_RED"])
    third = COLOUR_SHARE * COLOUR_PI
    tick = (high - low) / F.when(steps > 1, steps - 1)
    at = F.when(high > low, (F.round(v / tick) * tick - low) * (span * third) / (high - low)).otherwise(F.lit(0.0))

    def channel(phase):
        if phase is None:
            return F.lit("00")
        level = F.round((F.cos(at - phase * third) + COLOUR_LIFT) * COLOUR_SHARE * 255).cast("int")
        return F.lower(F.lpad(F.hex(F.greatest(level, F.lit(0))), 2, "0"))

    inside = (v >= low) & (v <= high) & at.isNotNull()
    return F.when(inside, F.concat(*[channel(p) for p in phases])).otherwise("000000")


def in_columns(seq, repeats) -> Column:
    """A read laid out as repeats and spacers in columns, overhangs included."""
    seq, r = _c(seq), _c(repeats)
    parts = F.transform(r, lambda x, i: F.concat(F.lit("DR: "), F.substring(seq, x["start"] + 1, x["stop"] - x["start"] + 1)))
    spacers = F.transform(interior_spacers(seq, r), lambda s: F.concat(F.lit(" SP: "), s, F.lit(" ")))
    return F.array_join(F.flatten(F.zip_with(parts, spacers, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def register(spark) -> None:
    """The scalar functions as SQL functions."""
    from . import kernels

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(s, '%s', '%s'))" % (COMPLEMENT_FROM, COMPLEMENT_TO))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canonical(s STRING) RETURNS STRING RETURN least(s, reverse(translate(s, '%s', '%s')))" % (COMPLEMENT_FROM, COMPLEMENT_TO))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION squeezed(s STRING) RETURNS STRING RETURN regexp_replace(s, '(.)\\\\1+', '$1')")
    spark.udf.register("edit_distance", kernels.edit_distance, "int")
    spark.udf.register("similarity", kernels.similarity, "double")
    spark.udf.register("low_complexity", kernels.low_complexity, "boolean")
