"""Format-preserving pseudonyms for validated numbers, dates and addresses, in Spark expressions only.

Method.  One pattern finds the candidates of a text; each is validated by kind (Luhn digit of card numbers, check digits
of IBANs, area/group/serial rules of social security numbers, calendar dates, octets of addresses) and, if valid, put
through a keyed Feistel network over exactly the values of its kind, so that the pseudonym is again a valid value of the
same length and punctuation.  The network is a bijection that depends on key, kind and value alone: equal values stay
linked across documents, and different ones stay apart.

========  ====================================================  =================================================
kind      valid                                                 permuted
========  ====================================================  =================================================
card      13 to 19 digits, Luhn                                 all but the last digit; that one is worked out again
phone     8 to 15 digits in a telephone's punctuation           the last ten digits (or all, if fewer)
ssn       ddd-dd-dddd, issued ranges                            all
iban      remainder 1 modulo 97, printed in fours or not        the account characters; check digits worked out again
date      1800-01-01 to 2199-12-31; y-m-d, m/d/y, d/m/y, d.m.y  the day within those 400 years, among the days that
                                                                are written in the same way
ip        four octets                                           all 32 bits
email     name@domain                                           letters and digits of the name
secret    32 to 64 hexadecimal digits                           all
========  ====================================================  =================================================

Letters keep their case and are linked whatever their case.  Everything else in the text is left alone, among it numbers
that fail their check.  Slashed dates are read as m/d/y, or d/m/y where only that is valid.  A day and a month without
leading noughts stay so, and a date that is only valid as d/m/y becomes another one: the network is walked on until it
reaches a day that is written as the first one was, so that different dates in one form stay different.

Scale.  A projection: no shuffle, no Python, nothing collected.  The network runs for matches only; texts without a digit
or ``@`` are not searched at all.

Repetitions in the patterns give nothing back, so that a text of any length is searched without depth.

Defined results: null text stays null; empty text stays empty; very long texts are searched whole; repeated rows give equal
rows; other columns pass through, whatever their names (one named as ``kinds`` gives way); an empty table gives an empty one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "spark.palisade.pii.key"  # the setting that holds the key
#: For tests and demonstrations only: anyone can undo its pseudonyms.
DEMO_KEY = "palisade-demonstration-key"

_DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}[ .-]?\d?(?:[ .-]\d{2}){4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"
#: Candidates, in order of preference at one place.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
        rf"(?<![0-9A-Za-z./-])(?:{_DATE})(?![0-9A-Za-z/-])(?!\.\d)",
        r"(?<![0-9A-Za-z.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z])(?!\.\d)",
        r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
        rf"(?<![0-9A-Za-z+])(?:{_PHONE})(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![0-9A-Za-z])",
    ]
)
_DAYS, _DAYS_LEFT, _DAYS_RIGHT = 146_097, 189, 773  # the days of 400 years, as a product
WALK = 200  # steps of a date's walk at most


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, and standing once in the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(key: str, kind: Column, turn: Column, *parts: Column) -> Column:
    """A keyed pseudorandom number below 2^60."""
    text = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: Column, left: Column, right: Column, size_left: Column, size_right: Column) -> Column:
    """Struct ``(l, r)``: a permutation of the pairs below the two sizes."""

    def network(s):
        def turn(acc, i):
            l, r = acc["l"], acc["r"]
            even = i % 2 == 0
            size = F.when(even, s["m"]).otherwise(s["n"])
            moved = (F.when(even, l).otherwise(r) + _digest(key, s["kind"], i, F.when(even, r).otherwise(l)) % size) % size
            return F.struct(F.when(even, moved).otherwise(l).alias("l"), F.when(even, r).otherwise(moved).alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(s["l"].alias("l"), s["r"].alias("r")), turn)

    fields = {"l": left, "r": right, "m": size_left, "n": size_right}
    return _let(F.struct(*[v.cast("long").alias(k) for k, v in fields.items()], kind.alias("kind")), network)


def feistel_text(key: str, kind: Column, text: Column, letters: int = 26) -> Column:
    """A permutation of the strings with the same pattern of digits, capitals, small letters and other characters."""

    def shifted(x, other, i):
        def one(c, at):
            first = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
            return _let(first, lambda f: F.when(f.isNull(), c).otherwise(F.char(f + (F.ascii(c) - f + _digest(key, kind, i, at, F.lower(other)) % F.when(f == 48, 10).otherwise(letters)) % F.when(f == 48, 10).otherwise(letters))))

        return F.when(x == "", x).otherwise(F.array_join(F.transform(F.split(x, ""), one), ""))

    def turn(acc, i):
        even = i % 2 == 0
        moved = shifted(F.when(even, acc["l"]).otherwise(acc["r"]), F.when(even, acc["r"]).otherwise(acc["l"]), i)
        return _let(moved, lambda m: F.struct(F.when(even, m).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(m).alias("r")))

    def network(t):
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substring(t, F.lit(1), half).alias("l"), F.substring(t, half + 1, F.length(t)).alias("r"))
        return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda d: F.concat(d["l"], d["r"]))

    return _let(text, network)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order."""
    place = lambda i: F.length(_digits(F.substring(form, F.lit(1), i + 1)))
    return _let(digits, lambda d: F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(d, place(i), F.lit(1))).otherwise(c)), ""))


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Sum of the digits, every second one doubled, counted from the right; ``doubled_from`` 0: the last one is."""
    value = lambda c, i: F.when(i % 2 == doubled_from, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), value), F.lit(0), lambda a, x: a + x)


def _numeric(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of one length (2 to 18)."""

    def permuted(s):
        d, a, b = s["d"], s["a"], s["b"]
        size = lambda k: F.pow(F.lit(10.0), k)
        done = feistel(key, F.concat(F.lit(kind), (a + b).cast("string")), F.substring(d, F.lit(1), a), F.substring(d, a + 1, b), size(a), size(b))
        return _let(done, lambda x: F.concat(F.lpad(x["l"].cast("string"), a, "0"), F.lpad(x["r"].cast("string"), b, "0")))

    return _let(digits, lambda d: _let(F.struct(d.alias("d"), F.floor(F.length(d) / 2).cast("int").alias("a"), F.ceil(F.length(d) / 2).cast("int").alias("b")), permuted))


def _card(key: str, m: Column) -> Column:
    def new(d):
        body = _numeric(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        whole = _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d, 1) % 10 == 0, _refill(m, whole))

    return _let(_digits(m), new)


def _phone(key: str, m: Column) -> Column:
    def new(d):
        kept = F.greatest(F.length(d) - 10, F.lit(0))
        return F.when(F.length(d).between(8, 15), _refill(m, F.concat(F.substring(d, F.lit(1), kept), _numeric(key, "phone", F.substring(d, kept + 1, F.length(d))))))

    return _let(_digits(m), new)


def _ssn(key: str, m: Column) -> Column:
    def new(p):
        valid = p["a"].between(1, 899) & (p["a"] != 666) & (p["g"] > 0) & (p["s"] > 0)
        area = p["a"] - F.when(p["a"] > 666, 2).otherwise(1)
        done = feistel(key, F.lit("ssn"), area * 99 + p["g"] - 1, p["s"] - 1, F.lit(898 * 99), F.lit(9999))
        text = lambda d: F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip((F.floor(d["l"] / 99) + F.when(d["l"] >= 665 * 99, 2).otherwise(1), d["l"] % 99 + 1, d["r"] + 1), (3, 2, 4))])
        return F.when(valid, _let(done, text))

    return _let(F.struct(*[F.substring(m, at, n).cast("int").alias(k) for k, at, n in (("a", 1, 3), ("g", 5, 2), ("s", 8, 4))]), new)


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _iban(key: str, m: Column) -> Column:
    def new(c):
        country, rest = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.length(c))
        valid = _mod97(F.concat(rest, F.substring(c, 1, 4))) == 1
        moved = feistel_text(key, F.concat(F.lit("iban"), country), rest)
        whole = _let(moved, lambda n: F.concat(country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        printed = lambda w: F.when(m.contains(" "), F.trim(F.regexp_replace(w, "(.{4})", "$1 "))).otherwise(w)
        return F.when(valid, _let(whole, printed))

    return _let(F.regexp_replace(m, " ", ""), new)


def _date(key: str, m: Column) -> Column:
    mark = F.when(m.contains("-"), "-").when(m.contains("/"), "/").otherwise(".")
    first = F.lit("1800-01-01").cast("date")

    def fits(year, month, day):
        leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
        last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return year.between(1800, 2199) & month.between(1, 12) & (day >= 1) & (day <= last)

    def ordered(p):
        """Year, month and day, and the order they stand in (null if it is no date)."""
        parts = [p[i].cast("int") for i in range(3)]
        in_order = F.when(mark == "-", "ymd").when((mark == "/") & fits(parts[2], parts[0], parts[1]), "mdy").otherwise("dmy")
        # two digits each, or no leading noughts, or a nought before one of them only
        wide = [F.length(p[i]) == 2 for i in range(3)]
        pick = lambda o, ymd, mdy, dmy: F.when(o == "ymd", ymd).when(o == "mdy", mdy).otherwise(dmy)
        fields = lambda o: F.struct(
            o.alias("o"), pick(o, parts[0], parts[2], parts[2]).alias("y"), pick(o, parts[1], parts[0], parts[1]).alias("m"), pick(o, parts[2], parts[1], parts[0]).alias("d"),
            pick(o, wide[1], wide[0], wide[1]).alias("wm"), pick(o, wide[2], wide[1], wide[0]).alias("wd"),
        )
        return _let(in_order, lambda o: new(fields(o)))

    def new(value):
        def moved(s):
            day = F.date_diff(F.make_date(s["y"], s["m"], s["d"]), first)

            def step(day):
                done = feistel(key, F.lit("date"), F.floor(day / _DAYS_RIGHT), day % _DAYS_RIGHT, F.lit(_DAYS_LEFT), F.lit(_DAYS_RIGHT))
                return _let(done, lambda x: (x["l"] * _DAYS_RIGHT + x["r"]).cast("int"))

            def like(n):
                """Is the day written in the same form?"""
                date = F.date_add(first, n)
                month, dom = F.month(date), F.dayofmonth(date)
                swapped = (mark == "/") & (s["o"] == "dmy")
                return ((month > 9) <= s["wm"]) & ((dom > 9) <= s["wd"]) & (~swapped | (dom > 12))

            def walk(acc, _):
                return F.when(acc["ok"], acc).otherwise(_let(step(acc["n"]), lambda n: F.struct(n.alias("n"), like(n).alias("ok"))))

            start = F.struct(day.alias("n"), F.lit(False).alias("ok"))
            done = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, walk)
            return F.when(fits(s["y"], s["m"], s["d"]), _let(done, lambda x: shown(s, F.date_add(first, x["n"]))))

        return _let(value, moved)

    def shown(s, n):
        two = lambda v, wide: F.when(wide, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
        parts = F.struct(two(F.dayofmonth(n), s["wd"]).alias("d"), two(F.month(n), s["wm"]).alias("m"), F.year(n).cast("string").alias("y"))
        return _let(parts, lambda p: F.when(s["o"] == "ymd", F.concat_ws("-", p["y"], p["m"], p["d"])).when(s["o"] == "mdy", F.concat_ws("/", p["m"], p["d"], p["y"])).otherwise(F.concat(p["d"], mark, p["m"], mark, p["y"])))

    return _let(F.split(m, r"[-/.]"), ordered)


def _ip(key: str, m: Column) -> Column:
    def new(o):
        valid = F.array_max(o) <= 255
        done = feistel(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        text = lambda d: F.concat_ws(".", *[x.cast("string") for x in (F.floor(d["l"] / 256), d["l"] % 256, F.floor(d["r"] / 256), d["r"] % 256)])
        return F.when(valid, _let(done, text))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), new)


def _email(key: str, m: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(key, F.lit("email"), name), F.substring(m, F.length(name) + 1, F.length(m)))


def replaced(m: Column, key: str) -> Column:
    """Struct ``(kind, text)`` for a candidate; ``kind`` is null, and the text unchanged, if it isn't valid."""
    tests = [
        ("email", m.contains("@"), _email(key, m)),
        ("secret", m.rlike("^[0-9a-fA-F]{32,}$"), feistel_text(key, F.lit("secret"), m, letters=6)),
        ("iban", m.rlike("^[A-Z]{2}"), _iban(key, m)),
        ("date", m.rlike(f"^(?:{_DATE})$"), _date(key, m)),
        ("ip", m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), _ip(key, m)),
        ("ssn", m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(key, m)),
        ("phone", m.rlike(f"^(?:{_PHONE})$"), _phone(key, m)),
        ("card", F.lit(True), _card(key, m)),
    ]
    text, kind = F.lit(None).cast("string"), F.lit("card")
    for name, test, value in reversed(tests):
        text, kind = F.when(test, value).otherwise(text), F.when(test, F.lit(name)).otherwise(kind)
    return F.struct(kind.alias("kind"), text.alias("text"))


def key_or_demo(spark: SparkSession) -> str:
    """The session's key or, with a warning, the demonstration key."""
    key = spark.conf.get(KEY, None)
    if not key:
        warnings.warn(f"{KEY} isn't set: the demonstration key makes pseudonyms that anyone can undo", stacklevel=2)
    return key or DEMO_KEY


def pseudonymised(docs: DataFrame, key: str | None = None, column: str = "text", kinds: str | None = None) -> DataFrame:
    """``docs`` with the pseudonyms in place; ``kinds`` names a further column for the kinds of the values replaced.
    Without ``key`` the session's setting ``KEY`` must hold one."""
    key = key or docs.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"no key: pass one or set {KEY}")
    quote = lambda c: F.col("`" + c.replace("`", "``") + "`")
    names = docs.columns
    at = names.index(column)
    # inside, columns go by their place, so that no name can clash
    docs = docs.select(*[quote(c).alias(f"c{i}") for i, c in enumerate(names)])
    text = F.col(f"c{at}").cast("string")
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("was"), replaced(m, key).alias("new")))
    held = F.when(text.rlike("[0-9@]"), found)
    docs = docs.withColumn("found", held)
    joined = F.zip_with(F.split(text, PATTERN, -1), F.col("found"), lambda piece, m: F.concat(piece, F.coalesce(m["new"]["text"], m["was"], F.lit(""))))
    new = F.when(F.size("found") > 0, F.array_join(joined, "")).otherwise(text)
    out = [(new if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(names) if c != kinds]
    if kinds:
        valid = F.filter("found", lambda m: m["new"]["text"].isNotNull())
        out.append(F.coalesce(F.transform(valid, lambda m: m["new"]["kind"]), F.array().cast("array<string>")).alias(kinds))
    return docs.select(*out)
