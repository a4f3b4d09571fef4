import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import pii


def digest(key, *parts):
    return int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def undone(key, kind, l, r, m, n):
    for i in reversed(range(pii.ROUNDS)):
        if i % 2 == 0:
            l = (l - digest(key, kind, i, r)) % m
        else:
            r = (r - digest(key, kind, i, l)) % n
    return l, r


def new_text(spark, *texts, key="k"):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in pii.pseudonymised(docs, key).orderBy("doc_id").collect()]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


CARDS = ["4111111111111111", "5500005555555559", "378282246310005", "4222222222222"]


def test_cards_keep_length_marks_and_check_digit(spark):
    out = new_text(spark, *CARDS, "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112")
    for was, now in zip(CARDS, out):
        assert now != was and len(now) == len(was) and luhn(now)
        body, n = now[:-1], len(now) - 1
        l, r = undone("k", f"card{n}", int(body[: n // 2]), int(body[n // 2 :]), 10 ** (n // 2), 10 ** (n - n // 2))
        assert str(l).zfill(n // 2) + str(r).zfill(n - n // 2) == was[:-1]
    assert out[4].replace(" ", "") == out[0] and out[5].replace("-", "") == out[0] and out[4][4] == " "
    assert out[6] == "4111111111111112"  # fails its check


def test_every_date_maps_to_another_date(spark):
    days = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = [r.text for r in pii.pseudonymised(days, "k").collect()]
    assert len(set(out)) == 40_000 and all(datetime.date.fromisoformat(x).year in range(1800, 2200) for x in out)


def test_formats(spark):
    a, b, c, d, e, f = new_text(spark, "2024-02-29", "02/29/2024", "29.02.2024", "2023-02-29", "13.13.2020", "29/2/2024")
    assert datetime.date.fromisoformat(a) == datetime.datetime.strptime(b, "%m/%d/%Y").date() == datetime.datetime.strptime(c, "%d.%m.%Y").date()
    assert (d, e) == ("2023-02-29", "13.13.2020") and f.count("/") == 2
    out = new_text(spark, "192.168.0.1", "999.1.1.1", "1.2.3.4.5", "123-45-6789", "000-45-6789", "DE89370400440532013000", "DE88370400440532013000")
    assert all(int(x) < 256 for x in out[0].split(".")) and out[1] == "999.1.1.1" and out[2] == "1.2.3.4.5"
    assert out[3] != "123-45-6789" and out[4] == "000-45-6789" and out[6] == "DE88370400440532013000"
    iban = out[5]
    number = "".join(str(int(x, 36)) for x in iban[4:] + iban[:4])
    assert iban[:2] == "DE" and iban != "DE89370400440532013000" and int(number) % 97 == 1
    mail, upper, phone = new_text(spark, "jo.do+7@x-y.example.com", "JO.DO+7@x-y.example.com", "+1 (042) 555-7845 1.2.3.4")
    assert mail != "jo.do+7@x-y.example.com" and mail.endswith("@x-y.example.com") and mail[2] == "." and mail[5] == "+" and upper.split("@")[0] == mail.split("@")[0].upper()
    assert phone.startswith("+1 (") and len(phone.split()) == 4 and phone[:17] != "+1 (042) 555-7845"


def test_links_and_keys(spark):
    a, b = new_text(spark, "x 4111111111111111 y", "pay 4111111111111111, 4111111111111111!")
    value = a.split()[1]
    assert b == f"pay {value}, {value}!"
    assert new_text(spark, "4111111111111111", key="other")[0] != value


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "plain text", "k"), (3, "plain text", "k"), (None, "7 " * 50_000 + "4111111111111111", "k"), (5, "\n4111111111111111\n", "k")], "doc_id long, text string, kinds string")
    out = pii.pseudonymised(docs, "k", kinds="kinds").collect()
    assert [r.text for r in out[:4]] == [None, "", "plain text", "plain text"] and out[0].kinds == []
    assert out[4].text.startswith("7 7 ") and out[4].kinds == ["card"] and out[5].text[0] == "\n" == out[5].text[-1]
    assert pii.pseudonymised(docs, "k").columns == docs.columns and pii.pseudonymised(docs.where("false"), "k").count() == 0


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.pseudonymised(spark.sql("select 1L doc_id, 'x' text"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and docs.count() == 1


def test_dates_of_every_written_form_stay_apart(spark):
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    y, m, d = F.year("d"), F.month("d"), F.dayofmonth("d")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    written = [F.concat_ws("/", two(m), two(d), y), F.concat_ws("/", m, d, y), F.concat_ws("/", two(d), two(m), y), F.concat_ws("/", d, m, y), F.concat_ws(".", two(d), two(m), y), F.concat_ws(".", d, two(m), y)]
    forms = days.select(F.explode(F.array(*written)).alias("text")).distinct().withColumn("was", F.col("text"))
    out = pii.pseudonymised(forms.repartition(8), "k")
    n, apart, alike = out.agg(F.count("*"), F.count_distinct("text"), F.count_if(F.length("text") == F.length("was"))).first()
    assert n == apart == alike


def test_one_day_in_full_forms_stays_linked(spark):
    iso, us, dotted = new_text(spark, "2020-07-09", "07/09/2020", "09.07.2020")
    assert us == "/".join((iso[5:7], iso[8:], iso[:4])) and dotted == ".".join((iso[8:], iso[5:7], iso[:4]))


def test_printed_ibans(spark):
    plain, printed = new_text(spark, "DE89370400440532013000", "pay DE89 3704 0044 0532 0130 00 now")
    assert printed == "pay " + " ".join(plain[i : i + 4] for i in range(0, 22, 4)) + " now" and plain != "DE89370400440532013000"
    assert new_text(spark, "DE88 3704 0044 0532 0130 00") == ["DE88 3704 0044 0532 0130 00"]


def test_a_megabyte_of_each_form_is_searched(spark):
    forms = ["x@" + "a." * 500_000 + "com", "a" * 10**6 + "@b.c", "1" * 10**6, "1.2.3." * 170_000, "GB29 " + "NWBK " * 200_000, "4111 " * 200_000, "+1 555 " * 150_000, "12-34-" * 170_000, "1/2/" * 250_000, "AB12" + "X" * 10**6]
    out = new_text(spark, *forms)
    assert [len(x) for x in out] == [len(x) for x in forms] and out[1:] == forms[1:]


def test_a_key_is_needed_and_names_may_clash(spark):
    docs = spark.createDataFrame([("4111111111111111", 1, "x"), (None, 2, "y")], "text string, found int, `c.0` string")
    with pytest.raises(ValueError):
        pii.pseudonymised(docs)
    out = pii.pseudonymised(docs, "k", kinds="kinds")
    assert out.columns == ["text", "found", "c.0", "kinds"] and sorted(r[1:] for r in out.collect()) == [(1, "x", ["card"]), (2, "y", [])]
    assert pii.pseudonymised(docs.where("false"), "k").count() == 0
