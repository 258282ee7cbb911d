"""Identifiers that only their context gives away."""

from __future__ import annotations

from gridcompare.llm.personal_data import masked, personal_data_report

FILLER = "plain words stand here and there without any meaning at all".split()


def texts() -> list[str]:
    rows = []
    for i in range(8):
        seed = f"card number 4111 1111 1111 1111" if i == 0 else f"please call +1 (555) 555-{1000 + i:04d} soon"
        rows.append(" ".join(FILLER[i % 5 :]) + f" {seed} " + " ".join(FILLER))
    rows.append(f"{' '.join(FILLER)} please call 555-867-5309 soon")  # no plus sign: unknown to the fixed patterns
    rows.append("in the year 1999 or the year 2001 or the year 2024 nothing happened 12345678")
    return rows


def report(spark, rows):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return {r.doc_id: r for r in personal_data_report(frame).collect()}


def test_a_trusted_context_finds_an_unseen_identifier(spark):
    rows = texts()
    found = report(spark, rows)
    start = rows[8].index("555-867-5309")
    assert found[8].n_phone == 0
    assert found[8].spans == f"phone:{start}:{start + 12}"
    assert found[0].n_card == 1 and found[0].spans == found[0].spans.split(",")[0]
    assert all(found[i].n_phone == 1 for i in range(1, 8))
    assert found[9].spans == ""


def test_a_context_that_plain_words_follow_too_is_not_trusted(spark):
    rows = [*texts(), *[f"{w} please call {w} again" for w in FILLER]]
    assert report(spark, rows)[8].spans == ""


def test_null_empty_repeated_and_long_texts(spark):
    long = "7 " * 50_000 + "a@b.co"
    rows = [None, "", "x", "a@b.co", "a@b.co", long, "1.2.3.4.5.6.7.8 é +12 345 678 90", "1" * 20_000]
    found = report(spark, rows)
    assert [found[i].spans for i in (0, 1, 2)] == ["", "", ""]
    assert found[3].spans == found[4].spans == "email:0:6"
    assert found[5].spans == "email:100000:100006"
    assert found[6].spans == "ip:0:7,ip:8:15,phone:18:32"
    assert found[7].spans == ""


def test_an_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, spans string, kind int")
    assert personal_data_report(empty).collect() == []
    one = spark.createDataFrame([(None, "write a@b.co or c@d.org now", "s", 1)], "doc_id long, text string, size string, number int")
    assert personal_data_report(one).first().n_email == 2
    assert masked(one).first()[:] == (None, "write [EMAIL] or [EMAIL] now", "s", 1)


def seeds(lead: str, count: int = 9) -> list[str]:
    return [f"{' '.join(FILLER[: 3 + i % 5])} {lead} +1 (555) 555-{1000 + i:04d} soon" for i in range(count)]


def test_contexts_are_the_two_words_before_whatever_stands_there(spark):
    unseen = [
        "Please call 555-867-5301 as a whole text",
        "see line 2 please call\n555-867-5302 today",
        "so (please call <555-867-5303> today",
        "so please\tcall 555 867 5304 today",
        "555-867-5305 please call 555-867-5306",
    ]
    values = ["555-867-5301", "555-867-5302", "555-867-5303", "555 867 5304", "555-867-5306"]
    found = report(spark, [*seeds("please call", 40), *unseen])
    for i, (text, value) in enumerate(zip(unseen, values, strict=True), 40):
        start = text.index(value)
        assert f"phone:{start}:{start + 12}" in found[i].spans.split(",")


def test_a_word_with_digits_is_a_word_of_the_context(spark):
    rows = [*seeds("room 7", 20), "they said room 7 555-867-5309 soon"]
    assert report(spark, rows)[20].spans == "phone:17:29"


def test_seeds_with_blanks_do_not_outnumber_the_words_that_follow(spark):
    plain = [f"so please call {a}{b} again" for a in FILLER for b in FILLER]
    rows = [*seeds("please call", 200), *plain, "so please call 555-867-5309 soon"]
    assert report(spark, rows)[len(rows) - 1].spans == ""  # 200 phones among 322 instances


def test_punctuation_after_an_instance_makes_no_other_instance(spark):
    marks = ["", ",", ".", ";", "!"]
    rows = [f"please write to mail{i}@b.co{m} soon" for i in range(9) for m in marks]
    assert report(spark, [*rows, "please write to me7(at)b.co soon"])[len(rows)].spans == "email:16:27"
