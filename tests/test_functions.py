from pyspark.sql import functions as F

from paperloom.functions import amounts, boxes, dates, match
from paperloom.functions import text as X


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    assert one(spark, "The  INVOICE\nis  for ACME!!!!!! and $5 .", X.clean_text) == "invoice acme!! $5"
    assert one(spark, None, X.clean_text) == ""
    assert one(spark, "", X.clean_text) == ""


def test_lines_split_like_python(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x85f g\n\n  \nh "
    assert one(spark, text, X.lines) == [s.strip() for s in text.splitlines() if s.strip()]


def test_ratios_of_nothing(spark):
    assert one(spark, None, X.digit_ratio) == 0.0
    assert one(spark, "", X.uppercase_ratio) == 0.0
    assert one(spark, "ÄbC1", X.uppercase_ratio) == round(2 / 3, 4)


def test_word_shape(spark):
    assert one(spark, "INV-12é", X.word_shape) == "AAA-00a"
    assert one(spark, "a" * 60, X.word_shape) == "a" * 40


def test_post_ocr_cleanup(spark):
    assert one(spark, "he|lo™", X.post_ocr_cleanup) == "hello"


def test_case_predicates_like_python(spark):
    for s in ["ABC 1", "Abc Def", "abc", "A", "ab Cd", "12", "Ärger Öl"]:
        assert one(spark, s, X.is_upper) == s.isupper(), s
        assert one(spark, s, X.is_title) == s.istitle(), s


def test_year_totals_vanish_in_v5(spark):
    assert one(spark, "2000.00", amounts.normalise_v5) is None
    assert one(spark, "2000.00", amounts.normalise) == "2000.00"
    assert one(spark, None, amounts.normalise_v5) is None


def test_iso_dates_are_not_read_from_version_1_on(spark):
    assert one(spark, "2024-01-15", dates.parse_named) is None
    assert one(spark, "due 5 March 2020", dates.parse_named) == "2020-03-05"


def test_date_candidates(spark):
    assert one(spark, "from 1/2/2020 to March 3, 2021 and 1/2/2020", dates.candidates) == ["2020-01-02", "2021-03-03"]


def test_matchers_of_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "g string, p string")
    for m in (match.match_string, match.match_number, match.match_date, match.match_amount):
        assert [r[0] for r in df.select(m(F.col("g"), F.col("p"))).collect()] == [False] * 3


def test_amount_tolerance(spark):
    df = spark.createDataFrame([("1000", "1005"), ("1000", "1020"), ("0.00", "0.00"), ("1337.0", "1337.00")], "g string, p string")
    assert [r[0] for r in df.select(match.match_amount(F.col("g"), F.col("p"))).collect()] == [True, False, True, True]


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    c = F.col
    x, y = (c("a"), c("b"), c("c"), c("d")), (c("e"), c("f"), c("g"), c("h"))
    got = df.select(boxes.iou(x, y), boxes.vertical_overlap(x, y)).collect()
    assert (round(got[0][0], 6), got[0][1]) == (round(1 / 7, 6), 0.5)
    assert tuple(got[1]) == (0.0, 0.0)


def test_buyer_name(spark):
    assert one(spark, "Buyer: Jane Roe\n1 Road", X.buyer_name) == "Jane Roe"
    assert one(spark, "Bill to:\nJane Roe", X.buyer_name) == "Jane Roe"
    assert one(spark, None, X.buyer_name) is None
