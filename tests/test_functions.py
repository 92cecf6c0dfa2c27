import pytest
from pyspark.sql import functions as F

from kinshelf.functions import display, screening, text, titles, validation
from kinshelf.sources import catalogue as cat


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("title,error", [
    ("Orchards and Bees: A Novel", None), ("The Salt Road (Part 2)", None),
    ("", "title_missing"), (None, "title_missing"), ("   ", "title_blank"), ("a" * 501, "title_too_long"),
    ("a" * 500, None), ("The Keeper's Song", "title_forbidden"), ("a%27b", "title_forbidden"),
    ("a\\x27b", "title_forbidden"), ("ééé", "title_unusable"), ("Élan", None),
])
def test_title_rules(spark, title, error):
    assert one(spark, title, validation.title_error) == error


def test_title_keeps_allowed_characters_only(spark):
    assert one(spark, " Élan, vital! ", validation.clean_title) == "lan, vital!"


@pytest.mark.parametrize("raw,value,error", [
    ("7", 7, None), (" 12 ", 12, None), ("100", 100, None), ("0", 0, "limit_too_small"), ("-1", -1, "limit_too_small"),
    ("101", 101, "limit_too_large"), ("many", None, "limit_not_integer"), ("2.5", None, "limit_not_integer"),
    (None, None, "limit_not_integer"),
])
def test_limit_rules(spark, raw, value, error):
    assert one(spark, raw, validation.limit_value) == value
    assert one(spark, raw, validation.limit_error) == error


def test_a_numeric_limit_is_truncated(spark):
    assert one(spark, 2.5, validation.limit_value, "double") == 2


@pytest.mark.parametrize("raw,error", [
    ("0", None), ("1.0", None), ("0.5", None), ("1.01", "threshold_out_of_range"), ("-0.1", "threshold_out_of_range"),
    ("nan", "threshold_out_of_range"), ("x", "threshold_not_number"),
])
def test_threshold_rules(spark, raw, error):
    assert one(spark, raw, validation.threshold_error) == error


def test_sanitise(spark):
    assert one(spark, "  a'b\t  c%2d%2Dd ", titles.sanitise) == "ab cd"
    assert one(spark, "''", titles.sanitise) == ""
    assert len(one(spark, "x" * 1200, titles.sanitise)) == 1200
    assert len(one(spark, "x" * 1200, lambda c: titles.sanitise(c, 1000))) == 1000


def test_unicode_white_space_is_stripped(spark):
    assert one(spark, " \t a 　\n", titles.title_key) == "a"


def test_bigrams_bridge_stop_words(spark):
    tokens = one(spark, "story of the jazz age", lambda c: text.content_words(c, ["of", "the"]))
    assert tokens == ["story", "jazz", "age"]
    df = spark.createDataFrame([(["story", "jazz", "age"],), (["one"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(text.terms(F.col("t"))).collect()]
    assert got == [["story", "jazz", "age", "story jazz", "jazz age"], ["one"], []]


def test_clean_text_uses_the_whole_description(spark):
    df = spark.createDataFrame([("T", "abc def", None, "X|Y")], "t string, d string, a string, c string")
    assert df.select(text.clean_text(F.col("t"), F.col("d"), F.col("a"), F.col("c"))).first()[0] == "t abc def x y"


def test_reasons_use_strict_bounds(spark):
    df = spark.createDataFrame([(0.7,), (0.71,), (0.5,), (0.51,), (0.3,), (0.31,)], "s double")
    got = [r[0] for r in df.select(display.reason(F.col("s"))).collect()]
    assert got == ["Similar themes and writing style", "Very similar content and themes", "Shared categories and topics",
                   "Similar themes and writing style", "Related content", "Shared categories and topics"]


def test_display_defaults(spark, shelf):
    row = display.display(shelf.where("id = 1").withColumn("authors", F.lit(None).cast("string"))).first()
    assert (row.slug, row.authors, row.rating, row.rating_count) == ("", "Unknown", 0.0, 0)
    assert not row.description.endswith("...")
    assert display.display(shelf, "simple").first().description.endswith("...")


@pytest.mark.parametrize("a,b,same,same_simple", [
    (("Salt Road", "H. Maren"), ("Salt-Road; or, The Caravan", "h. maren "), False, False),
    (("Salt Road", "X"), ("Salt Road: A Novel", "x"), True, True),
    (("Salt Road", "X"), ("Salt Road", "Y"), False, False),
    (("The Big Red Dog", "X"), ("The Big Red Fox Story", "X"), False, True),
    (("Amber", None), ("Amber Falls", None), True, True),
])
def test_duplicates(spark, a, b, same, same_simple):
    df = spark.createDataFrame([(*a, *b)], "t1 string, a1 string, t2 string, a2 string")
    cols = [F.col(c) for c in ("a1", "t1", "a2", "t2")]
    got = df.select(titles.is_duplicate(*cols), titles.is_duplicate(*cols, profile="simple")).first()
    assert tuple(got) == (same, same_simple)


def test_screening(spark):
    assert one(spark, "GoogleBOT/2", screening.is_bot) and not one(spark, None, screening.is_bot)
    assert one(spark, "k" * 20, screening.valid_key_format)
    for bad in ("k" * 19, "k" * 101, "k" * 20 + " ", None, ""):
        assert not one(spark, bad, screening.valid_key_format)


def test_catalogue_keeps_books_without_live_members(spark):
    deleted = "timestamp'2024-01-01'"
    tables = {
        "books_with_details": spark.sql(
            "select id, concat('T', id) title, null slug, null cover_local_path, 'd' description, 1.0D average_rating,"
            " 1L rating_count, 'en' language, cast(null as timestamp) deleted_at from values (1L),(2L),(3L) as t(id)"),
        "book_authors": spark.sql("select * from values (1L,1L),(1L,2L),(1L,1L),(2L,3L) as t(canonical_book_id, author_id)"),
        "authors": spark.sql(f"select * from values (1L,'B',null),(2L,'A',null),(3L,'C',{deleted}) as t(id,name,deleted_at)"),
        "book_categories": spark.sql("select * from values (3L,1L) as t(canonical_book_id, category_id)"),
        "categories": spark.sql("select 1L id, 'K' name, cast(null as timestamp) deleted_at"),
    }
    got = {r.id: (r.authors, r.categories) for r in cat.load_catalogue(tables).collect()}
    assert got == {1: ("A|B", None), 2: (None, None), 3: (None, "K")}
