import pytest
from pyspark.sql import functions as F

from docloom.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Bees, wasps; beetles?", ["bees", "wasps", "beetles"]),
        ("hive.open(wax)", ["hive", "open", "wax"]),
        ("queen_bee worker-bee", ["queen", "bee", "worker", "bee"]),
        ("Comb 6.25 kg", ["comb", "6", "25", "kg"]),
        ("\tone \r\n two ", ["one", "two"]),
        ("ÄPFEL Çilek ñandú", ["äpfel", "çilek", "ñandú"]),
        ("蜂 と 花", ["蜂", "と", "花"]),
        ("m" * 40 + " " + "n" * 41, ["m" * 40]),
        ("  ", []),
        ("?! ... ~~", []),
    ],
)
def test_tokens(spark, given, want):
    assert one(spark, text.tokens(F.lit(given))) == want


@pytest.mark.parametrize(("query", "want"), [("the queen of the hive", ["queen", "hive"]), ("of THE", ["of", "the"]), ("Wax wax WAX comb", ["wax", "comb"])])
def test_query_terms(spark, query, want):
    assert one(spark, text.query_terms(F.lit(query))) == want


def test_null_text_has_null_tokens(spark):
    assert one(spark, text.tokens(F.lit(None).cast("string"))) is None


def test_truncate(spark):
    long = one(spark, text.summary(F.lit(None).cast("string"), F.lit("word " * 100)))
    assert len(long) <= 241 and long.endswith("word…")
    assert one(spark, text.summary(F.lit(" own "), F.lit("plain"))) == "own"
    assert one(spark, text.truncate(F.lit("x" * 300))) == "x" * 240 + "…"
    assert one(spark, text.truncate(F.lit("a " + "é" * 300))) == "a " + "é" * 238 + "…"


def test_document_id(spark):
    a, b = (one(spark, text.document_id(F.lit(s), F.lit("https://a.example/"))) for s in ("hive", "comb"))
    assert len(a) == 16 and a != b


def test_colour_slot_equals_plain_python(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) % 2**32
        return h % 8

    for s in ("hive", "orchard-notes", "w" * 60):
        assert one(spark, text.colour_slot(F.lit(s))) == plain(s)


def test_relative_time(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    for then, want in (("2026-01-09 23:59:30", "just now"), ("2026-01-09 23:58:00", "2 minutes ago"), ("2026-01-09 00:00:00", "1 day ago"), ("2024-01-01 00:00:00", "2 years ago")):
        assert one(spark, text.relative_time(F.lit(then).cast("timestamp"), now)) == want


def test_flags_and_paths(spark):
    assert one(spark, text.flag_list(F.lit(" a, ,b,"))) == ["a", "b"]
    assert one(spark, text.display_url(F.lit("https://x.y/z"))) == "x.y/z"
    assert one(spark, text.document_path(F.lit("0123456789abcdef"))) == "docs/01/0123456789abcdef.json"


def test_routes_and_seconds(spark):
    route = text.search_route(F.lit("queen & hive"), F.array(F.lit("comb"), F.lit("moth")))
    assert one(spark, route) == "#/search?q=queen+%26+hive&s=comb%2Cmoth"
    back = one(spark, text.route_parts(route))
    assert (back["path"], back["query"], back["sources"], back["anchor"]) == ("/search", "queen & hive", ["comb", "moth"], "")
    assert one(spark, text.search_route(F.lit(""), F.lit(None).cast("array<string>"))) == "#/search"
    assert one(spark, text.route_parts(F.lit("#/doc/1?a=%zz")))["anchor"] == "%zz"
    assert str(one(spark, text.whole_seconds(F.lit("2026-01-02 03:04:05.678").cast("timestamp")))) == "2026-01-02 03:04:05"
