"""Dirty names with the terms and queries expected of them; the cases are our own."""

import plain_names
import pytest
from pyspark.sql import functions as F

from tablemill.functions import name_parts

CASES = [
    ("Mira Kell - Night Ferry", "Mira Kell", "Night Ferry", None),
    ("A1. Mira Kell - Night Ferry (Extended Mix)", "Mira Kell", "Night Ferry", "Extended Mix"),
    ("07 - Mira Kell - Night Ferry", "Mira Kell", "Night Ferry", None),
    ("[XYZ 014] Mira Kell - Night Ferry [320 kbps]", "Mira Kell", "Night Ferry", None),
    ("mira_kell_-_night_ferry-qrst", "mira kell", "night ferry", None),
    ("Mira Kell – Night Ferry-www.somewhere.example", "Mira Kell", "Night Ferry", None),
    ("Mira Kell - Night Ferry (Dub] FLAC", "Mira Kell", "Night Ferry", "Dub"),
    ("Some Label Records - Mira Kell - Night Ferry", "Mira Kell", "Night Ferry", None),
    ("Mira Kell - Night Ferry Harbour Remix", "Mira Kell", "Night Ferry", "Harbour Remix"),
    ("Night Ferry", "", "Night Ferry", None),
    ("Mira Kell - B2 Night Ferry", "Mira Kell", "Night Ferry", None),
    ("Track", "", "", None),
    ("100Hz - Night Ferry", "100Hz", "Night Ferry", None),
    ("Night-Ferry - Mira Kell-LMNOPQ", "Night-Ferry", "Mira Kell", None),
    ("", "", "", None),
]


@pytest.mark.parametrize(("stem", "artist", "title", "version"), CASES)
def test_terms(stem, artist, title, version):
    assert plain_names.terms(stem) == (artist, title, version)


def test_ladder_is_distinct_and_ordered():
    steps = plain_names.ladder("Mira Kéll", "Night Ferry", "Dub", "Mira Kell - Harbour Songs", "Mira Kéll - Night Ferry (Dub)")
    assert steps == ["Mira Kéll Night Ferry Dub", "Mira Kéll Night Ferry", "Night Ferry", "Mira Kéll Harbour Songs"]
    assert plain_names.ladder("", "", None, "", "a-b c-d e") == ["a b c d e"]


def test_readable_stem(spark):
    rows = [
        ("01 - [CAT] Night_Ferry (vinyl rip) 320 kbps", "Night Ferry"), ("Night Ferry (Original Mix)", "Night Ferry (Original Mix)"), ("", ""), (None, None),
        ("(promo) (rip) 07. Night (Live) (promo)", "Night (Live) (promo)"), ("320", ""), ("12", "12"), ("7.\u00a0Night", "Night"), ("(rip", "(rip"),
    ]
    out = spark.createDataFrame(rows, "stem string, want string").select(name_parts.clean_stem(F.col("stem")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_name_parts_against_plain_python(spark):
    """The Column forms give what the row-by-row ones give, on names, scraps and odd ones."""
    names = [c[0] for c in CASES + MORE] + ["-", " - ", "a - b - c", "a--b", "a.-b c", "x-y", "Dub", "dub mix", "ABC 012", "320", "24 bits é1", "www.a.b", "Ünder_score-ab-12-XYZ", "a-12", "no.com", "ß - Ü"]
    cols = F.col("n")
    got = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", name_parts.bare(cols).alias("bare"), name_parts.kind(cols).alias("kind"), name_parts.fields(cols).alias("fields"),
        name_parts.untagged(cols, F.lit(True)).alias("small"), name_parts.untagged(cols, F.lit(False)).alias("large"),
    ).collect()
    for r in got:
        assert (r.bare, r.kind, r.fields) == (plain_names.bare(r.n), plain_names.kind(r.n), plain_names.fields_of(r.n)), r.n
        assert (r.small, r.large) == (plain_names.without_tags(r.n, True), plain_names.without_tags(r.n, False)), r.n


def test_name_parts_of_nothing(spark):
    n = F.lit(None).cast("string")
    out = spark.range(1).select(name_parts.kind(n), name_parts.bare(n), name_parts.normalised(n), name_parts.queries(n, F.lit("ab"), F.lit(" Abc "), F.lit("abc")), name_parts.trailing_phrase(F.lit("Remix")))
    assert tuple(out.first()) == (None, None, None, ["Abc"], ("Remix", None))


MORE = [  # a wider table of expected roles
    ("Alpha Bee_-_Night Song_(Club_Mix)-ab", "Alpha Bee", "Night Song", "Club Mix"),
    ("Alpha Bee - Night Song - Long Road - Far Home", "Night Song", "Long Road - Far Home", None),
    ("Alpha Bee - Night Song - Extended Mix", "Alpha Bee", "Night Song", "Extended Mix"),
    ("1999 - Alpha Bee - Night Song", "Alpha Bee", "Night Song", None),
    ("Alpha Bee - Night Song - Alpha Bee", "Night Song", "Alpha Bee", None),
    ("Alpha Bee - Night Song-DEADBEEF", "Alpha Bee", "Night Song", None),
    ("(A2) Alpha Bee - Night Song", "Alpha Bee", "Night Song", None),
    ("1-02 Alpha Bee - Night Song", "Alpha Bee", "Night Song", None),
    ("Alpha Bee--Night Song", "Alpha Bee", "Night Song", None),
    ("Alpha Bee - Untitled", "", "", None),
    ("Alpha Bee - Night Song [WEB-DL] (2004)", "Alpha Bee", "Night Song", None),
    ("Alpha Bee - Night Song (feat. Cee (Dub Mix))", "Alpha Bee", "Night Song", "feat. Cee"),
]


@pytest.mark.parametrize(("stem", "artist", "title", "version"), MORE)
def test_terms_of_more_names(stem, artist, title, version):
    assert plain_names.terms(stem) == (artist, title, version)


def test_search_terms_mine_the_folder(spark):
    rows = [("Night Song", "Alpha Bee - Best Of"), ("Night Song", "Somewhere"), (None, None), ("Alpha Bee - Night Song", "Cee - Dee")]
    frame = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "stem string, folder string, id int, _title int")
    out = name_parts.with_terms(frame, F.col("stem"), F.col("folder")).orderBy("_title").select("terms.artist", "terms.title", "terms.queries")
    assert [tuple(r) for r in out.collect()] == [
        ("Alpha Bee", "Night Song", ["Alpha Bee Night Song", "Night Song", "Alpha Bee Best Of"]), ("", "Night Song", ["Night Song"]), ("", "", []),
        ("Alpha Bee", "Night Song", ["Alpha Bee Night Song", "Night Song", "Alpha Bee Dee"]),
    ]


ODD = ["", "(", ")(", "((a) b) c", "x [[y] z", "a (Dub) b (Live) [FLAC]", "320 - kbps", "Alpha - Track", "A - B - C - D - Dub Mix", "Rec. - x - y - x", "a (b) (c 12)", "http://x.y Night - Song"]


def test_terms_as_columns_against_plain_python(spark):
    """Whole names: the Column forms against the row-by-row ones, with and without a folder."""
    names = [c[0] for c in CASES + MORE] + ODD
    rows = [(n, f) for n in names for f in ("", "Mira Kéll - Harbour Songs", "1999 - Some Records")]
    frame = spark.createDataFrame(rows, "stem string, folder string")
    plain = {row: plain_names.search_terms(*row) for row in rows}
    got = name_parts.with_terms(frame, F.col("stem"), F.col("folder")).collect()
    assert {(r.stem, r.folder): tuple(r.terms) for r in got} == plain


def test_names_of_one_file_are_dealt_over_tasks(spark):
    rows = spark.range(0, 400, 1, 1).select("id", F.concat(F.lit("Alpha Bee - Song "), "id").alias("stem"))
    found = name_parts.with_terms(rows, F.col("stem"), F.lit("")).select("id", "terms.artist", F.spark_partition_id().alias("p")).collect()
    sizes = {p: sum(r.p == p for r in found) for p in {r.p for r in found}}
    assert sorted(r.id for r in found) == list(range(400)) and {r.artist for r in found} == {"Alpha Bee"}
    assert len(sizes) == 4 and max(sizes.values()) <= 110
