"""Golden texts of proposal repair, titles and summaries."""

from pyspark.sql import functions as F

from parcelflow.functions import proposals as P


def of(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_titles(spark):
    got = lambda t: of(spark, P.title, t)
    assert got("The works include 2no. modified shipping containers for the site. Further details follow.") == "The works include 2no. modified shipping containers for the site."
    assert got("See application ref. 21/4057 for the related permission. Further details follow.") == "See application ref. 21/4057 for the related permission."
    assert got("Permission for alterations to the dwelling. The works include a rear extension.") == "Permission for alterations to the dwelling."
    retained = "The development to be retained consists of (1) the erection of 2no. modified shipping containers for use as a drive-thru coffee kiosk, with ancillary storage and staff facilities; associated signage and site works."
    assert got(retained) == "Retention: erection of 2no. modified shipping containers for use as a drive-thru coffee kiosk…"
    full = "Permission for construction of a replacement dwelling with revised access arrangements, installation of a wastewater treatment system and polishing filter, landscaping works and all associated site development works"
    assert got(full) == "Permission for construction of a replacement dwelling with revised access arrangements…"
    assert got("Permission for construction of two storey dwelling house, detached domestic gara") == "Permission for construction of two storey dwelling house…"
    assert got(" N/A ") == got(None) == "Planning application" and got("(retention) of shed") == "(Retention) of shed"


def test_summaries(spark):
    text = "Retention permission for alterations to an agricultural building including revised elevations and internal layout changes, together with drainage works and landscaping"
    assert of(spark, lambda c: P.summary(c, "Fallback", 100), text) == "Retention permission for alterations to an agricultural building including revised elevations…"
    words = "w" * 50 + " " + "x" * 60 + " " + "y" * 90
    assert of(spark, P.summary, words) == "W" + "w" * 49 + " " + "x" * 60 + "…"
    assert of(spark, P.summary, "z" * 300) == "Z" + "z" * 154 + "…"


def test_repair(spark):
    got = lambda t: tuple(of(spark, P.repaired, t))
    cut = "Permission for: 1) Demolition of existing attached garage on the west side, 2) P"
    assert got(cut) == ("Permission for demolition of existing attached garage on the west side…", cut, True)
    limit = "Permission for construction of two storey dwelling house, detached domestic gara"
    assert got(limit) == ("Permission for construction of two storey dwelling house…", limit, True)
    for whole in ("Permission for a single-storey rear extension.", "Permission for the construction of a dwelling, alterations to the existing entrance, connection to public services and all associated site works."):
        assert got(whole) == (whole, None, False)
    long = "Permission for the construction of a dwelling and a garage beside the old road that leads to the"
    assert got(long) == (long[:-4].rstrip() + "…", long, True)
    assert got("x" * 73 + " garage") == ("X" + "x" * 72 + "…", "x" * 73 + " garage", True)
    assert got("y" * 80) == ("Y" + "y" * 79 + "…", "y" * 80, True)
    assert got(None) == got("  ") == ("Proposal description not recorded", None, False)
    assert got("short, of") == ("Short, of", None, False) and got("A shed, 2) b") == ("A shed…", "A shed, 2) b", True)


def test_choice(spark):
    got = lambda a, b: of(spark, P.authoritative, a, b)
    assert got("abc", "ab  cd") == "ab cd" and got("abc", "ab") == "abc" and got(None, " ") is None and got("a", None) == "a" and got("ab", "cd") == "cd"


def test_a_capital_is_one_letter(spark):
    """As in the SQL twins: before, ß became two letters."""
    assert of(spark, P.summary, "ßheit nicht") == "ẞHeit nicht"
    assert of(spark, P.summary, "ŉ 1") == "ŉ 1" and of(spark, P.summary, "ᾀ 1") == "ᾈ 1" and of(spark, P.summary, "äb") == "ÄB"
    assert of(spark, P.title, "ßheit nicht") == "ẞHeit nicht" and of(spark, P.title, "The development to be retained consists of İ 1") == "Retention: i 1"
