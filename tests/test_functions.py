"""Expressions on the cases the tables do not hold."""

import html
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from hustings import vocab
from hustings.functions import rules, score, text, votes, web


def one(spark, column, **values):
    cells = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cells).select(column.alias("x")).first()["x"]


def many(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "reference,base,number,again",
    [
        ("P.57/2026", "P.57/2026", None, False),
        ("P.57/2026(Amd)", "P.57/2026", 1, False),
        ("P.57/2026(Amd)(2)", "P.57/2026", 2, False),
        ("P.57/2026 Re-issue", "P.57/2026", None, True),
        ("P.57/2026 reissue(Amd)(11)", "P.57/2026", 11, True),
        ("{GUID-1}| P.1/2004 ", "P.1/2004", None, False),
        ("a|b|P.3/2005(Amd)", "P.3/2005", 1, False),
        ("Statement re-issue (Amd)", "Statement re-issue (Amd)", None, False),
        ("see P.1/2004", "see P.1/2004", None, False),
    ],
)
def test_reference(spark, reference, base, number, again):
    r = one(spark, votes.parse_reference(F.col("r")), r=reference)
    assert (r["base_ref"], r["amendment_number"], r["is_reissue"]) == (base, number, again)


def test_source_url(spark):
    assert one(spark, votes.source_url(F.col("r")), r="P.57/2026").endswith("/2026/p-57-2026")
    assert one(spark, votes.source_url(F.col("r")), r="Statement") is None


@pytest.mark.parametrize(
    "title,prop,expected",
    [
        ("Principles", None, "principles"),
        (None, "Draft (No. 2) Law principles", "principles"),
        ("x", "principles (No. 2) Law", "other"),
        ("As amended in third", "Third Reading", "third_reading"),
        ("third", "reading", "third_reading"),
        ("Article 3", "", "articles"),
        ("Articles", "", "other"),
        ("Amd of Paragraph 1", "", "amendment"),
        ("Paragraph (a) of regulations", "", "paragraph"),
        ("Regulations 1", "", "regulations"),
        ("", "motion to refer back", "procedural"),
        ("Whole proposition", "", "other"),
    ],
)
def test_stage(spark, title, prop, expected):
    assert one(spark, votes.stage(F.col("t"), F.col("p")), t=title, p=prop) == expected


def test_dates(spark):
    given = ["01/02/2024 09:05:00", "1/2/2024 9:5:0", "2024-02-01", "31/02/2024 00:00:00", "", None]
    found = many(spark, given, F.date_format(votes.parse_date(F.col("x")), "yyyy-MM-dd HH:mm:ss"))
    assert found == ["2024-02-01 09:05:00"] * 2 + [None] * 4


def test_names_and_positions(spark):
    assert many(spark, ["  A  B\t C\n", ""], votes.norm_name(F.col("x"))) == ["A B C", ""]
    given = ["Mr.", "Advocate", "Senators", "Connétable", "mr."]
    assert many(spark, given, votes.norm_position(F.col("x"))) == [
        "Deputy", "Deputy", "Senator", "Connétable", "mr.",
    ]


def test_vote_category_is_exact(spark):
    given = ["Pour", "pour", "Ill", "En défaut", "Unlisted"]
    assert many(spark, given, votes.vote_category(F.col("x"))) == [
        "active_vote", "unknown", "excused_absence", "unexcused_absence", "unknown",
    ]


def test_ties(spark):
    tie = {"p": 5, "c": 5}
    assert one(spark, votes.passed(F.col("p"), F.col("c")), **tie) is False
    assert one(spark, votes.majority(F.col("p"), F.col("c")), **tie) == 1
    assert one(spark, votes.closeness(F.col("p"), F.col("c")), **tie) == 0.5
    assert one(spark, votes.closeness(F.col("p"), F.col("c")), p=0, c=0) is None
    assert one(spark, votes.pour_share(F.col("p"), F.col("c")), p=0, c=0) == 50.0


def test_rounding_matches_exact_values(spark):
    generator = random.Random(7)
    given = [2.675, 0.125, 0.145, 0.285, 1.0, 0.0, 0.005, 0.015, 0.995]
    given += [generator.random() for _ in range(3000)]
    given += [generator.randrange(1000) / 1000 for _ in range(1000)]
    assert many(spark, given, score.round_hundredths(F.col("x")), "double") == [round(x, 2) for x in given]


def test_canonical_names(spark):
    given = ["Élise  O’Brien-Smith", "ﬁona ½", "Zoë Ñandú", "plain", "", "Øre ß"]

    def expected(name):
        parts = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        kept = "".join(c if c.isascii() and c.isalnum() or c.isspace() else " " for c in parts)
        return " ".join(kept.split()).lower()

    assert many(spark, given, text.canonical_name(F.col("x"))) == [expected(x) for x in given]
    assert many(spark, ["robert ward", "ward", "a b c"], text.initial_key(F.col("x"))) == ["r ward", None, "a c"]
    assert many(spark, ["Élise O'Brien ", "--"], text.slug(F.col("x"))) == ["elise-o-brien", ""]


def test_quotes(spark):
    source = "He said “we will – must” build homes.  Now"
    for quote, found in [
        ("we will - must", True),
        ("‘we will — must’ build homes. now", True),
        ('"we will', False),
        ("", False),
        ("gone", False),
    ]:
        assert one(spark, text.quote_matches(F.col("s"), F.col("q")), s=source, q=quote) is found


def test_anchors(spark):
    starts, ends = ["No previous convictions", "Previous convictions"], ["Proposers", "End"]
    cases = {
        "x PREVIOUS convictions a PROPOSERS b": "a",
        "Proposers no previous convictions a End b": "a",
        "no previous convictions rest ": "rest",
        "nothing": "",
        "previous convictions a no previous convictions b End": "b",
    }
    for given, expected in cases.items():
        assert one(spark, text.between_anchors(F.col("t"), starts, ends), t=given) == expected


def test_sections(spark):
    given = "intro\n\n**One** first\n more\n**Two**\n\n** not closed\n**Three**   x"
    found = one(spark, text.sections(F.col("t")), t=given)
    assert [(s["title"], s["body"]) for s in found] == [
        ("", "intro"),
        ("One", "first  more"),
        ("Two", "** not closed"),
        ("Three", "x"),
    ]
    assert one(spark, text.summary_fallback(F.col("s"), F.col("t")), s="", t=given) == "intro"
    assert one(spark, text.summary_fallback(F.col("s"), F.col("t")), s="own", t=given) == "own"


def test_entities(spark):
    given = [
        "a &amp;lt;b&gt; &nbsp;c", "&eacute;&#233;&#xe9;", "AT&T &notit; &copy", "&#39;&quot;", "none", "&amp;amp;",
    ]
    assert many(spark, given, web.unescape(F.col("x"))) == [html.unescape(x) for x in given]


def test_tags_after_entities(spark):
    given = "<p>a&lt;b&gt;c</p><br/>d<script>var x = '</p>';</script><P>e</P>"
    assert one(spark, web.strip_tags(F.col("h"), scripts=True), h=given) == "a c\n\nd e"


def test_article_drops_style_leftovers(spark):
    given = "<article class='x'>body { a } p{b}<p>Text .awlist1 > li:before { c }</p>li, table {d}</article>"
    assert one(spark, web.article_text(F.col("h")), h=given) == "Text"
    assert one(spark, web.article_text(F.col("h")), h="<p>x</p>") == ""


@pytest.mark.parametrize(
    "href,expected",
    [
        ("/a/b?x=1#y", "https://www.site.org/a/b?x=1"),
        ("c", "https://www.site.org/dir/c"),
        ("./c", "https://www.site.org/dir/c"),
        ("../c/./d/..", "https://www.site.org/c/"),
        ("../../../c", "https://www.site.org/c"),
        ("?q=1", "https://www.site.org/dir/page?q=1"),
        ("//sub.site.org/x", "https://sub.site.org/x"),
        ("http://other.org/x", "http://other.org/x"),
    ],
)
def test_resolve(spark, href, expected):
    base = "https://www.site.org/dir/page?old=1#f"
    assert one(spark, web.resolve(F.col("b"), F.col("h")), b=base, h=href) == expected


def test_same_site(spark):
    for a, b, same in [
        ("www.site.org", "site.org", True),
        ("a.site.org", "WWW.site.org", True),
        ("mysite.org", "site.org", False),
        ("", "site.org", False),
    ]:
        assert one(spark, web.same_site(F.col("a"), F.col("b")), a=a, b=b) is same


def test_ordered_rules(spark):
    listed = [
        rules.Rule("Money", [r"budget\b", r"stamp dut"], [r"financial services"]),
        rules.Rule("Services", [r"financial service"]),
        rules.Rule("Roads", [r"port", r"road", r"plan(?!.*budget)"]),
    ]
    given = ["The BUDGET", "Financial services budget", "A report", "Stamp duty", "Broadband", "none", "plan x"]
    assert many(spark, given, rules.topic_rules(F.col("x"), listed)) == [
        "Money", "Services", "Roads", "Money", "Roads", None, "Roads",
    ]
    table = spark.createDataFrame(
        [
            (i, r.category, kind, p)
            for i, r in enumerate(listed)
            for kind, ps in (("match", r.patterns), ("unless", r.unless))
            for p in ps
        ],
        "ordinal int, category string, kind string, pattern string",
    )
    read = rules.read_rules(table)
    assert [(r.category, sorted(r.patterns), sorted(r.unless)) for r in read] == [
        (r.category, sorted(r.patterns), sorted(r.unless)) for r in listed
    ]


def test_content_status(spark):
    given = ["", "   ", "w " * 149, "w " * 150, None]
    assert many(spark, given, text.content_status(F.col("x"))) == [
        "error", "error", "low_content", "ok", "error",
    ]


def test_contacts(spark):
    found = one(spark, text.contacts(F.col("t")), t="Party: N/A\nmail a.b@c.org or x@y.org, tel 01534 123 456 ")
    assert (found["email"], found["phone"], found["party"]) == ("a.b@c.org", "01534 123 456", "Independent")
    nothing = one(spark, text.contacts(F.col("t")), t="no such thing")
    assert (nothing["email"], nothing["phone"], nothing["party"]) == (None, None, None)


def test_vocabulary_sizes():
    assert len(vocab.TOPICS) == 16 and len(vocab.AREA_CONSTITUENCIES) == 12
