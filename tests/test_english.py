from pyspark.sql import functions as F

from tessera.functions.english import stem, stemmed, tokens
from tessera.operators.text import asked_terms, postings, rank_keywords, term_counts

#: The sample of words and stems published with the algorithm.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit
knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
#: Single rules: regions, exceptions, plurals, past forms, suffixes.
MORE = """dying die news news gas gas gaps gap this this kiwis kiwi ties tie cries cri skies sky generate generat generously generous communism communism arsenal arsenal hopping hop hoping hope hissing hiss falling fall luxuriated luxuri bedding bed bled bled
agreed agre feed feed by by say say cry cri relational relat conditional condit valency valenc digitizer digit conformably conform radically radic differently differ vilely vile analogously analog vietnamization vietnam operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl geology geolog reply repli electrical electr goodness good formative format adjustment adjust adoption adopt roll roll controll control cease ceas rate rate sky sky idly idl
proceeds proceed inning inning youth youth boyish boyish fluently fluentli singly singl excessively excess yellow yellow saying say""".split()


def test_published_words_and_single_rules():
    for words in (PUBLISHED, MORE):
        for word, want in zip(words[::2], words[1::2], strict=True):
            assert stem(word) == want, (word, stem(word), want)
    assert stem("straße") == "straße" and stem("naïveté") == "naïveté" and stem("a") == "a" and stem("") == ""


def test_tokens_by_type(spark):
    cases = {
        "The cats' e-mail": ["the", "cats", "e-mail", "e", "mail"],
        "Write to a.b@Host.example.org, or http://www.x.com/a/b?q=1. Then x.org:80": ["write", "to", "a.b@host.example.org", "or", "www.x.com/a/b?q=1", "www.x.com", "/a/b?q=1", "then", "x.org:80"],
        "3.1.2 -12.5 1e-9 7 x2y 5mm up-to-date": ["3.1.2", "-12.5", "1e-9", "7", "x2y", "5mm", "up-to-date", "up", "to", "date"],
        "<b>bold</b> a &amp; b &#65; foo_bar": ["bold", "a", "b", "foo", "bar"],
        "": [], " .,; ": [],
        "été naïve-été": ["été", "naïve-été", "naïve", "été"],
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.x and [y.token for y in r.x] for r in df.select("t", tokens(F.col("t")).alias("x")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == cases
    marked = df.limit(3).select(F.explode(tokens(F.col("t"))).alias("x")).filter("x.word").select("x.token").collect()
    assert {r.token for r in marked} == {"the", "cats", "e-mail", "e", "mail", "write", "to", "or", "then", "up-to-date", "up", "date"}


def test_long_texts_of_any_marks(spark):
    for text in ("a-" * 50_000, "x." * 50_000, "<" * 50_000, "1." * 50_000, "a@" * 50_000, "&" * 50_000, "/" * 50_000, "http://" * 10_000, "word " * 100_000):
        assert spark.createDataFrame([(text,)], "t string").select(F.size(tokens(F.col("t")))).first()[0] >= 0


def test_postings_and_ranking_by_stems(spark):
    docs = spark.createDataFrame([(1, "News", "dying stars, the Dying star-light"), (2, None, "gases and gas; see star.org/light"), (3, "", None)], "doc_id long, title string, text string")
    got = {(r.doc_id, r.term): r.positions for r in postings(docs, title_col="title").collect()}
    assert got == {(1, "news"): [1], (1, "die"): [2, 5], (1, "star"): [3, 7], (1, "star-light"): [6], (1, "light"): [8], (2, "gase"): [1], (2, "gas"): [3], (2, "see"): [4], (2, "star.org/light"): [5], (2, "star.org"): [6], (2, "/light"): [7]}
    queries = spark.createDataFrame([("q", ["Stars", "die"]), ("r", ["the"])], "query_id string, terms array<string>")
    counts = term_counts(docs, asked_terms(queries), title_col="title")
    assert [(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in rank_keywords(queries, counts).collect()] == [("q", 1, 0.4, 1)]
    assert spark.createDataFrame([("running",), (None,)], "w string").select(stemmed("w").alias("s")).collect()[0].s == "run"
