import duckdb
import pytest

from reviewloom.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM/en/x", "https://www.example.com/en/?q=1", "https://www.example.com/en",
    "http://x.www.example.com/en/a#f", "http://notexample.com/en/", "ftp://b.net/es/1", "ftp://b.net/ES/1", "http://b.net/fr/",
    "http://net/fr/x", "http://a.org/free-porn/1", "http://a.org/pornography", "http://a.org/casino", "http://a.org/casino/poker?x",
    "http://a.org/casino-casino", "http://a.org/?u=XXX", "http://a.org?casino&Poker", "http://a.org#x/y", "porn", "http://éx.com/\ny",
    "a://b://c.com/d", "http://u:p@h.com:80/x", "http://a.com", "http://a.org/1porn1",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, URLS[4], "h", "v"), (3, URLS[3], "h", "v")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")


def test_verdicts(pages):
    got = {r.page_id: r for r in urls.url_filter(pages).where("page_id is not null").collect()}
    by = {u: got[i] for i, u in enumerate(URLS)}
    assert (by["http://A.Example.COM/en/x"].host, by["http://A.Example.COM/en/x"].rule) == ("a.example.com", "example.com/en/")
    assert by["https://www.example.com/en/?q=1"].verdict == "allow"
    assert by["https://www.example.com/en"].rule == "com/"
    assert by["http://notexample.com/en/"].rule == "com/"
    assert by["ftp://b.net/es/1"].verdict == "block" and by["ftp://b.net/ES/1"].rule is None
    assert by["http://net/fr/x"].rule == "net/fr/"
    assert by["http://a.com"].rule is None  # an empty path doesn't start with /
    assert by["http://a.org/free-porn/1"].verdict == "block" and by["http://a.org/pornography"].verdict == "allow"
    assert by["http://a.org/casino-casino"].verdict == "allow" and by["http://a.org/casino/poker?x"].verdict == "block"
    assert by["http://a.org/1porn1"].verdict == "allow"
    assert by[None].host == by[None].path == by["no scheme"].host == "" and by[None].verdict == "allow"
    assert by["a://b://c.com/d"].host == "b:"


def test_against_sql(pages):
    rows = urls.url_filter(pages).collect()
    connection = duckdb.connect()
    frame = pages.toPandas()
    connection.register("pages", frame)
    cursor = connection.execute(urls.filter_sql())
    columns = [d[0] for d in cursor.description]
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    fixed = [(None if r[0] != r[0] or r[0] is None else int(r[0]), *r[1:]) for r in cursor.fetchall()]
    assert plain([tuple(r[c] for c in columns) for r in rows]) == plain(fixed)


def test_empty_table_and_own_vocabulary(spark, pages):
    assert urls.url_filter(pages.limit(0)).count() == 0
    got = urls.url_filter(pages, rules=[], vocabulary={("strict", "any"): ["en"]}).where("page_id = 4").first()
    assert (got.rule, got.verdict) == (None, "block")


BAD = [
    "https://adult-x.example.net/en/1", "https://adult-x.example.net/de/2", "http://cheap-pills.example.org/", "http://free-bets.example.org/a",
    "http://spam-farm.example.org/p/3", "http://casino-win.example.org/", "http://ads-track.example.org/px.gif",
    "http://shop.example.org/cheap/pills?id=1", "http://a.example.org/best-slots-bonus", "http://a.example.org/loans/payday",
    "http://my.example.org/x-rated/1", "http://www.adult-x.example.net/de/3", "http://m.casino-win.example.org/en/4",
    "http://www.adult.com", "http://porntube1.com", "http://bestcasino.bet", "https://m.sex.org/", "http://free.xxx/", "http://ads.tracker.org/p",
    "http://user@poker.org:80/x", "http://a.org/replica-rolex", "http://hookup.org/escorts",
]
CLEAN = [
    "https://en.example.org/wiki/Sussex", "https://news.example.org/sport/winter-games", "https://a.example.org/health/adult-education",
    "https://a.example.org/recipes/free-range-eggs", "https://a.example.org/farm/animals", "https://a.example.org/music/track/12",
    "https://law.example.org/sex-discrimination-act", "https://uni.example.org/adsorption/spills", "https://a.example.org/windows/freedom",
    "https://history.example.org/roads/better-tracks", "https://docs.example.org/bank/loan-basics",
    "https://school.org/girls/track", "https://bank.org/loans/debt-help", "https://nhs.uk/pharmacy/prescription",
    "https://nytimes.org/free-money-tips", "https://farm.gov/track/cattle", "https://docs.python.org/3/hot/track-changes",
    "https://a.org/login?u=https://ads.example.org/x", "https://essex.ac.uk/adult-education", "https://library.org/adult/sex-education",
    "https://adult-learning.org/courses", "https://security.org/phishing/malware", "https://calendar.org/free-slots",
    "https://x.org/adult", "https://a.org/wiki/Casino_Royale", "https://poker-face.org/", "https://adsorption.org/bets", "https://beta.org/win",
]


def test_bad_and_clean_addresses(spark):
    pages = spark.createDataFrame(list(enumerate(BAD + CLEAN)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.url_filter(pages).where("rule is null").collect()}
    assert [got[i] for i in range(len(BAD + CLEAN))] == ["block"] * len(BAD) + ["allow"] * len(CLEAN)
