from pagemill.sources import wiki

PAGES = {
    "Ada": "Ada wrote [[Notes|notes]] on the [[Engine#Parts]] and [[Countess]].",
    "Notes": "Some notes of Ada.",
    "Engine": "An engine. [[Deeper]]",
    "Countess": "#REDIRECT [[Ada]]",
    "Deeper": "not fetched",
}


def fetch(titles):
    assert len(titles) <= 2
    if "Missing" in titles:
        raise OSError("no answer")
    return "".join(f"<page><title>{t}</title><text>{PAGES[t]}</text></page>" for t in titles)


def test_crawl(spark):
    got = {r.title: r.body for r in wiki.crawl(spark, ["Ada", "Ada"], fetch, 1).collect()}
    assert got == {"Ada": PAGES["Ada"], "Notes": PAGES["Notes"], "Engine": PAGES["Engine"], "Countess": PAGES["Ada"]}


def test_failures_are_left_out(spark):
    titles = spark.createDataFrame([("Ada",), ("Missing",), (None,)], "title string").coalesce(1)
    assert wiki.exports(titles, fetch, 1).count() == 1


def test_topic_dictionary(spark):
    base = spark.createDataFrame([("ada", 5), ("zebra", 1)], "word string, freq long")
    got = {r.word: r.freq for r in wiki.topic_dictionary(spark, ["Notes"], lambda t: fetch(t), base).collect()}
    assert got == {"some": 1, "notes": 1, "of": 1, "ada": 6, "zebra": 1}
