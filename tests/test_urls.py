"""URL rules against the list of the query's contract."""

from geofeat.llm import urls

CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_rules_are_those_of_the_contract():
    assert {rule: act for act, rule in urls.RULES} == CONTRACT


def test_verdicts_of_rules(spark):
    expected = {
        "http://a.net/de/8": ("net/de/", "allow"),
        "http://www.Example.net/de/7": ("net/de/", "allow"),
        "http://www.example.net/de/81?x": ("example.net/de/8", "block"),
        "http://badexample.net/de/8": ("net/de/", "allow"),
        "http://example.com/en/71": ("example.com/en/7", "allow"),
        "http://example.com/en/8": ("com/en/", "block"),
        "https://x.org/es/": ("org/es/", "block"),
    }
    got = urls.judge(spark.createDataFrame([(u,) for u in expected], "url string")).collect()
    assert {r.url: (r.rule, r.verdict) for r in got} == expected
