from gridloom.llm.url_filter import SOFT, STRICT, automaton, blocked, filter_urls


def test_rules_vocabulary_and_odd_urls(spark):
    cases = {
        "http://a.example.org/es/x": ("block", "example.org/es/"), "https://EXAMPLE.org/en/12": ("block", "example.org/en/1"), "http://example.org/en/2": ("allow", "org/"),
        "http://x.com/fr/a?b#c": ("allow", "com/fr/"), "http://x.com/de/a": ("block", "com/de/"), "http://notexample.org": ("allow", None),
        "http://myorg/": ("allow", None), "http://x.net/casino": ("block", None), "http://x.net/casinos": ("allow", None), "http://x.net/free-ads": ("block", None),
        "http://x.net/free/free": ("allow", None), "http://xxx.net": ("block", None), None: ("allow", None), "": ("allow", None), "nothing/here": ("allow", None), "a://b://c/d": ("allow", None), "http://x.net/" + "a" * 50_000: ("allow", None),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*cases, *cases])], "page_id long, url string, rule string")
    rows = filter_urls(df).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.verdict, r.rule) == cases[r.url], r.url
    by = {r.url: r for r in rows}
    assert (by["https://EXAMPLE.org/en/12"].host, by["https://EXAMPLE.org/en/12"].path) == ("example.org", "/en/12")
    assert (by["http://x.com/fr/a?b#c"].path, by[None].host, by["nothing/here"].path, by["a://b://c/d"].host) == ("/fr/a", "", "", "b:")
    assert filter_urls(df.limit(0)).count() == 0


def test_every_term_counts_between_boundaries_only():
    made = automaton(STRICT, SOFT)
    for t in STRICT:
        assert blocked(t, made) and blocked(f"a/{t}.b", made) and not blocked(f"q{t}", made) and not blocked(f"{t}7", made)
    for a in SOFT:
        assert not blocked(f"{a}/{a}", made)


def test_any_column_name_and_long_urls(spark):
    long = "http://x.net/" + "a" * 200_000
    df = spark.createDataFrame([(1, long + "/casino", 1, 2), (2, long, 1, 2), (3, "http://a.com/de/casino", 1, 2), (4, None, 1, 2)], "page_id long, `the.url` string, __text int, found int")
    out = filter_urls(df, url_col="the.url")
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict"]
    assert [(r.verdict, r["__text"], r["found"]) for r in sorted(out.collect(), key=lambda r: r.page_id)] == [("block", 1, 2), ("allow", 1, 2), ("block", 1, 2), ("allow", 1, 2)]
