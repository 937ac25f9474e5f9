"""As-of list join against a plain evaluation of the change log."""

import datetime as dt

import numpy as np

from donorlens.llm import urlfilter


def plain_keys(url):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    if not m:
        return []
    host = m[1].lower().removesuffix(".")
    labels = host.split(".")
    out = [(2000, "host", host)]
    out += [(1000 + len(labels) - i, "domain", ".".join(labels[i:])) for i in range(len(labels) - 1)]
    p = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/+([^/?#]+)", url)
    if p:
        out.append((3000, "prefix", f"{host}/{p[1]}"))
    return out


def plain(captures, changes):
    log = {}
    for scope, key, on, action in changes:
        if None not in (scope, key, on, action):
            old = log.setdefault((scope, key), {}).get(on)
            log[scope, key][on] = min(action, old) if old else action
    rows = []
    for page, url, on in captures:
        active = []
        for rank, scope, key in plain_keys(url):
            past = [t for t in log.get((scope, key), {}) if on is not None and t <= on]
            action = log[scope, key][max(past)] if past else "remove"
            if action != "remove":
                active.append((rank, max(past), action, scope, key))
        top = max(active, default=None)
        rows.append((page, url, on, len(active), bool(top) and top[2] == "block",
                     " ".join(top[2:5]) if top else None))
    return sorted(rows, key=repr)


def test_equals_plain_evaluation(spark):
    rng = np.random.default_rng(0)
    start = dt.date(2024, 1, 1)
    hosts = ["a.example.com", "b.a.example.com", "Example.com", "x.org", "deep.b.a.example.com", "localhost", "X.org."]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/", "//en//1", "/en/1?q", "/de", "?x=/en", "#top", ":8080/en/2")]
    urls += [None, "", "not a url", "ftp://u:p@x.org/en", "//x.org/en", "http://"]
    captures = [(i, urls[rng.integers(len(urls))], start + dt.timedelta(int(rng.integers(0, 60)))) for i in range(300)]
    captures += [(7, urls[0], start)] * 3 + [(None, urls[2], start), (8, urls[2], None), (None, None, None)]
    keys = [("host", h.lower().removesuffix(".")) for h in hosts] + [("domain", "example.com"), ("domain", "a.example.com"),
                                                   ("prefix", "x.org/en"), ("prefix", "a.example.com/en")]
    changes = [(*keys[rng.integers(len(keys))], start + dt.timedelta(int(rng.integers(0, 60))),
                ["block", "allow", "remove"][rng.integers(3)]) for _ in range(60)]
    changes += changes[:3] + [(None, "x", start, "block"), ("host", None, start, "block"), ("host", "x.org", None, "block"),
                              ("host", "x.org", start, None)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").selectExpr("*", "'own' AS rank")
    log = spark.createDataFrame(changes, "scope string, key string, changed_on date, action string")
    got = urlfilter.judge(c, log)
    assert got.columns == ["page_id", "url", "fetched_on", "n_active", "blocked", "rule"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(captures, changes)
    assert urlfilter.judge(c.filter("false"), log).count() == 0
    assert urlfilter.judge(c, log.filter("false")).filter("n_active > 0 or blocked").count() == 0


def test_intervals_are_disjoint(spark):
    rows = [("host", "h", dt.date(2024, 1, d), a) for d, a in ((1, "block"), (5, "remove"), (9, "block"), (9, "remove"))]
    got = urlfilter.intervals(spark.createDataFrame(rows, "scope string, key string, changed_on date, action string"))
    assert sorted((r["valid_from"].day, r["valid_to"].day if r["valid_to"] else None) for r in got.collect()) == [
        (1, 5), (9, None)]


def test_prefixes_of_every_depth(spark):
    on = dt.date(2024, 1, 1)
    urls = ["http://h.org/a/b/c?x/y", "http://h.org/a/b/", "http://h.org/a", "http://h.org/a/bb", "http://h.org"]
    c = spark.createDataFrame([(i, u, on) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    log = spark.createDataFrame([("prefix", "h.org/a/b", on, "block"), ("prefix", "h.org/a", on, "allow")],
                                "scope string, key string, changed_on date, action string")
    got = {r["page_id"]: (r["n_active"], r["rule"]) for r in urlfilter.judge(c, log).collect()}
    deep, flat = (2, "block prefix h.org/a/b"), (1, "allow prefix h.org/a")
    assert got == {0: deep, 1: deep, 2: flat, 3: flat, 4: (0, None)}


def test_a_domain_entry_covers_the_host_of_its_name_and_entries_are_normalised(spark):
    on = dt.date(2024, 1, 1)
    urls = ["http://example.com/", "http://EXAMPLE.com.:80/x", "http://a.example.com", "http://anexample.com", "http://o.net//p/q/"]
    c = spark.createDataFrame([(i, u, on) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    log = spark.createDataFrame([("domain", "Example.COM.", on, "block"), ("prefix", "O.net//p/", on, "block")],
                                "scope string, key string, changed_on date, action string")
    got = {r["page_id"]: r["rule"] for r in urlfilter.judge(c, log).collect()}
    assert got == {0: "block domain example.com", 1: "block domain example.com", 2: "block domain example.com", 3: None,
                   4: "block prefix o.net/p"}


def test_a_url_of_a_hundred_thousand_segments(spark):
    on = dt.date(2024, 1, 1)
    url = "http://h.org" + "/s" * 100_000
    c = spark.createDataFrame([(1, url, on), (2, "http://h.org/" + "/".join(["x"] * 50_000), on)],
                              "page_id long, url string, fetched_on date")
    deep = "h.org" + "/s" * 40_000
    log = spark.createDataFrame([("prefix", "h.org/s/s/s", on, "allow"), ("prefix", deep, on, "block"),
                                 ("prefix", deep + "/t", on, "allow")], "scope string, key string, changed_on date, action string")
    got = {r["page_id"]: (r["n_active"], r["rule"]) for r in urlfilter.judge(c, log).collect()}
    assert got == {1: (2, "block prefix " + deep), 2: (0, None)}
