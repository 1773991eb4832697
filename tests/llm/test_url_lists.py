from datetime import datetime, timedelta

import pytest

from reqsieve.llm import url_lists

START = datetime(2024, 1, 1)


def day(n):
    return None if n is None else START + timedelta(days=n)


CHANGES = [
    ("ads", "a.example.org", "add", 10), ("ads", "a.example.org", "add", 20), ("ads", "a.example.org", "remove", 30), ("ads", "A.example.org/", "add", 200),
    ("ads", "a.example.org", "add", 10), ("bad", "example.org", "add", 5), ("bad", "example.org", "remove", 400), ("dir", "a.example.org/x/y", "add", 0),
    ("dir", "b.example.org/x", "remove", 1), ("tie", "c.org", "add", 50), ("tie", "c.org", "remove", 50), ("null", "d.org", None, 1), (None, "d.org", "add", 1),
    ("n", None, "add", 1), ("n", "d.org", "add", None), ("n", "d.org", "block", 1), ("n", "", "add", 1),
]
URLS = [
    "http://a.example.org/x/y/z?q#f", "https://user:pw@A.EXAMPLE.ORG.:8080", "a.example.org/x", "//b.example.org/x", "http://example.org", "http://notexample.org/",
    "http://c.org/", "http://d.org/x", None, "", "http:///x", "ftp://deep.a.example.org/x/y", "http://a.example.org?x/y", "http://a.example.org//x//y", "localhost",
]


def host_and_folders(url):
    rest = url.split("://", 1)[1] if "://" in url else url
    for mark in "#?":
        rest = rest.split(mark)[0]
    authority, _, path = rest.partition("/")
    host = authority.rsplit("@", 1)[-1].split(":")[0].rstrip(".").lower()
    return host, [f for f in path.split("/") if f]


def brute(rows):
    out = []
    for key, url, at in rows:
        lists = []
        if url and at is not None and host_and_folders(url)[0]:
            host, folders = host_and_folders(url)
            log = {}
            for name, pattern, action, when in CHANGES:
                if None in (name, pattern, action, when) or action not in ("add", "remove") or not pattern:
                    continue
                if when <= at:
                    log.setdefault((name, pattern.lower().rstrip("/")), []).append((when, action))
            for (name, pattern), changes in log.items():
                last = max(w for w, _ in changes)
                if all(a == "add" for w, a in changes if w == last):
                    domain, *path = pattern.split("/")
                    if (host == domain or host.endswith("." + domain)) and folders[: len(path)] == path:
                        lists.append(name)
        out.append((key, sorted(set(lists)), len(lists), bool(lists)))
    return sorted(out, key=repr)


def captures(spark, rows):
    return spark.createDataFrame([(k, u, day(a), "x", 1) for k, u, a in rows], "page_id long, url string, fetched_at timestamp, list string, _key_slice int")


def changes(spark, rows=CHANGES):
    return spark.createDataFrame([(n, p, a, day(w)) for n, p, a, w in rows], "list string, pattern string, action string, at timestamp")


@pytest.mark.parametrize("broadcast", [True, False])
def test_brute_force(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(url_lists, "BROADCAST_ROWS", 0)
    rows = [(u * 100 + k, url, at) for u, url in enumerate(URLS) for k, at in enumerate((0, 5, 9, 10, 29, 30, 50, 199, 200, 399, 400, 900, None))]
    rows += [rows[3], rows[3], (None, URLS[0], 15)]
    frame = captures(spark, rows).repartition(3)
    found = url_lists.filter_urls(frame, changes(spark), "page_id")
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == broadcast
    assert sorted(((r.page_id, r.lists, r.n_entries, r.blocked) for r in found.collect()), key=repr) == brute(rows)
    active = url_lists.active_entries(frame, changes(spark)).collect()
    assert len(active) == sum(r[2] for r in brute(rows))
    assert all(r.valid_from <= r.fetched_at and (r.valid_to is None or r.fetched_at < r.valid_to) for r in active)


def test_intervals(spark):
    found = {tuple(r) for r in url_lists.validity_intervals(changes(spark)).collect()}
    assert found == {
        ("ads", "a.example.org", day(10), day(30)), ("ads", "a.example.org", day(200), None), ("bad", "example.org", day(5), day(400)),
        ("dir", "a.example.org/x/y", day(0), None),
    }


@pytest.mark.parametrize("broadcast", [True, False])
def test_deep_folders_capitals_and_single_labels(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(url_lists, "BROADCAST_ROWS", 0)
    log = [
        ("deep", "a.org/1/2/3/4/5", "add", 0), ("case", "A.org/News//Old/", "add", 0), ("com", "com", "add", 0), ("com", "com", "remove", 9),
        ("four", "x.a.org/1/2/3/4", "add", 0),
    ]
    expected = {
        "http://a.org/1/2/3/4/5/6.html": ["deep"], "http://x.A.org/1/2/3/4/5": ["deep", "four"], "http://a.org/1/2/3/4": [], "http://a.org/News/Old/x": ["case"],
        "http://a.org/news/old/x": [], "http://a.org/News": [], "http://one.com/x": ["com"], "http://deep.one.com": ["com"], "com": ["com"], "http://com.org": [],
    }
    frame = captures(spark, [(k, u, 1) for k, u in enumerate(expected)])
    found = url_lists.filter_urls(frame, changes(spark, log), "page_id")
    assert {r.url: r.lists for r in found.collect()} == expected
    active = url_lists.active_entries(frame, changes(spark, log)).collect()
    assert sorted((r.url, r.list) for r in active) == sorted((u, n) for u, names in expected.items() for n in names)


def test_empty(spark):
    rows = [(1, URLS[0], 15)]
    assert url_lists.filter_urls(captures(spark, []), changes(spark), "page_id").count() == 0
    assert [r.blocked for r in url_lists.filter_urls(captures(spark, rows), changes(spark, []), "page_id").collect()] == [False]
    assert url_lists.filter_urls(captures(spark, [(1, None, None)]), changes(spark), "page_id").first().blocked is False


def test_only_built_in_functions(spark):
    plan = url_lists.filter_urls(captures(spark, [(1, URLS[0], 15)]), changes(spark), "page_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
