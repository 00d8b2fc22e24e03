from oracle import same_as_sql

from lakeline.llm import urls


def test_op2_equals_sql(spark):
    assert same_as_sql(spark, urls.op2_urls, urls.oracle(), "/root/testdata/sf0.01", ["pages"]) == 250


def test_rules_and_parts(spark):
    rows = [
        (1, "https://Example.COM/en/7?x", "a"), (2, "http://shop.example.com/en/712", "b"), (3, "x://example.com/en/8", "c"), (4, "http://badexample.com/en/7", "d"),
        (5, "http://a.example.net/de/81#t", "e"), (6, "http://a.net/de/81", "f"), (7, None, "g"), (8, "no scheme/en/", "h"), (9, "http://org/es/", "i"), (9, "http://org/es/", "i"),
        (None, "http://host?q/en/", "j"), (11, "http://k.org/ES/", "k"), (12, "http://com", "l"), (13, "http://É.com/en/", "m"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()}
    assert got == {
        1: ("example.com", "/en/7", "example.com/en/7", "allow"), 2: ("shop.example.com", "/en/712", "example.com/en/7", "allow"), 3: ("example.com", "/en/8", "com/en/", "block"),
        4: ("badexample.com", "/en/7", "com/en/", "block"), 5: ("a.example.net", "/de/81", "example.net/de/8", "block"), 6: ("a.net", "/de/81", "net/de/", "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("org", "/es/", "org/es/", "block"), None: ("host", "", None, "allow"), 11: ("k.org", "/ES/", None, "allow"),
        12: ("com", "", None, "allow"), 13: ("É.com", "/en/", "com/en/", "block"),
    }


def test_templates_generalise_merge_and_reject(spark):
    rows = [(i, f"http://s.com/{('en', 'fr')[i % 2]}/{i}") for i in range(60)]
    rows += [(100 + i, f"http://s.com/user/name{i}x/about") for i in range(40)]
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("/*/<n>", "block") and got[0] == ("/*/<n>", "block")
    assert got[101] == ("/user/*/about", "allow")


def test_empty(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert urls.judge_urls(spark.createDataFrame([(1, "http://a/{b}")], "page_id long, url string"), [("block", "a", "/{b}")]).first().verdict == "block"


def test_paths_that_differ_only_far_down_have_templates_of_their_own(spark):
    rows = [(i, f"http://s.com/en/a/b/c/d/e/{i}") for i in range(40)] + [(100 + i, f"http://s.com/x/a/b/c/d/f/{i}") for i in range(40)]
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("/en/a/b/c/d/e/<n>", "block") and got[101] == ("/x/a/b/c/d/f/<n>", "allow")


def test_variable_segments_below_variable_segments(spark):
    rows = [(i, f"http://s.com/u/{chr(97 + i % 26)}{chr(97 + i // 26)}/slug-{i * 7}-a") for i in range(600)]
    got = {r.template for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {"/u/*/*"}


def brute(rows):
    """Template of each URL by plain loops over a tree of the paths; fractions instead of whole-number tests."""
    from collections import Counter, defaultdict
    from fractions import Fraction

    import re

    def shape(x):
        if re.fullmatch("[0-9]+", x):
            return "<n>"
        if re.fullmatch("[0-9]+[.][a-z0-9]+", x):
            return "<n>" + x[x.rindex(".") :]
        return "<h>" if len(x) >= 8 and re.fullmatch("[0-9a-f]+", x) else "<s>" if len(x) > 32 else x

    def verdict(host, path):
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    pages = []
    for _, url in rows:
        host, _, path = url.split("://")[1].partition("/")
        path = "/" + path
        pages.append({"host": host.lower(), "label": verdict(host.lower(), path), "segs": [shape(x) for x in path.split("/") if x], "up": [], "rest": ""})
    depth = max(len(p["segs"]) for p in pages)
    for k in range(depth):
        below = defaultdict(list)
        for p in pages:
            if len(p["segs"]) > k:
                below[p["host"], tuple(p["up"])].append(p)
        for group in below.values():
            kinds = {p["segs"][k] for p in group}
            wild = len(kinds) >= 16 and len(group) < 4 * len(kinds)
            for p in group:
                p["up"] = [*p["up"], "*" if wild else p["segs"][k]]
    for k in range(depth - 1, -1, -1):
        below = defaultdict(lambda: defaultdict(list))
        for p in pages:
            if len(p["up"]) > k:
                below[p["host"], tuple(p["up"][:k])][p["up"][k]].append(p)
        for branches in below.values():
            rests = {b: Counter(p["rest"] for p in ps) for b, ps in branches.items()}
            families = defaultdict(list)
            for b, c in rests.items():
                families[min(c, key=lambda r: (-c[r], r.encode()))].append(b)
            for own in families.values():
                total = sum((rests[b] for b in own), Counter())
                size = total.total()
                alike = [b for b in own if rests[b].total() >= 10 and sum(abs(Fraction(rests[b][r], rests[b].total()) - Fraction(total[r], size)) for r in total) <= Fraction(1, 2)]
                tally = {b: (sum(p["label"] is not None for p in branches[b]), sum(p["label"] == "block" for p in branches[b])) for b in alike}
                for b in alike:
                    n1, b1 = tally[b]
                    n2, b2 = (sum(t[i] for t in tally.values()) - tally[b][i] for i in (0, 1))
                    if len(alike) >= 2 and (n1 == 0 or n2 == 0 or (b1 * n2 - b2 * n1) ** 2 * (n1 + n2) <= 3.84 * (b1 + b2) * (n1 + n2 - b1 - b2) * n1 * n2):
                        for p in branches[b]:
                            p["one"] = True
            for b, ps in branches.items():
                for p in ps:
                    p["rest"] = "/" + ("*" if p.pop("one", False) else b) + p["rest"]
    votes = defaultdict(list)
    for p in pages:
        p["template"] = p["rest"] or "/"
        votes[p["host"], p["template"]] += [p["label"]] * (p["label"] is not None)
    out = []
    for p in pages:
        v = votes[p["host"], p["template"]]
        out.append((p["template"], p["label"] or ("block" if len(v) >= 10 and Fraction(v.count("block") + 1, len(v) + 2) >= Fraction(8, 10) else "allow")))
    return out


def test_templates_and_verdicts_against_brute_force(spark):
    import random

    rng = random.Random(6)
    hosts, tops, kinds = ["a.com", "b.net", "c.org", "d.com"], ["en", "de", "es", "fr", "it", "x"], ["news", "blog", "shop"]
    rows = []
    for i in range(1500):
        parts = [rng.choice(tops)]
        if rng.random() < 0.9:
            parts.append(rng.choice(kinds))
        if rng.random() < 0.7:
            parts.append(rng.choice([f"name{rng.randrange(400)}", str(rng.randrange(99)), "all"]))
        if rng.random() < 0.5:
            parts.append(rng.choice([f"s-{rng.randrange(900)}", "about", "7.html"]))
        host = rng.choice(hosts)
        if host in ("b.net", "d.com"):  # branches that go on alike
            parts = [rng.choice(tops), rng.choice(kinds), str(rng.randrange(999))][: rng.choice([3, 3, 3, 1])]
        rows.append((i, f"http://{host}/" + "/".join(parts) * (rng.random() < 0.98)))
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(5)).collect()}
    want = brute(rows)
    assert [got[i] for i, _ in rows] == want and len({t for t, _ in want}) > 10 and any("*" in t.split("/")[1:2] for t, _ in want)
    assert sum(t.count("*") > 1 for t, _ in want) > 20
