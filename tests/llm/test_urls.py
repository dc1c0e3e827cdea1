import random

from marginalia.llm.filters import URL_RULES
from marginalia.llm.url_templates import ALLOW, BLOCK, TemplateSpec, UrlRule, judge_urls


def judged(spark, urls, rules=URL_RULES, spec=TemplateSpec()):
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in judge_urls(frame, rules, spec=spec).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.ORG/x?y#z", "a.org", "/x", "org/", ALLOW),
        ("http://a.org", "a.org", "", None, ALLOW),
        ("http://a.org?q=/x", "a.org", "", None, ALLOW),
        ("http://xorg/", "xorg", "/", None, ALLOW),
        ("https://m.example.org/es/1", "m.example.org", "/es/1", "example.org/es/", BLOCK),
        ("https://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", BLOCK),
        ("https://badexample.org/es/1", "badexample.org", "/es/1", "org/", ALLOW),
        ("http://com/de/", "com", "/de/", "com/de/", BLOCK),
        ("ftp://É.com//a://b/c", "É.com", "//a://b/c", None, ALLOW),
        ("a\nb://c.com/x\ny?z", "c.com", "/x\ny", None, ALLOW),
        ("no scheme", "", "", None, ALLOW),
        ("", "", "", None, ALLOW),
        (None, "", "", None, ALLOW),
    ]
    got = judged(spark, [c[0] for c in cases])
    for at, (_, host, path, rule, verdict) in enumerate(cases):
        row = got[at]
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_a_template_is_rejected_by_its_labelled_pages(spark):
    rules = (UrlRule(BLOCK, "a.net", "/ads/x"), UrlRule(ALLOW, "a.net", "/news/x"))
    urls = [f"http://a.net/ads/x{i}" for i in range(5)] + [f"http://a.net/news/x{i}" for i in range(5)]
    got = judged(spark, [*urls, "http://a.net/ads", "http://a.net/ads/y", "http://a.net/news", "http://a.net/other", "http://b.net/ads"], rules)
    assert [got[i].verdict for i in range(10, 15)] == [BLOCK, BLOCK, ALLOW, ALLOW, ALLOW]


def test_variable_segments_become_wildcards(spark):
    names = [f"http://a.net/user/{chr(97 + i % 26)}{chr(97 + i // 26)}/show" for i in range(40)]
    got = judged(spark, [*names, "http://b.net/user/aa/show", "http://a.net/9/88.html", "http://a.net/1/2/3/4/5/6/"])
    assert {got[i].template for i in range(40)} == {"/user/*/show"}
    assert [got[i].template for i in (40, 41, 42)] == ["/user/aa/show", "/*/*.html", "/*/*/*/*/*/*"]


def test_evidence_of_similar_branches_is_pooled(spark):
    rules = (UrlRule(BLOCK, "a.net", "/b/"), UrlRule(BLOCK, "a.net", "/c/"), UrlRule(ALLOW, "a.net", "/d/"))
    urls = [f"http://a.net/b/{i}" for i in range(9)] + ["http://a.net/c/1"] + [f"http://a.net/d/{i}" for i in range(40)]
    got = judged(spark, [*urls, "http://a.net/c"], rules, TemplateSpec(strength=4.0))
    assert got[50].verdict == BLOCK  # one page alone would not outweigh the overall share


def test_empty_and_repeated_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, host string, rule string, key string")
    assert judge_urls(frame, URL_RULES).collect() == []
    rows = [(1, "http://a.org/x", "h", "r", "k"), (1, "http://a.org/x", "h", "r", "k"), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, frame.schema)
    assert [r.page_id for r in judge_urls(frame, URL_RULES).orderBy("page_id").collect()] == [None, 1, 1]


def plain_verdict(urls, segments, verdict_of, spec):
    """The verdict of a path of letters by loops over all labelled paths of the one host."""
    labelled = [(s, verdict_of(s) == BLOCK) for s in urls if verdict_of(s)]
    share = sum(bad for _, bad in labelled) / len(labelled)
    for depth in range(len(segments) + 1):
        counts = {}
        for s, bad in labelled:
            if len(s) >= depth and s[: depth - 1 if depth else 0] == segments[: depth - 1 if depth else 0]:
                n, b = counts.get(s[:depth], (0, 0))
                counts[s[:depth]] = (n + 1, b + bad)
        pools = []
        for name, (n, b) in sorted(counts.items(), key=lambda item: (item[1][1] / item[1][0], item[0])):
            if pools:
                names, n_pool, b_pool = pools[-1]
                p = (b + b_pool) / (n + n_pool)
                if b / n - b_pool / n_pool <= spec.z * (p * (1 - p) * (1 / n + 1 / n_pool)) ** 0.5:
                    pools[-1] = ([*names, name], n + n_pool, b + b_pool)
                    continue
            pools.append(([name], n, b))
        n, b = next(((n, b) for names, n, b in pools if segments[:depth] in names), (0, 0))
        share = (b + spec.strength * share) / (n + spec.strength)
    return BLOCK if share > spec.max_blocked else ALLOW


def test_a_ladder_of_small_steps_is_not_one_pool(spark):
    rules, paths = [], []
    for step in range(13):
        bad = round(50 * step / 12)
        name = chr(97 + step)
        paths += [f"/{name}/bad"] * bad + [f"/{name}/good"] * (50 - bad) + [f"/{name}/none"]
        rules += [UrlRule(BLOCK, "a.net", f"/{name}/bad"), UrlRule(ALLOW, "a.net", f"/{name}/good")]
    got = judged(spark, ["http://a.net" + p for p in paths], rules)
    verdicts = {r.path[1]: r.verdict for r in got.values() if r.path.endswith("none")}
    assert [verdicts[chr(97 + step)] for step in (0, 1, 2, 3)] == [ALLOW] * 4
    assert [verdicts[chr(97 + step)] for step in (9, 10, 11, 12)] == [BLOCK] * 4


def test_random_trees_agree_with_plain_loops(spark):
    deal = random.Random(5)
    for strength in (0.5, 6.0):
        spec = TemplateSpec(strength=strength)
        tend = {a: deal.random() for a in "abcdefgh"}
        paths = []
        for _ in range(900):
            a, b = deal.choice("abcdefgh"), deal.choice("klmn")
            leaf = deal.choice(["x"] * 3 + ["bad" if deal.random() < tend[a] else "good"])
            paths.append((a, b, leaf) if deal.random() < 0.8 else (a, leaf))
        paths += [(), ("z",), ("z", "k", "x")]
        rules = [UrlRule(v, "a.net", "/" + "/".join((*p[:-1], w))) for p in {p for p in paths if p}
                 for w, v in (("bad", BLOCK), ("good", ALLOW)) if p[-1] == w]
        got = judged(spark, ["http://a.net/" + "/".join(p) for p in paths], rules, spec)
        label = {"bad": BLOCK, "good": ALLOW}
        verdict_of = lambda s: label.get(s[-1]) if s else None
        want = {p: verdict_of(p) or plain_verdict(paths, p, verdict_of, spec) for p in set(paths)}
        assert {p: got[i].verdict for i, p in enumerate(paths)} == want
        assert {want[p] for p in paths if verdict_of(p) is None} == {ALLOW, BLOCK}


def test_pages_beside_labelled_ones_follow_the_host(spark):
    rules = (UrlRule(BLOCK, "a.net", "/ads/"),)
    urls = [f"http://a.net/ads/{i}" for i in range(9)] + ["http://a.net/", "http://a.net/new/x", "http://b.net/ads/1"]
    got = judged(spark, urls, rules)
    assert [got[i].verdict for i in (9, 10, 11)] == [BLOCK, BLOCK, ALLOW]


def test_each_rule_of_the_contract_gives_its_own_verdict(spark):
    cases = [
        ("http://a.org/x", "org/", ALLOW),
        ("http://a.example.org/es/7", "example.org/es/", BLOCK),
        ("http://a.example.org/en/17", "example.org/en/1", BLOCK),
        ("http://a.com/fr/7", "com/fr/", ALLOW),
        ("http://a.com/de/7", "com/de/", BLOCK),
    ]
    got = judged(spark, [c[0] for c in cases])
    assert [(got[i].rule, got[i].verdict) for i in range(5)] == [c[1:] for c in cases]
