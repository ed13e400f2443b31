from itertools import combinations

from pairgate.llm import urls

RULES = [("org/", "allow"), ("bad.org/x/", "block"), ("com/de/", "block"), ("com/fr/", "allow")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None, frozenset()
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    path = tail[:end]
    fits = [
        (len(r), r, v)
        for r, v in RULES
        if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])
    ]
    rule = max(fits)[1:] if fits else (None, None)
    bare = tail.split("#")[0]
    keys = bare.split("?", 1)[1].split("&") if "?" in bare else []
    tokens = {"h:" + x for x in host.split(".") if x} | {"p:" + x for x in path.split("/") if x}
    tokens |= {"q:" + k.split("=")[0] for k in keys if k.split("=")[0]}
    return host, path, *rule, frozenset(tokens)


def test_verdicts_equal_brute_force(spark):
    cases = [None, "", "nothing", "http://", "x://A.Org", "http://a.org/", "https://BAD.org/x/1?q=1", "http://notbad.org/x/",
             "ftp://m.bad.org/x/#f", "http://a.com/de/?b=1&c", "http://a.com/de/2", "http://b.com/fr/1", "http://org/z",
             "http://c.net/de/9?b=2", "http://d.net/fr/9", "a://b://c/d", "http://e.com?x/y", "http://xorg/q"]
    rows = cases + cases[:9] + [f"http://s{i}.com/de/p?b=1" for i in range(6)]
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(rows)], "page_id long, url string, host string")
    seen = {u or "": brute(u) for u in rows}
    labelled = [v for v in seen.values() if v[3]]
    rules = {}
    for v in labelled:
        for k in range(1, len(v[4]) + 1):
            for c in combinations(sorted(v[4]), k):
                hit = [x for x in labelled if set(c) <= x[4]]
                blocked = sum(x[3] == "block" for x in hit)
                if blocked >= 0.2 * len(labelled) and blocked >= 0.8 * len(hit):
                    rules[c] = blocked / len(hit)
    assert rules
    got = {r.page_id: r for r in urls.judge_urls(df, RULES, 0.2, 0.8).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        host, path, rule, verdict, tokens = brute(u)
        sure = max((c for r, c in rules.items() if set(r) <= tokens), default=None)
        want = verdict or ("block" if sure is not None else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict, got[i].confidence) == (host, path, rule, want, sure)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge_urls(df, RULES).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), RULES).count() == 0
