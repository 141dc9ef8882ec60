import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tallyroll.llm import urls

URLS = [
    "http://A.example.net/en/1", "https://example.net/enx", "https://x.net", "https://x.net/?a=/", "http://org/fr/2", "http://o.org/fr",
    "http://www.example.com/de/9?q=/x", "http://wwwexample.com/de/9", "noscheme/path", "", None, "a://b://c/d", "http://h/p#f/g",
    "http://ÄB.Example.COM/de/", "http://h.com:80/de/1",
] + [f"http://many.com/{c}{c}{c}/1" for c in "abcdefghijklmnopqrstuvwxyzåéîøüç🙂ßñ"] + [f"http://bad.example.com/de/{i}" for i in range(60)] + [
    f"http://bad.example.com/en/{i}" for i in range(5)]


def test_against_sql(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = urls.filter_urls(pages)
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = db.execute(urls.SQL)
    names = [c[0] for c in want.description]
    assert got.columns == names
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    by = {r.page_id: r for r in got.collect()}
    assert (by[0].rule, by[0].verdict, by[0].host) == ("example.net/en/", "allow", "a.example.net")
    assert (by[1].rule, by[1].verdict) == ("net/", "block") and by[2].rule is None and by[3].rule == "net/"
    assert (by[4].rule, by[5].rule, by[6].rule, by[7].rule) == ("org/fr/", None, "example.com/de/", None)
    assert all((by[i].host, by[i].path) == ("", "") for i in (8, 9, 10)) and by[11].host == "b:"
    # urls that no rule names follow their template: here most pages of the branch are blocked
    assert all(by[i].verdict == "block" for i, u in enumerate(URLS) if u and u.startswith("http://bad.example.com/en"))
    assert by[14].verdict == "allow" and by[20].template == "many.com/*/<n>"


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=7)) for i in range(900)]


def tree_by_hand(pages):
    """Template and purity of every (host, shape), node by node, from (host, shape, bad) rows."""
    n, bad, out = Counter(), Counter(), {}
    for host, shape, b in pages:
        n[host, shape] += 1
        bad[host, shape] += b
    prior = sum(bad.values()) / sum(n.values())

    def smooth(leaves, parent):
        return (sum(bad[x] for x in leaves) + 10 * parent) / (sum(n[x] for x in leaves) + 10)

    def shares(leaves, level):
        c = Counter()
        for x in leaves:
            c[parts[x][level] if level < len(parts[x]) else ""] += n[x]
        return c

    def js(a, b):
        ta, tb, sum_ = sum(a.values()), sum(b.values()), 0.0
        for k in a | b:
            p, q = a[k] / ta, b[k] / tb
            sum_ += sum(w / 2 * math.log2(2 * w / (p + q)) for w in (p, q) if w)
        return round(sum_, 9)

    def grow(prefix, leaves, level, purity):
        below = defaultdict(list)
        for x in leaves:
            if level < len(parts[x]):
                below[parts[x][level]].append(x)
            else:
                out[x] = prefix, purity
        size = {seg: sum(n[x] for x in xs) for seg, xs in below.items()}
        rest = [v for v in size.values() if v * 16 < sum(size.values())]
        variable = sum(rest) ** 2 >= 16 * sum(v * v for v in rest)
        name = {seg: "*" if v * 16 < sum(size.values()) and variable else seg for seg, v in size.items()}
        pools = defaultdict(list)
        spread = {seg: shares(xs, level + 1) for seg, xs in below.items()}
        for seg in below:
            top = max((v, k) for k, v in spread[seg].items())[1]
            if name[seg] != "*" and size[seg] >= 5 and top:
                pools[top].append(seg)
        for segs in pools.values():
            pool = sum((spread[s] for s in segs), Counter())
            near = [s for s in segs if len(segs) > 1 and js(spread[s], pool) <= 0.05]
            if len(near) > 1:
                name.update(dict.fromkeys(near, "{" + min(near) + "}"))
        nodes = defaultdict(list)
        for seg, xs in below.items():
            nodes[name[seg]] += xs
        for label, xs in nodes.items():
            grow(f"{prefix}/{label}", xs, level + 1, smooth(xs, purity))

    parts = {x: re.sub("^/", "", x[1]).split("/", 7) for x in n}
    hosts = defaultdict(list)
    for x in n:
        hosts[x[0]].append(x)
    for host, leaves in hosts.items():
        grow(host, leaves, 0, smooth(leaves, prior))
    return out


def test_tree_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for host in ("a.org", "b.org", "c.org"):
        for _ in range(1200):
            depth = r.choice([0, 1, 2, 3, 4, 9])
            path = "".join("/" + (r.choice("xyz") if r.random() < 0.6 else r.choice(WORDS[:60])) for _ in range(depth))
            rows.append((host, path + r.choice(["", "", "/"]), path.startswith("/x") and r.random() < 0.7))
    rows += [("d.org", f"/{s}/{w}/{t}", s == "x") for s in ("x", "y", "z") for w in "klm" for t in WORDS[:40]]
    got = urls.template_purity(spark.createDataFrame(rows, "host string, shape string, bad boolean")).collect()
    want = tree_by_hand(rows)
    assert {(g.host, g.shape): g.template for g in got} == {x: t for x, (t, _) in want.items()}
    assert all(math.isclose(g.purity, want[g.host, g.shape][1], rel_tol=1e-9) for g in got) and len(got) == len(want)
    named = {t for t, _ in want.values()}
    assert any("/*" in t for t in named) and "d.org/{x}/{k}/*" in named


def test_slugs_at_any_depth_and_clean_sections(spark):
    paths = [f"https://shop.org/blog/{w}" for w in WORDS[:600]] + [f"https://shop.org/about/{w}" for w in WORDS[600:]]
    paths += [f"https://shop.org/blog/2024/{w}" for w in WORDS[:100]]
    paths += [f"https://bad.example.com/de/{w}" for w in WORDS[:400]] + [f"https://bad.example.com/docs/{w}" for w in WORDS[400:550]]
    pages = spark.createDataFrame(list(enumerate(paths)), "page_id long, url string")
    got = urls.filter_urls(pages).collect()
    assert {g.template for g in got if g.host == "shop.org"} == {
        "shop.org/blog/*", "shop.org/about/*", "shop.org/blog/<n>/*"}
    assert all(g.verdict == ("block" if g.path.startswith("/de/") else "allow") for g in got)
    # more crawled pages of the same urls, or one hot page, change no template
    again = [(i * 10 + k, u) for i, u in enumerate(paths) for k in range(4)] + [(10**6 + k, paths[0]) for k in range(1200)]
    more = urls.filter_urls(spark.createDataFrame(again, "page_id long, url string")).collect()
    hot = {g.template for g in more if g.path == "/blog/" + WORDS[0]}
    assert hot == {"shop.org/blog/" + WORDS[0]}  # a third of its parent's pages: a branch of its own
    rest = {(g.host, g.path): g.template for g in more if g.path != "/blog/" + WORDS[0]}
    assert rest == {(g.host, g.path): g.template for g in got if g.path != "/blog/" + WORDS[0]}
