import math
import re
from collections import Counter, defaultdict

from shelfsift.llm import templates
from shelfsift.llm.queries import QUERIES, URL_RULES


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def brute(pages, labels, rules):
    """{page: (host, path, rule, template, purity, verdict)}"""
    split = {p: parts(u) for p, u in pages.items()}
    segments = {p: (path[1:].split("/") if path else []) for p, (_, path) in split.items()}
    seen = Counter((split[p][0], len(s), i, x) for p, s in segments.items() for i, x in enumerate(s))
    literal = {k for k, n in seen.items() if n >= templates.LEAST_ROWS}
    template = {
        p: "".join("/" + ("\\" * x.startswith(("*", "~", "\\")) + x if (split[p][0], len(s), i, x) in literal else "*") for i, x in enumerate(s)) for p, s in segments.items()}
    good, count = defaultdict(float), defaultdict(int)
    for p in pages:
        if labels.get(p) is not None:
            good[split[p][0], template[p]] += labels[p]
            count[split[p][0], template[p]] += 1
    keys = {(split[p][0], template[p]) for p in pages}
    parent = {k: (k[0], re.sub("/[^/]*$", "", k[1])) for k in keys}
    all_good, all_count = Counter(), Counter()
    for k in keys:
        all_good[parent[k]] += good[k]
        all_count[parent[k]] += count[k]
    merged = {}
    for k in keys:
        g, n, ag, an = good[k], count[k], all_good[parent[k]], all_count[parent[k]]
        share = (ag + 1) / (an + 2)
        differs = n > 0 and abs(g / n - ag / an) > templates.SAME * math.sqrt(share * (1 - share) * (1 / n + 1 / an))
        merged[k] = (k[0], k[1] if differs else parent[k][1] + "/~")
    sums, sizes = Counter(), Counter()
    for k, m in merged.items():
        sums[m] += good[k]
        sizes[m] += count[k]
    total = sum(count.values())
    overall = sum(good.values()) / total if total else 1.0
    out = {}
    for p in pages:
        host, path = split[p]
        m = merged[host, template[p]]
        purity = (sums[m] + templates.STRENGTH * overall) / (sizes[m] + templates.STRENGTH)
        name, verdict = rule(host, path, rules)
        out[p] = (host, path, name, m[1], round(purity, 6), verdict or ("block" if purity < templates.LEAST_PURITY else "allow"))
    return out


def found(df):
    return {r[0]: (r["host"], r["path"], r["rule"], r["template"], round(r["purity"], 6), r["verdict"]) for r in df.collect()}


def test_pages_equal_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert found(QUERIES["op7_url_templates"](spark, folder)) == brute(pages, labels, URL_RULES)


def test_tree_merges_and_blocks(spark):
    pages, labels = {}, {}
    for i in range(600):
        kind = ("spam", "news", "blog")[i % 3]
        pages[i] = f"http://X.Example.com/{kind}/{i}.html?q=1"
        if i % 2:
            labels[i] = 0 if kind == "spam" else 1
    for i, u in enumerate([None, "", "no scheme", "a://", "a://h", "a://h?x", "a://h/#/y", "A://H//", "x://y://z/w", "http://a.net/EN/", "http://example.net/en/", "http://q.org\n/fr/x"], 600):
        pages[i] = u
    got = found(templates.judge(spark.createDataFrame(list(pages.items()), "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, good int"), URL_RULES))
    assert got == brute(pages, labels, URL_RULES)
    assert {v[-1] for p, v in got.items() if p < 600 and p % 3 == 0} == {"block"}
    assert {v[-1] for p, v in got.items() if p < 600 and p % 3} == {"allow"}


def test_edges(spark):
    pages = spark.createDataFrame([(None, "http://a/b", "x"), (1, None, "y"), (1, None, "y"), (2, "http://a/" + "s/" * 40, None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None), (None, 0)], "page_id long, good int")
    rows = templates.judge(pages, labels).collect()
    assert len(rows) == 4 and all(r["verdict"] == "allow" and r["rule"] is None for r in rows)
    assert templates.judge(pages.limit(0), labels.limit(0)).collect() == []


def test_many_sections_keep_their_branches(spark):
    for rows in (25, 60):  # of each section: the blocked one stays blocked in a larger crawl
        sections = ["casino", *(f"section{i}" for i in range(40))]
        pages = {n * rows + i: f"http://big.example.com/{s}/{i}.html" for n, s in enumerate(sections) for i in range(rows)}
        labels = {p: int("/casino/" not in u) for p, u in pages.items()}
        got = found(templates.judge(spark.createDataFrame(list(pages.items()), "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, good int")))
        assert {p: v[-1] for p, v in got.items()} == {p: "allow" if good else "block" for p, good in labels.items()}
        assert {v[3] for v in got.values()} == {f"/{s}/~" for s in sections}


def test_marks_are_no_segments(spark):
    """Bad pages below a section ``~``, ``*`` or ``\\~`` are blocked as below any other name, while many good sections are merged."""
    for bad in ("~", "zz", "*", "\\~"):
        urls = [f"http://h.example.com/{bad}/{i}" for i in range(40)] + [f"http://h.example.com/s{n}/{i}" for n in range(20) for i in range(40)] + [f"http://h.example.com/~{i}" for i in range(30)]
        pages = dict(enumerate(urls))
        labels = {p: int(p >= 40) for p in pages}
        got = found(templates.judge(spark.createDataFrame(list(pages.items()), "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, good int")))
        assert got == brute(pages, labels, ())
        assert {p: v[-1] for p, v in got.items()} == {p: "allow" if good else "block" for p, good in labels.items()}
