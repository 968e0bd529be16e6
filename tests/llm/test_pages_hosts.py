import hashlib
import os
import random
import re
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.llm import hosts, pagediff

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def pages(spark, rows, extra=False):
    schema = "page_id long, url string, html string" + (", text string, host string, rule string, page_row string" if extra else "")
    return spark.createDataFrame([(*r, "t", "h", "r", "p") if extra else r for r in rows], schema)


def test_blocks():
    html = """<html><head><title>T</title></head><body><nav><a href="/x">Menu</a></nav><div class="main-ad ad">Buy</div>
    <article><header><h1>Head &amp; more</h1></header><p>One<b>two</b> <br>three &lt;x&gt; <p>Four<aside>no</aside> five
    <form>f<input></form><section id="comments"><article>reader</article></section></article><footer>&copy;</footer>
    <script>var a = "<p>no</p>";</script><style>p{}</style></body></html>"""
    found = pagediff.blocks(html)
    assert " ".join(t for z, t in found if z == "article") == "Head & more Onetwo three <x> Four five"
    assert pagediff.blocks("") == [] and pagediff.blocks("<p></p>  ") == []
    assert pagediff.blocks("a<script>secret()") == [("plain", "a")]
    assert pagediff.blocks("<nav>x<main>y</main>") == [("aside", "x"), ("article", "y")]


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_lines_are_longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    found = sorted(pagediff.common_lines(a, b))
    rest = iter(b)
    assert all(a[i] in rest for i in found) and len(found) == table[0][0]


def test_nearest_pages_over_task_borders(spark):
    rng = random.Random(3)
    rows = [(i, f"h{rng.randint(0, 3)}.org", f"/{rng.choice('ab')}/{rng.choice('abc')}/{rng.randint(0, 99)}") for i in range(300)] + [(999, "alone.org", "/"), (1000, "", "")]
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2], r[0]))
    want = {}
    for k, own in enumerate(order):
        near = [(pagediff._shared(o[2], own[2]), -p, o[0]) for p, o in ((0, order[k - 1] if k else None), (1, order[k + 1] if k + 1 < len(order) else None)) if o and o[1] == own[1]]
        if near:
            want[own[0]] = max(near)
    got = {r.row: r.mate for r in pagediff.nearest_pages(spark.createDataFrame(rows, "row long, host string, path string"), "row").collect()}
    paths = {r[0]: r[2] for r in rows}
    assert got.keys() == want.keys()
    assert all(pagediff._shared(paths[i], paths[m]) == want[i][0] for i, m in got.items())


def test_differences_remove_what_neighbours_share(spark):
    page = "<body><div>Site name</div><p>{}</p><p>{}</p><div>Imprint</div></body>"
    rows = [(i, f"http://h.org/a/{i}", page.format(f"Only {i}", f"more {i}")) for i in range(1, 6)]
    rows += [(20, "http://alone.org/", "<p>Kept whole</p>"), (21, None, "<p>No url</p>"), (22, "http://h.org/a/1", None), (23, "", ""), (None, "http://h.org/z", "<article>Site name</article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in pagediff.main_text(pages(spark, rows, extra=True)).collect()}
    assert {i: got[i][0] for i in range(2, 6)} == {i: f"Only {i} more {i}" for i in range(2, 6)}
    assert got[20][0] == "Kept whole" and got[21][0] == "No url" and got[None][0] == "Site name"
    assert got[22] == got[23] == ("", 0)
    assert pagediff.main_text(pages(spark, [])).collect() == []


def brute_main_text(rows):
    """(text, lines gone) per row by sorting the distinct pages of a host and aligning each with its nearer neighbour."""
    out, read = [], [(hosts_of(u), pagediff.blocks(h or "")) for u, h in rows]
    for (host, _), found in read:
        same = {}
        for (other, path), lines in read:
            if other == host and host and lines:
                k = tuple(t for _, t in lines)
                same[k] = min(path, same.get(k, path))
        key = lambda k: (same[k], hashlib.blake2b(b"".join(map(pagediff._digest, k)), digest_size=16).digest())
        order = sorted(same, key=key)
        own, shared = tuple(t for _, t in found), set()
        if own in same and len(order) > 1:
            at = order.index(own)
            near = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
            mate = max(near, key=lambda k: len(os.path.commonprefix([same[k], same[own]])))
            shared = pagediff.common_lines(list(own), list(mate))
        article = any(z == "article" for z, _ in found)
        kept = [t for i, (z, t) in enumerate(found) if (z == "article" if article else z == "plain" and i not in shared)]
        out.append((" ".join(kept), sum(not (article and found[i][0] == "article") for i in shared)))
    return out


def hosts_of(url):
    host, _, path = re.split(r"[?#]", url.split("://", 1)[1])[0].partition("/") if "://" in (url or "") else ("", "", "")
    return host.lower(), f"/{path}"


def test_main_text_against_brute_force(spark):
    """Shared, repeated and mirrored pages, ties, several pages under one path, in shuffled rows."""
    rng = random.Random(11)
    line = lambda: f"<p>{rng.choice('abcdefgh')} {rng.randint(0, 3)}</p>"
    rows = []
    for _ in range(400):
        body = "".join(line() for _ in range(rng.randint(0, 6)))
        body = rng.choice((f"<div>Site</div>{body}<div>Imprint</div>", body, f"<nav>Menu</nav><article>{body}</article><p>Imprint</p>"))
        rows.append((f"http://h{rng.randint(0, 2)}.org/{rng.choice('ab')}/{rng.randint(0, 40)}", body))
    rows += rows[:60] + [(f"http://h0.org/copy/{i}", rows[0][1]) for i in range(30)] + [(None, "<p>x</p>"), ("http://h0.org/a/1", None)]
    rng.shuffle(rows)
    frame = pages(spark, [(i, *r) for i, r in enumerate(rows)]).repartition(7)
    got = {r.page_id: (r.text, r.n_template) for r in pagediff.main_text(frame).collect()}
    assert got == dict(enumerate(brute_main_text(rows)))


def test_repeated_pages_do_not_empty_each_other(spark):
    page = "<p>One</p><p>Two</p>"
    rows = [(1, "http://h.org/a/1", page), (2, "http://h.org/a/1", page), (3, "http://h.org/a/2", page), (4, "http://h.org/b", "<p>Two</p><p>Three</p>")]
    got = {r.page_id: r.text for r in pagediff.main_text(pages(spark, rows)).collect()}
    assert got == {1: "One", 2: "One", 3: "One", 4: "Three"}


def test_class_names_are_read_whole():
    html = '<article><div class="social-policy"><p>kept</p></div><div class="x cookie-banner">no</div><div id="comment_list">no</div></article>'
    assert [t for z, t in pagediff.blocks(html) if z == "article"] == ["kept"]


def test_very_long_pages_align_in_little_memory():
    rng = random.Random(5)
    own = [rng.randrange(40_000) for _ in range(50_000)]
    other = [c for c in own if rng.random() < 0.9]
    tracemalloc.start()
    found = pagediff.common_lines(own, [-1, *other, -2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(other) and peak < 400 << 20


def test_comparison_removes_lines_of_the_given_pages(spark):
    given = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    out = pagediff.main_text(given).select("page_id", "text", "n_template").collect()
    rows = given.orderBy("page_id").collect()
    want = dict(zip((r.page_id for r in rows), brute_main_text([(r.url, r.html) for r in rows]), strict=True))
    assert {r.page_id: (r.text, r.n_template) for r in out} == want
    assert sum(r.n_template > 0 for r in out) > 0


def test_rules(spark):
    rows = [
        (1, "http://a.COM/x?y", None), (2, "https://example.com/en/1", ""), (3, "https://www.Example.com/en/1#t", ""), (4, "https://m.example.com/en/", ""),
        (5, "https://example.com/en", ""), (6, "http://shop.net/es/q", ""), (7, "http://notcom/x", ""), (8, None, None), (9, "nothing", ""), (10, "http://com", ""), (None, "a://b.net?x=/es/", ""),
    ]
    got = {r.page_id: tuple(r)[1:] for r in hosts.judged(pages(spark, rows, extra=True), RULES).collect()}
    assert got == {
        1: ("a.com", "/x", "com/", "allow"), 2: ("example.com", "/en/1", "example.com/en/", "block"), 3: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        4: ("m.example.com", "/en/", "example.com/en/", "block"), 5: ("example.com", "/en", "com/", "allow"), 6: ("shop.net", "/es/q", "net/es/", "block"),
        7: ("notcom", "/x", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("com", "", None, "allow"), None: ("b.net", "", None, "allow"),
    }
    assert hosts.judged(pages(spark, []), RULES).collect() == []


def test_trust_and_distrust_spread(spark):
    link = '<a href="https://{}/p">x</a>'
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/q", ""), (3, "http://bad.net/es/2", "")]
    rows += [(10, "http://fan.org/1", link.format("bad.net")), (11, "http://fan.org/2", link.format("BAD.net") + link.format("fan.org"))]
    rows += [(20, "http://mixed.org/1", link.format("bad.net") + link.format("good.com")), (30, "http://good.com/1", link.format("mixed.org"))]
    got = {r.page_id: r.verdict for r in hosts.judged(pages(spark, rows), RULES).collect()}
    # mixed.org links to a distrusted host, but a trusted one links to it.
    assert got == {1: "block", 2: "block", 3: "block", 10: "allow", 11: "allow", 20: "allow", 30: "allow"}


def test_walks_go_on_until_nothing_can_change(spark):
    rng = np.random.default_rng(4)
    n = 40
    weights = rng.random((n, n)) * (rng.random((n, n)) < 0.1) * (1 - np.eye(n))
    weights /= np.maximum(weights.sum(axis=1, keepdims=True), 1e-9)  # some hosts have no edge
    start = {"trust": rng.random(n) * (rng.random(n) < 0.3), "distrust": rng.random(n) * (rng.random(n) < 0.3)}
    seeds = spark.createDataFrame([(k, f"h{i}", float(x)) for k, of in start.items() for i, x in enumerate(of) if x], "kind string, host string, score double")
    edges = spark.createDataFrame(
        [(k, f"h{i}", f"h{j}", float(weights[i, j])) for k in start for i in range(n) for j in range(n) if weights[i, j]],
        "kind string, a string, b string, weight double",
    )
    exact = {k: np.linalg.solve(np.eye(n) - 0.85 * weights.T, x) for k, x in start.items()}
    full = hosts.spread(seeds, edges, lambda state, left: max(left.values()) <= 1e-6).collect()
    assert all(abs(r.score - exact[r.kind][int(r.host[1:])]) < 1e-6 for r in full)
    early = hosts.spread(seeds, edges, hosts.settled).collect()
    of = lambda rows, kind: np.array([sum(r.score for r in rows if (r.kind, r.host) == (kind, f"h{i}")) for i in range(n)])
    bad = lambda distrust, trust: ((distrust >= 0.5) & (distrust > trust)).tolist()
    assert bad(of(early, "distrust"), of(early, "trust")) == bad(exact["distrust"], exact["trust"])
    # A walk in a circle without end: ten rounds leave a fifth of its weight, and would not reach the threshold.
    ring = spark.createDataFrame([("distrust", f"r{i}", f"r{(i + 1) % 12}", 1.0) for i in range(12)], "kind string, a string, b string, weight double")
    one = spark.createDataFrame([("distrust", "r0", 0.45)], "kind string, host string, score double")
    found = {r.host: r.score for r in hosts.spread(one, ring, hosts.settled).collect()}
    assert found["r0"] >= 0.5 and found["r1"] < 0.5
