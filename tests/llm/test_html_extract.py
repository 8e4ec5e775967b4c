"""Operator 8 on written pages whose main text is known."""

from __future__ import annotations

import random
from collections import Counter

from tessera.llm import html_extract, queries

SCHEMA = "page_id long, url string, html string"


def page(title, blocks, body="article", extra="", nav="<li><a href='/x'>menu word</a></li>" * 3):
    paragraphs = "".join(f"<p>{b}</p>" for b in blocks)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        f"<header>Site name</header><nav><ul>{nav}</ul></nav><!-- note --><div class='ad'>Buy now {title}</div><div id='cookie-notice'>We use cookies</div>"
        f"<{body}><h1>{title}</h1>{paragraphs}</{body}>{extra}<aside>Side {title}</aside><form>Find <input></form>"
        f"<section class='comments'><p>Nice {title}</p></section><footer>&copy; me &middot; {title}</footer></body></html>"
    )


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    return queries.op8_html_extract(spark, str(tmp_path)).collect()


def test_pages(spark, tmp_path):
    rows, want = [], {}
    for i in range(40):
        blocks = [f"Text {i} part {j} with &amp; and\n  <b>bold</b>\twords &eacute;." for j in range(i % 5 + 1)]
        rows.append((i, f"https://user@www.a.example:80/{i}", page(f"Title {i}", blocks)))
        want[i] = "\n".join([f"Title {i}", *[f"Text {i} part {j} with & and bold words é." for j in range(i % 5 + 1)]])
    for i in range(40, 60):  # no article: the slot is found by its varying text; a line is the same on all pages
        rows.append((i, f"http://b.example/{i}", page(f"Title {i}", [f"Body {i}.</p><blockquote>Thanks for reading our site.</blockquote><p>More of {i}."], "div", extra=f"<div class='related'>More {i}</div>")))
        want[i] = f"Title {i}\nBody {i}.\nThanks for reading our site.\nMore of {i}."
    broken = "<html><body><nav>menu</nav><article><h1>T</h1><p><b>One.<br><p>Two &lt;three&gt;</p>four</article><footer>f"
    rows += [(60, "http://c.example/", broken), (61, None, None), (62, "no url", ""), (63, "http://d.example", "plain text only"), (64, None, "<p>a<p>b")]
    want |= {60: "T\nOne.\nTwo <three>\nfour", 61: "", 62: "", 63: "plain text only", 64: "a\nb"}
    got = run(spark, tmp_path, rows + [rows[0]])
    assert Counter(r["page_id"] for r in got) == Counter([*want, 0])
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["url"] for r in got}[61] is None


def test_copies_are_no_template(spark, tmp_path):
    rows = [(i, "http://e.example/x", page("Same", ["All the same words."])) for i in range(30)]
    assert {r["text"] for r in run(spark, tmp_path, rows)} == {"Same\nAll the same words."}


def test_copies_beside_other_pages_keep_their_text(spark, tmp_path):
    copy = "<body><nav>menu</nav><article><h1>Hot</h1><p>First words.</p><blockquote>Quoted.</blockquote><p>Last words.</p></article></body>"
    rows = [(i, f"http://f.example/{i}", copy) for i in range(100)]
    rows += [(i, f"http://f.example/{i}", f"<body><nav>menu</nav><article><h1>T{i}</h1><p>Words {i}.</p></article></body>") for i in range(100, 150)]
    got = {r["page_id"]: r["text"] for r in run(spark, tmp_path, rows)}
    assert got == {i: "Hot\nFirst words.\nQuoted.\nLast words." if i < 100 else f"T{i}\nWords {i}." for i in range(150)}


def test_nothing_that_varies_is_left_outside(spark, tmp_path):
    body = lambda i: f"<div class=body><p>{f'Long text {i}. ' * 60}</p></div>"
    rows = [(i, f"http://g.example/{i}", f"<body><nav>menu</nav><div class=top>Site</div><article><h1>T{i}</h1><p class=lead>Lead {i}.</p>{body(i)}<p>End {i}.</p></article></body>") for i in range(30)]
    want = {i: f"T{i}\nLead {i}.\n{f'Long text {i}. ' * 60}".strip() + f"\nEnd {i}." for i in range(30)}
    rows += [(i, f"http://h.example/{i}", f"<body><nav>menu</nav><div class=top>Site</div>{body(i)}</body>") for i in range(30, 60)]
    want |= {i: f"Long text {i}. " * 60 for i in range(30, 60)}
    rows += [(60, "http://h.example/60", f"<body><nav>menu</nav><div class=top>Site</div>{body(60)}<div class=second><p>Second part.</p></div><aside>x</aside></body>")]
    want[60] = "Long text 60. " * 60 + "\nSecond part."
    got = {r["page_id"]: r["text"] for r in run(spark, tmp_path, rows)}
    assert got == {i: "\n".join(x.strip() for x in t.split("\n")) for i, t in want.items()}


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_alignment_finds_the_heaviest_common_trees():
    a = html_extract.Page("<body><div class=x><p>1<p>2</div><div class=y>3</div></body>").nodes
    b = html_extract.Page("<body><div class=z>0</div><div class=x><p>1</div><section>n</section><div class=y>3</div></body>").nodes
    found = html_extract.align(a, b)
    assert {(a[i][0], b[j][0]) for i, j in found.items()} == {("#root", "#root"), ("body", "body"), ("div.x", "div.x"), ("p", "p"), ("div.y", "div.y")}
    assert html_extract.align(a, a) == {i: i for i in range(len(a))}


def fallback(html):
    return html_extract.main_text(html_extract.Page(html), None, set())


def test_hosts_with_several_skeletons_need_the_wrapper(spark, tmp_path):
    """Constant blocks without a telling name go, in two layouts of one host; without a wrapper they would stay."""
    frame = lambda inner: f"<body><div class=x1><p>Welcome to our site, dear friends.</p></div><div class=x2>{inner}</div><div class=x3><p>Made with love.</p></div></body>"
    plain = lambda i: frame(f"<h1>T{i}</h1><p>Words {i}.</p><p>More {i}.</p>")
    rich = lambda i: frame(f"<h1>T{i}</h1><p>Words {i}.</p><table><tr><td>a{i}</td><td>b{i}</td></tr></table><ul><li>l{i}</li></ul>")
    rows = [(i, f"http://k.example/{i}", plain(i) if i % 3 else rich(i)) for i in range(60)]
    want = {i: f"T{i}\nWords {i}.\nMore {i}." if i % 3 else f"T{i}\nWords {i}.\na{i}\nb{i}\nl{i}" for i in range(60)}
    assert {r["page_id"]: r["text"] for r in run(spark, tmp_path, rows)} == want
    assert all(fallback(html) != want[i] for i, _, html in rows)


def test_names_count_as_wholes(spark, tmp_path):
    body = "<p>a</p><div class='search-results'>b</div><div class='share-price'>c</div><ul class='menu'><li>d</li></ul><div class='ad'>x</div><section class='comments'>y</section>"
    cases = {
        "<div class='content with-sidebar'><p>a</p></div>": "a",
        "<div class='post share-enabled'><p>a</p></div>": "a",
        f"<article>{body}</article>": "a\nb\nc\nd",
        "<p>a</p><svg/><p>b</p><iframe src=x /><p>c</p><svg><text>no</text></svg><p>d</p>": "a\nb\nc\nd",
        "<div><header><h1>Title</h1></header><p>a</p></div><div><header>Site</header></div>": "Title\na",
        "<div id='main-menu'>m</div><div class='cookie-banner'>k</div><div class='sidebar-wrapper'>s</div><p>a</p>": "a",
    }
    rows = [(i, f"http://n{i}.example/", html) for i, html in enumerate(cases)]
    assert {r["page_id"]: r["text"] for r in run(spark, tmp_path, rows)} == dict(enumerate(cases.values()))


def test_large_pages_are_read_whole(spark, tmp_path):
    links = "".join(f"<div class=k{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}><p>c{i}</p></div>" for i in range(1200))
    rows = [(i, f"http://m.example/{i}", f"<body><article><h1>T{i}</h1><p>Words {i}.</p></article><div class=comments>{links}</div></body>") for i in range(4)]
    rows += [(10, "http://o.example/1", "<div>" * 20_000 + "deep" + "</div>" * 20_000), (11, "http://o.example/2", "<div>" * 9_000 + "deeper"), (12, "http://p.example", "<a " * 200_000 + "> x")]
    got = {r["page_id"]: r["text"] for r in run(spark, tmp_path, rows)}
    assert {i: got[i] for i in range(4)} == {i: f"T{i}\nWords {i}." for i in range(4)}
    assert got[10] == "deep" and got[11] == "deeper"


def exhaustive(a, b, i=0, j=0):
    """Simple tree matching by its definition: the weight of the heaviest matching."""
    if a[i][0] != b[j][0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), exhaustive(a, b, x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[i][1], b[j][1])


def test_alignment_equals_brute_force():
    rng = random.Random(3)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randint(0, 3))) if depth else ""

    for _ in range(150):
        a, b = (html_extract.Page(f"<body>{tree(3)}</body>").nodes for _ in "ab")
        found = html_extract.align(a, b)
        assert len(found) == exhaustive(a, b)
        assert all(a[i][0] == b[j][0] for i, j in found.items()) and len(set(found.values())) == len(found)
