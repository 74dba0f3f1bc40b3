import random

from sparkrecall.llm import wrapper
from sparkrecall.llm.wrapper import Page, content_slot, extract, induce, match_trees

PAGES = "page_id bigint, url string, html string"


def test_meaning_of_elements():
    html = (
        '<body class="has-sidebar"><div id="cookie-notice">We use</div><header><h1>Site</h1></header><main><h2>T &amp; x</h2>'
        '<p>A<b>b</b>c<p>two<br>three<div class="comments"><p>nice</p></div><form>q<input></form><script>1<2</script><!-- c -->'
        "<ul><li>l1<li>l2</ul></main><footer>f"
    )
    assert Page(html).main_blocks() == ["T & x", "Abc", "two", "three", "l1", "l2"]
    assert Page(None).main_blocks() == [] and Page("").main_blocks() == []
    assert Page("<article><p>a \n\t b&nbsp;c</p>tail &lt;x&gt; 5 < 6</article>").main_blocks() == ["a b c", "tail <x> 5 < 6"]
    assert Page("<article><p>open <script>var a = '</p>'").main_blocks() == ["open"]
    assert Page("<p>plain text only").main_blocks() == ["plain text only"]
    assert Page("<div>" * 3000 + "deep").main_blocks() == ["deep"]
    assert Page('<article><p title="a>b" class=\'x\'>ok<p a="unclosed>still</article>').main_blocks()[0] == "ok"


def test_simple_tree_matching():
    one = "0 html\n1 body\n2 nav\n2 div\n3 p\n2 footer"
    two = "0 html\n1 body\n2 div\n3 h1\n3 p\n2 footer"
    assert match_trees(one, two) == {0: 0, 1: 1, 3: 2, 4: 4, 5: 5}
    assert match_trees("0 a", "0 b") == {} and match_trees(one, one) == {i: i for i in range(6)}


def pages(spark, n=30):
    rnd, rows = random.Random(3), []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rnd.choices('abcdefgh', k=12))} {i}</p>" for _ in range(3))
        extra = "<div><p>extra</p></div>" if i % 3 else ""
        rows.append((i, "http://site.example/x", f"<html><body><div>Top {extra}</div><div class=c><p>Same everywhere</p>{body}<p>Copyright us</p></div></body></html>"))
    return rows, spark.createDataFrame(rows, PAGES)


def test_template_is_induced_and_varying_text_stays(spark):
    rows, df = pages(spark)
    assert induce(df).count() == 2  # two skeletons of one host
    for limit in (wrapper.BROADCAST_BYTES, 0):
        got = {r["page_id"]: r["text"] for r in extract(df, limit).collect()}
        for i, _, h in rows:
            assert "Same everywhere" not in got[i] and "Copyright" not in got[i] and "Top" not in got[i]
            assert got[i].count(f" {i}") >= 3


def test_copies_of_an_article_are_no_template(spark):
    rows = [(i, "http://h.example/", "<article><h1>One</h1><p>the same text</p></article>") for i in range(40)]
    got = extract(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["text"] for r in got} == {"One the same text"} and {r["n_chars"] for r in got} == {17}


def test_edges(spark):
    rows = [(1, None, None), (None, "::bad::[", "<p>x"), (2, "http://a/", ""), (2, "http://a/", ""), (3, "u", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as text", "2 as drop", "3 as host")
    got = sorted(((r["page_id"], r["n_chars"]) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, 0), (None, 1), (2, 0), (2, 0), (3, 999_999)], key=str)
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_names_that_only_sound_like_page_parts():
    for attr in ('class="notice-of-death"', 'class="form-of-government"', 'id="related-work"', 'class="menu-engineering"', 'class="adverse"'):
        assert Page(f"<article><p>a</p><div {attr}>kept</div></article>").main_blocks() == ["a", "kept"], attr
    for attr in ('class="cookie-notice"', 'id="comments"', 'class="x ad-slot-3"', 'class="related"', 'class="site_footer"', 'class="newsletter-signup"'):
        assert Page(f"<article><p>a</p><div {attr}>gone</div></article>").main_blocks() == ["a"], attr


def recursive(one, two):
    """Simple tree matching by its recurrence: the size of the largest matching."""

    def tree(skeleton):
        nodes, path = [], []
        for line in skeleton.split("\n"):
            depth, _, sig = line.partition(" ")
            node = (sig, [])
            del path[int(depth) :]
            if path:
                path[-1][1].append(node)
            path.append(node)
            nodes.append(node)
        return nodes[0]

    def size(x, y):
        if x[0] != y[0]:
            return 0
        m = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, c in enumerate(x[1], 1):
            for j, d in enumerate(y[1], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + size(c, d))
        return m[-1][-1] + 1

    return size(tree(one), tree(two))


def test_matching_against_the_recurrence():
    rnd = random.Random(8)

    def grow(depth):
        lines = [f"{depth} "]
        for sig in rnd.sample("abcdefg", rnd.randint(0, 5 if depth < 3 else 0)):
            own = grow(depth + 1)
            own[0] = f"{depth + 1} {sig}"
            lines += own
        return lines

    for _ in range(300):
        one, two = grow(0), grow(0)
        one[0] = two[0] = "0 html"
        found = match_trees("\n".join(one), "\n".join(two))
        assert len(found) == recursive("\n".join(one), "\n".join(two)) and len(set(found.values())) == len(found)
        assert all(one[x].split(" ")[1] == two[y].split(" ")[1] for x, y in found.items())


def test_deep_and_wide_trees():
    deep = "\n".join(f"{k} div" for k in range(25_000))
    assert len(match_trees(deep, deep + "\n25000 p")) == 25_000
    wide = "0 body\n" + "\n".join(f"1 p.c{k}" for k in range(3000))
    assert len(match_trees(wide, wide + "\n1 hr")) == 3001
    assert Page("<div>" * 5000 + "x" + "<p>y").main_blocks() == ["x", "y"]


def test_content_slot():
    tree = "0 html\n1 body\n2 div.a\n3 ul\n2 div.b\n3 h1\n3 div.c\n4 p"
    assert content_slot(tree, {3: 10, 5: 30, 7: 900}) == 4  # the heading varies: its container stays
    assert content_slot(tree, {3: 10, 7: 900}) == 6
    assert content_slot(tree, {3: 500, 7: 900}) == 1  # nothing dominates
    assert content_slot(tree, {}) == -1
    assert content_slot("0 html\n1 article\n2 section\n3 p\n2 p", {3: 900, 4: 5}) == 1


def layout(rnd, i, article="div class=x1"):
    word = lambda n: " ".join(rnd.choices(["al", "be", "ga", "de", "ep", "ze"], k=n)) + f" {i}"
    body = f"<h1>{word(4)}</h1><h2>Introduction</h2><p>{word(40)}</p><h2>Method</h2><p>{word(60)}</p>"
    html = f"<html><body><div class=x0><ul><li><a href=/>{word(2)}</a></li><li><a href=/>{word(2)}</a></li></ul></div><div class=x2>{word(3)}</div><{article}>{body}<p>All about us</p></{article.split()[0]}><div class=x3>The end</div></body></html>"
    want = [x for x in __import__("re").findall(r"<(?:h1|h2|p)>([^<]*)<", body)]
    return html, " ".join(want)


def test_induction_alone_finds_the_content_slot(spark):
    """No tag or class says what is content: menus and adverts vary too."""
    rnd, rows, want = random.Random(9), [], {}
    for n, host in ((20, "big"), (3, "small")):
        for k in range(n):
            i = len(rows)
            html, want[i] = layout(rnd, i)
            rows.append((i, f"http://{host}.example/{i}", html))
    for limit in (wrapper.BROADCAST_BYTES, 0):
        got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES), limit).collect()}
        assert got == want


def test_constant_headings_of_an_article_stay(spark):
    rnd, rows, want = random.Random(9), [], {}
    for i in range(20):
        body = " ".join(rnd.choices("abcdefgh", k=30))
        rows.append((i, "http://h.example/", f"<article><h1>T{i}</h1><h2>Introduction</h2><p>{body} {i}</p></article><footer>f</footer>"))
        want[i] = f"T{i} Introduction {body} {i}"
    assert {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES)).collect()} == want
