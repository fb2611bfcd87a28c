import random
import re
from html import escape

from terradelta.llm import html_text as h


def tree():
    return h.grow(*h.labelled_blocks())


def test_tree_fits_its_table_and_holds_out():
    rows, labels = h.labelled_blocks()
    fitted = h.grow(rows, labels)
    assert sum(h.judge(fitted, r) == y for r, y in zip(rows, labels)) / len(rows) > 0.99
    order = random.Random(4).sample(range(len(rows)), len(rows))
    test, train = order[::4], [i for k, i in enumerate(order) if k % 4]
    fitted = h.grow([rows[i] for i in train], [labels[i] for i in train])
    assert sum(h.judge(fitted, rows[i]) == labels[i] for i in test) / len(test) > 0.95


def test_pages_of_known_parts():
    """Held-out pages: article paragraphs come back whole, all else goes."""
    rnd, t = random.Random(7), tree()
    words = lambda n: " ".join(rnd.choice(["alpha", "b&", "<c>", "délta", "e"]) for _ in range(n))
    for _ in range(60):
        article = [words(rnd.choice([1, 2, 9, 40, 90])) for _ in range(rnd.randrange(1, 8))]
        other = lambda: f"<p>{escape(words(rnd.choice([2, 20, 50])))}</p>"
        inside = [f"<p>{escape(p)}" + "</p>" * rnd.randrange(2) for p in article]
        for junk in ('<div class="ad-slot">%s</div>', "<aside>%s</aside>", "<form>%s</form>", "<script>if (a<b) '<p>';</script><!-- %s -->"):
            if rnd.random() < 0.4:
                inside.insert(rnd.randrange(len(inside) + 1), junk % (other() if "script" not in junk else "x"))
        page = f"<!DOCTYPE html><html><head><title>{escape(words(3))}</title><style>p{{}}</style></head><body><header>{other()}</header><nav>{other()}</nav><div id='cookie-notice'>{other()}</div><article>{''.join(inside)}</article><section class=comments>{other()}{other()}</section><div class='sidebar'>{other()}</div><footer>{other()}</footer>"
        assert h.main_text(page, t) == "\n\n".join(article)


def test_odd_input(spark):
    t = tree()
    for page in (None, "", "   ", "<div><div>", "<!-- x", "<p", "<script>a"):
        assert h.main_text(page, t) == ""
    assert h.main_text("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;\n c<br>d < 5</p>", t) == "a <b> &amp; é c d < 5"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert len(h.main_text(long, t).split("\n\n")) == 20_000
    rows = [(1, "u", "<p>hello world</p>", 7), (1, "u", "<p>hello world</p>", 7), (None, None, None, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((tuple(r) for r in h.extract(pages).collect()), key=str) == sorted([(1, "u", "hello world", 11)] * 2 + [(None, None, "", 0)], key=str)
    assert h.extract(pages.limit(0)).count() == 0
    assert re.fullmatch("page_id,url,text,n_chars", ",".join(h.extract(pages).columns))


def test_inline_elements_keep_what_is_no_article_out():
    t = tree()
    text = "real text here that goes on for a good while " * 12
    for inline in ('<span class="ad">BUY NOW</span>', "<span hidden>BUY NOW</span>", '<a class="share" href=/>BUY NOW</a>', '<x-box class="related">BUY <b>NOW</b></x-box>', '<ins class="adsbygoogle">BUY NOW</ins>', '<i style="display: none">BUY <i>NOW</i></i>'):
        got = h.main_text(f"<article><h1>Some title</h1><p>{text}</p><p>Hello {inline} world</p><p>{text}</p></article>", t)
        assert "BUY" not in got and "NOW" not in got and got.count(text.strip()) == 2 and "Hello" in got and "world" in got
    assert "\n\nHello world\n\n" in h.main_text(f"<article><p>{text}</p><p>Hello <span class=ad>BUY</span> world</p><p>{text}</p></article>", t)
    got = h.main_text(f'<article><h1>Some title</h1><p>{text}</p><ins class="adsbygoogle"><div>BUY</div> NOW</ins><p>{text}</p></article>', t)
    assert "BUY" not in got and "NOW" not in got and got.count(text.strip()) == 2
    # what is open stays open: other inline elements, unclosed ones, and a name around the whole page
    assert h.main_text(f"<article><p><b>Bold <i>and</i> <a href=/x>link</a> stay<p>{text}</p></article>", t) == f"Bold and link stay\n\n{text.strip()}"
    assert text.strip() in h.main_text(f'<font class="print"><article><p>{text}</p></article></font>', t)
    assert h.main_text(f'<article><p>One <span class="ad">BUY<p>{text}</p></article>', t) == f"One\n\n{text.strip()}"


def test_offsets_forms_and_nested_raw_elements():
    tree = h.grow(*h.labelled_blocks())
    text = "real text here that goes on for a good while " * 12
    assert h.main_text("\u0130" * 30 + f"<script>x</script><p>{text}</p>", tree).endswith(text.strip())
    page = f"<form><nav><a href=/>Home</a></nav><div id=content><h1>Some title here</h1><p>{text}</p></div></form>"
    assert text.strip() in h.main_text(page, tree) and "Home" not in h.main_text(page, tree)
    page = f"<form><article><p>{text}</p></article><p>search terms <input></p></form>"
    assert text.strip() in h.main_text(page, tree)
    assert "LEAK" not in h.main_text(f"<article><svg><svg>..</svg><text>LEAK</text></svg><p>{text}</p></article>", tree)
    assert "LEAK" not in h.main_text(f"<article><script>if (a) '<script>'</script><p>{text}</p></article>", tree)
