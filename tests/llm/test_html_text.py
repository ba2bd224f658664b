import random
import time
from html.parser import HTMLParser

from pyspark.sql import types as T

from docmap.llm.html_text import BAD, GOOD, STOP_WORDS, UNDECIDED, extract_main_text, main_text, second_pass

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">the and of</a></li></ul></nav><!-- ad 0 -->
<div class="ad">The best of all and it is for you in the shop.</div>
<div id="cookie-notice"><p>We use cookies and that is all there is to it, as you know, in this and that.</p></div>
<article><h1>Caf&eacute; &amp; more</h1><p><b>It was the best of times and it was the worst of times,
  and that is all.<br><p>Short   one.</p><p>a &lt;b&gt; c&nbsp;d</p>
<section class="comments"><p>The reader is of the opinion that it was not so and that is that.</p></section></article>
<aside class="sidebar"><p>the of and to a in that it was for on are as with be at by this or an but</p></aside>
<form><label>Your name</label><p>the of and to a in that it was for on are as with be</p></form>
<footer>&copy; example.com &middot; the and of</footer></body></html>"""

WANT = ("Café & more\nIt was the best of times and it was the worst of times, and that is all.\nShort one.\na <b> c d")


def test_article_without_what_is_beside_it():
    assert main_text(PAGE) == WANT


def test_page_without_article_is_judged_by_its_blocks():
    page = PAGE.replace("article>", "div>").replace("<section", "<section hidden")
    assert main_text(page) == WANT
    links = "<p>" + " ".join(f'<a href="{i}">the and of it is {i}</a>' for i in range(20)) + "</p>"
    body = "<p>" + "It was the best of all and that is what it was for the rest of us. " * 3 + "</p>"
    assert main_text(f"<body>{links}<p>More</p>{links}{body}<p>End.</p>{body}{links}</body>") == "\n".join(
        [("It was the best of all and that is what it was for the rest of us. " * 3).strip(), "End.",
         ("It was the best of all and that is what it was for the rest of us. " * 3).strip()])


def test_nearest_decided_neighbour():
    u = UNDECIDED
    assert second_pass([u, u], [False] * 2, [False] * 2) == [GOOD, GOOD]
    assert second_pass([GOOD, u, u, u, BAD], [False] * 5, [False] * 5) == [GOOD, GOOD, BAD, BAD, BAD]
    assert second_pass([BAD, u, GOOD], [False] * 3, [False, True, False]) == [BAD, GOOD, GOOD]
    assert second_pass([u, GOOD, u], [True] * 3, [False] * 3) == [GOOD] * 3


def test_broken_and_long_pages():
    assert main_text("") == "" and main_text("<" * 1000) == "<" * 1000
    assert main_text("<p>a<p>b<!-- never closed") == "a\nb"
    assert main_text("<script>var a = 1;") == ""
    assert main_text("<a" * 50_000) == ""
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<article><p>don't <a href=x title=don't>stop</a> the music of the night and the day</p>") == (
        "don't stop the music of the night and the day")
    text = "It is the one and all of it. " * 20_000
    assert main_text(f"<article><p>{text}</p></article>") == text.strip()


def test_table_with_awkward_rows(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType()), T.StructField("text", T.IntegerType()),
                           T.StructField("_html", T.StringType())])
    rows = [(1, "u", PAGE, 1, "x"), (1, "u", PAGE, 1, "x"), (2, None, None, None, None), (None, "v", "<p>plain</p>", 1, ""), (3, "w", "", 1, "")]
    got = extract_main_text(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "v", "plain", 5), (3, "w", "", 0)], key=str)
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


PROSE = [f"It was the {w} of all that is in the town, and that is what it was for the rest of us who had been there. " * 3
         for w in ("first", "second", "third", "fourth")]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def lines(texts):
    return "\n".join(t.strip() for t in texts)


def test_names_around_the_article_are_overruled():
    comments = f"<div class='comments'>{paragraphs(PROSE[3:])}</div>"
    for name in ("content-sidebar-wrap", "has-sidebar", "post-tags", "sidebar", "has-sidebar post-tags"):
        for tag in ("div", "span", "x-part"):
            for inner in ("article", "div"):
                page = f"<body><{tag} class='{name}'><{inner}>{paragraphs(PROSE[:3])}</{inner}>{comments}</{tag}></body>"
                assert main_text(page) == lines(PROSE[:3]), page
    nested = f"<div class='has-sidebar'><div id='post-tags'>{paragraphs(PROSE[:3])}</div></div>{comments}"
    assert main_text(nested) == lines(PROSE[:3])
    assert main_text("<div class='content-sidebar-wrap'><p>plain</p></div>") == "plain"
    section = f"<div>{paragraphs(PROSE[:2])}<section class='side-effects'>{paragraphs(PROSE[2:3])}</section></div>"
    assert main_text(section) == lines(PROSE[:3])


def test_names_stand_where_the_article_is_elsewhere():
    for name in ("comments", "post-tags", "sidebar", "user-comments"):
        page = f"<div>{paragraphs(PROSE[:2])}</div><div class='{name}'>{paragraphs(PROSE[2:3])}</div>"
        assert main_text(page) == lines(PROSE[:2]), name
    assert main_text(f"<div>{paragraphs(PROSE[:1])}</div><ol class='comments'>{paragraphs(PROSE[1:])}</ol>") == PROSE[0].strip()
    assert main_text(f"<p>{PROSE[0]}<span class='share'>Share this</span>{PROSE[1]}</p>") == f"{PROSE[0]}{PROSE[1]}".strip()


def test_clause_c_is_no_copyright_line():
    clauses = ["(a) the buyer has paid the price;", "(b) the seller has been told of it;", "(c) the goods have been sent."]
    page = f"<article><p>{PROSE[0]}</p>{paragraphs(clauses)}<p>{PROSE[1]}</p></article>"
    assert main_text(page) == lines([PROSE[0], *clauses, PROSE[1]])
    long = "(c) " + PROSE[2].strip()
    assert main_text(f"<p>{PROSE[0]}</p><p>{long}</p>") == lines([PROSE[0], long])
    assert main_text(f"<p>{PROSE[0]}</p><p>(c) 2024 Example</p><p>\u00a9 2024 Example</p>") == PROSE[0].strip()


def test_div_article_beside_article_tagged_teaser():
    teaser = "<article><h3>More of it</h3><p>A short teaser.</p></article>"
    got = main_text(f"<body><div>{paragraphs(PROSE)}</div>{teaser}</body>")
    assert got.startswith(lines(PROSE))
    comment = f"<article>{paragraphs(PROSE[3:])}</article>"
    assert main_text(f"<body><div>{paragraphs(PROSE[:3])}</div>{comment}</body>").startswith(lines(PROSE[:3]))


RUSSIAN = ["Он вышел из дома рано утром и пошёл по дороге к реке, на которой стояла старая мельница, и там он сидел. " * 2,
           "Потом он вернулся в город и рассказал всем о том, что видел на реке, но никто не поверил ему, и он ушёл. " * 2]
CHINESE = ["他早上很早就离开了家，沿着通往河边的路走去，那里有一座古老的磨坊，他在岸边坐了很久，看着河水。" * 2,
           "后来他回到了城里，把他在河边看到的一切都告诉了大家，但是没有人相信他的话。" * 2]


def test_tags_around_the_article_are_overruled():
    body = paragraphs(PROSE)
    for page in (f"<form action=x><p><label>Name</label><input></p><div>{body}</div></form>", f"<aside>{body}</aside>",
                 f"<header>{body}</header>", f"<figure><img src=x>{body}", f"<label>{body}", f"<svg><path d='x'><div>{body}</div>",
                 f"<svg><text>no</text></svg><div>{body}</div>", f"<object>{body}</object>", f"<nav><p>Menu</p></nav><form>{body}"):
        assert main_text(f"<body>{page}</body>") == lines(PROSE), page
    beside = f"<aside>{paragraphs(PROSE[:2])}</aside><form>{paragraphs(PROSE[:1])}</form><footer>{PROSE[0]}</footer>"
    assert main_text(f"<body><div>{body}</div>{beside}</body>") == lines(PROSE)
    figure = "<figure><img src=x><figcaption>The mill of it in 1900.</figcaption></figure>"
    assert main_text(f"<article>{paragraphs(PROSE[:2])}{figure}{paragraphs(PROSE[2:])}</article>") == lines(
        [*PROSE[:2], "The mill of it in 1900.", *PROSE[2:]])


def test_links_and_hidden_parts_without_end_tags():
    body = paragraphs(PROSE)
    assert main_text(f"<body><a name=top>{body}</body>") == lines(PROSE)
    assert main_text(f"<body><div><a href=/x>Home</div><div>{body}</div></body>") == lines(PROSE)
    assert main_text(f"<p hidden>of all that was<p>{PROSE[0]}<p>{PROSE[1]}") == lines(PROSE[:2])
    assert main_text(f"<head><title>T</title><body>{body}") == lines(PROSE)
    card = f"<a href=/x><h3>More</h3><p>{PROSE[0]}</p></a>"
    assert main_text(f"<body>{paragraphs(PROSE[1:])}<p>{PROSE[1]}</p>{card}</body>") == lines([*PROSE[1:], PROSE[1]])


def test_languages_without_stop_words_of_their_own():
    links = '<p><a href="/1">Первая ссылка на другую страницу сайта</a></p><p><a href="/2">Вторая</a></p>'
    for text in (RUSSIAN, CHINESE):
        for page in (f"{links}{paragraphs(text)}{links}", f"{links}<form>{paragraphs(text)}</form>"):
            assert main_text(f"<body>{page}</body>") == lines(text), page


def test_time_grows_with_the_page():
    for part in ("<a>", "<a href=x>", "<b>", "<svg>", "<form>", "<p hidden>x", "<div class=ad>"):
        start = time.perf_counter()
        main_text("<a>" * 5000 + "<b>" * 5000 + part * 20_000 + paragraphs(PROSE))
        assert time.perf_counter() - start < 5, part


class Blocks(HTMLParser):
    """(text, characters in links, heading) of the blocks of a well-formed page."""

    def __init__(self, page):
        super().__init__()
        self.out, self.text, self.linked, self.heading, self.link = [], "", 0, False, False
        self.feed(page)
        self.cut()

    def cut(self):
        if self.text.split():
            self.out.append((" ".join(self.text.split()), self.linked, self.heading))
        self.text, self.linked, self.heading = "", 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "h2", "li", "ul", "article"):
            self.cut()
            self.heading = tag == "h2"
        self.link = self.link or tag == "a"

    def handle_endtag(self, tag):
        if tag in ("p", "div", "h2", "li", "ul", "article"):
            self.cut()
        self.link = self.link and tag != "a"

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) * self.link


def plain_main_text(page):
    """Both passes for pages without names, written the slow way."""
    blocks, labels = Blocks(page).out, []
    for text, linked, _ in blocks:
        words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        good = len(text) >= 70 and (density >= 0.25 or (density >= 0.15 and len(text) >= 200))
        labels.append(BAD if linked > 0.33 * len(text) else GOOD if good else UNDECIDED)
    if all(x == UNDECIDED for x in labels):
        return "\n".join(text for text, _, _ in blocks)
    out = []
    for i, (text, _, heading) in enumerate(blocks):
        decided = [j for j, x in enumerate(labels) if x != UNDECIDED]
        after = min((j for j in decided if j >= i), default=max(decided))
        before = max((j for j in decided if j <= i), default=min(decided))
        if labels[before] == labels[after] or heading:
            label = labels[after]
        elif i - before == after - i:
            label = GOOD if page.startswith("<article>") else BAD
        else:
            label = labels[before] if i - before < after - i else labels[after]
        out += [text] * (label == GOOD)
    return "\n".join(out)


def test_random_pages_against_a_plain_version():
    rng = random.Random(8)
    common = ["the", "of", "and", "to", "it", "was", "that", "is"]
    rare = ["mill", "river", "town", "water", "grain", "bridge", "winter", "stone"]

    def text(n, share):
        return " ".join(rng.choice(common if rng.random() < share else rare) for _ in range(n))

    for _ in range(400):
        parts = [f"<p>{text(60, 0.5)}</p>"] * 2
        for _ in range(rng.randrange(14)):
            body = text(rng.choice((2, 8, 20, 60)), rng.choice((0.05, 0.2, 0.5)))
            link = f"<a href='/x'>{text(rng.choice((1, 6, 30)), 0.3)}</a>" if rng.random() < 0.4 else ""
            tag = rng.choice(("p", "div", "h2", "li"))
            parts.append(f"<{tag}>{body} <b>{rng.choice(rare)}</b> {link}</{tag}>")
        rng.shuffle(parts)
        page = "".join(parts)
        if rng.random() < 0.5:
            page = f"<article>{page}</article>"
        assert main_text(page) == plain_main_text(page), page
