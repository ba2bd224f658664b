"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text at block-level tags.  The first pass
labels a block from its stop-word density, length and link density as good,
bad, or (when short or in between) undecided.  In the second pass an
undecided block takes the label of its nearest decided neighbours.  Text
inside elements that are never shown as text (scripts, styles, drawings, ...)
is no block at all.  Tags and names of elements (forms, navigation, adverts,
comments, ...) and article tags are evidence only, which more good text
overrules.  Where the stop words fit no text of the page, the words that the
page itself repeats take their place.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmap.llm.common import slices

# Element names of HTML by their part in the layout.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript "
    "ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
HIDDEN_TAGS = frozenset("head svg math select option optgroup".split())
# Elements beside the article, unless they hold nearly all good text of the page.
FRAME_TAGS = frozenset("nav footer menu dialog".split())
PART_TAGS = frozenset("form fieldset label button aside header object canvas audio video".split())
REPEATED_TAGS = frozenset("p li dt dd tr td th option".split())  # a new one ends an open one
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in a class, id or role that mark parts beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices popup modal "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond widget toolbar pagination pager tags copyright legal "
    "disclaimer search complementary contentinfo alert alertdialog hidden".split())
# Frequent function words of the languages at hand, a parameter of the operator.
STOP_WORDS = frozenset(
    "the of and to a in is it that was for on are as with be by at or an this have from not but had his they she "
    "which you one we all were there can has more if will no out what up about so said when who them been its would "
    "der die das und ist nicht ein eine einer einen dem den des von zu mit sich auf für im in als auch es an werden "
    "aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch "
    "le la les de des du un une et est que qui dans en pour pas sur au avec plus par ne se ce il sont aux ou mais "
    "nous vous leur ont cette son elle comme ses tout fait été même "
    "el los las del al y que es por con para una su no se lo como más pero sus le ya o este sí porque esta entre "
    "cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
NAME_PARTS = re.compile(r"[a-z]+")
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.I)
HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
# Letters of scripts written without spaces: each counts as a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")

GOOD, BAD, UNDECIDED = 1, 0, -1


# How far a name speaks against an element: a part of it, its last part, or all of it is in BESIDE; or its tag does.
PART, LAST, WHOLE, TAG = 0, 1, 2, 3
Names = frozenset[tuple[int, str]]


def beside_names(attributes: str) -> tuple[bool, Names]:
    """(whether an element is hidden, the names in its class, id or role that
    speak against it)."""
    names: set[tuple[int, str]] = set()
    if not attributes or attributes.isspace():
        return False, frozenset()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, frozenset()
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True, frozenset()
        elif name != "aria-hidden":
            for one in value.split():
                parts = NAME_PARTS.findall(one)
                if not BESIDE.isdisjoint(parts):
                    names.add((PART if parts[-1] not in BESIDE else LAST if len(parts) > 1 else WHOLE, one))
    return False, frozenset(names)


def blocks_of(page: str) -> list[tuple[str, int, bool, bool, Names]]:
    """(text, characters inside links, heading, inside <article> or <main>,
    names of the elements around it that speak against it) of every block
    with text, in page order."""
    out: list[tuple[str, int, bool, bool, Names]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, Names]] = []  # open elements that are hidden or count: (tag, hidden, names)
    opened: Counter[str] = Counter()  # tags on the stack
    around: list[Names] = [frozenset()]  # names of all open elements, after each element that has some
    outer: list[tuple[list[str], int] | None] = []  # for each of those, the unfinished block around it if inline
    hidden = article = 0
    heading = link = ends_at_block = False  # in a link; in one without an end tag of its own
    never_closed: set[str] = set()  # tags without a further end tag on the page

    def flush() -> None:
        nonlocal linked, text
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, linked, heading, article > 0, around[-1]))
        text, linked = [], 0

    def leave() -> None:
        nonlocal linked, text
        flush()
        around.pop()
        if (rest := outer.pop()) is not None:
            text, linked = rest

    def enter(tag: str, none: bool, names: Names) -> None:
        nonlocal hidden, article
        stack.append((tag, none, names))
        opened[tag] += 1
        hidden += none
        article += tag in ("article", "main")

    def close(tag: str) -> None:
        nonlocal hidden, article
        while opened[tag]:
            name, was_hidden, names = stack.pop()
            opened[name] -= 1
            if names:
                leave()
            hidden -= was_hidden
            article -= name in ("article", "main")
            if name == tag:
                break

    def is_closed(tag: str, at: int) -> bool:
        if tag not in never_closed and not re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at):
            never_closed.add(tag)
        return tag not in never_closed

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                if not hidden:
                    text.append(token)
                    if link:
                        linked += len(token)
            elif token.startswith("<![CDATA[") and not hidden:
                text.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if tag in BLOCK_TAGS:
            flush()
            heading = not closing and tag in HEADINGS
            link = link and not ends_at_block
        elif tag == "br" and not hidden:
            text.append(" ")
        if closing:
            link = link and tag != "a"
            close(tag)
            continue
        if tag in RAW_TAGS:  # its content is text up to the closing tag
            end = CLOSING[tag].search(page, at)
            at = end.start() if end else n
            continue
        if tag in VOID_TAGS:
            continue
        if stack and ((stack[-1][0] == "p" and tag in BLOCK_TAGS) or (stack[-1][0] == tag and tag in REPEATED_TAGS)):
            close(stack[-1][0])
        if tag == "a":
            close(tag)
            link = bool(HREF.search(m[3]))
            following = LINK_TAG.search(page, at) if link else None
            ends_at_block = following is None or not following[1]
        none, names = (False, frozenset()) if tag in ("html", "body", "article", "main") else beside_names(m[3])
        if (none or tag in HIDDEN_TAGS) and not hidden:
            none = tag in REPEATED_TAGS or is_closed(tag, at)
        if tag in FRAME_TAGS:
            names |= {(WHOLE, f"<{tag}>")}
        elif tag in PART_TAGS and not (tag == "header" and article):
            names |= {(TAG, f"<{tag}>")}
        if none or hidden:
            names = frozenset()
        if names:
            outer.append(None if tag in BLOCK_TAGS else (text, linked))
            text, linked = [], 0
            around.append(around[-1] | names)
        if none or names or tag in ("article", "main", "header"):
            enter(tag, none, names)
        elif (hidden or outer) and tag not in REPEATED_TAGS:
            enter(tag, False, names)  # so that a closing tag inside does not end the hidden element
        elif opened[tag]:
            enter(tag, False, names)
    while outer:
        leave()
    flush()
    return out


def words_of(text: str) -> list[str]:
    """Lower-case words; letters of scripts without spaces are words each."""
    text = text.lower()
    return LETTERS.findall(UNSPACED.sub(r" \g<0> ", text) if UNSPACED.search(text) else text)


def size(text: str) -> int:
    """Characters, where those of scripts without spaces count three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(UNSPACED.findall(text))


def fitting_stop_words(blocks: list[tuple[str, int, bool, bool, Names]], words: list[list[str]],
                       stop_words: frozenset[str], short: int = 70, low: float = 0.15,
                       max_links: float = 0.33) -> tuple[frozenset[str], bool]:
    """(stop words, whether they are the given ones): where less than ``low``
    of the words in the page's plain blocks are given ones, those that the
    page repeats, of at most four letters, take their place."""
    plain = [of for (text, linked, *_), of in zip(blocks, words, strict=True) if linked <= max_links * len(text)
             and size(text) >= short]
    if sum(w in stop_words for of in plain for w in of) >= low * sum(map(len, plain)):
        return stop_words, True
    return frozenset(w for w, k in Counter(w for of in plain for w in of).items() if k > 1 and len(w) <= 4), False


def first_pass(text: str, linked: int, words: list[str], stop_words: frozenset[str], clauses: bool = False,
               given: bool = True, short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.25, max_links: float = 0.33) -> int:
    """Label of a block by link density, length and stop-word density; a
    short copyright line is bad, where (c) is none after a ``(b)``.  Long
    text is good whatever its words if the stop words are not the ``given``
    ones."""
    if linked > max_links * len(text):
        return BAD
    if text[0] == "©" and len(text) < long:
        return BAD
    if size(text) < short:
        return BAD if text.startswith("(c)") and not clauses else UNDECIDED
    if not given and size(text) >= long:
        return GOOD
    density = sum(w in stop_words for w in words) / max(len(words), 1)
    if density >= high:
        return GOOD
    if density >= low:
        return GOOD if len(text) >= long else UNDECIDED
    return UNDECIDED


def second_pass(labels: list[int], inside: list[bool], headings: list[bool]) -> list[int]:
    """Undecided blocks take the label of the nearest decided neighbours.

    Where both neighbours differ the nearer one counts; at equal distance a
    block in the article is good and others are bad, but a heading goes with
    what follows it.  A block with one decided neighbour takes its label;
    without any decided block all blocks are good.
    """
    n = len(labels)
    if all(x == UNDECIDED for x in labels):
        return [GOOD] * n
    before, last = [], None
    for i, x in enumerate(labels):
        before.append(last)
        last = i if x != UNDECIDED else last
    after, last = [None] * n, None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if labels[i] != UNDECIDED else last
    out = []
    for i, (x, b, a) in enumerate(zip(labels, before, after, strict=True)):
        if x != UNDECIDED:
            out.append(x)
        elif b is None or a is None:
            out.append(labels[a if b is None else b])
        elif labels[b] == labels[a] or headings[i]:
            out.append(labels[a])
        elif i - b == a - i:
            out.append(GOOD if inside[i] else BAD)
        else:
            out.append(labels[b] if i - b < a - i else labels[a])
    return out


def standing_names(blocks: list[tuple[str, int, bool, bool, Names]], labels: list[int], long: int = 200) -> Names:
    """The names whose elements are left out.

    Good text in named elements is weighed against the good text outside:
    where it is more, the names around it say nothing on this page and are
    taken back, the largest first (of names inside each other the outer
    ones), until the text outside is more.  Tags are taken back for three
    times as much good text, names that are in ``BESIDE`` as a whole only if
    there is hardly any good text outside, and a few words only if there is
    no other text at all.
    """
    names: Names = frozenset().union(*(b[4] for b in blocks))
    if not names:
        return names
    weigh = GOOD if GOOD in labels else UNDECIDED
    while True:
        held: dict[Names, int] = {}
        others = False
        for (text, _, _, _, around), label in zip(blocks, labels, strict=True):
            left = around & names
            others = others or (not left and label != BAD)
            if label == weigh:
                held[left] = held.get(left, 0) + size(text)
        plain = held.pop(frozenset(), 0)

        def free(some: Names, plain: int = plain, held: dict[Names, int] = held, others: bool = others) -> bool:
            if held[some] <= plain or (others and held[some] < long):
                return False
            tiers = {tier for tier, _ in some}
            if WHOLE in tiers:
                return plain < long <= held[some]
            return TAG not in tiers or (held[some] >= long and held[some] > 3 * plain)

        most = max(filter(free, held), key=held.__getitem__, default=None)
        if most is None:
            return names
        while (inner := min((x for x in held if x < most and free(x)), key=len, default=None)) is not None:
            most = inner
        names -= most


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS, long: int = 200) -> str:
    """The good blocks, joined by a line feed."""
    blocks = blocks_of(page)
    labels, clauses = [], False
    words = [words_of(b[0]) for b in blocks]
    stop_words, given = fitting_stop_words(blocks, words, stop_words)
    for (text, linked, *_), of in zip(blocks, words, strict=True):
        labels.append(first_pass(text, linked, of, stop_words, clauses, given))
        clauses = clauses or "(b)" in text
    names = standing_names(blocks, labels)
    # left out, but for long good blocks where only a part of a name speaks against them
    kept = [(b, label) for b, label in zip(blocks, labels, strict=True) if not (left := b[4] & names) or (
        label == GOOD and len(b[0]) >= long and all(tier == PART for tier, _ in left))]
    good = [sum(len(b[0]) for b, label in kept if label == GOOD and b[3] == inside) for inside in (False, True)]
    if any(b[3] for b, _ in kept) and good[True] >= good[False]:  # the marked article: the rules judge what it holds
        kept = [(b, label) for b, label in kept if b[3]]
    labels = second_pass([label for _, label in kept], [b[3] for b, _ in kept], [b[2] for b, _ in kept])
    return "\n".join(b[0] for (b, _), good in zip(kept, labels, strict=True) if good == GOOD)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                      stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` (empty if none), ``n_chars`` (code
    points) of every whole page.

    Defined results: null html counts as empty; null ids and addresses are
    passed on; repeated rows are extracted each; an unclosed tag or comment
    reaches to the end of the page; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "_url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [main_text(p, stop_words) for p in part["_html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part["_id"], part["_url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["_id", "_url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"_id {kinds[0]}, _url {kinds[1]}, text string, n_chars long")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_url", url_col)
