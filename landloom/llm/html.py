"""Main text of web pages by scoring their element trees."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*+>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg".split())
#: Elements whose text is not split from what surrounds it.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
#: Elements that are never part of an article.
DROPPED = frozenset("nav footer aside dialog menu button select option head object canvas audio video map".split())
#: Words in class, id or role that mark an element as no part of an article, unless it holds most of the page's text.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr popup modal footer masthead topbar comment comments disqus reply replies respond share sharing related recommended newsletter subscribe subscription signup login pagination pager complementary contentinfo thread discussion".split())
#: Words that do so unless a word of ``GOOD`` stands beside them.
WEAK_MARKS = frozenset("alert banner notice overlay search side skip social sponsor toolbar widget".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Marks of what may hold most of a page's text and still be no article.
TALK = frozenset("comment comments consent cookie cookies disqus discussion gdpr replies reply respond thread".split())
#: Beginnings of one-word names of such boxes, as in "commentlist", and of words that only look like them.
TALK_STEMS, OTHER_STEMS = ("comment", "disqus", "replies"), ("commentar",)
#: Words that name a single article, whose own header holds its title.
PIECES = frozenset("article entry post story".split())
#: A heading that begins a box of readers' comments.
_TALK_HEADING = re.compile(r"\W*\d*\s*(?:(?:reader|user)s?\W*\s)?(?:comments?|replies|responses|discussion|(?:leave|post|add|write) an? (?:reply|comment))\W*\d*\W*", re.I)
#: One that does so behind an article, where "Discussion" may be a chapter.
_TALK_BEHIND = re.compile(r"\W*\d*\s*(?:(?:reader|user)s?\W*\s)?(?:comments?|replies|(?:leave|post|add|write) an? (?:reply|comment))\W*\d*\W*", re.I)
#: Words that turn a mark around, as in "no-sidebar" or "has-comments".
TURNS = frozenset("has no with without".split())
#: An end or start of the second kind of element closes an open one of the first.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
FENCES = frozenset("ul ol dl table body html article section div".split())
MAX_POINTS = 3.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that go with an article beside them, and boxes that may be menus.
BESIDE = frozenset("ul ol dl pre table blockquote figure".split())
BOXES = frozenset("ul ol dl table div section".split())
#: Characters of a running paragraph, and of all that a marked element without other signs of an article must have.
RUNNING, MUCH = 80, 200
#: A container is left for one around it that holds this many times its running text, at a like share of links.
CLIMB, LIKE_LINKS = 1.3, 0.1
#: The page's only article is taken if it holds this share of the unlinked text, or the main heading.
ARTICLE_SHARE = 1 / 10


class Element:
    """An element: what its tag and names say, and sums over the text blocks in it."""

    __slots__ = ("articles", "at", "block", "box", "chars", "child", "dropped", "fence", "first", "good", "half", "in_article", "kept", "last", "last_block", "links", "mark", "parent", "prose", "running", "score", "stays", "tag", "talk_rank", "title")

    def __init__(self, tag: str, parent: Element | None, depth: int = 0, at: int = 0, mark: str = "", good: bool = False, piece: bool = False):
        self.tag, self.parent, self.mark, self.good, self.at = tag, parent, mark, good, at
        self.dropped = mark == "dropped" or parent is not None and parent.dropped
        self.in_article = piece or tag in ("article", "main") or parent is not None and parent.in_article
        #: Depths of the innermost elements around here that are no inline ones, and that no end tag of a paragraph goes beyond.
        self.block: Element = self if parent is None or tag not in INLINE else parent.block
        self.fence: int = depth if tag in FENCES or parent is None else parent.fence
        self.last, self.first, self.last_block = at, -1, -1
        self.score, self.chars, self.links = 0.0, 0, 0
        self.prose, self.running, self.title = 0, 0, False
        #: Rank of the heading that says that the rest of this element is readers' comments; 0 for none.
        self.talk_rank = 0

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0


Block = tuple[Element, str, int, Element]


def mark_of(tag: str, rest: str, in_article: bool) -> tuple[str, bool, bool]:
    """What an element's tag and names say: "dropped", a kind of mark or nothing, and whether they name an article, or a single one.

    A marked element is left out unless ``released`` finds that it holds the article.
    """
    if tag in DROPPED or tag == "header" and not in_article:
        return "dropped", False, False
    words = {w.lower() for m in _NAMES.finditer(rest) for w in _WORDS.findall(m[2] or m[3] or m[4] or "")} if "=" in rest else set()
    good, piece = bool(words & GOOD), bool(words & PIECES)
    if tag in ("form", "fieldset"):
        return "form", good, piece
    if tag in ("html", "body", "article", "main"):
        return "", tag in ("article", "main"), False
    if words & TURNS:
        return "", good, piece
    talk = words & TALK or any(w.startswith(TALK_STEMS) and not w.startswith(OTHER_STEMS) for w in words)
    if talk or words & MARKS or words & WEAK_MARKS and not good or "header" in words and not in_article and not good:
        return "talk" if talk else "mark", good, False
    return "", good, piece


def parsed(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and text blocks of a page in order: element, text, characters inside links and innermost element.

    One pass: each step looks at the innermost open element of a tag only, and
    what has no end is looked for once.
    """
    root = Element("html", None)
    elements, stack, blocks, text, links, in_link, at = [root], [root], [], [], 0, 0, 0
    opened: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    endless: set[str] = set()
    end = page.rfind(">") + 1  # no tag begins behind it
    told = 0  # characters outside headings and links so far

    def close_block() -> None:
        nonlocal links, told
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            inner = stack[-1]
            if words and not inner.dropped:
                owner, box = inner.block, inner.block.parent
                if owner.tag in HEADINGS and box is not None and box.first < 0 and box.tag in ("div", "section") and not box.mark and _TALK_HEADING.fullmatch(words):
                    box.mark = "talk"
                elif owner.tag in HEADINGS and box is not None and told >= RUNNING and _TALK_BEHIND.fullmatch(words):
                    owner.mark, box.talk_rank = "talk", int(owner.tag[1])
                if owner.tag not in HEADINGS:
                    told += len(words) - min(links, len(words))
                e = inner
                while e is not None and e.first < 0:
                    e.first = len(blocks)
                    e = e.parent
                blocks.append((owner, words, min(links, len(words)), inner))
            text.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal in_link
        for e in stack[k:]:
            opened[e.tag].pop()
            in_link -= e.tag == "a"
        del stack[k:]

    while at < len(page):
        m = _TOKEN.search(page, at, end) if at < end else None
        stop = m.start() if m else page.find("<!--", at)
        bare = page[at : stop if stop >= 0 else len(page)]
        if bare:
            text.append(bare)
            if in_link:
                links += len(" ".join(entities.unescape(bare).split()))
        if not m:
            break
        at = m.end()
        if m["tag"] is None:
            if page.startswith("<!--", stop) and not page.endswith("-->", stop, at):
                break
            continue
        tag, rest = m["tag"].lower(), m["rest"] or ""
        if m["end"]:
            if tag not in INLINE:
                close_block()
            k = opened[tag][-1] if opened.get(tag) else 0
            inner = stack[-1]
            if k > (opened[inner.block.tag][-1] if tag in INLINE and inner.block is not root else inner.fence if tag == "p" else 0):
                pop_to(k)
            continue
        if tag in RAW and not rest.endswith("/"):
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at, end)
            if close is None:
                endless.add(tag)
            at = close.end() if close else len(page) if tag in ("script", "style") else at
            continue
        if tag not in INLINE and tag != "wbr":
            close_block()
            ended = [*(() if tag in VOID else ("p",)), *CLOSES.get(tag, ())]
            k = max((opened[t][-1] for t in ended if opened.get(t)), default=0)
            if k > stack[-1].fence:
                pop_to(k)
        if tag in VOID or rest.endswith("/") and tag in INLINE:
            continue
        parent = stack[-1]
        opened[tag].append(len(stack))
        e = Element(tag, parent, len(stack), len(elements), *mark_of(tag, rest, parent.in_article))
        if parent.talk_rank and tag not in INLINE:
            if tag in HEADINGS and int(tag[1]) <= parent.talk_rank:
                parent.talk_rank = 0
            elif not e.mark:
                e.mark = "talk"
        stack.append(e)
        elements.append(e)
        in_link += tag == "a"
    close_block()
    for e in reversed(elements):
        e.first = -1
        if e.parent is not None:
            e.parent.last = max(e.parent.last, e.last)
    return elements, blocks


def summed(elements: list[Element], blocks: list[Block]) -> None:
    """Sums of the blocks in each element: from the innermost out, an element adds what it has to its parent."""
    for e in elements:
        e.score, e.chars, e.links, e.prose, e.running, e.title, e.first, e.last_block = 0.0, 0, 0, 0, 0, False, -1, -1
    for at, (owner, words, linked, _) in enumerate(blocks):
        prose = len(words) - linked if linked * 2 < len(words) else 0
        owner.chars += len(words)
        owner.links += linked
        owner.prose += prose
        owner.running += prose if prose >= RUNNING else 0
        owner.title |= owner.tag == "h1"
        owner.first, owner.last_block = owner.first if owner.first >= 0 else at, at
        holder = owner if owner.tag in ("div", "section", "article", "main", "body", "html", "td") else owner.parent or owner
        holder.score += 1.0 + sum(map(words.count, ",،、，")) + min(len(words) / 100, MAX_POINTS)
    for e in reversed(elements):
        p = e.parent
        if p is not None and e.first >= 0:
            p.chars += e.chars
            p.links += e.links
            p.prose += e.prose
            p.running += e.running
            p.title |= e.title
            p.score += e.score / 2
            p.first, p.last_block = min(p.first, e.first) if p.first >= 0 else e.first, max(p.last_block, e.last_block)


def released(elements: list[Element]) -> set[int]:
    """Places of the marked elements that stay because they hold the page's article.

    Such an element holds over half of the page's text outside links, and is
    named as an article, or holds a main heading or an element that is one with
    as much text; or it holds three quarters of the text in running paragraphs.
    Without a good name of its own it goes if an article stands beside it.
    """
    total = elements[0].prose
    named = [e for e in elements if e.good and not e.mark and e.prose]
    # elements with over half of the text lie in each other, so the innermost one says whether any is in another
    deepest = max((e.at for e in named if e.prose * 2 > total), default=-1)
    articles = [e.at for e in named if e.tag in ("article", "main")]
    of = set(articles)
    for e in elements:
        e.articles = (e.parent.articles if e.parent is not None else 0) + (e.at in of)
    out = set()
    for m in elements:
        if not m.mark or m.first < 0 or m.prose * 2 <= total:
            continue
        holds = m.title or deepest >= m.at
        inside = bisect_right(articles, m.last) - bisect_left(articles, m.at)
        rival = len(articles) > inside + m.articles - (m.at in of)
        if m.good and (m.mark != "talk" or not rival) or not rival and (holds or m.mark != "talk" and m.prose * 4 > total * 3 and m.running >= MUCH):
            out.add(m.at)
    return out


def beside(blocks: list[Block], top: Element) -> set[int]:
    """Places of the blocks that go with the kept children of ``top``.

    These are what stands between kept children, headings before them with
    what lies between, and lists and the like behind them.
    """
    units: list[tuple[Element | None, list[int]]] = []  # children of the parent in order; its own text has no element
    for at, (owner, *_) in enumerate(blocks):
        child = owner.child
        if child is None and owner is not top:
            continue
        if units and child is not None and units[-1][0] is child:
            units[-1][1].append(at)
        else:
            units.append((child, [at]))

    def share(unit: tuple[Element | None, list[int]]) -> float:
        return sum(blocks[k][2] for k in unit[1]) / sum(len(blocks[k][1]) for k in unit[1])

    def heading(unit: tuple[Element | None, list[int]]) -> bool:
        return all(blocks[k][0].tag in HEADINGS for k in unit[1]) or unit[0] is not None and unit[0].tag == "header"

    held = [k for k, (child, _) in enumerate(units) if child is not None and child.kept is child]
    first, last = held[0], held[-1]
    chosen = {k for k in range(first, last) if share(units[k]) <= 0.6}
    start = k = first
    while k and share(units[k - 1]) < 0.25:
        k -= 1
        if heading(units[k]):
            start = k
            if any(blocks[i][0].tag == "h1" for i in units[k][1]):
                break
    chosen |= set(range(start, first))
    k, waiting = last + 1, []
    while k < len(units) and share(units[k]) < 0.25 and (heading(units[k]) or units[k][0] is not None and units[k][0].tag in BESIDE):
        waiting.append(k)
        if not heading(units[k]):
            chosen |= set(waiting)
        k += 1
    return {at for k in chosen for at in units[k][1]}


def only_article(elements: list[Element]) -> Element | None:
    """The page's one outermost article, or main if there is no article, with a good part of the text or the main heading."""
    for tag in ("article", "main"):
        found, behind = [], 0
        for e in elements:
            if e.at >= behind and e.tag == tag and e.stays and e.prose:
                found.append(e)
                behind = e.last + 1
        if found:
            one = found[0]
            return one if len(found) == 1 and (one.title or one.prose >= ARTICLE_SHARE * elements[0].prose) else None
    return None


def climbed(best: Element, bound: Element | None) -> Element:
    """The container around ``best`` that holds the rest of an article cut into sections, up to ``bound``.

    That is one with ``CLIMB`` times its running text, or with more of it and a
    name of an article.  Of the body only the child on the way is taken, to be
    held against its siblings.
    """
    below, e = best, best.parent
    while best is not bound and e is not None:
        more = e.running >= CLIMB * best.running or e.good and e.running > best.running
        if more and best.running and e.density() <= best.density() + LIKE_LINKS:
            best = below if e.tag in ("body", "html") else e
        if e is bound:
            break
        below, e = e, e.parent
    return best


def main_text(page: str | None) -> str:
    """Text of the best container of a page and of its siblings that go with it.

    A block gives 1 point, 1 for each comma and up to 3 for each hundred
    characters; its container gets them, each further ancestor half of what the
    one below got.  Containers lose the share of their text that is in links;
    article and main elements count double, those in a marked element half.  If
    the page has one article element, the best container is looked for in it and
    its own siblings are kept only as headings and lists are; a
    container that holds one section of an article is left for that of all.
    A sibling is kept if it has a fifth of the best score, or holds running
    text, or stands between or beside such blocks as headings and lists do.
    Lists and boxes inside the container that are links for the most part are
    left out, unless running text goes before them, and after them or a heading
    leads them in.
    """
    elements, every = parsed(page or "")
    summed(elements, every)
    stay = released(elements)
    for e in elements:
        p = e.parent
        e.stays = (p is None or p.stays) and (not e.mark or e.at in stay)
        e.half = p is not None and p.half or bool(e.mark) and e.mark != "form" and not e.good
    blocks = [b for b in every if b[3].stays]
    if not blocks:
        bare = re.sub(r"(?i)</?(?:form|fieldset)\b[^>]*>", "", page or "")
        return main_text(bare) if bare != (page or "") else ""  # some pages are one form
    if len(blocks) < len(every):
        summed(elements, blocks)

    def worth(e: Element) -> float:
        return e.score * (1 - e.density()) * (2 if e.tag in ("article", "main") else 1) * (0.5 if e.half else 1)

    article = only_article(elements)
    pool = elements[article.at : article.last + 1] if article is not None else elements
    best = climbed(max((e for e in pool if e.score), key=worth, default=article), article)
    top = best.parent
    for e in elements:
        p = e.parent
        if e is best or best is not article and p is not None and p is top and e.first >= 0 and (worth(e) >= worth(best) / 5 or e.tag == "p" and e.chars > 80 and e.density() < 0.25):
            e.kept = e
        else:
            e.kept = p and p.kept
        e.child = e if p is not None and p is top else p and p.child
        linked = e.tag in BOXES and e.density() > 0.6
        e.box = None if e.kept is e or e is top else p and p.box or (e if linked else None)
    more = beside(blocks, top) if top is not None else set()

    running = [0]  # running blocks before each block
    for owner, words, linked, _ in blocks:
        running.append(running[-1] + (owner.tag not in HEADINGS and linked * 2 < len(words) and len(words) - linked >= RUNNING / 2))

    def in_text(box: Element) -> bool:
        if running[box.first] == running[box.parent.first]:
            return False
        lead = next((at for at in (box.first, box.first - 1) if blocks[at][0].tag in HEADINGS), None)
        if lead is not None:
            return not {w.lower() for w in _WORDS.findall(blocks[lead][1])} & MARKS
        return running[box.parent.last_block + 1] > running[box.last_block + 1]

    known: dict[int, bool] = {}

    def menu(box: Element | None) -> bool:
        if box is None:
            return False
        if box.at not in known:
            known[box.at] = not in_text(box)
        return known[box.at]

    return " ".join(words for at, (owner, words, *_) in enumerate(blocks) if (owner.kept is not None or at in more) and not menu(owner.box))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page: page_id, url, text, n_chars.

    Null and empty pages, and those with nothing but menus and the like, give
    an empty text.  Repeated rows stay; other columns are not read.  Each page
    is parsed where it is read, without a shuffle.
    """
    some = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))
    kinds = [f.dataType.simpleString() for f in some.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return some.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
