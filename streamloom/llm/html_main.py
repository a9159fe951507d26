"""The main text of HTML pages by scoring the trees of their elements."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame


#: Text of these is not part of any page.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold no article text, whatever their class.
NEVER = {"nav", "footer", "aside", "form", "button", "select", "noscript", "iframe", "object", "svg", "template", "dialog", "menu", "head", "canvas", "audio", "video", "map", "fieldset"}
#: Elements that end a block of text.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag ends the open elements of the first set, up to one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: A paragraph outside of these goes on after them, whatever they hold.
SCOPES = ("button", "noscript", "iframe", "object", "svg", "template", "canvas", "audio", "video", "select")
#: Of NEVER, elements that may be around a whole page.
WRAPS = {"form", "fieldset"}
#: A class, an id or a role of such words marks what is no article, alone or with words of PLAIN.
UNLIKELY = re.compile(
    r"ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|commentlist|commentary|consent|cookies?|disqus|footer|footnav|gdpr|guestbook|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|outbrain|overlay|pager|pagination|popup|promos?|promoted|recommended|related|repl(?:y|ies)|respond|share|sharing|sidebars?|signup|social|sponsor(?:ed|s)?|subscribe|subscription|taboola|toolbar|widgets?|complementary|contentinfo|search|alert|toc"
)
REMARKS = re.compile(r"comments?|commentlist|commentary|disqus|guestbook|repl(?:y|ies)|respond")
PLAIN = set(
    "area articles author bar block body bottom box btn button buttons center col column container content count footer form global group head header icon icons inner item items left link links list main meta mobile nav news outer page panel pane post posts primary right row secondary section site slot sticky stories sub tertiary text thread top unit wrap wrapper zone".split()
)
#: Parts of a name that tell what readers wrote if both are there.
READERS = {"user", "users", "customer", "customers", "reader", "readers", "visitor", "visitors", "guest", "guests"}
WRITINGS = {"review", "reviews", "comment", "comments", "feedback", "notes", "opinions", "ratings", "discussion"}
#: Whole names that readers' words and parts of articles share.
DISCUSSIONS = {"discussion", "discussions", "feedback", "reviews", "responses", "talkback", "testimonials", "thread", "threads"}
#: Signs of a reader's words, a title of one of several articles, and a name of DISCUSSIONS.
AUTHOR, DATE, REPLY, TITLE, DISCUSSION = 1, 2, 4, 8, 16
AUTHOR_NAMES = {"author", "username", "byline", "commenter", "reviewer", "nickname", "vcard", "fn"}
DATE_NAMES = {"date", "time", "timestamp", "datetime", "posted", "published", "dateline", "ago"}
AUTHOR_TEXT = re.compile(r"(?:posted |written |reviewed )?by\s\S.{0,40}|.{0,40}\b(?:says|said|wrote|writes)\s*:", re.IGNORECASE)
DATE_TEXT = re.compile(r".{0,20}(?:\d{4}-\d\d-\d\d|\d+ (?:second|minute|hour|day|week|month|year)s? ago|\d{1,2}(?:st|nd|rd|th)?\.? [^\W\d]{3,10}\.?,? \d{4}|[^\W\d]{3,10}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4}|\d{1,2}[./]\d{1,2}[./]\d{2,4}).{0,20}")
REPLY_TEXT = re.compile(r"reply(?: to .{1,40})?|répondre|antworten|responder|rispondi|beantwoorden|odpowiedz|ответить|返信|回复", re.IGNORECASE)
#: Elements that may each hold what one reader wrote.
ITEMS = {"article", "dd", "div", "li", "section", "table", "tr"}
#: Marks of an element: no text of it is kept; none unless the page needs it; the same for what readers wrote.
HARD, SOFT, REMARK = 1, 2, 3
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
TAG_END = re.compile(r"""(?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
#: Elements whose text is a paragraph of the element around them.
PARAGRAPHS = {"p", "pre", "td", "li", "blockquote", "dd"}


class Node:
    """An open or closed element and what its whole subtree adds up to."""

    __slots__ = ("tag", "parent", "dropped", "mark", "link", "closed", "own", "score", "chars", "linked", "held", "counts", "titles", "heads", "titled", "headed", "kept", "inside", "like", "signs", "first", "last")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, mark: int = 0, link: bool = False):
        self.tag, self.parent, self.dropped, self.mark, self.link = tag, parent, dropped, mark, link
        self.closed = self.kept = False
        self.own = self.score = self.held = 0.0
        self.chars = self.linked = self.counts = self.titles = self.heads = 0
        self.titled = tag in ("h1", "article", "main") and not mark or parent is not None and parent.titled
        self.headed = tag in ("h1", "main") or parent is not None and parent.headed
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.like, self.signs, self.first, self.last = "", 0, 0, -1


Block = tuple[Node, str, int]


@lru_cache(10_000)
def _name_mark(name: str) -> int:
    """The mark of a whole class token, id or role; related-work and has-sidebar are none."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
    if READERS.intersection(parts) and WRITINGS.intersection(parts):
        return REMARK
    if not any(map(UNLIKELY.fullmatch, parts)) or not all(p in PLAIN or UNLIKELY.fullmatch(p) for p in parts):
        return 0
    return REMARK if any(map(REMARKS.fullmatch, parts)) else SOFT


@lru_cache(10_000)
def _name_signs(name: str) -> int:
    """Signs in a class token, an id or a property's name."""
    parts = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
    author = AUTHOR if parts & AUTHOR_NAMES or {"user", "name"} <= parts else 0
    return author | (DATE if parts & DATE_NAMES else 0) | (REPLY if "reply" in parts else 0) | (DISCUSSION if name.lower() in DISCUSSIONS else 0)


def _signs(tag: str, attributes: dict[str, str]) -> int:
    signs = DATE if tag == "time" else TITLE if tag in ("h1", "h2") else 0
    for name in ("class", "id", "itemprop", "rel"):
        for token in attributes.get(name, "").split():
            signs |= _name_signs(token)
    return signs


def _mark(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """The mark of an element's own tag and attributes."""
    mark = SOFT if tag in WRAPS or tag == "label" else HARD if tag in NEVER else 0
    if mark == HARD or "hidden" in attributes or attributes.get("aria-hidden") == "true" or INVISIBLE.search(attributes.get("style", "")):
        return HARD
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return mark
    for name in ("class", "id", "role"):
        own = max(map(_name_mark, attributes.get(name, "").split()), default=0)
        if tag == "article":
            own = own if own == REMARK and name != "role" else 0
        elif own and name == "id" and in_article:
            own = 0  # the name of a part of the article
        mark = max(mark, own)
    if attributes.get("itemprop") == "comment" or attributes.get("itemtype", "").endswith(("/Comment", "/UserComments")):
        return REMARK
    return mark


class _Tree:
    """The open elements of a page, its elements in page order and its blocks of text.

    Places in the stack are kept by tag and for blocks, so that no step looks
    through the stack: a page takes time in proportion to its length.
    """

    def __init__(self, marks: bool):
        self.marks = marks
        self.nodes = [Node("", None, False)]
        self.stack = [self.nodes[0]]
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = [0]  # open blocks that are not dropped
        self.off_at: list[int] = []  # open elements that are dropped or marked
        self.inline_at: list[int] = []  # open inline elements with a mark
        self.blocks: list[Block] = []
        self.pieces: list[tuple[str, int, Node | None]] = []  # text, characters within links, marked inline element
        self.marked = False  # a piece is in such an element
        self.links = self.breaks = 0

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def flush(self) -> None:
        if self.pieces:
            pieces = _without_marked(self.pieces) if self.marked else self.pieces
            text = " ".join("".join(p[0] for p in pieces).split())
            if text:
                self.blocks.append((self.stack[self.block_at[-1]], text, min(sum(p[1] for p in pieces), len(text))))
            self.pieces = []
        self.marked, self.breaks = False, 0

    def add(self, text: str) -> None:
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        node, bare = self.stack[-1], text.strip()
        if 0 < len(bare) < 60:
            if AUTHOR_TEXT.fullmatch(bare):
                node.signs |= AUTHOR
            if DATE_TEXT.fullmatch(bare):
                node.signs |= DATE
            if (self.links or node.tag == "button") and REPLY_TEXT.fullmatch(bare):
                node.signs |= REPLY
        if node.dropped:
            return
        # the outermost marked inline element within the block
        k = bisect_right(self.inline_at, self.block_at[-1])
        inline = self.stack[self.inline_at[k]] if k < len(self.inline_at) else None
        self.marked |= inline is not None
        self.pieces.append((text, len(bare) if self.links else 0, inline))
        if bare:
            self.breaks = 0

    def line_break(self) -> None:
        """One is white space, two in a row end a block."""
        if not self.stack[-1].dropped:
            self.pieces.append((" ", 0, None))
            self.breaks += 1
            if self.breaks == 2:
                self.flush()

    def pop(self, to: int) -> None:
        if self.block_at[-1] >= to:
            self.flush()
        while len(self.stack) > to:
            node, k = self.stack.pop(), len(self.stack)
            if self.block_at[-1] == k:
                self.block_at.pop()
            if self.off_at and self.off_at[-1] == k:
                self.off_at.pop()
            if self.inline_at and self.inline_at[-1] == k:
                self.inline_at.pop()
            if not node.closed:
                self.close(node)

    def close(self, node: Node) -> None:
        self.at[node.tag].pop()
        self.links -= node.link

    def end(self, tag: str) -> None:
        block, k = tag in BLOCK, self.last((tag,))
        if block and not self.stack[-1].dropped:
            self.flush()
        if k and not block and self.block_at[-1] > k:
            self.stack[k].closed = True  # an inline element that a block within it outlives
            self.close(self.stack[k])
        elif k:
            self.pop(k)

    def start(self, tag: str, text: str) -> None:
        block = tag in BLOCK
        if block:
            if not self.stack[-1].dropped:
                self.flush()
            if self.last(("p",)) > self.last(SCOPES) and tag not in ("option", "legend", "summary"):
                self.pop(self.at["p"][-1])
            if tag in CLOSES:
                k = self.last(CLOSES[tag][0])
                if k > self.last(CLOSES[tag][1]):
                    self.pop(k)
            if tag in ("article", "main") and self.off_at and self.stack[self.off_at[0]].tag in ("nav", "header", "head", "form", "aside"):
                self.pop(self.off_at[0])  # what should have been closed before the article
        elif tag == "a":
            self.end("a")
        if tag in VOID or tag in RAW:
            return
        attributes: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(text):
            attributes.setdefault(name.lower(), next(filter(None, values), ""))
        in_article, parent = bool(self.at.get("article") or self.at.get("main")), self.stack[-1]
        mark = _mark(tag, attributes, in_article)
        if mark > HARD and (not self.marks and tag != "label" or not block and (self.at.get("pre") or self.at.get("code"))):
            mark = 0
        dropped = parent.dropped or mark == HARD or tag == "header" and not in_article
        node = Node(tag, parent, dropped, mark, tag == "a" and "href" in attributes)
        node.signs = _signs(tag, attributes)
        node.like = attributes.get("class", "").strip().partition(" ")[0].rstrip("0123456789-_")
        if node.link and self.last(HEADINGS):
            node.signs |= TITLE
        k = len(self.stack)
        self.nodes.append(node)
        self.stack.append(node)
        self.at.setdefault(tag, []).append(k)
        if block and not dropped:
            self.block_at.append(k)
        if dropped or mark:
            self.off_at.append(k)
        if mark and not dropped and not block:
            self.inline_at.append(k)
        self.links += node.link


def _without_marked(pieces: list[tuple[str, int, Node | None]]) -> list[tuple[str, int, Node | None]]:
    """A block's pieces but for marked inline elements that are no part of a sentence.

    Those are all where no word stands outside of them, and else those of
    mostly links; a link itself only if no text is on one side of it.
    """
    words = [k for k, p in enumerate(pieces) if p[2] is None and any(map(str.isalnum, p[0]))]
    if not words:
        return [p for p in pieces if p[2] is None]
    end = max(k for k, p in enumerate(pieces) if p[2] is None and p[0].strip())
    sizes: dict[Node, list[int]] = {}
    for k, (text, linked, inline) in enumerate(pieces):
        if inline is not None:
            size = sizes.setdefault(inline, [k, 0, 0])
            size[1] += len(text.strip())
            size[2] += linked
    off = {n for n, (k, chars, linked) in sizes.items() if 2 * linked > chars and not (n.link and words[0] < k < end)}
    return [p for p in pieces if p[2] not in off]


def parsed(page: str, marks: bool = True) -> tuple[list[Node], list[Block]]:
    """A page's elements, parents first, and its blocks in order: (element, text, characters within links).

    Blocks of elements with a mark other than HARD are there, too; without
    marks only HARD ones count.
    """
    tree, at, last, quoted = _Tree(marks), 0, page.rfind(">"), True
    while m := OPENING.search(page, at):
        tree.add(page[at : m.start()])
        at = m.end()
        if m[2] is None:  # a comment or a declaration
            end = page.find("-->", m.start() + 2) if m[0] == "<!--" else page.find(">", at)
            at = len(page) if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        if at > last:  # no tag ends from here on
            at = m.start()
            break
        # quoted values may hold a >, up to a tag that would thus have no end
        whole = TAG_END.match(page, at) if quoted else None
        quoted = whole is not None
        end = whole.end() if whole else page.find(">", at) + 1
        tag, text, at = m[2].lower(), page[at : end - 1], end
        if m[1]:
            tree.end(tag)
        elif tag == "br":
            tree.line_break()
        else:
            tree.start(tag, text)
            if tag in RAW:
                found = RAW_END[tag].search(page, at)
                end = page.find(">", found.end()) if found else -1
                at = len(page) if end < 0 else end + 1
    tree.add(page[at:])
    tree.flush()
    return tree.nodes, tree.blocks


def _points(node: Node, text: str, linked: int) -> float:
    """A paragraph's points: more for length and commas, less for its share of links."""
    if len(text) < 25 or node.tag in HEADINGS:
        return 0.0
    return (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked / len(text))


def _total(nodes: list[Node], found: list[Block]) -> None:
    """Sums over the subtree of each element: characters, points, paragraphs, blocks below titles.

    score passes all points of a paragraph to the element that holds it and
    half of an element's score to the one above.
    """
    for n in nodes:
        n.own = n.score = n.held = 0.0
        n.chars = n.linked = n.counts = n.titles = n.heads = 0
    for node, text, linked in found:
        points = _points(node, text, linked)
        node.chars += len(text)
        node.linked += linked
        node.held += points
        node.counts += points > 0
        node.titles += node.titled
        node.heads += node.headed
        holder = node.parent if node.tag in PARAGRAPHS else node
        holder.score += points
    for n in reversed(nodes):
        if n.parent is not None:
            up = n.parent
            up.chars += n.chars
            up.linked += n.linked
            up.held += n.held
            up.counts += n.counts
            up.titles += n.titles
            up.heads += n.heads
            up.score += n.score / 2


def _unmarked(nodes: list[Node], found: list[Block]) -> list[Block]:
    """The blocks in no marked element, but for marked ones around the page.

    Such an element holds most of the page's points. It has all titles (first
    headings, articles and main elements) within it, or one of them and nine
    tenths of the points; on a page without titles, nine tenths in several
    paragraphs. What readers wrote must have a first heading or the main element.
    """
    _total(nodes, found)
    page = nodes[0]

    def around(n: Node) -> bool:
        if 2 * n.held <= page.held or n.mark == REMARK and not n.heads:
            return False
        alone = page.held - n.held < 0.1 * page.held
        if not page.titles:
            return alone and n.counts > 1
        return n.titles == page.titles or alone and n.titles > 0

    for n in nodes:
        n.kept = (n.parent is None or n.parent.kept) and (not n.mark or around(n))
    return [x for x in found if x[0].kept]


def _without_remarks(nodes: list[Node], found: list[Block]) -> list[Block]:
    """The blocks but for what readers wrote below the article, told by its structure.

    That is, like siblings (of one tag and first class) which all have an
    author, all a date or all a reply link, and none a title, as articles of a
    list have; or an element outside of the article with a name of DISCUSSIONS,
    of which parts of an article may be named, too, so that one without such
    signs may not hold more points than what is before it. Before them lies an
    article; after them lies a tenth of its points at most. The element that
    holds them and nothing before them goes, and a heading just before.
    """
    sums = [0.0]
    for n in nodes:
        n.first, n.last = len(found), -1
    for k, block in enumerate(found):
        n = block[0]
        n.first, n.last = min(n.first, k), k
        sums.append(sums[-1] + _points(*block))
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.first, n.parent.last = min(n.parent.first, n.first), max(n.parent.last, n.last)
            n.parent.signs |= n.signs & ~DISCUSSION
    groups: dict[tuple[Node, str, str], list[Node]] = {}
    found_groups = []
    for n in nodes:
        if n.last >= 0 and n.parent is not None:
            if n.tag in ITEMS:
                groups.setdefault((n.parent, n.tag, n.like), []).append(n)
            if n.signs & DISCUSSION and not n.inside and (n.tag in ITEMS or n.tag in ("ol", "ul")):
                found_groups.append([n])
    for (up, _, _), items in groups.items():
        common = AUTHOR | DATE | REPLY
        for n in items:
            common &= n.signs
        # a block of its own beside the signs, unlike an entry of a list of works
        apart = common & REPLY or all(found[n.first][0] is not n or n.last > n.first for n in items)
        if len(items) > 1 and apart and (common & ~DATE or common and not up.inside) and not any(n.signs & TITLE for n in items):
            found_groups.append(items)
    end, off = len(found), set()
    for items in sorted(found_groups, key=lambda g: (-max(n.last for n in g), min(n.first for n in g))):
        first, last = min(n.first for n in items), max(n.last for n in items)
        if last >= end:
            continue  # within what went before
        lead, held, rest = sums[first], sums[last + 1] - sums[first], sums[end] - sums[last + 1]
        if not lead or 10 * rest > lead or lead < min(3.0, held / 2):
            continue
        if len(items) == 1 and held > lead and not items[0].signs & (AUTHOR | DATE | REPLY):
            continue
        up = items[0].parent
        while up is not None and up.tag not in ("", "html", "body", "main", "article") and sums[up.first] == lead:
            items, up = [up], up.parent
        first = min(n.first for n in items)
        before = found[first - 1][0] if first else None
        if before is not None and before.tag in HEADINGS and before.tag != "h1" and before.parent is up:
            items, first = [before, *items], first - 1
        off.update(items)
        end = first
    for n in nodes:
        n.kept = (n.parent is None or n.parent.kept) and n not in off
    return [x for x in found if x[0].kept] if off else found


def _worth(n: Node) -> float:
    return n.score * (1 - n.linked / max(n.chars, 1))


def main_text(page: str | None) -> str:
    """The best container's blocks and those of its siblings that belong to it, a line each.

    Of equal containers the first one that opens is the best. One that holds
    less than half of the page's points gives way to the element around it,
    the body and what is above excepted, and every container to an article
    around it. Where no paragraph has points, the first article is the text, or
    all blocks; where marks leave nothing, the page is read without them.
    """
    if not page:
        return ""
    nodes, found = parsed(page)
    if any(n.mark for n in nodes):
        found = _unmarked(nodes, found)
    if not found:
        nodes, found = parsed(page, marks=False)
        if not any(_points(*x) for x in found):
            return ""
    else:
        found = _without_remarks(nodes, found)
    _total(nodes, found)
    top = nodes[0]
    if top.held:
        best = max((n for n in nodes if n.tag and n.score > 0), key=_worth, default=top)
        while 2 * best.held < top.held and best.parent is not None and best.parent.tag not in ("", "body", "html"):
            best = best.parent
        up = best
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        best = up or best
        least = max(10.0, 0.2 * _worth(best))
    else:
        best = next((n for n in nodes if n.chars and n.tag in ("article", "main")), top)
    for n in nodes:
        n.kept = n is best or n.parent is not None and n.parent.kept
        if top.held and not n.kept and n.parent is best.parent and best.tag not in ("", "body", "html"):
            density = n.linked / max(n.chars, 1)
            n.kept = _worth(n) >= (least if n.tag != "article" or best.tag != "article" else 0.2 * _worth(best)) or density < 0.25 and (n.tag == "p" and n.chars > 80 or n.tag in HEADINGS)
    return "\n".join(text for node, text, _ in found if node.kept)


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Blocks lie a line each, in page order, their white space made one space;
    one line break is white space, two end a block. A marked inline element
    within a sentence stays; what readers wrote goes by names or by its
    structure. Pages go one by one, with
    nothing shuffled, so ids may be null or repeat, and repeated rows have equal
    texts. A null or empty html, or one of marked elements without a
    paragraph's points, gives an empty text; of a page of short blocks that no
    mark drops all are the text. Very long pages are read whole, in time in
    proportion to their length, however broken; of equal containers the first
    one that opens wins. An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    rows = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"`{url_col}` url", f"`{html_col}` html")
    return rows.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")
