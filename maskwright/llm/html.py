"""Main text of web pages by tag-path ratios.

The text blocks of a page are summed by their tag path: characters, characters in links, punctuation, blocks. A
container's ratio is smoothed with those of the containers around and inside it, and blocks above a share of the
best are kept, with the short parts of their article, the headings before them and the text between them. Paths that hold
links alone, and parts that are by their tag or role no article (menus, notices, forms ...), do not take part, nor does
what lies outside the articles (or the main part) that hold most of the text. Class and id drop elements outside an
article; inside, they lessen the ratio of containers and, where they say nothing else, of paragraphs. Work and memory
grow with the page's length, however deep it is nested.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("html body main article section div td th blockquote center details figure dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option optgroup textarea input label iframe object embed svg "
    "canvas audio video dialog menu noembed noframes title xmp".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer footers masthead "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended toolbar login search skip copyright".split()
)
#: Words that say nothing of what an element holds: a name of dropped words and these alone is sure.
FRAME_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col container content entry form header icon icons inline inner item items "
    "left link links list main meta news outer page panel post posts right row section site slot stories text title tools top topics unit wrap wrapper".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEGATIONS = frozenset("no not has with without".split())
#: A start tag of the key ends open elements of the value, up to the nearest element in the second value.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、；：！？]")
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attr>(?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[A-Za-z][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.S)
WORD = re.compile("[a-z0-9]+")
OWN_TITLE = re.compile(r"\s*(?:<(?:header|hgroup|div)\b[^>]*>\s*)?<h([1-6])\b[^>]*>(.*?)</h\1\b", re.I | re.S)
MARKUP = re.compile("<[^>]*>")
TITLE_REACH = 1000
#: Containers that hold the whole page: what lies in them says nothing of their own text.
PAGE = frozenset("html body".split())
#: Share of the best smoothed ratio that a path needs, and what a container takes from the one around or inside it.
LEAST_SHARE = 0.1
#: Characters of a line in a column beside the article.
SHORT_LINE = 40
#: Share of links from which on a path, or a block of several links, is a menu.
LINKS_ALONE = 0.9
FROM_AROUND = 0.5
#: What is left of the ratio of a container whose name speaks against it: all of the name, or a word of it.
SURE_PENALTY = 0.05
PENALTY = 0.5
#: Blocks before the article among which its title is looked for.
HEADING_REACH = 3


class Block:
    """A run of text between block elements: the number of its path, its container, its penalised element, characters and links."""

    __slots__ = ("chars", "container", "inside", "linked", "links", "path", "penalised", "tag", "text")

    def __init__(self, path: int, tag: str, container: int, text: str, linked: int, links: int, penalised: int, inside: bool):
        self.path, self.tag, self.container, self.text, self.chars, self.linked, self.links = path, tag, container, text, len(text), linked, links
        self.penalised, self.inside = penalised, inside


def _weight(tag: str, attr: str, inside_article: bool, after: str) -> float:
    """What is left of an element's ratio by its tag, role and class: 0 for one that is no part of an article.

    Names only speak against containers inside an article; outside, those of dropped words alone drop any element
    but headings. The id of a section that repeats its title (looked up in `after`) says nothing.
    """
    if tag in DROPPED or tag == "header" and not inside_article:
        return 0.0
    if not attr or "=" not in attr and "hidden" not in attr:
        return 1.0
    found = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attr)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return 0.0
    if found.get("role") in DROPPED_ROLES:
        return 0.0
    textual = tag in HEADINGS or tag == "p" or tag not in BLOCKS
    if tag in ("html", "body", "main", "article") or tag in HEADINGS or textual and inside_article and tag != "p":
        return 1.0
    weight = 1.0
    for name in [*found.get("class", "").split(), found.get("id", "")]:
        words = WORD.findall(name)
        if not NEGATIONS.isdisjoint(words):
            continue
        if "header" in words and not inside_article:
            return 0.0
        if DROPPED_WORDS.isdisjoint(words):
            continue
        if tag == "section" and inside_article and name == found.get("id"):
            title = OWN_TITLE.match(after)
            if title and set(words) <= set(WORD.findall(html.unescape(MARKUP.sub("", title[2])).lower())):
                continue
        sure = all(w in DROPPED_WORDS or w in FRAME_WORDS or w.isdigit() for w in words)
        if sure and not inside_article:
            return 0.0
        if not textual or sure:
            weight = min(weight, SURE_PENALTY if sure else PENALTY)
    return weight


def blocks_of(page: str) -> tuple[list[Block], list[int], list[str], list[float]]:
    """Text blocks of a page in order, for every container the one around it (-1 for none) and its tag, and the penalties of penalised elements."""
    # tag, dropped, container, inside an article, penalised element, number of the path of block elements, its last tag
    nothing = ("", False, -1, False, -1, 0, "")
    stack: list[tuple[str, bool, int, bool, int, int, str]] = []
    paths: dict[tuple[int, str], int] = {}
    depth_of: dict[str, int] = {}  # open elements of every tag
    penalties: list[float] = []
    around: list[int] = []
    tags: list[str] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, _, container, inside, penalised, path, last = stack[-1] if stack else nothing
                blocks.append(Block(path, last, container, text, min(linked, len(text)), links, penalised, inside))
            pieces.clear()
        linked = links = 0

    def pop_to(depth: int) -> None:
        if any(s[0] in BLOCKS for s in stack[depth:]):
            flush()
        for s in stack[depth:]:
            depth_of[s[0]] -= 1
        del stack[depth:]

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        text_end = found.start() if found else len(page)
        if text_end > at and not (stack and stack[-1][1]):
            pieces.append(page[at:text_end])
            if depth_of.get("a", 0):
                linked += text_end - at
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if depth_of.get(tag, 0):
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            if depth_of.get("p", 0):
                depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in CONTAINERS)
                if stack[depth][0] == "p":
                    pop_to(depth)
            if tag in IMPLIED and any(depth_of.get(t, 0) for t in IMPLIED[tag][0]):
                ends, until = IMPLIED[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in ends:
                        pop_to(k)
            flush()
        if tag in VOID:
            continue
        _, dropped, container, inside, penalised, path, last = stack[-1] if stack else nothing
        links += tag == "a"
        weight = 0.0 if dropped else _weight(tag, found["attr"], inside, page[at : at + TITLE_REACH] if tag == "section" else "")
        dropped = weight == 0
        if 0 < weight < (penalties[penalised] if penalised >= 0 else 1):
            penalties.append(weight)
            penalised = len(penalties) - 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in CONTAINERS and not dropped:
            around.append(container)
            tags.append(tag)
            container = len(around) - 1
        if tag in BLOCKS:
            path, last = paths.setdefault((path, tag), len(paths) + 1), tag
        depth_of[tag] = depth_of.get(tag, 0) + 1
        stack.append((tag, dropped, container, inside or tag in ("article", "main"), penalised, path, last))
    pop_to(0)
    flush()
    return blocks, around, tags, penalties


def _ratio(chars: float, linked: float, marks: float, count: float) -> float:
    """Text to path ratio fused with punctuation; text in links speaks against a path."""
    free = (chars - linked) / chars
    return chars * free * free * (1 + math.log1p(marks / count)) * (1 + math.log1p(chars / count) / 8)


def _unpenalised(blocks: list[Block], penalties: list[float]) -> list[Block]:
    """Without the penalised elements whose ratio per block, so lessened, is below a share of that of the other text.

    Where there is an article, names like theirs outside of it drop them.
    """
    def per_block(part: list[Block]) -> float:
        part = [b for b in part if b.tag not in HEADINGS] or part
        return _ratio(*(sum(x) for x in zip(*((b.chars, b.linked, len(PUNCTUATION.findall(b.text)), 1) for b in part)))) / len(part) if part else 0.0

    free = [b for b in blocks if b.penalised < 0]
    article = [b for b in free if b.inside]
    usual = per_block(article or free)
    of: dict[int, list[Block]] = {}
    for b in blocks:
        of.setdefault(b.penalised, []).append(b)
    out = {e for e, part in of.items() if e >= 0 and (article and not part[0].inside or penalties[e] * per_block(part) < LEAST_SHARE * usual)}
    return [b for b in blocks if b.penalised not in out]


def _nearest(around: list[int], tags: list[str], tag: str) -> list[int]:
    """For every container the innermost one of that tag that is or holds it, or -1; the last entry is for blocks outside any."""
    out = [-1] * (len(around) + 1)
    for c, o in enumerate(around):
        out[c] = c if tags[c] == tag else out[o]
    return out


def _without_menus(blocks: list[Block]) -> list[Block]:
    """Without blocks of several links and nothing else, and without paths of several blocks that are links alone."""
    sums: dict[int, list[int]] = {}
    letters = [sum(map(str.isalnum, b.text)) if b.linked else b.chars for b in blocks]  # bars and dots between links are none of either
    for b, n in zip(blocks, letters):
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + n, s[1] + b.linked, s[2] + 1
    menu = {p for p, (chars, linked, count) in sums.items() if count > 1 and linked >= LINKS_ALONE * chars}
    alone = [b.links > 1 and b.linked >= LINKS_ALONE * n or b.path in menu and b.tag not in HEADINGS and b.tag != "p" for b, n in zip(blocks, letters)]
    return [b for b, menu_ in zip(blocks, alone) if not menu_]


def main_text(page: str | None) -> str:
    """Blocks of the paths that hold the article, and what lies among them, in page order, one to a line."""
    blocks, around, tags, penalties = blocks_of(page or "")
    if penalties:
        blocks = _unpenalised(blocks, penalties)
    blocks = _without_menus(blocks)
    if not blocks:
        return ""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        s[0] += b.chars
        s[1] += b.linked
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += 1
    ratio = {path: _ratio(*s) for path, s in sums.items()}
    # a container has the ratios of the paths of its own blocks, and a share of those around it and inside it
    own: dict[int, float] = {}
    for container, path in dict.fromkeys((b.container, b.path) for b in blocks):
        own[container] = own.get(container, 0.0) + ratio[path]
    outer, inner = [0.0] * (len(around) + 1), [0.0] * (len(around) + 1)  # the last is that of blocks outside any container
    for c, o in enumerate(around):  # containers come after those around them
        outer[c] = FROM_AROUND * (own.get(o, 0.0) + outer[o])
    for c in range(len(around) - 1, -1, -1):
        if around[c] >= 0 and tags[around[c]] not in PAGE:
            inner[around[c]] = max(inner[around[c]], FROM_AROUND * max(own.get(c, 0.0), inner[c]))
    from_text = [own.get(b.container, 0.0) + outer[b.container] for b in blocks]
    best = max(from_text)
    if best <= 0:
        return ""
    least = LEAST_SHARE * best
    plain = [2 * b.linked <= b.chars for b in blocks]
    kept = [score >= least or plain[k] and inner[blocks[k].container] >= least for k, score in enumerate(from_text)]

    # where most of the kept text lies in articles, or else in the main part, what lies outside is something else
    article, main = _nearest(around, tags, "article"), _nearest(around, tags, "main")
    chars = sum(b.chars for b, k in zip(blocks, kept) if k)
    region = [True] * len(blocks)
    for nearest in (article, main):
        if 2 * sum(b.chars for b, k in zip(blocks, kept) if k and nearest[b.container] >= 0) > chars:
            region = [nearest[b.container] >= 0 for b in blocks]
            break
    kept = [k and r for k, r in zip(kept, region)]
    articles = {article[b.container] for b, k in zip(blocks, kept) if k} - {-1}
    # of an article also the short parts: text that is not outweighed by its links
    kept = [k or plain[n] and article[b.container] in articles for n, (b, k) in enumerate(zip(blocks, kept))]

    # sentences right beside kept blocks in a container of the same parent, below the page itself
    parent = [around[b.container] if b.container >= 0 else -1 for b in blocks]
    for steps in (range(1, len(blocks)), range(len(blocks) - 2, -1, -1)):
        for k in steps:
            beside = k - 1 if steps.step > 0 else k + 1
            close = parent[k] == parent[beside] >= 0 and tags[parent[k]] not in PAGE and tags[parent[k]] != "main"
            if kept[beside] and not kept[k] and plain[k] and region[k] and close and PUNCTUATION.search(blocks[k].text):
                kept[k] = True

    # containers of several short lines at either end, away from the one with most text, are columns beside it
    lines: dict[int, list[int]] = {}
    for b in blocks:
        lines.setdefault(b.container, []).append(b.chars)
    most = max({b.container for b, k in zip(blocks, kept) if k}, key=lambda c: (sum(lines[c]), -c))
    usual = sum(lines[most]) / len(lines[most])

    columns = {
        c for c, own in lines.items()
        if c != most and article[c] < 0 and len(own) > 1 and max(own) < 2 * SHORT_LINE and sum(own) < len(own) * min(SHORT_LINE, usual / 3)
    }
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        for k in order:
            if kept[k] and blocks[k].container not in columns:
                break
            kept[k] = False

    # the headings before the first kept block, and text between kept ones
    first = kept.index(True)
    for k in range(first - 1, max(-1, first - 1 - HEADING_REACH), -1):
        if blocks[k].tag in HEADINGS and plain[k]:
            kept[k], first = True, k
    last = len(kept) - 1 - kept[::-1].index(True)
    return "\n".join(b.text for k, b in enumerate(blocks) if kept[k] or first < k < last and plain[k])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks joined by line feeds.

    Character references are decoded, white space inside a block becomes one space. Null and empty pages, and pages
    without a content path, have an empty text. Markup that ends early is read to its end. Repeated rows each give a
    row; null ids and URLs stay. Extra columns are ignored; an empty table gives no rows. A page is one row's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(0, batch.num_rows, 256):
                part = batch.slice(p, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
