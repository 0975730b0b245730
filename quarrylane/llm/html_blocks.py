"""Blocks of text of an HTML page, with what its markup says about them. Used by operator 12."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Elements and words of class, id and role by what they are for.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, and none of it is text of the page.
RAW = frozenset("script style noscript template title textarea iframe noembed noframes xmp".split())
NOT_TEXT = frozenset("nav footer aside form button select dialog menu svg math object video audio canvas map".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOT_TEXT_WORDS = frozenset(
    "nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs sidebar aside masthead topbar footer ad ads adv advert adverts advertisement advertisements advertising "
    "adsense adslot sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal "
    "overlay share sharing social related recommended recommendations trending comment comments commentlist discussion disqus replies respond widget widgets pagination pager toolbar copyright "
    "disclaimer alert paywall".split()
)
HEAD_WORDS, ARTICLE_WORDS = frozenset(["header"]), frozenset("article post entry story".split())
#: A class that tells what a page has beside its text (`has-sidebar`), not what the element is.
ABOUT_WORDS = frozenset("has with without no".split())
CONTENT_WORDS = ARTICLE_WORDS | {"content", "main"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: How sure a marked element is the article: by its element, as the page's main part, by its class.
ARTICLE, MAIN, BODY, CLASS = 4, 3, 2, 1


@dataclass(frozen=True)
class Mark:
    """What an element's markup says: it is no text of the article (drop), or may be the article (rank above 0)."""

    drop: bool
    rank: int
    form: bool = False
    header: bool = False


@dataclass
class Block:
    text: str
    links: int
    inside: tuple[tuple[int, Mark], ...] = field(default=())


@lru_cache(1 << 14)
def mark(name: str, attributes: str) -> Mark | None:
    """The mark of an element by its name and attributes, or None."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if name == "article":
        rank = ARTICLE
    elif name == "main" or role == "main":
        rank = MAIN
    else:
        rank = BODY if found.get("itemprop", "").lower() == "articlebody" else 0
    drop = hidden or name in NOT_TEXT or role in NOT_TEXT_ROLES
    if name not in ("html", "body"):
        for given in (found.get("class", ""), found.get("id", "")):
            for one in given.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words & ABOUT_WORDS:
                    continue
                if words & NOT_TEXT_WORDS or (words & HEAD_WORDS and not words & ARTICLE_WORDS):
                    drop = True
                elif words & CONTENT_WORDS and name in BLOCKS:
                    rank = max(rank, CLASS)
    header = name == "header"
    return Mark(drop, 0 if drop else rank, name == "form", header) if drop or rank or header else None


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in its order, white space turned into one space, references decoded; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, tuple[int, Mark] | None]] = []
    pieces: list[str] = []
    links, in_link, number, at, end = 0, 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, min(links, len(text)), tuple(m for *_, m in stack if m)))
            pieces.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if in_link:
                links += len(" ".join(text.split()))

    def close(names: tuple[str, ...], until: frozenset[str]) -> None:
        """Close the innermost element of these names, unless one of `until` is open within it."""
        nonlocal in_link
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                if any(m for *_, m in stack[k:]) or any(b for _, b, _ in stack[k:]):
                    flush()
                del stack[k:]
                in_link = sum(n == "a" for n, *_ in stack)
                return
            if stack[k][0] in until:
                return

    while at < end:
        found = _TAG.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, closing, attributes = name.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in RAW and not closing:
            over = re.compile(f"</{name}[^>]*>?", re.I).search(page, at)
            at = over.end() if over else end
            continue
        block = name in BLOCKS
        if name == "br" or name in ("td", "th"):
            pieces.append(" ")
        if closing:
            if block:
                close((name,), frozenset())
                flush()
            else:
                close((name,), BLOCKS)
            continue
        if block:
            flush()
            close(("p",), _P_SCOPE)
            if name in _ENDED:
                close(*_ENDED[name])
        if name in VOID or attributes.endswith("/") and not block:
            continue
        if name == "a":
            close(("a",), BLOCKS)
            in_link = 1
        said = mark(name, attributes) if name in NOT_TEXT or name in _TELLING or "=" in attributes or "hidden" in attributes.lower() else None
        if said and said.header and any(m and m[1].rank >= MAIN for *_, m in stack):
            said = None if not said.drop else said  # the heading of the article itself
        elif said and said.header:
            said = Mark(True, 0)
        number += 1
        if said and not block and said.drop:  # an advert within a block: what stands around it is the block's
            over = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = over.end() if over else at
            continue
        stack.append((name, block, (number, said) if said else None))
    flush()
    return out


_TELLING = frozenset(["article", "main", "header"])
_P_SCOPE = frozenset("article aside body button caption div fieldset footer form header html li main nav object section table td th".split())
_LISTS, _TABLE = frozenset(["ul", "ol", "menu", "dir"]), frozenset(["table"])
_ENDED = {"li": (("li",), _LISTS), "dd": (("dd", "dt"), frozenset(["dl"])), "dt": (("dd", "dt"), frozenset(["dl"])), "tr": (("tr",), _TABLE), "option": (("option",), frozenset(["select"])), "body": (("head",), frozenset())}


def _text(blocks: list[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def article_of(blocks: list[Block]) -> tuple[list[Block], int]:
    """The blocks that may be the article's by the markup, and how sure the page's article is marked (0: not at all).

    Of marked articles the one with more than half of their text, else all; of elements with a telling class the
    innermost with most of the text. Menus and the like go where they are within the article; without a marked article
    they go wherever they are, and so do blocks that are links only.
    """
    forms = {n for b in blocks for n, m in b.inside if m.form}
    wrapping = {n for n in forms if 2 * _text([b for b in blocks if any(n == k for k, _ in b.inside)]) > _text(blocks)}
    drops = [[k for k, (n, m) in enumerate(b.inside) if m.drop and n not in wrapping] for b in blocks]
    held: dict[int, dict[int, list[int]]] = {ARTICLE: {}, MAIN: {}, BODY: {}, CLASS: {}}
    for i, (b, gone) in enumerate(zip(blocks, drops, strict=True)):
        if gone:
            continue
        seen = set()
        for n, m in b.inside:
            if m.rank and (m.rank == CLASS or m.rank not in seen):  # of nested articles the outermost
                seen.add(m.rank)
                held[m.rank].setdefault(n, []).append(i)
    size = [len(b.text) for b in blocks]
    amount = {n: sum(size[i] for i in own) for rank in held.values() for n, own in rank.items()}
    for rank in (ARTICLE, MAIN, BODY):
        own = held[rank]
        if not own:
            continue
        best = max(own, key=lambda n: amount[n])
        if 2 * amount[best] > sum(amount[n] for n in own):
            return [blocks[i] for i in own[best]], rank
        if rank != ARTICLE or not held[MAIN]:
            return [blocks[i] for i in sorted({i for x in own.values() for i in x})], rank
    free = [i for i, gone in enumerate(drops) if not gone]
    telling = [n for n in held[CLASS] if 5 * amount[n] >= 3 * sum(size[i] for i in free)]
    if telling:
        return [blocks[i] for i in held[CLASS][max(telling)]], CLASS
    return [blocks[i] for i in free if 5 * blocks[i].links < 4 * len(blocks[i].text)], 0
