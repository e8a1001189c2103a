"""A small tolerant HTML reader: block nodes with their text, and their features."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

# Fixed word lists: elements by kind, and attribute words by what they announce.
KINDS = {
    "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside dialog", "article": "article main",
    "section": "section", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd",
    "table": "table tbody thead tfoot tr td th caption", "form": "form fieldset", "figure": "figure figcaption",
    "quote": "blockquote pre address", "div": "div center details summary hr",
    "bare": "",            # text straight in the page: an anonymous block, its tag is empty
}
WORDS = {
    "menu": "nav navbar navigation menu menubar topnav subnav breadcrumb breadcrumbs crumbs tabs toolbar pager pagination "
            "toc skip links",
    "head": "header head masthead topbar top logo branding title",
    "foot": "footer foot bottom copyright legal colophon credits imprint",
    "side": "sidebar side aside rail widget widgets complementary secondary related recommended popular trending more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense",
    "notice": "notice notification cookie cookies consent gdpr alert popup modal overlay toast warning newsletter subscribe "
              "subscription paywall disclaimer",
    "comment": "comment comments reply replies respond discussion disqus thread reviews feedback guestbook",
    "share": "share sharing social follow tweet tags tag meta",
    "form": "form search searchbox login signup signin register contact input",
    "content": "content article articlebody post entry story body main text copy blog single prose",
}
# Elements whose content is never text of the page, and elements without content.
SKIPPED = ("script style noscript template iframe object svg canvas head title select button textarea audio video map "
           "noframes xmp").split()
BLOCK = {tag: kind for kind, tags in KINDS.items() for tag in tags.split() or [""]}
WORD = {w: g for g, ws in WORDS.items() for w in ws.split()}
ANNOUNCING = {w for w, g in WORD.items() if g not in ("content", "head")}
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)      # the second form: a quote that is never closed
_ATTR = re.compile(r"\b(class|id|role|aria-label|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCT = re.compile(r"[.!?,;:]")
_MARK = re.compile(r" [|/\u00b7\u2022\u00bb\u203a] ")
_STRIP = ".,;:!?()[]\"'\u00a9"


@dataclass
class Node:
    """A block element, or a run of text straight in the page. Sums over the subtree are
    filled in when reading is over."""

    tag: str
    parent: int
    depth: int
    groups: frozenset = frozenset()
    label: str = ""
    children: list = field(default_factory=list)
    own: int = 0           # characters of its own text
    chars: int = 0         # of the subtree, and so on
    words: int = 0
    links: int = 0
    punct: int = 0
    marks: int = 0         # that set items of a menu apart
    announcing: int = 0    # words of its text that announce a part of a page other than its content
    blocks: int = 1
    paragraphs: int = 0


def attributes(raw: str) -> tuple[frozenset, str]:
    """Announcing groups of an element's attribute words, and its training label if any."""
    groups, label = set(), ""
    for m in _ATTR.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-y":
            label = value
        else:
            groups.update(WORD[w] for w in (p.lower() for p in _PART.findall(value)) if w in WORD)
    return frozenset(groups), label


def read(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, segments): nodes in page order, node 0 standing for the page, and the
    text segments (node, text) between block borders, references decoded. Each run of text
    that lies in no block is a node of its own below node 0, which has no text itself."""
    nodes, stack, segments = [Node("", -1, 0)], [0], []
    run: list[str] = []
    linked, in_link, at, size = 0, 0, 0, len(page)
    bare = ""                  # training label of the run that lies in no block

    def flush() -> None:
        nonlocal run, linked, bare
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                at = stack[-1]
                if at == 0:
                    at = len(nodes)
                    nodes.append(Node("", 0, 1, label=bare))
                    nodes[0].children.append(at)
                n = nodes[at]
                n.own += len(text)
                n.words += text.count(" ") + 1
                n.links += min(linked, len(text))
                n.punct += len(_PUNCT.findall(text))
                n.marks += len(_MARK.findall(text))
                n.announcing += sum(w.strip(_STRIP).lower() in ANNOUNCING for w in text.split(" "))
                segments.append((at, text))
        run, linked, bare = [], 0, ""

    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            run.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at, tag, raw = m.end(), (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in SKIPPED:
            if not closing and not raw.endswith("/"):
                at = _end(tag, page, at)
            run.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in ("br", "wbr", "img", "input"):
            run.append("" if tag == "wbr" else " ")
        elif tag in BLOCK:
            flush()
            if not closing:
                top = nodes[stack[-1]].tag
                if top == "p" or top in CLOSES.get(tag, "").split():
                    stack.pop()
                if tag == "hr":
                    continue
                groups, label = attributes(raw)
                nodes.append(Node(tag, stack[-1], len(stack), groups, label))
                nodes[stack[-1]].children.append(len(nodes) - 1)
                stack.append(len(nodes) - 1)
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag == tag:
                        del stack[i:]
                        break
        elif not closing and len(stack) == 1 and "data-y" in raw:
            bare = attributes(raw)[1]
        # other elements are inline: their text belongs to the block around them
    flush()
    for n in nodes:
        n.chars = n.own
        n.paragraphs = int(n.tag == "p")
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        for a in ("chars", "words", "links", "punct", "marks", "announcing", "blocks", "paragraphs"):
            setattr(p, a, getattr(p, a) + getattr(n, a))
    return nodes, segments


_ENDS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in SKIPPED}


def _end(tag: str, page: str, at: int) -> int:
    """Where the content of a skipped element ends. An unclosed one ends where it began;
    the head's end tag may be left out, the body then begins it."""
    m = _ENDS[tag].search(page, at)
    return m.end() if m else at


KIND_NAMES, GROUP_NAMES = list(KINDS), list(WORDS)
FEATURES = ([f"is_{k}" for k in KIND_NAMES] + [f"says_{g}" for g in GROUP_NAMES]
            + [f"in_{k}" for k in ("nav", "header", "footer", "aside", "article", "form")]
            + [f"under_{g}" for g in GROUP_NAMES]
            + ["chars", "words", "link_share", "punct_per_word", "blocks", "chars_per_block", "paragraphs", "own_share",
               "depth", "place", "share_of_page", "share_of_parent", "siblings", "same_tag", "sibling_chars",
               "parent_paragraphs", "before", "words_per_punct", "has_heading", "beside_heading", "announcing", "marks"])


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: element kind, attribute words of it and of its ancestors, densities
    of its subtree, depth, place, and statistics of its siblings.

    ``under_`` a group is not a flag but the part of the page's text that the nearest ancestor with such a
    word holds: a word on a wrapper around the whole page says little, one on a small part much."""
    out = np.zeros((len(nodes), len(FEATURES)), np.float32)
    kinds, groups = len(KIND_NAMES), len(GROUP_NAMES)
    inside = [()] * len(nodes)                 # (kinds, {group: share of the page}) of the ancestors
    total, before = max(nodes[0].chars, 1), 0
    inner = ("nav", "header", "footer", "aside", "article", "form")
    alike = Counter((n.parent, n.tag) for n in nodes[1:])
    titled = {n.parent for n in nodes[1:] if n.tag in ("h1", "h2")}
    for i, n in enumerate(nodes):
        if i == 0:
            inside[0] = (frozenset(), {})
            continue
        p = nodes[n.parent]
        up = inside[n.parent]
        kind = BLOCK[n.tag]
        inside[i] = (up[0] | {kind}, up[1] | dict.fromkeys(n.groups, max(n.chars / total, 1e-3)) if n.groups else up[1])
        row = out[i]
        row[KIND_NAMES.index(kind)] = 1
        for g in n.groups:
            row[kinds + GROUP_NAMES.index(g)] = 1
        for j, k in enumerate(inner):
            row[kinds + groups + j] = k in up[0]
        for g, share in up[1].items():
            row[kinds + groups + len(inner) + GROUP_NAMES.index(g)] = share
        sib = p.children
        same = alike[n.parent, n.tag]
        row[kinds + 2 * groups + len(inner):] = (
            np.log1p(n.chars), np.log1p(n.words), n.links / max(n.chars, 1), n.punct / max(n.words, 1), np.log1p(n.blocks),
            np.log1p(n.chars / n.blocks), np.log1p(n.paragraphs), n.own / max(n.chars, 1), n.depth, i / len(nodes),
            n.chars / total, n.chars / max(p.chars, 1), np.log1p(len(sib)), np.log1p(same),
            np.log1p((p.chars - p.own) / len(sib)), np.log1p(p.paragraphs), before / total,
            n.words / (1 + n.punct), i in titled, n.parent in titled and n.parent > 0, n.announcing / max(n.words, 1),
            n.marks / max(n.words, 1))
        before += n.own
    return out
