"""Training pages for the extraction model: random layouts of the parts that web
pages are made of, every block element marked with ``data-y`` (1 content, 0 not).

The rules follow common page conventions: landmarks or plain divs, class and id
words in several spellings or none, end tags left out, boilerplate before,
beside, after and inside the article, reader comments in the same prose as it.
The article, what is in it and what is around it carry words that announce other parts, too
(``comment-enabled``, ``has-sidebar``, ``top``): a word alone decides nothing.
One page in four has text straight in the body, in inline elements at most; there
an inline element carries the mark.
"""

from __future__ import annotations

import random

from visitstat.llm.dom import WORDS

_SYLLABLES = "ba co de fi gu ha jo ka le mi no pe ra su ti vo wa xe yo zu an er in or ut".split()
# Class or id words per part; one is drawn, or none.
NAMES = {
    "header": "header site-header masthead top-bar page-head branding",
    "menu": "nav main-nav menu navbar site-navigation topnav menu-primary breadcrumbs pagination",
    "side": "sidebar aside rail widget-area secondary related-posts popular recommended more-stories",
    "ad": "ad ads advert advertisement sponsored promo-box banner-ad ad_slot adsense",
    "notice": "cookie-notice cookies consent-banner gdpr alert newsletter subscribe-box popup modal notice",
    "comments": "comments comment-list discussion responses reader-comments thread replies",
    "share": "share social-share follow-us tags post-meta sharing",
    "form": "search-form login signup contact-form newsletter-form",
    "footer": "footer site-footer page-bottom copyright legal colophon",
    "content": "content article post entry-content story-body main article-body post-content text",
    "wrap": "wrapper container page site layout row col inner grid outer",
}
# How a word of another part appears on content, and the words.
MISLEADING = ("{}", "{}", "{}-enabled", "has-{}", "with-{}", "{}-open", "{}_wrap", "{}-page", "no-{}", "{}-2")
MISLEADING_GROUPS = [*WORDS, "comment", "comment", "side"]


class Layouts:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.seed = seed

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice(".....?!") for _ in range(self.r.randint(low, high)))

    def tag(self, name: str, y: int, body: str, part: str = "", named: float = 0.75) -> str:
        attrs = ""
        if part and self.r.random() < named:
            words = self.r.choice(NAMES[part].split())
            extra = f" {self.r.choice(NAMES['wrap'].split())}-{self.r.randint(1, 9)}" if self.r.random() < 0.2 else ""
            attrs = f' {self.r.choice(["class", "class", "id"])}="{words}{extra}"'
        if y and part and self.r.random() < 0.45:
            word = self.r.choice(MISLEADING).format(self.r.choice(WORDS[self.r.choice(MISLEADING_GROUPS)].split()))
            attrs = f'{attrs[:-1]} {word}"' if attrs and self.r.random() < 0.6 else f' {self.r.choice(["class", "id"])}="{word}"'
        end = "" if name in ("p", "li") and self.r.random() < 0.15 else f"</{name}>"
        return f'<{name}{attrs} data-y="{y}">{body}{end}'

    def links(self, n: int, y: int = 0) -> str:
        return self.tag(self.r.choice(["ul", "ul", "ol"]), y, "".join(
            self.tag("li", y, f'<a href="/x">{self.words(1, 5)}</a>') for _ in range(n)))

    def menu(self) -> str:
        n = self.r.randint(2, 12)
        body = self.links(n) if self.r.random() < 0.7 else " ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(n))
        return self.tag(*self.r.choice([("nav", 0), ("nav", 0), ("div", 0), ("section", 0)]), body, "menu")

    def header(self) -> str:
        body = self.tag("div", 0, self.words(1, 4)) + (self.menu() if self.r.random() < 0.6 else "")
        if self.r.random() < 0.3:
            body += self.tag("p", 0, self.words(3, 9))
        return self.tag(self.r.choice(["header", "header", "div"]), 0, body, "header", 0.9)

    def small(self, part: str) -> str:
        """An advert, notice, share bar or form."""
        text = self.prose(1, 2) if self.r.random() < 0.6 else self.words(2, 9)
        if part in ("notice", "form") and self.r.random() < 0.5:
            text = self.telling(text)
        if part == "form":
            return self.tag("form", 0, self.tag("div", 0, text) + '<input name="q"><button>Go</button>', "form")
        if part == "share":
            text = " ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 6)))
        body = self.tag("p", 0, text) if self.r.random() < 0.5 else text
        return self.tag(self.r.choice(["div", "div", "section", "aside", "p"]) if "<p" not in body
                        else self.r.choice(["div", "section", "aside"]), 0, body, part, 1.0)

    def telling(self, text: str) -> str:
        """A short text that says itself what it is."""
        words = text.split()
        for _ in range(self.r.randint(1, 3)):
            words.insert(self.r.randint(0, len(words)), self.r.choice((WORDS["notice"] + " " + WORDS["form"]).split()))
        return " ".join(words)

    def mentioning(self, text: str) -> str:
        """Content that has such a word in its text now and then."""
        words = text.split()
        if self.r.random() < 0.25:
            words.insert(self.r.randint(0, len(words)), self.r.choice(WORDS[self.r.choice(list(WORDS))].split()))
        return " ".join(words)

    def side(self) -> str:
        parts = []
        for _ in range(self.r.randint(1, 4)):
            body = self.tag("h3", 0, self.words(1, 4)) if self.r.random() < 0.6 else ""
            body += self.links(self.r.randint(2, 8)) if self.r.random() < 0.6 else self.tag("p", 0, self.prose(1, 3))
            parts.append(self.tag("div", 0, body, "side", 0.4))
        name = self.r.choice(["aside", "aside", "div"])
        return self.tag(name, 0, "".join(parts), "side", 0.6 if name == "aside" else 1.0)

    def comments(self) -> str:
        one = lambda: self.tag(self.r.choice(["div", "li", "article"]), 0, self.tag("div", 0, self.words(1, 3))
                               + self.tag("p", 0, self.prose(1, 4)), "comments", 0.4)
        body = self.tag("h3", 0, f"{self.r.randint(1, 99)} {self.words(1, 2)}") + "".join(
            one() for _ in range(self.r.randint(1, 8)))
        return self.tag(self.r.choice(["section", "div", "div", "ol"]), 0, body, "comments", 1.0)

    def footer(self) -> str:
        body = f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}" if self.r.random() < 0.7 else self.prose(1, 2)
        if self.r.random() < 0.4:
            body += self.links(self.r.randint(2, 6))
        return self.tag(self.r.choice(["footer", "footer", "footer", "div"]), 0, body, "footer", 0.8)

    def seldom(self) -> tuple:
        """Arguments of ``tag`` that give a part of an article a name now and then."""
        return ("content", 0.5) if self.r.random() < 0.1 else ()

    def paragraph(self) -> str:
        k = self.r.random()
        if k < 0.68:
            text = self.mentioning(self.prose(1, 9) if self.r.random() < 0.85 else self.words(1, 12))
            if self.r.random() < 0.25:
                text = text.replace(" ", f' <a href="/">{self.word()}</a> ', 1)
            if self.r.random() < 0.15:
                text = f"<b>{text}<br>"
            return self.tag("p" if self.r.random() < 0.9 else "div", 1, text, *self.seldom())
        if k < 0.78:
            return self.tag(self.r.choice(["h2", "h3"]), 1, self.mentioning(self.words(1, 7)), *self.seldom())
        if k < 0.88:
            return self.tag(self.r.choice(["ul", "ol"]), 1, "".join(
                self.tag("li", 1, self.prose(1, 2) if self.r.random() < 0.6 else self.words(1, 8))
                for _ in range(self.r.randint(2, 6))))
        if k < 0.94:
            return self.tag("blockquote", 1, self.prose(1, 3))
        if k < 0.97:
            return self.tag("pre", 1, self.words(3, 30))
        rows = "".join(self.tag("tr", 1, "".join(self.tag("td", 1, self.words(1, 4)) for _ in range(3)))
                       for _ in range(self.r.randint(2, 5)))
        return self.tag("table", 1, rows)

    def article(self) -> str:
        title = self.tag("h1", 1, self.mentioning(self.words(2, 10)), *self.seldom()) if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = self.tag("header", 1, title)
        if self.r.random() < 0.25:         # a very short one
            parts = [self.tag("p", 1, self.words(1, 6).capitalize() + "." if self.r.random() < 0.6 else self.prose(1, 2))
                     for _ in range(self.r.randint(1, 2))]
        else:
            parts = [self.paragraph() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 12, 20]))]
        if self.r.random() < 0.25:
            parts.insert(self.r.randint(0, len(parts)), self.small(self.r.choice(["ad", "ad", "share", "notice", "form"])))
        if self.r.random() < 0.1:
            parts.insert(self.r.randint(0, len(parts)), self.side())
        if self.r.random() < 0.12:
            parts.append(self.comments())
        name = self.r.choice(["article", "article", "main", "div", "section"])
        body = "".join(parts)
        if self.r.random() < 0.3:
            body = self.tag("div", 1, body, "content", 0.8)
        return self.tag(name, 1, title + body, "content", 0.4 if name in ("article", "main") else 0.9)

    def bare(self, y: int, body: str) -> str:
        """Text in no block element; the inline element around it or in it only carries the mark."""
        name = self.r.choice(["span", "span", "font", "b", "x-text"])
        return f'<{name} data-y="{y}">{body}</{name}>' if self.r.random() < 0.5 else f'<{name} data-y="{y}"></{name}>{body}'

    def bare_links(self) -> str:
        mark = self.r.choice([" | ", " ", " &middot; "])
        if self.r.random() < 0.3:              # the links' text alone
            return self.r.choice([" | ", " &middot; ", " &raquo; ", " / "]).join(self.words(1, 2) for _ in range(self.r.randint(3, 9)))
        return mark.join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 12)))

    def bare_page(self) -> str:
        """The body of a page whose article, and often other parts too, lie straight in it."""
        alone = self.r.random()
        if alone < 0.15:
            return self.bare(1, self.words(1, 12) if self.r.random() < 0.5 else self.prose(1, 7))
        if alone < 0.22:                       # a menu or a notice and nothing else
            return self.bare(0, self.bare_links() if self.r.random() < 0.5 else self.telling(self.prose(1, 2)))
        parts = []                             # (label of bare text or None, html)
        if self.r.random() < 0.6:
            parts.append(self.r.choice([lambda: (None, self.header()), lambda: (None, self.menu()),
                                        lambda: (0, self.bare(0, self.bare_links()))])())
        if self.r.random() < 0.75:
            parts.append((None, self.tag(self.r.choice(["h1", "h1", "h2"]), 1, self.mentioning(self.words(1, 10)))))
        first, share = len(parts), self.r.choice([0.2, 0.5, 0.8, 1.0])
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 12])):
            if self.r.random() < share:
                runs = [self.prose(1, 9) if self.r.random() < 0.85 else self.words(2, 12)
                        for _ in range(self.r.choice([1, 1, 2, 4]))]
                text = "<br><br>".join(runs)
                if self.r.random() < 0.25:
                    text = text.replace(" ", f' <a href="/">{self.word()}</a> ', 1)
                parts.append((1, self.bare(1, text)))
            else:
                parts.append((None, self.paragraph()))
        if self.r.random() < 0.3:
            parts.insert(self.r.randint(first, len(parts)), (None, self.small(self.r.choice(["ad", "ad", "share", "notice", "form"]))))
        if self.r.random() < 0.2:
            parts.append((None, self.r.choice([self.side, self.comments])()))
        if self.r.random() < 0.7:
            parts.append(self.r.choice([lambda: (None, self.footer()), lambda: (0, self.bare(0, self.bare_links())),
                                        lambda: (0, self.bare(0, f"&copy; {self.words(1, 3)} &middot; {self.words(1, 6)}"))])())
        out, last = "", None
        for y, part in parts:
            if y is not None:                  # a bare run begins after the paragraph, and ends before one of another label
                out += "</p>" if last is None else "<hr>" if last != y else "<br>"
            out, last = out + part, y
        return out

    def page(self) -> str:
        if self.seed % 4 == 3:
            return f"<html><head><title>{self.words(2, 6)}</title></head><body>{self.bare_page()}</body></html>"
        some = lambda p, f: f() if self.r.random() < p else ""
        if self.r.random() < 0.06:             # no article at all
            body = some(0.4, self.menu) + some(0.6, lambda: self.small("notice")) + some(0.3, self.footer) or self.small("notice")
            return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"
        middle = [self.article()]
        if self.r.random() < 0.45:
            middle.insert(self.r.choice([0, 1]), self.side())
        if self.r.random() < 0.3:
            middle.append(self.comments())
        body = "".join(middle)
        for _ in range(self.r.randint(0, 2)):
            body = self.tag(self.r.choice(["div", "div", "section", "main"]), 1, body, "wrap", 0.8)
        body = (some(0.25, lambda: self.small("notice")) + some(0.5, self.header) + some(0.6, self.menu)
                + some(0.4, lambda: self.small("ad")) + some(0.15, lambda: self.small("form")) + body
                + some(0.25, lambda: self.small(self.r.choice(["ad", "share", "notice", "form"]))) + some(0.75, self.footer))
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"
