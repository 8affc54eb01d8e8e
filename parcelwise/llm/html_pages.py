"""Labelled pages for fitting the main-text model: invented words in varied layouts.

Every text is written with a mark before it, ``MAIN`` or ``OTHER``, which the trainer reads and takes out again.
Layouts differ in their elements (semantic or plain), names, order, nesting, missing end tags, and in what surrounds and
interrupts the article: menus, headers, footers, sidebars, notices, adverts, forms, share bars and reader comments.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MAIN, OTHER = "\ue000", "\ue001"
_SYLLABLES = "an ar be con da de el en er est for in ist ka la le ma men mi na ne no on or pa que ra re ro sa se ta te ti to un ur ver wa".split()

#: Names that pages give the parts of a layout.
NAMES = {
    "menu": "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs pagination site-nav tabs skip-links".split(),
    "header": "header masthead site-header banner branding topbar page-header logo".split(),
    "footer": "footer site-footer colophon copyright page-footer bottom legal credits".split(),
    "sidebar": "sidebar aside widget rail secondary related popular trending tags tag-cloud most-read recommended see-also".split(),
    "notice": "notice cookie cookie-banner consent alert gdpr popup modal message paywall toast disclaimer announcement".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adsbox commercial".split(),
    "form": "form search login signup subscribe newsletter contact-form poll survey".split(),
    "share": "share social sharing follow share-buttons tools".split(),
    "comments": "comments comment-list replies respond discussion thread responses feedback reader-comments".split(),
    "article": "article content post entry story main article-body post-content entry-content body-text page-content text hentry".split(),
    "plain": "container wrapper row col inner box page layout grid section block".split(),
}
TAGS = {
    "menu": "nav nav div ul".split(), "header": "header header div".split(), "footer": "footer footer div".split(), "sidebar": "aside aside div section".split(),
    "notice": "div div section dialog aside".split(), "ad": "div div aside section".split(), "form": ["form", "div"], "share": ["div", "ul"],
    "comments": "section div div ol".split(), "article": "article article main div div section".split(), "plain": ["div", "section"],
}
#: How often an element carries a name for its part.
NAMED = {"footer": 0.4, "menu": 0.5, "header": 0.5, "comments": 0.97, "ad": 0.97, "notice": 0.95, "share": 0.95, "sidebar": 0.85, "form": 0.7, "article": 0.6}


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.loose = rng.random() < 0.4  # leaves out end tags where it may
        self.upper = rng.random() < 0.1
        self.gap = rng.choice(["", "", "\n", "\n  "])

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        for i in range(len(out)):
            if i == 0 or out[i - 1].endswith("."):
                out[i] = out[i].capitalize()
            if rng.random() < 0.09 or i == len(out) - 1:
                out[i] += "."
            elif rng.random() < 0.05:
                out[i] += rng.choice([",", "&amp;", " &mdash;", "###", "%", " 12"])
        return " ".join(out)

    def label(self, low: int = 1, high: int = 3) -> str:
        return self.words(low, high).replace(".", "")

    def tag(self, name: str, inside: str, attributes: str = "", open_end: bool = False) -> str:
        name = name.upper() if self.upper else name
        return f"<{name}{attributes}>{inside}" + ("" if open_end and self.loose else f"</{name}>") + self.gap

    def part(self, kind: str, inside: str, tag: str | None = None) -> str:
        rng, attributes = self.rng, ""
        if rng.random() < NAMED.get(kind, 0.6):
            name = rng.choice(NAMES[kind])
            name = name.title().replace("-", "") if rng.random() < 0.1 else name
            extra = f" {rng.choice(NAMES['plain'])}-{rng.randint(1, 9)}" if rng.random() < 0.3 else ""
            attributes = rng.choice([f' class="{name}{extra}"', f' id="{name}"', f" class='{name}{extra}' data-x=\"1\"", f' id={name} class="{name}{extra}"'])
        return self.tag(tag or rng.choice(TAGS[kind]), inside, attributes)

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def links(self, low: int, high: int, wide: int = 3) -> str:
        rng = self.rng
        items = [OTHER + self.label(1, wide) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.7:
            return self.tag("ul", "".join(self.tag("li", self.link(x), open_end=True) for x in items))
        return rng.choice([" | ", " ", "&middot;"]).join(map(self.link, items))

    # What surrounds an article.

    def menu(self) -> str:
        return self.part("menu", self.links(3, 14))

    def header(self) -> str:
        inside = self.tag(self.rng.choice(["h1", "div", "p"]), OTHER + self.label(1, 4))
        return self.part("header", inside + self.rng.choice(["", self.menu(), self.tag("p", OTHER + self.words(3, 9))]))

    def footer(self) -> str:
        rng = self.rng
        inside = rng.choice([OTHER + f"&copy; {self.label()} &middot; " + self.words(2, 30), self.tag("p", OTHER + f"&copy; {rng.randint(1990, 2030)} " + self.words(2, 30))])
        return self.part("footer", rng.choice(["", self.links(2, 8)]) + inside)

    def sidebar(self) -> str:
        rng = self.rng
        boxes = [self.part("sidebar", self.tag(rng.choice(["h3", "h4", "div"]), OTHER + self.label(1, 3)) + rng.choice([self.links(3, 9, 9), self.tag("p", OTHER + self.words(5, 50))])) for _ in range(rng.randint(1, 3))]
        return self.part("sidebar", "".join(boxes))

    def notice(self) -> str:
        inside = self.tag(self.rng.choice(["p", "div"]), OTHER + self.words(4, 40))
        return self.part("notice", inside + self.rng.choice(["", self.tag("button", OTHER + self.label(1, 2))]))

    def advert(self) -> str:
        text = OTHER + self.words(2, 40)
        return self.part("ad", self.rng.choice([text, self.tag("p", text), self.link(text)]))

    def form(self) -> str:
        rng = self.rng
        fields = "".join(self.tag("label", OTHER + self.label(1, 2)) + '<input type="text">' for _ in range(rng.randint(1, 4)))
        return self.part("form", rng.choice(["", self.tag("p", OTHER + self.words(4, 20))]) + fields + self.tag("button", OTHER + self.label(1, 1)), rng.choice(["form", "form", "div"]))

    def share(self) -> str:
        return self.part("share", self.links(2, 5, 1))

    def comments(self) -> str:
        rng = self.rng

        def one() -> str:
            head = self.tag(rng.choice(["div", "header", "p", "h4"]), OTHER + self.label(1, 2) + rng.choice(["", f" {rng.randint(1, 28)}.{rng.randint(1, 12)}.2020"]))
            body = "".join(self.tag("p", OTHER + self.words(2, 80), open_end=True) for _ in range(rng.randint(1, 3)))
            return self.part("comments", head + body + rng.choice(["", self.link(OTHER + "Reply")]), rng.choice(["div", "li", "article"]))

        return self.part("comments", self.tag(rng.choice(["h2", "h3"]), OTHER + f"{rng.randint(1, 40)} " + self.label(1, 2)) + "".join(one() for _ in range(rng.randint(1, 8))))

    # The article itself.

    def block(self) -> str:
        rng, kind = self.rng, self.rng.random()
        if kind < 0.72:
            text = MAIN + self.words(1, rng.choice([4, 15, 30, 120]))
            if rng.random() < 0.2:
                text += " " + self.link(self.label()) + " " + self.words(1, 12)
            if rng.random() < 0.15:
                text = f"<b>{text}" + rng.choice(["</b>", "<br>"])
            return self.tag("p", text, open_end=True)
        if kind < 0.8:
            return self.tag(rng.choice(["h2", "h3"]), MAIN + self.label(1, 7))
        if kind < 0.87:
            return self.tag(rng.choice(["ul", "ol"]), "".join(self.tag("li", MAIN + self.words(1, 15), open_end=True) for _ in range(rng.randint(2, 8))))
        if kind < 0.91:
            return self.tag("blockquote", self.tag("p", MAIN + self.words(5, 40)))
        if kind < 0.94:
            cells = lambda: "".join(self.tag("td", MAIN + self.label(1, 2), open_end=True) for _ in range(3))
            return self.tag("table", "".join(self.tag("tr", cells(), open_end=True) for _ in range(rng.randint(2, 5))))
        if kind < 0.97:
            return self.tag("figure", '<img src="x.png">' + self.tag("figcaption", MAIN + self.words(2, 12)))
        return self.tag("pre", MAIN + self.words(5, 30))

    def article(self) -> str:
        rng = self.rng
        title = self.tag("h1", MAIN + self.label(1, 10))
        title = self.tag("header", title) if rng.random() < 0.15 else title
        blocks = [self.block() for _ in range(rng.choice([1, 1, 1, 2, 3, 5, 8, 20]))]
        while rng.random() < 0.35:
            blocks.insert(rng.randint(0, len(blocks)), rng.choice([self.advert, self.share, self.form, self.notice, self.sidebar])())
        inside = "".join(blocks)
        if rng.random() < 0.3:
            return title + self.part("article", inside)
        if rng.random() < 0.3:
            inside = self.part(rng.choice(["article", "plain"]), inside)
        if rng.random() < 0.1:
            inside += self.comments()
        return self.part("article", title + inside)

    def page(self) -> str:
        rng = self.rng
        plain = rng.random() < 0.3  # little more than the article, often a short one
        some = lambda *made: "".join(make() for make in made if rng.random() < (0.9 if make in (self.menu, self.footer) else 0.1 if plain else 0.45))
        middle = [self.article, *(m for m in (self.sidebar, self.comments, self.advert, self.form) if rng.random() < (0.05 if plain else 0.4))]
        if rng.random() < 0.3:
            rng.shuffle(middle)
        inside = "".join(make() for make in middle)
        for _ in range(rng.randint(0, 3)):
            inside = self.part("plain", inside)
        body = some(self.notice, self.header, self.menu, self.form) + "<!-- x -->" + some(self.advert) + inside + some(self.share, self.comments, self.notice, self.footer)
        end = "" if rng.random() < 0.1 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.label()}</title><style>p{{margin:0}}</style></head><body><script>var t='</p>';</script>{body}{end}"


def labelled_pages(count: int, seed: int) -> Iterator[str]:
    """``count`` pages with marked texts."""
    rng = random.Random(seed)
    for _ in range(count):
        yield _Writer(rng).page()
