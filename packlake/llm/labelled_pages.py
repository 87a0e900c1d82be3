"""Labelled pages that the extraction model is trained on.

Pages are composed at random from parts that web pages have: an article in one of several
shapes, and around or within it menus, headers, footers, sidebars, notices, adverts, forms
and reader comments under their usual names. An element's data-y says whether its text is
content (1) or not (0); elements without one inherit it. Words are random letters, so the
model can learn from structure only.
"""

from __future__ import annotations

import random

_MENU = "nav menu navbar navigation breadcrumb breadcrumbs topnav toolbar links pagination pager tabs sitemap toc skip share social tags".split()
_HEAD = "header masthead topbar top banner logo branding site hero".split()
_FOOT = "footer foot copyright colophon bottom legal imprint credits".split()
_SIDE = "sidebar aside side rail related recommended popular trending widget widgets more secondary complementary teaser archive author bio".split()
_NOTE = "cookie cookies consent notice alert popup modal overlay gdpr privacy subscribe newsletter paywall message toast warning banner hidden".split()
_AD = "ad ads advert advertisement advertising adsbox sponsor sponsored promo promotion banner commercial partner outbrain taboola dfp".split()
_FORM = "form search login signup newsletter contact feedback".split()
_COMMENT = "comment comments commentlist reply replies respond discussion disqus thread reader responses".split()
_MAIN = "content main article post entry story body text page article-body post-content entry-content story-body maincontent".split()
_PLAIN = "container wrapper row col inner block box wrap grid outer module layout clearfix".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices("etaoinshrdlucmfwypvbgkéüñ", k=self.r.randint(1, 11)))

    def words(self, lo: int, hi: int, stop: bool = True) -> str:
        w = [self.word() for _ in range(self.r.randint(lo, hi))]
        w = [x + "," if self.r.random() < 0.08 else x for x in w]
        if self.r.random() < 0.06:
            w = [x + self.r.choice(("###", "&amp;&amp;&amp;", "!!", " |", "%%%")) for x in w]
        return " ".join(w).capitalize() + ("." if stop and self.r.random() < 0.9 else "")

    def sentence(self) -> str:
        """Any length: short paragraphs are content as well."""
        r = self.r.random()
        return self.words(1, 3) if r < 0.2 else self.words(4, 12) if r < 0.5 else self.words(12, 60)

    def name(self, names: list[str]) -> str:
        k = self.r.random()
        n = self.r.choice(names)
        if k < 0.15:
            n = f"{n}-{self.r.choice(_PLAIN)}"
        elif k < 0.25:
            n = f"site-{n}"
        return f' {self.r.choice(("class", "class", "id"))}="{n}"'

    def plain(self) -> str:
        return f' class="{self.r.choice(_PLAIN)}"' if self.r.random() < 0.5 else ""

    def link(self, text: str | None = None) -> str:
        return f'<a href="/{self.word()}">{text or self.words(1, 4, False)}</a>'

    # parts that are not content

    def link_list(self) -> str:
        tag = self.r.choice(("ul", "ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{self.link()}" + self.r.choice(("</li>", "</li>", "")) for _ in range(self.r.randint(2, 9))) + f"</{tag}>"

    def menu(self) -> str:
        inner = self.link_list() if self.r.random() < 0.7 else " ".join(self.link() for _ in range(self.r.randint(2, 8)))
        if self.r.random() < 0.6:
            return f'<nav data-y="0"{self.name(_MENU) if self.r.random() < 0.5 else ""}>{inner}</nav>'
        return f'<{self.r.choice(("div", "div", "ul"))} data-y="0"{self.name(_MENU)}>{inner}</div>'

    def loose(self) -> str:
        """Paragraphs, headings and links of any length, as boilerplate has them too."""
        out = []
        for _ in range(self.r.randint(1, 3)):
            k = self.r.random()
            if k < 0.45:
                out.append(f"<p>{self.sentence()}</p>")
            elif k < 0.6:
                out.append(f"<h{self.r.choice('2346')}>{self.words(1, 5, False)}</h3>")
            elif k < 0.75:
                out.append(self.link_list())
            elif k < 0.85:
                out.append(f"<div{self.plain()}>{self.sentence()}</div>")
            else:
                out.append(self.sentence())
        return "".join(out)

    def header(self) -> str:
        inner = self.r.choice((self.link, self.loose, self.menu, lambda: f"<h1>{self.words(1, 4, False)}</h1>"))()
        if self.r.random() < 0.6:
            return f'<header data-y="0"{self.name(_HEAD) if self.r.random() < 0.4 else ""}>{inner}{self.menu() if self.r.random() < 0.5 else ""}</header>'
        return f'<div data-y="0"{self.name(_HEAD)}>{inner}</div>'

    def footer(self) -> str:
        inner = self.r.choice((f"&copy; {self.word()} &middot; {self.sentence()}", self.loose(), self.link_list()))
        if self.r.random() < 0.7:
            return f'<footer data-y="0"{self.name(_FOOT) if self.r.random() < 0.4 else ""}>{inner}</footer>'
        return f'<div data-y="0"{self.name(_FOOT)}>{inner}</div>'

    def side(self) -> str:
        if self.r.random() < 0.6:
            return f'<aside data-y="0"{self.name(_SIDE) if self.r.random() < 0.5 else ""}>{self.loose()}</aside>'
        return f'<{self.r.choice(("div", "section"))} data-y="0"{self.name(_SIDE)}>{self.loose()}</div>'

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "p", "ins"))
        inner = self.sentence() if tag in ("p", "ins") or self.r.random() < 0.6 else self.loose()
        return f'<{tag} data-y="0"{self.name(_AD)}>{inner}</{tag}>' if tag != "ins" else f'<div data-y="0"{self.name(_AD)}>{inner}</div>'

    def notice(self) -> str:
        role = self.r.choice(("", "", ' role="dialog"', ' role="alert"'))
        tag = self.r.choice(("div", "div", "section", "p", "dialog"))
        inner = self.sentence() if tag == "p" or self.r.random() < 0.5 else self.loose() + "<button>" + self.words(1, 2, False) + "</button>"
        return f'<{tag} data-y="0"{self.name(_NOTE)}{role}>{inner}</{tag}>'

    def form(self) -> str:
        inner = self.r.choice((
            f"<label>{self.words(1, 3, False)}</label><input name=q><button>{self.words(1, 2, False)}</button>",
            f"<p>{self.sentence()}</p><input type=email><button>{self.words(1, 2, False)}</button>",
            f"<fieldset><legend>{self.words(1, 3, False)}</legend><label>{self.words(1, 3, False)} <input></label></fieldset>",
        ))
        if self.r.random() < 0.75:
            return f'<form data-y="0"{self.name(_FORM) if self.r.random() < 0.4 else ""}>{inner}</form>'
        return f'<div data-y="0"{self.name(_FORM)}><form>{inner}</form></div>'

    def comment(self) -> str:
        body = "".join(f"<p>{self.sentence()}</p>" for _ in range(self.r.randint(1, 3)))
        by = self.r.choice((f"<div class=meta>{self.link()}</div>", f"<cite>{self.word()}</cite>", f"<h4>{self.word()}</h4>", ""))
        return by + (body if self.r.random() < 0.7 else self.sentence())

    def comments(self) -> str:
        tag, item = self.r.choice((("section", "article"), ("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "p")))
        title = f"<h3>{self.words(1, 3, False)}</h3>" if tag not in ("ol", "ul") else ""
        each = "".join(
            f"<{item}{self.name(_COMMENT) if self.r.random() < 0.6 else ''}>{self.sentence() if item == 'p' else self.comment()}</{item}>"
            for _ in range(self.r.randint(1, 5))
        )
        return f'<{tag} data-y="0"{self.name(_COMMENT)}>{title}{each}</{tag}>'

    # the article

    def paragraph(self) -> str:
        s = self.sentence()
        k = self.r.random()
        if k < 0.1:
            s = f"<b>{s}<br>"
            return f"<p>{s}"
        if k < 0.3:
            w = s.split(" ")
            at = self.r.randrange(len(w))
            w[at] = self.r.choice((self.link(w[at]), f"<em>{w[at]}</em>", f"<strong>{w[at]}</strong>", f"<code>{w[at]}</code>"))
            s = " ".join(w)
        return f"<p>{s}" + ("</p>" if self.r.random() < 0.93 else "")

    def rich(self) -> str:
        k = self.r.random()
        if k < 0.3:
            return f"<h{self.r.choice('234')}>{self.words(1, 8, False)}</h2>".replace("</h2>", "</h2>")
        if k < 0.5:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if k < 0.65:
            return f"<blockquote>{self.r.choice((self.sentence(), self.paragraph()))}</blockquote>"
        if k < 0.75:
            return f"<figure><img src=x.png><figcaption>{self.sentence()}</figcaption></figure>"
        if k < 0.85:
            return self.table()
        if k < 0.92:
            return f"<pre>{self.words(3, 20, False)}</pre>"
        return f"<div{self.plain()}>{self.sentence()}</div>"

    def table(self) -> str:
        wide, cell = self.r.randint(2, 4), self.r.choice((lambda: self.words(1, 4, False), self.sentence))
        head = "<tr>" + "".join(f"<th>{self.words(1, 3, False)}</th>" for _ in range(wide)) + "</tr>"
        rows = "".join("<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(wide)) + "</tr>" for _ in range(self.r.randint(1, 4)))
        k = self.r.random()
        if k < 0.3:
            return f"<table><thead>{head}</thead><tbody>{rows}</tbody></table>"
        return f"<table>{head if k < 0.7 else ''}{rows}</table>"

    def body(self) -> str:
        out = [f"<h1>{self.words(1, 12)}</h1>"] if self.r.random() < 0.9 else []
        if self.r.random() < 0.15:
            out = [f'<header data-y="1">{"".join(out)}</header>']
        noisy = self.r.random() < 0.5
        for _ in range(self.r.randint(1, 14)):
            out.append(self.paragraph() if self.r.random() < 0.82 else self.rich())
            if noisy and self.r.random() < 0.12:
                out.append(self.r.choice((self.advert, self.side, self.notice, self.form, self.menu, self.advert))())
        if noisy and self.r.random() < 0.2:
            out.append(self.r.choice((self.comments, self.footer, self.menu))())
        return "".join(out)

    def article(self) -> str:
        k, inner = self.r.random(), self.body()
        if k < 0.45:
            return f'<article data-y="1"{self.name(_MAIN) if self.r.random() < 0.3 else ""}>{inner}</article>'
        if k < 0.6:
            return f'<main data-y="1">{inner}</main>'
        if k < 0.7:
            return f'<main data-y="1"><article>{inner}</article></main>'
        if k < 0.9:
            tag = self.r.choice(("div", "div", "section"))
            return f'<{tag} data-y="1"{self.name(_MAIN)}>{inner}</{tag}>'
        return f'<div data-y="1"{self.plain()}>{inner}</div>'

    def page(self) -> str:
        before, after = [], []
        for make, share, where in (
            (self.notice, 0.3, before), (self.header, 0.5, before), (self.menu, 0.7, before), (self.advert, 0.5, before),
            (self.form, 0.2, before), (self.side, 0.15, before), (self.comments, 0.4, after), (self.side, 0.4, after),
            (self.advert, 0.25, after), (self.form, 0.2, after), (self.notice, 0.2, after), (self.footer, 0.75, after),
        ):
            if self.r.random() < share:
                where.append(make())
        middle = self.article()
        if self.r.random() < 0.35:
            cut = self.r.randint(0, len(before)), self.r.randint(0, len(after))
            wrap = self.r.choice(("div", "div", "section", "main"))
            inner = "".join(before[cut[0] :]) + middle + "".join(after[: cut[1]])
            middle, before, after = f"<{wrap}{self.plain()}>{inner}</{wrap}>", before[: cut[0]], after[cut[1] :]
        if self.r.random() < 0.15:  # a bare link, as those that skip the menus
            name = self.name(_MAIN) if self.r.random() < 0.5 else ""
            return f"<html><body data-y=\"0\"{name}>{self.link()}{''.join(before)}{middle}{''.join(after)}</body></html>"
        return f"<html><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def labelled_pages(n: int = 400, seed: int = 3) -> list[str]:
    """n labelled pages; the same for the same arguments."""
    return [_Writer(1_000_003 * seed + k).page() for k in range(n)]
