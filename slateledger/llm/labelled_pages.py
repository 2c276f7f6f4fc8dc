"""Labelled web pages to learn from: invented text in many layouts, every block of main text marked.

The given tables hold no labels for pages, so the pages are made by a rule with a seed: which parts a page has,
what elements and class names they use, and in which order they come, is drawn at random; words are drawn from
syllables. A part that isn't main text may lie within the article, and a part's names may say nothing.
"""

from __future__ import annotations

import random

#: A private-use character before the text of every main block.
MAIN = "\ue000"

#: Class names and ids that pages commonly give to a part.
NAMES = {
    "main": "content article post entry main story text body article-body post-content entry-content main-content page-content story-body primary prose blog-post".split(),
    "menu": "nav menu navbar navigation breadcrumbs breadcrumb topnav main-menu tabs pagination pager toc links".split(),
    "header": "header masthead site-header top branding logo page-header topbar".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot page-footer".split(),
    "side": "sidebar side aside widget related recommended popular trending more-stories rail secondary teaser tags".split(),
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert popup modal message announcement paywall disclaimer warning overlay privacy".split(),
    "ad": "ad ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense ad-slot adbox partner".split(),
    "form": "form newsletter subscribe signup search login contact-form subscription register".split(),
    "comments": "comments comment-list commentlist responses discussion reader-comments feedback disqus thread".split(),
    "comment": "comment reply response comment-body comment-text message".split(),
    "share": "share social sharing follow tools".split(),
}
CUES = {
    "menu": "Home|About us|Contact|News|Archive|Next|Previous|Sign in|Menu|Search|Shop|Blog".split("|"),
    "side": "Related|Popular now|Read more|Tags|Most read|Follow us|Recent posts".split("|"),
    "notice": "We use cookies|By continuing you accept our terms|Please accept our privacy policy|This site is under maintenance|Your consent".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Promoted".split("|"),
    "form": "Subscribe to our newsletter|Your e-mail|Password|Search|Log in|Sign up|Name".split("|"),
    "comments": "Comments|3 comments|Leave a reply|Discussion|What readers say".split("|"),
    "share": "Share|Tweet|Print|E-mail this|Like".split("|"),
}
SYLLABLES = "an en er in on re ti es or te st ed nd to at al le ar it de la ra se el ne ta ve is ou me co ro li ma si pa di ch sch ein ung ión ado é ère ü ß ñ ç que".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        w = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(least, most))]
        if self.r.random() < 0.06:
            w[self.r.randrange(len(w))] = self.r.choice(["12", "2019", "&amp;", "***", "%%%", "http://example.com/a", "a@example.com", "&lt;x&gt;", "+1 555 0100", self.r.choice(CUES[self.r.choice(sorted(CUES))])])
        return " ".join(w).capitalize() + self.r.choice(("....", ".", ".", ".", ".", "!", "?")) if w else ""

    def paragraph(self) -> str:
        if self.r.random() < 0.15:
            return self.sentence(1, 4)
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, 7)))
        k = self.r.random()
        if k < 0.15:
            w = text.split(" ")
            a = self.r.randrange(len(w))
            w[a] = f"<{self.r.choice(('b', 'i', 'em', 'strong', 'code', 'span'))}>{w[a]}</b>" if self.r.random() < 0.2 else f'<a href="/{a}">{w[a]}</a>'
            text = " ".join(w)
        elif k < 0.2:
            text = text.replace(". ", ".<br>", 1)
        return text

    def short(self, kind: str) -> str:
        return self.r.choice(CUES[kind]) if kind in CUES and self.r.random() < 0.5 else " ".join(self.word().capitalize() for _ in range(self.r.randint(1, 4)))

    def attrs(self, kind: str, plain: float = 0.1) -> str:
        if self.r.random() < plain:
            return self.r.choice(("", "", f' class="c{self.r.randrange(99)}"', f' class="{self.r.choice(("box", "wrap", "row", "col", "inner", "block"))}"'))
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.25:
            name = "".join(p.capitalize() if k else p for k, p in enumerate(name.split("-")))
        extra = f" {self.r.choice(('box', 'wrap', 'clearfix', 'col-3', 'large'))}" if self.r.random() < 0.3 else ""
        return f' {self.r.choice(("class", "class", "id"))}="{name}{extra}"'

    def links(self, kind: str, most: int = 8) -> str:
        items = [f'<li><a href="/{k}">{self.short(kind)}</a></li>' for k in range(self.r.randint(2, most))]
        if self.r.random() < 0.3:
            return " ".join(x[4:-5] for x in items)
        return f"<ul>{''.join(items)}</ul>"

    def menu(self) -> str:
        if self.r.random() < 0.5:
            return f"<nav{self.attrs('menu', 0.6)}>{self.links('menu', 9)}</nav>"
        return f"<div{self.attrs('menu', 0.1)}>{self.links('menu', 9)}</div>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        title = self.r.choice(("h1", "div", "p", "span", "a"))
        inner = f"<{title}>{self.short('header')}</{title}>" + (f"<p>{self.sentence(2, 8)}</p>" if self.r.random() < 0.5 else "") + (self.menu() if self.r.random() < 0.4 else "")
        return f"<{tag}{self.attrs('header', 0.6 if tag == 'header' else 0.05)}>{inner}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        inner = self.r.choice(("&copy; ", "Copyright 2020 ", "")) + f"{self.word()}.example.com" + self.r.choice((" &middot; ", " | ", "<br>")) + (self.sentence() if self.r.random() < 0.6 else self.short("menu"))
        if self.r.random() < 0.4:
            inner = f"<p>{inner}</p>"
        return f"<{tag}{self.attrs('footer', 0.6 if tag == 'footer' else 0.05)}>{inner}{self.links('menu', 5) if self.r.random() < 0.4 else ''}</{tag}>"

    def aside(self, kind: str) -> str:
        """An advert, a notice or a box beside the article: links or sentences, with or without a heading."""
        tag = self.r.choice(("div", "div", "aside", "section", "p")) if kind != "side" else self.r.choice(("aside", "aside", "div", "section"))
        body = self.r.choice((self.links(kind, 5), self.sentence(), f"<p>{self.sentence()}</p>", f"<p>{self.paragraph()}</p>", f'<a href="/x">{self.sentence(2, 8)}</a>', f"<p>{self.sentence()}</p><p>{self.sentence()}</p>"))
        if tag == "p":
            body = self.sentence()
        head = f"<{h}>{self.short(kind)}</{h}>" if tag != "p" and self.r.random() < 0.5 and (h := self.r.choice(("h2", "h3", "h4", "strong", "div"))) else ""
        plain = 0.5 if tag == "aside" else 0.0 if kind in ("ad", "notice") else 0.05
        hidden = self.r.choice((' style="display:none"', " hidden")) if kind == "notice" and self.r.random() < 0.15 else ""
        role = ' role="complementary"' if kind == "side" and self.r.random() < 0.1 else ' role="alert"' if kind == "notice" and self.r.random() < 0.1 else ""
        return f"<{tag}{self.attrs(kind, plain)}{hidden}{role}>{head}{body}</{tag}>"

    def form(self) -> str:
        tag = self.r.choice(("form", "form", "div", "section"))
        label = self.r.choice(("label", "p", "div", "h3"))
        rows = "".join(f"<{label}>{self.short('form')}{' ' + self.sentence(2, 9) if self.r.random() < 0.4 else ''}</{label}><input name=a>" for _ in range(self.r.randint(1, 3)))
        inner = f"{rows}<button>Send</button>"
        return f"<{tag}{self.attrs('form', 0.6 if tag == 'form' else 0.0)}>{inner if tag == 'form' else f'<form>{inner}</form>'}</{tag}>"

    def comments(self) -> str:
        out = f"<h{k}>{self.short('comments')}</h{k}>" if self.r.random() < 0.7 and (k := self.r.randint(2, 4)) else ""
        tag = self.r.choice(("div", "li", "article", "section", "p", "div"))
        named = self.r.random() < 0.8
        for _ in range(self.r.randint(1, 6)):
            who = self.r.choice((f"<b>{self.short('x')}</b>: ", f'<span class="author">{self.short("x")}</span> ', ""))
            if tag != "p" and self.r.random() < 0.4:
                who = f'<div class="{self.r.choice(("author", "meta", "user", "byline", "date"))}">{self.short("x")} {self.r.choice(("said", "wrote", "3 days ago", "at 12:30"))}</div>'
            text = self.paragraph()
            text = f"<p>{text}</p>" if tag != "p" and self.r.random() < 0.7 else text
            out += f"<{tag}{self.attrs('comment', 0.0) if named else ''}>{who}{text}</{tag}>"
        out = f"<ol>{out}</ol>" if tag == "li" else out
        outer = self.r.choice(("div", "section", "aside"))
        return f"<{outer}{self.attrs('comments', 0.0 if not named else 0.15)}>{out}{self.form() if self.r.random() < 0.3 else ''}</{outer}>"

    def share(self) -> str:
        return f"<div{self.attrs('share', 0.0)}>{self.links('share', 5)}</div>"

    def intruder(self) -> str:
        """What may stand within the article without being part of it."""
        k = self.r.random()
        if k < 0.35:
            return self.aside("ad")
        if k < 0.5:
            return self.aside("notice")
        if k < 0.65:
            return self.aside("side")
        return self.r.choice((self.share, self.form, self.menu))()

    def main(self, tag: str, text: str) -> str:
        return f"<{tag}>{MAIN}{text}</{tag}>" if tag != "p" or self.r.random() > 0.04 else f"<p><b>{MAIN}{text}<br>"

    def article(self) -> str:
        out = []
        if self.r.random() < 0.85:
            title = self.main(self.r.choice(("h1", "h1", "h1", "h2")), self.sentence(1, 12).rstrip(".") if self.r.random() < 0.7 else self.sentence())
            out.append(f"<header>{title}</header>" if self.r.random() < 0.1 else title)
        for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14))):
            k = self.r.random()
            if k < 0.8:
                out.append(self.main("p" if self.r.random() < 0.93 else "div", self.paragraph()))
            elif k < 0.86:
                out.append(self.main(self.r.choice(("h2", "h3", "h4")), self.sentence(1, 7).rstrip(".!?")))
            elif k < 0.91:
                out.append(f"<{(t := self.r.choice(('ul', 'ol')))}>" + "".join(self.main("li", self.sentence(1, 12)) for _ in range(self.r.randint(2, 6))) + f"</{t}>")
            elif k < 0.94:
                q = self.paragraph()
                out.append(f"<blockquote>{self.main('p', q)}</blockquote>" if self.r.random() < 0.6 else self.main("blockquote", q))
            elif k < 0.955:
                out.append(f'<figure><img src="a.png">{self.main("figcaption", self.sentence())}</figure>')
            elif k < 0.97:
                out.append(self.main("pre", self.paragraph()))
            elif k < 0.985:
                out.append("<table>" + "".join("<tr>" + "".join(self.main("td", self.short("x")) for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            else:
                out.append("<dl>" + "".join(self.main("dt", self.short("x")) + self.main("dd", self.sentence()) for _ in range(2)) + "</dl>")
            if self.r.random() < 0.35:
                out.append(self.intruder())
            if self.r.random() < 0.03:
                out.append(f'<script>var a="<p>{self.word()}</p>";</script>')
        inner = "".join(out)
        k = self.r.random()
        if k < 0.45:
            inner = f"<article{self.attrs('main', 0.6)}>{inner}</article>"
        elif k < 0.6:
            inner = f"<main{self.attrs('main', 0.6)}>{inner}</main>"
        elif k < 0.68:
            inner = f"<main><article>{inner}</article></main>"
        elif k < 0.92:
            inner = f"<{(t := self.r.choice(('div', 'div', 'section', 'td')))}{self.attrs('main', 0.15)}>{inner}</{t}>"
            inner = f"<table><tr>{inner}</tr></table>" if inner.startswith("<td") else inner
        if self.r.random() < 0.3:
            inner = f'<div{self.r.choice(("", self.attrs("main", 0.3), " class=wrapper"))}>{inner}</div>'
        return inner

    def page(self) -> str:
        r = self.r
        some = lambda p, f, *a: f(*a) if r.random() < p else ""
        before = [some(0.4, self.header), some(0.7, self.menu), some(0.3, self.aside, "notice"), some(0.35, self.aside, "ad"), some(0.15, self.form), some(0.15, self.aside, "side")]
        after = [some(0.3, self.share), some(0.35, self.aside, "side"), some(0.4, self.comments), some(0.2, self.aside, "ad"), some(0.2, self.form), some(0.15, self.aside, "notice"), some(0.15, self.menu)]
        r.shuffle(before)
        r.shuffle(after)
        inner = "".join(before) + self.article() + "".join(after) + some(0.75, self.footer) + some(0.1, self.aside, "notice")
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.short("x")}</title><style>p{{margin:0}}</style></head>'
        return f"{head}<body{some(0.2, self.attrs, 'main')}><!-- {self.word()} -->{inner}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
