"""Made-up labelled pages that the block labeller learns from.

Pages differ in their layout (semantic tags or plain divs with telling names),
in what surrounds the article, in what interrupts it, and in their words, which
are random syllables but for the usual vocabulary of menus, notices and forms.
"""

from __future__ import annotations

import random

_USUAL = {
    "menu": "home about contact news blog products services login sign in register search archive categories tags help faq privacy terms".split(),
    "notice": "we use cookies to improve your experience accept all decline settings privacy policy consent this site uses cookies agree".split(),
    "advert": "advertisement sponsored buy now limited offer sale discount shop promo deal free shipping click here".split(),
    "sidebar": "related posts recent articles popular trending most read tags archives follow us newsletter you may also like".split(),
    "footer": "copyright all rights reserved terms of use privacy policy contact imprint powered by sitemap".split(),
    "form": "subscribe email name submit send password enter your address search sign up newsletter message".split(),
    "comment": "reply posted by says comments thanks great post agree leave a comment anonymous user ago report share like".split(),
}
_NAMES = {
    "menu": ["nav", "menu", "navbar", "breadcrumbs", "topnav", "navigation"],
    "header": ["header", "site-header", "masthead", "logo", "branding", "top"],
    "notice": ["cookie", "cookie-notice", "banner", "alert", "consent", "notice", "gdpr", "notification", "popup"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner-ad", "advertisement"],
    "sidebar": ["sidebar", "widget", "related", "aside", "side", "recommended", "share", "social"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "colophon"],
    "form": ["form", "newsletter", "subscribe", "search", "signup", "login"],
    "comment": ["comments", "comment", "comment-list", "replies", "discussion", "reader-comments", "responses"],
}
_MAIN = ["content", "post", "entry-content", "article-body", "story", "post-content", "main", "text", "article"]
_SYLLABLES = [a + b for a in "b c d f g h l m n p r s t v w th sh ch tr st é ö ñ".split() for b in "a e i o u en an er in on".split()]


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(60)]

    def prose(self, low: int, high: int) -> str:
        words = self.r.choices(self.words, k=self.r.randint(low, high))
        words[0] = words[0].capitalize()
        if self.r.random() < 0.15:  # quotations, brackets, numbers, links between words
            words = [self.r.choice(["{}", "{},", "&quot;{}&quot;", "({})", "{} &amp;", "{}/{}", "{} 12", "{};", "&#8211; {}"]).replace("{}", w) if self.r.random() < 0.4 else w for w in words]
        return " ".join(words) + self.r.choice([".", ".", "", "!"])

    def talk(self, kind: str, low: int, high: int) -> str:
        usual = _USUAL.get(kind, _USUAL["menu"])
        share = self.r.choice([0.0, 0.3, 0.7, 1.0])
        return " ".join(self.r.choice(usual) if self.r.random() < share else self.r.choice(self.words) for _ in range(self.r.randint(low, high)))

    def named(self, kind: str, semantic: str, inner: str) -> str:
        name = self.r.choice(_NAMES[kind])
        attribute = self.r.choice(["class", "id"])
        if semantic and self.r.random() < 0.5:
            return f"<{semantic}>{inner}</{semantic}>" if self.r.random() < 0.6 else f'<{semantic} {attribute}="{name}">{inner}</{semantic}>'
        return f'<{self.r.choice(["div", "div", "section"])} {attribute}="{name}">{inner}</div>'

    def junk(self, kind: str) -> str:
        r = self.r
        link = lambda: f'<a href="/{r.choice(self.words)}">{self.talk(kind, 1, 3)}</a>'
        items = lambda n: "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, n)))
        if kind == "menu":
            return self.named(kind, "nav", f"<ul>{items(8)}</ul>" if r.random() < 0.7 else r.choice([" ", " | ", "<br>", " &middot; "]).join(link() for _ in range(r.randint(2, 6))))
        if kind == "share":
            return self.named("sidebar", "", " ".join(link() for _ in range(r.randint(1, 4))))
        if kind == "header":
            return self.named(kind, "header", r.choice([f"<h1>{self.prose(1, 4)}</h1>", f"<a href='/'>{self.prose(1, 3)}</a>", f"<p>{self.prose(2, 8)}</p>"]))
        if kind == "sidebar":
            return self.named(kind, "aside", r.choice([f"<h3>{self.talk(kind, 1, 4)}</h3><ul>{items(6)}</ul>", f"<p>{self.prose(3, 25)}</p>", f"<h2>{self.prose(2, 5)}</h2><p>{self.prose(4, 20)}</p>"]))
        if kind == "footer":
            return self.named(kind, "footer", r.choice([f"&copy; {self.prose(1, 3)} &middot; {self.prose(3, 14)}", f"<p>{self.talk(kind, 3, 12)}</p>", f"<ul>{items(5)}</ul><p>{self.talk(kind, 3, 9)}</p>"]))
        if kind == "form":
            return self.named(kind, "form", f"<label>{self.talk(kind, 1, 4)}</label><input name='x'>" + (f"<p>{self.talk(kind, 3, 12)}</p>" if r.random() < 0.5 else "") + f"<button>{self.talk(kind, 1, 2)}</button>")
        if kind == "comment":
            one = lambda: r.choice([f'<div class="comment"><p>{self.prose(4, 40)}</p></div>', f'<li class="comment"><b>{self.prose(1, 2)}</b><p>{self.prose(4, 30)}</p></li>', f"<p>{self.prose(4, 40)}</p>", f"<article><p>{self.prose(4, 30)}</p></article>"])
            return self.named(kind, "section" if r.random() < 0.2 else "", f"<h3>{self.talk(kind, 1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))
        return self.named(kind, "", r.choice([self.prose(3, 20), f"<p>{self.prose(3, 20)}</p>", f"<p>{self.talk(kind, 3, 14)}</p><a href='#'>{self.talk(kind, 1, 2)}</a>"]))

    def article(self) -> tuple[str, list[bool]]:
        """Parts of the article with a mark that they're main text, as html with \x01 before main text."""
        r = self.r
        main = "\x01"
        parts = [f"<h1>{main}{self.prose(2, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(min(60, 1 + int(r.expovariate(0.15)))):
            x = r.random()
            if x < 0.62:
                text = self.prose(1, 60)
                if r.random() < 0.2:
                    text = f"<b>{text}</b> {self.prose(1, 8)}"
                if r.random() < 0.15:
                    text += f" <a href='/x'>{self.prose(1, 3)}</a>"
                parts.append(f"<p>{main}{text}</p>")
            elif x < 0.72:  # line breaks instead of paragraphs, elements that nobody closed
                tag = r.choice(["b", "i", "strong", "em", "span", "font"])
                parts.append(r.choice([f"<p>{main}{self.prose(1, 40)}", f"<p><{tag}>{main}{self.prose(1, 40)}</p>", f"<p>{main}<{tag}>{self.prose(1, 30)}<br>{self.prose(1, 20)}", f"<div>{main}{self.prose(2, 30)}<br><br>{self.prose(2, 30)}</div>"]))
            elif x < 0.78:
                parts.append(f"<h{r.randint(2, 4)}>{main}{self.prose(1, 8)}</h2>")
            elif x < 0.83:
                parts.append("<ul>" + "".join(f"<li>{main}{self.prose(1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.86:
                parts.append(f"<blockquote>{main}{self.prose(3, 30)}</blockquote>")
            elif x < 0.88:
                parts.append("<table>" + "".join(f"<tr><td>{main}{self.prose(1, 4)}</td><td>{main}{self.prose(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.89:
                parts.append(f"<pre>{main}{self.prose(3, 20)}</pre>")
            elif x < 0.94:
                parts.append(self.junk(r.choice(["advert", "advert", "share", "share", "sidebar", "form", "notice", "comment", "menu"])))
            else:
                parts.append(f"<div>{main}{self.prose(3, 40)}</div>")
        return "".join(parts)

    def make(self) -> str:
        r = self.r
        body = self.article()
        wrap = r.random()
        if wrap < 0.45:
            body = f"<article>{body}</article>"
        elif wrap < 0.6:
            body = f"<main>{body}</main>"
        elif wrap < 0.68:
            body = f'<main><article class="{r.choice(_MAIN)}">{body}</article></main>'
        elif wrap < 0.8:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(_MAIN)}">{body}</div>'
        elif wrap < 0.93:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(_MAIN)}"><div class="{r.choice(_MAIN)}">{body}</div></div>'
        else:  # laid out as a table
            menu = r.choice(["<br>", " "]).join(f'<a href="{i}">{self.talk("menu", 1, 2)}</a>' for i in range(r.randint(2, 7)))
            menu = f'<td class="{r.choice(_NAMES["menu"] + _NAMES["sidebar"])}">{menu}</td>' if r.random() < 0.8 else f"<td width=20%>{menu}</td>"
            body = f'<table><tr>{menu}<td{r.choice(["", f" class={r.choice(_MAIN)}", " valign=top"])}>{body}</td></tr></table>'
        some = lambda kinds, p: "".join(self.junk(k) for k in kinds if r.random() < p)
        before = some(["notice", "header", "menu", "menu", "advert", "form"], 0.5)
        after = some(["advert", "form", "comment", "comment", "sidebar", "menu", "notice", "footer", "footer"], 0.4)
        if r.random() < 0.3:
            body = f"<div class='{r.choice(['container', 'wrapper', 'page', 'row'])}'>{some(['sidebar'], 0.4)}{body}{some(['sidebar', 'comment'], 0.4)}</div>"
        return f"<html><head><title>{self.prose(2, 10)}</title></head><body>{before}{body}{after}</body></html>"


def made_page(seed: int) -> str:
    """A page in which \\x01 stands before every main text."""
    return _Page(seed).make()
