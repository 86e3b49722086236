"""Labelled pages for the extraction model: invented prose in layouts as sites have them, with what is main text marked.

An element with the attribute ``main`` set to 1 holds main text, one with 0 does not; the closest one above decides. Pages are made by
a seeded generator, so that they are the same everywhere; a test set takes other seeds and, if wanted, names that training doesn't have.
"""

from __future__ import annotations

import random

#: Words that sites use in classes and ids, by part of a page.
NAMES = {
    "wrap": "page wrapper container site wrap outer layout inner row grid",
    "header": "header masthead top branding site-header page-header topbar banner hero logo",
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav tabs pagination pager toc links skip",
    "notice": "cookie cookies consent gdpr notice alert message popup modal newsletter subscribe paywall overlay toast privacy warning announcement",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion commercial adsense banner-ad dfp outbrain taboola",
    "main": "content main article post entry story article-body post-content entry-content body-text text article-content main-content post-body blog",
    "side": "sidebar side aside widget rail related recommended more-stories popular trending teaser right left column secondary",
    "comments": "comments comment-list commentlist responses replies discussion disqus comment-section reactions thread feedback guestbook",
    "form": "form search login signup register contact searchform mc-embedded poll",
    "footer": "footer site-footer page-footer bottom colophon copyright legal imprint footnotes credits foot",
    "share": "share social sharing share-buttons tools meta byline tags author-box print social-links",
}
LEFT_OUT = "site-header topnav consent advertisement story post-body recommended responses signup colophon social-links"  # of training, on request
SYLLABLES = "an be ch de en er ge in ion ka le mo na or pe ra re sch st ta tion ue ver vi wa zo é ü ñ 日 本"


class Writer:
    """Random prose and parts of pages."""

    def __init__(self, seed: int, all_names: bool = True):
        self.r = random.Random(seed)
        skip = set() if all_names else set(LEFT_OUT.split())
        self.names = {part: [n for n in names.split() if n not in skip] for part, names in NAMES.items()}

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES.split(), k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            text = self.words(3, 18).capitalize()
            out.append((text.replace(" ", ", ", 1) if self.r.random() < 0.4 else text) + self.r.choice("...?!"))
        return self.r.choice(["", "", "", "&amp; ", "&#8222;"]) + " ".join(out)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def links(self, low: int, high: int, wrap: str) -> str:
        def one() -> str:
            link = f'<a href="/{self.word()}">{self.words(1, 4)}</a>'
            return f"<{wrap}>{link}</{wrap}>" if wrap else link + self.r.choice([" ", " | ", " &middot; "])

        return "".join(one() for _ in range(self.r.randint(low, high)))

    def menu(self) -> str:
        kind = self.r.random()
        return f"<ul>{self.links(2, 9, 'li')}</ul>" if kind < 0.6 else self.links(2, 8, self.r.choice(["", "div", "p", "span"]))

    def element(self, part: str, inside: str, tags: str, label: int | None = 0, named: float = 0.85) -> str:
        """``inside`` in one of ``tags``; a div mostly has a name of its part, another element sometimes."""
        tag = self.r.choice(tags.split())
        mark = "" if label is None else f' main="{label}"'
        name = ""
        if self.chance(named if tag in ("div", "section", "ul", "td") else 0.4):
            words = self.r.sample(self.names[part], 1 + self.chance(0.2))
            name = f' {self.r.choice(["class", "class", "id"])}="{" ".join(words)}{self.r.choice(["", "", "-1", " clearfix"])}"'
        return f"<{tag}{name}{mark}>{inside}</{tag}>"

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.08:
            return f"<p>{self.words(1, 2).capitalize()}."
        if kind < 0.16:
            return f"<p><b>{self.sentences(1, 8)}<br><p>{self.sentences(1, 6)}</p>"
        if kind < 0.3:
            return f'<p>{self.sentences(1, 3)} <a href="/{self.word()}">{self.words(1, 3)}</a> {self.sentences(1, 4)}</p>'
        return f"<p>{self.sentences(1, self.r.choice([2, 5, 12]))}</p>"

    def main_text(self) -> str:
        plain = self.chance(0.12)  # paragraphs that are divs
        out = []
        for _ in range(self.r.choice([1, 1, 2, 4, 7, 12])):
            kind = self.r.random()
            if kind < 0.1:
                out.append(f"<h{(n := self.r.choice('234'))}>{self.words(1, 7)}</h{n}>")
            elif kind < 0.16:
                out.append("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif kind < 0.2:
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif kind < 0.23:
                out.append(f"<pre>{self.words(5, 40)}</pre>")
            elif kind < 0.26:
                cells = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(2, 5)))
                out.append(f"<table>{cells}</table>")
            elif kind < 0.29:
                out.append(f'<figure><img src="x.jpg"><figcaption>{self.sentences(1, 1)}</figcaption></figure>')
            else:
                out.append(f"<div>{self.sentences(1, 9)}</div>" if plain else self.paragraph())
        between = [
            lambda: self.element("ad", self.prose(1, 2), "div div aside"), lambda: self.element("side", self.menu(), "div aside"),
            lambda: self.element("share", self.links(2, 5, ""), "div ul"), lambda: self.element("notice", self.prose(1, 3), "div section"),
            lambda: self.element("form", self.form_fields(), "form", named=0.5), lambda: self.element("nav", self.menu(), "nav div")]
        for _ in range(2):
            if self.chance(0.25):
                out.insert(self.r.randint(0, len(out)), self.r.choice(between)())
        return "".join(out)

    def prose(self, low: int, high: int) -> str:
        text = self.sentences(low, high)
        return f"<p>{text}</p>" if self.chance(0.5) else text

    def form_fields(self) -> str:
        field = lambda: self.r.choice([f'<label>{self.words(1, 3)}</label><input name="q">', f"<select><option>{self.word()}<option>{self.word()}</select>",
                                       f"<textarea>{self.words(0, 4)}</textarea>", f"<p>{self.sentences(1, 2)}</p>"])
        return "".join(field() for _ in range(self.r.randint(1, 4))) + f"<button>{self.words(1, 2)}</button>"

    def comments(self) -> str:
        tag = self.r.choice(["div", "li", "article", "p"])
        one = lambda: f"<{tag}>" + (f"<b>{self.words(1, 2)}</b> " if self.chance(0.5) else f"<div>{self.words(1, 2)}</div>") * self.chance(0.8) + (
            self.sentences(1, 6) if tag == "p" or self.chance(0.5) else f"<p>{self.sentences(1, 6)}</p>") + f"</{tag}>"
        title = f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.5) else ""
        inside = title + "".join(one() for _ in range(self.r.choice([1, 2, 5, 9])))
        return self.element("comments", inside if tag != "li" else f"<ol>{inside}</ol>", "div div section", named=1)

    def page(self) -> str:
        w, c = self, self.chance
        heading = f"<h1>{w.words(2, 10)}</h1>" if c(0.75) else ""
        tail = (w.comments() if c(0.25) else "") + (w.element("share", w.links(2, 6, ""), "div ul") if c(0.15) else "")
        main = w.element("main", heading * (inner := c(0.8)) + w.main_text() + tail, "article article main div div section td", label=1, named=0.75)
        if not inner and heading:
            main = f'<div main="1">{heading}</div>{main}' if c(0.3) else heading.replace("<h1>", '<h1 main="1">') + main
        top = [
            w.element("header", f'<a href="/">{w.words(1, 3)}</a>' + (f"<p>{w.words(2, 6)}</p>" if c(0.4) else "") + (w.menu() if c(0.3) else ""), "header div") if c(0.5) else "",
            w.element("nav", w.menu(), "nav nav div div ul") if c(0.7) else "", w.element("notice", w.prose(1, 3), "div section aside", named=1) if c(0.3) else "",
            w.element("ad", w.prose(1, 3), "div div aside", named=1) if c(0.4) else "", w.element("form", w.form_fields(), "form", named=0.5) if c(0.2) else ""]
        w.r.shuffle(top)
        side = w.element("side", "".join(
            f"<h3>{w.words(1, 3)}</h3>" + (w.menu() if c(0.6) else w.prose(1, 2)) for _ in range(w.r.randint(1, 3))), "aside div div", named=0.9) if c(0.4) else ""
        bottom = (w.comments() if c(0.25) else "") + (w.element("notice", w.prose(1, 2), "div", named=1) if c(0.1) else "") + (
            w.element("footer", w.r.choice(["&copy; ", "© ", "", "Copyright "]) + w.r.choice([w.words(1, 4) + ". ", w.sentences(1, 2)]) + (w.menu() if c(0.4) else ""),
                      "footer footer div", named=0.95) if c(0.75) else "")
        parts = "".join(top), side, main, bottom
        body = parts[0] + (parts[1] + parts[2] if c(0.4) else parts[2] + parts[1]) + parts[3]
        if c(0.12):  # nothing but text
            body = heading.replace("<h1>", '<h1 main="1">') + f'<div main="1">{w.main_text()}</div>' if c(0.5) else f'<main main="1">{heading}{w.main_text()}</main>'
        for _ in range(w.r.choice([0, 0, 0, 1, 2])):
            body = w.element("wrap", body, "div", label=None)
        script = '<script>var t="</p>";</script>' if c(0.3) else ""
        return f"<!DOCTYPE html><html><head><title>{w.words(1, 5)}</title>{script}</head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 1, all_names: bool = True) -> list[str]:
    """``n`` labelled pages; the same for the same arguments."""
    return [Writer(seed * 1_000_003 + i, all_names).page() for i in range(n)]
