"""Labelled pages to train the extraction of main text on: made by rule from a seed, each with its main text.

Layouts vary as pages of the web do: semantic elements or plain divs, telling or opaque names, tables, markup left open,
text without paragraphs; menus, headers, footers, sidebars, notices, adverts, forms and readers' comments stand around
the article and some of them within it.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Frequent words of four languages, mixed into made-up ones.
COMMON = (
    "the of and to in a is that it was for on as with by at from this be are or an which you not have but they his her".split(),
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "le la de et les des en un une du que qui dans pour il est sur au ne se pas par plus ce avec elle ou son sont aux".split(),
    "el la de que y en un los se por con para una su no es al lo como más las del pero sus le ya o este sí porque".split(),
)
SYLLABLES = ("th er on an re in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(), "en er ch ei te in de ie un sch ge au be st ng it ver ich äu ö ü".split(), "es le en de ou ai an re on er é è eau que ment tion ç ê".split(), "de es en el la os ar ue ra ción ñ í á as do ent ante".split())
PHRASES = {
    "menu": "Home|About|About us|Contact|News|Blog|Products|Services|Login|Sign in|Archive|Sitemap|Help|FAQ|Startseite|Kontakt|Über uns|Accueil|Contacto|Inicio|Menu|Sport|Politics|Culture|Shop|Cart|My account".split("|"),
    "footer": "© 2024 {w}|Copyright {w}. All rights reserved.|Privacy policy|Terms of use|Terms and conditions|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by {w}|© {w} · {s}|Imprint|Cookies|© {w}".split("|"),
    "notice": "We use cookies to improve your experience. {s}|{p}|{s}|This site uses cookies. {s}|Accept all|Reject|Please enable JavaScript.|You are using an outdated browser.|Notice: {s}|Disclaimer: {s}|{s}|Got it|Learn more".split("|"),
    "form": "Search|Subscribe to our newsletter|Your email address|Name|Email|Password|Submit|Send|Log in|Forgot password?|Sign up|Register|Enter your email|Subscribe|Message|Remember me|{w}".split("|"),
    "advert": "Advertisement|Sponsored|{s}|{s} {s}|{p}|{s}|Buy now|Anzeige|Shop {w} today|Save 20% on {w}|Publicité|Sponsored content: {s}|Ad".split("|"),
    "share": "Share|Tweet|Share on Facebook|Print|Email this|Like|Share this article|Follow us|RSS".split("|"),
    "related": "Related articles|Read more|You may also like|Most read|More from {w}|{t}|{t}|{t}|Recommended|Next article|Previous".split("|"),
    "comment": "Comments|{w} says:|Reply|{s}|{s} {s}|{p}|3 comments|Leave a comment|{w} wrote on 3 May|Posted by {w}|Report abuse|Kommentare|Permalink|12 hours ago".split("|"),
    "sidebar": "Recent posts|Categories|Archives|Tags|{t}|{t}|{s}|About the author|Popular|{w}|{w} (12)|Follow us".split("|"),
    "header": "{w}|{t}|Welcome to {w}|{w} - {t}|Skip to content|Toggle navigation|{w} News|Breaking news|Today".split("|"),
}
#: Names that such parts go by, and elements that hold them.
KINDS = {
    "menu": ("nav menu navigation navbar breadcrumb breadcrumbs topnav tabs pagination pager links main-menu mainnav subnav toc", "nav div ul nav div"),
    "footer": ("footer site-footer bottom copyright colophon legal credits page-footer foot", "footer div footer div section"),
    "notice": ("notice cookie cookie-banner banner alert message gdpr consent warning disclaimer infobox popup modal overlay announcement", "div aside section div dialog"),
    "form": ("search login newsletter subscribe signup form contact-form searchbox register", "form div form form"),
    "advert": ("ad ads advert advertisement sponsored promo promotion banner-ad sponsor adbox commercial teaser-ad", "div aside div section aside"),
    "share": ("share social sharing social-links sharebar tools buttons follow", "div ul aside"),
    "related": ("related related-posts more recommended teaser also-like most-read readmore trending see-also", "div aside section ul nav"),
    "comment": ("comments comment-list comment reader-comments discussion responses replies commentlist disqus user-comments feedback", "div section ol ul aside"),
    "sidebar": ("sidebar side widget widgets aside secondary rail right-column left-column sidebox widget-area complementary", "aside div aside section td"),
    "header": ("header site-header masthead top logo branding page-header topbar title-bar hero-header", "header div header div"),
}
CONTENT = "content article post entry main story article-body post-content entry-content main-content body-text text story-body page-content".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.lang = self.r.randrange(4)
        self.opaque = self.r.random() < 0.25
        self.open = self.r.random() < 0.3  # leaves tags open
        self.text: list[str] = []

    # words

    def word(self) -> str:
        r = self.r
        return r.choice(COMMON[self.lang]) if r.random() < 0.35 else "".join(r.choice(SYLLABLES[self.lang]) for _ in range(r.randint(1, 4)))

    def title(self) -> str:
        t = " ".join(self.word() for _ in range(self.r.randint(2, 9)))
        return t[:1].upper() + t[1:]

    def sentence(self) -> str:
        words = [self.word() for _ in range(max(1, int(self.r.expovariate(1 / 9))))]
        for k in range(len(words) - 1):
            if self.r.random() < 0.08:
                words[k] += ","
        s = " ".join(words)
        return s[:1].upper() + s[1:] + self.r.choice("...........?!:")

    def prose(self) -> str:
        n = self.r.choice([1, 1, 1, 2, 3, 4, 6, 9])
        s = " ".join(self.sentence() for _ in range(n))
        if self.r.random() < 0.06:
            s = s.replace(" ", self.r.choice([" | ", " & ", " ### ", " > "]))
        return s

    def phrase(self, kind: str) -> str:
        p = self.r.choice(PHRASES[kind])
        for mark, make in (("{w}", lambda: self.word().title()), ("{t}", self.title), ("{s}", self.sentence), ("{p}", self.prose)):
            while mark in p:
                p = p.replace(mark, make(), 1)
        return p

    # markup

    def escape(self, s: str) -> str:
        return html.escape(s, quote=self.r.random() < 0.3).replace("©", self.r.choice(["&copy;", "©", "&#169;"]))

    def name(self, names: list[str], telling: bool = False) -> str:
        r = self.r
        if not telling and (self.opaque or r.random() < 0.12):
            return r.choice(["", f' class="css-{r.randrange(16**6):x}"', f' class="x{r.randrange(99)}"', ' class="row"', ' class="box"', ' class="container"'])
        n = r.choice(names)
        n = r.choice([n, n, n, f"{n}-wrapper", f"site-{n}", f"{n}_box", f"block {n}", n.title().replace("-", ""), f"{n} clearfix", f"js-{n}"])
        return r.choice([f' class="{n}"', f' id="{n}"', f" class='{n}'", f' class="{n}" id="{r.choice(names)}"', f" class={n.split()[0]}"])

    def line(self, s: str, article: bool = False) -> str:
        """A block's text with line markup; keeps it as main text if it stands in the article."""
        r, words = self.r, s.split()
        if article:
            self.text.append(" ".join(words))
        out = [self.escape(w) for w in words]
        if len(out) > 3 and r.random() < 0.3:
            k = r.randrange(len(out) - 2)
            tag = r.choice(["b", "i", "em", "strong", "a", "code", "span"])
            out[k] = f'<a href="/{k}">{out[k]}' if tag == "a" else f"<{tag}>{out[k]}"
            out[k + 1] += f"</{tag}>"
        if r.random() < 0.1:
            out[0] = f"<b>{out[0]}"
        gaps = [r.choice([" ", " ", " ", " ", "\n", "<br>", " <br/> "]) if r.random() < 0.05 else " " for _ in out]
        return "".join(x + g for x, g in zip(out, gaps)).rstrip(" ")

    def block(self, tag: str, s: str, article: bool = False) -> str:
        line = self.line(s, article)
        end = "" if self.open and tag in ("p", "li", "td", "dd") and self.r.random() < 0.7 else f"</{tag}>"
        tag = tag.upper() if self.r.random() < 0.03 else tag
        return f"<{tag}>{line}{end}" + self.r.choice(["", "", "\n", "<!-- x -->"])

    def noise(self, kind: str, telling: bool = False) -> str:
        """A part that isn't main text; telling: its name says what it is, as nothing else does in the midst of an article."""
        r = self.r
        names, tags = KINDS[kind]
        tag = r.choice(tags.split())
        inner = []
        for _ in range(r.choice([1, 2, 3, 5, 8]) if kind not in ("advert", "notice") else r.choice([1, 1, 2])):
            p = self.phrase(kind)
            link = r.random() < {"menu": 0.95, "share": 0.7, "related": 0.8, "footer": 0.4, "sidebar": 0.5, "comment": 0.1}.get(kind, 0.15)
            s = f'<a href="/{r.randrange(999)}">{self.escape(p)}</a>' if link else self.line(p)
            if tag in ("ul", "ol") or kind == "menu" and r.random() < 0.8:
                inner.append(f"<li>{s}</li>")
            elif kind == "form":
                inner.append(r.choice([f"<label>{s}</label><input type=text>", f"<button>{s}</button>", f"<p>{s}</p>", f"<select><option>{s}</option></select>"]))
            else:
                inner.append(r.choice([f"<p>{s}</p>", f"<p>{s}</p>", f"<div>{s}</div>", f"<h3>{s}</h3>", f"<span>{s}</span><br>", s]) if len(inner) else r.choice([f"<p>{s}</p>", f"<h3>{s}</h3>", f"<div>{s}</div>", s]))
        body = "".join(inner)
        if kind in ("advert", "notice") and r.random() < 0.4:  # text without blocks of its own
            body = self.line(self.phrase(kind))
        if tag not in ("ul", "ol") and "<li>" in body:
            body = f"<ul>{body}</ul>"
        if kind == "comment" and r.random() < 0.5:
            body += self.noise("form")
        tag = "div" if tag == "td" else tag
        return f"<{tag}{self.name(names.split(), telling)}>{body}</{tag}>" + r.choice(["", "\n"])

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.85:
            h = self.block(r.choice(["h1", "h1", "h1", "h2"]), self.title(), True)
            out.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.66:
                out.append(self.block("p", self.prose(), True))
            elif x < 0.71:
                out.append(self.block(r.choice(["h2", "h3"]), self.title(), True))
            elif x < 0.76:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(self.block("li", r.choice([self.sentence, self.title])(), True) for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif x < 0.79:
                out.append(f"<blockquote>{self.block('p', self.prose(), True)}</blockquote>")
            elif x < 0.81:
                out.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.word(), True) for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.83:
                out.append(self.block("pre", self.sentence(), True))
            elif x < 0.86:
                out.append(f'<div class="{r.choice(["text", "para", "section"])}">{self.line(self.prose(), True)}</div>')
            else:
                out.append(self.noise(r.choice(["advert", "share", "related", "form", "notice", "advert", "sidebar", "menu"]), True))
        if r.random() < 0.3:
            out.append(self.noise(r.choice(["comment", "comment", "share", "related"]), True))
        return "".join(out)

    def page(self) -> tuple[str, str]:
        r = self.r
        tag = r.choice(["article", "article", "article", "div", "div", "section", "main"])
        names = "" if tag in ("article", "main") and r.random() < 0.6 else self.name(CONTENT)
        body = f"<{tag}{names}>{self.article()}</{tag}>" if r.random() < 0.92 else self.article()
        if tag != "main" and r.random() < 0.3:
            body = f"<main>{body}{self.noise(r.choice(['comment', 'related', 'advert'])) if r.random() < 0.4 else ''}</main>"
        before = [self.noise(k) for k in ("notice", "header", "menu", "form", "advert", "menu") if r.random() < 0.5]
        after = [self.noise(k) for k in ("share", "related", "comment", "sidebar", "advert", "form", "footer") if r.random() < 0.45] + [self.noise("footer")] * (r.random() < 0.4)
        r.shuffle(before)
        if r.random() < 0.2:
            before.append(self.noise("sidebar"))
        if r.random() < 0.12:
            body = f"<table><tr><td>{before.pop() if before else ''}</td><td>{body}</td></tr></table>"
        if r.random() < 0.4:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "wrap", "layout", "row"])}">{body}{"".join(after[:2])}</div>'
            after = after[2:]
        head = f"<head><meta charset=\"utf-8\"><title>{self.escape(self.title())}</title><style>p{{margin:0}}</style><script>var t=\"</p><p>{self.word()}\";</script></head>"
        return f"{r.choice(['<!DOCTYPE html>', ''])}<html>{head}<body>{''.join(before)}{body}{''.join(after)}</body></html>", "\n\n".join(self.text)


def labelled_pages(spark: SparkSession, n: int = 900, seed: int = 12) -> DataFrame:
    """(page_id, html, text) of n made pages; text is the main text, its blocks joined by two line ends."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            made = [Writer(seed * 1_000_003 + i).page() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.string())], names=["page_id", "html", "text"])

    return spark.range(n, numPartitions=4).mapInArrow(make, "page_id long, html string, text string")
