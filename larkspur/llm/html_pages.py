"""Labelled pages for the article trees, made from a rule: families of layouts with names, nesting and mark-up drawn at random.

Elements that belong to the article carry the attribute keep; every other element does not. A family can
be left out of training, which shows what the trees make of a layout they have not seen.
"""

from __future__ import annotations

import random

SYLLABLES = "the of an in re on er sta la que de und mit les pour con una ting ver heit ment tion ales oria ka mo shi ро на то го дел ска".split()
K = " keep"
#: begins a page whose text stands in no element
ROOT = "<!--keep-->"

GOOD = "content post story article-body entry-content main-text post-body text body-copy page-content prose blog-entry markdown-body field-item".split()
MISLEADING = "popular-story related-work more-news top-stories header-text side-note footer-history menu-of-the-day comment-policy share-prices ad-hoc-report navigation-history login-guide widget-design sponsored-study".split()
NEUTRAL = "wrap container row col page inner box block section-1 c1 x9 grid layer module-a".split()
MENU = "menu navbar nav topnav site-nav main-menu breadcrumbs pagination toc tabs links".split()
SIDE = "sidebar widget related rail aside-box recommended trending popular-posts more-links secondary".split()
AD = "ad ads advert advertisement sponsored promo ad-slot banner-ad dfp taboola".split()
NOTICE = "cookie-notice consent alert gdpr notice cookie-banner announcement-bar modal popup".split()
TALK = "comments comment-list comments-area discussion replies disqus_thread responses commentlist reader-comments talkback".split()
ASK = "subscribe newsletter search-form signup login share social-links poll".split()
FOOT = "footer site-footer copyright legal foot page-footer bottom-links colophon".split()
HEAD = "header site-header masthead top banner page-header branding".split()


class Maker:
    """Pieces of pages from one random source."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = ""

    def restyle(self) -> None:
        """How the next page is written: with signs, without any, or in signs without spaces."""
        self.style = self.r.choice(("signs",) * 8 + ("bare", "dense"))

    def word(self) -> str:
        if self.style == "dense":
            return "".join(chr(self.r.randint(0x4E00, 0x9000)) for _ in range(self.r.randint(1, 3)))
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def phrase(self, a: int, b: int) -> str:
        return ("" if self.style == "dense" else " ").join(self.word() for _ in range(self.r.randint(a, b)))

    def prose(self, a: int = 1, b: int = 6) -> str:
        r = self.r
        if self.style == "bare":
            return self.phrase(4, 12).capitalize()
        if self.style == "dense":
            return "".join(self.phrase(3, 12) + r.choice(("。", "。", "！", "？", "，" + self.phrase(2, 6) + "。")) for _ in range(r.randint(a, b)))
        return " ".join(self.phrase(3, 18).capitalize() + r.choice((".", ".", ".", "!", "?", ", " + self.phrase(2, 8) + ".")) for _ in range(r.randint(a, b)))

    def attr(self, names: list[str], on: float = 0.7) -> str:
        r = self.r
        if r.random() >= on:
            return r.choice(("", "", "", f' style="color:#{r.randint(100, 999)}"', f" data-x={r.randint(1, 9)}"))
        name = r.choice(names) + (" " + r.choice(NEUTRAL) if r.random() < 0.2 else "")
        return f' {r.choice(("class", "class", "class", "id"))}="{name}"'

    def links(self, n: int, sep: str = "li") -> str:
        out = [f'<a href="/{self.word()}">{self.phrase(1, 4)}</a>' for _ in range(n)]
        return "".join(f"<li>{x}</li>" for x in out) if sep == "li" else sep.join(out)

    def menu(self) -> str:
        r, n = self.r, self.r.randint(2, 9)
        return r.choice((
            lambda: f"<nav{self.attr(MENU, 0.4)}><ul>{self.links(n)}</ul></nav>", lambda: f"<nav>{self.links(n, ' | ')}</nav>", lambda: f"<div{self.attr(MENU, 0.8)}>{self.links(n, r.choice((' ', ' &middot; ', ' | ')))}</div>",
            lambda: f"<ul{self.attr(MENU, 0.7)}>{self.links(n)}</ul>", lambda: f"<div{self.attr(MENU, 0.9)}><ul>{self.links(n)}</ul></div>", lambda: f"<div><div>{self.phrase(1, 2)}</div>{self.links(n, '<br>')}</div>",
            lambda: f'<div role="navigation">{self.links(n, " ")}</div>', lambda: f"<ul{self.attr(MENU, 0.8)}><li>{self.phrase(1, 2)}<ul>{self.links(r.randint(1, 4))}</ul></li>{self.links(n)}</ul>",
        ))()

    def header(self) -> str:
        r = self.r
        name = r.choice((f'<a href="/">{self.phrase(1, 3)}</a>', f"<h1><a href=/>{self.phrase(1, 3)}</a></h1>", f"<h1>{self.phrase(1, 3)}</h1>", f"<p class=site-title>{self.phrase(1, 3)}</p>", f"<div>{self.phrase(1, 3)}</div>"))
        line = f"<p>{self.phrase(2, 8)}{r.choice(('', '.'))}</p>" if r.random() < 0.5 else ""
        tag = r.choice(("header", "header", "div"))
        return f"<{tag}{self.attr(HEAD, 0.5 if tag == 'header' else 1)}>{name}{line}{self.menu() if r.random() < 0.3 else ''}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(("footer", "footer", "div"))
        text = r.choice((f"&copy; {r.randint(1999, 2025)} {self.prose(1, 2)}", f"<p>{self.prose(1, 3)}</p>", f"<div class=content><p>{self.prose(1, 3)}</p></div>", f"<div><h4>{self.phrase(1, 2)}</h4><ul>{self.links(4)}</ul></div><p>&copy; {self.phrase(2, 6)}</p>", f"{self.links(4, ' ')}<p>{self.phrase(3, 9)}.</p>"))
        return f"<{tag}{self.attr(FOOT, 0.5 if tag == 'footer' else 1)}>{text}</{tag}>"

    def ad(self) -> str:
        inner = self.r.choice((self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.phrase(2, 5)}</h3><p>{self.prose(1, 2)}</p><a href=/buy>{self.word()}</a>"))
        return f"<{(t := self.r.choice(('div', 'div', 'section', 'aside')))}{self.attr(AD, 1)}>{inner}</{t}>"

    def notice(self) -> str:
        return f"<div{self.attr(NOTICE, 1)}>{self.r.choice(('<p>{}</p>', '{}', '<div><p>{}</p></div>')).format(self.prose(1, 2))}<button>{self.word()}</button></div>"

    def ask(self) -> str:
        r = self.r
        return r.choice((
            lambda: f"<form{self.attr(ASK)}><label>{self.phrase(1, 4)}</label><input name=q><button>{self.word()}</button></form>", lambda: f"<form{self.attr(ASK)}><p>{self.prose(1, 2)}</p><input><select><option>{self.word()}<option>{self.word()}</select></form>",
            lambda: f"<div{self.attr(ASK, 1)}><h3>{self.phrase(2, 4)}</h3><p>{self.prose(1, 2)}</p><form><input type=email><button>{self.word()}</button></form></div>", lambda: f"<div{self.attr(ASK, 1)}>{self.links(3, ' ')}</div>",
        ))()

    def side(self) -> str:
        r = self.r
        tag = r.choice(("aside", "aside", "div", "section"))
        inner = r.choice((lambda: f"<h3>{self.phrase(1, 3)}</h3><ul>{self.links(r.randint(2, 7))}</ul>", lambda: f"<p>{self.prose(1, 3)}</p>", lambda: f"<h2>{self.phrase(1, 3)}</h2>" + "".join(f"<div><a href=/x>{self.phrase(3, 9)}</a><p>{self.phrase(4, 12)}</p></div>" for _ in range(r.randint(2, 4)))))()
        return f"<{tag}{self.attr(SIDE, 0.5 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def comments(self) -> str:
        r = self.r
        tag = r.choice(("section", "div", "div", "ol", "ul"))
        item = r.choice(("li",)) if tag in ("ol", "ul") else r.choice(("div", "article", "div"))
        own = lambda: f"<{item}{self.attr(['comment', 'reply', 'response', 'comment-body', 'post'], 0.6)}>{r.choice(('<b>{}</b>', '<cite>{}</cite>', '<span class=author>{}</span>', '<h4>{}</h4>')).format(self.word())}{r.choice(('<p>{}</p>', '<div>{}</div>', '<p>{}</p><p>' + self.prose(1, 2) + '</p>')).format(self.prose(1, 4))}</{item}>"
        head = r.choice(("", f"<h2>{r.randint(1, 40)} {self.phrase(1, 3)}</h2>", f"<h3>{self.phrase(1, 2)}</h3>")) if tag not in ("ol", "ul") else ""
        body = "".join(own() for _ in range(r.randint(1, 7)))
        if tag == "section" or r.random() < 0.3:
            body = f"<div>{body}</div>" if item != "li" else body
        return f"<{tag}{self.attr(TALK, 1)}>{head}{body}</{tag}>"

    def inline(self, text: str) -> str:
        r, words = self.r, text.split(" ")
        for _ in range(r.choice((0, 0, 0, 1, 2, 3))):
            i = r.randrange(len(words))
            tag = r.choice(("a href=/x", "b", "em", "strong", "code", "span", "i", "sup"))
            words[i] = f"<{tag}{K}>{words[i]}</{tag.split()[0]}>"
        return " ".join(words)

    def paragraph(self) -> str:
        t = self.inline(self.prose())
        x = self.r.random()
        if x < 0.06:
            return f"<p{K}><b{K}>{t}" + self.r.choice(("</b>", "<br>", ""))
        return f"<p{K}{self.attr(['intro', 'lead', 'first', 'has-text', 'p1'], 0.08)}>{t}" + ("</p>" if x < 0.9 else "")

    def block(self) -> str:
        """Something of an article other than a paragraph."""
        r = self.r
        return r.choice((
            lambda: f"<h{(n := r.randint(2, 4))}{K}>{self.phrase(1, 6)}</h{n}>", lambda: f"<h2{K}>{self.phrase(1, 6)}</h2>", lambda: f"<blockquote{K}><p{K}>{self.prose(1, 2)}</p></blockquote>", lambda: f"<blockquote{K}>{self.prose(1, 2)}</blockquote>",
            lambda: f"<{(t := r.choice(('ul', 'ol')))}{K}>" + "".join(f"<li{K}>{self.phrase(2, 14)}{r.choice(('.', ''))}{r.choice(('</li>', ''))}" for _ in range(r.randint(2, 6))) + f"</{t}>",
            lambda: f"<pre{K}>{self.phrase(4, 20)}</pre>", lambda: f"<pre{K}><code{K}>{self.phrase(1, 3)} = {self.phrase(2, 4)}\n{self.phrase(2, 6)}</code></pre>", lambda: self.table(), lambda: f"<dl{K}>" + "".join(f"<dt{K}>{self.phrase(1, 3)}</dt><dd{K}>{self.phrase(3, 12)}.</dd>" for _ in range(r.randint(1, 4))) + "</dl>",
            lambda: f"<figure{K}><img src=x><figcaption{K}>{self.phrase(3, 12)}.</figcaption></figure>", lambda: f"<hr{K}>",
        ))()

    def table(self) -> str:
        r, n = self.r, self.r.randint(1, 4)
        head = f"<tr{K}>" + "".join(f"<th{K}>{self.phrase(1, 3)}</th>" for _ in range(n)) + "</tr>" if r.random() < 0.7 else ""
        rows = "".join(f"<tr{K}>" + "".join(f"<td{K}>{self.phrase(1, 5)}</td>" for _ in range(n)) + "</tr>" for _ in range(r.randint(1, 5)))
        return f"<table{K}>{head}{rows}</table>" if r.random() < 0.6 else f"<table{K}><thead{K}>{head}</thead><tbody{K}>{rows}</tbody></table>"

    def title(self, on: float = 0.9) -> str:
        r = self.r
        return f"<h{(n := r.choice((1, 1, 1, 2)))}{K}{self.attr(['title', 'entry-title', 'headline', 'post-title'], 0.3)}>{self.phrase(2, 12).capitalize()}</h{n}>" if r.random() < on else ""

    def flow(self, n: int, extra: float = 0.25, junk: float = 0.1) -> str:
        out = []
        for _ in range(n):
            x = self.r.random()
            out.append(self.block() if x < extra else self.inside() if x < extra + junk else self.paragraph())
        return "".join(out)

    def inside(self) -> str:
        """What is no article though it stands in one."""
        return self.r.choice((self.ad, self.ad, self.ask, self.side, self.notice, lambda: f"<label><p>{self.prose(1, 2)}</p></label>", lambda: f"<script>var t = '<p>{self.word()}</p>';</script>", lambda: f"<aside><p>{self.prose(1, 2)}</p></aside>", lambda: f"<footer>{self.phrase(2, 8)}</footer>"))()

    def byline(self) -> str:
        return f"<div{K}{self.attr(['byline', 'meta', 'date', 'author'], 0.8)}>{self.phrase(2, 6)}</div>" if self.r.random() < 0.2 else ""

    def around(self, article: str, most: int = 2) -> str:
        for _ in range(self.r.randint(0, most)):
            article = f"<div{self.attr(NEUTRAL)}>{article}</div>"
        return article

    def framed(self, article: str, talk: float = 0.4) -> str:
        """Top, article, comments, sidebar, footer; each but the article may be missing."""
        r = self.r
        top = [f() for f, on in ((self.header, 0.6), (self.menu, 0.8), (self.ad, 0.4), (self.notice, 0.2)) if r.random() < on]
        if r.random() < 0.3:
            r.shuffle(top)
        end = [f() for f, on in ((self.ask, 0.15), (self.comments, talk), (self.side, 0.5), (self.ad, 0.15), (self.footer, 0.85)) if r.random() < on]
        if r.random() < 0.15:
            end.insert(0, self.menu())
        return "".join(top) + article + "".join(end)


def classic(m: Maker) -> str:
    t = m.r.choice(("article", "article", "main", "div", "section"))
    return m.framed(m.around(f"<{t}{K}{m.attr(GOOD, 1 if t in ('div', 'section') else 0.3)}>{m.title()}{m.byline()}{m.flow(m.r.randint(1, 14))}</{t}>"))


def plain_article(m: Maker) -> str:
    """Head-line and paragraphs in an article element, little else around."""
    return f"{m.menu()}{m.ad() if m.r.random() < 0.6 else ''}<article{K}>{m.title(1)}{m.flow(m.r.randint(1, 14), 0.03, 0.02)}</article>" + (m.comments() if m.r.random() < 0.2 else "") + (m.footer() if m.r.random() < 0.9 else "")


def bare(m: Maker) -> str:
    """The body itself is the article."""
    r = m.r
    loose = lambda: r.choice((m.prose(1, 2), m.prose(1, 3) + "<br><br>" + m.prose(1, 2), ""))
    inner = m.title() + loose() + m.flow(r.randint(1, 8), 0.2, 0.04) + (loose() if r.random() < 0.3 else "")
    return f"<body{K}>" + (m.menu() if r.random() < 0.25 else "") + inner + (m.footer() if r.random() < 0.3 else "") + "</body>"


def fragment(m: Maker) -> str:
    """A piece without any frame."""
    r = m.r
    return r.choice((m.paragraph, lambda: ROOT + (m.title() if r.random() < 0.5 else "") + m.inline(m.prose(1, 3)) + r.choice(("", "<br><br>" + m.prose(1, 3), m.paragraph())), lambda: m.title() + m.flow(r.randint(1, 5), 0.1, 0), lambda: f"<div{K}>{m.prose(1, 5)}</div>", lambda: f"<div>{m.title()}{m.flow(r.randint(1, 4), 0.1, 0)}</div>".replace("<div>", f"<div{K}>", 1)))()


def unnamed(m: Maker) -> str:
    """Divs without names; texts in divs instead of paragraphs."""
    r = m.r
    para = lambda: f"<div{K}>{m.inline(m.prose())}</div>" if r.random() < 0.7 else m.paragraph()
    head = f"<div{K}>{m.phrase(2, 9).capitalize()}</div>" if r.random() < 0.5 else m.title()
    article = f"<div{K}>{head}" + "".join(para() for _ in range(r.randint(1, 9))) + "</div>"
    top = f"<div>{m.links(r.randint(2, 8), r.choice((' ', ' | ', '</div><div>')))}</div>"
    end = f"<div>&copy; {r.randint(1999, 2025)} {m.phrase(2, 7)}</div>" if r.random() < 0.6 else ""
    side = f"<div><div>{m.phrase(1, 3)}</div>" + "".join(f"<div><a href=/x>{m.phrase(2, 7)}</a></div>" for _ in range(r.randint(2, 6))) + "</div>" if r.random() < 0.5 else ""
    return f"<body>{top}{article}{side}{end}</body>" if r.random() < 0.7 else f"<body><div>{top}<div>{article}{side}</div>{end}</div></body>"


def tables(m: Maker) -> str:
    """Layout by table cells."""
    r = m.r
    body = m.title() + m.flow(r.randint(2, 8), 0.15, 0.05)
    cell = f"<td{K}{r.choice(('', ' valign=top', ' width=80%'))}>{body}</td>"
    nav = f"<td{r.choice(('', ' width=20%', ' class=left'))}>{m.links(r.randint(2, 9), '<br>')}</td>"
    row = "<tr>" + (nav + cell if r.random() < 0.7 else cell + nav) + "</tr>"
    top = f"<tr><td colspan=2>{r.choice((m.phrase(1, 4), m.links(5, ' | ')))}</td></tr>" if r.random() < 0.6 else ""
    end = f"<tr><td colspan=2>{r.choice((m.phrase(3, 9), '&copy; ' + m.phrase(2, 5) + '.'))}</td></tr>" if r.random() < 0.6 else ""
    return f"<body><table{r.choice(('', ' border=0', ' class=layout'))}>{top}{row}{end}</table></body>"


def manual(m: Maker) -> str:
    """Reference pages: code, tables, definitions, headings; a table of contents beside."""
    r = m.r
    t = r.choice(("main", "main", "div", "article"))
    toc = f"<{(s := r.choice(('aside', 'nav', 'div')))}{m.attr(['toc', 'sidebar', 'menu', 'sphinxsidebar'], 1)}><ul>{m.links(r.randint(3, 12))}</ul></{s}>"
    crumbs = f"<{(s := r.choice(('ol', 'div', 'nav')))} class=breadcrumbs>{m.links(3, 'li' if s == 'ol' else ' &raquo; ')}</{s}>" if r.random() < 0.4 else ""
    body = f"<{t}{K}{m.attr(GOOD, 0.7 if t != 'div' else 1)}>{m.title(1)}{m.flow(r.randint(3, 14), 0.65, 0.02)}</{t}>"
    return (m.header() if r.random() < 0.5 else "") + crumbs + (toc + body if r.random() < 0.6 else body + toc) + (m.footer() if r.random() < 0.7 else "")


def blog(m: Maker) -> str:
    """A weblog theme: entry header, content, comments inside main."""
    r = m.r
    head = f'<header{K} class="entry-header">{m.title(1)}{m.byline()}</header>' if r.random() < 0.6 else m.title(1)
    entry = f'<div{K} class="{r.choice(("entry-content", "post-content", "content"))}">{m.flow(r.randint(2, 9))}</div>'
    post = f'<article{K}{r.choice((" class=post", "", " id=post-7"))}>{head}{entry}' + (f"<footer class=entry-footer>{m.links(2, ', ')} {m.phrase(1, 4)}</footer>" if r.random() < 0.4 else "") + "</article>"
    talk = m.comments() + (m.ask() if r.random() < 0.5 else "")
    t = r.choice(("main", "div"))
    return m.header() + m.around(f"<{t}{m.attr(['site-main', 'content-area', 'primary', 'main'], 0.7)}>{post}{talk}</{t}>", 1) + (m.side() if r.random() < 0.6 else "") + m.footer()


def named_oddly(m: Maker) -> str:
    """Article elements whose names say something else, and other ones with names of articles."""
    r = m.r
    t = r.choice(("div", "section", "section"))
    article = f"<{t}{K}{m.attr(MISLEADING, 1)}>{m.title()}{m.flow(r.randint(2, 9), 0.3, 0.04)}</{t}>"
    if r.random() < 0.3:
        article += f"<{t}{K}{m.attr(MISLEADING, 0.6)}><h2{K}>{m.phrase(1, 5)}</h2>{m.flow(r.randint(1, 5))}</{t}>"
    end = f"<footer><div{m.attr(GOOD, 1)}><p>{m.prose(1, 3)}</p></div></footer>" if r.random() < 0.5 else m.footer()
    return (m.header() if r.random() < 0.4 else "") + (m.menu() if r.random() < 0.6 else "") + m.around(article) + end


def news(m: Maker) -> str:
    """Several sections of text, pictures, boxes between them."""
    r = m.r
    parts = "".join(f"<section{K}{m.attr(NEUTRAL, 0.3)}>{f'<h2{K}>{m.phrase(2, 6)}</h2>' if r.random() < 0.6 else ''}{m.flow(r.randint(1, 4))}</section>" + (m.inside() if r.random() < 0.3 else "") for _ in range(r.randint(1, 4)))
    t = r.choice(("article", "main", "div"))
    return m.framed(m.around(f"<{t}{K}{m.attr(GOOD, 0.8)}>{m.title(1)}{m.byline()}{parts}</{t}>", 3), 0.6)


def parts(m: Maker) -> str:
    """An article in several unnamed parts that stand beside each other."""
    r = m.r
    t = r.choice(("section", "section", "div"))
    one = lambda: f"<{t}{K}{m.attr(NEUTRAL, 0.15)}>{f'<h2{K}>{m.phrase(1, 6)}</h2>' if r.random() < 0.8 else ''}{m.flow(r.randint(1, 3), 0.15, 0.03)}</{t}>"
    body = (m.title() if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(2, 6)))
    return (m.header() if r.random() < 0.4 else "") + (m.menu() if r.random() < 0.7 else "") + m.around(body, 1) + (m.side() if r.random() < 0.3 else "") + (m.footer() if r.random() < 0.7 else "")


def listing(m: Maker) -> str:
    """Articles that are mostly lists."""
    r = m.r
    items = "".join(f"<li{K}>{m.inline(m.prose(1, 2)) if r.random() < 0.7 else f'<p{K}>{m.prose(1, 2)}</p>'}</li>" for _ in range(r.randint(3, 9)))
    t = r.choice(("article", "div", "main"))
    return m.framed(f"<{t}{K}{m.attr(GOOD, 0.6)}>{m.title()}{m.paragraph()}<{(s := r.choice(('ol', 'ul')))}{K}>{items}</{s}>{m.paragraph() if r.random() < 0.5 else ''}</{t}>", 0.3)


FAMILIES = {f.__name__: f for f in (classic, plain_article, bare, fragment, unnamed, tables, manual, blog, named_oddly, news, parts, listing)}


def labelled_pages(each: int, seed: int, families=FAMILIES) -> list[str]:
    """`each` pages of every family."""
    pages = []
    for name in families:
        m = Maker(hash_of(name, seed))
        for _ in range(each):
            m.restyle()
            inner = FAMILIES[name](m)
            if name == "fragment":
                pages.append(inner)
                continue
            body = inner if inner.startswith("<body") else f"<body{m.attr(['home', 'single', 'page', 'theme-x'], 0.2)}>{inner}</body>"
            pages.append(m.r.choice(("<!DOCTYPE html><html><head><title>x</title></head>{}</html>", "<html>{}</html>", "{}")).replace("{}", body, 1) if "{}" not in body else body)
    return pages


def hash_of(name: str, seed: int) -> int:
    """The same in every process."""
    return sum(ord(c) * (i + 1) for i, c in enumerate(name)) * 1000 + seed
