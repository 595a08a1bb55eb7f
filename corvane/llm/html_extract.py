"""Main text of web pages by a recurrent block labeller.

A page is read into its sequence of text blocks (see :mod:`corvane.llm.htmlblocks`).  Each block becomes a vector: its
tag path, the innermost elements and their class and id words apart from the outer ones, and its words, each hashed into
places, and a few measures (length, share of links, marks, place in the page).  Words that training does not know have no
place: a class that nobody has seen says nothing, rather than what another one says.  A bidirectional LSTM
in numpy reads the whole sequence from both ends and gives every block the chance that it belongs to the article.

The labeller is trained in the driver on TRAIN_PAGES pages that :func:`example_page` writes with a fixed seed: articles in
many kinds of markup among menus, headers, footers, sidebars, notices, adverts, forms and comments, or alone, of which
each block's label is known.  On many pages classes tell nothing: articles stand in wrappers of any or no name, whole pages have
meaningless classes, or all tags are plain divs; what the parts are then shows in their words, links and place.  The model
does not depend on the table.

Defined cases: a null or empty page, or one without article blocks, gives the empty string; unclosed, misnested and
truncated markup is read as far as it goes; pages and blocks of any length are read whole; repeated rows are labelled
alike; a null page_id or url is carried through; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches
from corvane.llm.htmlblocks import Block, blocks
from corvane.llm.lstm import BiLstm, padded

#: Places that path words and text words are hashed into (only those that known words fill are kept), and measures.
PATHS, WORDS, MEASURES = 4096, 8192, 14
TRAIN_PAGES, HELD_PAGES, ROUNDS, KEEP_FROM = 4000, 300, 10, 0.5
#: Blocks that are labelled side by side; a longer page is labelled alone.
TOGETHER = 20_000

#: Tags that say what a part of a page is.
_SPEAKING = re.compile(r"<(/?)(?:article|main|section|aside|nav|header|footer|form|div|p|h[1-6]|blockquote|label|button)\b[^>]*>")

#: What stands in the parts of a page that are not its article, in four languages.
PHRASES = {
    "nav": "Home;News;About us;Contact;Sports;Business;Archive;Sign in;Products;Blog;Startseite;Über uns;Kontakt;Impressum;Accueil;À propos;Contactez-nous;Inicio;Noticias;Contacto;Acerca de;Services;Shop;Help;Topics",
    "notice": "We use cookies to improve your experience.;Accept all cookies;Subscribe to our newsletter for daily updates.;Sign up for our newsletter;This site uses cookies. Read our privacy policy.;Get unlimited access: subscribe now.;Wir verwenden Cookies auf dieser Website.;Newsletter abonnieren;Nous utilisons des cookies.;Abonnez-vous à notre newsletter;Usamos cookies en este sitio.;Suscríbete a nuestro boletín;Please enable JavaScript to continue.;Turn off your ad blocker;Cookie settings",
    "ad": "Advertisement;Sponsored content;Buy now and save 50%;Click here for a special offer;Limited time offer: free shipping on all orders;Anzeige;Jetzt kaufen;Publicité;Achetez maintenant;Publicidad;Compra ahora;Promoted by our partners;Shop the sale today",
    "side": "Related articles;Most read;Trending now;You may also like;Share this article;Follow us on social media;Popular posts;Recommended for you;Read more;Ähnliche Beiträge;Meistgelesen;Teilen;Articles similaires;Les plus lus;Partager;Artículos relacionados;Lo más leído;Compartir;Tags: politics, economy;Share on Facebook;Tweet this",
    "form": "Search;Email address;Password;Log in;Submit;Your name;Send message;Suche;Anmelden;Absenden;Rechercher;Se connecter;Envoyer;Buscar;Iniciar sesión;Enviar;Remember me;Enter your email;Register",
    "footer": "© 2024 All rights reserved.;Privacy policy;Terms of service;Terms and conditions;Cookie policy;Copyright 2023;Alle Rechte vorbehalten;Datenschutz;Impressum;Tous droits réservés;Mentions légales;Todos los derechos reservados;Aviso legal;Powered by our platform;Contact us;Site map",
    "comment": "Great post, thanks for sharing!;I totally agree with you.;Thanks, this helped me a lot;First!;Reply;Leave a comment;3 comments;Comments;Kommentare;Toller Artikel, danke!;Commentaires;Merci pour cet article !;Comentarios;Gracias por compartir;Log in to comment;Anna says: nice one;posted 2 days ago",
}
#: Common words of articles in the same languages.
PROSE = (
    "the of and to in that was for with on as by from had were which their more after two when year said he she it they but not would one been has have its new over who out about into than last could first people time when city water house work found long under "
    "der die und das von mit den ist nicht ein eine auf dem des sich wurde war als auch nach bei aus wird haben jahr sein durch werden zum über "
    "le la les des et une est que dans pour qui par sur au avec plus ne se ce sont été il elle ont cette mais deux comme son "
    "el los las una que del por con para como más pero sus este entre ser era cuando sobre también hasta desde todo años fue "
    "a is be this our your all we you are now no more up here only "
    "auf dieser wir im am für an "
    "à de un nous notre vous tous cet du "
    "y en tu nuestro a lo todos"
).split()


#: Class and id words of parts of a page, by kind, and of wrappers, which can hold anything.
CLASSES = {
    "article": "content post-content article-body entry-content article post entry body-copy post-body main-text story-body article-text",
    "ad": "ad ads advert advertisement sponsored promo banner ad-slot",
    "notice": "cookie-banner cookie-notice consent notice gdpr newsletter popup alert subscribe paywall",
    "side": "sidebar related widget side recommended trending share social author-bio tags",
    "comment": "comments comment-list discussion responses disqus-thread comment reply comment-body comment-item",
    "nav": "menu navbar breadcrumb nav navigation breadcrumbs topbar",
    "header": "site-header header masthead logo site-title brand",
    "footer": "footer site-footer",
    "form": "search newsletter login signup",
    "byline": "byline author meta dateline caption",
    "wrap": "container wrapper page text story inner row col site root app body box section block main-column center left wrap outer area layout grid",
}
TAGS = (
    "html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre figure figcaption form label button "
    "select option fieldset address details summary b strong em i a span br"
).split()


def _kept(words: set[str], places: int, salt: str) -> dict[str, int]:
    """The columns of known words: the places that they are hashed into, in order."""
    hashed = {w: zlib.crc32(f"{salt}{w}".encode("utf-8", "surrogatepass")) % places for w in words}
    column = {h: k for k, h in enumerate(sorted(set(hashed.values())))}
    return {w: column[h] for w, h in hashed.items()}


def _plain(word: str) -> str:
    return word.lower().strip(".,:;!?()\"'")


PATH = _kept({*TAGS, *(f".{w}" for names in CLASSES.values() for name in names.split() for w in name.split("-")), ".dialog", ".main"}, PATHS, "path ")
WORD = _kept({_plain(w) for of in [*PHRASES.values(), " ".join(PROSE)] for w in of.replace(";", " ").split()} - {""}, WORDS, "")
NEAR = FAR = max(PATH.values()) + 1
WIDTH = NEAR + FAR + max(WORD.values()) + 1 + MEASURES
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def vectors(found: list[Block], texts: list[str]) -> np.ndarray:
    """One row for each block of a page."""
    out = np.zeros((len(found), WIDTH), np.float32)
    paths: dict[tuple[str, ...], np.ndarray] = {}
    for k, (b, t) in enumerate(zip(found, texts, strict=True)):
        if b.path not in paths:
            v = np.zeros(NEAR + FAR, np.float32)
            v[[PATH[w] for w in b.path[-3:] if w in PATH]] = 1
            v[[NEAR + PATH[w] for w in b.path if w in PATH]] = 1
            paths[b.path] = v
        row = out[k]
        row[: NEAR + FAR] = paths[b.path]
        words = t.split()
        known = [WORD[w] for w in map(_plain, words) if w in WORD]
        if known:
            np.add.at(row, np.array(known) + NEAR + FAR, 1)
            part = row[NEAR + FAR : -MEASURES]
            part /= np.sqrt(part @ part)
        n, m = max(1, len(t)), max(1, len(words))
        stops = t.count(". ") + t.count("! ") + t.count("? ") + (t[-1:] in ".!?")
        row[-MEASURES:] = (
            np.log1p(len(words)) / 5, min(1.0, b.linked / n), min(1.0, 5 * (t.count(".") + t.count(",")) / m), float(t[-1:] in ".!?"),
            k / len(found), 1 / (1 + k), 1 / (len(found) - k), float("©" in t),
            np.log1p(stops) / 3, min(1.0, n / m / 12), float(b.path[-1:] != () and not _HEADING.isdisjoint(b.path[-3:])), len(known) / m, np.log1p(len(found)) / 5, float(len(words) >= 8 and b.linked < n / 2),
        )
    return out


def example_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the labels of its blocks, in page order."""
    pick = lambda *xs: xs[r.randrange(len(xs))]
    maybe = lambda p: r.random() < p
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    word = lambda: "".join(r.choices(letters, k=r.randrange(1, 9)))
    true_words, bare, alone, wrapped = r.random() < 0.6, r.random() < 0.25, r.random() < 0.1, r.random() < 0.45
    unnamed = not bare and r.random() < 0.3  # classes say nothing
    told = bare or unnamed  # only words tell what the parts are
    speaks = told or r.random() < 0.5
    any_word = lambda: r.choice(PROSE) if true_words and r.random() < 0.6 else word()
    between = lambda: pick(" | ", " | ", " * ", " # ", " - ", "!! ") if maybe(0.08) else " "
    some = lambda a, b: between().join(any_word() + (pick(".", ",", "") if maybe(0.15) else "") for _ in range(r.randrange(a, b))) or word()
    sentence = lambda a=4, b=40: some(a, b).rstrip(".,").capitalize() + pick(".", ".", "")
    html: list[str] = []
    labels: list[int] = []

    def say(kind: str, otherwise: str) -> str:
        """What a part of the page says: its phrases, on a page without classes always, else on half of the pages."""
        of = PHRASES[kind].split(";")
        return r.choice(of) + (" " + r.choice(of) if maybe(0.15) else "") if told or speaks and maybe(0.8) else otherwise

    def put(markup: str, *of: int) -> None:
        html.append(markup)
        labels.extend(of)

    def links(tag: str, cls: str) -> None:
        n = r.randrange(1, 8)
        if maybe(0.7):
            put(f"<{tag}{cls}><ul>" + "".join(f'<li><a href="/{i}">{say("nav", some(1, 4))}</a></li>' for i in range(n)) + f"</ul></{tag}>", *[0] * n)
        else:
            put(f"<{tag}{cls}>" + pick(" | ", " ").join(f'<a href="/{i}">{say("nav", some(1, 3))}</a>' for i in range(n)) + f"</{tag}>", 0)

    def cls(kind: str) -> str:
        if unnamed:
            return pick("", f' class="{word()}"', f' class="{word()} {word()}-{word()}"')
        return f' {pick("class", "class", "id")}="{pick(*CLASSES[kind].split())}{pick("", "", "", " " + word())}"'

    def wrapper() -> str:
        return f'div{pick("", pick(" class", " class", " id") + chr(61) + chr(34) + pick(pick(*CLASSES["wrap"].split()), pick(*CLASSES["wrap"].split()), word()) + chr(34))}'

    def box(tag: str, attrs: str, head: float = 0.4, most: int = 4, kind: str = "side") -> None:
        n = r.randrange(1, most)
        inner, own = "", 0
        if maybe(head):
            inner, own = f"<h{pick(2, 3, 4)}>{say(kind, some(1, 6))}</h{3}>", 1
        if maybe(0.35):
            inner += "<ul>" + "".join(f"<li>{pick('<a href=x>' + say(kind, some(1, 6)) + '</a>', say(kind, sentence(2, 20)))}</li>" for _ in range(n)) + "</ul>"
        elif maybe(0.7):
            inner += "".join(f"<p>{say(kind, sentence(3, 30))}</p>" for _ in range(n))
        else:
            inner, n = inner + f"<div>{say(kind, sentence(2, 25))}</div>", 1
        put(f"<{tag}{attrs}>{inner}</{tag}>", *[0] * (own + n))

    def one_ad() -> None:
        put(f"<div{cls('ad')}>{say('ad', sentence())}</div>", 0) if maybe(0.7) else box(pick("div", "section"), cls("ad"), kind="ad")

    def notice() -> None:
        box("div", cls("notice") + pick("", ' role="dialog"'), 0.2, 3, "notice")

    def form() -> None:
        put(f"<form{pick('', cls('form'))}><label>{say('form', some(1, 4))}</label><input name=q><button>{say('form', some(1, 3))}</button></form>", 0, 0) if maybe(0.8) else put(f"<form><select>" + "".join(f"<option>{say('form', some(1, 3))}</option>" for _ in range(3)) + "</select></form>", 0, 0, 0)

    def sidebar() -> None:
        box("aside", pick("", cls("side")), 0.7) if maybe(0.6) else box("div", cls("side"), 0.7)

    def comments() -> None:
        n, parts, own = r.randrange(1, 5), "", 0
        for _ in range(n):
            if maybe(0.5):
                parts += f"<{(t := pick('div', 'article', 'li'))}{cls('comment')}><p>{say('comment', sentence(3, 30))}</p></{t}>"
                own += 1
            else:
                parts += f"<div{cls('comment')}><b>{word()}</b>: {say('comment', sentence(3, 30))}</div>"
                own += 1
        tag = pick("section", "div", "div")
        head = maybe(0.6)
        put(f"<{tag}{cls('comment')}>" + (f"<h3>{say('comment', some(1, 3))}</h3>" if head else "") + parts + f"</{tag}>", *[0] * (own + head))

    put(f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>")
    around = r.randrange(1, 3) if wrapped else 0
    for _ in range(around):
        put(f"<{wrapper()}>")
    if not alone and maybe(0.3):
        notice()
    if not alone and maybe(0.45):
        inner = f"<div{cls('header')}>{some(1, 4)}</div>" if maybe(0.5) and not told else f"<h1>{some(1, 4)}</h1>" if maybe(0.4) and not told else f"<p>{say('nav', some(1, 8))}</p>"
        put(f"<header{pick('', cls('header'))}>{inner}", 0)
        if maybe(0.6):
            links("nav", "")
        put("</header>")
    if not alone and maybe(0.75):
        links("nav", pick("", cls("nav"))) if maybe(0.7) else links("div", pick("", cls("nav")) if told else cls("nav"))
    for _ in range(0 if alone else r.randrange(0, 3)):
        pick(one_ad, one_ad, notice, sidebar, form)()
    shell = pick("article", "article", "main", "main><article", "main", f"div{cls('article')}", f"div{cls('article')}", 'div role="main"', f"section{cls('article')}", "body", wrapper(), wrapper(), wrapper(), f"{wrapper()}><{wrapper()}")
    tags = [x.split()[0] for x in shell.split("><")] if shell != "body" else []
    put("".join(f"<{x}>" for x in shell.split("><")) if tags else "")
    owned = not bare and tags and tags[-1] in ("article", "main")  # what stands in such a tag belongs to it
    elsewhere = lambda: pick(*PHRASES[pick("nav", "form", "side", "footer", "footer")].split(";"))  # noqa: E731  # a line that would be a menu or footer elsewhere
    low = 6 if bare else 1  # on a page of plain divs a word or two alone could be anything
    byline = lambda: f"{pick('By ', 'by ', 'Von ', 'Par ', 'Por ', '')}{some(2, 4).title()}{pick('', ', 3 May 2024', ' · 12.04.2023', ' | 2022-01-30')}"
    if maybe(0.8):
        title = f"<h{pick(1, 1, 2)}>{elsewhere() if owned and maybe(0.06) else some(low, 10)}</h1>"
        if maybe(0.25) and not bare:
            mark = pick("p", "p", "div", "span")
            under = f"<{mark}{pick('', cls('byline'))}>{byline()}</{mark}>"
            put(f"<header>{title}{under}</header>" if maybe(0.5) and tags else title + under, 1, 1)
        else:
            put(f"<header>{title}</header>" if maybe(0.15) and tags else title, 1)
    for _ in range(r.randrange(1, 9) if maybe(0.8) else r.randrange(9, 45)):
        kind = r.random()
        if kind < 0.68:
            text = sentence(low, 70) if maybe(0.85) or bare else sentence(1, 3)
            text = text.upper() if maybe(0.04) else text
            if maybe(0.2):
                text = f"{pick('<b>', '<em>', '<a href=x>', '<span>')}{some(1, 5)}{pick('</b>', '</em>', '</a>', '</span>', '')} {text}"
            put(f"<p>{text}{pick('</p>', '</p>', '', '<br>')}", 1)
        elif kind < 0.76:
            put(f"<h{pick(2, 3)}>{some(low, 9)}</h2>", 1)
        elif kind < 0.82:
            n = r.randrange(1, 4)
            put(f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>{sentence(low, 20)}</li>" for _ in range(n)) + f"</{t}>", *[1] * n)
        elif kind < 0.86:
            put(f"<blockquote>{sentence()}</blockquote>", 1) if maybe(0.5) else put(f"<pre>{some(low, 14)}</pre>", 1)
        elif kind < 0.89:
            wide, deep, head = r.randrange(1, 4), r.randrange(1, 4), maybe(0.6)
            cells = lambda t: "<tr>" + "".join(f"<{t}>{some(low, low + 3)}</{t}>" for _ in range(wide)) + "</tr>"
            put("<table>" + (cells("th") if head else "") + "".join(cells("td") for _ in range(deep)) + "</table>", *[1] * (wide * (deep + head)))
        elif kind < 0.905:
            put(f"<figure><img src=x><figcaption>{some(max(2, low), 16)}</figcaption></figure>", 1)
        elif kind < 0.912 and not bare:
            put(f"<dl><dt>{some(1, 4)}</dt><dd>{sentence()}</dd></dl>", 1, 1)
        elif kind < 0.92 and owned:
            put(f"<{(t := pick('p', 'p', 'h2', 'h3'))}>{elsewhere()}</{t}>", 1)
        elif kind < 0.95 or alone:
            put(f"<div>{sentence()}</div>", 1)
        else:
            pick(one_ad, sidebar, form, notice)()
    if owned and maybe(0.2):
        put(f"<p>{elsewhere()}</p>", 1)
    if tags and not alone and maybe(0.1):
        comments()
    put("".join(f"</{x}>" for x in reversed(tags)))
    for _ in range(0 if alone else r.randrange(0, 3)):
        pick(one_ad, sidebar, notice, form)()
    if not alone and maybe(0.4):
        comments()
    if not alone and maybe(0.8):
        foot = pick("footer", "footer", f"div{cls('footer')}", f"div{cls('footer')}")
        if maybe(0.7):
            put(f"<{foot}>{pick('&copy; ', '', '2024 ')}{word()}.example.com {pick('&middot; ', '')}{say('footer', sentence(2, 25))}</{foot.split()[0]}>", 0)
        else:
            put(f"<{foot}>")
            links("div", "")
            put(f"<p>{say('footer', sentence(2, 20))}</p></{foot.split()[0]}>", 0)
    put("</div>" * around)
    page = "".join(html) + pick("</body></html>", "")
    if bare:  # no tag or class tells what a part is
        page = _SPEAKING.sub(lambda m: f"<{m[1]}div>", page)
    return page, labels


def examples(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    r, xs, ys = random.Random(seed), [], []
    while len(xs) < n:
        page, labels = example_page(r)
        found = blocks(page)
        if found and len(found) == len(labels):  # a page whose broken markup moves its blocks has no known labels
            xs.append(vectors(found, [b.text() for b in found]))
            ys.append(np.array(labels, float))
    return xs, ys


_model: list[BiLstm] = []


def model() -> BiLstm:
    """The labeller, trained once in a driver."""
    if not _model:
        xs, ys = examples(TRAIN_PAGES, 1)
        _model.append(BiLstm(WIDTH).fit(xs, ys, ROUNDS))
    return _model[0]


def label(pages: list[str | None], lstm: BiLstm) -> list[str]:
    """The main text of each page.  Pages of like length are labelled side by side."""
    found = [blocks(p or "") for p in pages]
    texts = [[b.text() for b in f] for f in found]
    out, order, k = [""] * len(pages), sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i])), 0
    while k < len(order):
        j = k
        while j < len(order) and (j == k or (j - k + 1) * len(found[order[j]]) <= TOGETHER):
            j += 1
        own = order[k:j]
        x, mask = padded([vectors(found[i], texts[i]) for i in own])
        for row, i in zip(lstm.chance(x, mask), own, strict=True):
            out[i] = "\n".join(t for t, c in zip(texts[i], row) if c >= KEEP_FROM)
        k = j
    return out


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    bounded_batches(pages.sparkSession)
    lstm = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = label(b.column(2).to_pylist(), lstm)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
