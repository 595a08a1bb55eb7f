"""Pages written by hand, some of plain divs, and what their article is."""

import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import html_extract  # noqa: E402

A = "The old bridge over the river had been closed for two winters when the council voted to rebuild it."
B = "Work began in April, and by the end of summer the first cars crossed again."
C = "Shopkeepers on both banks say that trade has doubled since then."
PAGES = {
    "plain divs": (f"<body><div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/c'>Contact</a></div><div>{A}</div><div>{B}</div><div>Subscribe to our newsletter for daily updates.</div><div>© 2024 Town Gazette. All rights reserved.</div></body>", [A, B]),
    "plain divs, Spanish": ("<body><div><a href='/'>Inicio</a> <a href='/n'>Noticias</a></div><div>El puente viejo sobre el río llevaba dos años cerrado cuando el pueblo votó por hacerlo de nuevo.</div><div>Todos los derechos reservados</div></body>", ["El puente viejo sobre el río llevaba dos años cerrado cuando el pueblo votó por hacerlo de nuevo."]),
    "formula": ("<nav><a href=/>Home</a></nav><article><h1>Laws</h1><p>The law <math><mi>a</mi>+<mi>b</mi></math> holds for all.</p></article><footer>&copy; x</footer>", ["Laws", "The law a+b holds for all."]),
    "article and aside": (f"<header><a href=/>Town</a></header><article><h1>The bridge</h1><p>{A}</p><p>{B}</p></article><aside><h3>Related articles</h3><ul><li><a href=/1>One</a></li></ul></aside>", ["The bridge", A, B]),
    "main and comments": (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><main><h1>The bridge</h1><p>{A}</p><p>{C}</p></main><div class='comments'><h3>3 comments</h3><div class='comment'><p>Great post, thanks for sharing!</p></div></div>", ["The bridge", A, C]),
    "notice in front": (f"<div class='cookie-banner'><p>We use cookies to improve your experience.</p></div><div class='content'><h1>The bridge</h1><p>{A}</p></div><footer><p>Privacy policy</p></footer>", ["The bridge", A]),
    "advert between": (f"<article><p>{A}</p><div class='ad'>Buy now and save 50%</div><p>{B}</p></article>", [A, B]),
    "form after": (f"<article><h1>The bridge</h1><p>{A} {B}</p></article><form class=search><label>Search</label><button>Submit</button></form>", ["The bridge", f"{A} {B}"]),
    "list in article": (f"<article><h1>What changed</h1><p>{A}</p><ul><li>The deck is new.</li><li>The piers are old.</li></ul></article><footer>© 2024</footer>", ["What changed", A, "The deck is new.", "The piers are old."]),
    "references and spaces": (f"<article><p>Fish &amp; chips\n  &lt;here&gt;&nbsp;since 1920, when the &quot;boat&quot; came.</p><p>{B}</p></article><footer>&copy; 2024</footer>", ['Fish & chips <here> since 1920, when the "boat" came.', B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_extract.label([page], html_extract.model()) == ["\n".join(want)]


def test_a_very_long_page_is_read_whole():
    text = " ".join(f"the word number{k} of the long story of the town" for k in range(20_000))
    assert html_extract.label([f"<nav><a href=/>Home</a></nav><article><p>{text}</p></article><footer>© x</footer>"], html_extract.model()) == [text]
