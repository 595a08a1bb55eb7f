"""Pages written by hand in four languages: articles in wrappers of unseen, meaningless or no classes, alone, with bylines, captions, tables and short lines."""

import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import html_extract  # noqa: E402

#: title, byline, three paragraphs, caption, table head and cells, menu, footer, advert
WORDS = {
    "en": (
        "A bridge for the town", "By Jane Miller, 4 May 2023",
        ("The old bridge over the river had been closed for two winters when the council voted to rebuild it.", "Work began in April, and by the end of summer the first cars crossed again.", "Shopkeepers on both banks say that trade has doubled since then, and the ferry has been sold."),
        "The new bridge seen from the mill", ("Year", "Crossings", "2021", "12 000"), ("Home", "News", "Contact", "About us"), "© 2024 Town Gazette. All rights reserved.", "Buy now and save 50%",
    ),
    "de": (
        "Eine Brücke für die Stadt", "Von Hanna Weber, 4. Mai 2023",
        ("Die alte Brücke über den Fluss war zwei Winter lang gesperrt, bevor der Rat beschloss, sie neu zu bauen.", "Die Arbeiten begannen im April, und am Ende des Sommers fuhren wieder die ersten Wagen hinüber.", "Die Händler auf beiden Ufern sagen, dass sich der Umsatz seither verdoppelt hat."),
        "Die neue Brücke von der Mühle aus", ("Jahr", "Fahrten", "2021", "12 000"), ("Startseite", "Kontakt", "Impressum", "Archiv"), "© 2024 Stadtblatt. Alle Rechte vorbehalten.", "Jetzt kaufen und sparen",
    ),
    "fr": (
        "Un pont pour la ville", "Par Anne Martin, 4 mai 2023",
        ("Le vieux pont sur la rivière était fermé depuis deux hivers quand le conseil a voté sa reconstruction.", "Les travaux ont commencé en avril, et à la fin de l'été les premières voitures passaient de nouveau.", "Les marchands des deux rives disent que les ventes ont doublé depuis ce jour."),
        "Le nouveau pont vu du moulin", ("Année", "Passages", "2021", "12 000"), ("Accueil", "Actualités", "Contactez-nous", "À propos"), "© 2024 Gazette. Tous droits réservés.", "Achetez maintenant",
    ),
    "es": (
        "Un puente para el pueblo", "Por Ana Ruiz, 4 de mayo de 2023",
        ("El puente viejo sobre el río llevaba dos años cerrado cuando el pueblo votó por hacerlo de nuevo.", "Las obras empezaron en abril, y al final del verano pasaron otra vez los primeros coches.", "Los comerciantes de las dos orillas dicen que las ventas se han doblado desde entonces."),
        "El puente nuevo visto desde el molino", ("Año", "Pasos", "2021", "12 000"), ("Inicio", "Noticias", "Contacto", "Acerca de"), "© 2024 Gaceta. Todos los derechos reservados.", "Compra ahora",
    ),
}


def menu(of, tag="nav", item="a"):
    return f"<{tag}>" + " ".join(f"<{item} href='/{k}'>{w}</{item}>" for k, w in enumerate(of)) + f"</{tag.split()[0]}>"


def listed(of, tag="nav"):
    return f"<{tag}><ul>" + "".join(f"<li><a href='/{k}'>{w}</a></li>" for k, w in enumerate(of)) + f"</ul></{tag.split()[0]}>"


def framed(shell):
    """A menu, one box of the class with a heading and paragraphs, and a footer."""
    return lambda t, by, ps, cap, cells, nav, foot, ad: (f"{listed(nav)}<div{shell}><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</div><footer>{foot}</footer>", [t, *ps])


def post_body(t, by, ps, cap, cells, nav, foot, ad):
    return f"<div class='top-links'>{menu(nav, 'div')}</div><div class='post-body'><p>{ps[0]}</p><p>{ps[1]}</p></div><footer><p>{foot}</p></footer>", list(ps[:2])


def alone(t, by, ps, cap, cells, nav, foot, ad):
    return f"<html><body><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</body></html>", [t, *ps]


def byline(t, by, ps, cap, cells, nav, foot, ad):
    return f"{menu(nav)}<article><header><h1>{t}</h1><p class='byline'>{by}</p></header>" + "".join(f"<p>{p}</p>" for p in ps) + f"</article><div class='ad'>{ad}</div><footer>{foot}</footer>", [t, by, *ps]


def figure_and_table(t, by, ps, cap, cells, nav, foot, ad):
    table = f"<table><tr><th>{cells[0]}</th><th>{cells[1]}</th></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>"
    return f"<div id='wrapper'>{listed(nav)}<main><h1>{t}</h1><p>{ps[0]}</p><figure><img src=x><figcaption>{cap}</figcaption></figure><p>{ps[1]}</p>{table}</main><footer>{foot}</footer></div>", [t, ps[0], cap, ps[1], *cells]


def wrapped_twice(t, by, ps, cap, cells, nav, foot, ad):
    return f"<div class='site'><div class='qx7 zz-lorum'>{listed(nav, 'div class=mnu')}<div class='story'><div class='inner'><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</div></div><div class='bottom'><p>{foot}</p></div></div></div>", [t, *ps]


def meaningless(t, by, ps, cap, cells, nav, foot, ad):
    return f"<body>{menu(nav, 'div class=a1b')}<div class=k9x><h1>{t}</h1><p>{ps[0]}</p><p>{ps[1]}</p></div><div class=v2>{ad}</div><div class=zq>{foot}</div></body>", [t, *ps[:2]]


LAYOUTS = {f"class {c}": framed(f" class='{c}'") for c in ("container", "page", "text", "story", "xk3f", "wrapper", "content", "hauptspalte")}
LAYOUTS |= {"no class": framed(""), "post body": post_body, "alone": alone, "byline": byline, "figure and table": figure_and_table, "wrapped twice": wrapped_twice, "meaningless classes": meaningless}


@pytest.mark.parametrize("lang", WORDS)
@pytest.mark.parametrize("layout", LAYOUTS)
def test_page(layout, lang):
    page, want = LAYOUTS[layout](*WORDS[lang])
    assert html_extract.label([page], html_extract.model())[0].split("\n") == want


def test_a_menu_word_in_an_article_stays():
    title, _, ps, *_ = WORDS["en"]
    page = f"<nav><a href=/>Home</a></nav><article><h1>{title}</h1><p>{ps[0]}</p><h2>Subscribe</h2><p>{ps[1]}</p></article><footer>© 2024</footer>"
    assert html_extract.label([page], html_extract.model()) == ["\n".join([title, ps[0], "Subscribe", ps[1]])]
