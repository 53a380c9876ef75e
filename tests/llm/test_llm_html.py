"""Main text of pages written by hand, which no generator made."""

import pytest


def said(n, first=0):
    return " ".join(f"word{(i * 7 + first) % 97}" for i in range(n))


A, B, C = said(40), said(60, 3), said(30, 5)
PAGES = {
    "a bare body": (f"<body><p>{A}</p></body>", A),
    "neutral names": (f'<body><div class="xyz"><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></div><div class="q1"><p>{A}</p><p>{A}</p></div><div class="zz">© 2020 Some Company</div></body>', f"{A} {A}"),
    "a table for the layout": (f"<html><body><table><tr><td><a href=a>One</a><br><a href=b>Two</a><br><a href=c>Three</a></td><td><h1>Title here</h1><p>{B}<p>{C}</td></tr></table></body></html>", f"Title here {B} {C}"),
    "nested boxes": (f"<div><div><div>{said(120)}</div></div></div>", said(120)),
    "one short paragraph": (f"<p>{said(12)}</p>", said(12)),
    "text without blocks": (f"<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><h1>Hello there</h1>{A}<br><br>{C}<p>© 2021 Me</p>", f"Hello there {A} {C}"),
    "an old page": (f"<body><center><font size=2>{said(80)}</font></center></body>", said(80)),
    "lists in the text": (f"<body><header><h1>Site</h1></header><main><p>{C}</p><ul><li>{said(6)}</li><li>{said(8, 2)}</li></ul></main><footer>Legal stuff</footer></body>", f"{C} {said(6)} {said(8, 2)}"),
    "plain text": (f"<body><pre>{A}</pre></body>", A),
    "paragraphs of all lengths": (f'<html><body><div id="k1"><h2>A heading of it</h2><p>{said(25)}</p><p>{said(9)}</p><p>{said(70)}</p></div></body></html>', f"A heading of it {said(25)} {said(9)} {said(70)}"),
    "an article among the rest": (
        f"<body><nav><a href=/>Home</a><a href=/x>X</a></nav><div class=cookie-notice><p>We use cookies</p></div><article><h1>News</h1><p>{A}</p><div class=ad>Buy now</div><p>{C}</p></article>"
        "<section id=comments><div class=comment><p>First!</p></div></section><aside class=sidebar><h3>More</h3><ul><li><a href=1>a</a></li></ul></aside><footer>Imprint</footer></body>",
        f"News {A} {C}",
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    from tidelog.llm.html_text import main_texts, model

    page, want = PAGES[name]
    assert main_texts([page], model()) == [want]


def test_plain_shapes():
    """Invented pages whose names tell nothing, of other seeds than the training pages."""
    import random
    import re

    from tidelog.llm.html_text import main_texts, model, plain_page

    r = random.Random(99)
    pages = [plain_page(r) for _ in range(150)]
    exact = 0
    for page, text in zip(pages, main_texts(pages, model()), strict=True):
        exact += set(re.findall(r"Q[a-z]+", re.sub(r"<[^>]*>", " ", page))) == set(re.findall(r"\b[Qz][a-z]+", text))
    assert exact >= 0.93 * len(pages)
