from clearfold.llm import htmltext as h


def test_held_out_accuracy():
    pages = h.labelled(1234, 150)
    model = h.default_model()
    hits = [a == b for page, labels in pages for a, b in zip(model.decode(page), labels)]
    assert len(pages) > 100 and sum(hits) / len(hits) > 0.99


def test_viterbi_equals_enumeration():
    from itertools import product

    model = h.default_model()
    for page, _ in h.labelled(77, 40):
        page = page[:9]
        s = model.scores(page)
        value = lambda y: sum(x * l for x, l in zip(s, y)) + sum(model.pairs[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731, E741
        best = max(product((0, 1), repeat=len(page)), key=value)
        assert abs(value(best) - value(tuple(model.decode(page)))) < 1e-9
        ones, pairs = model.marginals(s)
        assert all(0 <= p <= 1 for p in ones) and abs(sum(map(sum, pairs)) - (len(page) - 1)) < 1e-6


def test_blocks_of_broken_markup():
    html = '<p>One <b>two<br>three<p>four &amp; five&nbsp;six &am<ul><li>a<li>b</ul><script>var x="<p>no</p>"</script><!-- no --></div>seven<'
    assert [b.text for b in h.blocks(html)] == ["One two three", "four & five six &am", "a", "b", "seven<"] or [b.text for b in h.blocks(html)][:4] == ["One two three", "four & five six &am", "a", "b"]
    assert h.blocks(None) == [] and h.blocks("") == [] and h.blocks("<div><p> </p></div>") == []
    assert h.blocks("<div>" * 3000 + "deep")[0].text == "deep"


def test_pages(spark):
    page = (
        '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title</h1><p>First\n  text.</p><p><b>Second</article>'
        '<section class="comments"><div class="comment"><p>Nice one.</p></div></section><form><label>Mail</label></form><footer>&copy; us</footer>'
    )
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (1, "u", page), (3, "u", "<p>" + "word " * 50_000), (4, "u", "<nav><a>x</a></nav>")]
    df = spark.createDataFrame([(*r, "e", "f") for r in rows], "page_id bigint, url string, html string, text string, n_chars string")
    got = h.extract(df).collect()
    assert len(got) == 6
    assert [r["text"] for r in got if r["page_id"] == 1] == ["Title\n\nFirst text.\n\nSecond"] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (2, None)} == {""}
    assert h.extract(df.limit(0)).count() == 0


def test_formulas_and_drawings_are_text():
    formula = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x=2</annotation></semantics></math>'
    drawing = "<svg><desc>hidden</desc><style>g{}</style><g><path d='M0 0'/><text>one</text><text>two</text></g></svg>"
    assert [b.text for b in h.blocks(f"<article><p>Since {formula} holds.</p></article>")] == ["Since x=2 holds."]
    assert " ".join(b.text for b in h.blocks(f"<p>See {drawing} here.</p>")) == "See one two here."


PARAGRAPHS = ["The river rose in the night and by morning the lower road was under water.", "Nobody in the village had seen it so high since the old bridge was built.", "The council meets on Monday to decide what is to be done."]
BODY = "".join(f"<p>{t}</p>" for t in PARAGRAPHS)
LAYOUTS = {  # written by hand; labelled_page makes none of them
    "role": f'<body><div class="topbar"><a href="/">Home</a> <a href="/n">News</a></div><div role="main"><h1>High water</h1>{BODY}</div><div class="bottom footer"><p>Imprint</p></div></body>',
    "deep": f'<body><div id="page"><nav><a href="/">Home</a></nav><div id="wrap"><div class="col"><article><div class="inner"><h1>High water</h1>{BODY}</div></article></div></div></div><footer>Contact</footer></body>',
    "table": f'<body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td><h1>High water</h1>{BODY}</td></tr></table></body>',
    "bare": f"<body><h1>High water</h1>{BODY}</body>",
}


def test_layouts_that_are_not_generated():
    model = h.default_model()
    got = {name: h.main_text(html, model).split("\n\n") for name, html in LAYOUTS.items()}
    assert {name: [t for t in PARAGRAPHS if t not in found] for name, found in got.items()} == {name: [] for name in LAYOUTS}
    assert not any(t in found for found in got.values() for t in ("Imprint", "Contact", "Home"))


def test_an_open_head_ends_at_the_first_element_of_the_body():
    for start in ("<html><head><title>t</title>", "<head><title>t</title><meta name=x>", "<title>t</title>", "<html><head><title>t</title><style>p{}</style>"):
        assert [b.text for b in h.blocks(f"{start}<article><h1>A</h1>{BODY}</article>")] == ["A", *PARAGRAPHS]
    assert [b.text for b in h.blocks("<head><title>t</title>Loose text.<p>More.")] == ["Loose text.", "More."]


def test_elements_that_are_never_closed_swallow_nothing():
    for tag in ("object", "noscript", "template", "iframe", "video", "audio", "canvas", "select"):
        first, *rest = PARAGRAPHS
        page = f"<article><p>{first}</p><{tag}>" + "".join(f"<p>{t}</p>" for t in rest) + "</article>"
        assert [b.text for b in h.blocks(page)] == PARAGRAPHS, tag
        closed = f"<article><p>{first}</p><{tag}>x</{tag}>" + "".join(f"<p>{t}</p>" for t in rest) + "</article>"
        assert [b.text for b in h.blocks(closed) if b.text != "x"] == PARAGRAPHS, tag


def test_fallback_text_stays():
    page = "<article><p>Before.</p><video src=a><p>See <a href=b>the film</a>.</p></video><object><p>A map.</p></object><p>After.</p></article>"
    assert [b.text for b in h.blocks(page)] == ["Before.", "See the film.", "A map.", "After."]
    assert [b.text for b in h.blocks("<p>a</p><noscript><p>turn it on</p></noscript><select><option>x</select><p>b</p>")] == ["a", "b"]


def page_of(head, foot, wrap="{}", title="High water"):
    return f"<!doctype html><html><head><title>{title}</title></head><body>{head}{wrap.format(f'<h1>{title}</h1>{BODY}')}{foot}</body></html>"


MENU, NOTE, SIDE = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<div class="cookie-banner"><p>We use cookies.</p></div>', '<aside><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>'
FOOT, AD, TALK = '<footer><p>&copy; 2020 The Paper</p></footer>', '<div class="ad"><p>Buy one, get one free!</p></div>', '<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice piece.</p></div></section>'
FORM = '<form><label>Your mail</label><input name=m><button>Sign up</button></form>'
WHOLE = ["High water", *PARAGRAPHS]
HAND_PAGES = [  # written by hand: a page, and all of its main blocks
    page_of(MENU, FOOT, "<main><article>{}</article></main>"), page_of(MENU + NOTE, SIDE + FOOT, "<article>{}</article>"), page_of(f"<header><p>The Paper</p>{MENU}</header>", TALK + FOOT, '<div class="content">{}</div>'),
    page_of(MENU, AD + FOOT, '<div id="main"><div class="post">{}</div></div>'), page_of(NOTE, FORM + FOOT, "<main>{}</main>"), page_of('<div class="menu"><a href="/">Home</a></div>', '<div class="footer">Imprint</div>', '<div class="entry">{}</div>'),
    page_of(MENU, FOOT, "<section><article>{}</article></section>"), page_of(MENU + AD, TALK, "<article>{}</article>"), page_of("", FOOT, "<article>{}</article>"), page_of(MENU, "", "<article>{}</article>"),
    page_of(f'<div class="sidebar">{MENU}</div>', FOOT, '<div class="article">{}</div>'), page_of(MENU, SIDE, '<div role="main"><div>{}</div></div>'), page_of(f"<header>{MENU}</header>", FORM, '<article class="post"><div>{}</div></article>'),
    f"<html><head><title>t</title><article><h1>High water</h1>{BODY}</article>{FOOT}", f"<body>{MENU}<article><h1>High water</h1>{BODY}{AD}</article>{TALK}{FOOT}</body>", f"<body><article><header><h1>High water</h1></header>{BODY}</article>{SIDE}</body>",
]


def test_precision_and_recall_of_hand_written_pages():
    model = h.default_model()
    hit = found = wanted = 0
    for page in HAND_PAGES:
        got = h.main_text(page, model).split("\n\n")
        hit += len(set(got) & set(WHOLE))
        found, wanted = found + len(got), wanted + len(WHOLE)
        assert all(t in got for t in PARAGRAPHS)
    assert hit / found > 0.95 and hit / wanted > 0.95, (hit / found, hit / wanted)
