"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its text blocks. Each block has features of its ancestors
(tags, words of their classes and ids) and of its text; neighbouring labels share a
transition score. Weights are trained by the gradient of the conditional likelihood
(forward-backward) on pages that are generated here with their labels, none of them real, and
Viterbi gives the labels of a page.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearfold.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math semantics mrow mi mn mo ms mtext mspace msub msup msubsup munder mover munderover mmultiscripts mprescripts none mfrac msqrt mroot mstyle merror "
    "mpadded mphantom menclose mfenced mtable mtr mtd maction annotation annotation-xml "
    "svg g path rect circle ellipse line polyline polygon text tspan textpath defs use image lineargradient radialgradient stop symbol marker desc".split()
)
SILENT = frozenset("head title script style noscript template desc annotation annotation-xml iframe select".split())
IN_HEAD = frozenset("title script style noscript template meta link base basefont bgsound html head".split())
IN_SELECT = frozenset("option optgroup script template hr".split())
CLOSED_BY = {  # an opening tag that ends an open one of the same kind
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"},
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SCOPE = frozenset("article aside body div footer header html main nav section table td th ul ol form".split())
_NAME_WORD = re.compile(r"[a-z]+")
_SILENT_END = re.compile(r"</(" + "|".join(sorted(SILENT, key=len, reverse=True)) + r")\b", re.IGNORECASE)


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # ancestors, outermost first
    names: frozenset[str]  # words of the ancestors' classes, ids and roles
    linked: int  # characters inside links


class _Blocks(HTMLParser):
    """Blocks of one page. What a silent element holds is left out only if it is closed somewhere: an element
    that is never closed is read as if it were not there, so that it cannot swallow the rest of the page."""

    def __init__(self, html: str = ""):
        super().__init__(convert_charrefs=True)
        self.ends = Counter(m.lower() for m in _SILENT_END.findall(html))
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = self.silent = 0
        self.quiet: list[str] = []  # silent elements that are open

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            names = frozenset().union(*(n for _, n in self.stack)) if self.stack else frozenset()
            self.found.append(Block(text, tuple(t for t, _ in self.stack if t not in INLINE), names, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.silent -= tag in self.quiet
            if tag in self.quiet:
                self.quiet.remove(tag)
            self.links -= tag == "a"

    def _close(self, kinds: frozenset[str] | set[str]) -> None:
        """End the innermost open tag of ``kinds`` unless a container opened since."""
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth][0]
            if tag in kinds:
                self._pop(depth)
                return
            if tag in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            if tag == "br":
                self.parts.append(" ")
                return
            self._flush()
        if tag in ("text", "mtr", "mtd"):
            self.parts.append(" ")
        if "head" in self.quiet and tag not in IN_HEAD:
            self._end("head")
        if "select" in self.quiet and tag not in IN_SELECT:
            self._end("select")
        if tag in ENDS_P:
            self._close({"p"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag])
        if tag in VOID:
            return
        words = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME_WORD.findall(v.lower()))
        self.stack.append((tag, words))
        if tag in SILENT and (tag == "head" or self.ends[tag] > 0):
            self.silent += 1
            self.quiet.append(tag)
        self.links += tag == "a"

    def _end(self, tag: str) -> None:
        """End the innermost open ``tag`` and all that opened in it."""
        self._flush()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._pop(depth)
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.ends[tag] -= 1
        if tag not in INLINE and tag != "br":
            self._flush()
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._pop(depth)
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end("head")
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """Text blocks of a page in order; scripts, styles, comments and the head have none. Broken markup is read as far as it goes.

    The head ends where anything begins that cannot be in it. Fallback text of objects, videos and drawings is text.
    """
    parser = _Blocks(html or "")
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.found


def features(page: Sequence[Block], i: int) -> list[str]:
    b = page[i]
    n = len(b.text)
    out = [f"in:{t}" for t in set(b.tags)] + [f"name:{w}" for w in b.names]
    out += [f"tag:{b.tags[-1] if b.tags else ''}", f"under:{'/'.join(b.tags[-2:])}", f"chars:{min(9, int(math.log2(n + 1)))}"]
    out += [f"linked:{min(4, 5 * b.linked // max(n, 1))}", f"end:{b.text[-1] in '.!?'}", f"mark:{b.text[0] in '©|»'}", "any"]
    out += [f"first:{i == 0}", f"last:{i == len(page) - 1}"]
    return out


@dataclass
class Crf:
    """Scores of (feature, label) as the score of label 1 over label 0, and of label pairs."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def scores(self, page: Sequence[Block]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in features(page, i)) for i in range(len(page))]

    def decode(self, page: Sequence[Block]) -> list[int]:
        """Viterbi: the most likely label sequence."""
        scores, best, back = self.scores(page), [0.0, 0.0], []
        for i, s in enumerate(scores):
            if i == 0:
                best = [0.0, s]
                continue
            step = [max((0, 1), key=lambda a, y=y: best[a] + self.pairs[a][y]) for y in (0, 1)]
            best = [best[step[y]] + self.pairs[step[y]][y] + s * y for y in (0, 1)]
            back.append(step)
        if not scores:
            return []
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def marginals(self, scores: Sequence[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of label 1 at each place, and the expected number of each pair of neighbours."""
        n, t = len(scores), [[math.exp(x) for x in row] for row in self.pairs]
        local = [(1.0, math.exp(min(s, 50.0))) for s in scores]
        forward, backward = [None] * n, [(1.0, 1.0)] * n
        for i, e in enumerate(local):
            f = e if i == 0 else tuple(sum(forward[i - 1][a] * t[a][y] for a in (0, 1)) * e[y] for y in (0, 1))
            z = f[0] + f[1]
            forward[i] = (f[0] / z, f[1] / z)
        for i in range(n - 2, -1, -1):
            b = tuple(sum(t[y][c] * local[i + 1][c] * backward[i + 1][c] for c in (0, 1)) for y in (0, 1))
            backward[i] = (b[0] / (b[0] + b[1]), b[1] / (b[0] + b[1]))
        ones, pairs = [], [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n):
            p = [forward[i][y] * backward[i][y] for y in (0, 1)]
            ones.append(p[1] / (p[0] + p[1]))
            if i:
                q = [[forward[i - 1][a] * t[a][y] * local[i][y] * backward[i][y] for y in (0, 1)] for a in (0, 1)]
                z = sum(map(sum, q))
                for a in (0, 1):
                    for y in (0, 1):
                        pairs[a][y] += q[a][y] / z
        return ones, pairs


def train(pages: Sequence[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.4, decay: float = 1e-5) -> Crf:
    """Maximum conditional likelihood by AdaGrad over labelled pages; the result depends on nothing but them."""
    model, seen, pair_seen = Crf(), defaultdict(float), [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(epochs):
        for page, labels in pages:
            if not page:
                continue
            named = [features(page, i) for i in range(len(page))]
            ones, pairs = model.marginals([sum(model.weights.get(f, 0.0) for f in fs) for fs in named])
            gradient = defaultdict(float)
            for fs, p, y in zip(named, ones, labels):
                for f in fs:
                    gradient[f] += y - p
            for f, g in gradient.items():
                g -= decay * model.weights.get(f, 0.0)
                seen[f] += g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-6)
            for a, y in zip(labels, labels[1:]):
                pairs[a][y] -= 1
            for a in (0, 1):
                for y in (0, 1):
                    pair_seen[a][y] += pairs[a][y] ** 2
                    model.pairs[a][y] -= rate * pairs[a][y] / math.sqrt(pair_seen[a][y])
    return model


# -- labelled pages --------------------------------------------------------------------


def _prose(r: Random, low: int, high: int) -> str:
    word = lambda: "".join(r.choice("aeiounrstlmdkp") for _ in range(r.randint(1, 9)))
    text = " ".join(word() for _ in range(r.randint(low, high)))
    style = r.random()
    if style < 0.15:
        return text.upper().replace(" ", "!! ") + "!!"
    return text.capitalize() + r.choice([".", ".", ".", "", "?", "!"])


def labelled_page(r: Random) -> tuple[str, list[str]]:
    """A page of a random layout and the blocks of its main text.

    Texts of the article and of what surrounds it come from the same distribution, from one
    word to long paragraphs, so that places in the tree and runs of labels must tell them apart.
    """
    main, html = [], []
    text = lambda low=1, high=25: _prose(r, low, high)
    link = lambda: f'<li><a href="#">{text(1, 3)}</a></li>'
    named = lambda *names: r.choice([f'class="{n}"' for n in names] + [f'id="{n}"' for n in names])

    def aside() -> str:
        kind = r.randrange(7)
        if kind == 0:
            return f"<div {named('ad', 'ads', 'advert', 'sponsored', 'banner', 'promo')}>{text()}</div>"
        if kind == 1:
            return f"<aside{r.choice(['', ' ' + named('sidebar', 'related', 'widget')])}><h3>{text(1, 4)}</h3><p>{text()}</p><ul>{link() * 3}</ul></aside>"
        if kind == 2:
            return f"<div {named('sidebar', 'related', 'share', 'social', 'breadcrumb', 'menu')}><p>{text()}</p><ul>{link() * 4}</ul></div>"
        if kind == 3:
            return f"<form {named('search', 'newsletter', 'login', 'subscribe')}><label>{text(1, 4)}</label><p>{text(1, 12)}</p><button>{text(1, 2)}</button></form>"
        if kind == 4:
            return f"<div {named('cookie notice', 'cookie-banner', 'notice', 'consent', 'alert', 'popup')}><p>{text()}</p><button>OK</button></div>"
        if kind == 5:
            return f"<section {named('comments', 'comment-list', 'discussion', 'replies')}><h2>{text(1, 3)}</h2>" + "".join(
                f"<div {named('comment', 'reply')}><p>{text()}</p></div>" for _ in range(r.randint(1, 5))
            ) + "</section>"
        return f"<nav><ul>{link() * r.randint(2, 7)}</ul></nav>"

    def article() -> str:
        out = []

        def put(tag: str, low: int = 1, high: int = 60) -> None:
            t = text(low, high)
            main.append(t)
            inner = r.choice(["{}", "{}", "<b>{}</b>", "<b>{}<br>", "<span>{}</span>", '<a href="#">{}</a>' if r.random() < 0.2 else "{}"])
            out.append(f"<{tag}>" + inner.format(t) + (f"</{tag}>" if tag != "p" or r.random() < 0.8 else ""))

        put(r.choice(["h1", "h1", "h2"]), 1, 12)
        for _ in range(r.choice([1, 1, 2, 3, 5, 9, 14])):
            kind = r.random()
            if kind < 0.75:
                put("p")
            elif kind < 0.82:
                put(r.choice(["h2", "h3"]), 1, 8)
            elif kind < 0.88:
                out.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    put("li", 1, 20)
                out.append("</ul>")
            elif kind < 0.93:
                put(r.choice(["blockquote", "pre", "figcaption"]), 1, 30)
            elif kind < 0.96:
                out.append(aside())
            else:
                out.append(f"<div>{text()}</div>")
                main.append(re.sub(r"</?div>", "", out[-1]))
        if r.random() < 0.15:
            out.append(f"<section {named('comments', 'discussion')}><p>{text()}</p></section>")
        return "".join(out)

    if r.random() < 0.5:
        html.append(f"<header><h2>{text(1, 4)}</h2><p>{text(1, 10)}</p></header>")
    html += [f"<nav><ul>{link() * r.randint(1, 7)}</ul></nav>"] + [aside() for _ in range(r.randint(0, 3))]
    opened = r.choice(["<article>"] * 4 + ["<main>", "<main><article>", f"<div {named('content', 'post', 'entry', 'article', 'main')}>"])
    html += [opened, article(), "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))]
    html += [aside() for _ in range(r.randint(0, 3))]
    html.append(f"<footer>{r.choice(['&copy; ', '', ''])}{text(1, 25)}</footer>")
    return f"<html><head><title>{text(1, 5)}</title></head><body>{''.join(html)}" + r.choice(["</body></html>", ""]), main


def labelled(seed: int, n: int) -> list[tuple[list[Block], list[int]]]:
    """``n`` labelled pages as blocks and labels."""
    r, out = Random(seed), []
    for _ in range(n):
        html, main = labelled_page(r)
        page, at, labels = blocks(html), 0, []
        for b in page:
            hit = at < len(main) and b.text == " ".join(main[at].split()) and not (b.names & {"ad", "comment", "comments", "discussion"})
            labels.append(int(hit))
            at += hit
        if at == len(main):
            out.append((page, labels))
    return out


@lru_cache(maxsize=4)
def default_model(seed: int = 7, n: int = 600) -> Crf:
    """The model trained on ``n`` labelled pages of ``labelled_page``; the same on every call."""
    return train(labelled(seed, n))


def main_text(html: str | None, model: Crf) -> str:
    """Blocks labelled as main text, in page order, with an empty line between them."""
    page = blocks(html)
    return "\n\n".join(b.text for b, y in zip(page, model.decode(page)) if y)


def extract(pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page, in one pass without a shuffle.

    A null or empty page, or one without main text, gives an empty text. Nulls in the id or
    url are passed on, repeated rows give repeated results, extra columns are not read.
    """
    model = model or default_model()
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column("html")]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = chosen.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema
    return chosen.mapInArrow(run, schema)
