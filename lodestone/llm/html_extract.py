"""Main-text extraction by a tree-structured graphical model over the DOM.

A page's block elements and its runs of text are the nodes of a tree; each is content or not. An element's potential is
linear in its tag, the words of its class, id and role and their four-letter pieces, its text and link lengths and its
share of the page's text; a run's in its own length, links and signs. An edge's potential favours equal labels, as
strongly as the child's tag says, and has a term for the parent by the child's tag and words, so that a part which is
surely no content says nothing against what it stands in. Sum-product messages go up from the leaves and down from the
root, and a run is kept where its marginal of content is at least one half. Weights are fitted by exact maximum likelihood
on labelled pages; ``labelled_pages`` draws such pages from many layouts, and others can be given.

Inside a block, character references are decoded, white space becomes one space; blocks are joined in page order
by a line feed. ``br`` counts as white space. Scripts, styles, comments, the head and form controls hold no text.

Edge cases: a null or empty page, or one without content, gives an empty text; unclosed and stray tags are read as
browsers do for paragraphs, list items and table parts; a page cut off within a tag loses that tag only; repeated
rows each get their row; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import ship, tidied

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "select", "object", "math", "canvas")}
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes, up to the elements that bound the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SILENT = frozenset(("head", "button"))
#: Elements of any purpose, of which the size of their text says something.
SIZED = frozenset("#root article body center div main section table".split())
TAGS = {t: i for i, t in enumerate(sorted(BLOCKS | {"#root", "#text"} | {f"#text:{t}" for t in (*SIZED, "li", "td")}))}


class Page:
    """Block elements in page order, then runs of text: parent, tag, words of the attributes; ``runs`` are the texts."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words = [-1], ["#root"], [()]
        self.runs: list[str] = []
        self._runs: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("#root", 0)]
        self._text, self._link, links, mute, at = [], 0, 0, 0, 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at and not mute:
                piece = html.unescape(source[at:end])
                self._text.append(piece)
                if links:
                    self._link += len(piece.strip())
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name == "a":
                    links = max(0, links - 1)
                elif name in _SILENT:
                    mute = max(0, mute - 1)
                elif name in BLOCKS and name not in ("html", "body"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            self._flush(stack[-1][1])
                            del stack[k:]
                            break
                continue
            if name in _RAW:
                close = _RAW[name].search(source, at)
                at = close.start() if close else len(source)
            elif name == "br":
                self._text.append(" ")
            elif name == "a":
                links += 1
            elif name in _SILENT:
                mute += 1
            elif name in BLOCKS:
                if name == "body":
                    mute = 0
                self._flush(stack[-1][1])
                links = 0
                closes, bounds = _CLOSES.get(name, ((), ()))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or stack[k][0] in closes:
                        del stack[k:]
                        if name not in _CLOSES:
                            break
                    elif stack[k][0] in bounds or name not in _CLOSES:
                        break
                attrs = m[3] if m[2] else m[6]
                self.parent.append(stack[-1][1])
                self.tag.append(name)
                self.words.append(attribute_words(attrs) if attrs and not attrs.isspace() else ())
                if name not in VOID:
                    stack.append((name, len(self.tag) - 1))
        self._flush(stack[-1][1])
        self.elements, self.linked = len(self.tag), [0] * len(self.tag)
        for node, text, link in self._runs:
            own = f"#text:{self.tag[node]}"
            self.parent.append(node)
            self.tag.append(own if own in TAGS else "#text")
            self.words.append(())
            self.linked.append(link)
            self.runs.append(text)

    def _flush(self, node: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self._runs.append((node, text, self._link))
            self._text.clear()
        self._link = 0


def attribute_words(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role; ``hidden`` for what isn't shown."""
    out = set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if key == "style":
            out.update({"hidden"} if "display:none" in value.lower().replace(" ", "") else ())
        elif key in ("hidden", "aria-hidden"):
            out.update({"hidden"} if key == "hidden" or value.lower() == "true" else ())
        else:
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            out.update(_WORD.findall(value))
    return tuple(sorted(out))


_SIZES, _MEANS, _LENGTHS = (1, 100, 400, 1500), (10, 40, 120), (15, 40, 90, 200, 600)
#: Features of elements before those of runs, those of runs, and where those for a parent and of words begin.
FIXED, RUN = 26, 64
_AT_RUN = len(TAGS) + FIXED
_AT_PARENT = _AT_RUN + RUN
_AT_WORDS = _AT_PARENT + len(TAGS)
_STOP = re.compile(r"[.!?…:;]['\"”»)]*(?:\s|\Z)")
_KINDS = {"p": 1, "li": 2, "td": 3, "th": 3, "dd": 2, "dt": 2, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4, "pre": 5, "blockquote": 1, "figcaption": 6}
#: Characters below which a run is short, and how many short runs of a part count in full.
SHORT, VOTES = 90, 1.0
#: Elements that speak through their links and attributes only: many of them stand below one parent, and their
#: number must not outvote what the parent itself says.
NEUTRAL = frozenset("p li td th tr tbody thead tfoot dd dt dl h2 h3 h4 h5 h6 pre blockquote figure figcaption hr legend html".split())


def pieces(word: str) -> list[str]:
    """A word of an attribute and its four-letter pieces, marked."""
    return [word, *(f"~{word[i : i + 4]}" for i in range(len(word) - 3))]


def features(page: Page, vocabulary: dict[str, int]) -> tuple[list[list[int]], list[float]]:
    """Binary features of every node, and what they count. Elements: tag, size and mean run of the text below, link density, attribute words, and what children
    that have a say add; runs: length, links, signs, share of the page, and what they stand in. Many short runs of a part count less each, so that
    a hundred short ones don't outvote what the part itself and its long ones say."""
    n, m = len(page.tag), page.elements
    below, runs, links = [0] * m + list(map(len, page.runs)), [0] * m + [1] * len(page.runs), list(page.linked)
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        below[p] += below[k]
        runs[p] += runs[k]
        links[p] += links[k]
    base, out, scale, whole, wide = len(TAGS), [], [1.0] * m, max(1, below[0]), len(vocabulary)
    for k in range(m):
        density = 0 if not below[k] else min(3, 4 * links[k] // (below[k] + 1))
        row = [base + density] if density >= 2 or page.tag[k] not in NEUTRAL else []
        if page.tag[k] not in NEUTRAL:
            row.append(TAGS[page.tag[k]])
        if page.tag[k] in SIZED:
            mean = below[k] / max(1, runs[k])
            row += [base + 4 + sum(below[k] >= s for s in _SIZES), base + 9 + sum(mean >= s for s in _MEANS), base + 13 + min(3, 4 * below[k] // whole)]
            if not page.words[k]:  # nothing but its text says what it is for
                row += [base + 17, base + 18 + min(3, 4 * below[k] // whole), base + 22 + density]
        said = [vocabulary[x] for w in page.words[k] for x in pieces(w) if x in vocabulary]
        row += [_AT_WORDS + x for x in said]
        out.append(row)
        if k and page.tag[k] not in NEUTRAL:
            out[page.parent[k]].append(_AT_PARENT + TAGS[page.tag[k]])
        if k:
            out[page.parent[k]] += [_AT_WORDS + wide + x for x in said]
    parts = []
    for k in range(m, n):
        part = page.parent[k]
        while part and page.tag[part] in NEUTRAL:
            part = page.parent[part]
        parts.append(part)
    crowd = Counter(part for part, text in zip(parts, page.runs) if len(text) < SHORT)
    for k, text in enumerate(page.runs, m):
        length, share = sum(len(text) >= s for s in _LENGTHS), min(3, 4 * links[k] // (below[k] + 1))
        stops = min(2, len(_STOP.findall(text)))
        scale.append(1.0 if len(text) >= SHORT else min(1.0, VOTES / crowd[parts[k - m]]))
        out.append([_AT_RUN + length, _AT_RUN + 6 + 6 * share + length, _AT_RUN + 30 + stops, _AT_RUN + 33 + 3 * length + stops, _AT_RUN + 51 + min(3, 4 * below[k] // whole), _AT_RUN + 55 + _KINDS.get(page.tag[page.parent[k]], 0)])
    return out, scale


def marginals(parent: list[int], tags: list[str], unary: list[float], model: dict) -> list[float]:
    """Probability of content of every element, by messages up and down the tree."""
    n, couple = len(parent), model["couple"]
    tanh = np.tanh
    # A binary message is a log odds: through an edge of strength j, log odds u become 2 atanh(tanh(j) tanh(u / 2)).
    strength = [float(tanh(couple[TAGS[t]])) for t in tags]
    up, total = [0.0] * n, list(unary)
    for k in range(n - 1, 0, -1):
        up[k] = _through(strength[k], total[k])
        total[parent[k]] += up[k]
    for k in range(1, n):
        total[k] += _through(strength[k], total[parent[k]] - up[k])
    return [1 / (1 + np.exp(-max(-40.0, min(40.0, t)))) for t in total]


def _through(strength: float, odds: float) -> float:
    e = np.exp(-abs(odds))
    x = strength * (1 - e) / (1 + e)
    out = float(np.log1p(x) - np.log1p(-x))
    return out if odds >= 0 else -out


def _through_all(strength: np.ndarray, odds: np.ndarray) -> np.ndarray:
    x = np.clip(strength * np.tanh(odds / 2), -1 + 1e-12, 1 - 1e-12)
    return 2 * np.arctanh(x)


def fit(pages: list[tuple[Page, list[int]]], rounds: int = 300, decay: float = 1e-4) -> dict:
    """Weights and edge strengths of largest likelihood for pages with a label for each element.

    The gradient is the difference of expected and seen features; expectations are exact, by the same messages,
    passed level by level through all pages at once.
    """
    words = sorted({x for p, _ in pages for ws in p.words for w in ws for x in pieces(w)})
    vocabulary = {w: i for i, w in enumerate(words)}
    width = _AT_WORDS + 2 * len(words)
    rows, cols, count, parent, tags, y, depth, base = [], [], [], [], [], [], [], 0
    for page, labels in pages:
        for k, (row, scale) in enumerate(zip(*features(page, vocabulary))):
            rows += [base + k] * len(row)
            cols += row
            count += [scale] * len(row)
            parent.append(base + page.parent[k] if k else -1)
            depth.append(depth[parent[-1]] + 1 if k else 0)
            tags.append(TAGS[page.tag[k]])
        y += labels
        base += len(labels)
    rows, cols, count, parent, tags, y, depth = (np.array(x) for x in (rows, cols, count, parent, tags, y, depth))
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    sign, child = 2.0 * y - 1, np.flatnonzero(parent >= 0)
    agree = sign[child] * sign[parent[child]]
    w = np.concatenate([np.zeros(width), np.ones(len(TAGS))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        total = np.bincount(rows, weights=w[cols] * count, minlength=base)
        couple = w[width:][tags]
        strength, up = np.tanh(couple), np.zeros(base)
        for level in reversed(levels):
            up[level] = _through_all(strength[level], total[level])
            np.add.at(total, parent[level], up[level])
        alone = total[child].copy()  # odds of a child without its parent
        for level in levels:
            total[level] += _through_all(strength[level], total[parent[level]] - up[level])
        above = total[parent[child]] - up[child]
        p, q, j = np.abs(above + alone) / 2, np.abs(above - alone) / 2, couple[child]
        both = np.tanh((2 * j + p - q) / 2 + 0.5 * (np.log1p(np.exp(-2 * p)) - np.log1p(np.exp(-2 * q))))
        e = 1 / (1 + np.exp(-np.clip(total, -40, 40))) - y
        g = np.concatenate([np.bincount(cols, weights=e[rows] * count, minlength=width), np.bincount(tags[child], weights=both - agree, minlength=len(TAGS))]) / base
        g[:width] += decay * w[:width]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[width:] = np.clip(w[width:], 0.05, 4.0)
    return {"vocabulary": vocabulary, "weights": w[:width].tolist(), "couple": w[width:].tolist()}


def extract(source: str, model: dict) -> str:
    """The main text of a page."""
    page = Page(source)
    if not page.runs:
        return ""
    weights = model["weights"]
    unary = [scale * sum(weights[i] for i in row) for row, scale in zip(*features(page, model["vocabulary"]))]
    p = marginals(page.parent, page.tag, unary, model)
    return "\n".join(t for k, t in enumerate(page.runs, page.elements) if p[k] >= 0.5)


# ---------------------------------------------------------------- labelled pages

_SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti vo un er an es ist ou é ón".split()
#: Class or id words that pages give to their parts, in some languages.
_NAMES = {
    "content": "content main article post entry story text body page single inhalt artikel beitrag contenu contenido articulo texte".split(),
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav links toc pagination pager navigationsleiste navegacion menue".split(),
    "header": "header masthead top logo branding site title tagline kopfzeile entete cabecera".split(),
    "footer": "footer bottom copyright legal colophon fusszeile pied pie impressum".split(),
    "side": "sidebar side aside widget related recommended popular recent tags trending more seitenleiste lateral barra verwandte".split(),
    "notice": "cookie cookies notice banner consent gdpr alert popup modal overlay paywall hidden hinweis avis aviso".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion dfp anzeige werbung publicite publicidad anuncio".split(),
    "form": "form search login subscribe newsletter signup contact suche recherche buscar anmeldung".split(),
    "share": "share social follow sharing author byline meta teilen partager compartir".split(),
    "comments": "comments comment commentlist reply replies disqus respond discussion kommentar commentaire comentario opinion leserbriefe".split(),
}


def labelled_pages(count: int = 3000, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Pages of random layouts with a label for every block element and run of text; a run has its element's unless it was drawn as something else."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def words(a: int, b: int) -> str:
        return " ".join("".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(a, b)))).capitalize() + pick([".", "", "!", "."])

    def page():
        out, labels, odd = [], [0], {}

        def el(tag: str, label: int, inner, attrs: str = "", closed: bool = True) -> None:
            labels.append(label)
            out.append(f"<{tag}{attrs}>")
            inner() if callable(inner) else out.append(inner)
            if closed:
                out.append(f"</{tag}>")

        def named(kind: str) -> str:
            if chance(0.25):
                return ""
            if chance(0.12):  # a name that says nothing
                return f' class="{words(1, 3).lower().rstrip(".!").replace(" ", pick("-_ "))}"'
            names = [pick(_NAMES[kind])] + ([pick("wrapper box block container inner left right list item area section".split())] if chance(0.4) else [])
            return f' {pick(["class", "class", "id"])}="{pick(["-", " ", "_"]).join(names)}"'

        def links(tag: str = "ul") -> None:
            el(tag, 0, lambda: [el("li", 0, f'<a href="#">{words(1, 4)}</a>') for _ in range(int(rng.integers(2, 8)))])

        def raw(label: int, a: int, b: int, own: int) -> None:
            """Text right in an element of another label."""
            text = words(a, b)
            if label != own:
                odd[" ".join(text.split())] = label
            out.append(text)

        def para(label: int, a: int = 1, b: int = 60, attrs: str = "", linked: float = 0.06) -> None:
            if label and chance(linked):  # mostly a link
                el("p", label, f'{words(1, 3)} <a href="#">{words(3, 12)}</a> {words(0, 4) if chance(0.5) else ""}', attrs)
                return
            text = words(a, b) + (f' <a href="#">{words(1, 3)}</a> {words(2, 20)}' if chance(0.15) else "")
            el("p", label, ("<b>" if chance(0.2) else "") + text + ("<br>" if chance(0.2) else ""), attrs, closed=chance(0.85))

        def junk(kind: str) -> None:
            def inner() -> None:
                if kind in ("menu", "side") and chance(0.8):
                    if chance(0.4):
                        el(pick(["h2", "h3", "h4"]), 0, words(1, 4))
                    links()
                elif kind == "comments":
                    if chance(0.5):
                        el(pick(["h2", "h3"]), 0, words(1, 4))
                    wrap = pick(["div", "div", "div", "li", "li", "article"])
                    for _ in range(int(rng.integers(1, 5))):
                        el(wrap, 0, lambda: para(0, 3, 50), named("comments"))
                elif kind == "form":
                    out.append(f'<label>{words(1, 4)}</label><input name="q"><button>{words(1, 2)}</button>')
                elif kind == "header" and chance(0.6):
                    el(pick(["h1", "div", "p"]), 0, words(1, 5))
                    if chance(0.5):
                        links()
                else:
                    [para(0, 2, 30) for _ in range(int(rng.integers(1, 3)))] if chance(0.5) else out.append(words(3, 30))

            tag = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "div"], "notice": ["div", "section", "aside"], "advert": ["div", "aside"], "form": ["form"], "share": ["div", "p"], "comments": ["section", "div"]}[kind]
            tag = pick(tag)
            attrs = named(kind)
            while not attrs and tag in ("div", "section", "p", "ul") and chance(0.95):
                attrs = named(kind)
            if tag == "ul":
                el("ul", 0, lambda: [el("li", 0, f'<a href="#">{words(1, 4)}</a>') for _ in range(4)], attrs)
            elif tag == "p":
                el("p", 0, words(2, 12), attrs)
            else:
                el(tag, 0, inner, attrs)

        def body() -> None:
            if chance(0.85):
                el("h1", 1, words(2, 12))
            most = pick([60, 60, 60, 5])  # some have short paragraphs only
            for _ in range(int(rng.integers(1, pick([4, 12, 12, 40])))):
                kind = rng.random()
                if kind < 0.7:
                    para(1, 1, most)
                elif kind < 0.76:
                    el(pick(["h2", "h3", "h4"]), 1, words(1, 8))
                elif kind < 0.81:
                    el(pick(["ul", "ol"]), 1, lambda: [el("li", 1, words(2, 20), closed=chance(0.8)) for _ in range(int(rng.integers(2, 6)))])
                elif kind < 0.85:
                    el("blockquote", 1, (lambda: para(1, 4, 40)) if chance(0.5) else words(4, 40))
                elif kind < 0.87:
                    el("pre", 1, words(3, 30))
                elif kind < 0.89:
                    el("table", 1, lambda: [el("tr", 1, lambda: [el("td", 1, words(1, 5)) for _ in range(3)]) for _ in range(2)])
                elif kind < 0.91:
                    el("figure", 1, lambda: el("figcaption", 1, words(3, 12)))
                elif kind < 0.93:
                    el(pick(["section", "div"]), 1, lambda: [para(1) for _ in range(2)])
                elif kind < 0.95:
                    el(pick(["section", "div"]), 1, words(4, 60))
                elif kind < 0.96:
                    raw(0, 1, 3, 1)
                else:
                    junk(pick(["advert", "share", "side", "form", "notice"]))

        def article() -> None:
            def inner() -> None:
                if chance(0.15):
                    el("header", 1, lambda: el("h1", 1, words(2, 9)))
                shape = rng.random()
                if shape < 0.35:
                    el("div", 1, body, named("content"))
                elif shape < 0.5:
                    little()
                elif shape < 0.56:
                    out.append(words(10, 120))
                else:
                    body()

            tag = pick(["article", "article", "article", "main", "div", "section"])
            attrs = named("content")
            while tag in ("div", "section") and not attrs and chance(0.5):  # else nothing names it
                attrs = named("content")
            if chance(0.25):
                el(pick(["main", "div"]), 1, lambda: el(tag, 1, inner, attrs), named("content"))
            else:
                el(tag, 1, inner, attrs)

        before, after = ["menu", "header", "notice", "advert", "form", "side"], ["side", "comments", "footer", "advert", "share", "form", "notice", "menu"]

        def whole() -> None:
            parts = 1 if chance(0.25) else 5  # else nothing but the article
            for _ in range(int(rng.integers(0, parts))):
                junk(pick(before))
            article()
            for _ in range(int(rng.integers(0, parts))):
                junk(pick(after))

        def little() -> None:
            if chance(0.4):
                el(pick(["h1", "h2"]), 1, words(2, 9))
            if chance(0.15):
                el("pre", 1, words(3, 60))
            else:
                [para(1, 2, 50, linked=0.15) for _ in range(int(rng.integers(1, 4)))]
            if chance(0.35):
                junk(pick(["side", "side", "advert", "share", "menu", "footer", "comments"]))

        def plain(depth: int) -> None:  # containers that nothing names
            el(pick(["div", "div", "section", "center"]), 1, (lambda: plain(depth - 1)) if depth else pick([little, body]))

        shape = rng.random()
        if shape < 0.1:  # little more than a paragraph, and nothing around it
            labels[0] = 1
            kind = rng.random()
            if kind < 0.3:
                little()
            elif kind < 0.6:
                el("html", 1, lambda: el("body", 1, little))
            else:
                el("html", 1, lambda: el("body", 1, lambda: plain(0)))
        elif shape < 0.3:  # a page of unnamed containers, with the usual parts around them or without
            many = pick([0, 0, 1, 3])

            def unnamed() -> None:
                [junk(pick(["menu", "header", "form"])) for _ in range(min(many, int(rng.integers(0, 3))))]
                if chance(0.45):  # a table that lays the page out
                    def cells() -> None:
                        if chance(0.6):
                            el("td", 0, (lambda: links(pick(["ul", "ol"]))) if chance(0.3) else " ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(int(rng.integers(2, 7)))))
                        el("td", 1, pick([little, body]))
                        if chance(0.3):
                            el("td", 0, lambda: links())

                    el("table", 1, lambda: el("tr", 1, cells))
                else:
                    plain(int(rng.integers(0, 3)))
                [junk(pick(["footer", "side", "comments", "share"])) for _ in range(min(many, int(rng.integers(0, 3))))]

            el("html", 0 if many else 1, lambda: el("body", 0 if many else 1, unnamed))
            labels[0] = 0 if many else 1
        elif shape < 0.65:
            el("html", 0, lambda: el("body", 0, whole))
        elif shape < 0.82:  # fragments, and parts of the page only
            el("body", 0, whole) if chance(0.5) else whole()
        else:  # the article stands in the body itself, or nothing holds it
            def bare() -> None:
                for _ in range(int(rng.integers(0, 4))):
                    junk(pick(before))
                if chance(0.4):  # text right in the body
                    for _ in range(int(rng.integers(1, 4))):
                        out.append(words(5, 200) + pick(["<hr>", "<br><br>", " "]))
                        labels.extend([1] if out[-1].endswith("<hr>") else [])
                else:
                    pick([body, body, little])()
                for _ in range(int(rng.integers(0, 4))):
                    junk(pick(after))

            labels[0] = 1
            kind = rng.random()
            if kind < 0.5:
                el("html", 1, lambda: el("body", 1, bare))
            elif kind < 0.8:
                bare()
            else:
                out.append(words(3, 60))
        return "".join(out), labels, odd

    done = []
    while len(done) < count:
        source, labels, odd = page()
        read = Page(source)
        if read.elements == len(labels):
            done.append((read, labels + [odd.get(t, labels[p]) for t, p in zip(read.runs, read.parent[read.elements :])]))
    return done


def main_text(pages: DataFrame, model: dict | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, where it is read."""
    ship(pages.sparkSession)
    model = model or fit(labelled_pages())

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = [extract(h, model) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(tidied(run), schema)
