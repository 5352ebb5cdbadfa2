"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks: stretches of text between block elements, each with the
open elements around it. The field labels the blocks as main text or not, from the tags, classes
and ids of the ancestors, from the text (length, links, sentence ends, telling words), from where
a block lies to the box that holds most of the page's prose, and from the label of the block
before; Viterbi finds the best labels of a page. Names are known in several languages; of a name
that is not known only that it is there counts, so that the place and the text decide.

The field is trained here, on labelled pages in many layouts that `labelled_pages` writes: their
parts are known as they are put together. Their number is a parameter, nothing is downloaded.

Results: NULL and empty pages have an empty text. White space in a block becomes one space,
blocks are trimmed, empty ones left out, and main blocks joined by line ends in page order.
Character references are decoded. Scripts, styles, titles, controls and comments are no blocks.
Unclosed and misnested tags are tolerated as browsers do for the common cases; a head without its
end tag ends before the first tag or text that cannot stand in it. A page is read in time linear in
its length, however deep its elements nest and whatever it leaves open. Other columns are
left out, so clashing names do no harm; repeated rows give repeated results.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillstream.llm import common

TRAINING_PAGES = 600
EPOCHS = 250
SEED = 11

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HIDDEN = frozenset("head template noscript svg select button datalist dialog".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style "
                    "template title".split())
BLOCK = frozenset("html body address article aside blockquote center dd details div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu "
                  "nav ol p pre search section summary table caption thead tbody tfoot tr td th "
                  "ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
          "td": {"table"}, "th": {"table"}, "tbody": {"table"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)",
                    re.I)
_HUMP = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_PART = re.compile(r"[^\W\d_]+")
# A slash that belongs to an address without quotes closes nothing.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")


class Node:
    """An open element: what it and the elements around it say, made once for each."""

    __slots__ = ("around", "tag", "names", "features", "box", "start", "end", "prose", "place")

    def __init__(self, around: "Node | None", tag: str, names: tuple[str, ...], place: int):
        self.around, self.tag, self.names, self.place = around, tag, names, place
        self.features = path_features(around.features if around else NO_FEATURES, tag, names)
        # The nearest element that holds whole parts of a page, not one paragraph or cell.
        self.box = self if tag in BOXES or around is None else around.box
        self.start, self.end, self.prose = 0, 0, 0  # numbers of the first block, and behind it

    @property
    def path(self) -> tuple:
        """(tag, names) from the outermost element in."""
        out, node = [], self
        while node.around is not None:
            out.append((node.tag, node.names))
            node = node.around
        return tuple(reversed(out))


# Elements that hold whole parts of a page.
BOXES = frozenset("html body address article aside div details dialog form header footer main menu "
                  "nav search section td center fieldset".split())


@dataclass
class BlockOfText:
    node: Node  # the innermost open element
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> tuple:
        return self.node.path


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for _, value in _NAMED.findall(attributes):
        out.extend(p.lower() for p in _PART.findall(_HUMP.sub(" ", value)))
    return tuple(dict.fromkeys(out))


@dataclass
class _Tag:
    start: int
    end: int
    name: str = ""  # empty for comments and declarations
    closes: bool = False
    attributes: str = ""
    data: str = ""  # text of a CDATA section


def _tags(html: str) -> Iterator[_Tag | None]:
    """The tags of a page. The caller sends where to go on, or None for the end of the last tag.

    Every character is looked at a bounded number of times: what has been searched for in vain is
    not searched for again, and after one tag whose quotes never end, quotes count for nothing.
    """
    position, quotes, ends = 0, True, {}

    def find(what: str, start: int) -> int:
        if what not in ends:
            at = html.find(what, start)
            if at >= 0:
                return at
            ends[what] = True
        return -1

    def tag_end(start: int) -> int:
        """Where the tag's `>` is; -1 if there is none."""
        nonlocal quotes
        at = start
        while quotes:
            mark = _MARK.search(html, at)
            if mark is None:
                quotes = False
            elif mark[0] == ">":
                return mark.start()
            else:
                close = find(mark[0], mark.end())
                if close < 0:
                    quotes = False
                at = close + 1
        return find(">", start)

    while (start := find("<", position)) >= 0:
        following = html[start + 1:start + 2]
        tag = None
        if following in ("!", "?"):
            if html.startswith("<!--", start):
                end = find("-->", start + 4)
                tag = _Tag(start, end + 3 if end >= 0 else len(html))
            elif html.startswith("<![CDATA[", start):
                end = find("]]>", start + 9)
                tag = _Tag(start, end + 3 if end >= 0 else len(html),
                           data=html[start + 9:end if end >= 0 else len(html)])
            elif (end := find(">", start)) >= 0:
                tag = _Tag(start, end + 1)
        else:
            closes = following == "/"
            name = _NAME.match(html, start + 1 + closes)
            if name is not None and (end := tag_end(name.end())) >= 0:
                tag = _Tag(start, end + 1, name[0].lower(), closes, html[name.end():end])
        if tag is None:
            position = start + 1
        else:
            sent = yield tag
            position = tag.end if sent is None else sent


class _Reader:
    """The open elements of a page, by place and by name."""

    def __init__(self, html: str):
        self.html = html
        self.root = Node(None, "", (), -1)
        self.open: list[Node] = [self.root]
        self.places: dict[str, list[int]] = {}  # where elements of a name are open, in order
        self.found: list[BlockOfText] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append(BlockOfText(self.open[-1], text, self.linked))
            self.parts.clear()
            self.linked = 0

    def add(self, text: str) -> None:
        if self.hidden or not text:
            return
        if "&" in text:
            text = unescape(text)
        self.parts.append(text)
        if self.links:
            self.linked += len(text.strip())

    def enter(self, name: str, attributes: str) -> None:
        node = Node(self.open[-1], name, _names(attributes) if "=" in attributes else (),
                    len(self.open))
        node.start = len(self.found)
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(node)
        self.hidden += name in HIDDEN
        self.links += name == "a"

    def close(self, depth: int) -> None:
        """Closes the elements from `depth` on."""
        if any(node.tag in BLOCK for node in self.open[depth:]):
            self.flush()
        for node in self.open[depth:]:
            node.end = len(self.found)
            self.hidden -= node.tag in HIDDEN
            self.links -= node.tag == "a"
            self.places[node.tag].pop()
        del self.open[depth:]

    def innermost(self, tags, scope=frozenset()) -> int:
        """The place of the innermost open element of `tags`, unless one of `scope` is nearer."""
        last = lambda names: max((self.places[n][-1] for n in names
                                  if self.places.get(n)), default=-1)
        at = last(tags)
        return at if at > last(scope) else -1

    def leave_head(self) -> None:
        """Closes a head that is still open before what cannot stand in it."""
        if self.open[-1].tag == "head":
            self.close(len(self.open) - 1)

    def read(self) -> list[BlockOfText]:
        html, place = self.html, 0
        ends: dict[str, re.Pattern] = {}
        tags = _tags(html)
        tag = next(tags, None)
        while tag is not None:
            if text := html[place:tag.start]:
                if text.strip():
                    self.leave_head()
                self.add(text)
            place = tag.end
            name, resume = tag.name, None
            if not name:
                self.add(tag.data)
            elif tag.closes:
                if name == "br":
                    self.parts.append("\n")
                elif (at := self.innermost({name})) >= 0:
                    self.close(at)
            else:
                if name not in IN_HEAD:
                    self.leave_head()
                if name in RAW:
                    if name not in ends:
                        ends[name] = re.compile(rf"</{name}\b[^>]*>?", re.I)
                    end = ends[name].search(html, place)
                    place = resume = end.end() if end else len(html)
                else:
                    self.start(name, tag.attributes)
            try:
                tag = tags.send(resume)
            except StopIteration:
                tag = None
        if html[place:].strip():
            self.leave_head()
        self.add(html[place:])
        self.flush()
        for node in self.open:
            node.end = len(self.found)
        for block in self.found:
            if block.linked * 2 < len(block.text) and _SIGNS.search(block.text):
                block.node.box.prose += len(block.text)
        return self.found

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            if name not in ("html", "body") and (
                    at := self.innermost({"p"}, {"table", "td", "th", "li"})) >= 0:
                self.close(at)
            while (at := self.innermost(CLOSES.get(name, ()), SCOPES.get(name, ()))) >= 0:
                self.close(at)
            self.flush()
        if name == "br":
            self.parts.append("\n")
        elif name not in VOID and not _CLOSED.search(attributes):
            self.enter(name, attributes)


def blocks(html: str | None) -> list[BlockOfText]:
    """The leaf blocks of a page in order."""
    return _Reader(html or "").read()


# --- features ----------------------------------------------------------------------------------

# Words that tell about a part of a page when they stand in a class, an id or a short text, in
# English, German, French, Spanish, Italian, Portuguese and Dutch.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs menü menue "
            "hauptmenü navi brotkrumen navegación navegacion navegação navigazione sommaire índice "
            "navigatie kruimelpad",
    "top": "header masthead topbar top logo brand site tagline branding kopf kopfzeile seitenkopf "
           "entête entete cabecera encabezado testata intestazione cabeçalho cabecalho koptekst",
    "bottom": "footer bottom copyright colophon legal imprint fuss fuß fusszeile fußzeile impressum "
              "pied mentions pie aviso rodapé rodape piè voettekst colofon",
    "side": "sidebar side aside widget related recommended popular trending more rail teaser "
            "seitenleiste randspalte seitenspalte latérale laterale lateral barra ähnliche weitere "
            "verwandte relacionados relacionadas correlati zijbalk gerelateerd associés",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promoted banner adsense "
          "werbung anzeige anzeigen reklame publicité publicite pub publicidad anuncio anuncios "
          "pubblicità pubblicita sponsorisé patrocinado publicidade reclame advertentie",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer privacy "
              "hinweis hinweise datenschutz einwilligung zustimmung avis consentement "
              "confidentialité privacidad consentimiento avviso privacidade melding",
    "form": "form newsletter subscribe signup login register search input contact subscription "
            "formular anmeldung anmelden suche kontakt rundbrief formulaire inscription recherche "
            "formulario suscripción suscripcion buscar iscrizione modulo cerca inscrição pesquisa "
            "aanmelden zoeken",
    "talk": "comment comments reply replies discussion respond disqus thread reviews kommentar "
            "kommentare kommentarbereich antworten leserbriefe meinungen diskussion commentaire "
            "commentaires réactions comentario comentarios opiniones comentário comentários commenti "
            "commento reacties reactie opmerkingen",
    "share": "share sharing social follow meta tags tag byline author date print teilen folgen autor "
             "schlagworte partager suivre auteur compartir seguir condividi seguici partilhar delen "
             "volgen",
    "main": "content article post entry story main text body page single blog news inhalt beitrag "
            "artikel haupttext nachricht meldung contenu corps texte contenido artículo articulo "
            "texto noticia contenuto articolo testo conteúdo artigo bericht inhoud tekst",
}
_HINT = {word: hint for hint, words in HINTS.items() for word in words.split()}
_SIGNS = re.compile(r"[.!?…。！？]['\"’”»)」]*$")
_RIGHTS = re.compile(r"©|copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|"
                     r"todos los derechos|tutti i diritti|todos os direitos|alle rechten", re.I)
NO_FEATURES = frozenset({"last:none", "deepest:None"})


def path_features(around: frozenset, tag: str, names: tuple[str, ...]) -> frozenset:
    """What an element and those around it say: their tags, the last block's tag, their names
    and what these hint at. `around` is what the next element outwards says."""
    hints = [_HINT[name] for name in names if name in _HINT]
    out = {f"in:{tag}", *[f"hint:{hint}" for hint in hints]}
    if names and not hints:
        out.add("hint:unknown")
    replaced = set()
    if tag in BLOCK:
        replaced.add("last:")
        out.add(f"last:{tag}")
    deepest = hints[-1] if hints else None
    if tag in ("nav", "header", "footer", "aside", "form", "article", "main"):
        deepest = tag
    if deepest is not None:
        replaced.add("deepest:")
        out.add(f"deepest:{deepest}")
    if out <= around:
        return around
    return frozenset(f for f in around if f[:f.index(":") + 1] not in replaced) | out


def place_features(page: list[BlockOfText]) -> list[tuple[str, ...]]:
    """Where each block lies to the box with most prose: in it, in a box inside or around it, or
    elsewhere, before or after."""
    boxes = {id(b.node.box): b.node.box for b in page}
    main = max(boxes.values(), key=lambda box: box.prose, default=None)
    out = []
    for number, block in enumerate(page):
        box = block.node.box
        if not main.prose:
            where = "nowhere"
        elif box is main:
            where = "in"
        elif box.start >= main.start and box.end <= main.end and box.place > main.place:
            where = "inside"
        elif number < main.start:
            where = "before"
        else:
            where = "after" if number >= main.end else "around"
        out.append((f"box:{where}",))
    return out


def text_features(block: BlockOfText) -> tuple[str, ...]:
    """What the text says."""
    text, n = block.text, len(block.text)
    density = block.linked / n
    words = text.count(" ") + 1
    out = [f"words:{min(words.bit_length(), 7)}",
           f"links:{0 if density == 0 else 1 if density < 0.3 else 2 if density < 0.8 else 3}",
           f"ends:{bool(_SIGNS.search(text))}"]
    if _RIGHTS.search(text):
        out.append("sign:copyright")
    if words <= 12:
        hints = {_HINT[w] for w in _PART.findall(text.lower()) if w in _HINT}
        out.extend(f"says:{h}" for h in hints if h not in ("main", "top"))
    return tuple(out)


# --- the field ---------------------------------------------------------------------------------

@dataclass
class Chain:
    """Weights for 'main text' against 'other': per feature, and per pair of labels."""

    weights: dict[str, float]
    moves: np.ndarray  # [label before, label], 1 is main text
    first: np.ndarray

    def values(self, page: list[BlockOfText]) -> list[float]:
        out, known = [], {}
        for block, place in zip(page, place_features(page)):
            said = block.node.features
            if said not in known:
                # In one order, so that equal pages have equal sums.
                known[said] = sum(self.weights.get(f, 0.0) for f in sorted(said))
            out.append(known[said] + sum(
                self.weights.get(f, 0.0) for f in (*place, *text_features(block))))
        return out

    def label(self, page: list[BlockOfText]) -> list[bool]:
        """The best labels of a page's blocks (Viterbi)."""
        if not page:
            return []
        (other_other, other_main), (main_other, main_main) = self.moves.tolist()
        back = []
        other, main = self.first.tolist()
        values = self.values(page)
        main += values[0]
        for value in values[1:]:
            from_other, from_main = other + other_main, main + main_main
            stay, leave = other + other_other, main + main_other
            back.append((leave > stay, from_main >= from_other))
            other, main = max(stay, leave), max(from_other, from_main) + value
        labels = [main > other]
        for to_other, to_main in reversed(back):
            labels.append(to_main if labels[-1] else to_other)
        return labels[::-1]


def train(pages: list[tuple[list[BlockOfText], list[bool]]], epochs: int = EPOCHS) -> Chain:
    """Maximum likelihood by gradient steps (Adam), all pages side by side."""
    features: dict[str, int] = {}
    rows, ids = [], []
    length = max(len(p) for p, _ in pages)
    mask = np.zeros((len(pages), length), bool)
    truth = np.zeros((len(pages), length), np.int64)
    for i, (page, labels) in enumerate(pages):
        for j, (block, label, place) in enumerate(zip(page, labels, place_features(page))):
            mask[i, j], truth[i, j] = True, int(label)
            for f in (*sorted(block.node.features), *place, *text_features(block)):
                rows.append(i * length + j)
                ids.append(features.setdefault(f, len(features)))
    rows, ids = np.array(rows), np.array(ids)
    size = len(features)
    w = np.zeros(size + 6)  # features, moves, first
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        main = np.bincount(rows, w[ids], minlength=mask.size).reshape(mask.shape)
        moves, first = w[size:size + 4].reshape(2, 2), w[size + 4:]
        state = np.stack([np.zeros_like(main), main], 2)
        # Forward and backward sums in logarithms; blocks past a page's end change nothing.
        ahead = np.zeros(state.shape)
        ahead[:, 0] = first + state[:, 0]
        for t in range(1, length):
            new = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]
                               ) + state[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros(state.shape)
        expected = np.zeros((2, 2))
        for t in range(length - 1, 0, -1):
            on = mask[:, t]
            after = state[:, t] + behind[:, t]
            pair = (ahead[:, t - 1, :, None] + moves[None] + after[:, None, :]
                    - total[:, None, None])
            expected += np.exp(pair[on]).sum(0)
            new = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
            behind[:, t - 1] = np.where(on[:, None], new, 0)
        chance = np.exp(ahead + behind - total[:, None, None])
        # A block past the end carries the last sums on; it is masked out here.
        wrong = np.where(mask, truth - chance[:, :, 1], 0).ravel()
        gradient = np.zeros_like(w)
        gradient[:size] = np.bincount(ids, wrong[rows], minlength=size)
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:, :-1][mask[:, 1:]], truth[:, 1:][mask[:, 1:]]), 1)
        gradient[size:size + 4] = (seen - expected).ravel()
        gradient[size + 4:] = [np.sum((truth[:, 0] == k) - chance[:, 0, k]) for k in (0, 1)]
        gradient = gradient / len(pages) - 1e-4 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        w += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Chain({f: float(w[i]) for f, i in features.items()}, w[size:size + 4].reshape(2, 2),
                 w[size + 4:])


# --- labelled pages ----------------------------------------------------------------------------

class _Writer:
    """Writes a page part by part; main text goes between marks that are read off again."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        pick = self.random
        return " ".join("".join(pick.choice("abcdefghilmnoprstuvéäñ") for _ in range(
            pick.randint(1, 9))) for _ in range(pick.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 14).capitalize() + self.random.choice([".", ".", ".", "!", "?"])
                        for _ in range(self.random.randint(low, high)))

    def named(self, tag: str, hint: str, inner: str, main: bool = False) -> str:
        """An element that is told by its tag or by its class or id."""
        pick = self.random
        words = HINTS[hint].split()
        name = pick.choice(words)
        if pick.random() < 0.2:  # a name that nobody knows
            name = self.words(1, 1)
        elif pick.random() < 0.4:
            name += pick.choice(["-", "_", " "]) + pick.choice(
                ["box", "wrap", "inner", "area", "list", "block", pick.choice(words)])
        style = pick.random()
        if style < 0.4 and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        if style < 0.6 and tag != "div":
            return f'<{tag} class="{name}">{inner}</{tag}>'
        holder = pick.choice(["div", "div", "section"])
        return f'<{holder} {pick.choice(["class", "id"])}="{name}">{inner}</{holder}>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(
            self.random.randint(low, high))]
        if self.random.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.random.choice([" | ", " "]).join(items)

    def paragraphs(self, low: int, high: int) -> str:
        return "".join(self.paragraph(self.sentences(1, 9)) for _ in range(
            self.random.randint(low, high)))

    def paragraph(self, text: str) -> str:
        style = self.random.random()
        if style < 0.15:
            words = text.split(" ")
            words[0] = f"<b>{words[0]}</b>"
            text = " ".join(words)
        elif style < 0.25:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 6)}.'
        elif style < 0.35:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if style < 0.95 else f"<p>{text}"

    def around(self, kind: str) -> str:
        """A part that is not main text."""
        pick, text = self.random, ""
        if kind == "menu":
            return self.named("nav", "menu", self.links(3, 8))
        if kind == "top":
            text = pick.choice([f"<p>{self.words(1, 4)}</p>", f"<h1>{self.words(1, 3)}</h1>",
                                f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 8)}</p>",
                                self.links(2, 6)])
            return self.named("header", "top", text)
        if kind == "side":
            text = f"<h3>{self.words(1, 3)}</h3>" + pick.choice(
                [self.links(3, 7), self.paragraphs(1, 2)])
            return self.named("aside", "side", text)
        if kind == "ad":
            return self.named("div", "ad", pick.choice(
                [self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.words(1, 5)]))
        if kind == "notice":
            return self.named("div", "notice", pick.choice([
                f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)]) + pick.choice(
                ["", "<button>OK</button>", f'<a href="/p">{self.words(1, 2)}</a>']))
        if kind == "form":
            return self.named("form", "form", f"<label>{self.words(1, 4)}</label><input name=q>"
                              + pick.choice(["", f"<p>{self.sentences(1, 2)}</p>"])
                              + f"<button>{self.words(1, 2)}</button>") if pick.random() < 0.3 else (
                f"<form><p>{self.sentences(1, 2)}</p><label>{self.words(1, 3)}</label><input></form>")
        if kind == "talk":
            one = lambda: (f'<{tag} class="{pick.choice(["comment", "reply", "comment-body"])}">'
                           + f"<p>{self.sentences(1, 5)}</p></{tag}>")
            tag = pick.choice(["div", "li", "article"])
            text = pick.choice(["", f"<h2>{self.words(1, 2)}</h2>"]) + "".join(
                one() for _ in range(pick.randint(1, 5)))
            return self.named("div", "talk", text)
        if kind == "share":
            return self.named("div", "share", self.links(2, 5))
        text = pick.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 1)}",
                            f"<p>{self.words(2, 8)}</p>", self.links(2, 6),
                            f"<p>{self.sentences(1, 2)}</p>"])
        return self.named("footer", "bottom", text)

    def article(self) -> str:
        """Main text, now and then with other parts inside."""
        pick = self.random
        title = f"<h1>{self.words(2, 10)}</h1>"
        if pick.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = [_ON + (title if pick.random() < 0.8 else "")]
        for _ in range(pick.randint(1, 5)):
            kind = pick.random()
            if kind < 0.6:
                parts.append(self.paragraphs(1, 4))
            elif kind < 0.68:
                parts.append(f"<h2>{self.words(1, 6)}</h2>" + self.paragraphs(1, 2))
            elif kind < 0.74:
                parts.append("<ul>" + "".join(f"<li>{self.words(1, 12)}</li>" for _ in range(
                    pick.randint(2, 5))) + "</ul>")
            elif kind < 0.79:
                parts.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.83:
                parts.append(f"<pre>{self.words(3, 20)}</pre>")
            elif kind < 0.87:
                parts.append("<table>" + "".join(
                    f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>"
                    for _ in range(pick.randint(1, 3))) + "</table>")
            elif kind < 0.90:
                parts.append(f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption>"
                             "</figure>")
            else:
                parts.append(_OFF + self.around(pick.choice(["ad", "share", "side", "form"])) + _ON)
        inner = "".join(parts) + _OFF
        style = pick.random()
        if style < 0.35:
            return f"<article>{inner}</article>"
        if style < 0.45:
            return f"<main>{inner}</main>"
        if style < 0.55:
            return f'<main><article class="post">{inner}</article></main>'
        if style < 0.9:
            return self.named("article", "main", inner)
        return f"<div>{inner}</div>" if style < 0.97 else inner

    def page(self) -> str:
        pick = self.random
        before = [self.around(k) for k in ("notice", "top", "menu", "ad", "form", "side")
                  if pick.random() < 0.45]
        after = [self.around(k) for k in ("share", "talk", "side", "ad", "form", "menu", "notice",
                                          "bottom") if pick.random() < 0.4]
        pick.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        if pick.random() < 0.15:
            body = f'<div class="{pick.choice(["page", "container", "wrapper", "site"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{body}"


_ON, _OFF = "\ue000", "\ue001"  # marks around main text in labelled pages; never learned


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED
                   ) -> Iterator[tuple[list[BlockOfText], list[bool]]]:
    """Pages in many layouts as blocks and their labels."""
    for i in range(count):
        page, labels, on = [], [], False
        for block in blocks(_Writer(seed * 1_000_003 + i).page()):
            switched = on
            for mark in block.text:
                if mark == _ON:
                    switched = on = True
                elif mark == _OFF:
                    on = False
            text = " ".join(block.text.replace(_ON, "").replace(_OFF, "").split())
            if text:
                page.append(BlockOfText(block.node, text, min(block.linked, len(text))))
                labels.append(switched)
        if page:
            yield page, labels


@cache
def trained(count: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    return train(list(labelled_pages(count, seed)))


# --- the operator ------------------------------------------------------------------------------

def main_text(chain: Chain, html: str | None) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, main in zip(page, chain.label(page)) if main)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def step(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column(2)
            for start in range(0, len(pieces), 256):
                texts = [main_text(shared.value, h.as_py()) for h in pieces[start:start + 256]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:start + 256], batch.column(1)[start:start + 256],
                     pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[page_id, url, "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return common.mapped(pages.select(page_id, url, html), step, (
        f"`{page_id}` {kind(page_id)}, `{url}` {kind(url)}, text string, n_chars long"))
