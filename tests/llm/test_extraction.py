import pytest

from tillstream.llm import extraction as X
from tillstream.llm import queries

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script>'
        '</head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy this now please.</div><article><h1>A title &amp; more</h1>'
        '<p><b>First  words.<br>\n<p>Second words\tof it &eacute;&#233;.</p></article>'
        '<footer>&copy; x &middot; Some words here.</footer></body></html>')


def texts(html):
    return [b.text for b in X.blocks(html)]


def test_blocks_of_broken_pages():
    assert texts(None) == texts("") == texts("<script>x") == []
    assert texts("plain & <b>bold</b>text") == ["plain & boldtext"]
    assert texts("<p>a<p>b<div>c</p>d</div>e") == ["a", "b", "cd", "e"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<p title='a>b'>x</p><p class=\"unclosed>y</p>") == ["x", "y"]
    assert texts("a < b <3 c</nothing>") == ["a < b <3 c"]
    assert texts("<p>a<br>b&nbsp;c</p><textarea>no</textarea><button>no</button>z") == ["a b c", "z"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<!-- a --><p>b<!-- c -->d</p><!-- open <p>e") == ["bd"]


def test_a_head_without_end_tag_hides_nothing():
    head = "<html><head><meta charset=x><title>T</title><style>p{}</style>"
    for body in ("<body><p>a<p>b</body></html>", "<p>a<p>b", "<div>a</div>b", "a<p>b", "\n a <p>b",
                 "<noscript><img src=x>no</noscript><template><p>no</template><body><p>a<p>b"):
        assert texts(head + body) == texts(head + "</head>" + body) == ["a", "b"], body
    assert X.main_text(X.trained(), PAGE.replace("</head>", "")) == X.main_text(X.trained(), PAGE)
    assert [b.path for b in X.blocks(head + "<body><p>a")] == [
        b.path for b in X.blocks(head + "</head><body><p>a")]


def test_the_copyright_word_counts_anywhere_in_a_block():
    block = X.blocks("<p>" + "some more words here " * 30 + "Copyright of us</p>")[0]
    assert "sign:copyright" in X.text_features(block)


@pytest.mark.parametrize("page", [
    "<div>x" * 100_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " * 100_000,
    '<a "' * 100_001, "<p " + "<b '\"> " * 100_001, "<ul><li>x" * 50_000, "<b>" * 100_000 + "</i>" * 100_000,
    "<![CDATA[x" * 50_000, "<!" * 100_000, "<script>" * 100_000, "<table><tr><td>" * 50_000,
    '<div class="a b">' * 100_000 + "x", "<" * 200_000], ids=lambda page: page[:12])
def test_deep_and_broken_pages_take_linear_time(page):
    import time
    start = time.process_time()
    X.main_text(X.trained(), page)
    assert time.process_time() - start < 8


def test_text_that_is_shown_is_kept():
    assert texts("<p>Let <math><mi>x</mi></math> be.</p>") == ["Let x be."]
    assert texts("<p>a <object>b</object> <audio>c</audio> <canvas>d</canvas></p>") == ["a b c d"]
    block = X.blocks("<p><a href=/x/>abc</a> d")[0]
    assert (block.text, block.linked) == ("abc d", 3)
    assert texts("<p><a name='x'/>a</p><br/>b<div />c") == ["a", "b", "c"]


def test_names_of_several_languages_and_humps():
    block = X.blocks('<div class="leserKommentare fußzeile-2">x</div>')[0]
    assert block.path == (("div", ("leser", "kommentare", "fußzeile")),)
    assert {"hint:talk", "hint:bottom"} <= block.node.features
    assert "hint:unknown" in X.blocks('<div class="xqz">x</div>')[0].node.features


def test_place_to_the_box_of_most_prose():
    page = X.blocks("<body><div>menu</div><div><p>One two.</p><div>three</div><p>Four five.</p>"
                    "</div>six<div>seven</div></body>")
    assert [p for (p,) in X.place_features(page)] == [
        "box:before", "box:in", "box:inside", "box:in", "box:after", "box:after"]
    assert X.place_features(X.blocks("<p>no prose")) == [("box:nowhere",)]


# Pages written by hand: (page, main text). Names in several languages, some that say nothing.
ARTICLE_DE = ["Die Brücke wird gesperrt", "Ab Montag ist die alte Brücke für sechs Wochen gesperrt.",
              "Der Verkehr wird über die Nordstraße geleitet, teilte die Stadt mit.",
              "Fußgänger können weiter passieren."]
ARTICLE_FR = ["Le marché change de place", "Le marché du samedi aura lieu sur la place de la gare.",
              "Les travaux doivent durer jusqu'en juin, selon la mairie.",
              "Les commerçants sont plutôt contents."]
ARTICLE_ES = ["La biblioteca abre los domingos", "Desde mayo la biblioteca abre también los domingos.",
              "El horario será de diez a dos, dijo la directora.", "La entrada es libre."]
ARTICLE_EN = ["How the mill was saved", "For thirty years nobody thought the mill could be repaired.",
              "Then a group of neighbours began to meet every week.",
              "This spring the wheel turned again."]


def _p(lines):
    return f"<h1>{lines[0]}</h1>" + "".join(f"<p>{line}</p>" for line in lines[1:])


def _links(*names):
    return "<ul>" + "".join(f"<li><a href=#>{n}</a></li>" for n in names) + "</ul>"


HAND = [
    (f'<div class="navigation">{_links("Start", "Politik", "Sport")}</div><div class="beitrag">'
     f'{_p(ARTICLE_DE)}</div><div class="kommentare"><h3>Kommentare</h3><div class="kommentar"><p>'
     "Endlich passiert da etwas.</p></div><div class=kommentar><p>Und wer zahlt das alles?</p></div>"
     '</div><div class="fuss">Alle Rechte vorbehalten. Impressum</div>', ARTICLE_DE),
    (f'<div id="entete"><a href=/>Le Journal</a></div><div id="corps">{_p(ARTICLE_FR)}</div>'
     '<div id="commentaires"><p>Enfin une bonne nouvelle pour la ville.</p></div>'
     "<div id=pied>Tous droits réservés.</div>", ARTICLE_FR),
    (f'<nav>{_links("Inicio", "Cultura")}</nav><main>{_p(ARTICLE_ES)}</main>'
     '<section class="comentarios"><p>Ya era hora de que abriera.</p></section>'
     '<footer>© El Diario</footer>', ARTICLE_ES),
    (f'<div class="zx1">{_links("Home", "News", "Sport", "Weather")}</div><div class="qq7">'
     f'{_p(ARTICLE_EN)}</div><div class="kk3"><a href=#>One</a> <a href=#>Two</a></div>', ARTICLE_EN),
    (f'<header><h2>Valley News</h2></header><article>{_p(ARTICLE_EN)}</article>'
     f'<aside><h4>More</h4>{_links("A story", "Another story")}</aside>', ARTICLE_EN),
    (f'<div id=cookieNotice><p>Wir verwenden Cookies. Bitte stimmen Sie zu.</p><button>OK</button>'
     f'</div><article class=artikel>{_p(ARTICLE_DE)}</article>', ARTICLE_DE),
    (f'<div class="publicidad"><p>Compre ahora y ahorre mucho.</p></div><div class="contenido">'
     f"{_p(ARTICLE_ES)}</div>", ARTICLE_ES),
    (f'<table><tr><td class="menu">{_links("Un", "Deux")}</td><td class="contenu">'
     f"{_p(ARTICLE_FR)}</td></tr></table>", ARTICLE_FR),
    (f'<main><article>{_p(ARTICLE_EN)}</article><form><p>Get our letter every week.</p>'
     "<label>Mail</label><input></form></main>", ARTICLE_EN),
    (f'<div class="werbung">Jetzt neu im Handel.</div><section class="inhalt">{_p(ARTICLE_DE)}'
     "</section><div class=teilen><a href=#>Teilen</a></div>", ARTICLE_DE),
    (f'<article>{_p(ARTICLE_ES)}</article><div class="suscripcion"><p>Reciba el boletín cada día.'
     "</p></div><footer><p>Aviso legal</p></footer>", ARTICLE_ES),
    (f'<div class="seitenleiste"><h3>Weitere</h3>{_links("Rathaus", "Schule")}</div>'
     f'<div class="haupttext">{_p(ARTICLE_DE)}</div>', ARTICLE_DE),
]


def test_pages_written_by_hand():
    right = found = wanted = 0
    for page, lines in HAND:
        got = X.main_text(X.trained(), f"<html><body>{page}</body></html>").split("\n")
        right += len(set(got) & set(lines))
        found += len([g for g in got if g])
        wanted += len(lines)
    assert 2 * right / (found + wanted) > 0.95, (right, found, wanted)


def test_ancestors_and_links():
    block = X.blocks('<div class="side-bar Main"><p id=x>ab <a href=y>cd</a></p></div>')[0]
    assert block.path == (("div", ("side", "bar", "main")), ("p", ("x",)))
    assert (block.text, block.linked) == ("ab cd", 2)


def test_viterbi_finds_the_best_labels():
    import itertools
    chain = X.trained(80, 5)
    page = X.blocks(PAGE)

    def value(labels):
        out = chain.first[labels[0]]
        values = chain.values(page)
        out += sum(v for v, label in zip(values, labels) if label)
        return out + sum(chain.moves[a][b] for a, b in zip(labels, labels[1:]))

    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert [int(x) for x in chain.label(page)] == list(best)


def test_held_out_layouts():
    chain, wrong, total = X.trained(), 0, 0
    for page, labels in X.labelled_pages(150, seed=77):
        got = chain.label(page)
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.01


def test_main_text():
    assert X.main_text(X.trained(), PAGE) == (
        "A title & more\nFirst words.\nSecond words of it éé.")


@pytest.mark.parametrize("part", [
    '<div id="comments"><div class="comment"><p>I like it very much. Thanks!</p></div></div>',
    '<aside class="sidebar"><h3>Related</h3><ul><li><a href=x>Other</a></li></ul></aside>',
    '<div class="cookie-notice"><p>We use cookies. Please accept.</p><button>OK</button></div>',
    '<form action=x><label>Your mail</label><input><p>Subscribe to it now.</p></form>',
    '<header class="masthead"><p>The site of all sites</p></header>'])
def test_other_parts_are_left_out(part):
    body = "<article><h1>Title here</h1><p>Some text of it.</p><p>More of that text.</p></article>"
    want = "Title here\nSome text of it.\nMore of that text."
    assert X.main_text(X.trained(), f"<body>{body}{part}</body>") == want
    assert X.main_text(X.trained(), f"<body>{part}{body}</body>") == want


def test_query_on_odd_rows(spark, write):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>x"),
            (4, "y", "<article>" + "<p>Some words of text.</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F
    folder = write(pages=pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("c")))
    got = queries.op3_extraction(spark, folder).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[2, None] == by[None, "v"] == ""
    assert by[4, "y"].count("\n") == 4999
    assert by[1, "u"].startswith("A title & more\n")
    assert X.extract(pages.limit(0)).count() == 0
