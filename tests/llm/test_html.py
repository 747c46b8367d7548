"""Main text: pages whose text is known, against an independent parser, and hostile pages."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from marlstone.llm.html_text import BLOCKS, blocks_of, main_text

T = "This is the text of a page that we have here and it is long enough to be read by all of us."
S = "Words of another kind stand here and they are of no use to those who want to read the page."


class ArticleText(HTMLParser):
    """The text of the page's article elements, a space at each block's ends."""

    def __init__(self):
        super().__init__()
        self.depth, self.off, self.out = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.off += tag in ("script", "style", "aside", "nav", "form", "footer")
        if tag in BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.off -= tag in ("script", "style", "aside", "nav", "form", "footer")
        if tag in BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth > 0 and not self.off:
            self.out.append(data)


def test_every_page_of_the_table_gives_its_articles_text():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert len(pages) > 100
    for page in pages:
        p = ArticleText()
        p.feed(page or "")
        p.close()
        assert main_text(page) == " ".join("".join(p.out).split())


#: Pages with their main text. What names like these hold, or deny, is the point.
KNOWN = [
    (f'<body class="has-sidebar"><article><p>{T}</p></article></body>', T),
    (f'<html class="no-js cookie-consent"><body><article><p>{T}</p></article></body></html>', T),
    (f'<body class="popup"><main><p>{T}</p></main></body>', T),
    (f'<article class="ad-free"><p>{T}</p></article>', T),
    (f'<article><p><a href="x">{T}</a> so</p></article>', f"{T} so"),
    (f'<article><p>{T}</p><div class="skip-logic">Real text here</div></article>', f"{T} Real text here"),
    (f"<article><p>{T} <label>Some</label> <math><mi>x</mi></math></p></article>", f"{T} Some x"),
    (f'<div class="article-header"><h1>Head</h1></div><div class="post-content"><p>{T}</p></div>', f"Head {T}"),
    (f'<div class="entry-content"><p>{T}</p><div class="share-buttons">Share</div><div class="author_box ads-free">By her</div></div>', f"{T} By her"),
    (f'<article><h1>Head</h1><p>{T}</p></article><article class="comment"><p>{S}</p></article>', f"Head {T}"),
    (f'<main><p>{T}</p><section id="comments-area"><p>{S}</p></section></main>', T),
    (f'<div class="site-header">{S}</div><div id="cookieBanner">{S}</div><div class="related-posts">{S}</div><div class="ad-slot-3">{S}</div><p>{T} {T}</p><div class="sidebar-left">{S}</div>', f"{T} {T}"),
    (f'<div role="navigation">{S}</div><p>{T} {T}</p><div aria-hidden="true">{S}</div><div style="display: none">{S}</div><p hidden>{S}</p>', f"{T} {T}"),
    (f'<article><header><h1>Head</h1></header><p>{T}</p><footer>{S}</footer><form>{S}<label>x</label></form><nav>{S}</nav></article><header>{S}</header>', f"Head {T}"),
    (f"<p>{T} {T}<p>Short.<p>{T} {T}", f"{T} {T} Short. {T} {T}"),
    (f'<article><p>a&nbsp;b &lt;i&gt; &#x41;\n\n  c</p><ul><li>one<li>two</ul></article>', "a b <i> A c one two"),
]


@pytest.mark.parametrize("page, text", KNOWN)
def test_known_pages(page, text):
    assert main_text(page) == text


def test_hostile_pages_take_linear_time():
    pages = ["<b>" * 40000 + "<p>x</p>" * 40000, "<u>" + "<div><i>" * 30000 + "</u>" * 30000, "<ul><li>" * 50000 + "</li>" * 50000, "</x>" * 50000, "<p>" + "<b>" * 40000 + "<br>" * 40000, "<" * 50000]
    began = time.process_time()
    for page in pages:
        blocks_of(page)
    assert time.process_time() - began < 30


MENU = "<div id=menu><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div>"
#: Prose in languages of which no stop words are listed; none of it comes from anywhere.
FOREIGN = {
    "ja": "この町には古い橋があり、毎朝多くの人が川を渡って市場へ向かいます。春になると桜の木が岸辺を飾り、子どもたちは学校の帰りに花びらを集めます。橋のたもとには小さな茶屋があって、旅人はそこで休みながら川の流れを眺めます。" * 3,
    "it": "Ogni mattina il mercato del paese apre prima dell'alba, quando gli agricoltori scaricano cassette di frutta e verdura. Gli anziani arrivano presto, scelgono con calma e discutono dei prezzi, mentre i bambini corrono tra i banchi. " * 2,
    "sk": "Každé ráno prichádzajú ľudia na námestie, kde predavači ukladajú ovocie, zeleninu a čerstvý chlieb. Starší susedia sa zastavia pri studni, rozprávajú o počasí a potom pokračujú domov cez úzke uličky. " * 2,
    "fi": "Aamulla torille saapuu väkeä kaikista kylistä, ja kauppiaat asettelevat marjoja, kalaa sekä tuoretta leipää pöydille. Lapset juoksevat rannalle katsomaan laivoja ennen kuin koulu alkaa. " * 2,
    "pl": "Każdego ranka mieszkańcy przychodzą na rynek, gdzie sprzedawcy układają owoce, warzywa oraz świeży chleb. Starsi sąsiedzi zatrzymują się przy studni, rozmawiają i wracają wąskimi uliczkami. " * 2,
    "ru": "Каждое утро жители приходят на рынок, где продавцы раскладывают фрукты, овощи и свежий хлеб. Пожилые соседи останавливаются у колодца, беседуют о погоде и возвращаются домой. " * 2,
    "tr": "Her sabah kasabalılar pazara gelir, satıcılar meyveleri, sebzeleri ve taze ekmekleri dizer. Yaşlı komşular kuyunun yanında durup havadan konuşur, sonra dar sokaklardan evlerine döner. " * 2,
    "ko": "매일 아침 마을 사람들은 시장에 모이고 상인들은 과일과 채소를 진열한다. 노인들은 우물가에서 이야기를 나누고 아이들은 골목을 뛰어다닌다. " * 4,
    "el": "Κάθε πρωί οι κάτοικοι έρχονται στην αγορά, όπου οι έμποροι απλώνουν φρούτα, λαχανικά και φρέσκο ψωμί. Οι γείτονες στέκονται στο πηγάδι και μιλούν για τον καιρό. " * 2,
    "hu": "Minden reggel emberek érkeznek a piacra, ahol az árusok gyümölcsöt, zöldséget és friss kenyeret raknak ki. Az idősebb szomszédok megállnak a kútnál, beszélgetnek, majd hazamennek. " * 2,
}


@pytest.mark.parametrize("lang", FOREIGN)
def test_pages_without_listed_stop_words_keep_their_text(lang):
    text = " ".join(FOREIGN[lang].split())
    page = f"<html><body>{MENU}<div class=page><h1>{text[:20]}</h1><p>{text}</p></div><div><a href=1>{text[:70]}</a></div><footer>{text[:90]}</footer></body></html>"
    assert main_text(page) == f"{text[:20].strip()} {text}"
    short = text[:70].strip()
    assert main_text(f"<body>{MENU}<p>{short}</p></body>") == short


@pytest.mark.parametrize("name", "comment-body comment-thread comment-meta commentlist comments-area comment_content adsbygoogle outbrain cookie-law-info sidebar-primary sidebar-secondary related-stories related-article commentBox pagefooter leftsidebar mainNavigation newsletter-cta-foo".split())
def test_such_names_are_not_main_text(name):
    for page in (f"<article><p>{T}</p><div class='{name}'><p>{S}</p></div></article>", f"<body><div><p>{T * 3}</p></div><div id='{name}'><p>{S * 3}</p></div></body>"):
        assert S not in main_text(page) and T in main_text(page)


@pytest.mark.parametrize("name", "commentary headerless ad-free no-comments adsorption sidebar-free has-newsletter main-content post-body entry-meta story-text".split())
def test_such_names_are_kept(name):
    assert main_text(f"<article><p>{T}</p><div class='{name}'><p>{S}</p></div></article>") == f"{T} {S}"


def test_articles_that_lead_elsewhere():
    for other in (f"<article class='related'><p>{S}</p></article>", f"<article class='post teaser'><p>{S}</p></article>", f"<article><h2><a href=1>{S}</a></h2></article>" * 3, f"<article class='comment-body'><p>{S}</p></article>"):
        assert main_text(f"<main><article><p>{T}</p><p>{T}</p>{other}</article></main>") == f"{T} {T}"
        assert main_text(f"<main><article><p>{T}</p><p>{T}</p></article>{other}</main>") == f"{T} {T}"


def test_references_are_decoded_within_a_piece_of_text():
    assert main_text(f"<article><p>{T} &am<b>p;</b> &amp;amp; &lt;b&gt;</p></article>") == f"{T} &amp; &amp; <b>"
    assert main_text(f"<article><p>{T} <![CDATA[a &amp; b]]></p></article>") == f"{T} a &amp; b"


@pytest.mark.parametrize("unit", ['<a "', "<a '", "<a \"'>", '<a ">', "<a \"'>x</a>", "<p class='x\"'>y\"", "<a href=\"x'>\""])
def test_quotes_that_do_not_close_take_linear_time(unit):
    def seconds(n):
        t = time.perf_counter()
        main_text(unit * n + "'")
        return time.perf_counter() - t

    seconds(1000)
    assert min(seconds(64_000) for _ in range(2)) < 40 * max(0.02, min(seconds(4_000) for _ in range(2)))


def test_an_open_quote_loses_no_text():
    assert main_text(f'<article><p>{T}</p><p class="x>{S}</p></article>') == f"{T} {S}"
    assert T in main_text(f"<article><p>{T}</p></article><a '")
