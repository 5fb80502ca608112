"""Sharding, main text, BPE, token counts."""

import hashlib
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from plantspark.llm import byte_bpe, html_text, sharding, token_counts

from .samples import answer, frame, rows


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from plantspark.session import ship

    ship(spark)


def narrow(df):
    return df.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("bytes"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))


@pytest.mark.parametrize("large", [1 << 20, 3])
def test_ring_is_balanced_and_gapless(spark, monkeypatch, large):
    monkeypatch.setattr(sharding, "LARGE", large)
    placed = sharding.place(narrow(frame(spark, rows())), "doc_id", 5, ties=("bytes", "crc"), ring_bits=4, vnodes=2).collect()
    assert len(placed) == len(rows())
    slots = {}
    for r in placed:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((r.doc_id, r.crc) for r in placed) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows())


def test_ring_moves_little_and_respects_slack():
    counts = {p: 1 + p % 7 for p in range(0, 1 << 16, 3)}
    total = sum(counts.values())
    before, after = (sharding.walk(counts, s) for s in (16, 17))
    kept = sum(
        max(0, min(b1, b2) - max(a1, a2)) for p in counts for a1, b1, s1, _ in before[p] for a2, b2, s2, _ in after[p] if s1 == s2
    )
    assert 1 - kept / total < 2 / 17
    loose = sharding.walk(counts, 16, slack=0.1)
    load = Counter()
    for steps in loose.values():
        for first, end, shard, _ in steps:
            load[shard] += end - first
    assert sum(load.values()) == total and max(load.values()) <= 1.1 * total / 16 + 1


def test_ring_of_nothing(spark):
    assert sharding.place(narrow(frame(spark, [])), "doc_id", 4).count() == 0


def test_bpe_equals_library_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(path))}, special_tokens={})
    made = byte_bpe.encoded(frame(spark, rows(), clash=True), path, public_tokenizers.PATTERN, outputs=("ids", "decoded", "n_tokens", "ids_sha256")).select("text", "ids", "decoded", "n_tokens", "ids_sha256")
    for r in made.collect():
        expected = library.encode_ordinary(r.text or "")
        assert r.ids == expected and r.n_tokens == len(expected) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
    assert byte_bpe.encoded(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 5)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = byte_bpe.Codec(byte_bpe.serialise(byte_bpe.read_ranks(path)), public_tokenizers.PATTERN)
    for _, text in rows():
        assert codec.decode(codec.encode(text or "")) == (text or "").encode()


def test_token_counts_equal_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    extra = ["▁", " ▁ a▁b", "<s></s><unk>", "a  b   c ", "\t\n x", "日本語 テキスト", " " * 40, "\x00 a"]
    pairs = rows() + [(1000 + i, t) for i, t in enumerate(extra)]
    made = token_counts.counted(frame(spark, pairs, clash=True), path, limit=100)
    for r in made.select("text", "n_bytes", "n_tokens", "over_limit").collect():
        n = len(library.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
    assert token_counts.counted(frame(spark, []), path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article class=post><header><h1>A &amp; B</h1></header><p>First   line<br>goes on&nbsp;here.<p>Second &lt;b&gt; <b>bold</b>
<script>var x = "</p><p>no</p>";</script><div class="ad">Buy!</div><p>Third.</p><form><p>Name</p></form>
<section class="comments"><p>I agree with all of this.</p></section></article><aside>More</aside><footer>&copy; us</footer></body></html>"""


def test_main_text_of_marked_up_page():
    assert html_text.main_text(PAGE) == "A & B\nFirst line goes on here.\nSecond <b> bold\nThird."


def test_main_text_by_density_and_neighbours():
    long = "The cat and the dog are in the house of the man, and that is for all of us to see as it was by the sea and not in the city, "
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><div><h2>Title</h2><p>{long * 2}</p><p>Short.</p><p>{long * 2}</p></div><div>© 2020</div>"
    assert html_text.main_text(page).split("\n") == ["Title", (long * 2).strip(), "Short.", (long * 2).strip()]


DENSE = "The cat and the dog are in the house of the man, and that is for all of us to see as it was by the sea and not in the city."


def test_teaser_article_beside_the_main_text():
    card = "<article class=card><h3><a href=/n>Next story</a></h3><p>Read on.</p></article>"
    content = f"<div id=content><h1>Head</h1><p>{DENSE * 3}</p><p>{DENSE * 2}</p><p>Short end.</p></div>"
    for page in (content + card, card + content):
        got = html_text.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>&copy; us</footer></body>").split("\n")
        assert got[:4] == ["Head", DENSE * 3, DENSE * 2, "Short end."] or got[-4:] == ["Head", DENSE * 3, DENSE * 2, "Short end."]
        assert "Next story" not in got


def test_text_outside_and_notices_inside_an_article():
    notice = "<p><a href=/a>Buy this</a></p><p>SALE 50% OFF shop now, free shipping, best deals, brand new stock, order today!</p><p><a href=/b>Order here</a></p>"
    page = f"<article><h1>Head</h1><p>{DENSE * 3}</p>{notice}<p>{DENSE}</p><p>End.</p></article><div><p>{DENSE * 2}</p></div>"
    assert html_text.main_text(page).split("\n") == ["Head", DENSE * 3, DENSE, "End.", DENSE * 2]
    assert html_text.main_text("<div class=ad>Buy!</div><article><h1>Head</h1><p>One.</p></article><footer>us</footer>") == "Head\nOne."


WRAPPED = [
    "<body><form id=aspnetForm>{nav}<div>{text}</div></form></body>",
    "<body><form id=aspnetForm>{nav}<article>{text}</article></form></body>",
    "<body><nav><a href=/>Home</a><div>{text}</div></body>",
    "<body><header><a href=/>Home</a><article>{text}</article></body>",
    "<body class=no-sidebar>{nav}<div>{text}</div></body>",
    "<body class='login comments'>{nav}<div>{text}</div></body>",
    "<body>{nav}<div class='layout has-sidebar with-fixed-header'>{text}</div></body>",
    "<body>{nav}<div class='sidebar-layout'>{text}</div></body>",
    "<body>{nav}<article class='post category-social tag-search'>{text}</article></body>",
    "<html><head><title>T</title><div>{text}</div></html>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_no_place_rule_empties_a_page(page):
    page = page.format(nav="<nav><a href=/>Home</a></nav>", text=f"<h1>Head</h1><p>{DENSE * 3}</p><p>End.</p><div class=sidebar><p>{DENSE}</p></div>")
    assert html_text.main_text(page).split("\n") == ["Head", DENSE * 3, "End."]


def test_marked_parts_beside_little_text_stay_out():
    for mark in ("<aside>{}</aside>", "<footer>{}</footer>", "<div class=ad>{}</div>", "<ol class=comment-list><li><article class=comment-body>{}</article></li></ol>"):
        page = f"<article><h1>Head</h1><p>One short line of text stands here.</p></article>{mark.format('<p>' + DENSE * 2 + '</p>')}"
        assert html_text.main_text(page) == "Head\nOne short line of text stands here."


@pytest.mark.parametrize("element", "button select object canvas svg math audio video template noscript".split())
def test_unclosed_elements_end_with_their_part(element):
    for page in (f"<body><div><{element}>Menu</div><p>{DENSE * 3}</p><p>End.</p></body>", f"<body><{element}>Menu<p>{DENSE * 3}</p><p>End.</p><div><{element}>x</{element}></div>"):
        assert html_text.main_text(page) == f"{DENSE * 3}\nEnd."
    assert html_text.main_text(f"<p>{DENSE * 2} <{element}>no<p>no</p></{element}>yes</p>") == f"{DENSE * 2} yes"


def test_only_anchors_with_href_are_links_and_end_with_their_block():
    want = f"Head\n{DENSE * 3}\n{DENSE * 2}"
    assert html_text.main_text(f"<article><a name=top><h1>Head</h1><p>{DENSE * 3}</p><p>{DENSE * 2}</p></article>") == want
    assert html_text.main_text(f"<div><a name=top><h1>Head</h1><p>{DENSE * 3}</p><p>{DENSE * 2}</p><p><a href=/x>More</a></p></div>") == want
    assert html_text.main_text(f"<article><p><a href=/x>Home<h1>Head</h1><p>{DENSE * 3}</p><p>{DENSE * 2}</p></article>") == want
    assert html_text.main_text(f"<article><h1>Head</h1><p>{DENSE * 3}</p><p>{DENSE * 2}</p></article><div><a href=/x><h3>Next</h3><p>{DENSE}</p></a></div>") == want


FOREIGN = {
    "pl": "Wczoraj wieczorem nad rzeką zebrało się wielu mieszkańców miasta, którzy chcieli zobaczyć odnowiony most oraz posłuchać koncertu orkiestry strażackiej. ",
    "ru": "Вчера вечером у реки собралось много жителей города, которые хотели увидеть обновлённый мост и послушать концерт духового оркестра под открытым небом. ",
    "tr": "Dün akşam nehir kıyısında toplanan kent sakinleri yenilenen köprüyü görmek ve bandonun konserini dinlemek istediler, çocuklar ise oyun oynadı. ",
    "fi": "Eilen illalla joen rannalle kokoontui paljon kaupungin asukkaita, jotka halusivat nähdä uudistetun sillan sekä kuunnella palokunnan orkesteria. ",
    "zh": "昨天晚上许多市民聚集在河边,他们想看看修缮一新的大桥,并聆听消防乐队的露天音乐会,孩子们则在草地上玩耍,直到天黑才回家,气氛十分热闹。",
}


@pytest.mark.parametrize("language", FOREIGN)
def test_languages_without_listed_function_words(language):
    text = FOREIGN[language]
    page = f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h2>{text[:12]}</h2><p>{text * 2}</p><p>{text[:20]}</p><p>{text * 3}</p></div><div>© 2020</div></body>"
    assert html_text.main_text(page).split("\n") == [" ".join(t.split()) for t in (text[:12], text * 2, text[:20], text * 3)]
    mixed = f"<div><p>{DENSE * 2}</p><p>{text * 3}</p><p>{text * 3}</p></div>"
    assert len(html_text.main_text(mixed).split("\n")) == 3


def test_lists_beside_text_of_a_known_language_stay_out():
    junk = "Shop sale brand stock deals price order shipping outlet " * 3
    page = f"<div><p>{DENSE * 3}</p><p>{DENSE * 2}</p></div><div>{junk}</div>"
    assert html_text.main_text(page) == f"{DENSE * 3}\n{DENSE * 2}"


def test_nested_and_stray_tags_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 30_000 + "</section>" * 30_000, "<svg>" * 30_000 + "</nav>" * 30_000, "<a href=x>" * 30_000 + "<button>" * 30_000):
        assert html_text.main_text(page + "</div>") == ""
    assert time.perf_counter() - began < 20


def test_main_text_edge_cases(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<!-- open"), (5, "u", "<article>x</article>"), (5, "u", "<article>x</article>"), (6, "u", "<a" * 20_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(df).collect()}
    assert got[1] == got[2] == got[4] == ("", 0) and got[5] == ("x", 1)
    assert html_text.extracted(df.limit(0)).count() == 0
    assert answer(html_text.extracted(df).where("page_id = 5").select("text")) == [("x",), ("x",)]


PROSE = "The law of the land is that it was for the people and by the people, and in the end it is what they had in mind when they wrote it. "
STORY = "It is the story of the town and of its people, and what they did in the years of the war. "


def test_pages_of_short_lines_keep_them():
    lines = [f"A line of the poem, number {i}" for i in range(12)]
    page = "<html><body><nav><a href=/>Home</a></nav><div id=content><h1>Poem</h1>" + "".join(f"<p>{x}</p>" for x in lines) + "</div><footer>© 2024 Site</footer></body></html>"
    assert html_text.main_text(page) == "\n".join(["Poem", *lines])
    links = "<ul>" + "<li><a href=x>Link to here</a></li>" * 20 + "</ul><p>Loading"
    assert html_text.main_text(links) == ""


@pytest.mark.parametrize(("name", "kept"), [("legal-history", True), ("search-results-note", True), ("related-work", True), ("related-posts", False), ("comments-area", False), ("ad", False), ("search", False), ("cookie-notice", False)])
def test_names_within_an_article(name, kept):
    text = html_text.main_text(f"<article><h1>T</h1><p>{STORY * 4}</p><section class='{name}'><p>{PROSE * 2}</p></section><p>{STORY * 5}</p></article>")
    assert (PROSE[:40] in text) is kept and text.count(STORY[:40]) == 9


def test_empty_comments_end_at_once():
    for empty in ("<!-->", "<!--->", "<!-- x -->", "<!-- x --!>"):
        assert html_text.main_text(f"<p>{PROSE * 2}</p>{empty}<p>{STORY * 3}</p><p>{PROSE} --> {STORY}</p>").count(STORY[:40]) == 4


def test_text_without_scripts():
    assert html_text.main_text(f"<body><div id=app></div><noscript><div><p>{PROSE * 2}</p></div></noscript><script>x</script></body>").startswith(PROSE[:40])
    assert "enable" not in html_text.main_text(f"<body><p>{PROSE * 2}</p><noscript><p>{STORY * 3} Please enable scripts.</p></noscript></body>")


def ring_by_rows(keys, shards, vnodes, ring_bits):
    """Bounded loads one row at a time: the rows of a round knock in ring order, by rank within their position."""
    ring = sharding.points(shards, vnodes, ring_bits)
    room = sharding.capacities(len(keys), shards, 0.0)
    where = [p for p, _ in ring]
    at = {k: next((i for i, p in enumerate(where) if p >= k[0]), 0) for k in keys}
    placed, waiting = {}, sorted(keys)
    while waiting:
        left = []
        for key in waiting:
            shard = ring[at[key] % len(ring)][1]
            if room[shard]:
                room[shard] -= 1
                placed[key] = shard
            else:
                at[key] += 1
                left.append(key)
        for key in left:
            while not room[ring[at[key] % len(ring)][1]]:
                at[key] += 1
        waiting = left
    return placed


def test_ring_equals_a_walk_by_rows(spark):
    df = narrow(frame(spark, [(i, f"t{i % 50}") for i in range(600)]))
    df = df.withColumns({c: F.lit(-1) for c in ("shard", "slot", "steps", "parts", "first")})
    placed = sharding.place(df, "doc_id", 7, ties=("bytes", "crc"), ring_bits=6, vnodes=3)
    hashed = placed.select("doc_id", "shard", F.xxhash64("doc_id").alias("h")).collect()
    keys = {((r.h & (1 << 64) - 1) >> 58, r.h, r.doc_id): r.shard for r in hashed}
    assert ring_by_rows(list(keys), 7, 3, 6) == keys
