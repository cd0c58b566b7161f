"""Quality rules, packing and extraction against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from partloom.llm import html_text, packing, quality_rules, suffix

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", [1, 2, 3, 255])
def test_suffix_arrays(kind):
    rng = random.Random(kind)
    for _ in range(150):
        b = bytes(rng.randint(0, kind) for _ in range(rng.randint(1, 70)))
        b = b * 3 if rng.random() < 0.3 else b
        want = sorted(range(len(b)), key=lambda i: b[i:])
        t = np.frombuffer(b, np.uint8).astype(np.int64)
        assert suffix.of_bytes(b).tolist() == want == suffix.doubled(t).tolist() == suffix.induced(np.r_[t + 1, 0], 257)[1:].tolist()
        common = [0] * len(b)
        for i, j in zip(want, want[1:]):
            while max(i, j) + common[j] < len(b) and b[i + common[j]] == b[j + common[j]]:
                common[j] += 1
        assert suffix.plcp(b, np.array(want)).tolist() == common


def plain_repetition(b, least):
    """Longest match of every place with any other, by comparing all pairs."""
    n, hit, most = len(b), bytearray(len(b)), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                d = 0
                while max(i, j) + d < n and b[i + d] == b[j + d]:
                    d += 1
                best = max(best, d)
        if best >= least:
            most = max(most, best)
            hit[i : i + best] = b"\x01" * best
    return sum(hit), most


def test_repetition():
    rng = random.Random(4)
    piece = bytes(rng.randint(97, 122) for _ in range(60))
    for b in (b"", b"a" * 31, b"a" * 90, piece, piece + b"--" + piece, piece + piece[:40] + b"x" + piece[10:], bytes(rng.randint(97, 122) for _ in range(200))):
        assert quality_rules.repetition(b, 32)[:2] == plain_repetition(b, 32)


def test_quality_rules(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9)))
    clean = "\n".join(" ".join(word() for _ in range(12)) for _ in range(9))
    looped = (" ".join(word() for _ in range(60)) + "\n") * 2
    texts = [None, "", "a b a b a b", clean, looped, clean + "\n\n#* $% &|<>", "x " * 3000, "one word\nline\n line\nline\n"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate([*texts, clean])], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate([*texts, clean]):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(windows)
        inside = {k + d for k, w in enumerate(windows) if n[w] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)), i
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    assert [got[i].kept for i in range(9)] == [False, False, False, True, False, True, False, False, True]
    left = quality_rules.filter_rules(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 5, 8]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    own, other = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert own.fast is not None
    for t in ["", " ", "a\n\n b\t c  ", "<|endoftext|>", "a <|endoftext|> b", "\x1c\x85\xa0x", "日本語 😀", "I'm we'll 12ab³ ½", "a" * 3000, " " * 50 + "y\r\n", "nul\x00"]:
        assert own(t) == other.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_curve(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = packing.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("tokens", [700, 2_000_000])
def test_packing(spark, monkeypatch, tokens):
    monkeypatch.setattr(packing, "RANGE_TOKENS", tokens)
    rng = random.Random(6)
    texts = [None, "", "<|endoftext|>"] + [" ".join(rng.choice(["alpha", "beta", "gamma", "ñandú"]) for _ in range(rng.choice([1, 5, 50, 900]))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    ids = {i: np.array([*Tokenizer.from_file(VOCABULARY).encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, VOCABULARY, length=256).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, own in ids.items():
        upto = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == upto and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[upto : upto + r.length].tobytes())
            upto += r.length
        assert upto == len(own)
    for rows in by_sequence.values():
        upto = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == upto
            upto += r.length
        assert upto <= 256 and upto & (upto - 1) == 0
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


PAGES = [
    (None, ""), ("", ""), ("plain   text", "plain text"), ("<p>one<p>two <b>bold</b>", "one\ntwo bold"),
    ("<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><article><header><h1>Head &amp; line</h1></header><p>First\n  paragraph&nbsp;here.</p><div class='ad'>Buy</div><p>Second <a href=y>link</a>.<br>Third</p><section class=comments><p>Reader says much more than the article does, and goes on and on.</p></section><form><p>mail</p><button>go</button></form></article><aside>side</aside><footer>foot</footer></body></html>",
     "Head & line\nFirst paragraph here.\nSecond link.\nThird"),
    ("<body><div id=top class=header><p>Site name</p></div><div class=content><h2>Title of it</h2><p>A long paragraph with a good number of words to weigh in the balance.</p><p>Another paragraph, which is long as well and has no links at all.</p></div><div class=links><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div></body>",
     "Title of it\nA long paragraph with a good number of words to weigh in the balance.\nAnother paragraph, which is long as well and has no links at all."),
    ("<article><p>cut off in the mid", "cut off in the mid"), ("<!-- <article>x</article> --><article><p>a<!-- b -->c</article>", "ac"), ("<main><p hidden>no</p><p style='display: none'>no</p><p>yes &lt;b&gt;</p></main>", "yes <b>"),
]


def test_html_text(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (rows[i].text, rows[i].n_chars, rows[i].url) == (want, len(want), f"http://x/{i}")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_text_is_linear_in_odd_pages():
    assert html_text.main_text("<div>" * 30000 + "deep") == "deep"
    for odd in ('<a "' * 50000, "<" * 50000, "<p>x</p>" * 20000, "<b>" * 20000 + "x", "&amp;" * 50000):
        html_text.main_text(odd)


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='page with-comments'", "div class='layout no-banner'", "div class='widget-content'", "div class='post social-impact'", "div class='content widget'", "div id=overlay", "form action=x"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_html_text_within_marked_wrappers(wrapper, inner):
    lines = ["A long paragraph with a good number of words to weigh in the balance.", "Another paragraph, which is long as well and has no links at all."]
    page = f"<body><nav><a href=x>menu</a></nav><{wrapper}><{inner}>" + "".join(f"<p>{x}</p>" for x in lines) + f"<div class='ad'>Buy</div></{inner}></{wrapper.split()[0]}><div class=comments><p>Well said.</p></div></body>"
    assert html_text.main_text(page) == "\n".join(lines)


def test_html_text_drops_comments_that_are_articles():
    page = "<body><article><p>The text itself, of some length.</p></article><div id=comments>" + "<article><p>A reader says this and that, at length.</p></article>" * 2 + "</div><div class=text><p>" + "More words of the page. " * 9 + "</p></div></body>"
    assert "reader" not in html_text.main_text(page)


def plain_density(x, body):
    """Composite text density of an element by its definition, walking all below it."""
    import math

    def texts(n):
        return "".join(" ".join(c.split()) if isinstance(c, str) else texts(c) for c in n.children if isinstance(c, str) or not c.drop)

    def below(n):
        return [y for c in n.children if not isinstance(c, str) and not c.drop for y in (c, *below(c))]

    def linked(n):
        tops = [n] if n.tag == "a" else [y for y in below(n) if y.tag == "a" and not inside_link(y.parent, n)]
        return sum(len(texts(y)) for y in tops)

    def inside_link(y, top):
        while y is not top:
            if y.tag == "a":
                return True
            y = y.parent
        return top.tag == "a"

    c, t, lc, lt = len(texts(x)), max(1, len(below(x))), linked(x), sum(y.tag == "a" for y in [x, *below(x)])
    base = math.log(c / max(1, c - lc) * max(1, lc) + linked(body) / max(1, len(texts(body))) * c + math.e)
    return c / t * math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base) if c else 0.0


def test_densities_of_random_pages():
    rng = random.Random(8)

    def some(depth):
        if depth == 0 or rng.random() < 0.25:
            return " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))
        tag = rng.choice(["div", "span", "a", "section", "b", "article", "nav", "ul"])
        inner = "".join(some(depth - 1) for _ in range(rng.randint(1, 4)))
        inner = re.sub(r"</?a>", "", inner) if tag == "a" else inner
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        nodes = html_text.parse("<body>" + "".join(some(5) for _ in range(4)))
        html_text.densities(nodes)
        for x in nodes:
            assert abs(x.density - plain_density(x, nodes[0])) < 1e-6 * max(1.0, x.density)


PARAGRAPH = "A long sentence of plain prose that says something, and then goes on to say some more of it. " * 3
FOOT = '<nav><a href=1>Home</a> <a href=2>News</a></nav>', '<aside>Other things to see</aside><footer>Rights reserved by the owner of this page</footer>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<main><article><p>{PARAGRAPH}</p></article><article><p>Second {PARAGRAPH}</p></article></main>", [PARAGRAPH.strip(), "Second " + PARAGRAPH.strip()]),
        (f'<article><h1>Title</h1><p class="related-work">{PARAGRAPH}</p><div class="social-science">{PARAGRAPH}</div></article>', ["Title", PARAGRAPH.strip(), PARAGRAPH.strip()]),
        (f"<div><h2>Title</h2><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>Short.</p></div></div>", ["Title", PARAGRAPH.strip(), PARAGRAPH.strip(), "Short."]),
        (f'<article><p>{PARAGRAPH}</p><div class="ad">Buy this now, it is cheap and good.</div><form>Your name <input></form><ul><li>One</li><li>Two</li></ul></article>', [PARAGRAPH.strip(), "One", "Two"]),
        (f'<article><section><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></section><section><p>Brief end of it all, told in one line.</p></section></article><div class="comments"><p>{PARAGRAPH * 2}</p></div>', [PARAGRAPH.strip(), PARAGRAPH.strip(), "Brief end of it all, told in one line."]),
        (f"<article>Loose text in front.<div><p>{PARAGRAPH}</p></div>and behind.</article>", ["Loose text in front.", PARAGRAPH.strip(), "and behind."]),
    ],
)
def test_html_text_by_density(page, want):
    assert html_text.main_text(f"<html><body>{FOOT[0]}{page}{FOOT[1]}</body></html>").split("\n") == want


def test_html_text_of_a_very_long_page_and_repeated_rows(spark):
    page = "<body><article>" + f"<p>{PARAGRAPH}</p>" * 20000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, 5), (1, "u", page, 5), (None, None, None, 6)], "page_id long, url string, html string, n_chars int")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), *[(1, 20000 * (len(PARAGRAPH.strip()) + 1) - 1)] * 2]


COMMENTS = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(8))


@pytest.mark.parametrize("post", ["<div class=post><p>One paragraph.</p></div>", "<article><p>One paragraph.</p></article>", "<main><p>One paragraph.</p></main>", "<div>" + "One paragraph." + "</div>"])
@pytest.mark.parametrize("more", [f"<div id='comments'>{COMMENTS}</div>", f"<section class='post-list replies'>{COMMENTS}</section>", f"<div class='cookie'>{COMMENTS}</div>", f"<div id=consent>{COMMENTS}</div>", f"<div class='sponsored box'>{COMMENTS}</div>"])
def test_html_text_leaves_out_long_comments_and_notices(post, more):
    assert html_text.main_text(f"<body>{FOOT[0]}{post}{more}{FOOT[1]}") == html_text.main_text(f"<body>{FOOT[0]}{more}{post}{FOOT[1]}") == "One paragraph."


def test_html_text_keeps_named_paragraphs_of_an_article():
    page = '<article><h2 class="related">Title</h2><p id="reply">A reply.</p><p class="note notice">Take note.</p><blockquote class="comment">Said.</blockquote><p class="ad">Buy this.</p></article>'
    assert html_text.main_text(page) == "Title\nA reply.\nTake note.\nSaid."
    assert html_text.main_text(f"<div id=comments>{COMMENTS}</div>") == html_text.main_text(FOOT[0] + FOOT[1]) == ""


def test_html_text_of_random_pages():
    """Articles among random boilerplate, which is known as the page is built."""
    rng = random.Random(12)
    words = lambda n: " ".join("w" * rng.randint(2, 9) for _ in range(n))
    around = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=x>{words(2)}</a>' for _ in range(rng.randint(1, 9)))}</ul></nav>", lambda: f"<div id=comments>{''.join(f'<div class=comment><p>{words(rng.randint(5, 90))}</p></div>' for _ in range(rng.randint(1, 9)))}</div>",
        lambda: f"<div class='cookie-notice notice'><p>{words(rng.randint(3, 200))}</p><button>ok</button></div>", lambda: f"<aside><p>{words(30)}</p></aside>", lambda: f"<footer><p>{words(12)}</p></footer>",
        lambda: f"<div class=ad>{words(rng.randint(1, 60))}</div>", lambda: f"<script>{words(50)}</script><style>{words(9)}</style>", lambda: f"<form><p>{words(5)}</p><input></form>", lambda: f"<div class=sidebar><p>{words(25)}</p></div>",
    ]
    for k in range(150):
        blocks = [words(rng.randint(20, 80)) for _ in range(rng.randint(1, 7))]
        inner = "".join(f"<p>{b}</p>" + (around[5]() if rng.random() < 0.2 else "") for b in blocks)
        tag = ["article", "main", "div class=post", "div"][k % 4]
        page = "".join(x() for x in rng.choices(around, k=rng.randint(0, 5))) + f"<{tag}>{inner}</{tag.split()[0]}>" + "".join(x() for x in rng.choices(around, k=rng.randint(0, 5)))
        assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n".join(blocks), page
