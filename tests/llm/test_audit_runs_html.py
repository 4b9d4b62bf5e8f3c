"""Main text, divergence and periodic runs: against brute force and hand-made pages, with the edge cases."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest

from pagemill.llm import divergence, main_text, periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")

# op11

PAGES = {
    "clutter by name": ('<body><nav><a href=x>Menu</a></nav><div class="sidebar"><p>Side, side, side text here.</p></div><div id=content><p>One, two, three and some.</p><p>Second paragraph, with words.</p><div class="ad">Buy now, cheap.</div><p>Third one.</p></div><div id="comments"><p>I like it, really, very much, so, so, so, much more than anything, yes.</p></div></body>', "One, two, three and some.\nSecond paragraph, with words.\nThird one."),
    "references and scripts": ('<p>x &lt; y &amp;amp; z<script>if (a<b) document.write("<p>no</p>")</script> end', "x < y &amp; z end"),
    "empty": ("", ""),
    "no markup": ("just text", "just text"),
    "missing ends": ("<article><h1>T</h1><p>a<p><b>b<br><ul><li>c<li>d</ul></article><footer>f</footer>", "T\na\nb\nc\nd"),
    "article in a form": ("<form><main><p>in a form, kept</p></main><input></form>", "in a form, kept"),
    "readers write more": ('<div class="notice"><p>We use cookies, sorry.</p></div><article class="post"><p>Short.</p></article><section class="comments"><article class="comment"><p>Long, long, long, comment, of, a, reader, with, commas.</p></article></section>', "Short."),
    "heading in front": ('<body><h1>Head</h1><div class="content"><p>Text, of some length.</p></div><aside>no</aside></body>', "Head\nText, of some length."),
    "inline and br": ("<div>a<b>b</b>c</div> <div>d<br>e</div>", "abc\nd e"),
    "comments and quotes": ('<article><p>one</p><!-- <p>no</p> --><p title="a>b">two</p><style>p{}</style></article>', "one\ntwo"),
    "comment without end": ("<article><p>before</p><!-- <p>no</p>", "before"),
    "table": ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    "menu in an article": ("<article><p>Words, and more words.</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", "Words, and more words."),
    "a link in a sentence": ("<article><p>See <a href=1>this page</a>, please.</p></article>", "See this page, please."),
    "only clutter": ("<nav><p>menu</p></nav><footer><p>foot</p></footer>", ""),
    "page header, article header": ("<header><p>Site, of sites.</p></header><article><header><h1>T</h1></header><p>b</p></article>", "T\nb"),
    "white space": ("<article><p> a \n\t b </p><pre>c\n d</pre></article>", "a b\nc d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_made_pages(name):
    page, text = PAGES[name]
    assert "\n".join(main_text.article_parts(page)) == text


def test_main_text_whole_table(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.op11_main_text(spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


def test_main_text_edges(spark):
    kind = "page_id bigint, html string, text string, N_Chars int, url string"
    got = main_text.extracted(spark.createDataFrame([(1, None, "x", 1, None), (None, "<p>a", "x", 2, "u"), (1, "<p>" + "w " * 200_000, "x", 3, "u")], kind))
    assert got.columns == ["page_id", "html", "url", "text", "n_chars"]
    assert [(r["page_id"], r["n_chars"]) for r in got.collect()] == [(1, 0), (None, 1), (1, 399_999)]
    assert main_text.extracted(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<p>a<b>", '<a href="', "<!--", "</div>", "<li>a", '<div class="ad">a', "<script>", '<b title="', "<td>", "<h1>"])
def test_main_text_of_broken_markup_is_fast(piece):
    main_text.article_parts(piece * 20_000)


# op12


def brute_audit(rows, least=10, top=10):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        langs[lang].add(source)
        counts[lang, source].update(terms)
        counts[lang].update(terms)
        docs[lang].update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {}
        for g in [None, *sources]:
            c = counts[lang] if g is None else counts[lang, g]
            n = sum(c[t] for t in kept)
            p[g] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        for g in sources:
            pairs = sorted((-sum(f(p[g][t], p[h][t]) for t in kept), h.encode()) for h in sources if h != g)
            out |= {(lang, g, "pair", h.decode(), -v, i) for i, (v, h) in enumerate(pairs, 1)}
            terms = sorted((-f(p[g][t], p[None][t]), t.encode()) for t in kept if counts[lang, g][t] and p[g][t] > p[None][t])[:top]
            out |= {(lang, g, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)}
    return out


@pytest.mark.parametrize("cell_bytes", [4, 1 << 20])
def test_divergence(spark, cell_bytes):
    rng = random.Random(5)
    letters = ["a", "B", "é", "ß", "x1y", "Zed", "ÀB", "end."] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(26)]
    rows = [(" ".join(rng.choices(letters, k=rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), rng.choice(["s", "s", "t", "u", None, ""])) for _ in range(300)]
    rows += [(None, "en", "blank"), ("", "xx", "one"), ("rare words", "xx", "two"), ("a b", "yy", "alone")] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, Rank int")
    got = {tuple(r) for r in divergence.audited(df, cell_bytes=cell_bytes).collect()}  # few cells: collisions change nothing
    assert got == brute_audit(rows)


def test_divergence_edges(spark):
    empty = divergence.audited(spark.createDataFrame([], "text string, lang string, source string"))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert empty.count() == 0
    with pytest.raises(ValueError):
        divergence.audited(empty, least=300)


def test_sketch_never_underestimates(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abc", k=3)) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string").repartition(7)
    docs = Counter(t for x in texts for t in set(x.split()))
    for width in (4096, 8192):
        through = {r["term"] for r in divergence.term_counts(df, 40, width).collect()}
        assert {t for t, n in docs.items() if n >= 40} <= through


# op13


def brute_runs(words, exponent, least):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent, least", [(4, 6), (2, 2), (3, 10)])
@pytest.mark.parametrize("long_bytes, work", [(1 << 16, 1 << 28), (10, 100)])
def test_periodic_runs(spark, exponent, least, long_bytes, work):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = [rng.choice("ab" if k % 2 else ["a", "é", "c,", "dd"]) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 100]))]
        if k % 3 == 0 and len(words) > 10:
            p, a = rng.randint(1, 5), rng.randint(0, len(words) - 5)
            words[a:] = [words[a + i % p] for i in range(len(words) - a)]
        rows.append((k, "\n ".join(words), k))
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string, Uid int"), exponent, least, long_bytes, work)
    assert got.columns == ["doc_id", "text", "Uid", "n_words", "runs", "collapsed"]
    got = {r["doc_id"]: r for r in got.collect()}
    for k, text, _ in rows:
        words = WORD.findall(text)
        runs = brute_runs(words, exponent, least)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(r) for r in got[k]["runs"]] == runs
        assert got[k]["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[k]["n_words"] == len(words)


def test_periodic_runs_edges(spark):
    kind = "doc_id bigint, text string, runs string, Low int"
    rows = [(None, "a " * 9, "x", 1), (1, None, "x", 2), (1, " \t\n", "x", 3), (1, "b " * 60_000, "x", 4), (1, "b " * 60_000, "x", 4)]
    for long_bytes in (1 << 16, 0):
        got = periodic_runs.periodic_runs(spark.createDataFrame(rows, kind), long_bytes=long_bytes).collect()
        assert sorted((r["Low"], r["n_words"], len(r["runs"]), r["collapsed"]) for r in got) == [(1, 9, 1, "a"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 60_000, 1, "b"), (4, 60_000, 1, "b")]
    assert periodic_runs.periodic_runs(spark.createDataFrame([], kind)).count() == 0


def test_many_different_words(spark):
    words = [f"w{i}" for i in range(70_000)] + ["x", "y"] * 4
    got = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), long_bytes=1 << 30).first()
    assert [tuple(r) for r in got["runs"]] == [(70_000, 8, 2)]
