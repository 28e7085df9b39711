"""Page text against the generator's structure, and benchmark leaks against brute force."""

from __future__ import annotations

import html
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from regionwatch.llm import decontaminate, extract, queries


def plain_article(page):
    """The test pages hold one article of a heading and paragraphs."""
    m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page or "", re.S)
    parts = re.split(r"</?p>|</?h1>", m[1]) if m else []
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_extract_query(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op8_extract(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p", ""), ("plain words that stand alone without any markup at all here today", "plain words that stand alone without any markup at all here today"),
    ("<article><p>A &lt;b&gt; &eacute;&#x41;&nbsp;\n\t x</p><p>B</p></article>", "A <b> éA x\n\nB"),
    ("<article><header><h1>T</h1></header><p>One<br>two <b>three<p>four &am", "T\n\nOne two three\n\nfour &am"),
    ("<article><p>a</p><div class='cookie-notice'><p>no</p></div><aside>no</aside><form><p>no</p></form><ul class=share><li>no</ul><p>b</p><section id=comments><p>no</p></section></article>", "a\n\nb"),
    ("<header><p>no</p></header><nav><a href=x>no</a></nav><article><script>var t='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a</p></article><footer>no</footer>", "a"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"), ("<ARTICLE><P CLASS=\"ad\">no</P><P>a</P></ARTICLE>", "a"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>a</article><p>outside the article there are many words that do not belong to it</p>", "a"),
])
def test_odd_pages(page, text):
    assert extract.extract(page) == text


def test_page_without_an_article():
    long = "words of a long paragraph that says something about the world and goes on for a while"
    page = f"<div><a href=a>Home</a></div><div><a href=b>News</a> <a href=c>Sport</a></div><h2>Title of it</h2><p>{long}</p><p>Short one.</p><p>{long}</p><div><a href=d>Next</a></div>"
    assert extract.extract(page) == f"Title of it\n\n{long}\n\nShort one.\n\n{long}"


def test_tree_fits_its_table_and_generalises():
    rows = list(extract.LABELLED)
    assert all(extract.is_content(r[:-1]) == bool(r[-1]) for r in rows)
    rng = random.Random(1)
    right = 0
    for _ in range(20):
        rng.shuffle(rows)
        cut = len(rows) // 5
        node = extract.grow(rows[cut:])
        for r in rows[:cut]:
            at = node
            while at.low is not None:
                at = at.low if r[at.feature] <= at.cut else at.high
            right += at.content == bool(r[-1])
    assert right / (20 * cut) > 0.85


def test_odd_page_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>x</p></article>"), (2, "v", "<article>" + "<p>word</p>" * 20_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = sorted((repr(r["page_id"]), r["url"], r["n_chars"]) for r in extract.main_text(frame).collect())
    assert got == [("1", "u", 0), ("1", "u", 0), ("2", "v", 20_000 * 6 - 2), ("None", None, 1)]
    assert extract.main_text(frame.limit(0)).isEmpty()


# --- leaks --------------------------------------------------------------------


def shingle_share(part, words):
    n = min(5, len(part))
    wanted = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return len(wanted & there) / len(wanted) if wanted else None


def test_query_finds_every_copied_item(spark, small):
    docs = {r["doc_id"]: decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = {(d, i) for d, ws in docs.items() for i, t in items.items() if shingle_share(decontaminate.question_and_answer(t)[0], ws) >= 0.5}
    got = queries.op10_decontaminate(spark, small).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    for r in got:
        question, answer = decontaminate.question_and_answer(items[r["item_id"]])
        assert r["question_overlap"] == pytest.approx(shingle_share(question, docs[r["doc_id"]]))
    left = decontaminate.without_leaks(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet"))
    assert left.count() == len(docs) - len({d for d, _ in want})


def exact(index, words):
    """Shares of the best score of all items in all passages, without bounds."""
    best = {}
    for start in range(0, max(1, len(words)), index.stride):
        there = set(words[start : start + 2 * index.stride])
        ids = {index.vocab[w] for w in there if w in index.vocab}
        for n, item in enumerate(index.items):
            score = sum(v for t, v in item.impacts.items() if t in ids)
            best[n] = max(best.get(n, 0), score / item.best)
    return best


def test_bounds_lose_no_candidate(monkeypatch):
    rng = random.Random(8)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3_000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40))) + ". " + " ".join(rng.choices(vocab, k=5)) + ".") for i in range(60)]
    df = {}
    for _, t in items:
        for w in set(decontaminate.words_of(t)):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(items, df, len(items), 25.0)
    for size in (1 << 21, 64):
        monkeypatch.setattr(decontaminate, "SUMS_AT_A_TIME", size)
        monkeypatch.setattr(decontaminate.Index, "_verify", lambda self, item, window, share: (share, 1.0, 1.0))
        texts = [decontaminate.words_of(" ".join(rng.choices(vocab, k=rng.randint(0, 300))) + " " + rng.choice(items)[1]) for _ in range(15)] + [[]]
        got = {}
        for d, i, share, *_ in index.search(texts):
            got.setdefault(d, {})[i] = share
        for d, ws in enumerate(texts):
            want = {index.items[n].item_id: s for n, s in exact(index, ws).items() if s >= decontaminate.CANDIDATE}
            assert got.get(d, {}) == pytest.approx(want)


def indexed(items):
    counted = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    return decontaminate.Index(items, counted, len(items), sum(len(decontaminate.words_of(t)) for _, t in items) / len(items))


def test_questions_of_items_with_long_answers_are_found():
    """Question-only and half-question copies, the cheapest half of the shingles among them."""
    rng = random.Random(5)
    vocab = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3_000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 20))) + ". " + " ".join(rng.choices(vocab, k=rng.randint(20, 60))) + ".") for i in range(80)]
    index, low = indexed(items), 0
    for i, t in items:
        question = decontaminate.question_and_answer(t)[0]
        half = -(-len({tuple(question[k : k + 5]) for k in range(len(question) - 4)}) // 2) + 4
        for k in range(len(question) - half + 1):
            words = [f"x{n}" for n in range(200)] + question[k : k + half] + [f"y{n}" for n in range(200)]
            for copy in (words, [*words[:200], *question, *words[200 + half :]]):
                wanted = shingle_share(question, copy) >= 0.5
                got = {n: share for _, n, share, *_ in index.search([copy], parts=True)}
                assert (i in got) == wanted
                low += got.get(i, 1) < decontaminate.CANDIDATE
    assert low > 100


def test_answers_and_whole_texts_are_leaks():
    answer = "a long last sentence goes on for many words and holds most of what the item says to its reader"
    items = [(1, f"Why? {answer.capitalize()}."), (2, "one two three four five six seven eight nine ten. " + "Eleven twelve thirteen fourteen fifteen sixteen."), (3, "What is it that we all want? Four."), (4, "Red blue green grey. Pink white black brown.")]
    index = indexed(items)
    pad = [b"x%d" % n for n in range(150)]
    found = lambda text: [(i, kind) for _, i, *_, kind in index.search([pad + decontaminate.words_of(text) + pad], parts=True)]
    assert found(answer) == [(1, "answer")] and found(f"Why {answer}") == [(1, "full")]
    assert found(answer.rsplit(" ", 4)[0]) == [(1, "answer")] and found("its reader goes on and says for many words what most items say") == []
    assert found("eleven twelve thirteen fourteen fifteen sixteen") == [(2, "answer")] and found(items[1][1]) == [(2, "full")]
    assert found("four five six seven eight nine ten") == [(2, "question")] and found("four") == [] and found("why") == []
    assert found("blue green grey pink white") == [] and found("blue green grey pink white black") == [(4, "text")]


def test_least_score_is_a_lower_bound():
    rng = random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(8) for _ in range(rng.randint(5, 14))]
        impacts = {t: rng.random() for t in ids}
        runs = sorted({tuple(ids[k : k + 5]) for k in range(len(ids) - 4)})
        exactly = min(sum(impacts[t] for t in set().union(*some)) for some in itertools.combinations(runs, -(-len(runs) // 2)))
        bound = decontaminate.least_score(decontaminate.np.array(ids, "int32"), impacts)
        assert 0 < bound <= exactly + 1e-9


def test_odd_documents_and_items(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "one two three four five six seven"), (4, "Five six seven eight nine ten eleven twelve? Thirteen fourteen."), (4, "a")], "item_id long, text string")
    for shard in (200_000, 8):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        found = decontaminate.leaks(odd, items).collect()
        pairs = {(r["doc_id"], r["item_id"], r["kind"]) for r in found}
        assert {(d, i, "full") for d in (1, 2, 3, None) for i in (None, 4)} | {(9, 4, "full")} <= pairs
        assert len([r for r in found if r["doc_id"] == 2 and r["item_id"] == 4]) == 2
        kept = decontaminate.without_leaks(odd, items)
        assert kept.schema == odd.schema and not {1, 2, 3, 9} & {r["doc_id"] for r in kept.collect()}
    assert decontaminate.leaks(none, items).isEmpty() and decontaminate.leaks(odd, items.limit(0)).isEmpty()
    assert decontaminate.without_leaks(odd, items.limit(0)).count() == odd.count()


FIRST = "First paragraph has quite a lot of words in it so that it is certainly the text of an article and nothing else at all."
SECOND = "Second paragraph also has many words and says something different, as a paragraph of running prose does on most pages."
PROSE = f"<p>{FIRST}</p><p>{SECOND}</p>"


@pytest.mark.parametrize(
    "around",
    [
        '<div class="content has-sidebar">%s</div>', '<main class="with-sidebar">%s</main>', '<article class="post share-enabled">%s</article>',
        '<article class="post-12 type-post comments-open">%s</article>', '<div id="content" class="site-content right-sidebar">%s</div>',
        '<div id="page" class="no-menu">%s</div>', '<div class="share-price">%s</div>', '<div id="ad-free-zone">%s</div>',
        '<form action="/"><main>%s</main></form>', '<form><div class="main">x</div></form><div>%s</div>',
    ],
)
def test_layout_classes_hide_no_text(around):
    text = extract.extract(f"<html><head><title>t</title></head><body><nav><a>menu</a></nav>{around % PROSE}</body></html>")
    assert FIRST in text and SECOND in text and "menu" not in text


@pytest.mark.parametrize("name", ["comments", "post-comments", "right-sidebar", "cookie-notice", "main-menu"])
def test_furniture_by_name_is_left_out(name):
    assert extract.extract(f'<body><div id="content">{PROSE}</div><div class="{name}"><p>{FIRST} Not this.</p></div></body>') == f"{FIRST}\n\n{SECOND}"


def test_end_tag_of_a_head_and_stray_quotes():
    want = f"{FIRST}\n\n{SECOND}"
    assert extract.extract(f"<html><head><title>x</title><meta a=b><body><article>{PROSE}</article>") == want
    assert extract.extract(f"<head><title>x</title>{PROSE}") == want
    assert extract.extract(f'<body><p class=lead">{FIRST}</p><p id="b">{SECOND}</p>') == want
    assert extract.extract(f"<body><p a=\"1>2\" b='>' c = \">\">{FIRST}</p><p '>{SECOND}</p>") == want
