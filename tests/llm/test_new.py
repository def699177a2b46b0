"""Spelling variants, HTML extraction and fill-in-middle against brute force, held-out pages and exact round trips, with their defined results for odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import fill_middle, html_text, queries, spelling
from seriesmill.llm.html_blocks import blocks
from seriesmill.llm.html_pages import Writer, labelled_pages

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, word string, key int, form string, output string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "r", "w", 1, "f", "o") for i, t in zip(ids or range(len(texts)), texts)], DOC)


# ---------------------------------------------------------------- 11


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, least_length=5, least_n=3, drop=97):
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least_n}


def brute_variants(n, ratio=2):
    """Neighbours by all single edits over the words' letters, not by comparison of words."""
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
        near[w] = {x for x in made if x in n and x != w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_counts(rows))
    assert got_variants(queries.op11_spelling(spark, small)) == want and sum(x[0] is not None for x in want.values()) > 100


@pytest.mark.parametrize("tile_rows, block", [(4096, 128), (6, 4)])
def test_spelling_with_hot_keys_ties_and_short_words(spark, tile_rows, block):
    """Keys of more words than tile_rows are cut; blocks end within groups; forms chain; letters repeat."""
    rng = random.Random(tile_rows)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(700)} | {"a" * k for k in range(1, 40)} | {"x" * 3000, "x" * 3001, "y" + "x" * 3000}
    n = {w: rng.choice([1, 2, 3, 4, 8, 16, 64]) for w in words}
    df = spark.createDataFrame([*[(w, k, 1) for w, k in n.items()], (None, 9, 1)], "word string, n int, size int")
    assert got_variants(spelling.spelling_variants(df, tile_rows=tile_rows, block=block)) == brute_variants(n)


def test_spelling_counts_on_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéÀß×") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    texts = [None, "", "  ", "Straße ÀÉ × ÷", "x" * 40_000, *[" ".join(rng.choice(vocabulary).title() for _ in range(rng.randint(1, 300))) for _ in range(60)]]
    ids = [None, *range(1, len(texts) - 1), 3]
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs(spark, texts, ids), least_length=4, least_n=2).collect()}
    assert got == brute_counts(list(zip(ids, texts)), 4, 2) and len(got) > 50
    empty = spelling.spelling_variants(spelling.word_counts(docs(spark, ["x"]).limit(0)))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_common_ends_decide_single_edits():
    rng = random.Random(5)
    a = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    points = lambda ws: (np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, ws)]))
    left, right = spelling.matrices(*points(a), 0)
    other_left, other_right = spelling.matrices(*points(a), 1)
    both = spelling.common(left, other_left) + spelling.common(right, other_right)
    for i, j in itertools.product(range(60), repeat=2):
        if abs(len(a[i]) - len(a[j])) <= 1 and a[i] != a[j]:
            assert (both[i, j] >= max(len(a[i]), len(a[j])) - 1) == one_edit(a[i], a[j]), (a[i], a[j])


def test_forms_chain_to_their_root(spark):
    n = {"w" * k: 2 ** (20 - k) for k in range(1, 20)}
    got = got_variants(spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert all(x[1] == "w" for x in got.values()) and got["www"][0] == "ww"
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"), ratio=1)


# ---------------------------------------------------------------- 12


@pytest.fixture(scope="module")
def field(spark):
    return html_text.train(labelled_pages(spark, 250))


def test_blocks_of_broken_pages():
    of = lambda p: [(b.text, b.at.tag) for b in blocks(p)]
    assert of("<p>a<p>b &amp;lt; <b>c<br>d</p>tail") == [("a", "p"), ("b &lt; c d", "p"), ("tail", "")]
    assert of("<ul><li>x<li>y<ul><li>z</ul></ul>q") == [("x", "li"), ("y", "li"), ("z", "li"), ("q", "")]
    assert of("<table><tr><td>a<td>b<tr><th>c</table>d") == [("a", "td"), ("b", "td"), ("c", "th"), ("d", "")]
    assert of('x<script>var t="</p>";</script>y<style>p{}</style><!-- <p>no</p> -->z') == [("xyz", "")]
    assert of("a < b and c > d &copy &#233; &am <div") == [("a < b and c > d © é &am", "")]
    assert of('<P CLASS=x title="a>b">c</P><p title="q>d') == [("c", "p"), ("d", "p")]
    assert of("yes<!-- open <p>z") == [("yes", "")] and of("") == [] and of("<!--><p>a") == [("a", "p")]
    assert of("<p>a  \n\tb</p><script>open <p>z</p>") == [("a b", "p")]
    assert [b.linked for b in blocks("<div><a href=q>link</a> text</div>")] == [4]
    assert [b.at.names for b in blocks('<div class="mainContent ad-box" hidden>t</div>')] == [("ad", "box", "content", "hidden", "main")]
    assert len(blocks("<div>" * 3000 + "x" + "<a<" * 3000)) == 1


def test_field_decodes_the_best_of_all_label_sequences():
    rng = random.Random(1)
    names = ["t:p", "t:li", "t:nav", "own:p", "l:0", "l:4", "e:stop", "n:0", "q:0", "first", "last", "t:article"]
    for seed in range(30):
        field = html_text.Field({f: rng.uniform(-2, 2) for f in names}, np.array([rng.uniform(-2, 2) for _ in range(8)]).reshape(2, 2, 2), np.array([rng.uniform(-1, 1), 0]))
        page = blocks(Writer(seed).page()[0])[:9]
        paths = html_text.Paths(field.weights)
        features, same = html_text.page_features(page, paths)
        emit = [sum(field.weights.get(f, 0) for f in own) + sum(field.weights.get(f, 0) for f in paths.of(b.at)[0]) for b, own in zip(page, features)]

        def score(y):
            return field.start[y[0]] + sum(e for e, label in zip(emit, y) if label) + sum(field.steps[same[k], y[k - 1], y[k]] for k in range(1, len(y)))

        best = max(itertools.product((0, 1), repeat=len(page)), key=score)
        assert score(field.decode(page)) == pytest.approx(score(best))


def test_field_finds_articles_of_held_out_pages(field):
    right = wrong = missed = 0
    for seed in range(10**6, 10**6 + 150):
        page, text = Writer(seed).page()
        parsed = blocks(page)
        want = html_text.labels_of(parsed, text)
        assert sum(want) == len([x for x in text.split("\n\n") if x])
        for b, y, z in zip(parsed, want, field.decode(parsed)):
            right, wrong, missed = right + len(b.text) * (y and z), wrong + len(b.text) * (z and not y), missed + len(b.text) * (y and not z)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98
    assert html_text.Field.from_json(field.to_json()).decode(parsed) == field.decode(parsed)


def test_neighbours_change_the_decision(field):
    """The chain matters: without the scores of neighbouring labels other blocks are picked."""
    alone = html_text.Field(field.weights, np.zeros((2, 2, 2)), field.start)
    pages = [blocks(Writer(s).page()[0]) for s in range(2 * 10**6, 2 * 10**6 + 100)]
    assert any(alone.decode(p) != field.decode(p) for p in pages)


def test_html_query_returns_the_articles_of_all_pages(spark, small):
    got = {r["page_id"]: r for r in queries.op12_html(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        want = "\n\n".join(b.text for b in blocks(inner[1])) if inner else ""
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_html_on_odd_rows(spark, field):
    page = Writer(7).page()[0]
    pages = spark.createDataFrame([(1, None, "a", "t"), (2, "", "b", "t"), (3, page, None, "t"), (3, page, None, "t"), (None, "<p>" + "word, " * 300_000 + "end.</p>", "c", "t"), (5, "\x00<", "d", "t")], "page_id long, html string, row string, text string")
    out = html_text.extract(pages, field).collect()
    assert len(out) == 6 and [r["text"] for r in out if r["row"]["page_id"] in (1, 2)] == ["", ""]
    assert len({r["text"] for r in out if r["row"]["page_id"] == 3}) == 1 and [len(r["text"]) for r in out if r["row"]["page_id"] is None][0] in (0, 6 * 300_000 + 4)
    assert html_text.extract(pages.limit(0), field).count() == 0
    nothing = html_text.train(pages.limit(0))
    assert {r["text"] for r in html_text.extract(pages, nothing).collect()} == {""}


# ---------------------------------------------------------------- 13


def test_skip_list_reaches_ranks_by_widths():
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 500, 3000):
        widths = [rng.randint(0, 9) for _ in range(n)]
        lanes = fill_middle.SkipList(widths)
        assert [lanes.seek(k) for k in range(n + 1)] == [0, *itertools.accumulate(widths)]
        for k in range(1, len(lanes.units)):  # a lane's links are sums of the links below them
            for i, (u, c) in enumerate(zip(lanes.units[k], lanes.chars[k])):
                a, b = lanes.down[k][i], lanes.down[k][i + 1]
                assert (u, c) == (sum(lanes.units[k - 1][a:b]), sum(lanes.chars[k - 1][a:b]))
    assert len(lanes.units) > 3 and len(lanes.units[1]) < 1500
    with pytest.raises(IndexError):
        lanes.seek(3001)


def brute_fill(doc_id, text, seed=7, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or h[2] % 100 >= rate or any(m in t for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, t
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm, seed", [(100, 50, 7), (60, 0, 1), (0, 100, 2)])
def test_fill_in_middle_equals_brute_force_and_restores(spark, rate, spm, seed):
    rng = random.Random(seed)
    line = lambda: "".join(rng.choice("ab é\U0001f600<SMP") for _ in range(rng.randint(0, 12)))
    texts = [None, "", "\n", "\n\n\n", "one line", "has <M> mark\nx", "a\r\nb c\x00", "é" * 100_000 + "\n" + "b", "".join(f"l{k}\n" for k in range(20_000)), *["\n".join(line() for _ in range(rng.randint(1, 30))) for _ in range(120)]]
    ids = [None, *range(1, len(texts) - 1), 3]
    df = fill_middle.fill_in_middle(docs(spark, texts, ids), seed=seed, rate=rate, spm=spm).withColumn("back", fill_middle.restored("output", "form"))
    got = df.collect()
    want = Counter((i, *brute_fill(i, t, seed, rate, spm), t or "") for i, t in zip(ids, texts))
    assert Counter((r["row"]["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert {r["form"] for r in got} == ({"plain", "psm", "spm"} if 0 < spm < 100 else {"plain", "psm"} if rate else {"plain"})


def test_fill_in_middle_by_other_units_and_marks(spark):
    text, marks = "one two  three four", ("\u0001p", "\u0001s", "\u0001m")
    df = fill_middle.fill_in_middle(docs(spark, [text] * 40), unit=r"\S+\s*", marks=marks).withColumn("back", fill_middle.restored("output", "form", marks))
    rows = df.collect()
    assert all(r["n"] == 4 and r["back"] == text and r["prefix_chars"] in (0, 4, 9, 15, 19) for r in rows) and len({r["output"] for r in rows}) > 5
    assert fill_middle.unit_widths("..a.b..", re.compile("[ab]")) == [3, 4]
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs(spark, [text]), marks=("<P>", "<S>", "P>"))
    assert fill_middle.fill_in_middle(docs(spark, ["x"]).limit(0)).count() == 0


def test_fill_in_middle_query(spark, small):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op13_fill_middle(spark, small)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        n, form, a, m, made = brute_fill(r["doc_id"], rows[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, a, m, sha(made), sha(rows[r["doc_id"]] or ""))
    assert got.where(F.col("form") == "plain").count() < len(rows)
