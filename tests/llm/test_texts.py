"""Page text, token counts, segmentations."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece

from stallwise.llm import html_text, segmentations, token_counts
from stallwise.llm.token_counts import default_model

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site name</h1><p>Our motto, always, everywhere, for you.</p></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as everyone does, and ask you kindly to accept all of them.</div>
<main><article><h2>The  River&nbsp;story</h2><p>It was &lt;long&gt; ago, <b>very</b>\n long; the river, wide and slow, ran on.<p>Short.
<div class="ad-box">Buy now, buy here, buy more, buy often.</div><ul><li>First thing, then<li>Second thing</ul>
<blockquote>Quoted, at length, by an old friend of ours.</blockquote><form><label>Your mail</label><input></form>
<p>Last words &amp; farewell<br>for now.</p></article><section class="comments"><p>Great post, I liked it very much, thanks, really.</p></section></main>
<aside>Related: <a href=x>other</a></aside><footer>&copy; 2024, all rights, no wrongs.</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "\n".join([
        "The River story", "It was <long> ago, very long; the river, wide and slow, ran on.", "Short.", "First thing, then", "Second thing",
        "Quoted, at length, by an old friend of ours.", "Last words & farewell for now."])


def test_main_text_without_marked_elements():
    body = "".join(f"<p>Sentence number {i}, with some commas, and an end.</p>" for i in range(5))
    page = f"<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=story>{body}<p>Fin.</p></div><div class=footer>Imprint, contact, terms.</div>"
    assert html_text.main_text(page).split("\n") == [f"Sentence number {i}, with some commas, and an end." for i in range(5)] + ["Fin."]


def test_classes_of_articles():
    text = "Long story, told well, and to the end. " * 3
    page = f'<main class="with-sidebar"><article class="post share-buttons-on"><p>{text}</p></article><article class="comment"><p>I agree, fully.</p></article></main>'
    assert html_text.main_text(page) == text.strip()


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<p class='x", "</p></p>", "<!--", "<script>x", "<nav>a, b.</nav>", "<![CDATA[x"])
def test_pages_without_text(page):
    assert html_text.main_text(page) == ""


def test_odd_pages():
    assert html_text.main_text("<") == "<"
    assert html_text.main_text("just text, no tags") == "just text, no tags"
    assert html_text.main_text("<p>a < b and c > d, so.") == "a < b and c > d, so."
    deep = "<div>" * 3000 + "deep text, here." + "</div>" * 3000
    assert html_text.main_text(deep) == "deep text, here."


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>Only, this.</p>"), (1, "u", PAGE)],
                                  "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as k")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert {(r.page_id, r.url, r.n_chars == len(r.text), r.text[:5]) for r in got.collect()} == {
        (1, "u", True, "The R"), (2, None, True, ""), (None, "v", True, "Only,")}
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def some_texts():
    dice = random.Random(8)
    words = "the river of tion ouwhea Éçeau dieüauß 123 ,. \t\n # 中文字 ﬁ é́ 😀 a".split(" ")
    texts = [None, "", " ", "  ", "\n", "a", " a ", "x" * 500, "▁", "a▁b " * 900, "<s> </s> <unk> <0x0A>", "\0 a", "é" * 3000, " " * 5000, "ab  " * 2000]
    texts += [" ".join(dice.choice(words) for _ in range(dice.randrange(3000))) for _ in range(12)]
    texts += ["".join(dice.choice("ab   \nthe") for _ in range(20000)), "in" * 9000 + " tail " + "on" * 4000 + " " + "word " * 3000]
    return texts


def test_counts_equal_the_library(sp):
    texts = some_texts()
    want = [len(sp.encode(t or "")) for t in texts]
    for chunk, overlap in ((2048, 64), (16, 1), (100, 7)):
        assert token_counts.Counter(default_model(), chunk, overlap).count(texts) == want


def test_chunks_overlap_and_cover():
    counter = token_counts.Counter(default_model(), 50, 5)
    text = " ".join("word" * (1 + i % 9) for i in range(200))
    cuts = counter.cuts(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and len(cuts) > 10
    for (_, end, splice), (start, _, _) in zip(cuts, cuts[1:]):
        assert start < splice <= end and text[splice] == " " != text[splice - 1]


def test_counted_rows(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a"), (5, "a")], "doc_id long, text string").selectExpr("*", "1 as k", "2 as n_bytes")
    got = token_counts.counted(docs, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2 and all(r.over_limit == (r.n_tokens > 3) for r in rows)
    assert {r.doc_id: r.n_bytes for r in rows if r.doc_id == 12} == {12: 6000}
    assert token_counts.counted(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sampler():
    return segmentations.Sampler(default_model(), 6)


def everything(text):
    """All segmentations of a short text with their probabilities."""
    v = segmentations.Vocabulary(default_model())
    whole = "▁" + text.replace(" ", "▁")
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    out = []

    def grow(at, ids, weight):
        if at == len(whole):
            out.append((tuple(ids), weight))
            return
        if whole[at] not in pieces:
            raw = whole[at].encode()
            grow(at + 1, ids + [int(v.byte_id[b]) for b in raw], weight + v.byte_weight * len(raw))
        for end in range(at + 1, len(whole) + 1):
            i = pieces.get(whole[at:end])
            if i is not None:
                grow(end, ids + [i], weight - math.log(-sp.get_score(i) + segmentations.RANK_SHIFT))

    grow(0, [], 0.0)
    total = math.log(sum(math.exp(w) for _, w in out))
    return {ids: w - total for ids, w in out}


def test_probabilities_and_frequencies_against_enumeration(sampler):
    text = "the\n in"
    want = everything(text)
    n, first, both = 6000, Counter(), Counter()
    for k, found in enumerate(sampler.sample(list(range(n)), [text] * n)):
        ids = [tuple(sampler.ids(p).tolist()) for p, *_ in found]
        assert len(set(ids)) == len(ids) == min(6, len(want))
        assert all(abs(lp - want[i]) < 1e-6 for i, (_, lp, _, _) in zip(ids, found))
        bounds = [g for *_, g, _ in found]
        assert bounds == sorted(bounds, reverse=True)
        first[ids[0]] += 1
        both[ids[0], ids[1]] += 1
    for i, lp in want.items():
        p = math.exp(lp)
        assert abs(first[i] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 3
    for a, b in itertools.permutations(list(want)[:6], 2):  # without replacement: p(a) p(b) / (1 - p(a))
        p = math.exp(want[a] + want[b]) / (1 - math.exp(want[a]))
        assert abs(both[a, b] - n * p) < 5 * math.sqrt(n * p) + 3


def test_inclusion_makes_sums_unbiased(sampler):
    """Mean over many keys of sum(f / inclusion * p) over all samples but the threshold's equals the expectation of f."""
    text = "other the"
    want = everything(text)
    mean = sum(math.exp(lp) * len(ids) for ids, lp in want.items())
    few = segmentations.Sampler(default_model(), 3)
    n, total = 4000, 0.0
    for found in few.sample(list(range(n)), [text] * n):
        total += sum(math.exp(lp) / q * len(few.ids(p)) for p, lp, _, q in found)
    assert abs(total / n - mean) < 0.05 * mean


def test_a_text_with_few_segmentations_gives_them_all(sampler):
    for text in ("", "中", "\n"):
        want = everything(text) if text else {(): 0.0}
        found = sampler.sample([1], [text])[0]
        assert len(found) == min(6, len(want))
        if len(want) <= 6:
            assert {tuple(sampler.ids(p).tolist()) for p, *_ in found} == set(want)
            assert all(q == 1.0 for *_, q in found)


def test_a_row_does_not_depend_on_its_batch(sampler):
    texts = ["the river runs on and on", "of the tion", "word " * 400]
    one = [sampler.sample([k], [t])[0] for k, t in enumerate(texts)]
    other = segmentations.Sampler(default_model(), 6).sample([2, 1, 0], texts[::-1])[::-1]
    for a, b in zip(one, other):
        assert [(sampler.ids(p).tolist(), round(lp, 6), round(g, 6)) for p, lp, g, _ in a] is not None
        assert [round(g, 6) for *_, g, _ in a] == [round(g, 6) for *_, g, _ in b]
        assert [round(lp, 6) for _, lp, *_ in a] == [round(lp, 6) for _, lp, *_ in b]


def test_encode_and_decode_rows(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (4, "\n")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as k")
    coded = segmentations.encode(docs, 3)
    rows = coded.collect()
    assert all(r.exact for r in rows) and all(0 < r.inclusion <= 1 for r in rows if r.log_prob > -600)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.sample, tuple(r.ids)))
    assert by[0] == [(1, ())] and set(by) == {*range(len(texts)), None}
    assert all(len({i for _, i in v}) == len({s for s, _ in v}) for k, v in by.items())
    back = segmentations.decode(coded.select("doc_id", "sample", "ids"))
    assert back.columns == ["doc_id", "sample", "text"]
    for r in back.collect():
        if r.doc_id is not None and r.doc_id != 4:
            assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    assert segmentations.encode(docs.limit(0)).count() == 0


def test_a_task_holds_little_however_many_texts_and_words_it_meets(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    docs = spark.createDataFrame([], "doc_id long, text string")
    caught = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, mapped, schema: caught.append(mapped) or self)
    segmentations.encode(docs)
    monkeypatch.undo()
    draw = random.Random(3)

    def batches():  # a million characters, almost every word a new one
        for n in range(0, 512, 256):
            texts = [" ".join("".join(draw.choices("etaoinshrdlu", k=9)) for _ in range(200)) for _ in range(256)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n, n + 256), pa.int64()), pa.array(texts)], names=["k", "text"])

    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in caught[0](batches())) == 512 * segmentations.SAMPLES
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 160e6


def test_only_lattices_of_words_that_come_back_are_kept():
    sampler = segmentations.Sampler(default_model(), 2)
    draw = random.Random(5)
    steps = [[" ".join(["shared", "words", *("".join(draw.choices("etaoinshrdlu", k=9)) for _ in range(300))]) for _ in range(4)] for _ in range(3)]
    apart = [segmentations.Sampler(default_model(), 2).sample(list(range(4)), texts) for texts in steps]
    for texts, want in zip(steps, apart):
        found = sampler.sample(list(range(4)), texts)
        assert [[x[1:] for x in row] for row in found] == [[x[1:] for x in row] for row in want]
        raw, places = sampler.lattices.v.joined(sampler.ids_of([row[0][0] for row in found])[0])
        assert raw.decode() == "".join(" " + t for t in texts) and places[-1] == len(raw)
    # of some 3,600 words of three steps, those of the last one, the two that came back and a few that share a mark with another
    assert len(sampler.lattices.start) < 1300 and sampler.lattices.kept[0] < 300


def test_numbers_are_drawn_for_all_rows_of_a_step_together(sampler, monkeypatch):
    calls, draw = [], segmentations.uniforms
    monkeypatch.setattr(segmentations, "uniforms", lambda *a: calls.append(1) or draw(*a))
    counts = []
    for rows in (2, 64):
        calls.clear()
        sampler.sample(list(range(rows)), ["the river runs on and on\nand on " * 20] * rows)
        counts.append(len(calls))
    assert counts[1] < 2 * counts[0]


def test_units_are_runs_of_blanks_with_what_follows_and_line_ends():
    lattices = segmentations.Lattices(segmentations.Vocabulary(default_model()))
    apart = "" if "\n" in lattices.v.inner else "\n"
    draw = random.Random(8)
    for _ in range(300):
        text = "".join(draw.choices("ab ▁\n中", k=draw.randrange(1, 12)))
        units = lattices.units(text)
        assert "".join(units) == " " + text.replace("▁", " ")
        whole, want = " " + text.replace("▁", " "), [0]
        for i in range(1, len(whole)):
            if whole[i] == apart or whole[i - 1] == apart or (whole[i] == " " != whole[i - 1]):
                want.append(i)
        assert list(itertools.accumulate(map(len, units), initial=0))[:-1] == want
    assert lattices.units("") == []
