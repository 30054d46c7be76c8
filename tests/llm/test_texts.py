"""Quality rules, decontamination, toxicity, templates, scores, archives and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmaflow.llm import decontaminate, jaccard, language_model, quality, substring, template, toxicity, warc
from lemmaflow.llm.attention import STEP, Attention, padded, subwords
from lemmaflow.llm.text import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(repeated)}


def test_measures():
    rng = random.Random(1)
    parts = ["a", "b", "é", "日本", " ", "\n", "\t", "#", "$", "A ", "x y z ", "\n\n"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(800))]
    got = [{k: int(v[i]) for k, v in m.items()} for b in blocks(pa.array(texts), limit=500) for m in [quality.measures(b)] for i in range(b.n)]
    assert got == [brute_measures(t) for t in texts]


def test_quality_rules(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    junk = "### " * 40 + clean
    rows = [(i, clean + f" {i}", "good") for i in range(30)] + [(100 + i, junk, "bad") for i in range(30)] + [(200, clean, "bad"), (201, None, None), (202, "few words", "good"), (203, "x y z " * 40, "good"), (204, junk, "good"), (200, clean, "bad")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' as n_words", "1 as kept", "2 as host_bad")
    for keep_text, spare in ((True, False), (False, False), (True, True)):
        got = {r["doc_id"]: r for r in quality.quality_rules(df, keep_text=keep_text, spare_clean=spare).collect()}
        assert all(got[i]["kept"] for i in range(30)) and not any(got[100 + i]["kept"] for i in range(30))
        assert got[200]["kept"] == spare and got[204]["kept"]  # a clean text of a bad host, a poor text of a good one
        assert not any(got[i]["kept"] for i in (201, 202, 203)) and got[203]["base_failed"]
        assert quality.quality_rules(df, keep_text=keep_text).count() == len(rows)
    assert quality.quality_rules(df.limit(0)).collect() == []


def invented(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ko", "ri", "te", "lu", "mi"]) for _ in range(rng.randint(3, 5))) for _ in range(n)]


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(invented(rng, 30)) + ". " + " ".join(invented(rng, 8)) + ".") for i in range(12)] + [(50, None), (51, ""), (52, "of the")]
    rows, planted = [], set()
    for d in range(300):
        w = invented(rng, rng.choice([5, 120, 700]))
        if d % 10 == 0:
            i = d // 10 % 12
            leak = items[i][1].split()
            if d % 20 == 0:
                leak = [x.upper() + "!!" for x in leak]
            if d % 30 == 0:
                leak = leak[:4] + ["mid"] + leak[4:20] + leak[22:]
            at = rng.randrange(len(w))
            w = w[:at] + leak + w[at:]
            planted.add((d, i))
        rows.append((d, " ".join(w)))
    rows += [(300, None), (301, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as item_id", "3 as cosine")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()} == planted
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in planted}
    assert decontaminate.leaks(df.limit(0), bench).collect() == [] and decontaminate.leaks(df, bench.limit(0)).collect() == []


def reworded(rng, words):
    """A third of the words replaced or left out, some neighbours swapped."""
    out = [rng.choice(invented(rng, 1)) if rng.random() < 0.25 else w for w in words if rng.random() > 0.08]
    for i in range(0, len(out) - 1, 9):
        out[i], out[i + 1] = out[i + 1], out[i]
    return out


def test_recall_on_rewordings(spark, monkeypatch):
    """Latent search against a brute-force check of every passage and piece, short items among them."""
    rng = random.Random(13)
    items = [(i, " ".join(invented(rng, rng.choice([4, 6, 9, 16, 30, 70]))) + ". " + " ".join(invented(rng, 6)) + ".") for i in range(60)]
    rows, planted = [], set()
    for d in range(500):
        w = invented(rng, rng.choice([60, 200, 500]))
        if d % 3 == 0:
            i = d // 3 % 60
            at = rng.randrange(len(w))
            w = w[:at] + (items[i][1].split() if d % 2 else reworded(rng, items[i][1].split())) + w[at:]
            if d % 2:
                planted.add((d, i))
        rows.append((d, " ".join(w)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 600)  # several blocks
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    pieces = decontaminate.cut(items)
    n, df_ = decontaminate.document_frequencies(df, pieces.vocabulary)
    idf = decontaminate.weights_of(pieces, n, df_)
    brute = set()
    for d, text in rows:
        w = decontaminate.places_in(pieces.vocabulary, decontaminate.word_hashes(text))
        for lo in range(0, max(1, len(w) - 48), 48):
            passage = w[lo : lo + 96]
            brute |= {(d, int(i)) for i, piece, answer in zip(pieces.items, pieces.words, pieces.answers, strict=True) if decontaminate.is_match(piece, answer, passage, idf)}
    assert planted <= whole and planted <= got
    assert len(brute - planted) > 40 and len(whole & brute) >= 0.9 * len(brute) and whole <= brute
    assert len(got & brute) >= 0.9 * len(brute)


@pytest.mark.parametrize("seed", range(5))
def test_common_subsequence(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a, b = ([rng.randrange(-1, 5) for _ in range(rng.randint(0, 14))] for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y and y >= 0 else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(np.array(a, int), np.array(b, int)) == table[-1, -1]


def test_randomised_basis(spark):
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 40, 12).tolist() for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "words array<int>")
    idf = np.ones(40, np.float32)
    ends = np.arange(0, 12 * 201, 12)
    rows = decontaminate.tf_idf(ends, np.array(words).ravel(), idf)
    none = decontaminate.tf_idf(np.array([0]), np.zeros(0, int), idf)
    basis = decontaminate.latent_basis(df, none, idf, 40)
    assert basis.shape == (40, 40)
    assert np.allclose(basis.T @ basis, np.eye(40), atol=1e-4)
    dense = np.zeros((200, 40))
    dense[rows.row, rows.word] = rows.value
    energy = np.sort(np.linalg.norm(dense @ basis, axis=0))[::-1]
    assert np.allclose(energy, np.linalg.svd(dense, compute_uv=False), rtol=1e-3, atol=1e-3)


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = invented(rng, rng.choice([20, 60]))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["scorn", "scornful", "scorned", "vile"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "scorn scorn vile"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic", "'q' as score", "2 as lang")
    labelled = spark.createDataFrame([*labels, (None, 1), (902, None)], "doc_id long, toxic int")
    learns = toxicity.crc_remainder("doc_id", 3) != 1
    out = toxicity.scored(docs, toxicity.trained(docs, labelled, may_learn=learns, epochs=8)).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [(r["predicted"], r["doc_id"] % 4 == 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    few = toxicity.sample(docs, labelled, "toxic", learns, 3000, 6000, 20_000)
    assert 0 < sum(len(r[2].encode()) for r in few) <= 20_000 and few == toxicity.sample(docs, labelled, "toxic", learns, 3000, 6000, 1 << 30)[: len(few)]
    flat = toxicity.scored(docs, toxicity.trained(docs, labelled.limit(0))).collect()
    assert len({r["score"] for r in flat}) == 1
    assert toxicity.scored(docs.limit(0), toxicity.Convolutional()).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><article>x";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">{menu}</a></li></ul></nav><!-- <p>no</p> --><div class="ad">{ad}</div>
{open}<h1>{title}</h1><p>One &amp; {title}<br>two  <b>bold</b>
text<p>Three &lt;x&gt; {title}</p><p>Every page says so.</p>{close}<aside><p>related</p></aside><section id="comments"><p>nice!</p></section><form>f</form><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize(("open_", "close"), [("<article>", "</article>"), ("<div id=main-content>", "</div>"), ("<div class='x7'>", "</div>")])
def test_templates(spark, open_, close):
    rows = [(i, f"http://h{i % 3}.example/p{i}", PAGE.format(menu=f"m{i}", ad=f"buy {i}", title=f"Title {i} of a long article that has words", open=open_, close=close)) for i in range(20)]
    rows += [(30, "http://h0.example/x", None), (31, None, ""), (32, "odd", "<p>just a text"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'s' as slots", "2 as text")
    got = {r["page_id"]: r for r in template.extracted(df).collect()}
    for i in range(20):
        t = f"Title {i} of a long article that has words"
        assert got[i]["text"] == f"{t}\nOne & {t} two bold text\nThree <x> {t}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[30]["text"] == "" and got[31]["text"] == "" and got[32]["text"] == "just a text"
    assert template.extracted(df).count() == len(rows) and template.extracted(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a<p class='ad'>buy<div class='ad'>no</div><p>b <span class=share>tweet</span> c</article>", "a\nbuy\nb tweet c"),
        ("<article><p>Let <math><mi>x</mi></math> be <object>o</object> ... done</p><p class='social-science'>Para</p><h2 class='search'>Hd</h2></article>", "Let x be o ... done\nPara\nHd"),
        ("<main><header><h1>T</h1></header><p>x &nosuch; &#233;</p><div id='comments'><article>no</article></div></main>", "T\nx &nosuch; é"),
        ("<div id=header>Site</div><div class=content>one<ul><li>two<li>three</ul></div>", "one\ntwo\nthree"),
        ("<body><p>cut off <b>here", "cut off here"),
        ("<article><script>if (a < b) { '</p>' }</script>x<style>y</style><!-- z --></article>", "x"),
        ("<article>a<br>b</article><footer>c</footer>", "a b"),
        ("<div class='social search'>" + "most of the words " * 9 + "</div><div class=x>few</div>", " ".join(["most of the words"] * 9)),
        ("no markup < at 3 > all", "no markup < at 3 > all"),
        ("<dl><dt>a<dd>b<dt>c</dl><table><tr><td>d<td>e<tr><td>f</table>", "a\nb\nc\nd\ne\nf"),
        (None, ""),
    ],
)
def test_single_pages(page, text):
    assert template.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<div>", "<a '\">", '<a "<b>', "</p><div></i>", "<script ", "<!--", "<!", "<script></scrip", "&lt;<"])
def test_hostile_pages_take_linear_time(part):
    page = "<article>start</article>" + part * (1_000_000 // len(part))
    began = time.process_time()
    assert template.main_text(page).startswith("start")
    assert time.process_time() - began < 10


def test_copied_articles_stay_whole(spark):
    rows = [(i, "http://one.example/", PAGE.format(menu="m", ad="a", title="Same title", open="<article>", close="</article>")) for i in range(10)]
    texts = {r["text"] for r in template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {"Same title\nOne & Same title two bold text\nThree <x> Same title\nEvery page says so."}


def sentence(i, n=12):
    return " ".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest()[:6] for j in range(n))


#: No element and no name tells the article from the rest.
BARE = "<html><body><div class=q1><div class=q2>{long}</div><div class=q3><ul><li><a href=/>Home</a><li><a href=/>About</a></ul></div></div><div class=q4><div class=q5><h1>{title}</h1><p>{text}</p><div class=q6><div>Read  all our letters</div> every week</div><p>{more}</p></div></div><div class=q7>All rights are ours</div></body></html>"


@pytest.mark.parametrize("sent", [1 << 24, 0])
def test_templates_decide_where_names_say_nothing(spark, monkeypatch, sent):
    monkeypatch.setattr(template, "SENT", sent)
    fixed = sentence("menu", 80)
    rows = [(i, f"http://h{i % 2}.example/{i}", BARE.format(long=fixed, title=sentence(("t", i), 3), text=sentence(("a", i)), more=sentence(("b", i)))) for i in range(24)]
    # Another wording where the template has one, on a page of the host; and a host with too few pages to show a template.
    rows += [(100, "http://h0.example/x", rows[0][2].replace("every week", "every day")), (101, "http://lone.example/", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: [sentence(("t", i), 3), sentence(("a", i)), sentence(("b", i))]
    assert all(got[i] == "\n".join(own(i)) for i in range(24))
    assert got[100] == "\n".join([*own(0)[:2], "every day", own(0)[2]])
    assert fixed in got[101] and template.main_text(rows[0][2]) == got[101] != got[0]  # the template changed the result


def test_classes_need_size_and_support(spark):
    # Each page of the host repeats one paragraph; alone in its class on half the pages, it is no template.
    page = lambda i: f"<article><h1>{sentence(i, 3)}</h1><p>{sentence(('p', i))}</p>" + ("<p>a line that many pages share</p>" if i % 2 else "") + "</article>"
    rows = [(i, "http://c.example/", page(i)) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("a line that many pages share" in t) == (i % 2 == 1) and sentence(("p", i)) in t for i, t in got.items())


def test_interleaved_tokens_are_split_by_slot():
    token = lambda key, up, kind, pages=10, v=1, **more: {"key": key, "up": up, "kind": kind, "tag": "div", "off": False, "named": False, "main": False, "pages": pages, "v1": v, "v2": v, "text": 0, "link": 0, "direct": 0} | more
    rows = [token(0, 0, 0, text=500), token(1, 0, 0, text=400), token(2, 0, 0, text=100)]
    nested = [token(11, 1, 0, v=7, text=390), token(12, 2, 0, v=7, text=90)]  # one vector, but in two slots: too few tokens in each
    assert template.deduced(rows + nested, 10).slot == 1
    assert template.deduced([*rows, *nested, token(13, 11, 1, v=7)], 10).slot == 11
    assert template.deduced([*rows, *nested, token(13, 11, 1, v=6)], 10).slot == 1  # of another class
    text = [token(20, 1, 2, pages=9, v=8, text=9), token(21, 1, 2, pages=8, v=9, text=9), token(22, 11, 2, v=9, text=9)]
    assert template.deduced(rows + text, 10).texts == {20}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div id='content' class='has-sidebar'>one<div class='sidebar-content'>no</div></div>", "one"),
        ("<div class='post comment-open'>one</div><div class='comment'>no</div>", "one"),
        ("<div class='has-sidebar'><p>one of many words</div><div class='ad'>no</div>", "one of many words"),
        ("<section class='entry-intro'>one</section><section class='entry-body'>one and more</section><footer>no</footer>", "one\none and more"),
    ],
)
def test_main_containers_stay(spark, page, text):
    rows = [(i, "http://m.example/", page.replace("one", f"one{i}")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text.replace("one", f"one{i}") for i in range(5)}


VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("head", [1 << 19, 5])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n\t"]).join(invented(rng, rng.choice([0, 1, 9, 80])))) for i in range(150)] + [(150, None), (151, "É Über x A"), (3, "again"), (None, "the of")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as held_out", "2 as learns")
    got = language_model.scored(df, *VOCABULARY, toxicity.crc_remainder("doc_id", 7) == 2).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    expected = Counter((d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, round(sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model.scored(df.limit(0), *VOCABULARY, F.lit(False)).collect() == []


def test_scores_use_all_counts(spark, monkeypatch):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, " ".join(invented(rng, 40))) for i in range(80)] + [(90, "of of lone " + "x" * 3000), (91, None)], "doc_id long, text string")
    got = []
    for head in (1 << 19, 5, 0):
        monkeypatch.setattr(language_model, "HEAD", head)
        got.append({r["doc_id"]: r["score"] for r in language_model.scored(df, *VOCABULARY, toxicity.crc_remainder("doc_id", 7) == 2).collect()})
    assert all(np.allclose([g[d] for d in got[0]], list(got[0].values()), rtol=1e-9) for g in got[1:])


def test_every_document_trains(spark):
    signs = list("!#$%&()*+,-./:;<=>?@[]^_{|}~")
    rows = [(f"a b {i % 50}", True) for i in range(16_000)] + [(f"{x} {x}", True) for x in signs for _ in range(30)] + [("` `", False)] * 30
    docs = spark.createDataFrame(rows, "text string, learns boolean").repartition(4)
    model = Attention.from_counts(np.random.default_rng(4).integers(0, 5, (1025, 1025)).astype(float))
    before = model.weights["state"].copy()
    made = language_model.encoded_texts(docs.selectExpr("1 as doc_id", "text", "not learns as held_out", "learns"), *VOCABULARY, 1024, language_model.ROUNDS)
    moved = np.abs(language_model.trained(made, model, 1024).weights["state"] - before).max(axis=1) > 1e-6
    code = subwords(*VOCABULARY, 1024)
    used = lambda x: moved[code.encode_ordinary(" " + x)]
    assert all(used(x).all() for x in signs) and not used("`").all()


def test_attention_is_causal_and_sums_to_one():
    rng = np.random.default_rng(2)
    n = 60
    counts = rng.integers(0, 5, (n, n)).astype(float)
    model = Attention.from_counts(counts)
    model.weights["out"] = rng.standard_normal(model.weights["out"].shape).astype(np.float32)
    ids = rng.integers(0, n, 41)
    first = np.array([0, 20, 40])
    base = model.log_probabilities(ids, first)
    changed = ids.copy()
    changed[30:] = rng.integers(0, n, 11)
    assert np.allclose(model.log_probabilities(changed, first)[:29], base[:29], atol=1e-5)
    total = 0.0
    for x in range(n):  # the probabilities of all next tokens at one place
        other = ids.copy()
        other[16] = x
        total += float(np.exp(model.log_probabilities(other, first)[15]))
    assert abs(total - 1) < 1e-3


def test_every_window_moves_attention():
    rng = np.random.Generator(np.random.PCG64(5))
    size, wide = 320, 2 * STEP
    ids = np.append(size, np.arange(size))  # every subword stands in one window only
    model = Attention.from_counts(rng.random((size + 1, size + 1)))
    model.weights["out"] = rng.standard_normal(model.weights["out"].shape).astype(np.float32)
    before = model.weights["embed"]
    assert model.train(ids, np.array([0, size]), batch=2) == size
    moved = (model.weights["embed"] != before).any(axis=1)
    assert moved[ids[:-1]].all() and size // wide > 2 * 4


def test_training_is_plain_adam():
    rng = np.random.default_rng(6)
    n, wide, steps = 40, 2 * STEP, 3
    counts = rng.integers(0, 5, (n, n)).astype(float)
    ids, first = rng.integers(0, n, 4 * steps * wide + 1), np.array([0, 4 * steps * wide])
    model, plain = Attention.from_counts(counts), Attention.from_counts(counts)
    given, copies = dict(model.weights), {k: v.copy() for k, v in model.weights.items()}
    model.train(ids, first, batch=4, rate=0.01, seed=1)
    assert all((given[k] == copies[k]).all() for k in given)
    assert len({id(v.base) for v in model.weights.values()}) == 1 and model.weights["q"].base is not None  # a step moves all at once
    asks, target = (x.reshape(-1, wide) for x in padded(ids, first, wide)[:2])
    order = np.random.Generator(np.random.PCG64(1)).permutation(len(asks))
    m, s = dict.fromkeys(given, 0.0), dict.fromkeys(given, 0.0)
    for t in range(steps):
        pick = order[4 * t : 4 * t + 4]
        _, seen, g = plain.gradients(asks[pick], target[pick], np.ones((4, wide), bool))
        for k in g:
            grad = g[k].astype(float) / seen
            m[k], s[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * s[k] + 0.01 * grad**2
            step = m[k] / (1 - 0.9 ** (t + 1)) / (np.sqrt(s[k] / (1 - 0.99 ** (t + 1))) + 1e-6)
            plain.weights[k] = (plain.weights[k] - 0.01 * (1 - 0.9 * t / steps) * (t + 1) / 10 * step).astype(np.float32)
    assert all(np.allclose(model.weights[k], plain.weights[k], atol=1e-5) for k in given)
    assert not np.allclose(model.weights["q"], given["q"], atol=1e-5)


def test_hyperbolic_tangents():
    from lemmaflow.llm.attention import _tanh

    x = np.array([-np.inf, -200, -30, -1, -1e-3, 0, 1e-3, 1, 30, 200, np.inf], np.float32)
    assert np.allclose(_tanh(x.copy()), np.tanh(x), rtol=0, atol=3e-7)


def test_attention_gradients():
    rng = np.random.default_rng(3)
    n = 50
    model = Attention.from_counts(rng.integers(0, 5, (n, n)).astype(float))
    model.weights["out"] = 0.3 * rng.standard_normal(model.weights["out"].shape).astype(np.float32)
    ids = rng.integers(0, n, 31)
    here, target, where, _ = (x.reshape(-1, 16) if len(x) == 32 else x for x in padded(ids, np.array([0, 30]), 16))
    real = np.isin(np.arange(32), where).reshape(-1, 16)
    loss = lambda: -np.log(model.gradients(here, target, real)[0]).sum() / 30
    seen, grads = model.gradients(here, target, real)[1:]
    grads = {k: v / 30 for k, v in grads.items()}
    assert seen == 30 and all(np.allclose(v / 30, grads[k]) for k, v in model.gradients(here, target, real, False)[2].items())
    for name, at in (("out", (3, 4)), ("state", (int(ids[5]), 2)), ("q", (1, 2)), ("k", (2, 3)), ("v", (4, 5)), ("embed", (int(ids[9]), 1)), ("lag", (1,))):
        w = model.weights[name]
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at]), name


def test_archives(spark):
    rows = [(1, "u", "x"), (2, "u\r\ny", "x"), (3, None, None), (4, "a", ""), (5, "b", "\x1f\x8b\x08zz"), (2, "u", "x"), (None, "q", "x"), (1, "u", "x"), (6, "c", "é" * 30_000)]
    rows += [(10 + i, f"http://h/{i}", hashlib.sha256(str(i % 25).encode()).hexdigest() * (i % 40)) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as path", "2 as size", "3 as first_id").repartition(3)
    first: dict[str, int] = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    expected = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first[h or ""]
        expected[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == f else "revisit", None if p == f else f] += 1
    manifest = warc.write_archives(df, file_bytes=20_000)
    assert manifest.count() >= 2
    for split in (997, 1 << 25):
        back = warc.read_archives(spark, manifest, split)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()) == expected
    assert {r["payload"] for r in back.where("page_id = 6").collect()} == {"é" * 30_000}
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).collect() == []


def test_scanner_skips_false_magic():
    member = warc.record(1, "u", b"\x1f\x8b\x08" * 50, None)
    data = b"\x1f\x8b\x08junk" + member + b"\x1f\x8b\x08" + warc.record(2, "v", b"y", None)
    for cut in range(0, len(data), 13):
        found = [warc.parsed(m.data)["page_id"] for lo, hi in ((0, cut), (cut, len(data))) for m in warc.Scanner(pa.BufferReader(data), lo, hi)]
        assert found == [1, 2]


def test_very_long_texts(spark):
    """Two near copies of 150,000 words among short texts, through each operator."""
    rng = random.Random(21)
    long = invented(rng, 150_000)
    other = [*long[:70_000], "changed", *long[70_001:]]
    rows = [(1, " ".join(long)), (2, " ".join(other)), *((10 + i, " ".join(invented(rng, 60))) for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    comps = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert comps[2] == 1 and all(comps[10 + i] == 10 + i for i in range(20))
    kept = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in substring.repeated_removed(docs, 35, keep_text=False).collect()}
    assert kept[1] == kept[2] == 1 and all(kept[10 + i] == 60 for i in range(20))
    found = {r["doc_id"]: r for r in quality.quality_rules(docs, keep_text=False).collect()}
    assert found[1]["n_words"] == 150_000
    scores = {r["doc_id"]: r for r in language_model.scored(docs, *VOCABULARY, F.lit(False)).collect()}
    assert scores[1]["n_tokens"] == 150_001 and np.isfinite(scores[2]["score"])
    bench = spark.createDataFrame([(5, " ".join(long[140_000:140_030]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()} == {1, 2}
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, toxicity.Convolutional()).collect())
    page = "<div>menu</div><article>" + "".join(f"<p>{x}</p>" for x in long[:100_000]) + "</article>"
    assert template.main_text(page) == "\n".join(long[:100_000])
