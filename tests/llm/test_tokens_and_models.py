"""Token counts, SentencePiece, main text and language ID."""

import math
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from fixtures import EDGE, SF, edge
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from curatorium.llm import langid, pages, pieces, registry, store, tokens

registry.load_all()
JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(JSON)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["op4_token_counts"](spark, SF).collect():
        text = texts.pop(r["doc_id"])
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert not texts


def test_token_counts_of_odd_strings():
    rng = random.Random(1)
    odd = ["a", "b", " ", "  ", "\n", "é", "ß", "日本", "😀", "<|endoftext|>", "'s", "'ll", "1", "٣", "\xa0", "\x1c", "\x85", "aaaa", "\t", "!", "​"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["ab" * 20_000, "qwertyuiop" * 2000]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(JSON)(texts) == want


def test_token_counts_of_very_long_words():
    rng = random.Random(2)
    letters = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [letters("ACGT", 40_000), letters("abcdefghijklmnopqrstuvwxyz", 30_000), "a" * 20_001, "é" * 3000 + "日本語" * 900, letters("abc", 700) + " " + "x" * 513, "=" * 10_001, "the" * 200, letters("0123456789abcdef", 9000)]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(JSON)(texts) == want
    started = time.perf_counter()
    assert tokens.counter(JSON)([letters("abcdefghijklmnopqrstuvwxyz", 1_000_000)])[0] > 300_000
    assert time.perf_counter() - started < 30


def test_pairs_kept_by_rank_equal_whole_rounds(monkeypatch):
    rng = random.Random(3)
    table = tokens.merges(JSON)
    words = ["".join(rng.choice("aabcdeé ") for _ in range(rng.randrange(1, 300))).encode() for _ in range(400)]
    want = tokens.count_symbols(words, table).tolist()
    monkeypatch.setattr(tokens, "LONG", 0)
    assert tokens.count_symbols(words, table).tolist() == want


def test_remembered_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    library = Tokenizer.from_file(JSON)
    count = tokens.counter(JSON)
    for text in ("one two three four", "five six seven eight nine ten", "one two"):
        assert count([text]) == [len(library.encode(text).ids)]


def _best_by_table(model, text):
    """Score of the best segmentation, trying every piece at every place."""
    scores = {p: s for p, s, t in model.entries if t in (pieces.NORMAL, pieces.USER)}
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + model.unknown_score)
    return best[-1]


def test_segmentation_is_the_best_and_decodes():
    model, rng = pieces.pieces(pieces.vocabulary()), random.Random(4)
    encode = pieces.encoder(pieces.vocabulary())
    score = {i: s for i, (_, s, _) in enumerate(model.entries)}
    for _ in range(400):
        text = "".join(rng.choice(["the", "ing", "re", "q", " ", "  ", "ñ", "日", "\n", "\t", "€", "😀", "x", ".", "and"]) for _ in range(rng.randrange(1, 14)))
        ids = encode(text).tolist()
        assert model.decode(ids) == text
        piece_bytes = sum(model.entries[i][2] == pieces.BYTE for i in ids)
        unknown = sum(c not in {p for p, _, t in model.entries if t == pieces.NORMAL} for c in text.replace(" ", pieces.SPACE)) if piece_bytes else 0
        total = sum(score[i] for i in ids if model.entries[i][2] != pieces.BYTE) + unknown * model.unknown_score
        assert total == pytest.approx(_best_by_table(model, pieces.SPACE + text.replace(" ", pieces.SPACE)), rel=1e-12)


def test_words_equal_the_unigram_library():
    """The best of the library's lattice over the same pieces; single words, as it sums in 32 bits."""
    spec = sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary(), "rb") as file:
        spec.ParseFromString(file.read())
    spec.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    encode = pieces.encoder(pieces.vocabulary())
    words = [p[0].strip(pieces.SPACE) + q[0].strip(pieces.SPACE) for p, q in zip(pieces.pieces(pieces.vocabulary()).entries[300:4000], pieces.pieces(pieces.vocabulary()).entries[900:4600])]
    assert [encode(w).tolist() for w in words] == [library.nbest_encode_as_ids(w, 2)[0] for w in words]


def test_round_trip_over_a_table(spark):
    rows = registry.QUERIES["op3_sentencepiece"](spark, SF).collect()
    assert len(rows) == 200 and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)


def test_awkward_rows_of_the_tokenizers(spark):
    store.ship(spark)
    counted = tokens.token_counts(edge(spark), JSON).collect()
    assert len(counted) == len(EDGE) and counted[0]["n_tokens"] == 0 and "odd.name" in counted[0].asDict()
    coded = pieces.encode(edge(spark), pieces.vocabulary(), check=True)
    texts = [r["text"] for r in pieces.decode(coded, pieces.vocabulary()).collect()]
    assert sorted(map(str, texts)) == sorted(str(t) for _, t in EDGE)
    assert tokens.token_counts(edge(spark).limit(0), JSON).count() == 0 and pieces.encode(edge(spark).limit(0), pieces.vocabulary()).count() == 0


class Article(HTMLParser):
    """Blocks of article, by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in pages.INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in pages.INLINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def _article(html):
    parser = Article()
    parser.feed(html)
    parser.close()
    return " ".join("".join(parser.parts).split())


def test_main_text_of_a_table(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/../sf0.01/pages.parquet").collect()}
    rows = registry.QUERIES["op6_main_text"](spark, f"{SF}/../sf0.01").collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r["text"] == _article(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><script>var x = "</p><article>";</script></head><body class="page-1"><header><h1>Site</h1></header>
<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class="cookie notice">We use cookies</div>{open}<h1>H &amp; {n}</h1>
<p>One  <b>b</b>old&nbsp;x {n}<br>line</p><ul><li>a {n}</li><li>b</li></ul><form>Sub<input></form><!-- <p>no</p> --><p>&lt;two&gt; {n}{close}
<aside>Related</aside><div id="comments"><p>first!</p><p>second {n}</p></div><footer>&copy; Site"""


def test_wrapper_separates_template_from_article(spark):
    store.ship(spark)
    rows = [(n, "http://h.com/1", PAGE.format(n=n, open="<article>", close="</article>")) for n in range(4)]
    rows += [(n, "http://plain.com/", PAGE.format(n=n, open="<div>", close="</div><div>All rights reserved</div><p><a href=x>one</a> <a href=y>two {n}</a></p>")) for n in range(10, 16)]
    rows += [(20, "http://h.com/2", None), (21, None, ""), (22, "x", "just text"), (23, "http://h.com/1", rows[0][2])]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id int, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    for n in (0, 1, 2, 3, 10, 15):
        assert got[n] == f"H & {n} One bold x {n} line a {n} b <two> {n}"
    assert got[20] == "" and got[21] == "" and got[22] == "just text" and got[23] == got[0]
    assert pages.extract(df.limit(0)).count() == 0


def test_names_of_page_and_article_are_no_boilerplate():
    import json

    html = '<html class="no-nav"><body class="has-sidebar header-fixed"><article class="post related"><p>text</p><article class="comment"><p>reply</p></article></article><div class="share">x</div></body></html>'
    tokens_, texts = pages.stream(html)
    assert pages.Extractor()(html, json.dumps(pages.page_wrapper(tokens_, texts))) == "text"


def test_elements_without_text_take_none_of_the_article():
    def text_of(html):
        return " ".join(text for _, text, _ in pages.stream(html)[1])

    assert text_of('<p>one <svg class="icon"/>two <math/>three</p><p>four <svg><path/><title/>no</svg>five</p>') == "one two three four five"
    for tag in pages.SKIPPED:
        assert text_of(f"<p>one</p><{tag} id=x><p>two</p><p>three</p>") == "one two three"
        assert text_of(f"<p>one</p><{tag}>no<{tag}>no</{tag}>no</{tag}><p>two</p>") == "one two"
        assert text_of(f"<p>one</p><{tag}><p>two</p><{tag}>no</{tag}><p>three</p>") == "one two three"
    assert text_of("<p>one</p><object><!-- </object> --><script>'</object>'</script>no</object><p>two</p><style>no") == "one two"
    assert text_of("<object>" * 50_000 + "one" + "</object>" * 20_000 + "two") == "two"


def test_slots_of_copies_are_no_template(spark):
    store.ship(spark)
    page = "<html><body><div class=page><h2>Great Site</h2><p>Text {n} of {n}</p>{more}<div>All rights reserved</div></div></body></html>"
    quote = "<blockquote>As they say</blockquote><table><tr><td>A cell</table>"
    rows = [(n, "http://a.com/x", page.format(n=n, more="")) for n in range(40)]
    rows += [(n, "http://a.com/y", page.format(n="y", more=quote).replace("<body>", f"<body><!-- {n} -->")) for n in range(100, 160)]  # captures
    rows += [(n, "http://a.com/z", page.format(n=n, more="<pre>Near copies</pre>")) for n in range(200, 206)]
    rows += [(n, "http://b.com/y", page.format(n="y", more=quote)) for n in range(300, 303)] + [(n, "http://b.com/x", page.format(n=n, more="")) for n in range(303, 306)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(8)
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got[0] == "Text 0 of 0" and got[303] == "Text 303 of 303"
    assert {got[n] for n in (*range(100, 160), *range(300, 303))} == {"Text y of y As they say A cell"}
    assert all(got[n] == f"Text {n} of {n} Near copies" for n in range(200, 206))


def test_wrappers_merge_in_any_grouping(spark, monkeypatch):
    monkeypatch.setattr(pages, "GROUP", 2)
    store.ship(spark)
    rows = [("h", PAGE.format(n=n, open="<article>", close="</article>") + "<p>x</p>" * (n % 3)) for n in range(12)]
    found = pages.infer_wrappers(spark.createDataFrame(rows, "host string, html string").repartition(8)).collect()
    assert len(found) == 1
    import json

    text = pages.expression(json.loads(found[0]["wrapper"]))
    assert "<li+ #+ </li+" in text and "<p+?" in text or "<p?" in text


def _renamed(html, rng, names):
    """The page with its containers and all class, id and role names replaced, the same way all over the host."""
    name = lambda word: names.setdefault(word, "x" + "".join(rng.choice("abcdefghij") for _ in range(7)))
    html = re.sub(r"(</?)(nav|article|div|header|footer|aside|form|section|main)\b", lambda m: m[1] + name(m[2]), html)
    return re.sub(r'\b(class|id|role)="([^"]*)"', lambda m: f'{m[1]}="{" ".join(name(w) for w in m[2].split())}"', html)


def test_renamed_pages_give_the_same_texts(spark):
    """Without any telling name the wrapper of a host of three pages or more still finds every article."""
    store.ship(spark)
    rng, hosts = random.Random(8), {}
    for r in spark.read.parquet(f"{SF}/../sf0.01/pages.parquet").collect():
        hosts.setdefault(r["url"].split("/")[2], []).append(r)
    rows, want = [], {}
    for own in hosts.values():
        names: dict = {}
        for r in own if len(own) >= 3 else []:
            rows.append((r["page_id"], r["url"], _renamed(r["html"], rng, names)))
            want[r["page_id"]] = _article(r["html"])
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(want) > 200 and got == want


def test_doubtful_names_and_template_inside_articles(spark):
    store.ship(spark)
    prose = lambda n: " ".join(f"word{(n * 31 + k * k) % 997}" for k in range(40))
    page = "<article><h1>About {n}</h1><p>{a}</p><div class='social-history'><p>{b}</p></div><div class='alert'>Sign up today</div><p>Read our other articles</p><div class='share'>{n} shares</div><div class='comment'><p>{b}</p></div></article>"
    rows = [(n, "http://h.com/", page.format(n=n, a=prose(n), b=prose(n + 100))) for n in range(8)]
    rows += [(20, "http://one.com/", page.format(n=1, a="A", b="B")), (21, "http://two.com/", "<article><div class='social-history'><p>All there is</p></div></article>")]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for n in range(8):
        assert got[n] == f"About {n} {prose(n)} {prose(n + 100)}"
    # a single page shows no wrapper: names decide, but they leave no article empty
    assert got[20] == "About 1 A Read our other articles" and got[21] == "All there is"


def test_siblings_repeat_as_groups():
    tokens_, texts = pages.stream("<div>" + "".join(f"<h2>h{k}</h2><p>a{k}</p><p>b{k}</p>" for k in range(5)) + "<ul><li>x</li></ul></div>")
    assert " ".join(f"{s}{'+' * r}" for s, r in tokens_ if s[0] == "<") == "<div <h2+ </h2+ <p+ </p+ <ul <li </li </ul </div"
    assert [t for _, t, _ in texts] == [x for k in range(5) for x in (f"h{k}", f"a{k}", f"b{k}")] + ["x"]
    assert all(tokens_[at][0][0] == "#" for at, _, _ in texts)
    tokens_, _ = pages.stream("<div>" + "<section><h3>a</h3><p>b</p></section>" * 7 + "<p>c</p>" * 2 + "</div>")
    assert sum(s == "<section" for s, _ in tokens_) == 1 and sum(s == "<p" for s, _ in tokens_) == 2


def test_mismatches_become_repeated_groups():
    own = lambda html: pages.page_wrapper(*pages.stream(html))
    one, two = own("<div><h2>a</h2><p>b</p></div>"), own("<div><h2>a</h2><p>b</p><table>c</table><h2>d</h2><p>e</p></div>")
    merged = pages.merge(one, two)
    assert len(merged) == len(pages.merge(two, one)) == len(two)
    # pages of many lengths make no longer wrapper than the longest
    many = None
    for k in range(1, 40):
        page = own("<div>" + "<h2>a</h2><p>b</p><blockquote>c</blockquote><p>d</p>" * k + "</div>")
        many = pages.merge(many, page) if many else page
    assert len(many) <= 16


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(3, hidden=4)
    for part in net.parts:
        for key in part:
            part[key] = rng.normal(0, 0.4, part[key].shape)
    codes, mask = langid.padded([b"abcde", b"xy", b"q"])
    labels, weights = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    _, grads = net.gradients(codes, mask, labels, weights)
    for part, grad in zip(net.parts, grads):
        for key in part:
            flat = part[key].reshape(-1)
            for at in rng.choice(np.flatnonzero(np.abs(grad[key].reshape(-1)) > 1e-6), 6):
                was = flat[at]
                flat[at] = was + 1e-5
                up = net.gradients(codes, mask, labels, weights)[0]
                flat[at] = was - 1e-5
                down = net.gradients(codes, mask, labels, weights)[0]
                flat[at] = was
                assert (up - down) / 2e-5 == pytest.approx(grad[key].reshape(-1)[at], rel=1e-3, abs=1e-7)


def _plain_probabilities(net, word):
    """The network unit by unit and byte by byte, in Python numbers."""

    def states(direction, codes):
        x, u, b = (direction.w[k].astype(float).tolist() for k in ("x", "u", "b"))
        size = len(u)
        h, out = [0.0] * size, []
        for code in codes:
            a = [x[code][j] + b[j] for j in range(3 * size)]
            g = [sum(h[i] * u[i][j] for i in range(size)) for j in range(3 * size)]
            z = [1 / (1 + math.exp(-(a[j] + g[j]))) for j in range(size)]
            r = [1 / (1 + math.exp(-(a[size + j] + g[size + j]))) for j in range(size)]
            n = [math.tanh(a[2 * size + j] + r[j] * g[2 * size + j]) for j in range(size)]
            h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(size)]
            out.append(h)
        return out

    ahead, back = states(net.ahead, word), states(net.back, word[::-1])[::-1]
    rows = []
    for one, two in zip(ahead, back):
        logits = [sum(v * net.top["o"][i][k] for i, v in enumerate([*one, *two])) + net.top["c"][k] for k in range(len(net.top["c"]))]
        whole = sum(math.exp(v) for v in logits)
        rows.append([math.exp(v) / whole for v in logits])
    return rows


def test_network_equals_plain_loops():
    rng = np.random.default_rng(3)
    net = langid.Network(3, hidden=5)
    for part in net.parts:
        for key in part:
            part[key] = rng.normal(0, 0.6, part[key].shape)
    words = [b"abcdefg", "größe".encode(), b"x", b"zz"]
    codes, mask = langid.padded(words)
    got, _ = net.probabilities(codes, mask)
    want = [_plain_probabilities(net, word) for word in words]
    for k, word in enumerate(words):
        assert got[k, : len(word)] == pytest.approx(np.array(want[k]), abs=1e-9)
    # a text is the mean over the positions of its words, lower-cased and without their edges
    pooled = langid.Labeller(langid.Model(["a", "b", "c"], net)).pooled(pa.array(["ABCDEFG, (x) zz!", "12 -- ...", None, "Größe größe"]))
    positions = [*want[0], *want[2], *want[3]]
    assert pooled[0] == pytest.approx(np.mean(positions, axis=0), abs=1e-6) and not pooled[1].any() and not pooled[2].any()
    assert pooled[3] == pytest.approx(np.mean(want[1], axis=0), abs=1e-6)


def test_language_of_held_out_documents(spark):
    sf = f"{SF}/../sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.QUERIES["op7_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    asked = [r for r in rows if r["held_out"] and len(truth[r["doc_id"]]["text"]) > 100]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in asked]) > 0.97


def test_labels_don_t_depend_on_slices_and_unknowns(spark):
    store.ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, sample_docs=40, sample_words=1500)
    found = {r["doc_id"]: r for r in langid.identify(edge(spark), model).where("doc_id is not null").collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 15)] == ["und"] * 4 and found[1]["score"] == 0
    assert found[13]["lang_pred"] != "und" and found[10]["lang_pred"] == "en"
    assert langid.fit(docs.withColumn("lang", docs["lang"].substr(1, 0)).where("false")).network is None
    none = langid.identify(docs.select("doc_id", "text"), langid.Model([], None)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    labeller, texts = langid.Labeller(model), [r["text"] for r in docs.limit(20).collect()]
    together = labeller.pooled(pa.array(texts))
    apart = np.concatenate([langid.Labeller(model).pooled(pa.array([t])) for t in texts])
    assert np.allclose(together, apart, atol=1e-4)
