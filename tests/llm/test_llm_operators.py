"""The training-data operators against brute force, on small fixtures with every awkward row."""

import hashlib
import html
import re
import time
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from stratastats.llm import (
    balltree, curriculum, html_text, imatch, language, lines, neardup, pieces, quality, token_store,
)
from stratastats.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES

PIECE, BYTE = public_tokenizers.path(PIECE_MODEL), public_tokenizers.path(BYTE_MODEL)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 4000
LINE = "this line stands in more than five of the documents here"


def awkward(spark, extra=()):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, "en", "a", len(LONG)),
        (4, "un deux trois", "fr", "b", 13), (4, "un deux trois", "fr", "b", 13),
        (None, "sans nom", None, None, None), (None, None, None, None, None),
        (5, " \n\t ", None, "c", 4), (6, "123 456", "en", "a", 7), (7, "😀 ▁ \x00 é", None, "", 8),
        *((10 + i, f"{LINE}\nown line of document number {i} and some more words\n {LINE.upper()} ", "en", "a", 1) for i in range(6)),
        *extra,
    ]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({"score": frame.doc_id, "component_id": frame.text, "key": frame.source, "_row": frame.lang})


def empty(spark):
    return awkward(spark).limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_quality(spark):
    good = [(i, f"a calm sentence about river number {i}", "en", "a", 1) for i in range(100, 160)]
    bad = [(i, f"buy*** now*** {i}*** win*** win***", "en", "a", 1) for i in range(200, 260)]
    docs = awkward(spark, good + bad)
    labels = spark.createDataFrame(
        [(i, 1) for i in range(100, 150)] + [(i, 0) for i in range(200, 250)] + [(None, 1), (3, None), (100, 1)],
        "doc_id bigint, quality int",
    )
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in rows(quality.score(docs, model))}
    assert all(got[i] > 0.5 for i in range(150, 160)) and all(got[i] < 0.5 for i in range(250, 260))
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    assert quality.score(docs, model).count() == docs.count()
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in rows(quality.score(docs, none))} == {0.5}
    assert not rows(quality.score(empty(spark), model))


def test_quality_held_out(spark, folder):
    """Held-out accuracy on the given tables."""
    got = QUERIES["op1_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.8


def test_language(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op2_language"](spark, folder).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    model = language.train(docs)
    texts = {x: next(r["text"] for r in docs.filter(f"lang = '{x}' and n_chars > 1000").collect()) for x in ("de", "fr")}
    both = model.mixture(texts["de"][:1000] + texts["fr"][:1000])
    assert {x[0] for x in both} == {"de", "fr"} and abs(sum(x[1] for x in both) - 1) < 1e-6
    found = rows(language.identify(awkward(spark), model))
    assert len(found) == awkward(spark).count()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 5, 6)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    untrained = language.train(empty(spark))
    assert {r["lang_pred"] for r in rows(language.identify(awkward(spark), untrained))} == {"und"}


def test_html_text(spark, folder):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>x='</p>'</script></head><body>"
        "<div class='cookie-notice'>We use cookies</div><nav><a href=x>Home</a></nav>"
        "<article><h1>Ti&amp;tle</h1><p>One <b>bo</b>ld\n  word.</p><div class=ad>Buy</div>"
        "<p>Tw&ouml;<br>x</p></article><section id='comments'><p>A reader says much about it all</p>"
        "</section><aside>Side</aside><form><label>Name</label></form><footer>&copy; f</footer></body></html>"
    )
    assert html_text.main_text(page) == "Ti&tle One bold word. Twö x"
    plain = "<body><ul class=menu><li><a>a</a></ul><div>" + "<p>" + "A long sentence of the story. " * 9 + "<p>The end.</div><div class=footer>f</div>"
    assert html_text.main_text(plain) == ("A long sentence of the story. " * 9 + "The end.").strip()
    odd = spark.createDataFrame(
        [(1, "u", None), (None, None, ""), (2, "u", "<p"), (3, "u", "no markup"), (3, "u", "no markup"), (4, "u", "<div><p>" * 20000)],
        "page_id bigint, url string, html string",
    )
    got = rows(html_text.extract(odd.selectExpr("*", "url as text")))
    assert [r["text"] for r in got] == ["", "", "<p", "no markup", "no markup", ""]
    assert not rows(html_text.extract(odd.limit(0)))
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        blocks = re.split(r"</?(?:p|h1|br|li|ul|div)[^>]*>", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        assert html_text.main_text(r["html"]) == " ".join(t for t in texts if t)


def test_html_text_by_line_blocks():
    """What is kept does not hang on an article tag or on the longest paragraph."""
    huge, advert = "A very long story goes on. " * 2000, "<div class=ad>Buy</div>"
    story = f"<p>{huge}</p>{advert}<p>A short paragraph.</p>{advert}<p>The end.</p>"
    for tag in ("div", "article", "main"):
        want = huge + "A short paragraph. The end."
        assert html_text.main_text(f"<body><{tag}>{story}</{tag}></body>") == want
    teasers = "".join(f"<article class=card><p>Teaser {i}</p></article>" for i in range(3))
    found = html_text.main_text(f"<body><div><p>{'The body of the page. ' * 30}</p></div>{teasers}</body>")
    assert found.count("The body of the page.") == 30 and "Teaser 2" in found
    links = "<p><a href=x>Some other page</a></p>" * 20
    assert html_text.main_text(f"<main>{links}</main>") == ""
    assert html_text.main_text(f"<main><p>{'Text with references. ' * 40}</p>{advert}{links}</main>").count("other page") == 20


@pytest.mark.parametrize(
    "page",
    [
        "<div " * 100_000, "<a href='x" * 60_000, "<a b=\"'c" * 60_000, "<!" * 200_000, "<!--" * 100_000,
        "</script " * 50_000, "<article>" * 50_000 + "x" + "</article>" * 50_000,
        "<article>x<div class=ad>y</div></article>" * 10_000, "<div " + "a" * 500_000 + ">x",
        "<p a" + " " * 500_000 + ">x</p>", "a &#" + "1" * 6000 + "; b",
    ],
)
def test_html_text_of_broken_pages_takes_linear_time(page):
    begin = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begin < 2


def test_html_text_falls_to_empty_by_no_doubtful_name():
    body = "<div class='{}'><p>A whole text stands here.</p></div>"
    assert html_text.main_text(body.format("widget-text")) == "A whole text stands here."
    assert html_text.main_text(body.format("search-results")) == "A whole text stands here."
    assert html_text.main_text(body.format("comments")) == ""
    assert html_text.main_text("<article><p>Story.</p></article>" + body.format("widget")) == "Story."
    assert html_text.main_text("a &#" + "0" * 30 + "65; b &#" + "9" * 5000 + ";") == "a A b \ufffd"


def test_top_k(spark):
    rng = np.random.default_rng(5)
    made = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(700)]
    same = [(i, [0.5] * 6) for i in range(700, 1400)]
    odd = [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (None, [1.0] * 6), (2150, []), (2200, [1.0, 2.0]), (2250, [2.0, 1.0])]
    raw = spark.createDataFrame(made + same + odd, "vec_id bigint, embedding array<double>")
    vectors = balltree.quantised(raw.withColumn("rank", raw.vec_id), 256)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(balltree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5))}
    usable = {i: np.floor(np.array(v) * 256).astype(np.int64) for i, v in made + same + odd[5:]}
    want = {}
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-int(v @ usable[q]), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best[:5], 1)}
    assert got == want
    none = balltree.quantised(raw.limit(0), 256)
    assert not rows(balltree.top_k(none, none, 5))


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    p = pieces.Pieces(PIECE)
    rng = np.random.default_rng(3)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", " the", "ing", "①", "梦", "😀", "***", "<s>", "<0x41>", "th", "he", "\x00", "x" * 30, " " * 20]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        ids = array("I", p.encode(text))
        assert ids.tolist() == sp.encode(text)
        assert p.decode(ids) == sp.decode(ids.tolist())
    for _ in range(800):
        ids = rng.choice([0, 1, 2, 5, 200, 214, 240, 259, 300, 29871], rng.integers(0, 7)).tolist()
        assert p.decode(array("I", ids)) == sp.decode(ids)
    docs = awkward(spark)
    got = rows(pieces.encode(docs, PIECE))
    assert [r["ids"] for r in got] == [sp.encode(r["text"] or "", add_bos=True, add_eos=True) for r in docs.collect()]
    back = rows(pieces.decode(pieces.encode(docs, PIECE), PIECE))
    assert [r["text"] for r in back] == [sp.decode(r["ids"]) for r in got]
    told = rows(pieces.digests(docs, PIECE))
    assert [r["ids_sha256"] for r in told] == [hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() for r in got]
    assert not rows(pieces.digests(empty(spark), PIECE))


@pytest.mark.parametrize("parts", [1, 40])
def test_lines(spark, parts):
    docs = awkward(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # runs of a key cross partitions
    try:
        maps = lines.keep_bitmaps(docs)
        got = {(r["doc_id"], r["n_lines"]): r for r in rows(lines.digests(docs, maps))}
        text = {r["doc_id"]: r["text"] for r in lines.cleaned(docs, maps).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for i in range(5):
        assert text[10 + i] == f"own line of document number {i} and some more words"
        assert got[10 + i, 3]["n_dropped"] == 2
        assert got[10 + i, 3]["kept_sha256"] == hashlib.sha256(text[10 + i].encode()).hexdigest()
    assert got[15, 3]["n_dropped"] == 0 and text[1] is None and got[1, 1]["n_dropped"] == 0
    assert lines.cleaned(docs, maps).columns == docs.columns
    assert not rows(lines.digests(empty(spark), lines.keep_bitmaps(empty(spark))))


def test_near_duplicates(spark):
    rng = np.random.default_rng(11)
    word = [f"w{i}" for i in range(4000)]
    base = [list(rng.choice(word, 120)) for _ in range(30)]
    texts = {i: " ".join(b) for i, b in enumerate(base, 100)}
    for i in range(400):  # copies of a few with one to three edits, so that links chain
        copy = list(base[i % 4])
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            copy[at] = str(rng.choice(word))
        texts[1000 + i] = " ".join(copy)
    for i in range(60):  # a passage in common, far from the threshold
        texts[3000 + i] = " ".join(base[9][:60]) + " " + " ".join(rng.choice(word, 50))
    for i in range(240):  # many copies too far from most others, some with close copies or cuts of their own
        copy = list(base[5])
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            copy[at] = str(rng.choice(word))
        texts[5000 + 3 * i] = " ".join(copy)
        copy[int(rng.integers(0, 120))] = str(rng.choice(word))
        if i % 3 == 0:
            texts[5001 + 3 * i] = " ".join(copy)
        if i % 4 == 0:
            texts[5002 + 3 * i] = " ".join(copy[: 120 - int(rng.integers(0, 16))])
    docs = awkward(spark, [(i, t, "en", "a", len(t)) for i, t in texts.items()])
    got = rows(neardup.components(docs, percent=85))
    assert len(got) == docs.count()
    sets = {r["doc_id"]: set(neardup.shingles(r["text"]).tolist()) for r in docs.collect() if r["doc_id"] is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (find(r["doc_id"]), len(sets[r["doc_id"]]))
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert not rows(neardup.components(empty(spark)))


def test_near_duplicates_linked_with_one_of_many(spark):
    """A cut of a text is near that text only, not its many edited copies, and shares no shingle
    with it that most of them do not have."""
    rng = np.random.default_rng(12)
    texts, cuts = {}, {}
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(204)]
        for i in range(1, 512):
            copy = list(base)
            if i != 80:
                copy[int(rng.integers(5, 160))] = f"g{g}e{i}"
            texts[1000 * g + i] = " ".join(copy)
        del texts[1000 * g + 300]
        cuts[1000 * g + 300] = " ".join(base[:175])
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in (texts | cuts).items()}
    for i in cuts:
        near = [j for j in texts if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
        assert near == [i - 220]
    docs = spark.createDataFrame(list((texts | cuts).items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(neardup.components(docs, percent=85))}
    assert got == {i: i // 1000 * 1000 + 1 for i in got}


def test_labels_follow_all_links(spark):
    """Components of random graphs and of a chain, labelled at once and after further links."""
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [tuple(map(int, e)) for e in rng.integers(100, 400, (220, 2))] + [(7, 7)]
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(least[u], least[v])
            changed |= least[u] != low or least[v] != low
            least[u] = least[v] = low
    want = {(x, low) for x, low in least.items() if x != low}
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {tuple(r) for r in neardup._stars(frame).collect()} == want
    rng.shuffle(order := list(range(len(edges))))
    parts = [spark.createDataFrame([edges[i] for i in order[k::3]], "u bigint, v bigint") for k in range(3)]
    labels = neardup._stars(parts[0])
    for part in parts[1:]:
        labels = neardup._joined(labels, part)
    got = labels.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    none = frame.limit(0)
    assert not neardup._joined(neardup._stars(none), none).collect()


def test_curriculum(spark):
    docs = awkward(spark, [(i, "w " * (i % 9), "en", f"s{i % 3}", 1) for i in range(500, 2000)])
    weight = lambda i, s: [(0.0, 1.0 + i), (0.5, 0.5), (1.0, 2.0)]
    got = rows(curriculum.plan(docs, weight))
    assert len(got) == docs.count()
    assert sorted(map(str, got)) == sorted(map(str, rows(curriculum.plan(docs, weight))))
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"] and r["positions"] == sorted(r["positions"])
        assert all(0 <= p <= 1 for p in r["positions"])
    total = sum(r["size"] for r in got)
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6
    for g in by.values():
        assert g[0]["target"] <= 2 * g[0]["source_size"]
        assert abs(sum(r["taken"] for r in g) - g[0]["target"]) <= max(r["size"] for r in g)
    # the words used by half time follow the integral of the schedule
    half = sum(r["size"] * sum(p <= 0.5 for p in r["positions"]) for r in by["s1"])
    own = weight(sorted(s for s in by if s is not None).index("s1"), "s1")
    assert abs(half / by["s1"][0]["target"] - curriculum.integral(own[:2]) / curriculum.integral(own)) < 0.02
    mix = curriculum.mixed(docs, curriculum.plan(docs, weight))
    assert mix.columns == docs.columns and mix.count() == sum(len(r["positions"]) for r in got)
    assert not rows(curriculum.plan(empty(spark), weight))


def test_curriculum_in_order(spark):
    docs = awkward(spark, [(None, f"null id {i}", "en", "a", 1) for i in range(3000)])
    planned = curriculum.plan(docs, lambda i, s: [(0.0, 1.0), (1.0, 2.0)])
    got = rows(curriculum.in_order(planned))
    used = [r["position"] for r in got if r["positions"]]
    assert used == sorted(used) and [r["position"] for r in got[: len(used)]] == used
    for r in got:
        ends = (r["positions"][0], r["positions"][-1]) if r["positions"] else (None, None)
        assert (r["position"], r["last_position"]) == ends
    assert not rows(curriculum.in_order(curriculum.plan(empty(spark), lambda i, s: [(0.0, 1.0), (1.0, 1.0)])))


def test_mix_of_many_equal_rows(spark):
    """Equal rows meet their plans one to one."""
    docs = spark.createDataFrame([(1, "five words stand right here", "en", "a", 1)] * 3000 + [(2, "x", "en", None, 1)], DOCS)
    planned = curriculum.plan(docs, lambda i, s: [(0.0, 1.0), (1.0, 1.0)])
    mix = curriculum.mixed(docs, planned)
    assert mix.count() == sum(len(r["positions"]) for r in rows(planned))
    assert "Join" not in mix._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]


def test_encoder_knows_words_by_themselves():
    """A word comes to the tokenizer once, whatever marks and line ends stand around it."""
    model, sent = token_store.Encoder(BYTE), []
    whole = model._whole
    model._whole = lambda texts, *a: sent.extend(texts) or whole(texts, *a)
    words = ["thonre", "anblewh", "éêlle", "Zukeit", "ofou"]
    marks = ["", ",", ".", "!!", ";", ":", ")", "?", "...", "-", "###", "|"]
    texts = [f"{b}{w}{m}" for w in words for m in marks for b in ("x ", "x\n", "x\n\n")]
    want = [array("H", e.ids).tobytes() for e in model.model.encode_batch(texts, add_special_tokens=False)]
    assert model.encode_all(texts) == want
    assert len(sent) <= 2 * len(words) + len(marks) + 5


def test_encoder_cuts_at_any_white_space():
    parts = ["ab", "Cd", "é", "9", "'s", "don't", ".", ",,", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\x85", "\u3000", "\x1c", "日", "<|endoftext|>"]
    picks = np.random.default_rng(3).integers(0, len(parts), (3000, 7))
    texts = ["".join(parts[i] for i in row) for row in picks]
    model = token_store.Encoder(BYTE)
    want = [array("H", e.ids).tobytes() for e in model.model.encode_batch(texts, add_special_tokens=False)]
    assert model.encode_all(texts) == want
    assert model.encode_all(texts) == want  # from memory


def test_fingerprint_words_outlast_a_full_memory(monkeypatch):
    """Words met last are not hashed again when a worker's memory of words is full."""
    hashed, digest = [], imatch.xxhash.xxh32_intdigest
    monkeypatch.setattr(imatch.xxhash, "xxh32_intdigest", lambda x: hashed.append(x) or digest(x))
    texts = [" ".join(f"w{i}q" for i in range(j, j + 50_001)) for j in range(0, 550_000, 50_001)]
    first = [imatch.terms(t) for t in texts]
    imatch.terms("one more")
    hashed.clear()
    assert imatch.terms(texts[-1]) == first[-1]
    assert imatch.terms(texts[0]) == first[0]
    assert not hashed


def test_subset_hashes_match_a_plain_loop():
    def plain(own, level):
        out = []
        for deep in range(level, level + imatch.USED):
            shorts = []
            for salt in imatch._SALTS.tolist():
                upto = total = any_ = 0
                for t in own.tolist():
                    x = t * salt % 2**32
                    x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
                    x ^= x >> 13
                    v = t * 0x9E3779B1 % 2**32
                    v = (v ^ v >> 16) * 0x85EBCA77 % 2**32
                    if x < min(2**32 - 1, 2 ** (32 - deep)):
                        any_, upto = 1, (upto + v) % 2**32
                        total = (total + upto * 0x27D4EB2F) % 2**32
                shorts.append(f"{max(total >> 16, 1) if any_ else 0:04x}")
            out.append("".join(shorts))
        return out

    random = np.random.default_rng(5)
    for n, level in ((1, 0), (1, 9), (2, 0), (7, 2), (60, 5), (300, 8), (40, 0)):
        own = np.unique(random.integers(0, 2**32, n, dtype=np.uint32))
        assert imatch._subset_hashes(own, level) == plain(own, level)


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = awkward(spark, [(50 + i, "word <|endoftext|>  \n x" * i, "en", "a", 1) for i in range(30)])
    tk = Tokenizer.from_file(BYTE)
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    path = token_store.write(docs, BYTE, 2, f"{tmp_path}/tokens")
    got = sorted(rows(token_store.entries(spark, path)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in order]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted(zlib.crc32(np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in order)
    assert sorted(r["ids_crc32"] for r in got) == want
    some = token_store.get(spark, path, [3, 4, 79, 99999])
    assert set(some) == {3, 4, 79} and some[3] == [*tk.encode(LONG).ids, 2]
    texts = [r["text"] or "" for r in order]
    assert token_store.Encoder(BYTE).encode_all(texts) == [token_store.Encoder(BYTE).encode(t) for t in texts]
    many = spark.range(40_000).selectExpr("id as doc_id", "concat('t ', id) as text")
    wide = token_store.write(many, BYTE, 2, f"{tmp_path}/wide")
    assert token_store.read(spark, wide).count() > 4
    assert token_store.shards_of(spark, wide, [77, 30_000]).count() == 2
    assert token_store.shards_of(spark, wide, []).count() == 0
    assert "PushedFilters: [Or" in token_store.shards_of(spark, wide, [77, 30_000])._jdf.queryExecution().toString()
    assert set(token_store.get(spark, wide, [77, 30_000, 50_000])) == {77, 30_000}
    none = token_store.write(empty(spark), BYTE, 2, f"{tmp_path}/none")
    assert not rows(token_store.entries(spark, none))


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_perfect_hash(n):
    h = token_store._hashes(np.arange(n), np.zeros(n, np.int64))
    displacements, slots = token_store.perfect_hash(h)
    assert sorted(slots.tolist()) == list(range(n)) and len(displacements) <= max(1, n // 3)


def test_fingerprints(spark):
    rng = np.random.default_rng(4)
    made = [(100 + i, " ".join(rng.choice([f"t{k}" for k in range(900)], 150)), "en", "a", 1) for i in range(40)]
    docs = awkward(spark, made)
    lex = imatch.lexicon(docs)
    got = rows(imatch.edited_digests(docs, lex))
    assert len(got) == docs.count()
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    by = {r["doc_id"]: r for r in got}
    for i, r in enumerate(order):
        if r["doc_id"] is not None and r["doc_id"] not in (4,):
            own, following = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
            part = len(own) // 4
            edited = own[: len(own) - part] + following[:part]
            assert by[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert by[r["doc_id"]]["n_chars"] == len(own)
    near = [(r["near_edited"], r["near_next"]) for r in got if (r["doc_id"] or 0) >= 100]
    assert np.mean([a > b for a, b in near]) > 0.9
    texts = {}
    for r in rows(imatch.fingerprints(docs.select("doc_id", "text"), lex)):
        texts.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert len(texts[4]) == 1
    assert imatch.likeness(None, "x") == 0.0 and imatch.likeness("a:0:::", "a:0:::") == 1.0
    assert not rows(imatch.edited_digests(empty(spark), imatch.lexicon(empty(spark))))


def test_pipeline(spark, folder):
    """Every stage keeps clean documents and its decisions take effect."""
    docs = awkward(spark, spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id > 50").collect())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.columns == columns, name
        if name == "language":
            assert docs.filter("doc_id in (1, 2, 5, 6)").count() == 0
            # only what has no letter goes
            letter = lambda t: any(c.isalpha() for c in t or "")
            assert docs.count() == sum(letter(r["text"]) for r in before.select("text").collect())
        if name == "near_duplicates":
            assert docs.filter("doc_id = 4").count() <= 1
    last = rows(corpus_pipeline.STAGES[-1][1](spark, docs, folder))
    assert len(last) == docs.count() > 0
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in last[:200]:
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(r["ids"]).encode()).hexdigest()
    assert isinstance(docs.schema["n_chars"].dataType, T.LongType)


def test_pipeline_of_nothing(spark, folder):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
