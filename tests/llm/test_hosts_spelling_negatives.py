"""Host rules, spelling variants and hard negatives against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratastats.llm import hosts, negatives, spelling
from stratastats.llm.queries import QUERIES
from test_llm_operators import awkward, empty, rows


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def test_host_measures(spark):
    texts = [
        "", None, " \n\t", "a b c d e f g h", "a " * 9, "a " * 16, "x y " * 40, "a b c d e f g h " * 3 + "i",
        "1 2 3 4 5 6 7 8 9 10 1 2 3 4 5 6 7 8 11 12 3 4 5 6 7 8 9 10", "l\nl \nl\n\n \nl", "😀 é <b>|x|</b> ##",
        "one two " + "w1 w2 w3 w4 w5 w6 w7 w8 w9 " + "mid " * 3 + "w2 w3 w4 w5 w6 w7 w8 w9 w10", "a\x0bb\x0cc\rd\x1fe\x85f g",
        "long " * 30000, " ".join(f"v{i % 5000}" for i in range(12000)),
    ]
    rng = np.random.default_rng(2)
    texts += [" ".join(rng.choice(list("abc"), rng.integers(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rows(hosts.measured(docs))}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_hosts_by_their_failures(spark):
    """A bad host goes, a strict one is held to the tight limits, two documents judge no host."""
    clean = lambda i, n=60: " ".join(f"word{i}n{j}" for j in range(n))
    light = lambda i: clean(i, 40) + " #" * 8  # noqa: E731  fails the tight limit only
    made = []
    for h in range(20):
        made += [(f"good{h}", clean(i)) for i in range(95)] + [(f"good{h}", light(i)) for i in range(5)]
    made += [("bad", "junk")] * 90 + [("bad", clean(i)) for i in range(10)]
    made += [("mixed", "short")] * 25 + [("mixed", light(i)) for i in range(25)] + [("mixed", clean(i)) for i in range(50)]
    made += [("tiny", "junk")] * 2 + [("tiny", clean(1))] + [(None, clean(i)) for i in range(9)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(made)], "doc_id long, text string, source string")
    found = rows(hosts.judged(docs.withColumn("host", docs.text).withColumn("rate", docs.text)))
    assert len(found) == len(made)
    verdict = {r["host"]: r["host_verdict"] for r in found}
    assert verdict["bad"] == "blocked" and verdict["mixed"] == "strict" and verdict["good3"] == "trusted"
    kept = Counter(r["host"] for r in found if r["kept"])
    assert kept["bad"] == 0 and kept["mixed"] == 50 and kept["good7"] == 100 and kept[None] == 9
    rate = {r["host"]: r["host_rate"] for r in found}
    assert rate["tiny"] < 0.66 and abs(rate["bad"] - 0.9) < 0.05
    assert rate[None] == pytest.approx(np.mean([r["base_failed"] or counted(made[r["doc_id"]][1])[2] > 0 for r in found]))
    for r in found:
        words, _, symbols, *_ = counted(made[r["doc_id"]][1])
        fails = words < 20 or {"blocked": True, "strict": 10 * symbols > words, "trusted": 2 * symbols > words}[r["host_verdict"]]
        assert r["kept"] == (not fails)


def test_hosts_awkward(spark):
    found = rows(hosts.judged(awkward(spark)))
    assert len(found) == awkward(spark).count()
    assert all(r["base_failed"] and not r["kept"] for r in found if r["doc_id"] in (1, 2, 5))
    assert not rows(hosts.judged(empty(spark)))
    same = spark.createDataFrame([(1, "junk", "a"), (2, "junk", "a")], "doc_id long, text string, source string")
    assert {r["host_rate"] for r in rows(hosts.judged(same))} == {1.0}
    plan = hosts.judged(awkward(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n, times=10):
    out = {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        form = others[0][1] if others and -others[0][0] >= times * n[w] else None
        out[w] = [form, None, n[w], len(others), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def test_spelling(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("aabcdé÷"), rng.integers(7, 12))) for _ in range(40)] + ["aaaaaaaa", "abababab"]
    n = {}
    for w in base:
        n[w] = int(rng.integers(2, 40000))
        for _ in range(12):  # one or two edits away, in chains
            at, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
            w = w[:at] + ("" if kind == 0 and len(w) > 1 else str(rng.choice(list("abcdz")))) + w[at + (kind != 1) :]
            n.setdefault(w, int(rng.integers(2, 300)))
    n |= {"aaaaaaab": 3000, "aaaaaabb": 200, "aaaaabbb": 20, "aaaabbbb": 2}  # a long way to its root
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(spelling.variants(words))}
    assert got == expected(n)
    assert not rows(spelling.variants(words.limit(0)))
    with pytest.raises(ValueError):
        spelling.variants(words, times=1)


def test_spelling_counts(spark):
    docs = awkward(spark, [(90, "Ünüsual ÀÉx×÷ÿab xX_Letters9abcdefgh ÀÉx×÷ÿABıabcdefgi abcdefgh", None, None, 0)] * 2 + [(91, "b" * 3_000_000 + " " + "b" * 3_000_000, "x", "x", 1)])
    for every in (None, 3, 31):
        want = Counter()
        for r in docs.collect():
            for run in re.findall(r"[A-Za-zÀ-ÿ]+", r["text"] or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                if every and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += 1
        want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
        assert {r["word"]: r["n"] for r in rows(spelling.counted_words(docs, misspell=every))} == want
    assert not rows(spelling.counted_words(empty(spark)))


def test_spelling_query(spark, folder):
    """The registered query on its whole table; neighbours by deleting each letter once."""
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for run, n in Counter(re.findall(r"[A-Za-zÀ-ÿ]+", r["text"] or "")).items():
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += n
    n = {w: c for w, c in want.items() if len(w) >= 7 and c >= 2}
    shared = {}
    for w in n:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shared.setdefault(x, []).append(w)
    out = {w: {v for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for v in shared[x] if near(w, v)} for w in n}
    form = {}
    for w, vs in out.items():
        first = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = first if first and n[first] >= 10 * n[w] else None
    def root(w):
        return root(form[w]) if form[w] else w
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(QUERIES["op12_spelling_variants"](spark, folder))}
    assert got == {w: (form[w], root(w), n[w], len(out[w]), n.get(form[w])) for w in n} and any(form.values())


@pytest.mark.parametrize("size", [1, 7, 150])
def test_residues(size):
    rng = np.random.default_rng(size)
    for large in (1, 300, 10**6, 2**28):
        a, b = (rng.integers(-large, large + 1, (40, size)) for _ in range(2))
        a[0], b[0] = large, -large
        bound = int(large * large * size)
        if bound >= 2**62:
            continue
        primes = negatives.moduli(bound)
        got = negatives.Residues(a, primes).scores(negatives.Residues(b, primes))
        assert (got == a @ b.T).all()


def test_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TILE_CELLS", 200)
    rng = np.random.default_rng(7)
    made = [(i, int(rng.integers(0, 3)), [float(x) for x in np.round(rng.normal(0.4, 0.3, 4), 1)]) for i in range(900)]
    made += [(i, 1, [0.5] * 4) for i in range(900, 1400)] + [(i, 5, [0.45] * 4) for i in range(1400, 1450)]
    made += [(3000, 1, [1e5, -1e5, 1e5]), (3001, 1, [1e5, 0.0, 1e5]), (3002, 2, [1e5, 1e4, 1e5]), (4000, 7, [0.5] * 4), (4000, 7, [0.5] * 4)]
    odd = [(5000, 1, None), (5100, 1, [1.0, None, 1.0, 1.0]), (5200, 1, [float("inf")] * 4), (None, 1, [1.0] * 4), (5300, None, [1.0] * 4), (5400, 1, [])]
    raw = spark.createDataFrame(made + odd, "vec_id long, label int, embedding array<double>")
    vectors = negatives.quantised(raw.withColumn("rank", raw.vec_id), 256)
    found = negatives.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"))
    got = sorted(tuple(r) for r in found.collect())
    x = [(i, c, np.floor(np.array(v) * 256).astype(np.int64)) for i, c, v in made]
    want = []
    for a in {i: (i, c, v) for i, c, v in x if i % 100 == 0}.values():
        scored = sorted((-int(v @ a[2]), i, c) for i, c, v in x if len(v) == len(a[2]))
        for s, p, _ in [t for t in scored if t[2] == a[1] and t[1] != a[0]][:5]:
            fit = [t for t in scored if t[2] != a[1] and 80 * -s <= 100 * -t[0] <= 100 * -s]
            want += [(a[0], p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit[:5], 1)]
    assert got == sorted(want) and len(want) > 100
    assert not rows(negatives.hard_negatives(vectors.limit(0), vectors.limit(0)))
    big = negatives.quantised(raw.withColumn("embedding", F.transform("embedding", lambda e: e * 1e15)), 256)
    with pytest.raises(ValueError):
        negatives.hard_negatives(big, big)
