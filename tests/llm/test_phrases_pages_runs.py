"""Phrases, main texts and periodic runs against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from probelens.llm import phrases, queries, tandem, templates

# ---- phrases


def brute_phrases(rows, longest, least, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                continue
            score, cut = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["of", "The", "the", "x\u00e9", "a", "b", "c", "New", "york", "\u00c9"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \x0b"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None]), text + " of the new york " * rng.randint(0, 3)))
    return [*rows, ("en", None), ("de", ""), (None, " ,. \n"), ("und", "of the the the"), ("en", "deep sea " * 3000)] + rows[:20]


@pytest.mark.parametrize("longest,least,most,share", [(3, 10, 2000, None), (2, 3, 5, None), (4, 6, 50, 20), (3, 10, 2000, 6)])
def test_phrases(spark, monkeypatch, longest, least, most, share):
    rows = phrase_rows()
    if share:  # some words and pairs are hot
        monkeypatch.setattr(phrases, "SHARE", share)
        monkeypatch.setattr(phrases, "BUCKET", 300)
        monkeypatch.setattr(phrases, "HELD", 500)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in phrases.collocations(docs, longest=longest, least=least, most=most).collect())
    assert got == brute_phrases(rows, longest, least, most)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts near 10^10, as they come out of the buckets."""
    counts = spark.createDataFrame([("en", b"a", 9_999_999_999), ("en", b"b", 9_999_999_998)], "lang string, phrase binary, n long")
    found = spark.createDataFrame([("en", b"a b", 9_999_999_997)], "lang string, phrase binary, n long")
    monkeypatch.setattr(phrases, "phrases", lambda *a: (counts, found))
    got = phrases.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert got["score"] == 10**6 * 9_999_999_997**2 // (9_999_999_999 * 9_999_999_998)


# ---- pages

WORDS = [f"{a}{b}{c}" for a in "klmnp" for b in ("ara", "eto", "inu", "osi") for c in ("", "s", "ter", "lich", "tion")]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def opaque_site(rng, host, n):
    """Pages whose classes tell nothing, with what each should give."""
    out = []
    for i in range(n):
        paras, title = [words(rng, rng.randint(8, 60)) + f" &amp; {i}" for _ in range(rng.randint(1, 6))], words(rng, 5)
        body = "".join(f"<p>{p}</p>" if j % 2 else f"<p>{p}" for j, p in enumerate(paras))
        said = "".join(f'<div class="z9"><b>user{i}</b> {words(rng, 15)}</div>' for _ in range(rng.randint(0, 3)))
        page = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p {{margin: 0}}</style><script>var t = "</p>"; if (1 < 2) f();</script></head><body>
<div class="a1"><div class="a2">Daily {host}</div><ul><li><a href="/">Home</a></li><li><a href="/n">All the news of today</a></li></ul></div>
<div class="a3">This site sets small files on your machine. Go on?</div>
<div class="q1"><div class="a4" id="t{i}"><h1>{title}</h1>{body}</div>
<div class="a5"><h4>Popular</h4><ul><li><a href="1">{words(rng, 4)}</a></li><li><a href="2">{words(rng, 5)}</a></li></ul></div></div>
<div class="k8"><h3>Comments ({i})</h3>{said}</div><form><input name="q"><label>Your mail</label></form>
<div class="e1">All rights are with {host} &copy;</div></body></html>"""
        out.append((f"https://{host}/{i}", page, "\n\n".join([title, *paras]).replace("&amp;", "&")))
    return out


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_main_text(spark, sent):
    """Templates sent to the tasks, and joined."""
    rng = random.Random(8)
    rows = opaque_site(rng, "one.example", 12) + opaque_site(rng, "two.example", 5)
    rows += [(f"http://named.example/{i}", f'<body><header>Site</header><nav><a href=1>x</a></nav><main><article><header><h1>H{i}</h1></header><p>{t}</p><aside>Also</aside><div class="ad-box">Buy</div></article></main><section id="comments"><p>{words(rng, 90)}</p></section><footer>F</footer>', f"H{i}\n\n{t}") for i, t in enumerate(words(rng, 30) for _ in range(2))]
    same = opaque_site(rng, "copies.example", 1)[0]
    rows += [(f"https://copies.example/{i}", *same[1:]) for i in range(6)]
    rows += [(None, None, ""), ("no host", "", ""), (None, "just words <b>in</b>side", "just words inside"), ("x://h/", "<p>cut off <foot", "cut off"), ("x://h/", "<p>a &lt;b&gt; &#233;&nbsp;c&amp", "a <b> \u00e9 c&")]
    rows += [("https://long.example/", f"<article>{'<p>' + words(rng, 20000)}</article>", None), rows[0]]
    pages = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("main", F.lit(1)).withColumn("row", F.lit(2)).repartition(4)
    got = {r["page_id"]: r for r in templates.main_text(pages, max_sent_bytes=sent).collect()}
    assert len(got) == len(rows) and all(r["host"] == "h" and r["row"] == 2 for r in got.values())
    for i, (url, page, want) in enumerate(rows):
        if want is None:
            want = page[len("<article><p>") : -len("</article>")]
        assert got[i]["text"] == want, url


def test_main_text_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert templates.main_text(pages).count() == 0


def test_classes_nest():
    """A text that always comes with an element of one place is the template's; one that shares its pages by chance isn't."""
    rows = [dict(token=t, text=x, up=u, tag=g, pages=n, times=n, va=v, vb=v, words=w) for t, x, u, g, n, v, w in [(0, False, 0, "", 8, 8, 90), (1, False, 0, "body", 8, 8, 90), (2, False, 1, "div", 8, 8, 60), (3, False, 1, "div", 5, 5, 30), (4, True, 3, "", 5, 5, 10), (5, True, 2, "", 6, 6, 4), (6, True, 1, "", 8, 8, 3)]]
    assert templates.deduce(rows) == (2, [4, 6])


# ---- runs


def brute_runs(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)  # a multiple of the smallest period comes later
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def run_texts():
    rng = random.Random(1)
    out = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x " * 5000, "a b " * 3 + "a b a b c", "a b a b " * 2]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 5)):
            base = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
            parts += (base * rng.randint(1, 8))[: rng.randint(0, 45)]
        out.append(rng.choice([" ", "\t", " \n "]).join(parts))
    base = [f"w{rng.randint(0, 300)}" for _ in range(90)]
    prose = [f"w{rng.randint(0, 300)}" for _ in range(3000)]
    return [*out, " ".join(prose[:50] + base * 4 + prose[50:] + base * 5 + ["end"]), " ".join(prose), *out[9:12]]


@pytest.mark.parametrize("least,times,held", [(6, 4, 400_000), (4, 2, 100), (10, 3, 400_000)])
def test_runs(spark, monkeypatch, least, times, held):
    texts = run_texts()
    monkeypatch.setattr(tandem, "HELD", held)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("found", F.lit(7)).repartition(3)
    got = {r["doc_id"]: r for r in tandem.periodic_runs(docs, least=least, times=times).collect()}
    assert len(got) == len(texts) and got[0]["found"] == 7
    for i, text in enumerate(texts):
        w = (text or "").encode().split()
        runs = brute_runs(w, least, times)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        assert [tuple(r) for r in got[i]["runs"]] == runs, text
        assert got[i]["n_words"] == len(w)
        assert got[i]["collapsed"] == b" ".join(x for j, x in enumerate(w) if j not in gone).decode()


def test_runs_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tandem.described(tandem.periodic_runs(docs)).count() == 0


def test_op13(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 150)))) for i in range(400)] + [(None, "a b"), (401, None), (402, "a " * 50), (402, "a " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        s, m, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
        digests = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode(), b" ".join(x for j, x in enumerate(w) if j not in gone))]
        want.append((doc_id, n, len(runs), s, m, q, 1000 * m // q if runs else None, *digests))
    assert got == sorted(want, key=str)
    assert sum(r[2] > 0 for r in got) > 20


# ---- masks of the top-k search


def test_masks_are_all_and_rows(spark, monkeypatch):
    """All masks of s bits, once, as rows; what would be more of them than the bound goes by a scan, with the same result."""
    from itertools import combinations

    from probelens.llm import topk_hamming

    masks = spark.createDataFrame([(w, 0, -1) for w in (3, 6)], "w int, mask long, top int")
    for s in range(1, 7):
        masks = topk_hamming._further(masks)
        got = sorted((r["w"], r["mask"]) for r in masks.collect())
        assert got == sorted((w, sum(1 << i for i in c)) for w in (3, 6) for c in combinations(range(w), s))
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, rng.getrandbits(64) - 2**63) for i in range(200)], "vec_id long, code long")
    want = sorted(tuple(r) for r in topk_hamming.top_k(rows, rows.where("vec_id % 20 = 0"), k=3).collect())
    monkeypatch.setattr(topk_hamming, "MOST_MASKS", 40)
    assert sorted(tuple(r) for r in topk_hamming.top_k(rows, rows.where("vec_id % 20 = 0"), k=3).collect()) == want


# ---- mixtures of languages


def test_em_stops_within_its_bound():
    """What is missing of the maximum likelihood is below gain, for close languages too, where the iteration is slow."""
    import numpy as np

    from probelens.llm import langid

    rng = np.random.default_rng(0)
    for case in range(30):
        n, k = int(rng.integers(3, 60)), int(rng.integers(2, 5))
        logs = rng.normal(size=(n, k)) * (0.02 if case % 2 else 1.0)
        like, mass = np.exp(logs - logs.max(1, keepdims=True)), rng.integers(1, 9, n).astype(float)
        share, value = langid._em(like, mass, np.array([n]), np.full((1, k), 1 / k), 1e-3)
        best = np.full(k, 1 / k)
        for _ in range(100_000):
            part = like * best
            new = (part / part.sum(1, keepdims=True) * mass[:, None]).sum(0) / mass.sum()
            if np.abs(new - best).max() < 1e-13:
                break
            best = new
        assert abs(share.sum() - 1) < 1e-9 and -1e-9 <= (mass * np.log(like @ best)).sum() - value[0] <= 1e-3
