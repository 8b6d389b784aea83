"""The text operators against brute force, exact round trips and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, common, decontam, html_extract, langid, ngram_jaccard, pii, queries, spm, token_files, toxicity, vptree

P = pytest.importorskip("public_tokenizers")
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = [(None, "no id"), (900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "two words"), (905, "w " * 30000), (906, "same text twice here"), (906, "same text twice here"), (907, "é́ 日本語 😀 \x00 ▁ <|endoftext|> </s>"), (908, "x" * 50000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, ids string, signature int, score string, `a.b` int"


def frame(spark, rows):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", "x", 1, "s", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, ODD).where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# --- language identification ---


def test_language(spark, docs, odd, none):
    truth = dict(docs.select("doc_id", "lang").collect())
    got = langid.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in got} == set(truth) and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    model = langid.fit(docs)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {900, 901, 902}
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_language_ignores_neighbours():
    alone, _ = langid.hashed_ngrams(["bonjour le monde"])
    both, first = langid.hashed_ngrams(["xyz", "bonjour le monde"])
    assert np.array_equal(alone, both[first[1] :])


def test_too_many_languages_are_noticed_first(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = [(i, "some text", f"l{i % 4}") for i in range(40)]
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langid.fit(spark.createDataFrame([r for r in rows if r[2] != "l3"], "doc_id long, text string, lang string"))[0]) == 3


def test_language_by_hand(spark):
    """Plain naive Bayes over the same n-grams, letter by letter."""
    rng = random.Random(8)
    letters = {"aa": "abcde éè", "bb": "defgh ßü", "cc": "ghijk 日本"}
    rows = [(n, "".join(rng.choices(letters[lang] + " .1", k=rng.randrange(1, 80))).upper() if n % 2 else "".join(rng.choices(letters[lang], k=rng.randrange(1, 80))), lang) for n, lang in enumerate(list(letters) * 30)]
    df = spark.createDataFrame([(*r, r[2]) for r in rows] + [(1000, None, "aa", "x"), (1001, "abc", None, "x"), (None, "abcabc", "aa", "x")], "doc_id long, text string, lang string, score string")
    grams = lambda t: langid.hashed_ngrams([t], 1 << 12)[0].tolist()
    counts = {lang: Counter(g for _, t, x in rows if x == lang for g in grams(t)) for lang in letters}
    counts["aa"].update(grams("abcabc"))
    model = langid.fit(df, buckets=1 << 12)
    assert model[0] == sorted(letters)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for i, t, _ in rows:
        logs = {x: sum(math.log((c[g] + 0.1) / (c.total() + 0.1 * 4096)) for g in grams(t)) for x, c in counts.items()}
        top = max(logs.values())
        p = {x: math.exp(v - top) for x, v in logs.items()}
        if any(c.isalpha() for c in t):
            assert p[got[i]["lang_pred"]] == pytest.approx(1.0, abs=1e-3) and got[i]["score"] == pytest.approx(1 / sum(p.values()), abs=1e-3)
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)


def test_language_of_long_texts(monkeypatch):
    """A text taken apart into pieces has the n-grams of the whole."""
    text = "Ab  cé 12 日.. x" * 40 + "...   " * 30 + "end"
    whole, _ = langid.hashed_ngrams([text])
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(common, "CHUNK_CHARS", size)
        assert np.array_equal(np.concatenate(list(langid._long(text, langid.BUCKETS))), whole)
        got = list(langid.grams_of(["a b", text, "", text + "  ", "c"], langid.BUCKETS))
        monkeypatch.undo()
        for n, t in enumerate(["a b", text, "", text + "  ", "c"]):
            own = np.concatenate([g[f[n - at] : f[n - at + 1]] for at, g, f in got if at <= n < at + len(f) - 1] or [np.zeros(0)])
            assert np.array_equal(own, langid.hashed_ngrams([t])[0])


def test_language_memory_of_a_long_text(spark):
    import tracemalloc

    text = "wörter und andere " * 400_000  # 7 MB
    langid.folding.lower_letters()
    tracemalloc.start()
    n = sum(len(g) for _, g, _ in langid.grams_of([text], 1 << 12))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 3 * 6_000_000 and peak < 60 << 20


# --- n-gram Jaccard join ---


def brute(rows, k, percent):
    sets = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: (r[0], r[1] is None, r[1] or ""), reverse=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    group[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed):
    """Copies, near copies, chains of edits and texts made mostly of a passage that all share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for f in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for _ in range(10):
            out.append(list(base))
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(words)
    for _ in range(40):
        out.append([rng.choice(words) for _ in range(rng.randrange(6))] + passage + [rng.choice(words) for _ in range(rng.randrange(6))])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("k,percent,buckets", [(3, 90, 1 << 12), (5, 80, 1 << 6)])
def test_jaccard(spark, k, percent, buckets):
    rows = families(k)
    got = {r[0]: (r[1], r[2]) for r in ngram_jaccard.components_of(frame(spark, rows), k, percent, buckets).collect()}
    assert got == brute(rows, k, percent)


def test_jaccard_odd(spark, odd, none):
    got = {r[0]: (r[1], r[2]) for r in ngram_jaccard.components_of(odd, 3, 90).collect()}
    assert got == brute(ODD, 3, 90)
    assert ngram_jaccard.components_of(none).count() == 0


def kept(rows, k, percent):
    """The rows (number, id, text) that stay when one row of each group does, by brute force."""
    groups = brute([(n, t) for n, (_, t) in enumerate(rows)], k, percent)
    best = {}
    for n, (i, _) in enumerate(rows):
        if groups[n][0]:
            best.setdefault(groups[n][1], []).append((i is None, i or 0, n))
    alike = lambda g: {m for m in best[g] if m[:2] == min(best[g])[:2]}  # noqa: E731  rows of the smallest id; any one of them
    return [n for n in range(len(rows)) if not groups[n][0]], [{m[2] for m in alike(g)} for g in best]


@pytest.mark.parametrize("repeat", [False, True])
def test_one_row_of_a_group_stays(spark, repeat):
    rows = families(9)[:80]
    if repeat:
        rows = rows + ODD + [(7, None), (7, rows[7][1]), (7, "a text of its own that nobody else has got"), (None, rows[3][1]), (None, "no id but a text of its own as well")]
    df = frame(spark, rows)
    got = ngram_jaccard.keep_first(df, 5, 80)
    assert got.columns == df.columns
    empty, groups = kept(rows, 5, 80)
    have = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert have.total() == len(empty) + len(groups)
    for n in empty:
        assert have[rows[n]] > 0
        have[rows[n]] -= 1
    for g in groups:
        one = next(rows[n] for n in g if have[rows[n]] > 0)
        have[one] -= 1


def test_members_meet_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    rows = [(1, i, 1) for i in range(30)] + [(2, i, 1) for i in range(3)]
    at = ngram_jaccard._dealt(spark.createDataFrame(rows, "signature long, doc_id long, n long"))
    one, two = (at.select("signature", "low", "high", F.col("doc_id").alias("d" + x), F.col("block").alias("b" + x)) for x in "ab")
    met = one.join(two, ["signature", "low", "high"]).where("(low = high or ba <> bb) and da < db").select("signature", "da", "db").collect()
    assert len(met) == len(set(met)) == 30 * 29 // 2 + 3


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("frequent", [0, 3, 99])
def test_linked_sets_share_a_signature(percent, frequent):
    rng = np.random.default_rng(frequent + percent)
    for n in [3, 5, 9, 10, 40, 90, 200, 700]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = x.copy()
            gone = rng.permutation(len(x))[: int((1 - percent / 100) * len(x) * rng.random())]
            y = np.unique(np.concatenate([np.delete(y, gone), rng.integers(0, 2**63, rng.integers(0, len(gone) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (len(x) + len(y) - both) or np.array_equal(x, y):
                continue
            level = lambda u: (common.mix(u) % np.uint64(7)).astype(np.uint8)
            (a, la), (b, lb) = (ngram_jaccard.signatures(u, level(u), frequent, percent) for u in (x, y))
            _, i, j = np.intersect1d(a, b, return_indices=True)
            assert len(i)
            # no bound of the signatures that both have may rule the pair out altogether
            most = np.minimum(la[i], lb[j])
            assert (100 * most >= percent * (len(x) + len(y) - most)).any()


# --- vantage-point trees ---


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).round(3)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [math.nan] + [1.0] * 7), (503, [None] + [1.0] * 7), (504, [math.inf] + [1.0] * 7), (None, [1.0] * 8), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.search(df, df.where("vec_id % 20 = 0"), 20, 1.0).collect()}
    for q in range(0, 400, 20):
        want = sorted((-float((x[q] * v).sum()), i) for i, v in enumerate(x) if i != q)[:20]
        assert [got[q, n + 1][0] for n in range(20)] == [i for _, i in want]
        assert [got[q, n + 1][1] for n in range(20)] == pytest.approx([-s for s, _ in want])
    assert len(got) == 400
    found = {(r["query_id"], r["vec_id"]) for r in vptree.search(df, df.where("vec_id % 20 = 0"), 20, 1.5).collect()}
    assert len(found & {(q, v) for (q, _), (v, _) in got.items()}) >= 0.9 * len(got)
    assert vptree.search(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id < 3")
    assert vptree.search(few, few, 20).count() == 6
    with pytest.raises(ValueError):
        vptree.search(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.select("vec_id", "embedding").schema), few)


def nearest_by_hand(rows, k, every):
    """(query, rank) -> (vec_id, score) by comparing all pairs; of rows with one id the smallest vector counts."""
    own = {}
    for i, v in rows:
        own[i] = min(own.get(i, v), v)
    x = {i: np.array(v, float) for i, v in own.items() if any(v)}
    out = {}
    for q in x:
        if q % every == 0:
            for n, (s, i) in enumerate(sorted((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q)[:k]):
                out[q, n + 1] = (i, -s)
    return out


@pytest.mark.parametrize("kind", ["bits", "whole", "large", "clusters"])
def test_nearest_is_exact_on_ties(spark, kind):
    rng = np.random.default_rng(11)
    n, d = 900, 6
    x = {
        "bits": lambda: rng.integers(0, 2, (n, d)).astype(float),
        "whole": lambda: rng.integers(-3, 4, (n, d)).astype(float),
        "large": lambda: rng.integers(-3, 4, (n, d)) * 1e6 + rng.integers(0, 2, (n, 1)),
        "clusters": lambda: rng.integers(-40, 40, (12, d))[rng.integers(0, 12, n)] + rng.integers(0, 2, (n, d)) * 0.5,
    }[kind]()
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(7, x[9].tolist()), (20, x[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vptree.search(df, df.where("vec_id % 20 = 0"), 20, 1.0, shard_rows=100).collect()}
    assert got == nearest_by_hand(rows, 20, 20)


# --- decontamination ---


def windows(text):
    w = re.findall(r"[0-9a-zA-Z\u0080-\U0010ffff]+", (text or "").replace("İ", "i").lower())
    return w, [tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))]


def leaks(text, items):
    words, _ = windows(text)
    out = {}
    for item, t in items:
        own, _ = windows(t)
        k = min(5, len(own))
        if not own or len(words) < k:
            continue
        grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        c, best = grams(own), 0.0
        for at in range(max(1, len(words) - len(own) + 1)):
            u = grams(words[at : at + len(own)])
            n = sum((u & c).values())
            best = max(best, n / (u.total() + c.total() - n))
        if best >= 0.8 - 1e-12:
            out[item] = round(best, 9)
    return out


def test_decontamination(spark, sf, docs, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    rng = random.Random(2)
    planted = []
    for n, (_, t) in enumerate(items[:20]):
        w = t.split()
        if n % 3 == 1:
            w[len(w) // 2] = "changed"
        if n % 3 == 2:
            w[rng.randrange(len(w))] += "!"
        planted.append((5000 + n, "before it " * 9 + " ".join(w).upper() + " and after"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(60).collect()] + planted
    got: dict = {}
    for r in decontam.matches(frame(spark, rows), bench).collect():
        got.setdefault(r["doc_id"], {})[r["item_id"]] = round(r["similarity"], 9)
        assert windows(dict(rows)[r["doc_id"]][r["start_char"] : r["end_char"]])[0] != []
    assert got == {i: x for i, t in rows if (x := leaks(t, items))}
    assert all(5000 + n in got for n in range(0, 20, 3))
    short = spark.createDataFrame([(1, "Two Words"), (1, "Two Words"), (2, None), (3, ""), (None, "two")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(odd, short).collect()} == {(904, 1)}
    assert decontam.matches(odd, short.where("false")).count() == 0 and decontam.matches(none, short).count() == 0


def test_fingerprints_within_radius():
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"w{v}" for v in rng.integers(0, 50, 30))) for i in range(40)]
    index = decontam.Index(items, 5, 0.8, 79).sizes[30][1]
    asked = np.stack([np.where(rng.random(32) < share, index.prints[i % 40], f) for i, (f, share) in enumerate(zip(rng.integers(0, 256, (400, 32)), rng.random(400)))]).astype(np.uint8)
    for f, got in zip(asked, index.within(asked)):
        assert got.tolist() == [i for i, p in enumerate(index.prints) if sum(bin(a ^ b).count("1") for a, b in zip(p.tolist(), f.tolist())) <= 79]


@pytest.mark.parametrize("words,run", [(113, 60), (157, 90), (224, 150), (336, 250), (445, 350), (60, 0)])
def test_repeated_words_are_found(words, run):
    """Passages that are mostly a run of one word, near the threshold, and other edits of an item."""
    rng = random.Random(words)
    index_of = lambda t: decontam.Index([(1, t)], 5, 0.8, decontam.RADIUS)
    for _ in range(20):
        base = [f"v{rng.randrange(10**6)}" for _ in range(words - run)] + ["again"] * run
        item = " ".join(base)
        edited = list(base)
        for _ in range(rng.randrange(1, 1 + max(1, words // 60))):
            edited[rng.randrange(words - run)] = "changed"
        if run:
            edited = edited[: words - run // 10] + [f"z{n}" for n in range(run // 10)]
        want = leaks(" ".join(edited), [(1, item)])
        h, first, _, _ = common.hash_words([" ".join(edited).encode()], decontam.WORD_GAPS)
        got = {i: round(sim, 9) for i, _, _, sim in index_of(item).find(h)}
        assert got == want


def test_short_documents_are_whole_windows(spark):
    item = " ".join(f"w{i}" for i in range(38))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.split(" ", 1)[1]), (2, item.rsplit(" ", 1)[0]), (3, " ".join(item.split()[:30])), (4, " ".join(item.split()[:37])), (5, "w1 w2 w3 w4 w5 w6")]
    got = {r["doc_id"] for r in decontam.matches(frame(spark, rows), bench).collect()}
    assert got == {i for i, t in rows if leaks(t, [(1, item)])} == {1, 2, 4}
    both = frame(spark, [(None, item), (1, item), (1, "clean words"), (2, None)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in decontam.keep_clean(both, bench).collect() if r["text"]) == [(1, "clean words")]
    assert decontam.keep_clean(both, bench).columns == both.columns


# --- page texts ---


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import html

    got = {r["page_id"]: r for r in html_extract.main_texts(pages.withColumn("host", F.lit(1)).withColumn("path", F.lit(2))).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_page_consensus(spark):
    shell = "<body><div class='top nav'>menu</div><div id=main><div class='post p-{0}'>{1}</div></div><div class=extra>{2}</div><div class='comments'>bad</div></body>"
    rows = [(i, "http://h.example/a", shell.format(i, f"<h2>T{i}</h2><p>body text of page {i} is here", "x")) for i in range(5)]
    rows += [(9, "http://h.example/b", shell.format(9, "<p>short", "some very long text outside the post which would win on its own " * 3)), (10, None, None), (11, "http://h.example/c", ""), (12, "x", "<<p>&lt;a&gt; &#x41;<script>no</script><b>b</b>c"), (9, "http://h.example/b", "<p>again")]
    got = [(r["page_id"], r["text"]) for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    assert (0, "T0 body text of page 0 is here") in got and (9, "short") in got and (10, "") in got and (11, "") in got and (9, "again") in got
    assert next(t for i, t in got if i == 12).endswith("<a> Abc")
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lead_beside_the_body(spark):
    """On a host without article or main the lead that stands beside the body belongs to the text; menus don't."""
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    page = "<body><div class=links>" + "<a href=x>link text</a> " * 9 + "</div><div id=content><div class=lead>{0}</div><div class=body>{1}</div></div><div class=tail>ok</div></body>"
    rows = [(i, "http://h.example/a", page.format(words(12, f"lead{i}x"), words(88, f"body{i}x"))) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: words(12, f"lead{i}x") + " " + words(88, f"body{i}x") for i in range(4)}


@pytest.mark.parametrize("markup", ["<div>", "<div class=a>", "<a ", "<svg>", "<p><b>", "<td><b>", "<li>x", "</x><div>", "<!-- ", "<a '>\"", "<style>x</style", "<b><tr></tr>"])
def test_deep_and_broken_markup_is_linear(markup):
    import time
    import tracemalloc

    def cost(n):
        page = "start " + markup * n + " text"
        began = time.process_time()
        html_extract.extract(page, None)
        [c.path() for _, c in html_extract.scored(*html_extract.parse(page))]
        return time.process_time() - began

    cost(1000)
    assert cost(100_000) < 30
    tracemalloc.start()
    html_extract.parse("<p>some text here" + markup * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


# --- token files ---


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(50).collect()] + [r for r in ODD if r[0] is not None and r[0] != 905]
    directory = f"file://{tmp_path}/tokens"
    manifest = token_files.write(frame(spark, rows), directory, WORDS, sequence=64, partitions=3).cache()
    got = sorted(tuple(r) for r in token_files.read(manifest, directory).collect())
    at, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):  # the one repeated id has equal texts
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)
    one = manifest.orderBy("part").first()
    f = token_files.TokenFile(pafs.LocalFileSystem(), one["path"] + ".arrow")
    ids, mask = f.sequence(0)
    assert len(ids) == 64 and mask.all() and not ids.flags.owndata
    last = pa.ipc.open_file(pa.memory_map(one["path"] + ".arrow"))
    batch = last.get_batch(last.num_record_batches - 1)
    assert int(batch.column("mask").flatten().to_numpy(zero_copy_only=False).sum()) % 64 == one["tokens"] % 64
    empty = token_files.write(none, f"file://{tmp_path}/none", WORDS)
    assert token_files.read(empty, f"file://{tmp_path}/none").count() == 0


def test_every_letter_before_a_sign_is_encoded_as_by_the_library():
    """All letters, marks, numbers and blanks of Unicode beside signs and letters, and random mixtures of them."""
    import unicodedata

    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), token_files.Encoder(WORDS, "uint16")
    assert own.by_words
    rng = random.Random(5)
    every = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c))[0] in "LMNZ" and not 0x4E10 < c < 0x9F00 and not 0xAC10 < c < 0xD700 and not 0x3500 < c < 0x4D00 and not 0x20010 < c]
    texts = []
    for at in range(0, len(every), 8):
        texts.append(" ".join(x for c in every[at : at + 8] for x in (f"/{c}$", f"a{c}.b", f"{c}*", f"e {c}, A{c}é!", f"{c}'s|", f"\t{c}\n{c}#")))
    pool = every + list(" .,;:!?*%$&#'|<>/\n\t\u00a0") * 300 + list("abcéßİΣσςAZ09") * 300
    texts += ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(20000)]
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    got = own.encode(texts)
    assert [x for x, a, b in zip(texts, want, got) if np.frombuffer(b, "uint16").tolist() != a.ids] == []


def test_token_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_BYTES", 20_000)
    own, rng = token_files.Encoder(WORDS, "uint16"), random.Random(1)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(60)]
    got = [own.encode([t])[0] for t in texts]
    assert own.size < 40_000 and got == token_files.Encoder(WORDS, "uint16").encode(texts)
    assert len(own.words) + len(own.words_before) < 300 and own.encode(texts) == got


# --- personal data ---


def luhn(digits):
    total = sum(d if n % 2 == 0 else d * 2 - 9 * (d > 4) for n, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p.lstrip("0")[:5] or 0) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


HARD = [
    "a@b.c_d@e.f.g x +1 (489) 555-0950 ip 1.2.3.4.5.6.7.8 4111 1111 1111 1111 999.1.1.1 0010.2.3.4", "12345678901234567890123 4111-1111-1111-1111 41111111111111111111",
    "4" * 5000 + " " + "1." * 3000, "é😀 x.y@z.de, +49 30 1234567 +49301234567890123 😀 4111  1111 1111 1111", "@a@b.c@d.e +1+12345678901+ 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a.b@c.d " * 700,
    "%" * 2000 + "@x.y", "1.2.3.4" * 50, "+" * 300 + "1 234 567 8901", "4111 1111 1111 1111 " * 300,
]


def test_personal_data(spark, docs, odd, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(7000 + n, t) for n, t in enumerate(HARD)] + [r for r in ODD if r[0] != 906]
    df = frame(spark, rows)
    model = pii.fit(df)
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(df, model)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), i
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[3] == k for x in want) for k in pii.KINDS[:4]]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert clean[900] is None and clean[901] == "" and "x.y@z.de" not in clean[7003] and clean[7003].startswith("é😀 [EMAIL], [PHONE]")
    assert pii.redact(odd, model).columns == odd.columns and pii.detect(odd, model).count() == len(ODD)
    assert pii.detect(none, pii.fit(none)).count() == 0
    assert pii.detect(odd, pii.fit(none)).count() == len(ODD)


KEPT = ["Mrs. Ortega", "Dr Weiss", "Klaus Richter", "jane.roe (at) mail (dot) example (dot) org", "j_r [at] web.de", "(415) 555-0123", "415-555-0123"]
DROPPED = ["James Street was long", "order 415-555-0123 shipped", "serial 415 555 0123", "Mark Avenue", "version (115) 155-0123"]


def test_loose_spans(spark):
    """Loose candidates in the fit: contact details stay, look-alikes go, and nothing else is touched."""
    rows = [(n, f"we met {t} there") for n, t in enumerate(KEPT * 5)] + [(1000 + n, f"the {t} there") for n, t in enumerate(DROPPED * 5)]
    rows += [(2000, "a.b@c.de " * 900 + "Klaus Richter " * 900), (2001, "+1 (415) 555-0123 and (415) 555-0123")]
    df = frame(spark, rows)
    model = pii.fit(df)
    got = {r["doc_id"]: r["spans"] for r in pii.detect(df, model).collect()}
    text = dict(rows)
    for n, t in enumerate(KEPT * 5):
        assert [text[n][s["start"] : s["end"]] for s in got[n]] == [t], t
    assert [text[i] for i in got if 1000 <= i < 2000 and got[i]] == []
    assert len(got[2000]) == 1800 and [(s["start"], s["end"]) for s in got[2001]] == [(0, 17), (22, 36)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert clean[0] == "we met [NAME] there" and clean[1000] == text[1000]
    unseen = pii.fit(df.where("false"))
    assert {r["doc_id"]: len(r["spans"]) for r in pii.detect(df, unseen).collect()} == {i: len(s) for i, s in got.items()}


# --- toxicity ---


def test_toxicity(spark, odd, none):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    truth = dict(labels.select("doc_id", "toxic").collect())
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)  # learned from 300 rows
    lexicon = toxicity.fit(toxicity.labelled(docs, labels))
    score = lambda t: lexicon.score(toxicity.fold([t])[0])
    assert min(score(t) for t in ("you idiot", "an 1d10t", "аn іdiоt", "ＩＤＩＯＴ", "id!ot")) >= 0.3 > score("a fine day")
    assert len(toxicity.score(odd, lexicon).collect()) == len(ODD)
    assert toxicity.keep_below(odd, lexicon, 0.3).columns == odd.columns
    unlabelled = toxicity.classify(none, labels)
    assert unlabelled.count() == 0
    assert {(r["predicted"], r["score"]) for r in toxicity.classify(odd, labels.where("false")).collect()} == {(0, 0.0)}


def test_folding():
    fold = lambda t: toxicity.fold([t, "x"])[0].split()
    for t in ("ïdïöt", "id\u200biot", "i\u0301diot", "ІDІОТ", "1d10t", "id!ot", "ＩＤＩＯＴ", "i\u00addiot"):
        assert fold(t) == ["idiot"], t
    assert fold("straße año") == ["straße", "ano"] and toxicity.readings(" idiiiot ") == [" idiot ", " idiiot "]
    lexicon = toxicity.Lexicon({" idiot": 3.0, " ass ": 3.0}, frozenset(), (-3.0, 2.0, 2.0, 1.0))
    hit = lambda t: lexicon.measure(toxicity.fold([t])[0])[0] > 0
    assert hit("idiiiiot") and hit("assss") and not hit("as a fine day") and not hit("assist")
    assert toxicity.Lexicon({}).score(" any ") == 0.0


def test_toxicity_by_hand(spark):
    """Counts, lexicon hits and scores against plain loops without an automaton."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.labelled(docs, labels).collect()
    lexicon = toxicity.fit(toxicity.labelled(docs, labels))
    counts = (Counter(), Counter())
    folded = {r["doc_id"]: toxicity.fold([r["text"]])[0] for r in rows}
    for r in rows:
        words = {w for t in toxicity.readings(folded[r["doc_id"]]) for w in t.split()}
        counts[r["toxic"]].update({" " + w + " " for w in words} | {" " + w[:n] for w in words for n in range(4, 9) if len(w) >= n})
    sizes = Counter(r["toxic"] for r in rows)
    odds = lambda k: math.log((counts[1][k] + 0.1) / (sizes[1] + 0.2)) - math.log((counts[0][k] + 0.1) / (sizes[0] + 0.2))
    assert lexicon.weights and all(w == pytest.approx(odds(k)) and counts[1][k] >= 5 and w >= 1.5 for k, w in lexicon.weights.items())

    def by_hand(text):
        best = 0.0
        for t in toxicity.readings(text):
            words, total = t.split(), 0.0
            for i, w in enumerate(words):
                own = max([x for k, x in lexicon.weights.items() if (w == k.strip() if k.endswith(" ") else w.startswith(k.strip()))], default=0.0)
                around = {(words[i - 1] if i else "") + " " + w, w + " " + (words[i + 1] if i + 1 < len(words) else "")}
                total += own if not around & lexicon.exceptions else 0.0
            best = max(best, total and math.log1p(total))
        return best

    for t in list(folded.values())[:150] + [toxicity.fold(["you iiidiot id1ot an idiot"])[0]]:
        assert lexicon.measure(t)[0] == pytest.approx(by_hand(t))


def test_exceptions():
    lexicon = toxicity.Lexicon({" trash": 3.0}, frozenset({"trash can"}), (-3.0, 2.0, 2.0, 1.0))
    assert lexicon.measure(" put it in the trash can ") == (0.0, 0.0, 0.0) and lexicon.measure(" you trash ")[0] > 0
    assert lexicon.measure(" xtrash ")[0] == 0


# --- SentencePiece ---


def cut_slowly(model, text, key, dropout, seed, drawn=None):
    """Ids of a text by one agenda a unit; drawn collects the draws of the candidate merges."""
    limit, symbols = min(2**64 - 1, int(dropout * 2.0**64)), [int(model.chars[ord(c)]) for c in text]
    inner = {(a, b) for p in model.symbols for a, b in zip(p, p[1:])}
    units = []
    for i, c in enumerate(text):
        pair = tuple("\u2581" if x == " " else x for x in text[i - 1 : i + 1])
        if i and pair in inner and not {text[i - 1], c} & set("\u2581\0\n"):
            units[-1].append(i)
        else:
            units.append([i])
    out = []
    for number, own in enumerate(units):
        unit = int(model.unit_keys(np.array([key]), np.array([number]), seed)[0])
        skips = model.skips
        if drawn is not None:
            model.skips = lambda *x: drawn.append(r := skips(*x)) or r
        got = model.agenda([symbols[i] for i in own], unit, limit)
        model.__dict__.pop("skips", None)
        for i, s in zip(own, got):
            if s >= 0:
                out += [s] if s < model.size else [int(model.bytes[b]) for b in text[i].encode()]
    return out


def test_pieces(spark, docs, odd, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").limit(40).collect()]
    model = spm.Model.load(PIECES)
    drawn = []
    for i, t in [(i, t[:1500]) for i, t in rows[:15]] + [(i or 0, (t or "")[:1500]) for i, t in ODD] + [(5, "aaaa " * 90 + "b" * 200)]:
        for dropout, seed in ((0.0, 1), (0.1, 1), (0.5, 7), (1.0, 1)):
            own = drawn if dropout == 0.1 else None
            assert model.encode([t, t], [i, i], dropout, seed)[1].tolist() == cut_slowly(model, t, i, dropout, seed, own)
    assert 0.09 < sum(map(bool, drawn)) / len(drawn) < 0.11  # candidates are skipped at the rate asked for
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(plain.encode(t) == model.encode([" " + t], [1], 0.0, 1)[0].tolist() for t in ("Hello world", "ab  cd é", rows[0][1]))
    line = model.encode([" information" * 4000], [1], 0.1, 1)[0]
    ends = np.flatnonzero([model.out[i].startswith(b" ") for i in line])
    assert len({tuple(x.tolist()) for x in np.split(line, ends)}) > 50  # the same word is cut in many ways within a line
    words = model.encode([" government"] * 3000, list(range(3000)), 0.1, 1)
    assert len({tuple(x.tolist()) for x in words}) > 30 and all(model.decode(x) == " government" for x in words)
    df = frame(spark, rows + ODD)
    coded = spm.encode(df, PIECES).cache()
    assert set(coded.columns) == set(df.columns)
    back = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in spm.decode(coded, PIECES).collect())
    assert back == sorted((i is not None, i or 0, t or "") for i, t in rows + ODD)
    assert all(r["lossless"] for r in spm.round_trip(df, PIECES).collect())
    ids = lambda **how: {r["doc_id"]: r["ids"] for r in spm.encode(frame(spark, rows), PIECES, **how).collect()}
    assert ids(seed=3) == ids(seed=3) != ids(seed=4) and ids(dropout=0.0, seed=3) == ids(dropout=0.0, seed=4)
    assert spm.encode(none, PIECES).count() == 0


# --- chat formatting ---


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|>\n \\< [INST] |>"), (1, 1, "assistant", "a</s>\\"), (1, 1, "assistant", "a</s>\\"), (1, None, "system", None), (2, 5, None, "x"), (None, 0, "user", "q"), (None, 1, "assistant", ""), (3, 0, "as|>\nsis<tant", "<|assistant|>\n")]
    rows += [(4, n, "user" if n % 2 else "assistant", f"t{n}") for n in range(37)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("x")).withColumn("id", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_trees(chat.chain(df))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_trees(chat.chain(df.where("false")))).count() == 0


def test_chat_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 2, "user", "other", 0.2), (2, 1, 77, "user", "lost parent", None)]
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    assert sorted((r["tree"], r["leaf"], r["id"], r["distance"]) for r in chat.paths(df).collect()) == [(1, 4, 1, 2), (1, 4, 3, 1), (1, 4, 4, 0), (1, 5, 1, 2), (1, 5, 2, 1), (1, 5, 5, 0), (2, 1, 1, 0)]
    best = {r["tree"]: r["formatted"] for r in chat.format_trees(df).collect()}
    assert best[1] == "<|user|>\nq<|end|>\n<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n" and len(best) == 2
    assert chat.format_trees(df, keep=2).where("tree = 1").count() == 2
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1)], "tree long, id long, parent long")).count()


# --- queries and pipeline ---


def test_queries_are_native_where_asked(spark, sf):
    for name in ("op7_weak_supervision", "op10_chat_trees"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_search_query_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, keys in (("op2_ngram_jaccard", ["doc_id", "n_shingles", "component_id"]), ("op3_vantage_point_search", ["query_id", "rank", "vec_id"]), ("op10_chat_trees", ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])):
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, sf).select(*keys).collect())
        assert got == sorted(con.sql(queries.ORACLE_SQL[name]).project(", ".join(keys)).fetchall())


def bag(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_pipeline(spark, sf, none):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    calm = pipeline.drop_toxic(spark, docs, sf).cache()
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r[0] for r in calm.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.3} and labels
    single = pipeline.drop_near_duplicates(spark, calm, sf).cache()
    groups = brute([tuple(r) for r in calm.select("doc_id", "text").collect()], 5, 80)
    assert {r[0] for r in single.select("doc_id").collect()} == {i for i, (_, c) in groups.items() if c == i}
    fair = pipeline.drop_benchmark(spark, single, sf).cache()
    assert {r[0] for r in fair.select("doc_id").collect()} == {i for i, t in single.select("doc_id", "text").collect() if not leaks(t, items)}
    private = pipeline.redact_private(spark, fair, sf).cache()
    assert private.count() == fair.count() and not [r for r in private.collect() if any(x[3] == "email" for x in base_spans(r["text"]))]
    for df in (calm, single, fair, private):
        assert df.columns == docs.columns
    out = pipeline.encode_tokens(spark, private, sf)
    assert {r["doc_id"]: r["text"] for r in spm.decode(out, PIECES).collect()} == {r["doc_id"]: r["text"] for r in private.collect()}


def test_pipeline_on_odd_rows(spark, sf):
    """Each stage keeps exactly the rows that brute force keeps, whatever ids, texts and columns they have."""
    import corpus_pipeline as pipeline

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    leak = items[0][1]
    rows = ODD + [(906, None), (7, None), (7, "the real text of this id stays"), (7, leak), (None, leak), (None, None), (9, "mail me: a.b@c.de")]
    odd = frame(spark, rows)
    for name, stage in pipeline.STAGES:
        got = stage(spark, odd, sf)
        assert stage(spark, odd.where("false"), sf).count() == 0
        assert name == "token_ids" or got.columns == odd.columns
        if name in ("toxicity", "personal_data"):
            assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in rows)
        if name == "personal_data":
            assert (9, "mail me: [EMAIL]") in bag(got.collect()) and (906, None) in bag(got.collect())
        if name == "near_duplicates":
            want = Counter(rows)
            want[906, "same text twice here"] -= 1
            want[None, leak] -= 1  # the row with an id stays of the two
            assert bag(got.collect()) == +want
        if name == "decontamination":
            assert bag(got.collect()) == Counter(r for r in rows if r[1] != leak)
        if name == "token_ids":
            assert Counter(r["text"] for r in spm.decode(got, PIECES).collect()) == Counter(t or "" for _, t in rows)
