"""Periodic runs, importance resampling and sketched near duplicates against brute force, SQL and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import crc_ring, ngram_jaccard, periodic_runs, queries, setsketch

ODD = [(None, "no id"), (900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "two words"), (905, "w " * 30000), (906, "same text twice here"), (906, "same text twice here"), (907, "é́ 日本語 😀 \x00 ▁ a"), (908, "x" * 50000)]
SCHEMA = "doc_id long, text string, lang string, value string, n long, component_id string, score int, `a.b` int, rank int"


def frame(spark, rows):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_crc_ring", "op13_setsketch"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.project(", ".join(got.columns)).fetchall())


# --- periodic runs ---


def runs_by_hand(words, least_words, least_periods):
    """Maximal stretches for each period, without those that a divisor of the period explains."""
    out = set()
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least_words, least_periods * q):
                out.add((start, i + q - start, q))
            i += 1
    return sorted(r for r in out if not any(all(words[k] == words[k + d] for k in range(r[0], r[0] + r[1] - d)) for d in range(1, r[2])))


@st.composite
def repeating(draw):
    words = draw(st.lists(st.sampled_from("abcde"[: draw(st.integers(1, 5))]), max_size=80))
    if words and draw(st.booleans()):
        a = draw(st.integers(0, len(words) - 1))
        p = draw(st.integers(1, max(1, (len(words) - a) // 3)))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    return words


@settings(max_examples=400, deadline=None)
@given(repeating(), st.sampled_from([(24, 3), (3, 3), (1, 5)]))
def test_runs_by_hand(words, least):
    found = periodic_runs.runs_of(words, *least)
    assert found == runs_by_hand(words, *least)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    assert periodic_runs.collapse(words, found) == [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=200, deadline=None)
@given(repeating())
def test_lyndon_words(words):
    """The end of the longest Lyndon word is the next start of a smaller suffix."""
    numbers = periodic_runs.Words(words)
    for reverse in (False, True):
        x = [-v if reverse else v for v in numbers.ids]
        want = [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) for i in range(len(x))]
        assert periodic_runs.lyndon_ends(numbers, reverse) == want


def test_misled_hashes_are_noticed(monkeypatch):
    words = [f"w{i * 7 % 50}" for i in range(50)] * 4 + ["end"]
    want = periodic_runs.runs_of(words)
    assert want == [(0, 200, 50)]
    monkeypatch.setattr(periodic_runs, "_PRIME", 3)
    assert periodic_runs.runs_of(words) == want


def test_long_structured_words():
    """A Thue-Morse word has no run of three periods; a Fibonacci word has; both mislead weak hashes."""
    morse = [bin(i).count("1") % 2 for i in range(1 << 13)]
    assert periodic_runs.runs_of(morse, 3, 3) == []
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    assert periodic_runs.runs_of(list(b), 3, 3) == runs_by_hand(list(b), 3, 3)
    assert periodic_runs.runs_of(["w"] * 20000) == [(0, 20000, 1)]


def test_strongest_run_is_exact(spark):
    big = 10**9
    rows = [(1, [(5, 3 * big + 1, big), (2, 9 * big + 4, 3 * big + 1), (1, 30, 10)]), (2, [(7, 30, 10), (3, 60, 20), (3, 30, 10)]), (3, [])]
    df = spark.createDataFrame([(i, r, "") for i, r in rows], "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    got = {r["doc_id"]: r for r in periodic_runs.digest(df).collect()}
    assert got[1][2:5] == (5, 3 * big + 1, big) and got[2][2:5] == (3, 30, 10) and got[2]["exponent_milli"] == 3000
    assert got[3][1:6] == (0, None, None, None, None) and got[3]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def test_runs_of_odd_rows(spark):
    odd = frame(spark, ODD)
    got = {r["doc_id"]: r for r in periodic_runs.find(odd).collect()}
    assert periodic_runs.find(odd).count() == len(ODD) and periodic_runs.find(odd.where("false")).count() == 0
    assert [tuple(r) for r in got[905]["runs"]] == [(0, 30000, 1)] and got[905]["collapsed"] == "w"
    assert all(got[i]["runs"] == [] and got[i]["collapsed"] == "" for i in (900, 901, 902))
    assert got[907]["collapsed"] == "é́ 日本語 😀 \x00 ▁ a"
    planted = periodic_runs.with_planted_runs(odd)
    assert planted.count() == len(ODD) and planted.where("doc_id is null").first()["text"] == "no id"


# --- importance resampling ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features_by_hand(text, n, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB9 ,éÉ日\n\x00_{", max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_ring_by_hand(text, n, piece):
    """The same features wherever pieces are cut."""
    before, crc_ring.PIECE = crc_ring.PIECE, piece
    try:
        got = list(crc_ring.features(text.encode(), n, 1000))
    finally:
        crc_ring.PIECE = before
    words, want = features_by_hand(text, n, 1000)
    assert sum(w for w, _ in got) == words
    assert sorted(np.concatenate([f for _, f in got]).tolist() if got else []) == sorted(want)


def test_resampling_by_hand(spark):
    rng = random.Random(3)
    topics = {"far": "lorem ipsum dolor sit amet tempor".split(), "near": "gain bucket ratio sample target 日本".split()}
    rows = [(i, " ".join(rng.choices(topics["near" if i % 5 == 0 else "far"], k=rng.randrange(10, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "gain " * 40), (902, "gain " * 40), (None, "gain " * 40)]
    target = [("Gain bucket, ratio sample!",), (None,), ("",)]
    got = crc_ring.resample(frame(spark, rows), spark.createDataFrame(target, "text string"), n=2, buckets=64, percent=10, least_words=20, seed=7).collect()
    each = [(i, *features_by_hand(t, 2, 64)) for i, t in rows]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for (x,) in target for b in features_by_hand(x, 2, 64)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 64) / ((s[b] + 1) * (t.total() + 64)))) for b in range(64)]
    want = []
    for i, words, f in each:
        w = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, words, len(f), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    order = sorted((-r[4], r[0]) for r in want if r[1] >= 20 and r[4] is not None)
    drawn = order[: len(order) // 10]
    assert [(-r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    assert sum(i % 5 == 0 for _, i in drawn) > len(drawn) / 2


def test_resampling_of_odd_rows(spark):
    odd, target = frame(spark, ODD), spark.createDataFrame([("one w",)], "text string")
    got = crc_ring.resample(odd, target, percent=100).collect()
    assert len(got) == len(ODD) and {r["doc_id"] for r in got if r["rank"]} == {905}
    assert all(r["n_features"] == 0 and r["weight"] == 0 for r in got if r["doc_id"] in (900, 901, 902))
    assert crc_ring.resample(odd.where("false"), target).count() == 0
    assert crc_ring.resample(odd, target.where("false")).count() == len(ODD)


# --- sketches ---


def _sets(rng, n, similarity):
    both = round(2 * n * similarity / (1 + similarity))
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    return a, np.concatenate([a[:both], rng.integers(0, 2**63, n - both, dtype=np.uint64)])


def test_registers_estimate_similarity_and_size():
    rng = np.random.default_rng(4)
    for similarity in (0.2, 0.5, 0.8):
        found = []
        for _ in range(60):
            a, b = _sets(rng, 500, similarity)
            x, y = setsketch.sketch_sets([a, b])
            found.append(setsketch.estimate(np.array([500.0]), np.array([500.0]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0][0])
            assert abs(setsketch.cardinality(x) / 500 - 1) < 0.25
        assert abs(np.mean(found) - similarity) < 0.02 and np.std(found) < 0.04


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 900, dtype=np.uint64)
    x, y, both = setsketch.sketch_sets([a, b, np.concatenate([a, b])])
    assert np.array_equal(setsketch.merge(np.vstack([x, y])), both)
    big = rng.integers(0, 2**63, 3 * setsketch.CHUNK + 5, dtype=np.uint64)
    assert np.array_equal(list(setsketch.sketch_sets([big]))[0], setsketch.registers(setsketch.minima(big, np.array([0])))[0])


def test_linked_pairs_meet_and_pass():
    """Pairs at the threshold share a band and are never dropped by the likelihood; far ones are."""
    rng = np.random.default_rng(6)
    for n in (9, 45, 450):
        for _ in range(300):
            a, b = _sets(rng, n, 0.8)
            x, y = setsketch.sketch_sets([a, b])
            assert (setsketch.band_values(x[None]) == setsketch.band_values(y[None])).any()
            assert setsketch.may_link([n], [n], [(x > y).sum()], [(x < y).sum()], 80)[0]
    a, b = _sets(rng, 450, 0.4)
    x, y = setsketch.sketch_sets([a, b])
    assert not setsketch.may_link([450], [450], [(x > y).sum()], [(x < y).sum()], 80)[0]
    assert not setsketch.may_link([100], [79], [21], [0], 80)[0] and setsketch.may_link([100], [80], [100], [0], 80)[0]


def components_by_hand(rows, k, percent):
    sets = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: (r[0], r[1] is None, r[1])):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.setdefault(i, {tuple(words)} if 0 < len(words) < k else {tuple(words[j : j + k]) for j in range(len(words) - k + 1)})
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("block", [2048, 4])
def test_sketched_components_by_hand(spark, monkeypatch, block):
    """Chains, stars and crowds of near copies, in blocks of few members too."""
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rng = random.Random(11)
    rows, vocabulary = [], [f"w{i}" for i in range(3000)]
    for group in range(12):
        words = rng.choices(vocabulary, k=rng.choice([6, 30, 120]))
        for _ in range(rng.choice([2, 9, 25])):
            edited = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 12) + 1)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(edited)))
            words = edited if rng.random() < 0.3 else words
    rows += [(2000 + i, t) for i, t in enumerate(["", None, "One", "one", "a b", "A  B", "b a"])]
    got = {r["doc_id"]: tuple(r)[1:] for r in setsketch.components_of(frame(spark, rows), 2, 80).collect()}
    assert got == components_by_hand(rows, 2, 80) and len({c for _, c, _ in got.values()}) < len(got)


def test_open_members_meet_in_blocks():
    """Members of different components are compared in some pair of blocks, in the first band that they share."""
    rng = np.random.default_rng(8)
    a, b = _sets(rng, 300, 0.85)
    c = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x, y, z = setsketch.sketch_sets([a, b, c])
    first = int((setsketch.band_values(x[None]) == setsketch.band_values(y[None]))[0].argmax())
    short = lambda u: (u >> np.uint64(32)).astype(np.uint32).tobytes()
    rows = [{"doc_id": i, "n": 300, "c": c, "block": block, "band": first, "sketch": s.tobytes(), "tokens": short(u)} for i, c, block, s, u in [(1, 1, 0, x, a), (2, 2, 1, y, b), (3, 3, 1, z, c), (4, 1, 1, y, b)]]
    assert setsketch._counted(rows, 80) == setsketch._joining(rows, 80) == [(1, 2)]
    assert setsketch._hopeful(rows, 80) == [(1, 1), (2, 2)]
    assert setsketch._counted([r | {"band": first + 1} for r in rows], 80) == []
    one = [r | {"block": 0, "band": 0 if r["doc_id"] == 4 else first} for r in rows]
    assert setsketch._joining(one, 80) == [(2, 4)]  # which also joins 1, as it is with 4
    # what is likely by the sketches alone is counted out
    assert setsketch._counted([r | {"tokens": short(c)} if r["doc_id"] == 1 else r for r in rows], 80) == []


def test_few_sketches_travel(spark, monkeypatch):
    """Only sketches that a comparison reads are carried, and in the last round only where a likely pair first meets."""
    rng, dealt = random.Random(12), []
    common_part = [f"c{i}" for i in range(100)]
    near = [" ".join(common_part[:j] + [f"x{j}y"] + common_part[j + 1 :]) for j in range(2, 98, 2)]
    alone = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    docs = frame(spark, list(enumerate(near + alone)))
    plain = setsketch._dealt

    def counted(rows, carried):
        dealt.append((carried.columns, rows.count(), carried.select("doc_id").distinct().count()))
        return plain(rows, carried)

    monkeypatch.setattr(setsketch, "_dealt", counted)
    monkeypatch.setattr(setsketch, "_joining", lambda rows, percent: [])  # leaves more to the later rounds
    got = {r["doc_id"]: tuple(r)[1:] for r in setsketch.components_of(docs, 2, 80).collect()}
    assert got == components_by_hand(list(enumerate(near + alone)), 2, 80)
    assert len(dealt) == 3 and all(n <= len(near) for _, _, n in dealt)

    # a pair that shares several values brings its tokens to one of them
    a, b = _sets(np.random.default_rng(8), 300, 0.95)
    x, y = setsketch.sketch_sets([a, b])
    shared = np.flatnonzero(setsketch.band_values(x[None])[0] == setsketch.band_values(y[None])[0]).tolist()
    group = lambda band: [{"value": 100 + band, "doc_id": i, "n": 300, "c": i, "block": 0, "band": band, "sketch": s.tobytes()} for i, s in ((1, x), (2, y))]
    assert len(shared) > 1
    assert [p for band in shared for p in setsketch._meeting(group(band), 80)] == [(100 + shared[0], 1), (100 + shared[0], 2)]


def test_sketches_of_odd_rows(spark):
    odd = frame(spark, ODD)
    got = {r["doc_id"]: tuple(r)[1:] for r in setsketch.components_of(odd, 2, 80).collect()}
    assert got == components_by_hand(ODD, 2, 80)
    assert setsketch.components_of(odd.where("false")).count() == 0


def test_sketched_links_are_those_of_the_join(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, two = (f(docs, 5, 80).select("doc_id", "n_shingles", "component_id") for f in (setsketch.components_of, ngram_jaccard.components_of))
    assert sorted(one.collect()) == sorted(two.collect())
