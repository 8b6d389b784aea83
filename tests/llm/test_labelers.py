"""The label model on planted labelers, gazetteers as input, and redaction against plain patterns."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from geoloom.llm import pii


def planted(prior, right, silent, n=40_000, seed=1, copies=()):
    """Vote patterns of labelers of known reliability, and the candidates' classes."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    v = np.column_stack([np.where(rng.random(n) < s, 0, np.where((rng.random(n) < r) == y, 1, -1)) for r, s in zip(right, silent)])
    for a, b in copies:
        v[:, b] = v[:, a]
    counts = Counter(map(tuple, v.tolist()))
    return [{**dict(zip(pii.VOTERS, k)), "size": 1, "count": c} for k, c in counts.items()], v, y


@pytest.mark.parametrize("prior", [0.02, 0.3, 0.6])
@pytest.mark.parametrize("right", [(0.5, 0.7, 0.99, 0.8, 0.9), (0.99, 0.5, 0.7, 0.7, 0.95)])
def test_planted_reliabilities_are_recovered(prior, right):
    rows, _, _ = planted(prior, right, (0.0, 0.1, 0.0, 0.3, 0.2))
    kind = pii._learn_kind(rows)
    assert kind.prior == pytest.approx(prior, abs=0.05)
    assert list(kind.right.values()) == pytest.approx(right, abs=0.05)


def test_classifier_follows_the_label_model():
    rows, v, y = planted(0.3, (0.6, 0.7, 0.95, 0.8, 0.9), (0.1,) * 5)
    kind = pii._learn_kind(rows)
    z = kind.weights["bias"] + kind.weights["size", 1] + sum(np.select([v[:, j] == 1, v[:, j] == -1], [kind.weights[name, 1], kind.weights[name, -1]], 0.0) for j, name in enumerate(pii.VOTERS))
    assert ((z > 0) == (kind.posterior(v) > 0.5)).mean() > 0.97 and ((z > 0) == y).mean() > 0.93


def test_copied_labeler_has_no_second_say():
    once, _, _ = planted(0.3, (0.7, 0.5, 0.8, 0.75, 0.9), (0.1,) * 5)
    twice, _, _ = planted(0.3, (0.7, 0.7, 0.8, 0.75, 0.9), (0.1,) * 5, copies=[(0, 1)])
    a, b = pii._learn_kind(once), pii._learn_kind(twice)
    assert b.share.tolist() == [0.5, 0.5, 1, 1, 1] and b.prior == pytest.approx(a.prior, abs=0.03) and b.right["usual"] == pytest.approx(0.7, abs=0.05)


def test_one_sided_labelers_do_not_confirm_themselves():
    """Three labelers that vote both ways find the classes; one that only says yes, mostly wrongly, is found out."""
    rows, v, y = planted(0.1, (0.8, 0.85, 0.9, 0.5, 0.5), (0.0, 0.0, 0.0, 1.0, 1.0))
    rng = np.random.default_rng(2)
    v[:, 3] = rng.random(len(y)) < 0.7
    v[:, 4] = -1 * (rng.random(len(y)) < np.where(y, 0.02, 0.5))
    kind = pii._learn_kind([{**dict(zip(pii.VOTERS, k)), "size": 1, "count": c} for k, c in Counter(map(tuple, v.tolist())).items()])
    assert kind.prior == pytest.approx(0.1, abs=0.05) and kind.right["context"] == pytest.approx(0.1, abs=0.05) and kind.right["around"] > 0.95


def test_pseudo_counts_stand_in_where_votes_leave_the_classes_open():
    for rows in ([], [{**dict.fromkeys(pii.VOTERS, 1), "size": 1, "count": 100_000}], [{**dict.fromkeys(pii.VOTERS, 0), "usual": s, "size": 1, "count": 50_000} for s in (-1, 1)]):
        kind = pii._learn_kind(rows)
        assert kind.prior == pytest.approx(1 / 3) and list(kind.right.values()) == pytest.approx([0.8] * 4 + [0.9])


def test_evidence_keeps_and_drops_loose_candidates(spark):
    """A vote that pseudo-counts alone would follow is overruled where the corpus shows that it is no better than chance."""
    rng = random.Random(3)
    texts = []
    for i in range(3000):
        yours = i % 3 == 0
        area, exchange = (rng.randrange(212, 289), rng.randrange(210, 999)) if yours == (rng.random() < 0.97) else (rng.randrange(100, 199), 155)
        before = ("please call" if yours else "order no.") if rng.random() < 0.95 else ("order no." if yours else "please call")
        texts.append((i, f"{before} {f'({area}) {exchange}-0123' if yours == (rng.random() < 0.8) else f'{area}-{exchange}.0123'} and"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = pii.fit(df)
    kind = model.kinds["local"]
    assert kind.prior == pytest.approx(1 / 3, abs=0.05)
    assert [kind.right[k] for k in ("usual", "checks", "context")] == pytest.approx([0.8, 0.97, 0.95], abs=0.05)
    got = {r["doc_id"]: len(r["spans"]) for r in pii.detect(df, model).collect()}
    assert sum(bool(got[i]) == (i % 3 == 0) for i in got) > 0.98 * len(got)


def test_gazetteers_are_an_input(spark):
    lists = pii.Gazetteers.read(spark.createDataFrame([("names", "Zyx"), ("names", "Zyx-Ann"), ("names", None), ("titles", "Dame")], "list string, entry string"))
    assert lists.names == "Zyx\\-Ann|Zyx" and lists.titles == "Dame" and lists.places == pii.Gazetteers().places
    df = spark.createDataFrame([(1, "dear Zyx-Ann Miller and"), (2, "dear Mary Miller and"), (3, "name: Dame Zyx and")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.detect(df, pii.fit(df, lists=lists)).collect()}
    assert found == {1: [("name", 5, 19)], 2: [], 3: [("name", 6, 14)]}
    with pytest.raises(ValueError, match="gazetteers"):
        pii.Gazetteers.read(spark.createDataFrame([("nmaes", "x")], "list string, entry string"))


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2]) % 10 == 0 if len(d) == 1 else (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("CARD", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
]


def test_redaction_by_hand(spark):
    """Base spans of every kind, replaced one kind after the other, beside columns with helpers' names."""
    rng = random.Random(9)
    pool = ["a.b@c.de", "x@y", "q@w.e.", "10.0.0.1", "1.2.3.400", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1 (415) 555-0123", "+1 2", "4012888888881881", "word", "12", "-", ",", "é"]
    rows = [(i, rng.choice([" ", "", ", ", "\n"]).join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame([(i, t, "keep", [1], "also", 5) for i, t in rows], "doc_id long, text string, __may string, found array<int>, `text.b` string, __digits int")
    got = pii.redact(df, pii.fit(df))
    assert got.columns == df.columns
    for r, (_, t) in zip(got.orderBy("doc_id").collect(), rows):
        want = t
        for kind, pattern, holds in RULES if t else ():
            want = re.sub(pattern, lambda m, kind=kind, holds=holds: f"[{kind}]" if holds(m[0]) else m[0], want)
        assert tuple(r) == (r["doc_id"], want, "keep", [1], "also", 5), t
