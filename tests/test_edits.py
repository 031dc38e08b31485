"""Near duplicates of whole texts against longest common subsequences of all pairs."""

import difflib
import random

import numpy as np
import pytest

from evidra.operators import edits
from evidra.plans import vectors


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bits of one number a column (Hyyrö 2004)."""
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def changed(rng, text, edits_, spread=False):
    out = list(text)
    places = [int((i + 0.5) * len(out) / edits_) for i in range(edits_)] if spread else sorted(rng.sample(range(len(out)), min(edits_, len(out))))
    for at in reversed(places):
        kind = rng.randrange(3)
        if kind == 0:
            del out[at]
        elif kind == 1:
            out.insert(at, rng.choice("abcdexyz "))
        else:
            out[at] = rng.choice("qjkv")
    return "".join(out)


def written(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(n))


def test_distance_is_that_of_the_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randrange(0, 60)))
        b = changed(rng, a, rng.randrange(0, 9)) if a and rng.random() < 0.7 else "".join(rng.choices("abc", k=rng.randrange(0, 60)))
        true = len(a) + len(b) - 2 * common(a, b)
        for most in (0, 3, 12, 120):
            assert edits.edit_distance(a, b, most) == (true if true <= most else -1)


def test_equal_windows_have_equal_fingerprints():
    rng = random.Random(4)
    inner = written(rng, 12)[:50]
    a, b = edits.fingerprints("x" * 70 + inner + "y" * 80, 50, 16), edits.fingerprints("7" * 41 + inner, 50, 16)
    assert set(a[0]) & set(b[0])
    assert a[1].sum() == 70 + 50 + 80 - 49
    assert len(edits.fingerprints("x" * 49, 50, 16)[0]) == 0
    short = edits.fingerprints(inner, 50, 16)
    assert len(short[0]) == 1 and np.isin(short[0], b[0]).all()


@pytest.fixture(scope="module")
def texts():
    """Families around whole texts of up to 9,000 characters, most edits near the bound, all with a passage in common; short, empty and null ones, and texts that differ a lot."""
    rng = random.Random(11)
    passage = written(rng, 60)
    rows = []
    for family in range(14):
        size = [30, 33, 36, 120, 300, 700, 1500][family % 7]
        base = written(rng, size) if family % 3 else written(rng, size // 2 + 1) + " " + passage + " " + written(rng, size // 2 + 1)
        rows.append(base)
        for step in range(5):
            edits_ = max(1, round(len(base) * rng.choice([0.002, 0.005, 0.0075, 0.01, 0.012])))
            rows.append(changed(rng, base, edits_, spread=step % 2 == 0))
        rows.append(base)
    rows += [passage, passage[:90], passage[:90], passage[:89], "", "", None, "x" * 400, "x" * 401, "x" * 404, "x" * 430, "ü€𝄞" * 90, "ü€𝄞" * 90 + "z", "a", "a"]
    return [(i, t, [None, "p", "q"][i % 3]) for i, t in enumerate(rows)]


@pytest.mark.parametrize("ratio", [0.995, 0.98])
def test_links_are_those_of_all_pairs(spark, texts, ratio):
    frame = spark.createDataFrame(texts, "k long, body string, family string")
    got = {r["k"]: (r["class_id"], r["n_equal"], r["n_near"], r["best"] and round(r["best"], 9)) for r in edits.near_text_links(frame, "k", "body", "family", ratio).collect()}
    full = [(i, t, g) for i, t, g in texts if t]
    want, near = {}, 0
    for i, t, g in full:
        equal, close, best = 0, 0, None
        for _, u, h in full:
            if g == h or abs(len(t) - len(u)) > (1 - ratio) * (len(t) + len(u)) + 1e-9:
                continue
            d = len(t) + len(u) - 2 * common(t, u)
            if d <= int((1 - ratio) * (len(t) + len(u)) + 1e-9):
                equal, close, best = equal + (t == u), close + (t != u), max(best or 0, round(1 - d / (len(t) + len(u)), 9))
        want[i] = (min(j for j, u, _ in full if u == t), equal, close, best)
        near += close
    assert near > 40
    assert got == want


def test_what_a_block_matcher_finds_is_found(spark, texts):
    pairs = edits.near_text_pairs(edits.text_classes(spark.createDataFrame(texts, "k long, body string, family string"), "k", "body", "family")[1])
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    first = {}
    for i, t, _ in texts[:49]:
        if t and len(t) < 2500:
            first.setdefault(t, i)
    close = {(i, j) for t, i in first.items() for u, j in first.items() if i < j and difflib.SequenceMatcher(None, t, u, autojunk=False).quick_ratio() >= 0.995 and difflib.SequenceMatcher(None, t, u, autojunk=False).ratio() >= 0.995}
    assert close and close <= found


def test_ratio_out_of_range_is_refused(spark, texts):
    with pytest.raises(ValueError):
        edits.near_text_pairs(spark.createDataFrame([(1, "a")], "class_id long, t string"), 0.9)


def test_empty_table(spark):
    assert edits.near_text_links(spark.createDataFrame([], "k long, body string, family string"), "k", "body", "family").count() == 0


def test_query_over_whole_documents(spark, tmp_path):
    rng = random.Random(5)
    base = written(rng, 900)
    rows = [(1, base, "web"), (2, base.upper() + "!", "books"), (3, changed(rng, base, 8), "web"), (4, changed(rng, base, 200), "books"), (5, written(rng, 900), "books"), (6, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["n_equal"], r["n_near"]) for r in vectors.QUERIES["c16_near_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 1), 3: (3, 0, 1), 4: (4, 0, 0), 5: (5, 0, 0)}


def test_like_texts_go_to_regions_and_not_to_pairs(spark, monkeypatch):
    """Texts that share rare passages but aren't near are dealt by region: no table has a row for each pair, blocks of a region meet two by two, and a pair comes once."""
    seen = {}

    def note(df, name, kept=edits.settled):
        seen[name] = kept(df, name)
        return seen[name]

    monkeypatch.setattr(edits, "settled", note)
    monkeypatch.setattr(edits, "_BLOCK", 20_000, raising=False)
    rng = random.Random(8)
    base = written(rng, 220)
    texts = [changed(rng, base, 14) for _ in range(50)]
    texts += [changed(rng, t, 2) for t in texts[:12]]
    rows = [(i, t, "pq"[i % 2]) for i, t in enumerate(texts)]
    members, classes = edits.text_classes(spark.createDataFrame(rows, "k long, body string, family string"), "k", "body", "family")
    got = [(r["a"], r["b"], r["distance"]) for r in edits.near_text_pairs(classes).collect()]
    want = {}
    for i, t in enumerate(texts):
        for j in range(i + 1, len(texts)):
            d = len(t) + len(texts[j]) - 2 * common(t, texts[j])
            if d <= int(0.005 * (len(t) + len(texts[j])) + 1e-9):
                want[i, j] = d
    assert len(want) >= 12 and len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    assert max(df.count() for name, df in seen.items() if name not in ("prints", "often", "posts")) <= 10 * len(texts)
