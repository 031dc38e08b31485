"""The training-data operators against brute force, the libraries, round trips and held-out labels."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.llm import bloom, jaccard_join, lm_score, mixing, quality_classifier, quality_rules, rans, sentence_pieces, token_counts, token_files, url_filter
from evidra.llm.common import table
from evidra.llm.components import connected_components
from evidra.llm.embed_dedup import near_vectors
from evidra.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, vocabulary
from evidra.llm.word_tokens import WordTokens

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE, PIECES = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string, key string, size string, row string"


def docs(spark, texts, **columns):
    """Documents with further columns whose names operators use themselves."""
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), "k", "z", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def groups(n, links):
    root = list(range(n))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 40), (31, 30), (50, None)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {(i, 0) for i in range(1, 21)} | {(31, 30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=8).tolist() for _ in range(40)]
    x += [(np.array(x[i % 6]) + rng.normal(size=8) * 0.15).tolist() for i in range(80)] + [x[0]] * 30
    rows = [(i, v, "z") for i, v in enumerate(x)] + [(900, None, "z"), (901, [0.0] * 8, "z"), (902, [float("nan")] * 8, "z"), (903, [1.0, None] + [1.0] * 6, "z"), (904, [1.0, 2.0], "z"), (905, [2.0, 4.0], "z"), (None, x[1], "z"), (5, x[5], "z")]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string"), block=64, leaf=60)
    good = [(i, v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in good]
    links = [(a, b) for a, b in itertools.combinations(range(len(good)), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    n = np.bincount(np.array(links).ravel(), minlength=len(good))
    root = groups(len(good), links)
    least = {r: min(good[i][0] for i in range(len(good)) if root[i] == r) for r in set(root)}
    want = sorted((i, int(n[k]), least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(good))
    rest = {900, 901, 902, 903, None}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r for r in rows if r[0] not in rest) == want
    assert {r for r in rows if r[0] in rest} == {(i, 0, i, True) for i in rest - {None}} | {(None, 0, None, False)}
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hot_group_keeps_its_links(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit(rng.normal(size=(1, 64))) + unit(rng.normal(size=(2400, 64))) * math.sqrt(1 / 0.905 - 1)
    x = unit(np.concatenate([near, rng.normal(size=(5600, 64))]))
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = sum(r["n_links"] for r in near_vectors(frame).collect())
    assert 0.995 <= got / ((x @ x.T >= 0.9).sum() - 8000) <= 1


def best_pieces(p, text):
    score = {p.bytes_of[i].replace(b" ", b"\xe2\x96\x81").decode(): (s, i) for i, s in zip(p.ids.tolist(), p.scores.tolist())}
    t = sentence_pieces.normalise(text)
    best = [(0, [])] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for b in range(max(0, e - 16), e):
            w = t[b:e]
            if best[b] is None or (w not in score and e - b > 1):
                continue
            s, ids = (score[w][0], [score[w][1]]) if w in score else (p.unknown, [int(p.byte_ids[x]) for x in w.encode()])
            if best[e] is None or best[b][0] + s > best[e][0]:
                best[e] = (best[b][0] + s, best[b][1] + ids)
    return best[-1]


def test_pieces_against_plain_search(spark):
    p = sentence_pieces.load_pieces(PIECES)
    rng = random.Random(1)
    texts = ["", " ", "\n\n", None, "x" * 5000, "▁▁ a"] + ["".join(rng.choice(["a", "b", "the", "en", " ", "  ", "\n", "é", "日", "😀", "\t", "xyzzy", "ing", "\x00", "ﬁ"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    got = sentence_pieces.encode_documents(docs(spark, texts), PIECES, ids=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = best_pieces(p, t or "")
        assert (r["ids"], r["score"]) == (want[1], want[0]) and r["round_trip"] and r["n_tokens"] == len(want[1])
        assert r["decoded"] == (t or "").replace("▁", " ")
    frame = spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got], "doc_id long, ids array<int>")
    assert [r["text"] for r in sentence_pieces.decode_documents(frame, PIECES).orderBy("doc_id").collect()] == [(t or "").replace("▁", " ") for t in texts]


def test_ids_are_the_library_s_for_the_written_model(spark, tmp_path):
    """The library reads the unigram model and gives the same ids for whole texts, odd and very long units too."""
    import sentencepiece

    sentence_pieces.write_model(PIECES, f"{tmp_path}/unigram.model")
    library = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/unigram.model")
    p = sentence_pieces.load_pieces(f"{tmp_path}/unigram.model")
    given = sentence_pieces.load_pieces(PIECES)
    assert (p.scores == given.scores).all() and (p.scores < 0).all() and np.exp(p.scores).sum() == pytest.approx(1, abs=0.01)
    rng = random.Random(2)
    texts = ["", " ", "a" * 3000, "日本語" * 2000, "x" * 70, "\n\n a", "😀" * 40 + "ab" * 50] + ["".join(rng.choice(["a", "the", "en", " ", "  ", "\n", "é", "日", "😀", "\t", "ing", "ﬁ", "क"]) for _ in range(rng.randrange(300))) for _ in range(200)]
    texts += [r["text"] or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = [np.frombuffer(x, "<u4").tolist() for x, _ in sentence_pieces.encode_texts(given, texts)]
    assert got == library.encode(texts, num_threads=1)


def test_long_units_as_short_ones(monkeypatch):
    p = sentence_pieces.load_pieces(PIECES)
    rng = random.Random(3)
    units = ["".join(rng.choice(["a", "b", "the", "日", "é", "😀", "ing"]) for _ in range(rng.randrange(1, 18))).encode()[:64].decode("utf-8", "ignore").encode() for _ in range(300)]
    monkeypatch.setattr(sentence_pieces, "_LOOK", 7)
    assert [sentence_pieces._search_long(p, u) for u in units] == sentence_pieces.viterbi(p, units)


def test_double_array_holds_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zz"]
    trie = sentence_pieces.DoubleArray(keys)

    def find(key):
        s = 0
        for c in key:
            t = trie.base[s] + c
            if trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert [find(k) for k in keys] == list(range(len(keys))) and find(b"z") == find(b"abd") == find(b"c") == -1


def base_counts(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = {r: runs.count(r) for r in set(runs)}
    again = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_rule_counts_against_plain_python(spark):
    texts = [None, "", " \n", "a b c d e a b c d e", "x\x0by\xa0z é", "l\nl\n\nl x", "a " * 300, "w" * 500 + " b"] + [r["text"] for r in table(spark, SF, "documents").limit(60).collect()]
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge_quality(docs(spark, texts), empty).orderBy("doc_id").collect()
    assert [tuple(r)[1:7] for r in got] == [base_counts(t or "") for t in texts]
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.judge_quality(docs(spark, []), empty).count() == 0


def test_binomial_bound_and_correction():
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.2), (40, 40, 0.5)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    steps = quality_rules.STEPS

    def at(**where):
        h = np.zeros(steps + 1)
        for s, n in where.items():
            h[int(s[1:])] = n
        return h

    clear = {("en", 0, h, 1): at(s0=4000) for h in (0, 1)} | {("en", 0, h, 0): at(s50=300) for h in (0, 1)}
    assert quality_rules.choose_cutoffs(clear, 0.03, 0.05) == {("en", 0): 49}
    few = {("en", 0, h, 1): at(s0=40) for h in (0, 1)} | {("en", 0, h, 0): at(s50=30) for h in (0, 1)}
    assert quality_rules.choose_cutoffs(few, 0.03, 0.05) == {}  # too little evidence: nothing is rejected
    mixed = {("en", 0, 0, 1): at(s0=4000), ("en", 0, 0, 0): at(s50=300), ("en", 0, 1, 1): at(s0=3900, s60=100), ("en", 0, 1, 0): at(s50=300)}
    assert quality_rules.choose_cutoffs(mixed, 0.03, 0.05) == {}  # the held-out part contradicts


def test_rules_hold_their_risk_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = quality_rules.judge_quality(table(spark, sf, "documents"), table(spark, sf, "labels")).where("not base_failed").join(table(spark, sf, "labels"), "doc_id")
    for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect():
        assert r["kept"] > 0.97 if r["quality"] == 1 else r["kept"] < 0.7


def test_range_coder_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 63, 64, 1000, 70_001):
        ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.uint32)
        tab = rans.Table(np.bincount(ids, minlength=10))
        data = rans.encode(ids, tab, block=20_000)
        assert (rans.decode(data, tab) == ids).all()
    at = rans.block_size(data, 0)  # the second block decodes by itself
    assert (rans.decode_block(data, at, tab) == ids[20_000:40_000]).all()
    broken = bytearray(data)
    broken[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(bytes(broken), tab)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


ODD = [None, "", "it's Don't x<|endoftext|>y <|ENDOFTEXT|> foo). İstanbul. ΣΑΣ. é. e\u0301, <|startoftext|> a,b 12.5% #tag#", "\xa0a\u2003b", "a  \n\n b\x0bc", "q" * 3000]


def test_word_tokens_as_the_library(library, spark):
    texts = [t or "" for t in ODD] + [r["text"] for r in table(spark, SF, "documents").collect()]
    ids, at = WordTokens(BPE).encode(pa.array(texts))
    for t, i, j, e in zip(texts, at[:-1], at[1:], library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[i:j].tolist() == e.ids, t


def test_token_files_from_what_was_written(library, spark, tmp_path):
    rows = docs(spark, ODD).unionByName(docs(spark, ["again"])).unionByName(docs(spark, ["none"]).withColumn("doc_id", F.lit(None).cast("long")))
    token_files.write_token_files(rows, f"file://{tmp_path}/t", BPE, 2, frame_ids=50)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").collect()
    ordered = sorted([(-1, "none"), *enumerate(ODD), (0, "again")], key=lambda x: x[0])
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ordered]
    want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 0, 0, 1, 2, 3, 4, 5]
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    token_files.write_token_files(docs(spark, []), f"file://{tmp_path}/e", BPE, 2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_counts_of_long_texts_are_spliced(library, spark):
    rng = random.Random(4)
    texts = [*ODD, "word " * 400, "x" * 900 + " y " * 50, "".join(rng.choice(["the ", "don't ", "ab", "  ", "é", ".", "\n", "<|endoftext|>", "12"]) for _ in range(900))]
    got = token_counts.count_tokens(docs(spark, texts), BPE, 20, chunk=64, overlap=8).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 20), t


def test_base_scores_and_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    frame = table(spark, sf, "documents").limit(300).unionByName(docs(spark, [None, "", "zzz qqq"]).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    rows = frame.collect()
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm_score.score_texts(spark.createDataFrame(rows, frame.schema)).collect()}
    tokens = [[*WORD.findall((r["text"] or "").translate(FOLD)), None] for r in rows]
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    count = {}
    for t, h in zip(tokens, held, strict=True):
        for w in t if not h else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    better = 0.0
    for r, t, h in zip(rows, tokens, held, strict=True):
        g = got[r["doc_id"], len(t)]
        assert (g["held_out"], g["n_known"], g["train_tokens"]) == (h, sum(w in count for w in t), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert g["score"] < 0
        better += h * (g["score"] - g["base_score"])
    assert better > 0


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(3)
    keys, n = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64)), rng.integers(1, 300, 3000)
    q = lm_score.level(n)
    bits = lm_score.fill_chunk(keys, n)
    found = lm_score.probe_levels(keys, len(bits), lambda at, _: bits[at])
    assert (found >= q).all() and (found == q).mean() > 0.9
    assert (lm_score.probe_levels(rng.integers(0, 1 << 63, 3000, dtype=np.uint64), len(bits), lambda at, _: bits[at]) > 0).mean() < 0.1
    assert lm_score.level(np.array([0, 1, 2, 3, 4, 5, 6])).tolist() == [0, 1, 2, 3, 4, 4, 5]


def test_model_scores_against_exact_counts(spark):
    """The same formula on exact counts: quantised ones differ by at most a step of the scale, false hits are rare, and what follows a word sums to about one."""
    sf = "/root/testdata/sf0.01"
    frame = table(spark, sf, "documents").limit(250).select("doc_id", "text")
    rows = frame.collect()
    tokens = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(FOLD)), None] for r in rows}
    learnt = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    one, two = Counter(itertools.chain.from_iterable(learnt)), Counter(x for t in learnt for x in zip([None, *t], t))  # noqa: B905
    n, v = one.total(), len(one)
    p_word = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p = lambda h, w: 0.6 * (two[h, w] / one[h] if one[h] else 0) + 0.4 * p_word(w)
    got = {r["doc_id"]: r for r in lm_score.score_texts(spark.createDataFrame(rows, frame.schema)).collect()}
    assert len(got) == len(rows)
    step, off = math.log10(1.5) + 0.01, []
    for i, t in tokens.items():
        exact = sum(math.log10(p(h, w)) for h, w in zip([None, *t], t))  # noqa: B905
        assert abs(got[i]["score"] - exact) <= step * len(t)
        off.append(abs(got[i]["score"] - exact) / len(t))
    assert np.mean(off) < 0.08
    value = lm_score.value_of_level()
    quantised = lambda c: value[lm_score.level(np.array([c]))[0]]
    sums = [sum(min(1, quantised(c) / quantised(one[h])) for c in by.values()) for h in (None, *list(one)[1:200]) if (by := {w: c for (x, w), c in two.items() if x == h})]
    assert 0.9 < np.mean(sums) < 1.1 and max(sums) < 1.6


def test_scores_in_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lm_score.score_texts(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm_score.score_texts(spark.createDataFrame([(held, "a b")], schema)).first()  # nothing to learn from
    assert got["held_out"] and (got["n_tokens"], got["n_known"], got["train_tokens"]) == (3, 0, 0)
    assert got["base_score"] == pytest.approx(3 * math.log10(0.1 / 0.1)) and got["score"] == pytest.approx(3 * math.log10(0.4))
    got = lm_score.score_texts(docs(spark, ["x y", None]).unionByName(docs(spark, ["x y"])).withColumn("doc_id", F.when(F.col("text").isNull(), None).otherwise(1 + 0 * F.col("doc_id")))).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 3), ("1", 3), ("None", 1)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_pairs_seen_once_count_and_large_filters_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(8)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:200]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    texts = {i: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 40) for _ in range(60)) for i in ids}
    texts |= {held[0]: texts[ids[0]], held[1]: " ".join(rng.sample(texts[ids[0]].split(), 60))}
    frame = spark.createDataFrame([*texts.items(), (None, None), (ids[0], "")], "doc_id long, text string")
    pick = lambda got: sorted(tuple(map(str, r)) for r in got.collect())
    want = lm_score.score_texts(frame)
    score = {r["doc_id"]: r["score"] for r in want.collect() if r["n_tokens"] == 61}
    assert score[held[0]] > score[held[1]] + 3  # pairs of a text learnt once against the same words in another order
    assert pick(lm_score.score_texts(frame, most_bits=1)) == pick(want)
    monkeypatch.setattr(lm_score, "SLICE", 500)  # many slices, more chunks than the least
    monkeypatch.setattr(lm_score, "CHUNK", 50)
    assert [r[:6] for r in pick(lm_score.score_texts(frame, most_bits=1))] == [r[:6] for r in pick(want)]


def test_filter_holds_every_ngram():
    rng = np.random.default_rng(5)
    keys, n = np.unique(rng.integers(0, 1 << 64, 3000, np.uint64)), rng.integers(1, 40, 3000)
    n = n[: len(keys)]
    for chunks in (2, 16):
        of = lm_score.chunk_of(keys, chunks)
        assert (np.diff(of) >= 0).all() and set(of) == set(range(chunks))
        bits = [lm_score.fill_chunk(keys[of == c], n[of == c]) for c in range(chunks)]
        every = lm_score.Filter(np.concatenate([np.packbits(x, bitorder="little") for x in bits]), np.cumsum([0, *map(len, bits)]))
        found = every.levels(keys)
        assert (found >= lm_score.level(n)).all() and (found == lm_score.level(n)).mean() > 0.95
        alone = np.concatenate([lm_score.probe_levels(keys[of == c], len(x), lambda at, _, x=x: x[at]) for c, x in enumerate(bits)])
        assert (found == alone).all()  # the broadcast filter says what each chunk says by itself
        assert (every.levels(rng.integers(0, 1 << 64, 3000, np.uint64)) > 0).mean() < 0.05


def shingles(t):
    w = WORD.findall((t or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_filter_comes_to_the_driver_in_chunks(spark, monkeypatch):
    """The driver gets a row for each chunk of a filter and not for each word; all places of all keys are set and no others."""
    frame, got = type(spark.range(0)), []
    monkeypatch.setattr(frame, "toPandas", lambda df: pytest.fail("rows of a filter came to the driver one by one"))
    monkeypatch.setattr(frame, "toArrow", lambda df, kept=frame.toArrow: got.append(kept(df)) or got[-1])
    monkeypatch.setattr(bloom, "HELD", 5_000, raising=False)
    for n in (0, 1, 60_000):
        own = bloom.build(spark.range(n).select(F.xxhash64("id").alias("s")), n)
        keys = spark.range(n).select(F.xxhash64("id").alias("s")).collect()
        want = np.zeros(len(own.words), np.uint64)
        for at in bloom.positions(np.array([r["s"] for r in keys], np.int64), len(own.words), own.probes):
            np.bitwise_or.at(want, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        assert (own.words == want).all() and own.words.any() == (n > 0)
    assert max(t.num_rows for t in got) == 2  # 11,251 words


def test_jaccard_join_against_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    make = lambda n: [word() for _ in range(n)]
    common, texts = make(30), [None, "", "one", "ONE", "one two", " \n", "One  two"]
    for size in (1, 2, 6, 70):  # groups of near copies, one above the size that is compared outright
        base = make(60)
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join(common + make(rng.randrange(5, 60))) for _ in range(60)]  # a passage that many share
    texts += [texts[10]] * 30 + [" ".join(make(4000))]
    frame = docs(spark, texts).unionByName(docs(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_documents(frame).collect()}
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = groups(len(texts), links)
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))} | {None: (1, None)}
    assert jaccard_join.near_documents(docs(spark, [])).count() == 0


def test_large_group_whose_copies_are_mostly_not_linked_with_its_pivot(spark):
    """Copies of one text with a few or many edits, some of them copies of copies: linked pairs lie among thousands that aren't."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    base = [word() for _ in range(120)]

    def edited(t, most):
        t = list(t)
        for _ in range(rng.randrange(1, most)):
            at = rng.randrange(len(t))
            if rng.random() < 0.3:
                del t[at : at + rng.randrange(1, 12)]
            else:
                t[at] = word()
        return t

    far = [edited(base, 14) for _ in range(1500)]
    texts = far + [edited(rng.choice(far), 3) for _ in range(1500)] + [edited(far[0], 8) for _ in range(400)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_documents(docs(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    shared = {x: i for i, x in enumerate(x for x, n in Counter(itertools.chain.from_iterable(sets)).items() if n > 1)}
    has = np.zeros((len(texts), len(shared)), np.float32)
    for i, own in enumerate(sets):
        has[i, [shared[x] for x in own if x in shared]] = 1
    both, size = has @ has.T, np.array([len(x) for x in sets])
    linked = np.triu(100 * both >= 75 * (size[:, None] + size - both), 1)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in np.argwhere(linked).tolist():
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {i: find(i) for i in range(len(texts))}
    assert len(set(want.values())) > 100 and linked.sum() > 1000
    assert got == want


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.random()], rng.integers(0, 1 << 62, int(rng.integers(0, 80)), dtype=np.uint64)]))
        apart = sum((p ^ q) .bit_count() if (p ^ q) >= 0 else ((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(jaccard_join.sketch(x), jaccard_join.sketch(y), strict=True))
        assert apart <= len(np.setxor1d(x, y))


def test_bucket_counts_never_rule_out_a_link():
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    s = jaccard_join.Sets(pa.array(texts))
    own = [set(s.values[a:b].tolist()) for a, b in zip(s.at[:-1], s.at[1:])]
    for i, j in itertools.combinations(range(30), 2):
        assert jaccard_join.may_link(s.buckets(i), s.buckets(j), len(own[i]), len(own[j])) <= 1 - len(own[i] & own[j]) / len(own[i] | own[j]) + 1e-12


def test_targets_are_filled_again_below_the_limit():
    got = mixing.fill_targets({0: 10, 1: 100, 2: 100}, {0: 3, 1: 1, 2: 2}, 1.5, 2.0)
    assert got[0] == 20 and got[1] == pytest.approx(295 / 3) and got[2] == pytest.approx(590 / 3) and sum(got.values()) == pytest.approx(315)
    assert mixing.fill_targets({0: 0, 1: 10}, {0: 3, 1: 1}, 1.5, 2.0) == {0: 0, 1: 15}


def test_mixture_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 30))), "en", [None, "b", "a", "B"][i % 4], i % 7) for i in range(400)] + [(400, None, "en", "a", 1), (3, "x y", "en", "a", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, target long")
    got = mixing.mix_sources(frame, rows_per_range=20).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert len(got) == len(rows)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5 and sum(r["size"] for r in own) == own[0]["source_size"]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(frame.repartition(7), rows_per_range=20).collect()), key=str)
    out = mixing.mixed_documents(frame)
    assert out.schema == frame.schema
    assert out.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = quality_classifier.classify(table(spark, sf, "documents"), labels).where("held_out").join(labels, "doc_id")
    for r in got.groupBy("quality").agg(F.avg("predicted").alias("p")).collect():
        assert r["p"] > 0.97 if r["quality"] == 1 else r["p"] < 0.15


def test_classifier_without_labels_and_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.classify(docs(spark, [None, "", "a b"]), none).collect()} == {0.5}
    labels = table(spark, SF, "labels")
    got = quality_classifier.classify(table(spark, SF, "documents").select("doc_id", "text").unionAll(docs(spark, [None, ""]).select("doc_id", "text")), labels).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(docs(spark, []), labels).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x", "http://xexample.net/en/", "http://example.com/de", "http://example.com/de/", "https://q.org/fr/?a", "https://org/fr/", "x://net", "x://net/", "x://a.net?b/", "x://b.org#/fr/", "y://example.net/en/a/b/c", "://net/", "a://b://net/", "http://example.net/EN/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("keys", F.lit("k"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(frame, URL_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = re.match("([^/?#]*)([^?#]*)", rest).groups()
        host = host.translate(FOLD)
        fits = [(len(k), k, v) for k, v in URL_RULES if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        rule, verdict = max(fits)[1:] if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict), u
    assert url_filter.filter_urls(frame.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError, match="not a rule"):
        url_filter.filter_urls(frame, [("net", "block")])


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(4000).select(*(h.alias(f"h{i}") for i, h in enumerate(url_filter.hashes(F.col("id").cast("string")), 1)))
    listed = spark.range(0, 4000, 9).select(*(h.alias(f"h{i}") for i, h in enumerate(url_filter.hashes(F.col("id").cast("string")), 1)))
    levels = url_filter.build_cascade(listed, keys)
    rows = spark.range(4000).select("id", *(h.alias(f"h{i}") for i, h in enumerate(url_filter.hashes(F.col("id").cast("string")), 1))).toPandas()
    got = url_filter.member(levels, rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64))
    assert len(levels) > 1 and (got == (rows["id"].to_numpy() % 9 == 0)).all()
    with pytest.raises(ValueError, match="max_bits"):
        url_filter.build_cascade(listed, keys, max_bits=64)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)[0]
    assert got.sort_values(key).astype(object).where(got.notna(), None).values.tolist() == want.sort_values(key).astype(object).where(want.notna(), None).values.tolist()
