"""Token ids and counts equal the library's on every letter, around punctuation, in random strings and over spliced chunks."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from evidra.llm import word_tokens
from evidra.llm.queries import vocabulary
from evidra.llm.token_counts import Chunk, count_long, splice
from evidra.llm.word_tokens import WordTokens

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
PUNCTUATION = ".,;:!?*#$%&'\"-<>|()"


def check(own, texts):
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, at = own.encode(pa.array(texts, pa.string()))
    if np.concatenate([np.array(x, np.int64) for x in want] + [np.zeros(0, np.int64)]).tolist() != ids.tolist():
        for t, w, i, j in zip(texts, want, at[:-1], at[1:], strict=True):
            assert ids[i:j].tolist() == w, (t, [hex(ord(c)) for c in t[:40]])
    assert own.count(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


@pytest.fixture(scope="module")
def own():
    made = WordTokens(WORDS)
    assert made.words
    return made


def test_every_letter_alone_joined_and_around_punctuation(own):
    letters = [c for c in map(chr, range(0x80, 0x30000)) if not 0xD800 <= ord(c) < 0xE000 and (c.isalpha() or not unicodedata.is_normalized("NFC", c) or c.lower() != c)]
    check(own, letters)
    check(own, [f"a{c}b {c}{c} {c}" for c in letters])
    some = [c for c in letters if ord(c) < 0x2000 or not unicodedata.is_normalized("NFC", c)]
    check(own, [" ".join(f"{p}{c}{p} A{c}{p} {c}9{p}x" for p in PUNCTUATION) for c in some])
    check(own, ["क़लम hello", "DERGİSİ. İ. ẋ."])


def test_random_strings(own):
    rng = random.Random(3)
    odd = [chr(rng.randrange(0x80, 0x3000)) for _ in range(400)] + list("İ̇́क़יִ  \u0085\x1c") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    usual = list("abcXYZ019 .,'!?#*&$%<>|\n\t") + ["'s", "'re", "don't", " the"]
    check(own, ["".join(rng.choice(odd if rng.random() < 0.3 else usual) for _ in range(rng.randrange(1, 30))) for _ in range(100_000)])


def test_nulls_ends_and_full_tables(own):
    ids, at = own.encode(pa.array([None, "", "a b", "a"]), end_id=2)
    one = own.tokenizer.encode("a b", add_special_tokens=False).ids
    assert ids.tolist() == [2, 2, *one, 2, one[0], 2] and at.tolist() == [0, 1, 2, 5, 7]
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []
    small = WordTokens(WORDS, most=3)
    check(small, ["one two three four five", "six seven one two", "one."])
    check(small, ["seven eight nine"])


def test_other_vocabularies_are_asked_for_whole_texts(own):
    other = WordTokens(BYTES)
    assert not other.words
    check(other, ["It's  a test <|endoftext|> x", "", "İ. café\n\n x"])
    spec = {"normalizer": {"type": "Sequence", "normalizers": word_tokens.NORMALISERS[:2]}, "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE"}, "added_tokens": []}
    assert not word_tokens.word_kind(spec) and not word_tokens.word_kind({})


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_spliced_counts(path):
    tokens = WordTokens(path)
    rng = random.Random(5)
    bits = ["the ", "don't ", "ab", "  ", "   \n", "é", "é", ".", "\n", "<|endoftext|>", "12", "\U0001f600", "İ.", " x", "....", "क़"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(100, 900))) for _ in range(60)]
    texts += ["word " * 400, "x" * 900 + " y " * 50, " " * 700 + "a" + " " * 300, "ab" * 900, "\U0001f600" * 300, "." * 500, "12" * 400]
    for t in texts:
        for chunk, overlap in ((64, 8), (40, 2), (200, 50)):
            assert count_long(t, tokens, chunk, overlap) == len(tokens.tokenizer.encode(t, add_special_tokens=False).ids), (chunk, t)


def test_overlaps_are_widened_where_chunks_do_not_agree():
    tokens = WordTokens(BYTES)
    text = "one alpha beta gamma " + "z" * 60 + " delta epsilon zeta"
    left = Chunk(tokens, text, 0, 75)
    narrow, wide = Chunk(tokens, text, 70, 95), Chunk(tokens, text, 3, 95)
    assert splice(left, narrow) is None
    a, b = splice(left, wide)
    assert left.begin[a] == wide.begin[b] == text.index(" beta")
    assert splice(left, wide, a + 1) is None
    # tokens of a run that was cut differ from the whole run's, and are never taken for agreement
    assert count_long(text, tokens, 30, 4) == len(tokens.tokenizer.encode(text, add_special_tokens=False).ids)
