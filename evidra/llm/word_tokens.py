"""Token ids of whole texts by the tokenizers library.

A vocabulary of the known word kind (see ``word_kind``) drops white space and never joins what stands on both sides of it, so the ids
of a text are those of its words (runs of anything but ASCII white space) in order, and the library is asked once for each distinct word; each worker keeps
a bounded table. Any other vocabulary is asked for whole texts.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The normaliser and the pattern of runs for which words are independent.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Punctuation that may end a word: after a letter or digit it is always a run of its own. None of it closes a special token.
_TAIL = ".,;:!?*#$%&"
#: Letters above ASCII are looked at up to here; words with others go to the library whole.
_LETTERS = 0x590


def word_kind(spec: dict) -> bool:
    """If a vocabulary (its JSON) has the normaliser and runs for which words are independent, marks the ends of runs, and has plain special tokens."""
    normaliser, pre, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    parts = pre.get("pretokenizers") or [{}, {}]
    added = spec.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["special"] and t["content"].startswith("<") and t["content"].endswith(">") and not any(c.isspace() for c in t["content"]) for t in added)
    return (
        normaliser.get("normalizers") == NORMALISERS
        and len(parts) == 2
        and parts[0] == {"type": "Split", "pattern": {"Regex": RUNS}, "behavior": "Removed", "invert": True}
        and parts[1].get("type") == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
        and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
        and bool(added) and plain
    )


class WordTokens:
    """Encodes string columns; ``words`` says if words are asked one by one. ``table[word]``: little-endian unsigned 32-bit ids of a word."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.words = word_kind(json.load(f))
        self.most = most
        self.table: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        if self.words:
            self.between, self.special = min((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
            suffix = self.tokenizer.model.end_of_word_suffix
            #: If each id's token ends a run.
            self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            ascii_letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
            #: Letters that the library keeps as letters of one run.
            self.letters = frozenset(ascii_letters) | {c for c in map(chr, range(0x80, _LETTERS)) if self._one_run(c)}
            self.stem_ends = self.letters | frozenset("0123456789")

    def _one_run(self, c: str) -> bool:
        now = self.tokenizer.normalizer.normalize_str(c)
        return c.isalpha() and len(now) == 1 and now.isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{now}b")) == 1

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts (null: empty), each with the end id if there is one, and the offsets of the texts in them."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.fill_null("")
        if not self.words:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            if end_id is not None:
                got = [np.append(x, np.uint32(end_id)) for x in got]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)
        which, first, raw, size = self._words(column)
        if end_id is not None:  # the end is one more word
            which = np.insert(which, first[1:], len(raw))
            first = first + np.arange(len(first))
            raw, size = [*raw, np.array([end_id], "<u4").tobytes()], np.append(size, 1)
        flat = np.frombuffer(b"".join(raw), "<u4")
        n = size[which]
        to = np.cumsum(n)
        begin = (np.cumsum(size) - size)[which]
        ids = flat[np.repeat(begin - (to - n), n) + np.arange(int(n.sum()))]
        return ids, np.concatenate(([0], to))[first]

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text (null: none)."""
        if not self.words:
            return np.diff(self.encode(column)[1])
        which, first, _, size = self._words(column.fill_null(""))
        return np.diff(np.concatenate(([0], np.cumsum(size[which])))[first])

    def _words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """The words of a column as numbers of distinct words, the first word of each text, and ids and number of ids of each distinct word."""
        split = pc.ascii_split_whitespace(column)
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        raw = list(map(self.table.__getitem__, distinct))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        return coded.indices.to_numpy().astype(np.int64), first - first[0], raw, size

    def learn(self, words: list[str]) -> None:
        """Makes sure that ``table`` has each of the distinct words; tables are emptied first where they would grow too large."""
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > self.most:
            self.table.clear()
            new = words
        split = list(map(self._split, new))
        wanted = set(itertools.chain.from_iterable(split))
        missing = list(wanted.difference(self.parts))
        if len(self.parts) + len(missing) > self.most:
            self.parts.clear()
            missing = list(wanted)
        self._encode(missing)
        parts = self.parts
        self.table.update((w, parts[a] + parts[b]) for w, (a, b) in zip(new, split, strict=True))

    def _split(self, word: str) -> tuple[str, str]:
        """A word as what ends in a verified letter or digit (in lower case where that can't matter) and a tail of punctuation: two runs or more that never join."""
        stem = word.rstrip(_TAIL)
        if not stem or stem[-1] not in self.stem_ends:
            return word, ""
        return (stem.lower() if stem.isascii() and "<" not in stem else stem), word[len(stem) :]

    def _encode(self, parts: list[str]) -> None:
        """Many parts in one call. Parts of verified letters alone are one run each, so they stand in one text and a run's last token, known by
        its word end, closes each; others stand between special tokens, at which the library cuts its text before anything else."""
        letters = [x for x in parts if x and self.letters.issuperset(x)]
        known = set(letters)
        others = [x for x in parts if x not in known and self.special not in x]
        for own, between in ((letters, " "), (others, self.special)):
            for at in range(0, len(own), 2000):
                some = own[at : at + 2000]
                ids = np.array(self._ids([between.join(some)])[0], "<u4")
                if between == " ":
                    end = np.flatnonzero(self.closing[ids]) + 1
                    begin = np.concatenate(([0], end[:-1]))
                else:
                    cut = np.flatnonzero(ids == self.between)
                    begin, end = np.concatenate(([0], cut + 1)), np.append(cut, len(ids))
                if len(end) != len(some) or (between == " " and end[-1] != len(ids)):
                    raise RuntimeError("the vocabulary doesn't close its runs as its settings say")
                raw = ids.tobytes()
                self.parts.update((x, raw[i:j]) for x, i, j in zip(some, (4 * begin).tolist(), (4 * end).tolist(), strict=True))
        rest = list(set(parts) - known - set(others))
        self.parts.update((x, np.array(ids, "<u4").tobytes()) for x, ids in zip(rest, self._ids(rest), strict=True))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_KEPT: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own tables, kept between tasks."""
    if path not in _KEPT:
        _KEPT[path] = WordTokens(path)
    return _KEPT[path]
