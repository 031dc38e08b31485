"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of more than ``chunk`` code points is encoded in overlapping chunks, each whole, with the library's offsets. The library cuts text into runs from
left to right, looking ahead but never back, and encodes each run by itself. So where two neighbouring chunks both begin a run at one place, all that follows is the same in both, up to
where the left chunk's end may have changed its runs. Neighbours are spliced at such a place, if the tokens that follow agree too; where the
overlap has none, it is widened and the chunk encoded again, and if need be the left chunk is made longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.word_tokens import WordTokens, word_tokens
from evidra.llm.words import slices, text_bytes


class Chunk:
    """Tokens of a text's part [lo, hi): where each begins (code points of the text), and if it begins a run."""

    def __init__(self, tokens: WordTokens, text: str, lo: int, hi: int) -> None:
        got = tokens.tokenizer.encode(text[lo:hi], add_special_tokens=False)
        self.lo, self.hi, self.ids = lo, hi, np.array(got.ids, np.int64)
        self.begin = np.array([a for a, _ in got.offsets], np.int64).reshape(-1) + lo
        runs = np.array([-1 if r is None else r for r in got.word_ids], np.int64)
        # A special token belongs to no run and is one by itself; run numbers begin anew after it.
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (runs[1:] < 0)
        # A run begins where its first token begins, and no other token begins there (a character may have several).
        new[1:] &= self.begin[1:] > self.begin[:-1]
        self.run = new

    def sure(self) -> int:
        """Up to this token the chunk's end has no say, if it isn't the text's end: the last two runs may have been cut."""
        at = np.flatnonzero(self.run)
        return int(at[-2]) if len(at) > 1 else 0


def splice(left: Chunk, right: Chunk, start: int = 0, agree: int = 4) -> tuple[int, int] | None:
    """Numbers of the first tokens, left (``start`` or later) and right, from which both chunks go on alike: runs begin at one place in both, and ``agree`` tokens that are sure in the left chunk follow alike.

    The right chunk's first run may have lost its beginning, so it proves nothing.
    """
    end = left.sure()
    at = start + np.flatnonzero(left.run[start:end])
    at = at[left.begin[at] > right.lo]
    own = np.flatnonzero(right.run)[1:]
    _, i, j = np.intersect1d(left.begin[at], right.begin[own], return_indices=True)
    for a, b in zip(at[i].tolist(), own[j].tolist(), strict=True):
        n = min(agree, end - a)
        if n and all(np.array_equal(x[a : a + n], y[b : b + n]) for x, y in ((left.begin, right.begin), (left.run, right.run), (left.ids, right.ids))):
            return a, b
    return None


def count_long(text: str, tokens: WordTokens, chunk: int, overlap: int) -> int:
    """Number of tokens of a long text."""
    n, total, start = len(text), 0, 0
    left = Chunk(tokens, text, 0, min(n, chunk))
    while left.hi < n:
        wide, found, right = overlap, None, left
        while found is None:
            lo = max(left.lo, left.hi - wide)
            right = Chunk(tokens, text, lo, min(n, lo + max(chunk, 2 * wide)))
            found = splice(left, right, start)
            if lo == left.lo:
                break
            wide *= 2
        if found is None:  # no common place in the whole left chunk: a longer one from the same beginning
            left = Chunk(tokens, text, left.lo, min(n, left.lo + 2 * (left.hi - left.lo)))
            continue
        total += found[0] - start
        start, left = found[1], right
    return total + len(left.begin) - start


def counter(path: str, chunk: int, overlap: int) -> Callable[[pa.Array], np.ndarray]:
    """Token counts of a string column (null: empty)."""
    tokens = word_tokens(path)

    def count(column: pa.Array) -> np.ndarray:
        size = np.diff(text_bytes(column)[1])
        long = size > chunk
        out = np.zeros(len(column), np.int64)
        if not long.all():
            out[~long] = tokens.count(column.filter(pa.array(~long)))
        for i in np.flatnonzero(long):
            text = column[i].as_py()
            out[i] = count_long(text, tokens, chunk, overlap)
        return out

    return count


def count_tokens(docs: DataFrame, path: str, limit: int, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null text counts as empty, with 0 bytes and tokens. Repeated rows are counted each; an empty table gives no rows; texts
    above ``chunk`` bytes are encoded whole, in chunks of that many code points. Other columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_in = counter(path, chunk, overlap)
        for b in slices(batches, most=8_000_000):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(text_bytes(b.column("text"))[1])), pa.array(tokens_in(b.column("text")))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
