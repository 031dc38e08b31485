"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a SentencePiece model file, and so do the log scores if it is a unigram model. A BPE file has ranks instead: its pieces get the log probabilities of Zipf's law,
``-log(rank) - log(sum of 1/rank)``, rounded to 1/32 so that sums are exact in single precision too. ``write_model`` saves pieces and scores as a unigram model file, and the
library's ids with that file are the ids given here. Text gets a leading white-space marker and each space becomes one;
the path with the highest sum of scores wins (of equal ones, the one with the longer last piece), a character without
a piece falls back to its UTF-8 bytes. No piece has a marker after other characters, nor a line feed, so texts are cut
into units there (markers with the characters that follow them), and each worker runs the Viterbi search once for a distinct unit,
for many short units at a time, keeping a bounded table.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.words import slices

MARK = "▁"
_UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Units up to this many bytes are searched together; of longer ones this many bytes at a time are looked up.
_SHORT, _LOOK = 64, 1 << 16


class DoubleArray:
    """A trie of byte strings: from node s, byte c leads to ``t = base[s] + c`` where ``check[t] == s``; ``value[t]`` is the key's number or -1."""

    def __init__(self, keys: list[bytes]) -> None:
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, key in enumerate(keys):
            at = 0
            for c in key:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = tree[at][c]
            ends[at] = number
        size = 2 * len(tree) + 100_000
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0], low, tail, todo = 1, 257, 257, [(0, 0)]
        for node, slot in todo:
            children = sorted(tree[node])
            if not children:
                continue
            while used[low]:
                low += 1
            at = max(1, low - children[0])
            if len(children) > 1:  # look for a gap near the end of the used slots, else start there
                at = max(at, tail - 300)
                at = next((x for x in range(at, at + 300) if not any(used[x + c] for c in children)), tail)
            elif used[at + children[0]]:
                at = next(x for x in range(at, size) if not used[x + children[0]])
            base[slot] = at
            for c in children:
                t = at + c
                used[t], check[t], value[t] = 1, slot, ends[tree[node][c]]
                todo.append((tree[node][c], t))
            tail = max(tail, at + children[-1] + 1)
        self.base, self.check, self.value = base, check, value


@dataclass
class Pieces:
    """What encoding and decoding need of a model; small enough to broadcast (bounded by ``most`` pieces)."""

    trie: DoubleArray
    ids: np.ndarray  # id of each key of the trie
    scores: np.ndarray  # score of each key
    unknown: float
    byte_ids: np.ndarray
    byte_score: np.ndarray
    bytes_of: list[bytes]
    table: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": {}}


def load_pieces(path: str, most: int = 1_000_000) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > most:
        raise ValueError(f"more than {most} pieces")
    keys, ids, byte_ids, bytes_of = [], [], np.full(256, -1, np.int64), []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            bytes_of.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            bytes_of.append(b"")
        else:
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses a unit")
            keys.append(piece.encode())
            ids.append(i)
            bytes_of.append(piece.replace(MARK, " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    scores = log_scores(np.array([model.get_score(i) for i in ids]))
    return Pieces(DoubleArray(keys), np.array(ids), scores, float(scores.min()) - 10, byte_ids, np.zeros(256), bytes_of)


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log scores of pieces: a unigram model's as they are; where all are whole numbers they are ranks, and Zipf's law gives the scores."""
    if not len(scores) or (scores != np.round(scores)).any():
        return scores
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable") + 1.0
    return np.round(32 * (-np.log(rank) - np.log((1 / rank).sum()))) / 32


def write_model(path: str, out: str) -> None:
    """The pieces of a model file with their log scores as a unigram model file that the library reads."""
    import sentencepiece

    model, p = sentencepiece.SentencePieceProcessor(model_file=path), load_pieces(path)
    score = dict(zip(p.ids.tolist(), p.scores.tolist(), strict=True))

    def number(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    sized = lambda tag, data: number(tag << 3 | 2) + number(len(data)) + data
    whole = lambda tag, n: number(tag << 3) + number(n)
    # Kinds of pieces and field numbers of the model file's format.
    normal, unknown, control, byte = 1, 2, 3, 6
    data = b""
    for i in range(model.get_piece_size()):
        kind = byte if model.is_byte(i) else unknown if model.is_unknown(i) else control if model.is_control(i) or model.is_unused(i) else normal
        data += sized(1, sized(1, model.id_to_piece(i).encode()) + number(2 << 3 | 5) + struct.pack("<f", score.get(i, 0.0)) + whole(3, kind))
    unigram, byte_fallback = whole(3, 1), whole(35, 1)
    data += sized(2, unigram + byte_fallback) + sized(3, sized(1, b"identity") + whole(3, 1) + whole(4, 0) + whole(5, 1))
    with open(out, "wb") as f:
        f.write(data)


def viterbi(p: Pieces, units: list[bytes]) -> list[tuple[bytes, float]]:
    """Little-endian ids and score of each unit; short units of about equal length are searched together."""
    out: list = [None] * len(units)
    length = np.array([len(u) for u in units], np.int64)
    order = np.argsort(length, kind="stable")
    size = length[order]
    at, short = 0, int(np.searchsorted(size, _SHORT, side="right"))
    while at < short:
        longest = int(size[at])
        to = min(int(np.searchsorted(size, min(_SHORT, longest + max(1, longest // 4)), side="right")), at + 50_000)
        group = order[at:to]
        for i, x in zip(group, _search(p, [units[i] for i in group]), strict=True):
            out[i] = x
        at = to
    for i in order[short:]:
        out[i] = _search_long(p, units[i])
    return out


def _matches(p: Pieces, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces from these starts (of characters), as start, end and number, in the order of starts and ends; a character without a piece of its own has number -1."""
    base, check, value = p.trie.base, p.trie.check, p.trie.value
    first = text[starts]
    width = np.where(first < 0x80, 1, np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2)))
    got, single = [], np.zeros(len(starts), bool)
    live, node, d = np.arange(len(starts)), np.zeros(len(starts), np.int32), 0
    while len(live):
        inside = starts[live] + d < len(text)
        live, node = live[inside], node[inside]
        to = base[node] + text[starts[live] + d]
        on = check[to] == node
        live, node, d = live[on], to[on], d + 1
        hit = value[node] >= 0
        own = live[hit]
        single[own[width[own] == d]] = True
        got.append((starts[own], starts[own] + d, value[node[hit]]))
    alone = np.flatnonzero(~single)
    got.append((starts[alone], starts[alone] + width[alone], np.full(len(alone), -1)))
    start, end, key = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((end, start))
    return start[order], end[order], key[order]


def _search_long(p: Pieces, unit: bytes) -> tuple[bytes, float]:
    """One unit of any length: pieces are looked up for many places at a time, the best path goes through them once."""
    text = np.frombuffer(unit, np.uint8)
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    best, back, kind = [-np.inf] * (len(unit) + 5), [0] * (len(unit) + 5), [-1] * (len(unit) + 5)
    best[0] = 0.0
    for at in range(0, len(starts), _LOOK):
        start, end, key = _matches(p, text, starts[at : at + _LOOK])
        score = np.where(key >= 0, p.scores[key], p.unknown)
        for s, e, k, x in zip(start.tolist(), end.tolist(), key.tolist(), score.tolist(), strict=True):
            x += best[s]
            if x > best[e]:
                best[e], back[e], kind[e] = x, s, k
    ids, at = [], len(unit)
    while at > 0:
        ids.append(p.ids[kind[at]] if kind[at] >= 0 else p.byte_ids[text[back[at] : at]][::-1])
        at = back[at]
    flat = np.concatenate([np.atleast_1d(x) for x in ids])[::-1] if ids else np.zeros(0, np.int64)
    return flat.astype("<u4").tobytes(), best[len(unit)]


def _search(p: Pieces, units: list[bytes]) -> list[tuple[bytes, float]]:
    n, size = len(units), max(map(len, units))
    text = np.zeros((n, size + 1), np.uint8)
    length = np.array([len(u) for u in units])
    text[:, :size][np.arange(size) < length[:, None]] = np.frombuffer(b"".join(units), np.uint8)
    char = np.where(text < 0x80, 1, np.where(text >= 0xF0, 4, np.where(text >= 0xE0, 3, 2))).astype(np.int8)
    begins = (text & 0xC0) != 0x80
    best = np.full((n, size + 5), -np.inf)
    best[:, 0] = 0
    piece, origin = np.full((n, size + 5), -2, np.int32), np.zeros((n, size + 5), np.int32)
    base, check, value = p.trie.base, p.trie.check, p.trie.value
    for i in range(size):
        rows = np.flatnonzero((length > i) & begins[:, i] & (best[:, i] > -np.inf))
        if not len(rows):
            continue
        start, single = rows, np.zeros(n, bool)
        node, d = np.zeros(len(rows), np.int32), 0
        while len(rows):
            to = base[node] + text[rows, i + d]
            on = (check[to] == node) & (length[rows] > i + d)
            rows, node, d = rows[on], to[on], d + 1
            v = value[node]
            hit = v >= 0
            if hit.any():
                r, k = rows[hit], v[hit]
                single[r[char[r, i] == d]] = True
                new = best[r, i] + p.scores[k]
                better = new > best[r, i + d]
                r = r[better]
                best[r, i + d], piece[r, i + d], origin[r, i + d] = new[better], k[better], i
            if i + d > size:
                break
        alone = start[~single[start]]
        if len(alone):
            end = i + char[alone, i]
            new = best[alone, i] + p.unknown
            better = new > best[alone, end]
            alone, end = alone[better], end[better]
            best[alone, end], piece[alone, end], origin[alone, end] = new[better], -1, i
    # A character without a piece steps back byte by byte.
    row, end = np.nonzero(piece == -1)
    width = end - origin[row, end]
    for k in range(4):
        own = width > k
        piece[row[own], end[own] - k], origin[row[own], end[own] - k] = -1, end[own] - k - 1
    score = best[np.arange(n), length]
    rows, at, steps = np.arange(n), length.copy(), []
    while len(rows):
        k = piece[rows, at]
        steps.append((rows, np.where(k >= 0, p.ids[k], p.byte_ids[text[rows, at - 1]])))
        at = origin[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    row = np.concatenate([r for r, _ in steps[::-1]])
    flat = np.concatenate([i for _, i in steps[::-1]])[np.argsort(row, kind="stable")].astype("<u4").tobytes()
    to = 4 * np.cumsum(np.bincount(row, minlength=n))
    return [(flat[i:j], s) for i, j, s in zip([0, *to[:-1].tolist()], to.tolist(), score.tolist(), strict=True)]


def normalise(text: str) -> str:
    """The text with its leading marker and markers for spaces; empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def encode_texts(p: Pieces, texts: list[str], most: int = 120_000) -> list[tuple[bytes, float]]:
    """Little-endian unsigned 32-bit ids and score of each text."""
    units = [_UNIT.findall(normalise(t)) for t in texts]
    distinct = set().union(*units)
    new = [u for u in distinct if u not in p.table]
    if len(p.table) + len(new) > most:
        p.table.clear()
        new = list(distinct)
    p.table.update(zip(new, viterbi(p, [u.encode() for u in new]), strict=True))
    out = []
    for own in units:
        got = list(map(p.table.__getitem__, own))
        out.append((b"".join([x for x, _ in got]), sum([s for _, s in got])))
    return out


def decode_ids(p: Pieces, ids: np.ndarray) -> str:
    """Text of ids: byte pieces join to characters (a broken one becomes U+FFFD), markers become spaces and the leading one goes."""
    text = b"".join(map(p.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, n_byte_tokens, score, ids_crc32, round_trip, and with ``ids`` the ids and the decoded text.

    ``round_trip`` says if the decoded text is the text again (U+2581 counts as a space). Null text counts as empty: no ids, score 0;
    repeated rows are encoded each; an empty table gives no rows; texts of any length are encoded whole. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_byte_tokens", "score", "ids_crc32", "round_trip", "ids", "decoded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        low, high = p.byte_ids.min(), p.byte_ids.max()
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            got = encode_texts(p, texts)
            arrays = [np.frombuffer(x, "<u4") for x, _ in got]
            decoded = [decode_ids(p, a) for a in arrays]
            columns = [
                b.column("doc_id"), pa.array([len(a) for a in arrays], pa.int64()), pa.array([int(((a >= low) & (a <= high)).sum()) for a in arrays], pa.int64()), pa.array([s for _, s in got], pa.float64()),
                pa.array([zlib.crc32(x) for x, _ in got], pa.int64()), pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
            ]
            if ids:
                flat = np.concatenate([*arrays, np.zeros(0, "<u4")]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    schema = f"doc_id {kind}, n_tokens long, n_byte_tokens long, score double, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` of rows with ``ids``; null ids give null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else decode_ids(sent.value, np.asarray(x)))

    return encoded.select("doc_id", text("ids").alias("text"))
