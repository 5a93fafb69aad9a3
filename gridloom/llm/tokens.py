"""SentencePiece encoding and decoding as a max-plus scan.

A model's pieces with their scores are read as a unigram vocabulary: the encoding of a text
is the piece sequence of highest total score. In the (max, +) semiring that is a product of
transfer matrices, one a chunk of text, between boundary states: how many characters a piece
that began before the boundary reaches past it. Products are associative, so

* inside a worker every stretch between places that no piece can span (a word with its
  leading spaces) is a chunk with a single boundary state. Distinct stretches are solved
  once, all side by side, and documents are put together from them;
* documents over `GIANT` characters are first split into rows of about `CHUNK` characters that
  tasks work on apart. A chunk ends where no piece can span, or, within a stretch longer than
  CHUNK, anywhere: such a chunk yields its transfer matrix, the matrices of a stretch are
  combined in order to the scores with which each of its chunks is entered, and each chunk is
  then backtraced on its own from every state in which it can be left. Putting a document
  together is choosing one of these traces a chunk, from the end.

Ties go to the shortest last piece, then to the shortest before it, and so on. Scores are rounded
to multiples of 2^-16, which float64 adds exactly, and a chunk is backtraced with the true scores
at its start, so a text has the same ids whole and in chunks of any size. Characters without a
piece fall back to the byte pieces of their UTF-8 form, at the score of an unknown character.

Normalisation is the identity: one leading space is added, spaces become U+2581. Decoding
reverses it; a U+2581 in the text itself comes back as a space, as with any SentencePiece
model. Defined cases: null and empty text have no tokens (null decodes to null); an empty table
gives an empty result; a text of any length is encoded whole; repeated rows are encoded each; a
row's other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.llm.words import rows_of

MARK = "▁"
GIANT = 65_536
CHUNK = 16_384
NONE = -np.inf
UNKNOWN_BELOW = 10.0
#: Scores are whole multiples of one over this.
FINE = 65_536.0
#: Stretches and characters of them that a worker remembers: about 20 MB.
REMEMBERED, REMEMBERED_CHARS = 100_000, 2_000_000
SLICE = 1 << 18


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = np.round(np.array([sp.get_score(i) for i in range(n)], dtype=np.float64) * FINE) / FINE
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores[plain]) - UNKNOWN_BELOW
        #: Scores of ids in an encoding: the first byte of a character without piece stands for all of it.
        self.cost = self.scores.copy()
        for b, i in self.bytes.items():
            self.cost[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown_score
        self.codes, self.coded = _coded(self.ids)
        self.maybe = np.zeros(1 << 20, bool)  # by the low bits of a code: is there such a piece at all?
        self.maybe[self.codes & _LOW] = True
        self.raw = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in (*self.bytes.values(), self.unknown):
            self.raw[i] = b"" if i == self.unknown else bytes([int(self.pieces[i][3:-1], 16)])
        #: No piece spans the place before a mark that follows another character, nor a line's end.
        line = "" if any("\n" in p for p in self.ids if len(p) > 1) else "\n"
        whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.stretch = re.compile("(?s).+" if whole else f"{MARK}*[^{MARK}{line}]+|{MARK}+" + "|\n" * bool(line))

    def fallback(self, char: str) -> list[int]:
        found = [self.bytes.get(b) for b in char.encode()]
        return [self.unknown] if None in found else found

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MULTIPLIER, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 20) - 1)


def _coded(ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the pieces and their ids; no two pieces of a vocabulary may share a code."""
    mask, codes = (1 << 64) - 1, []
    for p in ids:
        c, power = 0, 1
        for ch in reversed(p):
            c, power = (c + ord(ch) * power) & mask, power * int(_MULTIPLIER) & mask
        codes.append(c ^ (len(p) * int(_LENGTH) & mask))
    order = np.argsort(np.array(codes, np.uint64))
    found = np.array(codes, np.uint64)[order]
    if (found[1:] == found[:-1]).any():
        raise ValueError("two pieces share a code")
    return found, np.array(list(ids.values()))[order]


def best_paths(vocab: Vocabulary, text: str, stop: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Max-plus scores of a chunk for each row (lane) of entry, the scores with which it is entered at its first characters.

    text holds the chunk, its first `stop` characters, and after it those that a piece begun
    inside may still cover. Returns score[lane, end] over ends up to the text's end, with the
    last piece's length (0: entered there) and id; pieces begin inside the chunk only. A
    piece of the chunk is shorter than one that reaches into it, so it wins ties.
    """
    n, lanes = len(text), len(entry)
    score = np.full((lanes, n + 1), NONE)
    back = np.zeros((lanes, n + 1), np.int16)
    piece = np.full((lanes, n + 1), -2, np.int32)
    get, most, single = vocab.ids.get, vocab.longest, vocab.unknown_score
    for end in range(n + 1):
        for size in range(max(1, end - stop + 1), min(most, end) + 1):
            at = end - size
            i = get(text[at:end])
            if i is None and size > 1:
                continue
            new = score[:, at] + (single if i is None else vocab.scores[i])
            up = new > score[:, end]
            score[up, end], back[up, end], piece[up, end] = new[up], size, -1 if i is None else i
        if end < entry.shape[1]:
            up = entry[:, end] > score[:, end]
            score[up, end], back[up, end] = entry[up, end], 0
    return score, back, piece


def trace(vocab: Vocabulary, text: str, back: np.ndarray, piece: np.ndarray, end: int) -> tuple[int, list[int]]:
    """The place where the best path to end enters the chunk, and its ids."""
    out: list[list[int]] = []
    while back[end]:
        i, size = int(piece[end]), int(back[end])
        out.append([i] if i >= 0 else vocab.fallback(text[end - size : end]))
        end -= size
    return end, [i for ids in reversed(out) for i in ids]


class Stretches(dict):
    """stretch -> its number. The encodings lie one after another in one array, while there is room."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab, self.new, self.chars = vocab, [], 0
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.chars = 0
        self.ids, self.size, self.same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self.size) + len(self.new)
        self.new.append(word)
        return i

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word, does it decode to the word?)"""
        if len(self) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._empty()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            ids, size = solve(self.vocab, self.new)
            self.chars += sum(map(len, self.new))
            self.same = np.r_[self.same, _same(self.vocab, self.new, ids, size)]
            self.ids, self.size, self.new = np.r_[self.ids, ids], np.r_[self.size, size], []
        first, size = np.cumsum(self.size) - self.size, self.size[at]
        run = np.arange(size.sum()) + np.repeat(first[at] - (np.cumsum(size) - size), size)
        return self.ids[run], size, self.same[at]


def _same(vocab: Vocabulary, words: list[str], ids: np.ndarray, size: np.ndarray) -> list[bool]:
    raw, ends = list(map(vocab.raw.__getitem__, ids.tolist())), np.cumsum(size).tolist()
    return [b"".join(raw[a:b]) == w.replace(MARK, " ").encode() for w, a, b in zip(words, [0, *ends], ends, strict=False)]


def solve(vocab: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best ids of the words in a row and their number for each, every word a chunk with one way in and one way out.

    All words advance together: step t closes position t of those that reach it. Pieces are
    found by a rolling code of their characters in a sorted table.
    """
    codes, coded = vocab.codes, vocab.coded
    length = np.array([len(w) for w in words])
    order = np.argsort(-length, kind="stable")
    size = length[order]
    flat = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    total = len(flat)
    # position p of word k sits at first[k] + k + p in arrays with a slot for the start
    base = first + np.arange(len(size))
    best = np.full(total + len(size), NONE)
    back = np.zeros(total + len(size), np.int16)
    piece = np.full(total + len(size), -1, np.int32)
    best[base] = 0.0
    within = np.arange(total) - np.repeat(first, size)
    place = np.arange(total) + np.repeat(np.arange(len(size)), size) + 1
    code, power = flat.copy(), _MULTIPLIER  # of the run that ends here, lengthened leftwards
    hits = []
    with np.errstate(over="ignore"):
        for n in range(1, min(vocab.longest, int(size[0])) + 1):
            if n > 1:
                code[n - 1 :] += flat[: total - n + 1] * power
                power *= _MULTIPLIER
            key = code ^ (np.uint64(n) * _LENGTH)
            some = np.flatnonzero(vocab.maybe[key & _LOW])
            some = some[within[some] >= n - 1]
            at = np.minimum(np.searchsorted(codes, key[some]), len(codes) - 1)
            hit = codes[at] == key[some]
            hits.append((some[hit], coded[at[hit]]))
    known = np.zeros(total, bool)
    known[hits[0][0]] = True
    lone = np.flatnonzero(~known)
    end = np.concatenate([*(h[0] for h in hits), lone])
    what = np.concatenate([*(h[1] for h in hits), np.full(len(lone), -1, np.int64)])
    long = np.concatenate([*(np.full(len(h[0]), n + 1) for n, h in enumerate(hits)), np.ones(len(lone), np.int64)])
    value = np.where(what >= 0, vocab.scores[what], vocab.unknown_score)
    # by position, longest first: of equal scores the one written last, the shortest piece's, stays
    group = np.lexsort((-long, within[end]))
    end, what, long, value = end[group], what[group], long[group], value[group]
    edge = np.searchsorted(within[end], np.arange(int(size[0]) + 1))
    for t in range(int(size[0])):
        e = slice(edge[t], edge[t + 1])
        to = place[end[e]]
        new = best[to - long[e]] + value[e]
        rank = np.argsort(new, kind="stable")
        to, rank_long = to[rank], long[e][rank]
        best[to], back[to], piece[to] = new[rank], rank_long, what[e][rank]
    now, left, steps = base + size, np.arange(len(size)), []
    while len(left):
        steps.append((left, piece[now], now - base[left] - 1))
        now = now - back[now]
        go = now > base[left]
        now, left = now[go], left[go]
    word, ids, last = (np.concatenate(x) for x in zip(*steps, strict=True))
    back_to_front = np.lexsort((-np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps]), order[word]))
    word, ids, last = order[word][back_to_front], ids[back_to_front], last[back_to_front]
    for i in np.flatnonzero(ids < 0)[::-1]:
        found = vocab.fallback(words[word[i]][last[i]])
        ids[i] = found[0]
        if len(found) > 1:
            ids, word, last = (np.insert(x, i + 1, y) for x, y in ((ids, found[1:]), (word, [word[i]] * (len(found) - 1)), (last, [0] * (len(found) - 1))))
    return ids, np.bincount(word, minlength=len(words))


def _marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def _encoder(vocab):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches(vocab)
        split = vocab.stretch.findall
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                texts = batch.column("text").to_pylist()
                found = [split(_marked(t)) if t else [] for t in texts]
                n = np.array([len(ws) for ws in found])
                ids, size, same = known.encode([w for ws in found for w in ws])
                owner = np.repeat(np.arange(len(texts)), n)
                ends = np.r_[0, np.cumsum(np.bincount(owner, size, len(texts)).astype(np.int64))]
                null = np.array([t is None for t in texts], bool)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[null, False]), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.bincount(owner, ~same, len(texts)) == 0, mask=null)], names=["doc_id", "ids", "round_trip"])

    return encode


def chunks(vocab: Vocabulary, text: str, size: int) -> list[tuple[str, int, bool, bool]]:
    """(characters of the chunk and the look-ahead, length of the chunk, hard start, hard end) of a marked text.

    Whole stretches gather to chunks of about size characters; a longer stretch is cut into
    hard chunks of its own.
    """
    size, out, at = max(size, vocab.longest), [], 0
    for m in vocab.stretch.finditer(text):
        s, e = m.span()
        if e - s > size:
            if s > at:
                out.append((text[at:s], s - at, False, False))
            for c in range(s, e, size):
                stop = min(c + size, e)
                out.append((text[c : min(stop + vocab.longest - 1, e)], stop - c, c > s, stop < e))
            at = e
        elif e - at >= size:
            out.append((text[at:e], e - at, False, False))
            at = e
    return out + [(text[at:], len(text) - at, False, False)] * (at < len(text))


def _splitter(vocab, size: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_of(whole, SLICE):
                for rid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                    rows = [(rid, doc, i, *x) for i, x in enumerate(chunks(vocab, _marked(text), size))]
                    yield pa.RecordBatch.from_pylist([dict(zip(CHUNK_ROW.names, r, strict=True)) for r in rows], schema=CHUNK_ROW)

    return split


CHUNK_ROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("part", pa.string()), ("stop", pa.int32()), ("hard_start", pa.bool_()), ("hard_end", pa.bool_())])


def transfer(vocab: Vocabulary, part: str, stop: int, hard_start: bool, hard_end: bool) -> np.ndarray:
    """Max-plus matrix (ways in x ways out) of a chunk; one way at a place that no piece spans."""
    ways = vocab.longest if hard_start else 1
    score, _, _ = best_paths(vocab, part, stop, np.where(np.eye(ways, dtype=bool), 0.0, NONE))
    out = np.full((ways, vocab.longest if hard_end else 1), NONE)
    got = score[:, stop : stop + out.shape[1]]
    out[:, : got.shape[1]] = got
    return out


def _transferrer(vocab):
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [transfer(vocab, *(batch.column(c)[j].as_py() for c in ("part", "stop", "hard_start", "hard_end"))) for j in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("i"), batch.column("hard_start"), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.ravel().tolist() for m in found], pa.list_(pa.float64()))],
                names=["rid", "i", "hard_start", "ways_in", "matrix"])

    return matrices


def entries(matrices: list[np.ndarray], hard_starts: list[bool]) -> list[np.ndarray]:
    """Scores with which each of consecutive chunks is entered; a chunk without hard start begins a new product."""
    out, now = [], np.zeros(1)
    for m, hard in zip(matrices, hard_starts, strict=True):
        now = now if hard else np.zeros(1)
        out.append(now)
        now = (now[:, None] + m).max(0)
    return out


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("i")
    found = entries([np.asarray(m).reshape(w, -1) for m, w in zip(rows["matrix"], rows["ways_in"], strict=True)], rows["hard_start"].tolist())
    return pd.DataFrame({"rid": rows["rid"], "i": rows["i"], "entry": found})


def traces(vocab: Vocabulary, part: str, stop: int, hard_end: bool, entry: np.ndarray) -> list[tuple[int, list[int], bool]]:
    """(place of entry, ids, do they decode to the text?) for every state in which a chunk can be left."""
    score, back, piece = best_paths(vocab, part, stop, entry[None])
    out = []
    for end in range(stop, min(len(part), stop + vocab.longest - 1) + 1 if hard_end else stop + 1):
        enter, ids = trace(vocab, part, back[0], piece[0], end) if score[0, end] > NONE else (0, [])
        out.append((enter, ids, b"".join(vocab.raw[i] for i in ids) == part[enter:end].replace(MARK, " ").encode()))
    return out


def _tracer(vocab):
    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches(vocab)
        for batch in batches:
            for j in range(len(batch)):
                r = batch.slice(j, 1).to_pylist()[0]
                if r["hard_start"] or r["hard_end"]:
                    found = traces(vocab, r["part"], r["stop"], r["hard_end"], np.array(r["entry"]))
                    enter, same, size = [x[0] for x in found], [x[2] for x in found], [len(x[1]) for x in found]
                    ids = np.array([i for x in found for i in x[1]], np.int32)
                else:
                    ids, _, ok = known.encode(vocab.stretch.findall(r["part"]))
                    enter, same, size = [0], [bool(ok.all())], [len(ids)]
                yield pa.RecordBatch.from_pylist([{"rid": r["rid"], "doc_id": r["doc_id"], "i": r["i"], "hard_start": r["hard_start"], "enter": enter, "same": same, "size": size, "ids": ids}], schema=TRACE_ROW)

    return traced


TRACE_ROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("i", pa.int32()), ("hard_start", pa.bool_()), ("enter", pa.list_(pa.int32())), ("same", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])


def _joiner(rows: pd.DataFrame) -> pd.DataFrame:
    """A document from its chunks' traces: the last chunk is left at its end, each one before where the next is entered."""
    rows, leave, out, same = rows.sort_values("i", ascending=False), 0, [], True
    for hard, enter, ok, size, ids in zip(*(rows[c] for c in ("hard_start", "enter", "same", "size", "ids")), strict=True):
        at = int(np.sum(size[:leave]))
        out.append(np.asarray(ids)[at : at + size[leave]])
        same = same and bool(ok[leave])
        leave = int(enter[leave]) if hard else 0
    return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "ids": [np.concatenate(out[::-1])], "round_trip": [same]})


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids and round_trip (do the ids decode to the text?) of every row of docs (doc_id, text)."""
    vocab = Vocabulary(model)  # travels with the tasks
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= giant).mapInArrow(_encoder(vocab), "doc_id long, ids array<int>, round_trip boolean")
    large = docs.where(F.length("text") > giant).withColumn("rid", F.monotonically_increasing_id())
    parts = stored(large.mapInArrow(_splitter(vocab, chunk), "rid long, doc_id long, i int, part string, stop int, hard_start boolean, hard_end boolean"), "chunks")
    hard = parts.where("hard_start or hard_end").repartition("rid", "i")
    entry = hard.mapInArrow(_transferrer(vocab), "rid long, i int, hard_start boolean, ways_in int, matrix array<double>").groupBy("rid").applyInPandas(_combine, "rid long, i int, entry array<double>")
    found = parts.join(entry, ["rid", "i"], "left").mapInArrow(_tracer(vocab), "rid long, doc_id long, i int, hard_start boolean, enter array<int>, same array<boolean>, size array<int>, ids array<int>")
    return small.unionByName(found.groupBy("rid").applyInPandas(_joiner, "doc_id long, ids array<int>, round_trip boolean"))


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text of tokens (doc_id, ids)."""
    vocab = Vocabulary(model)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if x is None else vocab.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
