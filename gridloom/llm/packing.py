"""Harmonic packing: documents become token ids, are cut into pieces, and pieces fill sequences.

A piece of length L belongs to the reciprocal class k = capacity // L, and a sequence of class k
holds exactly k pieces: any k of them fit. What is wasted is the distance of a piece from
capacity / k, so a document is cut where classes end: whole sequences first, then, while the rest
is more than `SLACK` under its class's size, a head of exactly capacity // (k + 1) and the rest
again. That is the greedy expansion into unit fractions, whose rest shrinks quadratically: a
document has at most three pieces or so beyond its whole sequences, and a full sequence is
padded by SLACK of the capacity at most.

Every task fills sequences of its own, and holds one open sequence a class (some 2 * sqrt(capacity)
of them, all together under 128 capacities of ids). Open sequences at a task's end are dealt
to fewer tasks, which fill on; when `LAST` ids or fewer are left, one task fills
the last full ones, lays the remaining pieces end to end, cuts them at the capacity, and ends with
sequences whose lengths are powers of two, which need no padding.

Ids are those of the `tokenizers` library. Its file drops white space, so the ids of a text
are those of its words one after the other: a Python worker encodes a word once as long as it
remembers it, and long texts are worked on in stretches of about `STRETCH` bytes that end at white
space. Nothing but a single word without white space must be in memory with the library's
own bookkeeping.

Defined cases: null and empty texts have the end id alone; a text of any length is encoded whole;
repeated rows, also of one doc_id, and null doc_ids are each packed; an empty table gives an empty
result; other columns are not carried and can't clash. Which pieces meet depends on how Spark
deals the rows; that each id lies in one piece, and the padding's bound, do not.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from types import SimpleNamespace
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.llm.words import rows_of, texts

CAPACITY, END = 4096, 2
#: Share of its class's size that a piece may be short of before it is cut.
SLACK = 1 / 64
#: Bytes of a text that are encoded at a time, and words that a worker remembers (some 120 MB).
STRETCH, REMEMBERED = 1 << 20, 600_000
#: Ids that one task gets after the first round, and at most in the last.
LAST = 4 << 20
#: How a file must split words for them to be encoded apart, and the same for lower-case ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
#: A mark at a word's end, after a letter of ASCII or Latin-1.
LAST_MARK = re.compile(rb"([.,;:!?])(?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))(?=[ \t\n\r\x0b\x0c]|\Z)")
#: Pieces of an output batch.
BATCH = 512

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_SQL = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if rest >= (capacity // k) * (1 - SLACK):
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class WordIds(dict):
    """A word's ids by the tokenizer's file, as bytes; forgotten when there are too many.

    Words are encoded apart if the file lowers letters and splits by PATTERN. Then what it does to Latin and ASCII words is
    known: only their tokens are left to the library's model. All other words, and texts under any other file, are encoded by the library.
    """

    def __init__(self, file: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.model = self.tokenizer.model
        # byte-level tokens: printable bytes stand for themselves, the others for the characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in shown)}
        how = json.loads(file)
        steps = [x["type"] for x in (how["normalizer"] or {}).get("normalizers", [])]
        parts = (how["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern") == {"Regex": PATTERN} and not (how["added_tokens"] and any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in how["added_tokens"]))

    @classmethod
    def of_worker(cls, file: str) -> WordIds:
        """One that lasts as long as the Python worker, which runs task after task."""
        held = sys.modules.setdefault("_words_of_worker", SimpleNamespace())
        key = zlib.crc32(file.encode())
        if getattr(held, "key", None) != key:
            held.key, held.words = key, cls(file)
        return held.words

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        s = word.decode(errors="replace")
        if s.isascii() and "<" not in s and s.isprintable():
            s = s.lower()
            parts = (s,) if s.isalpha() else ASCII_PART.findall(s)
        elif _one_token(s):
            parts = (s.lower().encode().decode("latin-1").translate(self.shown),)
        else:
            out = self[word] = array("i", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
            return out
        out = self[word] = array("i", [t.id for p in parts for t in self.model.tokenize(p)]).tobytes()
        return out

    def of(self, text: bytes) -> np.ndarray:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join([b"".join(map(self.__getitem__, _words(part))) for part in stretches(text)]), np.int32)


def _one_token(s: str) -> bool:
    """Is s a Latin word whose only normalisation is lower case and that is not split?"""
    return s.isalpha() and max(s) < "\u0250" and "\u0130" not in s and is_normalized("NFC", s)


def _words(part: bytes) -> list[bytes]:
    """What is encoded apart: no token holds white space, and a last mark after a letter starts one. Letters are lowered anyway, but for special tokens."""
    return LAST_MARK.sub(rb" \1", part if b"<|" in part else part.lower()).split()


def stretches(text: bytes, most: int = STRETCH) -> Iterator[bytes]:
    """Parts of about `most` bytes that end before white space; a longer word is not cut."""
    at, space = 0, b" \t\n\r\x0b\x0c"
    while at < len(text):
        to = at + most
        while to < len(text) and text[to] not in space:
            to += 1
        yield text[at:to]
        at = to


def _pieces(file: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = WordIds.of_worker(file)
        for batch in batches:
            for part in rows_of(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                    ids, at = np.append(known.of(text or b""), np.int32(END)), 0
                    for length in cuts(len(ids), capacity):
                        yield doc_id, at, ids[at : at + length], len(ids)
                        at += length

    return cut


def _lists(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list starts, and last where the last ends, in the values of all."""
    return np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]), ids.flatten().to_numpy(zero_copy_only=False)


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        at, flat = _lists(batch.column("ids"))
        for doc_id, start, whole, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")), at[:-1], at[1:], strict=True):
            yield doc_id, start, flat[a:b].copy(), whole


def fill(pieces: Iterator[tuple], capacity: int, first: int, last: bool) -> Iterator[tuple]:
    """(piece, sequence, offset) of pieces (doc_id, start, ids, doc_tokens); sequence is None for what stays open, unless this is the last task."""
    open_: dict[int, list[tuple]] = {}
    for p in pieces:
        k = capacity // len(p[2])
        held = open_.setdefault(k, [])
        held.append(p)
        if len(held) == k:
            at = 0
            for q in held:
                yield q, first, at
                at += len(q[2])
            first += 1
            held.clear()
    rest = [p for k in sorted(open_) for p in open_[k]]
    if not last:
        yield from ((p, None, None) for p in rest)
        return
    total = sum(len(p[2]) for p in rest)
    room, at = iter([capacity] * (total // capacity) + powers(total % capacity)), 0
    most = next(room, 0)
    for doc_id, start, ids, whole in rest:
        done = 0
        while done < len(ids):
            if at == most:
                most, at, first = next(room), 0, first + 1
            n = min(most - at, len(ids) - done)
            yield (doc_id, start + done, ids[done : done + n], whole), first, at
            done, at = done + n, at + n


def _filler(source, capacity: int, turn: int, last: bool):
    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (turn << 56) + (TaskContext.get().partitionId() << 32)
        rows = []
        for (doc_id, start, ids, whole), sequence, offset in fill(source(batches), capacity, first, last):
            rows.append((doc_id, start, len(ids), ids, whole, sequence, offset))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return filled


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, length, ids, whole, sequence, offset = zip(*rows, strict=True)
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))
    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), flat, pa.array(crc, pa.int64()), *(pa.array(x, pa.int64()) for x in (whole, sequence, offset))], schema=PIECE)


def pack(docs: DataFrame, file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id and offset of every piece of docs (doc_id, text); file: the tokenizer's, as read by the driver."""
    spark = docs.sparkSession
    with open(file, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return _pieces(sent.value, capacity)(batches)

    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_filler(source, capacity, 0, False), PIECE_SQL), "pieces")
    out, turn, tasks = found.where("sequence_id is not null"), 0, 1 << 40
    while True:
        left, turn = found.where("sequence_id is null"), turn + 1
        tasks = min(tasks // 4, -(-(left.agg(F.sum("length")).first()[0] or 0) // LAST))
        if tasks <= 1:
            return out.unionByName(left.coalesce(1).mapInArrow(_filler(_again, capacity, turn, True), PIECE_SQL))
        found = stored(left.repartition(tasks).mapInArrow(_filler(_again, capacity, turn, False), PIECE_SQL), "pieces")
        out = out.unionByName(found.where("sequence_id is not null"))
