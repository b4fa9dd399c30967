"""Bounded-space online packing of tokenised documents into sequences of a fixed number of tokens.

Every task reads its documents once and keeps a fixed number of open windows.  A document goes whole into the window that it fills
best; when it fits none and all windows are open, the fullest is topped up with the document's head and emitted, and the rest is
placed again.  Documents longer than a window fill windows of their own first.  So a sequence that a task emits is full.

What is left in the open windows of all tasks is merged in rounds: a fixed number of tasks' leftovers meet in one task, which packs
their pieces in the same way and again leaves no more than its open windows.  The last round closes them: the pieces are laid end to
end, cut at the window's size, and the rest is cut at powers of two, which need no padding.  No task ever holds more than the windows
of a few others, and the number of rounds is logarithmic in the number of tasks.
"""

from __future__ import annotations

import collections
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, whole_text

SIZE = 2048
#: Open windows of a task.
WINDOWS = 16
#: Tasks whose leftovers meet in one task.
FAN_IN = 16
#: Bytes of ids in a batch of rows that a task returns.
BATCH = 4 << 20
#: Texts that are encoded together.
TEXTS = 128
#: Pre-tokens and chunks of text whose ids a worker remembers; longer ones are not remembered.
KNOWN, KNOWN_CHARS = 1 << 20, 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long"
#: Characters below this are composed already and have lower-case forms of their own, whatever stands beside them.
_PLAIN = 0x250

Encoder = Callable[[list[str]], list[np.ndarray]]
_encoders: dict[tuple[str, int], Encoder] = {}


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _DIGITS = _class("L"), _class("N")
#: The file's pre-tokens, of plain lower-case text.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\x09-\x0D \x85\xA0{_LETTERS}{_DIGITS}]+")


class _WordEncoder:
    """Ids of texts by a file of word-end BPE; each distinct chunk and pre-token is encoded once while it is remembered."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # pre-tokens that are cut and in lower case already need neither the file's pattern nor its normalisation
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end_id], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.not_plain = re.compile("|".join([f"[^\0-{chr(_PLAIN - 1)}]", *special])).search
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _encode_words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, all in one text: each ends with the only one of its ids that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(new):
            return self._encode_chunks(new)
        raw = ids.tobytes()
        return {w: raw[a:b] for w, a, b in zip(new, [0, *ends], ends)}

    def _encode_chunks(self, new: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(new, found, strict=True)}

    def _encode_new(self, new: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not remembered; those of plain ones are the ids of their pre-tokens."""
        plain = [c for c in new if not self.not_plain(c)]
        found = self._encode_chunks(list(new.difference(plain))) if len(plain) < len(new) else {}
        if len(self.words) > KNOWN:
            self.words.clear()
        parts = [_WORD.findall(c.lower()) for c in plain]
        words = list(set(itertools.chain.from_iterable(parts)).difference(self.words))
        ids = self.words
        if words:
            own = self._encode_words(words)
            self.words.update((w, x) for w, x in own.items() if len(w) <= KNOWN_CHARS)
            if any(len(w) > KNOWN_CHARS for w in words):
                ids = collections.ChainMap(own, self.words)
        found.update((c, b"".join([ids[w] for w in part])) for c, part in zip(plain, parts, strict=True))
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > KNOWN:
            self.chunks.clear()
        cut = [text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for text in texts]
        got = [list(map(self.chunks.get, own)) for own in cut]
        new = {c for own, ids in zip(cut, got, strict=True) if None in ids for c, x in zip(own, ids, strict=True) if x is None}
        if new:
            found = self._encode_new(new)
            got = [[found[c] if x is None else x for c, x in zip(own, ids, strict=True)] if None in ids else ids for own, ids in zip(cut, got, strict=True)]
            self.chunks.update((c, x) for c, x in found.items() if len(c) <= KNOWN_CHARS)
        return [np.frombuffer(b"".join(ids) + self.end, "<u4") for ids in got]


def tokenizer_encoder(path: str, end_id: int) -> Callable[[], Encoder]:
    """Encoder by a file of the ``tokenizers`` library for word-end BPE whose pre-tokens never hold white space; ``end_id`` ends each text.

    A text's ids are those of its chunks between blanks, tabs and line ends: no pre-token and no special string holds one of these,
    normalisation never composes across one and maps letters one by one.  Plain chunks are cut into the file's pre-tokens here.  The
    library encodes each distinct piece; a worker remembers a bounded number of them.
    """

    def make() -> Encoder:
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = _WordEncoder(path, end_id)
        return _encoders[path, end_id]

    return make


class _Packer:
    """Open windows of one task; ``emit`` takes the pieces of a full one. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int, emit: Callable[[list[tuple]], None]):
        self.size, self.windows, self.emit = size, windows, emit
        self.room: list[int] = []
        self.held: list[list[tuple]] = []

    def _put(self, at: int, piece: tuple) -> None:
        self.held[at].append(piece)
        self.room[at] -= len(piece[2])
        if not self.room[at]:
            self.emit(self.held.pop(at))
            self.room.pop(at)

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc_id, start, ids[: self.size], doc_tokens)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fits = [(room, i) for i, room in enumerate(self.room) if room >= len(ids)]
            if fits:
                at = min(fits)[1]
            elif len(self.room) < self.windows:
                self.room.append(self.size)
                self.held.append([])
                at = len(self.room) - 1
            else:
                at = min(range(len(self.room)), key=lambda i: (self.room[i], i))
            head = min(len(ids), self.room[at])
            self._put(at, (doc_id, start, ids[:head], doc_tokens))
            start, ids = start + head, ids[head:]

    def close(self) -> None:
        """Emit all: full sequences, and the rest cut at powers of two."""
        pieces = [p for held in sorted(self.held, key=lambda held: -sum(len(p[2]) for p in held)) for p in held]
        self.room, self.held = [], []
        left = sum(len(p[2]) for p in pieces)
        own: list[tuple] = []
        need = self._next(left)
        for doc_id, start, ids, doc_tokens in pieces:
            while len(ids):
                head = min(len(ids), need)
                own.append((doc_id, start, ids[:head], doc_tokens))
                start, ids, need, left = start + head, ids[head:], need - head, left - head
                if not need:
                    self.emit(own)
                    own, need = [], self._next(left)

    def _next(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(0, left.bit_length() - 1)


class _Rows:
    """Pieces gathered into batches of rows."""

    def __init__(self, round_: int, part: int):
        self.name, self.part, self.count = (round_ << 56) | (part << 32), part, 0
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, pieces: list[tuple], closed: bool = True) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), doc_tokens, self.name + self.count if closed else None, offset, self.part))
            offset += len(ids)
            self.bytes += 4 * len(ids) + 64
        self.count += closed

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.bytes >= least and self.rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")]
            )
            self.rows, self.bytes = [], 0


def _first_round(make: Callable[[], Encoder], size: int, windows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        rows = _Rows(0, TaskContext.get().partitionId())
        packer = _Packer(size, windows, rows.add)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first in range(0, len(ids), TEXTS):
                own = ids[first : first + TEXTS]
                for doc_id, tokens in zip(own, encode(texts.slice(first, TEXTS).to_pylist()), strict=True):
                    packer.add(doc_id, 0, tokens, len(tokens))
                yield from rows.take(BATCH)
        for held in packer.held:
            rows.add(held, closed=False)
        yield from rows.take(0)

    return task


def _merge_round(round_: int, size: int, windows: int, last: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, packer = None, None, None
        columns = ("part", "doc_id", "start", "ids", "doc_tokens")

        def leave() -> Iterator[pa.RecordBatch]:
            if packer is not None:
                if last:
                    packer.close()
                for held in packer.held:
                    rows.add(held, closed=False)
                yield from rows.take(0)

        for batch in batches:
            for own, doc_id, start, ids, doc_tokens in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if own != part:
                    yield from leave()
                    part, rows = own, _Rows(round_, own)
                    packer = _Packer(size, windows, rows.add)
                packer.add(doc_id, start, np.frombuffer(ids, "<u4"), doc_tokens)
            if rows is not None:
                yield from rows.take(BATCH)
        yield from leave()

    return task


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Stored in the shared folder; ids pack well."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(PIECES).parquet(path)


def pack(
    docs: DataFrame, make: Callable[[], Encoder], *, size: int = SIZE, windows: int = WINDOWS, fan_in: int = FAN_IN, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``make`` gives, inside a task, a function from texts to arrays of ids.  Each id of each row lies in exactly one piece;
    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.  Sequences are full, but for at most
    one of each smaller power of two.  A NULL text is empty; rows that repeat an identifier, or have none, are packed each for
    itself, and only ``start`` and ``doc_tokens`` tell their pieces.  Other columns are ignored.  A document without ids has no piece;
    an empty table gives no rows.  Nothing is random: the same partitions of input give the same sequences.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    packed = _kept(rows.mapInArrow(_first_round(make, size, windows), PIECES), "packing-first")
    closed = packed.filter("sequence_id is not null")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    for round_ in itertools.count(1):
        last = parts <= fan_in
        # a window's number in its part is not needed: pieces are packed one by one, in a fixed order
        order = ["part", "from", F.col("length").desc(), "doc_id", "start", "ids"]
        left = packed.filter("sequence_id is null").withColumn("from", F.col("part")).withColumn("part", F.expr(f"part div {fan_in}"))
        together = left.repartition("part").sortWithinPartitions(*order)
        merged = together.select("part", "doc_id", "start", "ids", "doc_tokens").mapInArrow(_merge_round(round_, size, windows, last), PIECES)
        packed = _kept(merged, "packing-merged")
        closed = closed.unionByName(packed.filter("sequence_id is not null"))
        if last:
            return closed.drop("part")
        parts = -(-parts // fan_in)
