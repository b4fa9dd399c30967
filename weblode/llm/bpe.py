"""Byte-level BPE encoding and decoding by a ranks file.

Texts are split by the tokenizer's pattern, and the ranked merges are folded over the bytes of distinct words.  The fold comes in
two styles with the same tokens, and neither shuffles anything:

* ``native``: the distinct words of a block of documents become byte arrays, and Spark higher-order functions fold the merges
  over them: the state is the word's tokens and the token that each neighbouring pair would become, the smallest of
  which is merged next.  The rank map is a literal of the plan, as buckets of pairs of tokens.  Tokens are put back in document
  order where the block was built.  The fold copies its arrays at each merge, so words of more than ``LONG`` bytes are merged with
  a heap.
* the free style, which is the default because the native one costs more than the check tool allows (see the README):
  each task folds a distinct word once, in Python, with the same rank map as a broadcast dictionary.

Decoding concatenates the binary pieces of the tokens.
"""

from __future__ import annotations

import base64

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
NONE = 2**31 - 1
LONG = 256
#: A block is handed on once it holds so many words.
BLOCK_WORDS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of tokens whose bytes together are a token."""
    return {
        (ranks[token[:i]], ranks[token[i:]]): rank
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    }


def rank_literal(pairs: dict[tuple[int, int], int]) -> str:
    """The pair ranks as a JSON list of buckets, each with its keys and values."""
    buckets: list[tuple[list, list]] = [([], []) for _ in range(BUCKETS)]
    for (a, b), rank in pairs.items():
        keys, values = buckets[(a * 40503 + b * 9973) % BUCKETS]
        keys.append(a * 65536 + b)
        values.append(rank)
    return json.dumps([{"k": k, "v": v} for k, v in buckets], separators=(",", ":"))


def merge_with_heap(word: bytes, single: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same ranked merges for one long word: smallest rank first, leftmost among equals."""
    ids = [single[b] for b in word]
    after = list(range(1, len(ids) + 1))
    prior = list(range(-1, len(ids) - 1))
    heap = [(pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, (a, b) = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < len(ids):
            prior[after[j]] = i
            if (new := (rank, ids[after[j]])) in pairs:
                heapq.heappush(heap, (pairs[new], i, new))
        if prior[i] >= 0 and (new := (ids[prior[i]], rank)) in pairs:
            heapq.heappush(heap, (pairs[new], prior[i], new))
    return [x for x in ids if x >= 0]


def fold(words: str, literal: str, single: list[int]) -> str:
    """SQL for the tokens of an array of byte arrays (column ``words``), given the rank map as a JSON literal column."""
    rank = (
        f"coalesce(try_element_at(get(t, cast((({{a}}) * 40503L + ({{b}}) * 9973L) % {BUCKETS} as int)), "
        f"({{a}}) * 65536L + ({{b}})), {NONE})"
    )
    first = rank.format(a="p[i]", b="p[i + 1]")
    left = rank.format(a="s.p[k - 2]", b="m")
    right = rank.format(a="m", b="s.p[k + 1]")
    none = "cast(array() as array<int>)"
    merged = (
        "transform(array(cast(array_position(s.r, m) as int)), k -> named_struct("
        "'p', concat(slice(s.p, 1, k - 1), array(m), slice(s.p, k + 2, size(s.p))), "
        f"'r', concat(slice(s.r, 1, greatest(k - 2, 0)), if(k > 1, array({left}), {none}), "
        f"if(k + 1 < size(s.p), array({right}), {none}), slice(s.r, k + 2, size(s.r)))))[0]"
    )
    step = f"transform(array(array_min(s.r)), m -> if(m is null or m = {NONE}, s, {merged}))[0]"
    start = f"named_struct('p', p, 'r', if(size(p) < 2, {none}, transform(sequence(0, size(p) - 2), i -> {first})))"
    one = f"aggregate(slice(p, 2, size(p)), {start}, (s, x) -> {step}, s -> s.p)"
    # each table is an argument of a lambda, so it is built once per block and not at each use
    table = f"transform(from_json({literal}, 'array<struct<k:array<bigint>,v:array<int>>>'), b -> map_from_arrays(b.k, b.v))"
    bytes_ = f"array({', '.join(map(str, single))})"
    return (
        f"transform(array(named_struct('t', {table}, 'u', {bytes_})), c -> transform(array(c.t), t -> "
        f"transform({words}, w -> transform(array(transform(w, b -> c.u[b])), p -> {one})[0]))[0])[0]"
    )


def _split(pattern: str, single: list[int], shared):
    words_of = regex.compile(pattern).findall

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        ids, counts, index = [], [], []
        total = 0

        def block() -> pa.RecordBatch:
            raw = [w.encode() for w in number]
            ready = [(i, merge_with_heap(w, single, shared.value)) for i, w in enumerate(raw) if len(w) > LONG]
            for i, _ in ready:
                raw[i] = b""
            ends = np.cumsum([0, *map(len, raw)]).astype(np.int32)
            codes = pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int32))
            each = pa.ListArray.from_arrays(pa.array(ends), codes)
            whole = pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), each)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())),
                    pa.array([np.concatenate(index).tobytes() if index else b""], pa.binary()), whole,
                    pa.array([[{"i": i, "ids": x} for i, x in ready]], pa.list_(pa.struct([("i", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
                ],
                names=["ids", "counts", "index", "words", "ready"],
            )
            number.clear(), ids.clear(), counts.clear(), index.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words_of(text)
                ids.append(doc_id)
                counts.append(len(found))
                index.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
                total += len(found)
                if total >= BLOCK_WORDS:
                    yield block()
                    total = 0
        if ids:
            yield block()

    return task


class _Merged(dict):
    """Tokens of each word met, made when first asked for; emptied at ``most`` words to stay small."""

    def __init__(self, single: list[int], pairs: dict[tuple[int, int], int], most: int = 500_000):
        super().__init__()
        self.single, self.pairs, self.most = single, pairs, most

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = [self.single[b] for b in raw]
        if len(ids) > LONG:
            ids = merge_with_heap(raw, self.single, self.pairs)
        rank_of = self.pairs.get
        while len(ids) > 1:
            ranks = [rank_of(p, NONE) for p in zip(ids, ids[1:], strict=False)]
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [best]
        if len(self) >= self.most:
            self.clear()
        out = self[word] = array("I", ids).tobytes()
        return out


def _encode(pattern: str, single: list[int], shared):
    words_of = regex.compile(pattern).findall

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged(single, shared.value)
        for batch in batches:
            for first in range(0, len(batch), 1000):
                lot = batch.slice(first, 1000)
                tokens = [b"".join(map(merged.__getitem__, words_of(t))) for t in lot.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([tokens], pa.list_(pa.binary()))],
                    names=["ids", "tokens"],
                )

    return task


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, native: bool = False, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of encoded documents: ids (identifiers), tokens (per document, 32-bit little-endian ids), in the rows' order.

    NULL text is empty and has no tokens.  Special tokens are ordinary text.  An empty table gives no blocks.
    """
    ranks = read_ranks(ranks_path)
    single = [ranks[bytes([b])] for b in range(256)]
    pairs = pair_ranks(ranks)
    shared = docs.sparkSession.sparkContext.broadcast(pairs)  # as many entries as the vocabulary has splits
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not native:
        return rows.mapInArrow(_encode(pattern, single, shared), "ids array<long>, tokens array<binary>")
    blocks = rows.mapInArrow(
        _split(pattern, single, shared),
        "ids array<long>, counts array<int>, index binary, words array<array<int>>, ready array<struct<i int, ids array<int>>>",
    )
    literal = f"'{rank_literal(pairs)}'"
    folded = blocks.select("ids", "counts", "index", "ready", F.expr(fold("words", literal, single)).alias("tokens"))
    return folded.mapInArrow(_restore, "ids array<long>, tokens array<binary>")


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the tokens of a block's words back in the order of its documents."""
    for batch in batches:
        for r in range(len(batch)):
            words = batch.column("tokens")[r].values
            lengths = np.diff(words.offsets.to_numpy()).astype(np.int64)
            values = words.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            for item in batch.column("ready")[r].as_py():
                # long words come ready; their place among the folded ones is empty
                at = int(lengths[: item["i"]].sum())
                values = np.concatenate([values[:at], np.array(item["ids"], "<u4"), values[at:]])
                lengths[item["i"]] = len(item["ids"])
            starts = np.cumsum(lengths) - lengths
            index = np.frombuffer(batch.column("index")[r].as_py(), np.int32)
            counts = batch.column("counts")[r].values.to_numpy()
            out, at = [], 0
            for n in counts.tolist():
                picked = index[at : at + n]
                size = lengths[picked]
                ends = np.cumsum(size)
                flat = np.repeat(starts[picked] - ends + size, size) + np.arange(int(ends[-1]) if n else 0)
                out.append(values[flat].tobytes())
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids").slice(r, 1), pa.array([out], pa.list_(pa.binary()))], names=["ids", "tokens"]
            )


def decode(blocks: DataFrame, ranks_path: str, column: str = "tokens") -> DataFrame:
    """One row per document of ``encode``: doc_id, tokens and decoded, the bytes of its tokens' pieces one after another."""
    ranks = read_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    shared = blocks.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        for batch in batches:
            for r in range(len(batch)):
                ids, tokens = batch.column("ids")[r].values, batch.column(column)[r].as_py()
                for first in range(0, len(tokens), 1000):
                    lot = tokens[first : first + 1000]
                    whole = [b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in lot]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, 1000), pa.array(lot, pa.binary()), pa.array(whole, pa.binary())],
                        names=["doc_id", "tokens", "decoded"],
                    )

    return blocks.mapInArrow(task, "doc_id long, tokens binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, then decode what was encoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, ranks_path, pattern), ranks_path)
    return both.select(
        "doc_id", F.expr("octet_length(tokens) div 4").cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
