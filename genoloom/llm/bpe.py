"""Byte-level BPE: merges in rounds over all distinct words of a chunk of documents, decoding by pieces."""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

ID_BITS = 17
NONE = (1 << ID_BITS) - 1  # no merge


@dataclass
class Vocabulary:
    """Ranks of byte strings. A token's rank is its id; two neighbours merge if their bytes together are a token."""

    ranks: dict[bytes, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def single_bytes(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def pairs(self) -> dict[int, dict[int, int]]:
        """left id -> {right id: rank of both together}"""
        out: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    out.setdefault(left, {})[right] = rank
        return out

    def pieces(self) -> list[bytes]:
        """The bytes of each id; none for an id that is no token's, and for one more at the end."""
        out = [b""] * (max(self.ranks.values()) + 2)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out


def rank_map(pairs: dict[int, dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pair ranks as one sparse table: row a starts at base[a]; slot base[a] + b holds (a, rank) or belongs to another row.

    A map column is searched from its start on every look-up; here a look-up is two array accesses.
    Rows are placed from the longest on; those of a single entry fill the slots that are left, in order.
    """
    base, table, used = np.full(max(pairs) + 1, -1 << 20, np.int64), {}, 0
    for left, row in sorted(((a, r) for a, r in pairs.items() if len(r) > 1), key=lambda x: (-len(x[1]), x[0])):
        low, taken, own = min(row), 0, 0
        for right in row:
            taken |= used >> (right - low)
            own |= 1 << (right - low)
        place = (~taken & taken + 1).bit_length() - 1  # the first place for ``low`` at which the slots of all are free, as bits
        used |= own << place
        base[left] = place - low
        table.update((place - low + right, left << ID_BITS | rank) for right, rank in row.items())
    rows = np.frombuffer(used.to_bytes(used.bit_length() // 8 + 1, "little"), np.uint8)
    single = np.array([(a, *next(iter(r.items()))) for a, r in pairs.items() if len(r) == 1], np.int64).reshape(-1, 3)
    taken = np.r_[np.unpackbits(rows, bitorder="little"), np.zeros(len(single), np.uint8)]
    slots = np.full(len(taken), -1, np.int64)
    slots[np.fromiter(table, np.int64, len(table))] = np.fromiter(table.values(), np.int64, len(table))
    place = np.flatnonzero(taken == 0)[: len(single)]
    base[single[:, 0]] = place - single[:, 1]
    slots[place] = single[:, 0] << ID_BITS | single[:, 2]
    return base, slots[: np.flatnonzero(slots >= 0)[-1] + 1] if (slots >= 0).any() else slots[:1]


class Merges:
    """The rank map, padded on both sides: any pair of ids is looked up by two array accesses."""

    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.ranks.values()) + 1
        if size > NONE:
            raise ValueError(f"ids from {NONE} on do not fit the rank map")
        base, slots = rank_map(vocabulary.pairs())
        self.base, self.slots = np.zeros(size, np.int64), np.full(len(slots) + 2 * size, -1, np.int64)
        has = np.flatnonzero(base > -size)
        self.base[has], self.slots[size : size + len(slots)] = base[has] + size, slots

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.slots[self.base[left] + right]
        return np.where(found >> ID_BITS == left, found & NONE, NONE).astype(np.int32)


def merged(ids: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words of equally many bytes, given as one row of ids each, one after the other; and their numbers.

    Each round merges in every word the leftmost pair of least rank and looks up the two pairs it
    makes. So the words of a round have equally many pieces; a word without a merge leaves.
    """
    out, sizes, rows = np.zeros(ids.shape, np.int32), np.zeros(len(ids), np.int64), np.arange(len(ids))
    rank = merges.ranks(ids[:, :-1], ids[:, 1:])
    while len(rows):
        width = ids.shape[1]
        least = rank.min(axis=1, initial=NONE)
        done = least == NONE
        out[rows[done], :width], sizes[rows[done]] = ids[done], width
        rows, ids, rank, least = rows[~done], ids[~done], rank[~done], least[~done]
        if not len(rows):
            break
        at, each = rank.argmin(axis=1), np.arange(len(rows))
        after = np.arange(width - 1) > at[:, None]
        ids = np.where(after, ids[:, 1:], ids[:, :-1])
        ids[each, at] = least
        rank = np.where(after[:, : width - 2], rank[:, 1:], rank[:, :-1])
        some = np.flatnonzero(at > 0)
        rank[some, at[some] - 1] = merges.ranks(ids[some, at[some] - 1], least[some])
        some = np.flatnonzero(at < width - 2)
        rank[some, at[some]] = merges.ranks(least[some], ids[some, at[some] + 1])
    return out[np.arange(out.shape[1]) < sizes[:, None]], sizes


def merged_long(ids: list[int], merges: Merges) -> list[int]:
    """Token ids of one word: its pairs in a heap by rank and place, so n letters cost n log n."""
    ahead, back, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    rank = merges.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist() + [NONE]
    heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
    heapq.heapify(heap)
    while heap:
        new, at = heapq.heappop(heap)
        if not alive[at] or rank[at] != new:
            continue  # one of its pieces has been merged since
        gone = ahead[at]
        ids[at], alive[gone], ahead[at] = new, False, ahead[gone]
        if ahead[at] < len(ids):
            back[ahead[at]] = at
        for i in (back[at], at):
            if i >= 0:
                rank[i] = int(merges.ranks(np.array([ids[i]]), np.array([ids[ahead[i]]]))[0]) if ahead[i] < len(ids) else NONE
                if rank[i] != NONE:
                    heapq.heappush(heap, (rank[i], i))
    return [i for i, a in zip(ids, alive, strict=True) if a]


def word_tokens(words: pa.Array, vocabulary: Vocabulary, single: np.ndarray, merges: Merges, rows: int = 1 << 15, short: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, sizes, tokens) of the words: a word that is a token is its id, others are merged from the ids of their bytes."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, get = np.frombuffer(data, np.uint8), vocabulary.ranks.get
    whole = np.concatenate([np.array([get(w, -1) for w in words.slice(at, rows).cast(pa.binary()).to_pylist()], np.int32) for at in range(0, len(words), rows)])
    begins, sizes, flat, n = np.zeros(len(words), np.int64), np.ones(len(words), np.int64), [], 0

    def put(some: np.ndarray, tokens: np.ndarray, own: np.ndarray) -> None:
        nonlocal n
        begins[some], sizes[some] = n + np.cumsum(own) - own, own
        flat.append(tokens)
        n += len(tokens)

    known = np.flatnonzero(whole >= 0)
    put(known, whole[known], np.ones(len(known), np.int64))
    lengths, rest = np.diff(offsets), np.flatnonzero(whole < 0)
    rest = rest[np.argsort(lengths[rest], kind="stable")]
    own, first = np.unique(lengths[rest], return_index=True)
    for length, a, b in zip(own.tolist(), first, np.append(first[1:], len(rest)), strict=False):
        for at in range(a, b, rows if length <= short else 1):
            some = rest[at : min(b, at + rows)] if length <= short else rest[at : at + 1]
            if length <= short:
                put(some, *merged(single[raw[offsets[some][:, None] + np.arange(length)]], merges))
            else:
                tokens = np.array(merged_long(single[raw[offsets[some[0]] : offsets[some[0]] + length]].tolist(), merges), np.int32)
                put(some, tokens, np.array([len(tokens)]))
    return begins, sizes, np.concatenate(flat)


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 32 << 20) -> DataFrame:
    """(id, tokens) per row of ``docs``; the words of a text are the matches of ``pattern``.

    Documents are taken in chunks of about ``chunk_bytes`` of words (an array offset included). A
    word is looked up whole, and merged if it is no token, once per chunk; nothing is shuffled, so no source, text or word can be hot and a
    lost task repeats its own chunks only.

    Cases: a null or empty text has no tokens; a text of any length is one array; ids of any type,
    null or repeated, pass through; other columns are ignored. Every byte must be in the vocabulary.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    unicode = "(?U)" + pattern  # \s then means all Unicode white space
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.regexp_extract_all(text, F.lit(unicode), F.lit(0)).alias("words"))
    kind, shared = words.schema["id"].dataType, docs.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.single_bytes(), Merges(vocabulary)))
    give_back()

    def tokens_of(ids: list, listed: list) -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array([x.flatten() for x in listed], pa.string()).dictionary_encode()  # one dictionary for all
        distinct = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.string())
        begins, sizes, flat = word_tokens(distinct, *shared.value)
        numbers, at = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in coded.chunks]]), 0
        del coded
        for own, words in zip(ids, listed, strict=True):
            cut = np.concatenate([[0], np.cumsum(np.diff(words.offsets.to_numpy()), dtype=np.int64)])
            some = numbers[at : at + cut[-1]]
            at += int(cut[-1])
            upto = np.concatenate([[0], np.cumsum(sizes[some])])
            where = np.repeat(begins[some] - upto[:-1], sizes[some]) + np.arange(upto[-1])
            yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(upto[cut], pa.int32()), pa.array(flat[where], pa.int32()))], ["id", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, listed, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids.append(batch.column(0).slice(at, 256))
                listed.append(batch.column(1).slice(at, 256))
                held += listed[-1].flatten().nbytes
                if held >= chunk_bytes:
                    yield from tokens_of(ids, listed)
                    ids, listed, held = [], [], 0
        if ids:
            yield from tokens_of(ids, listed)
        del ids, listed
        give_back()  # the worker stays and serves other stages

    return words.mapInArrow(run, f"id {kind.simpleString()}, tokens array<int>").withColumnRenamed("id", id_col)


def _each_joined(tokens: pa.Array, text_of, separator: bytes, finish=lambda joined: joined.cast(pa.binary()), rows: int = 256) -> pa.Array:
    """``finish`` of the joined texts of each array of ids; null for null. Some rows at a time, as the texts of single ids take many times their bytes."""
    out = []
    for at in range(0, max(len(tokens), 1), rows):
        some = tokens.slice(at, rows)
        sizes = pc.fill_null(pc.list_value_length(some), 0).to_numpy()
        listed = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), text_of(some.flatten()))
        joined = pc.binary_join(listed, pa.scalar(separator, pa.large_binary()))
        out.append(finish(pc.if_else(some.is_valid(), joined, pa.scalar(None, pa.large_binary())) if some.null_count else joined))
    whole = pa.concat_arrays(out)
    del out
    give_back()  # the worker lives on beside the one that merges
    return whole


def decode(tokens: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of an array of ids: the pieces of all ids, one after the other. An id without piece, or null, adds nothing."""
    shared = pa.array(vocabulary.pieces(), pa.large_binary())

    def of(ids: pa.Array) -> pa.Array:
        ids = pc.fill_null(ids, -1).to_numpy()
        return shared.take(pa.array(np.where((ids >= 0) & (ids < len(shared)), ids, len(shared) - 1)))

    return F.arrow_udf(lambda tokens: _each_joined(tokens, of, b""), "binary")(tokens)


def ids_digest(tokens: Column) -> Column:
    """SHA-256 in hex of the decimal ids of an array, joined by one space; nulls are left out."""

    def digests(joined: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() if x.is_valid else None for x in joined], pa.string())

    def run(tokens: pa.Array) -> pa.Array:
        if tokens.flatten().null_count:
            tokens = pa.array([x and [i for i in x if i is not None] for x in tokens.to_pylist()], tokens.type)
        return _each_joined(tokens, lambda ids: ids.cast(pa.large_string()).cast(pa.large_binary()), b" ", digests)

    return F.arrow_udf(run, "string")(tokens)


def token_report(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> DataFrame:
    out = encode(docs, vocabulary, pattern)
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), ids_digest(F.col("tokens")).alias("ids_sha256"), F.sha2(decode(F.col("tokens"), vocabulary), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.read(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_report(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
