"""Cost-balanced packing of tokenized documents into sequences.

A document's ids are followed by one end id. Documents longer than a sequence are cut into
full pieces and a rest. Pieces are dealt to shards by a hash (of document, start and the
row's place in its input task, so a document that is repeated does not fill one shard). In a
shard, the number of sequences is its tokens over the capacity, rounded up. Pieces go in
descending order of length, each to the sequence of the lowest cost among those with room,
where a piece of n tokens costs ``linear * n + quadratic * n * n`` (feed-forward and
attention within the piece). A piece that fits nowhere whole is cut to fill the emptiest
sequences, as long as that gives parts of ``least_cut`` ids or more; else one more sequence
is opened.

Ids are shuffled, two bytes each, only for pieces that may be cut once more. The number of shards follows the number of
characters, so a shard's rows stay about ``rows_a_shard`` at any input size.

A batch of texts is split into the words of the file's pattern by columns, and each different word
of about ``SLICE`` bytes is encoded once. Texts with characters whose class is not the same in all
versions of Unicode since 3.2, or above U+FFFF, or with names of added tokens are encoded one by one.

Defined cases: null and empty texts are the end id alone; repeated rows and ids are packed
each on their own; null ids are kept; an empty table gives no rows; other columns are not
looked at. Strings that name added tokens of the file become those tokens' ids, as by the
tokenizers library's own defaults. The vocabulary has to have at most 65,536 ids.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import shingles
from tramline.llm.common import table

CAPACITY = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
ROWS_A_SHARD = 20_000
CHARS_A_TOKEN = 2.5   # only for the number of shards
END_ID = 0

LEAST_CUT = 64
# Tiktoken's pattern recurses on white space, so longer runs of it go to the tokenizers library.
LONG_SPACE = re.compile(r"\s{10000}")

SLICE = 1 << 21   # bytes of text whose words are encoded together
UNSURE, LETTER, NUMBER, OTHER, SPACE = range(5)
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "ordinal bigint, ids binary")
PACKED = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence bigint, offset bigint, ids binary")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: same ids, four times the speed.

    A token's rank in the merges is its id in such files; special tokens are left out.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["content"] for t in told.get("added_tokens", ())}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items()
             if token not in special}
    return tiktoken.Encoding(
        "file", mergeable_ranks=ranks, special_tokens={}, pat_str=(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"))


@functools.lru_cache(maxsize=2)
def added(path: str):
    """A pattern of the file's added tokens (None without any) and the tokenizers library's own encoder."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        names = [re.escape(t["content"]) for t in json.load(file).get("added_tokens", ())]
    return re.compile("|".join(names)) if names else None, Tokenizer.from_file(path)


def token_ids(text: str | None, path: str, special: bool = False) -> np.ndarray:
    """Ids and the end id; ``special``: names of added tokens in the text are those tokens."""
    known, library = added(path)
    if text and (special and known and known.search(text) or LONG_SPACE.search(text)):
        found = library.encode(text, add_special_tokens=False).ids
    else:
        found = encoder(path).encode_ordinary(text) if text else []
    return np.array([*found, END_ID], dtype="<u4")


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point up to U+FFFF in the pattern; UNSURE where versions of Unicode differ."""
    found = np.full(1 << 16, UNSURE, dtype=np.uint8)
    for code in range(1 << 16):
        category = unicodedata.category(chr(code))
        if category == unicodedata.ucd_3_2_0.category(chr(code)) and category not in ("Cn", "Co", "Cs"):
            found[code] = {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)
    found[SPACES] = SPACE
    return found


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each UTF-8 byte's character; UNSURE above U+FFFF."""
    found = np.append(kinds()[:128], np.zeros(128, np.uint8))[data]
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    for n, mask in ((2, 0x1F), (3, 0x0F)):
        at = lead[size == n]
        code = data[at].astype(np.int32) & mask
        for step in range(1, n):
            code = code << 6 | data[at + step] & 0x3F
        kind = kinds()[code]
        for step in range(n):
            found[at + step] = kind
    return found


def words_of(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the pattern begins in the bytes of the rows; rows that may be split otherwise."""
    at, rows = int(offsets[0]), offsets - offsets[0]
    data = values[at:int(offsets[-1])]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds_of(data)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[rows] = True
    first, last = first[:-1], first[1:]
    space, blank = kind == SPACE, data == 0x20
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = (kind[1:] != kind[:-1]) & (space[1:] | ~blank[:-1])   # one blank goes with what follows it
    alone = np.flatnonzero(space[:-1] & ~space[1:] & ~last[:-1])   # of white space before a word, the last character
    while len(inside := np.flatnonzero((data[alone] & 0xC0) == 0x80)):
        alone[inside] -= 1
    begin[alone] = True
    begin[first] = True
    mark = np.flatnonzero(data == 0x27)
    mark = mark[first[mark] | (kind[mark - 1] != OTHER) & ~blank[mark - 1]]
    end = rows[np.searchsorted(rows, mark, side="right")]
    after = lambda step: np.where(mark + step < len(data), data[np.minimum(mark + step, len(data) - 1)], 0)
    one, two = after(1), after(2)
    short = np.isin(one, list(b"stmd")) & (mark + 1 < end)
    long = np.isin(one.astype(np.int32) << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]) & (mark + 2 < end)
    begin[mark[short | long] + 1] = False
    rest = np.concatenate([mark[short] + 2, mark[long] + 3])
    begin[rest[rest < len(data)]] = True
    unsure = np.unique(np.searchsorted(rows, np.flatnonzero(kind == UNSURE), side="right") - 1)
    return np.flatnonzero(begin) + at, unsure


def ids_of_rows(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """``token_ids`` with names of added tokens, for each row of a string column."""
    values, offsets = shingles.buffers(column)
    begins, unsure = words_of(values, offsets)
    names, _ = added(path)
    if names:
        named = pc.fill_null(pc.match_substring_regex(column, names.pattern), False)
        unsure = np.union1d(unsure, np.flatnonzero(named.to_numpy(zero_copy_only=False)))
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [
        None, pa.py_buffer(np.append(begins, offsets[-1])), pa.py_buffer(values)]).dictionary_encode()
    encode, sizes, found = encoder(path)._core_bpe.encode_single_piece, [], []
    for different in words.dictionary.to_numpy(zero_copy_only=False).tolist():
        ids = encode(different)
        sizes.append(len(ids))
        found += ids
    many, flat = np.array(sizes, dtype=np.int64), np.array(found, dtype="<u4")
    word = words.indices.to_numpy()
    size = many[word]
    end = np.cumsum(size)
    ids = flat[np.repeat((np.cumsum(many) - many)[word] - (end - size), size) + np.arange(int(size.sum()))]
    row_end = np.concatenate([[0], end])[np.searchsorted(begins, offsets)]
    single = set(unsure.tolist())
    for row in range(len(column)):
        if row in single:
            yield token_ids(column[row].as_py(), path, special=True)
        else:
            yield np.append(ids[row_end[row]:row_end[row + 1]], np.uint32(END_ID))


def pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int,
              all_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``capacity`` ids; the ids go along where a piece may be cut again."""
    schema = pa.schema([(name, pa.int64()) for name in (
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ordinal")] + [("ids", pa.binary())])
    ordinal = 0
    for part in (p for batch in batches for p in shingles.slices(batch, 1, SLICE)):
        out: list[tuple] = []
        for key, ids in zip(part.column(0).to_pylist(), ids_of_rows(part.column(1), path)):
            for start in range(0, len(ids), capacity):
                cut = ids[start:start + capacity]
                out.append((key, start, len(cut), zlib.crc32(cut), len(ids), ordinal,
                            cut.astype("<u2").tobytes() if all_ids or len(cut) < capacity else None))
            ordinal += 1
        pa.default_memory_pool().release_unused()   # else a worker keeps what its largest slice took
        columns = zip(*out) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Sequences:
    """Sequences by room left and cost, to find the cheapest one with enough room."""

    def __init__(self, capacity: int, linear: float, quadratic: float):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.by_room: list[list] = [[] for _ in range(capacity + 1)]
        self.cheapest = np.full(capacity + 1, np.inf)
        self.count = 0

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.by_room[room], (cost, sequence))
            self.cheapest[room] = self.by_room[room][0][0]

    def open(self, n: int = 1) -> None:
        for _ in range(n):
            self.put(self.capacity, 0.0, self.count)
            self.count += 1

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Put n ids into the cheapest sequence with just this room: sequence, offset."""
        cost, sequence = heapq.heappop(self.by_room[room])
        self.cheapest[room] = self.by_room[room][0][0] if self.by_room[room] else np.inf
        self.put(room - n, cost + self.linear * n + self.quadratic * n * n, sequence)
        return sequence, self.capacity - room

    def roomy(self, n: int) -> int:
        """Room of the cheapest sequence with room for n; -1 if there is none."""
        room = n + int(np.argmin(self.cheapest[n:]))
        return room if np.isfinite(self.cheapest[room]) else -1

    def most(self) -> int:
        found = np.flatnonzero(np.isfinite(self.cheapest))
        return int(found[-1]) if len(found) else 0


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC,
           least_cut: int = LEAST_CUT) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for pieces given in descending length."""
    sequences = Sequences(capacity, linear, quadratic)
    sequences.open(-(-sum(lengths) // capacity))
    placed, left = [], []
    for piece, n in enumerate(lengths):
        room = sequences.roomy(n)
        if room < 0:
            left.append((piece, n))
        else:
            placed.append((piece, 0, n, *sequences.take(room, n)))
    for piece, n in left:
        start = 0
        while start < n:
            room = sequences.most()
            if room < min(n - start, least_cut):
                sequences.open()
                continue
            part = min(n - start, room)
            placed.append((piece, start, part, *sequences.take(room, part)))
            start += part
    return placed


def pack_shard(shard: pd.DataFrame, capacity: int, linear: float, quadratic: float,
               least_cut: int) -> pd.DataFrame:
    shard = shard.sort_values(["length", "doc_id", "start", "ordinal"],
                              ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    placed = assign(shard["length"].tolist(), capacity, linear, quadratic, least_cut)
    piece, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*placed))
    out = shard.take(piece).reset_index(drop=True)
    whole = length == out["length"].to_numpy()
    for i in np.flatnonzero(~whole):
        ids = np.frombuffer(out.at[i, "ids"], dtype="<u2")[start[i]:start[i] + length[i]]
        out.at[i, "ids"] = ids.tobytes()
        out.at[i, "ids_crc32"] = zlib.crc32(ids.astype("<u4").tobytes())
    return out.assign(start=out["start"] + start, length=length, sequence=sequence, offset=offset)[
        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids"]]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None,
         capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC,
         least_cut: int = LEAST_CUT, rows_a_shard: int = ROWS_A_SHARD, ids: bool = False) -> DataFrame:
    """Placed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``ids`` also the piece's ids (little-endian, two bytes each).
    """
    path = path or vocabulary()
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    shards = max(1, round((rows + chars / CHARS_A_TOKEN / capacity) / rows_a_shard + 0.5))
    pieces = docs.mapInArrow(lambda b: pieces_of(b, path, capacity, ids), PIECES)
    placed = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ordinal"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(lambda number, g: pack_shard(g, capacity, linear, quadratic, least_cut).assign(
            shard=number[0]), PACKED + ", shard bigint")
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft("shard", 32) + F.col("sequence")).alias("sequence_id"), "offset",
        *(["ids"] if ids else []))


def op10_packing(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
