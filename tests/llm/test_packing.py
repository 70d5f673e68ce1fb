import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_helpers import odd_rows, plain
from tramline.llm import packing
from tramline.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    known = Tokenizer.from_file(packing.vocabulary())
    known.encode_special_tokens = True
    return known


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_same_ids_as_the_tokenizers_library(spark, tokenizer):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    texts += ["", " ", "\n\n  a\t b", "<|endoftext|>", "don't I'LL 12³ ①", "日本語 и ещё", "a" * 3000, "  x", "😀👍🏽", "\x00\x01", "é"]
    for text in texts:
        assert packing.token_ids(text, packing.vocabulary()).tolist() == ids_of(tokenizer, text)


def test_pieces_hold_every_id_once(spark, odd, tokenizer):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = packing.pack(docs, ids=True, capacity=256, rows_a_shard=5).collect()
    by_sequence = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] and zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    wanted = [(k, i) for k, t, *_ in odd_rows() for i in ids_of(tokenizer, t)]
    got = [(r["doc_id"], int(i)) for r in rows for i in np.frombuffer(r["ids"], "<u2")]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    for key, text, *_ in odd_rows():
        if key in (8, 9, 10):
            mine = sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["start"])
            assert b"".join(r["ids"] for r in mine) == np.array(ids_of(tokenizer, text), "<u2").tobytes()


def test_little_padding_and_balanced_cost(spark):
    rows = QUERIES["op10_packing"](spark, "/root/testdata/sf0.01").collect()
    total, sequences = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert total >= 0.97 * packing.CAPACITY * sequences


def test_assign_follows_the_rule():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 100, 400).tolist(), reverse=True)
    placed = packing.assign(lengths, 128)
    cost, room, seen = {}, {}, 0
    count = -(-sum(lengths) // 128)
    for piece, start, n, sequence, offset in placed:
        room.setdefault(sequence, 128)
        assert offset == 128 - room[sequence] and n <= room[sequence]
        if n == lengths[piece] and sequence < count and start == 0 and seen == piece:
            fits = [cost.get(s, 0.0) for s in range(count) if room.get(s, 128) >= n]
            assert cost.get(sequence, 0.0) == min(fits)
            seen += 1
        room[sequence] -= n
        cost[sequence] = cost.get(sequence, 0.0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    assert seen > 300
    whole = {}
    for piece, start, n, *_ in placed:
        whole[piece] = whole.get(piece, 0) + n
    assert whole == dict(enumerate(lengths))


def test_empty(spark, empty):
    assert plain(QUERIES["op10_packing"](spark, empty)) == []


def test_added_tokens_as_by_the_library(spark, documents):
    """The ids of the query are those of the tokenizers library's defaults."""
    library = Tokenizer.from_file(packing.vocabulary())
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "x<|endoftext|><|endoftext|>y " * 40, 4: "<|endoftext> |", 5: "plain"}
    folder = documents([(k, t, "en", "a") for k, t in texts.items()])
    rows = {r["doc_id"]: r for r in plain(QUERIES["op10_packing"](spark, folder))}
    for key, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert rows[key]["doc_tokens"] == len(ids) == rows[key]["length"]
        assert rows[key]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_long_runs(tokenizer):
    """Runs of one character that are longer than a pattern's stack, as by the library's defaults."""
    plain_library = Tokenizer.from_file(packing.vocabulary())
    for text in (" " * 1_500_000, "a " + " \n" * 400_000 + "b", "7" * 500_000, "x" * 500_000, "!" * 500_000, "\t" * 9_999 + "y"):
        assert packing.token_ids(text, packing.vocabulary(), special=True).tolist() == [
            *plain_library.encode(text, add_special_tokens=False).ids, packing.END_ID]


def by_rows(texts):
    return [ids.tolist() for ids in packing.ids_of_rows(pa.array(texts, pa.string()), packing.vocabulary())]


def by_texts(texts):
    return [packing.token_ids(t, packing.vocabulary(), special=True).tolist() for t in texts]


def test_words_of_a_batch_have_the_ids_of_whole_texts():
    """Splitting by columns follows the pattern: contractions, blanks, white space, any character."""
    parts = ["'", "s", "re", "ll", "'t", "'ve", "d", "m", " ", "  ", "\n", "\t", "\xa0", "\u3000", "1", "²", "!", "é", "я", "漢",
             "’", "…", "<|endoftext|>", "😀", "\u0378", "\r\n", "ab", "\x1c", "\x85"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += [None, "", " ", "'", "'s", "a'", "a'r", "a're", " " * 30000 + "x", "x" * 30000, None]
    assert by_rows(texts) == by_texts(texts)
    assert by_rows([]) == [] and by_rows([None]) == by_texts([None])
    points = [chr(c) for c in np.flatnonzero(packing.kinds() != packing.UNSURE)]
    texts = [f"a{c}b1{c} {c}{c} x{c}'s {c}'re\n{c}2" for c in points]
    assert by_rows(texts) == by_texts(texts)


def test_each_word_of_a_batch_is_encoded_once(monkeypatch):
    real, seen = packing.encoder(packing.vocabulary()), []

    class Counting:
        def __init__(self):
            self._core_bpe = self

        def encode_single_piece(self, piece):
            seen.append(len(piece))
            return real._core_bpe.encode_single_piece(piece)

        def encode_ordinary(self, text):
            seen.append(len(text.encode()))
            return real.encode_ordinary(text)

    monkeypatch.setattr(packing, "encoder", lambda path: Counting())
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["some", "words", "été", "12", "don't"]) for _ in range(300)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(packing.pieces_of(iter([batch]), packing.vocabulary(), 1024, True)).to_pylist()
    assert sum(seen) < 200
    for row in rows:
        ids = real.encode_ordinary(texts[row["doc_id"]]) + [packing.END_ID]
        assert np.frombuffer(row["ids"], "<u2").tolist() == ids[row["start"]:row["start"] + row["length"]]
