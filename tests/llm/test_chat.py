import pytest

from llm_helpers import plain, same
from tramline.llm import chat
from tramline.llm.catalog import QUERIES

LOG = "conv_id bigint, turn bigint, copy bigint, seq bigint, kind string, role string, text string"


def test_fold_and_round_trip(spark):
    rows = [
        (1, 0, 1, 2, "delta", None, "lo"), (1, 0, 1, 1, "delta", "user", "hel"),
        (1, 1, 1, 1, "delta", "assistant", "bad"), (1, 1, 1, 2, "regenerate", "assistant", "go"),
        (1, 1, 1, 3, "delta", "assistant", "od"), (1, 2, 1, 1, "delta", "user", "x"), (1, 2, 1, 2, "edit", "user", "edited"),
        (1, 3, 1, 1, "delta", "user", "gone"), (1, 3, 1, 2, "delete", None, None),
        (1, 4, 1, 1, "delta", "user", "gone"), (1, 4, 1, 2, "delete", None, None), (1, 4, 1, 3, None, "user", "back"),
        (2, None, 1, None, None, None, None), (None, 0, 1, 1, "delta", "assistant", "<|end|>\\<|text|>\\\\$1<"),
    ]
    messages = chat.fold(spark.createDataFrame(rows, LOG))
    assert {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in messages.collect()} == {
        (1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "edited"), (1, 4): ("user", "back"),
        (2, None): ("", ""), (None, 0): ("assistant", "<|end|>\\<|text|>\\\\$1<")}
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(messages)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "hello"), ("assistant", "good"), ("user", "edited"), ("user", "back")]
    assert back[1]["loss_text"] == "good" and back[None]["loss_text"] == "<|end|>\\<|text|>\\\\$1<"
    assert back[1]["formatted"].startswith("<|start|>user<|text|>hello<|end|><|start|>assistant")


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\<|start|>\\\\", "a" * 5000 + "<|end|>", "é<|\n|>"])
def test_escape(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        chat.escaped(chat.F.col("t")).alias("e"), chat.unescaped(chat.escaped(chat.F.col("t"))).alias("u")).first()
    assert row["u"] == text and "<|" not in row["e"]


def test_odd_rows(spark, tmp_path, duck):
    schema = "conv_id bigint, turn bigint, role string, text string, copy int, piece string, seq string"
    rows = [(1, 0, "user", "a<|b\\", 0, "", ""), (1, 1, "assistant", None, 0, "", ""), (1, 1, "assistant", "same", 0, "", ""),
            (1, 1, "assistant", "same", 0, "", ""), (2, 0, None, "é" * 3000, 0, "", ""), (3, 5, "assistant", "w " * 100_000, 0, "", "")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i} \\<|", 0, "", "") for i in range(300)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    same(plain(QUERIES["op5_chat_format"](spark, f"{tmp_path}/a")), duck(chat.SQL, f"{tmp_path}/a", ["conversations"]))
    assert [r["conv_id"] for r in plain(QUERIES["op5_chat_format"](spark, f"{tmp_path}/b"))] == [-1]
