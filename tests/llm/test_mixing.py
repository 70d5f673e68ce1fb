import pytest

from llm_helpers import PROSE, odd_rows, plain, same
from tramline.llm import mixing
from tramline.llm.catalog import QUERIES


def test_odd_rows(spark, odd, empty, duck):
    got = plain(QUERIES["op6_mix_sources"](spark, odd))
    assert len(got) == len(odd_rows())
    same(got, duck(mixing.SQL, odd))
    assert plain(QUERIES["op6_mix_sources"](spark, empty)) == []


def test_targets_cuts_and_reruns(spark, documents, duck):
    rows = [(i, " ".join(["w"] * (i % 50 + 1)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    folder = documents(rows)
    got = plain(QUERIES["op6_mix_sources"](spark, folder))
    same(got, duck(mixing.SQL, folder))
    assert plain(QUERIES["op6_mix_sources"](spark, folder)) == got
    source = {r[0]: r[3] for r in rows}
    for name in set(source.values()):
        mine = [r for r in got if source[r["doc_id"]] == name]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=1)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    assert sum({source[r["doc_id"]]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))


def test_take_gives_the_words(spark, documents):
    folder = documents([(i, f" {PROSE}\n{i} end ", "en", f"s{i % 4}") for i in range(60)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    mixed = mixing.mix(docs)
    taken = {r["doc_id"]: r["mix"]["taken"] for r in mixed.collect()}
    rows = mixing.take(mixed).collect()
    words = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {k: v for k, v in taken.items() if v}


def test_plan_has_no_python(spark):
    plan = QUERIES["op6_mix_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
