import random

import corpus_pipeline
from llm_helpers import PROSE, expected, odd_rows
from tramline.llm import mixing


def run_stages(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    return out


def test_stages_take_effect(spark, documents):
    rng = random.Random(8)
    words = PROSE.split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1].upper(), "en", "s0") for i in range(10)]            # copies
    rows += [(300, "Это совсем другой язык и другая азбука " * 4, None, "s1")]       # another script
    rows += [(299, PROSE + " Mail jo@mail.example.org today.", "en", "s1")]
    folder = documents(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, language, unique, clean, mixed, packed = run_stages(spark, docs, folder)
    assert all(frame.columns == docs.columns for frame in (language, unique, clean, mixed))
    ids = lambda frame: sorted(r["doc_id"] for r in frame.select("doc_id").collect())
    assert ids(language) == sorted(k for k, *_ in rows if k != 300)
    groups = expected({k: t for k, t, *_ in rows if k != 300})
    assert ids(unique) == sorted({c for _, c in groups.values()})
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "[EMAIL]" in texts[299] and "jo@mail" not in texts[299]
    assert all(texts[k] == t for k, t, *_ in rows if k in texts and k != 299)
    told = {r["doc_id"]: r["mix"] for r in mixing.mix(clean).collect()}
    counted = {}
    for r in mixed.collect():
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + len(r["text"].split())
    assert counted == {k: m["taken"] for k, m in told.items() if m["taken"]}
    assert packed.agg({"length": "sum"}).first()[0] > 0 and set(ids(packed)) == set(ids(mixed))


def test_run_reads_documents(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id"} <= set(rows[0].asDict())


def test_odd_rows(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    frames = run_stages(spark, docs, odd)
    assert frames[0].count() == len(odd_rows()) and all(f.count() >= 0 for f in frames)
    assert all(f.count() == 0 for f in run_stages(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty))
