"""The chain of the corpus pipeline on documents with every odd case, stage by stage."""

import random

import corpus_pipeline
import pytest
from leafmark.storage import materialize


def corpus():
    r = random.Random(11)
    vocab = {"en": [f"the{i}ing" for i in range(80)], "xx": [f"zo{i}ka" for i in range(80)]}
    prose = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    rows = [(i, prose(lang, 60), lang) for i, lang in enumerate(["en", "xx"] * 20)]
    item = prose("en", 30)
    long = prose("en", 40)
    rows += [
        (100, None, "en"), (101, "", None), (102, "12 34 !!", "en"), (None, prose("en", 30), None), (103, rows[0][1], "en"), (104, f"{prose('en', 20)} {item} {prose('en', 20)}", "en"),
        (105, f"{long}\n{prose('en', 12)}", "en"), (106, f"{prose('xx', 12)}\n{long}", "xx"), (107, "\n".join(prose("en", 8) for _ in range(4000)), "en"), (7, rows[7][1], "xx"),
    ]
    return rows, item


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, item = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, len(t or ""), {"a": 1}, 5) for i, t, lang in rows], "doc_id long, text string, lang string, n_chars long, m map<string,int>, `x.y` int").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, folder), name)
        out.append(now)
    return folder, docs, out


def test_stages_keep_columns_and_clean_documents(stages):
    _, docs, out = stages
    assert all(sorted(s.columns) == sorted(docs.columns) for s in out[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in out]
    assert not {100, 101, 102} & ids[0] and set(range(40)) | {None, 103, 107} <= ids[0]
    # Texts of one line that are long go with their later copies.
    assert 103 not in ids[1] and set(range(40)) | {None, 104, 105, 106, 107} <= ids[1]
    assert {r["text"].count("\n") for r in out[1].where("doc_id IN (105, 106)").collect()} == {0, 1}
    assert ids[2] >= set(range(40)) | {104, 107}
    assert ids[3] == ids[2] - {104}


def test_packing_takes_all_that_is_left(spark, stages):
    folder, _, out = stages
    packed = out[-1].groupBy("sequence_id").sum("length").collect()
    assert max(r["sum(length)"] for r in packed) <= 4096
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect()), key=str) == sorted(map(tuple, out[-1].select(key).collect()), key=str)


def test_empty_table(spark, tmp_path, stages):
    _, docs, _ = stages
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
