"""Line dedup against a plain reading of its rule."""

import random
import time

import duckdb
import pytest

from leafmark.llm import linededup


def brute(texts):
    """Kept text of each document, from the definition alone: runs that start earlier too."""
    told = [[(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")] for t in texts]
    earlier, out = set(), []
    for own, t in zip(told, texts, strict=True):
        gone = set()
        for p in range(len(own)):
            for q in range(p + 1, len(own) + 1):
                run = tuple(x for _, x in own[p:q])
                if q - p >= 2 or len(run[0].split()) >= linededup.LONG:
                    if run in earlier:
                        gone |= {i for i, _ in own[p:q]}
                    earlier.add(run)
        out.append(t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return out


def corpus(seed):
    r = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(25)] + ["", "  "]
    pool += [" ".join(f"w{i}{k}" for k in range(n)) for i in range(4) for n in (24, 25, 40)]
    runs = [[r.choice(pool) for _ in range(r.randrange(2, 7))] for _ in range(8)]
    texts = [None, "", "\n\n", "a\n" * 9, "one line"]
    for _ in range(60):
        own = []
        for _ in range(r.randrange(0, 4)):
            own += r.choice(runs) if r.random() < 0.6 else [f"own {r.random()}"]
        texts.append("\n".join(own))
    return [*texts, texts[20], texts[30]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force_and_sql(spark, seed, tmp_path):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = linededup.dedupe(docs.selectExpr("*", "1 AS gone", "2 AS d", "'x' AS h")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == brute(texts)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(map(tuple, got), key=lambda x: x[0]) == sorted(duckdb.sql(linededup.SQL).fetchall(), key=lambda x: x[0])


def test_stage_keeps_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b\nc d\ne f", "en", 11), (1, "a b\nc d\ne f", "en", 11), (2, "a b\nc d\ne f", None, 11), (None, "g h\ni j", "en", 7), (3, "g h\ni j\nk", "en", 9), (4, None, None, None)], "doc_id long, text string, d string, n_chars long")
    got = linededup.stage(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([tuple(r) for r in docs.collect() if r["doc_id"] not in (2, 3)] + [(3, "k", "en", 1)], key=str)
    assert linededup.stage(docs.limit(0)).collect() == []


def test_the_longer_run_elsewhere_counts(spark):
    """The first place of a fingerprint has two of the lines only; a later one has all three."""
    for names in ("abcxy", "pqrst", "klmno", "efghi"):
        a, b, c, x, y = names
        texts = ["\n".join(t) for t in ([x, a, b, y], [a, b, c], [a, b, c])]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert [r["text"] for r in linededup.dedupe(docs).orderBy("doc_id").collect()] == [texts[0], c, ""]


def test_long_lines_and_single_line_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long), (2, f"own\n{long}\nother"), (3, f"own\n{long}"), (4, "short line"), (5, "short line"), (6, long + " ")], "doc_id long, text string")
    assert [r["text"] for r in linededup.dedupe(docs).orderBy("doc_id").collect()] == [long, "own\nother", "", "short line", "short line", long + " "]


def test_columns_of_any_kind_and_name(spark):
    docs = spark.sql("SELECT * FROM VALUES (1L, 'a\nb\nc', map('k', 1), 5), (2L, 'a\nb\nc', map('k', 2), 6), (3L, 'z', null, 7) AS t(doc_id, text, m, `x.y`)")
    got = linededup.stage(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["x.y"]) for r in got.collect()) == [(1, 5), (3, 7)]


def test_one_long_text_is_linear(spark):
    took = []
    for n in (4_000, 32_000):
        text = "\n".join(f"line {i}" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        began = time.time()
        assert sorted(r["n_removed"] for r in linededup.dedupe(docs).collect()) == [0, n]
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5
