"""Decontamination by a benchmark of many short items."""

import random

from leafmark.llm import decontam


def test_every_verbatim_item_of_a_large_benchmark_is_found(spark):
    r = random.Random(11)
    vocab = ["".join(r.choice(["ta", "ro", "mi", "len", "su", "ke"]) for _ in range(r.randrange(2, 5))) for _ in range(900)]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(12))) for i in range(700)] + [(700 + i, " ".join(prose(6))) for i in range(50)]
    rows = [" ".join(prose(60) + t.split() + prose(60)) for _, t in items] + [" ".join(prose(130)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()}
    assert found == {(i, i) for i, _ in items}
    assert {x["doc_id"] for x in decontam.keep_clean(docs, bench).collect()} == set(range(750, 800))
