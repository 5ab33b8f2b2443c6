"""The corpus pipeline against plain versions of its stages."""

from collections import Counter

import corpus_pipeline as cp
from recolith.scratch import cut
from tests.conftest import SF
from tests.llm.test_text_operators import brute_classes


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cut(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == names
    before, after = seen["near_duplicates"]
    want = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in want.items() if i == c}
    before, after = seen["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in after.collect()}
    assert all((r["doc_id"] in kept) != any(x in r["text"] for x in items) for r in before.collect())
    mixed = Counter(r["doc_id"] for r in seen["mixing"][1].collect())
    assert mixed and max(mixed.values()) <= 3
    last = seen["token_ids"][1].collect()
    assert Counter(r["doc_id"] for r in last) == mixed
    assert sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)
    assert cp.run(spark, SF).count() == len(last)


def test_queries_import():
    import __spark_entry__ as e

    q = e.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {x.split("_")[0] for x in q} and "pipeline" in q
