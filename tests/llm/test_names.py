"""Columns of any names pass through the stages of the pipeline; short benchmark items are found inside long documents."""

import pytest
from geobucket.llm.containment import contained_items, without_items
from geobucket.llm.guess_cost import redact_secrets
from geobucket.llm.probminhash import deduplicated
from geobucket.llm.quality import good_documents

EXTRA = ("__words", "__id", "__node", "__own", "__text", "words", "node", "id", "own", "a.b", "class", "h", "Node_", "r")


@pytest.fixture
def docs(spark):
    text = [" ".join(f"wörd{chr(97 + n // 20)}{chr(97 + n % 20)}" for n in range(60 * i, 60 * i + 40)) for i in range(4)]
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate([*text, text[0]])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.mark.parametrize("stage", ["dedup", "items", "quality", "secrets"])
def test_columns_of_any_name(spark, docs, stage):
    items = spark.createDataFrame([(1, "no such words anywhere at all")], "item_id long, text string")
    got = {"dedup": deduplicated, "items": lambda d: without_items(d, items), "quality": good_documents, "secrets": redact_secrets}[stage](docs)
    assert got.columns == docs.columns
    want = {tuple(r) for r in docs.collect() if stage != "dedup" or r.doc_id < 4}
    assert {tuple(r) for r in got.collect()} == want


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "once upon alpha beta gamma a time there was"), (2, "alpha gamma beta"), (3, "Alpha  Beta\nGAMMA"), (4, None), (5, "x alpha"), (6, "gamma delta " * 3000 + "last"), (7, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "last"), (3, "gamma delta gamma delta"), (4, None), (5, " "), (6, "one two three four five six seven"), (7, "upon alpha")], "item_id long, text string")
    assert sorted(tuple(r) for r in contained_items(docs, items).collect()) == [(1, 1, 1, 1, 1.0), (1, 7, 1, 1, 1.0), (3, 1, 1, 1, 1.0), (6, 2, 1, 1, 1.0), (6, 3, 1, 1, 1.0)]
    assert sorted(r.doc_id for r in without_items(docs, items).collect()) == [2, 4, 5, 7]
    assert contained_items(docs, items.limit(0)).count() == 0 and without_items(docs, items.limit(0)).count() == 7 and contained_items(docs.limit(0), items).count() == 0
