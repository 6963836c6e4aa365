"""What the pipeline's stages send to Python workers and hold there."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from geobucket.llm import sentencepiece_sa
from geobucket.llm.containment import ItemIndex, without_items
from geobucket.llm.guess_cost import redact_secrets


def prose(rows: int, words: int) -> list[str]:
    own = np.random.default_rng(1)
    known = [f"{a}{b}{c}" for a in ("ba", "ko", "li", "mu") for b in ("ne", "ro", "si") for c in ("ta", "ve", "xi", "zo")]
    return [" ".join(own.choice(known, words)) for _ in range(rows)]


def moved(df) -> tuple[int, int]:
    """Bytes that collecting df sent to Python workers and got from them."""
    df.collect()
    sent, got, plans = 0, 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        metrics, below = plan.metrics(), plan.children()
        if metrics.contains("pythonDataSent"):
            sent, got = sent + metrics.apply("pythonDataSent").value(), got + metrics.apply("pythonDataReceived").value()
        plans += [below.apply(k) for k in range(below.size())]
    return sent, got


@pytest.mark.parametrize("stage", ["items", "secrets"])
def test_texts_are_sent_once_and_stay_in_spark(spark, stage):
    texts = prose(800, 500)
    size = sum(map(len, texts))
    texts[7] += " alpha beta gamma delta epsilon zeta password = Xk29fQz81LmPw0"
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").coalesce(2)
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = without_items(docs, items) if stage == "items" else redact_secrets(docs)
    sent, got = moved(rows)
    assert size < sent < 1.2 * size and got < size / 20
    changed = {r.doc_id: (r.text, r.n_chars) for r in rows.collect() if r.doc_id != 7}
    assert changed == {k: (t, len(t)) for k, t in enumerate(texts) if k != 7}
    last = [r for r in rows.collect() if r.doc_id == 7]
    assert [(r.text, r.n_chars) for r in last] == ([] if stage == "items" else [(texts[7][:-14] + "[SECRET]", len(texts[7]) - 6)])


class Taken:
    """A table of which only the function for its batches matters."""

    def __getitem__(self, column):
        return self

    def cast(self, kind):
        return self

    alias = cast

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_memory_of_a_batch_that_is_encoded():
    texts = prose(700, 500)
    encode = sentencepiece_sa.encode_documents(Taken(), file := public_tokenizers.path("piece_bpe_32k.model"))
    sentencepiece_sa.pieces_of(file)
    tracemalloc.start()
    rows = sum(b.num_rows for b in encode(iter([pa.RecordBatch.from_pydict({"doc_id": range(700), "text": texts})])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 700 and most < 8 << 20
