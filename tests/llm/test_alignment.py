"""Token alignment against the definition on whole texts, with fresh libraries."""

import hashlib
import os
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from geobucket.llm import alignment as A
from geobucket.llm.queries import op12_token_alignment, tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "\nline first", "ends with a line\n", "one\n\ntwo", "tab\tand space 　 wide", "▁ mark▁inside", "<|endoftext|> and </s> <unk>",
    "naïve café 日本語 テスト 🙂🙂 क्षि \u0000 � \x1c\x1f x", "x" * 700, "don't we'll I'd", "a,b;c|d ((e)) -- f", "same text here", "same text here", "​ zero ́ combining", "123 4567 890123",
]


@pytest.fixture(scope="module")
def libraries():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=FILES[1]), decoders


def tokens(text, libraries):
    """(id, end) of both kinds on the whole text; nothing where a side does not give it back."""
    a, b, _ = libraries
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    if not text:
        return [], []
    out = []
    for pairs in (
        [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)],
    ):
        if b"".join(x for _, x in pairs) != (" " + text).encode():
            return [], []
        out.append(list(zip([i for i, _ in pairs], np.cumsum([len(x) for _, x in pairs]).tolist())))
    return out


def by_definition(rows, libraries):
    found, count = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text, libraries)
        links = [(i, j) for i, e in a for j, f in b if e == f] if len(a) < 300 else [(i, dict((f, j) for j, f in b)[e]) for i, e in a if e in {f for _, f in b}]
        both, groups, x, y = sorted({e for _, e in a} & {f for _, f in b}), [], 0, 0
        for cut in both:
            own = [[], []]
            while x < len(a) and a[x][1] <= cut:
                own[0].append(a[x][0])
                x += 1
            while y < len(b) and b[y][1] <= cut:
                own[1].append(b[y][0])
                y += 1
            groups.append("|".join(",".join(map(str, k)) for k in own))
        count.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return sorted((d, n, m, len(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for d, n, m, g, k in found)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_odd_texts(spark, libraries):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, links long").repartition(3)
    assert sorted(A.alignment_table(docs, *FILES).select(*COLUMNS).collect()) == by_definition(rows, libraries)
    assert A.alignment_table(docs.limit(0), *FILES).count() == 0


def test_corpus(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(op12_token_alignment(spark, sf).select(*COLUMNS).collect()) == by_definition(rows, libraries)


def test_blocks_and_memory(libraries, monkeypatch):
    """Blocks cut inside a long chunk, and remembered chunks, change nothing."""
    texts = ["abcdefgh" * 60, "the cat, the dog " * 30 + "end", "x\n\ny " * 40]
    whole = A.Aligner(*FILES)
    monkeypatch.setattr(A, "TOKENS", 7)
    monkeypatch.setattr(A, "CALL", 3)
    small = A.Aligner(*FILES)
    for text in (*texts, *texts):
        results = []
        for own in (whole, small):
            parts, wide, numbers, _ = A.chunked(pa.array([text]))
            chunks = own.parts(parts, np.bincount(numbers, minlength=len(parts))[: len(parts)] > 1).with_more(own.wide(wide))
            results.append((";".join(chunks.groups.take(pa.array(numbers)).to_pylist()), chunks.n_a[numbers].sum(), chunks.links.tolist()))
        assert results[0] == results[1]
    assert len(whole.known) == len(small.known) > 0
    assert whole.pairs.keys.size < 1 << 20


class Taken:
    """A DataFrame that hands over the function given to mapInArrow."""

    def __getitem__(self, name):
        return self

    def cast(self, kind):
        return self

    def alias(self, name):
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_memory_of_a_batch():
    """A batch is aligned in slices of texts, so what a worker holds at once does not follow the batch."""
    words = np.array(pa.compute.split_pattern("the of and alignment tokenizer bytes, group; links counts corpus. many words", " ").as_py())
    own = np.random.default_rng(1)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": [" ".join(own.choice(words, 400)) for _ in range(1000)]})
    align = A.aligned_documents(Taken(), *FILES)
    A.aligner_of(*FILES)
    tracemalloc.start()
    rows = sum(b.num_rows for b in align(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1001 and most < 15 << 20
