"""Values of letters only are judged by their cost, against the words of the documents."""

import math
from collections import Counter

from geobucket.llm import guess_cost

SECRETS = ["pwd = kTqWzXvBnRfJ", 'passphrase: "QwXzKvRtPmLs"', "token=qZkWvXpJ"]
PLAIN = ["token = get_token()", "password: sunflowers", "secret: Verwaltung", "pwd: notwendigkeit"]
PROSE = "please get the sunflowers from Verwaltung and the notwendigkeit of it"


def test_letters_only(spark):
    texts = SECRETS + SECRETS + PLAIN + [PROSE] * 3 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_guess for r in guess_cost.scan_secrets(docs).collect()}
    assert found == {i: int(t in SECRETS) for i, t in enumerate(texts)}
    clean = {r.doc_id: r.text for r in guess_cost.redact_secrets(docs).collect()}
    assert all(("[SECRET]" in clean[i]) if t in SECRETS else clean[i] == t for i, t in enumerate(texts))


def test_words_are_ranked_without_a_limit(spark):
    texts = ["alpha alpha alpha alpha beta beta gamma once"] * 1 + ["secret: zzqqxx"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = guess_cost.ranked_words(docs)
    assert words.get("alpha") == 1 and words.get("beta") == 2 and not any(map(words.get, ("once", "gamma", "zzqqxx")))
    nothing = guess_cost.ranked_words(docs.limit(0))
    assert not nothing.paths and nothing.get("alpha") is None and all(nothing.get(w) == k for w, k in guess_cost.WORD_RANK.items())


def test_words_over_many_files(spark):
    """Against counts in a dictionary: words of many letters and languages, ties, null and empty texts, a column of a clashing name."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    made = [f"w{letters[k % 32]}{letters[k // 32 % 32]}{letters[k // 1024]}" for k in range(3000)] + ["größenordnung", "x" * 64, "x" * 65, "internationalization"]
    texts = [" ".join(w for k, w in enumerate(made) if k % (d + 1) == 0) for d in range(8)] + [" ".join(made[-4:])] * 2 + [None, ""]
    docs = spark.createDataFrame([(d, t, d) for d, t in enumerate(texts)], "doc_id long, text string, h long")
    counts = Counter(w for t in texts for w in (t or "").split())
    words = guess_cost.ranked_words(docs, 500)
    classes = {w: math.floor(16 * math.log2(n)) for w, n in counts.items() if n > 1 and len(w) <= 64}
    assert len(words.paths) == words.files == -(-len(classes) // 500)
    above = {c: sum(x >= c for x in classes.values()) for c in set(classes.values())}
    assert {w: words.get(w) for w in counts} == {w: above[classes[w]] if w in classes else None for w in counts}
