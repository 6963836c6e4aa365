"""The Merkle manifest against the definition in plain Python."""

import hashlib
import zlib

from geobucket.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, source, lang, n_chars, text = row
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if lower and text is not None else text
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and the (left, right) siblings of each node, level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, i in enumerate(own):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[x].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            own[x] = i // 16
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def by_definition(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = {s: (own := sorted(g, key=lambda r: (r[0] is not None, r[0], leaf(r))), *tree([leaf(r) for r in own])) for s, g in groups.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        own, sub, paths = trees[s]
        for r, path in zip(own, paths):
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, z in path + top:
                now = h(a, now, z)
            out.append((r[0], leaf(r), sub, root, h(*[a + z for a, z in path + top]), now, now == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert sorted(map(tuple, M.merkle_documents(docs).collect()), key=repr) == by_definition(rows)


def test_sizes_of_groups(spark):
    """One leaf, whole runs and blocks, one more, and three passes."""
    rows = [(1000 * s + i, f"s{s}", "en", i, f"Text {i} {'É' * (i % 3)}") for s, n in enumerate((1, 2, 15, 16, 17, 255, 256, 257, 273)) for i in range(n)]
    check(spark, rows)


def test_more_than_two_passes(spark, monkeypatch):
    for name, value in (("LEVELS", 1), ("BLOCK", 16)):
        monkeypatch.setattr(M, name, value)
    check(spark, [(i, "hot" if i % 3 else f"s{i}", None, i, "A") for i in range(1200)])


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, "A"), (5, "a", "en", 1, ""), (5, "a", "en", 1, ""), (5, "a", "en", 1, "X" * 100_000), (-7, "é", "-", 0, "1:a"), (7, "Z", "x", 3, "lower only"), (2**40, "", "x", 3, "Up")]
    check(spark, rows)
    check(spark, rows[2:3])


def test_no_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", 2, "T", "x", "y")], COLUMNS + ", root string, g string")
    assert [tuple(r) for r in M.merkle_documents(docs).collect()] == by_definition([(1, "a", "en", 2, "T")])
    assert M.merkle_documents(docs.limit(0)).count() == 0


def test_a_changed_text_is_found(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(300)]
    got = {r.doc_id: r.verified for r in M.merkle_documents(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300)} and not all(got.values())
