import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ticketlens.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h(*below[i:i + 3]) for i in range(0, len(below), 3)])
    return levels


def _way(levels, at):
    """(before, after) of every level from the leaf up."""
    out = []
    for below in levels[:-1]:
        run = at - at % 3
        out.append(("".join(below[run:at]), "".join(below[at + 1:run + 3])))
        at //= 3
    return out


def _brute(rows):
    """rows (group, key, leaf, changed) -> sorted tuples of the manifest."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None and r[3] != r[2], r[3] or ""))
        trees[g] = _levels_of([r[2] for r in groups[g]])
    top = _levels_of([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, (_, key, leaf, changed) in enumerate(groups[g]):
            way = _way(trees[g], at) + _way(top, i)
            now = changed or leaf
            for before, after in way:
                now = _h(before, now, after)
            out.append((str(g), str(key), leaf, trees[g][-1][0], top[-1][0], _h(*[a + b for a, b in way]), now, len(way)))
    return sorted(out)


def _rows(sizes, seed=5):
    rnd = random.Random(seed)
    rows = []
    for group, n in sizes.items():
        for i in range(n):
            leaf = _h(str(group), str(i // 2))         # repeated leaves
            rows.append((group, None if i % 11 == 3 else rnd.choice([i, i, 7]), leaf, rnd.choice([None, leaf, _h("x", str(i))])))
    rnd.shuffle(rows)
    return rows


SIZES = {None: 30, "": 1, "a": 2, "b": 3, "é": 4, "Z": 40, "hot": 700} | {f"s{i:03}": i % 5 + 1 for i in range(60)}


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_equals_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** levels)
    rows = _rows(SIZES if levels > 1 else {None: 5, "a": 30, "b": 1, "c": 3, "d": 100})
    frame = spark.createDataFrame(rows, "group string, key long, leaf string, changed string").repartition(7)
    # other names, and columns that clash with the operator's own
    frame = frame.toDF("source", "doc_id", "l", "c").withColumn("pos", F.lit(1)).withColumn("n", F.lit("x")).withColumn("a.b", F.lit(1))
    got = merkle.manifest(frame, "source", "doc_id", "l", "c").collect()
    assert sorted((str(r["group"]), str(r["key"]), *r[2:]) for r in got) == _brute(rows)


def test_a_version_copies_its_path_and_shares_the_rest():
    leaves = [_h(str(i)) for i in range(25)]
    tree = merkle.grown(leaves, 3)
    version = merkle.replaced(tree, 13, 3, _h("new"))
    assert version[0] == merkle.grown(leaves[:13] + [_h("new")] + leaves[14:], 3)[0] != tree[0]
    assert tree[0] == merkle.grown(leaves, 3)[0]

    def nodes(n):
        return {id(n)} | {i for c in n[1] for i in nodes(c)}
    assert len(nodes(version) - nodes(tree)) == 4           # the leaf and three ancestors
    again = merkle.replaced(version, 13, 3, leaves[13])
    assert again == tree


def test_empty_table(spark):
    frame = spark.createDataFrame([], "g string, k long, l string, c string")
    assert merkle.manifest(frame, "g", "k", "l", "c").collect() == []


def test_query_follows_the_contract(spark, tmp_path):
    from ticketlens.llm.queries import QUERIES
    rows = [(1, "a\nb", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0),
            (None, "x\n", "de", "é", 2), (40, "ü\n" * 50_000, "de", "é", 100_000), (-5, "c\n", "en", None, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "leaf", F.lit("clash")).withColumn("root", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    want = []
    for doc, text, lang, source, n in rows:
        leaf = _leaf(doc, source, lang, n, text)
        even = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
        want.append((source, doc, leaf, _leaf(doc, source, lang, n, text and text.replace("\n", "")) if even else None))
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(
        (w[1], *w[2:7], w[6] == w[4]) for w in _brute(want))
    assert {r["verified"] for r in got} == {True, False}
