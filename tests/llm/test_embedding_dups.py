import numpy as np
import pytest

from ticketlens.llm.components import connected_components
from ticketlens.llm.embedding_dups import near_duplicates, passes_for

SCHEMA = "vec_id long, embedding array<float>, node string"


def _brute(rows, threshold=0.95):
    good = {}
    for i, (_, v, _) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.sqrt((x * x).sum())
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * len(rows)
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, links[i], least.get(root(i), -1)) for i, r in enumerate(rows))


def _vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for size in (1, 1, 2, 3, 40, 150):
        centre = rng.standard_normal(24)
        for _ in range(size):
            rows.append((5000 - len(rows), (centre + 0.2 * rng.standard_normal(24)).tolist(), "n"))
    rows += [(i, rng.standard_normal(24).tolist(), "n") for i in range(300)]
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = _vectors(3)
    same = rows[10][1]
    rows += [(9000 + i, same, "n") for i in range(50)]                       # exact copies
    rows += [(9100, [2.5 * x for x in same], "n"), (None, same, "n")]        # scaled; null id
    rows += [(9200, None, "n"), (9201, [], "n"), (9202, [0.0] * 24, "n"), (9203, [0.0] * 24, "n"),
             (9204, [float("nan")] * 24, "n"), (9205, [None] + [1.0] * 23, "n"), (9206, [float("inf")] * 24, "n"),
             (9207, same[:12], "n"), (9208, same[:12], "n")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"],
                   r["component_id"] if r["component_id"] is not None else -1) for r in got) == _brute(rows)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = near_duplicates(frame).toPandas().set_index("vec_id")
    rows = frame.toPandas()
    x = np.stack([np.asarray(v, float) for v in rows["embedding"]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    found = got.loc[rows["vec_id"], "n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()


def test_empty_table_and_no_valid_vector(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, None, "n")], SCHEMA)).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(1, 0, 1, True)]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
                                   [(i, 40 + i * 7 % 30) for i in range(30)] + [(3, 3), (40, 2), (40, 2)]])
def test_components(spark, links):
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {n: root(n) for n in up if root(n) != n}


def test_more_vectors_take_more_passes():
    counts = [passes_for(n, 0.95, 32, 0.99) for n in (100, 10_000, 10**6, 10**9)]
    assert counts == sorted(counts) and counts[0] < counts[-1] < 200


@pytest.mark.parametrize("pairs, spread", [(16384, 0.7), (16384, 0.85), (64, 0.85)])
def test_pairs_in_a_crowded_cone_are_found(spark, monkeypatch, pairs, spread):
    """A third of the vectors has a mutual cosine of ``spread``; planted pairs at 0.955."""
    from ticketlens.llm import embedding_dups
    monkeypatch.setattr(embedding_dups, "PAIRS", pairs, raising=False)
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    n, planted = 12_000, 400
    x = unit(rng.standard_normal((n, 64)))
    hot = n // 3
    x[:hot] = unit(np.sqrt(spread) * x[-1] + np.sqrt(1 - spread) * x[:hot])
    aside = rng.standard_normal((planted, 64))
    aside = unit(aside - (aside * x[:planted]).sum(axis=1)[:, None] * x[:planted])
    y = 0.955 * x[:planted] + np.sqrt(1 - 0.955 ** 2) * aside
    rows = [(i, v.tolist(), "n") for i, v in enumerate(np.concatenate([x, y]))]
    got = {r["vec_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] == got[n + i] for i in range(planted)) >= 0.99 * planted


def test_links_do_not_depend_on_the_shuffle_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rng = np.random.default_rng(1)
        rows = []
        for i in range(20):                                                 # 20 pairs right above the threshold
            x, y = rng.standard_normal((2, 64))
            x /= np.linalg.norm(x)
            y -= (x @ y) * x
            near = 0.952 * x + (1 - 0.952 ** 2) ** 0.5 * y / np.linalg.norm(y)
            rows += [(2 * i, x.tolist(), "n"), (2 * i + 1, near.tolist(), "n")]
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == _brute(rows)
