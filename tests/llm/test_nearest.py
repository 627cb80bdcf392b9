import numpy as np
import pytest
from tests.conftest import DATA

from docloom.llm import nearest, queries


def by_hand(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(axis=1)
        keep = np.flatnonzero(ids != ids[q])
        by = keep[np.lexsort((ids[keep], -s[keep]))][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in by]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got, want = answers(queries.op4_nearest_neighbours(spark, DATA)), by_hand(rows, 20, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    scores = {q: dict(v) for q, v in by_hand(rows, 20, len(rows)).items()}
    assert all(scores[q][i] == s for q, v in got.items() for i, s in v)
    assert all(len(v) == 20 and v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_largest_inner_product_with_unequal_norms(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(12) * rng.uniform(0.2, 3)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert recall(answers(nearest.nearest(spark, df, k=10, batch=150, queries=10)), by_hand(rows, 20, 10)) >= 0.9


def test_few_within_the_radius(spark, monkeypatch):
    """Queries far from all others search on until they have k."""
    learn = nearest.learn

    def narrow(*a):
        c = learn(*a)
        c.radius = 1
        return c

    monkeypatch.setattr(nearest, "learn", narrow)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)] + [(40, rng.standard_normal(16).tolist())]
    got = nearest.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=5, batch=64).collect()
    assert len(got) == 16 * 5  # id 40 is asked for twice
    assert {r["query_id"] for r in got} == set(range(0, 300, 20)) and all(r["vec_id"] != r["query_id"] for r in got)


def test_shuffle_grows_with_the_queries_alone(spark):
    """Each task keeps k rows a query, however many batches it reads."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    model = nearest.learn(np.array([r[1] for r in rows[:500]]), 6.0, 4)
    queries = df.where("vec_id % 100 = 0").selectExpr("vec_id as q", "vec_id", "embedding as v").toArrow()
    for batch in (100, 5000):
        assert nearest._found(df.selectExpr("vec_id", "embedding as v"), model, queries, 10**6, 4, batch).count() == 20 * 4 * 2


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, [1.0, 2.0, 3.0]), (9, [-1.0, 0.2])]
    df = spark.createDataFrame([(i, v, 1.0, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, score double, rank int, v string")
    got = answers(nearest.nearest(spark, df))
    assert got[0] == [(1, 1.0), (20, 1.0), (2, 0.5), (2, 0.5), (9, -1.0)] and got[20] == [(0, 1.0), (1, 1.0), (2, 0.5), (2, 0.5), (9, -1.0)] and set(got) == {0, 20}
    assert nearest.nearest(spark, df.limit(0)).count() == 0 and nearest.nearest(spark, df.where("vec_id = 1")).count() == 0
    assert answers(nearest.nearest(spark, df.where("vec_id in (0, 3)"))) == {}


@pytest.mark.parametrize("radius", [0, 3, 9, 30, 70])
def test_probing_retrieves_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    x = rng.standard_normal((400, 16))
    model = nearest.learn(x[:200], float(np.linalg.norm(x, axis=1).max()), 5)
    index = nearest.Index(model, np.arange(400), x)
    codes = model(x[:20], True)
    words = nearest.words64(codes)
    for i in range(20):
        d = nearest.distances(words[i], index.words)
        assert index.within(codes[i], words[i], radius).tolist() == np.flatnonzero(d <= radius).tolist()
