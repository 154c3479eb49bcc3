import numpy as np
import pytest

from cairn.llm import embeddings, queries, topk
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, rank int, part string"


def table(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame([(i, None if r is None else [None if v is None else float(v) for v in r], 1, "extra", 9, "p") for i, r in zip(ids, x)], SCHEMA)


def vectors(n=400, dim=24, seed=2):
    """Random vectors, a cluster of near copies and a group of equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:120] = x[50] + 0.15 * rng.normal(size=(70, dim))
    x[200:240] = x[200]
    x[240] = 2 * x[200]
    return x


def test_near_duplicates_equal_brute_force(spark):
    x = vectors()
    odd = [None, [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [3.0, 4.0]]
    rows = embeddings.near_duplicates(table(spark, [*x, *odd]).repartition(3)).collect()
    found = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    expected = brute.near_vectors(list(range(len(x))), x.astype(float)) | {len(x) + i: (0, len(x) + i) for i in range(len(odd))}
    assert found == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    x = vectors()
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table(spark, x)).collect()}
    assert found == brute.near_vectors(list(range(len(x))), x.astype(float))


def test_recall_at_the_threshold(spark):
    """Pairs at cosine 0.9 to 0.91, the hardest: at least 0.9 of them are found, and no false one."""
    rng = np.random.default_rng(9)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.905 * a + np.sqrt(1 - 0.905**2) * b]).astype(np.float32)
    expected = brute.near_vectors(list(range(len(x))), x.astype(float))
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table(spark, x)).collect()}
    true = sum(n for n, _ in expected.values())
    assert sum(found.values()) >= 0.9 * true and all(found[i] <= expected[i][0] for i in found)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    turn = embeddings.rotation(64, 3)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-5)
    o, q = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 64)))
    q = 0.8 * o + 0.6 * q
    q /= np.linalg.norm(q)
    errors = []
    for seed in range(300):
        t = embeddings.rotation(64, seed)
        code = np.sign(o @ t) / 8
        factor = code @ (o @ t)
        errors.append(((code @ (q @ t)) / factor - o @ q) / np.sqrt((1 - factor**2) / factor**2 / 63))
    assert abs(np.mean(errors)) < 0.15 and np.mean(np.abs(errors) > 3) < 0.02


@pytest.mark.parametrize(("n", "k"), [(300, 20), (12, 20), (1, 5)])
def test_top_k_equals_brute_force(spark, n, k):
    x = vectors(max(n, 300))[:n] / 3
    x[::7] = x[0]
    whole = table(spark, x).repartition(3)
    got = sorted(map(tuple, topk.top_k(whole.where("vec_id % 20 = 0"), whole, k).collect()))
    assert got == brute.top_k(list(range(n)), x, range(0, n, 20), k)


def test_top_k_stops_only_on_proof(monkeypatch):
    """Many blocks, carried thresholds and hard pruning give the same as one exact pass."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(900, 32)) * 20).astype(np.int64)
    q, qid = x[:40].astype(float), np.arange(40)
    held = (np.zeros(0, np.int64),) * 3
    import pyarrow as pa

    for lo in range(0, 900, 150):
        batch = pa.record_batch({"vec_id": np.arange(lo, lo + 150), "impact": list(x[lo : lo + 150])})
        (block,) = topk.posting_blocks(4096)([batch])
        ids = topk.unpack(block["ids"][0].as_py())["vec_id"].to_numpy()
        held = topk.score_block(q, qid, (ids, topk.unpack(block["segments"][0].as_py())), 32, held, 10)
    got = list(zip(held[0].tolist(), held[2].tolist(), held[1].tolist()))
    expected = [(a, i, s) for a, _, i, s in brute.top_k(list(range(900)), x, range(40), 10, 1)]
    assert got == expected


def test_vector_edges(spark):
    x = [None, [float("nan"), 1.0], [None, 1.0], [1.0, 2.0], [0.0, 0.0], [1.0, 2.0], [1.0]]
    whole = table(spark, x)
    got = sorted(map(tuple, topk.top_k(whole, whole, 2).collect()))
    assert got == [(3, 1, 5, 64 * 64 * 5), (3, 2, 4, 0), (4, 1, 3, 0), (4, 2, 5, 0), (5, 1, 3, 64 * 64 * 5), (5, 2, 4, 0)]
    assert topk.top_k(whole.limit(0), whole.limit(0), 2).count() == 0
    assert embeddings.near_duplicates(whole.limit(0)).count() == 0
    assert embeddings.near_duplicates(whole.where("vec_id < 3")).where("kept").count() == 3
    no_id = table(spark, [[1.0, 2.0], [1.0, 2.0], [1.0, 2.0]], [None, 7, 7])
    rows = sorted(map(tuple, embeddings.near_duplicates(no_id).collect()), key=str)
    assert rows == [(7, 1, 7, True), (7, 1, 7, True), (None, 0, None, False)]
    assert topk.top_k(no_id, no_id, 2).count() == 0


def test_top_k_of_vectors_of_very_different_length(spark, monkeypatch):
    """Many slices, of which few can serve a query."""
    monkeypatch.setattr(topk, "INDEX_BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "SLICE", 50)
    monkeypatch.setattr(topk, "TOGETHER", 5)
    x = vectors(400) / np.linspace(0.2, 40, 400)[::-1, None]
    whole = table(spark, x).repartition(3)
    got = sorted(map(tuple, topk.top_k(whole.where("vec_id % 20 = 0"), whole, 7).collect()))
    assert got == brute.top_k(list(range(400)), x.astype(np.float32), range(0, 400, 20), 7)


def test_scores_out_of_range_are_an_error(spark):
    whole = table(spark, [[3e38, 1.0], [3e38, 2.0]])
    with pytest.raises(Exception, match="2\\^52|overflow|cast"):
        topk.top_k(whole, whole, 2).collect()


def test_registered_queries_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in given], float)
    found = {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_embedding_near_dedup(spark, sf).collect()}
    assert found == brute.near_vectors([r.vec_id for r in given], x)
