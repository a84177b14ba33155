import numpy as np
import pytest

from fluxspan.llm import packing


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, shard string")


def plans(spark, *capacities):
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(capacities)], "plan_id bigint, capacity_tokens int")


def check(rows, capacity, sizes):
    """No container overfull, every token of every text exactly once, splits only of long texts."""
    load, pieces = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(load.values()) <= capacity and set(pieces) == set(sizes)
    for d, parts in pieces.items():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) == sizes[d]
        assert len(parts) == max(1, -(-sizes[d] // capacity))
    return load


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(0)
    words = ["motor", "kettle", "colour", "river", "stone", "lamp", "green", "paper", "cloud", "horse"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(400)] + ["", None, "x " * 3000]
    df = docs(spark, texts)
    sizes = {i: packing.count_tokens(t or "") for i, t in enumerate(texts)}
    out = packing.pack_documents(df.unionByName(df.limit(5)), plans(spark, 128, 512, None, 0), shard=150)
    for plan, capacity in ((1, 128), (2, 512)):
        load = check(out.where(f"plan_id = {plan}").collect(), capacity, sizes)
        assert sum(load.values()) / (capacity * len(load)) > 0.93
    assert packing.pack_documents(df.limit(0), plans(spark, 128)).count() == 0
    assert packing.container_fill(out).count() == 2


def test_long_texts_count_the_same_in_stretches():
    text = ("Der schnelle braune Fuchs  springt\n\n über 12,5 faule Hunde! " * 3000)[:150_000]
    assert packing.count_tokens(text) == len(packing.encoder().encode_ordinary(text))


def test_index_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    n, vocabulary = 60, 40
    counts = rng.poisson(0.4, (n, vocabulary))
    df = (counts > 0).sum(axis=0).astype(float)
    index = packing.ShardIndex([np.flatnonzero(c) for c in counts], [c[c > 0] for c in counts], df, n)
    lengths = counts.sum(axis=1)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = packing.K1 * (1 - packing.B + packing.B * lengths / lengths.mean())
    weight = idf * counts * (packing.K1 + 1) / (counts + norm[:, None])
    for d in range(n):
        assert np.allclose(index.scores(d), weight[:, counts[d] > 0].sum(axis=1))


def test_neighbours_share_a_container(spark):
    texts = [f"{w} " * 20 for w in ("kettle", "violin") for _ in range(6)]
    rows = packing.pack_documents(docs(spark, texts), plans(spark, 6 * packing.count_tokens(texts[0])), shard=1000).collect()
    homes = {}
    for r in rows:
        homes.setdefault(r.container, set()).add(texts[r.doc_id])
    assert all(len(t) == 1 for t in homes.values())


@pytest.mark.parametrize("seed", range(5))
def test_filling_random_sizes(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 101, 300)
    place = packing.fill_containers(sizes, 100, lambda i: rng.random(300))
    load = np.bincount(place, weights=sizes)
    assert load.max() <= 100 and (place >= 0).all() and len(load) <= np.ceil(sizes.sum() / 100) * 1.15 + 1


def test_all_neighbours_are_walked_in_order():
    """Many short texts: the window holds the best neighbours, however many fit."""
    sizes = np.r_[5, np.full(2000, 2)]
    scores = np.r_[0.0, np.arange(2000, 0, -1.0)]
    place = packing.fill_containers(sizes, 1005, lambda i: scores if i == 0 else None)
    assert set(np.flatnonzero(place == place[0])) == set(range(501))


def test_forgetting_changes_no_score_of_the_rest():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.5, (80, 50))
    index = packing.ShardIndex([np.flatnonzero(c) for c in counts], [c[c > 0] for c in counts], (counts > 0).sum(axis=0).astype(float), 80)
    before = index.scores(7)
    gone = rng.random(80) < 0.5
    index.forget(gone)
    assert np.allclose(index.scores(7), np.where(gone, 0, before))
    index.forget(np.arange(80) % 3 == 0)
    assert np.allclose(index.scores(7), np.where(gone | (np.arange(80) % 3 == 0), 0, before))
    index.restore()
    assert np.allclose(index.scores(7), before)


def test_all_plans_and_all_texts_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "PLANS", 2)
    df = spark.createDataFrame([(1, "one text"), (1, "another text of it"), (1, "one text"), (2, "a third"), (None, "x")], "doc_id bigint, text string")
    rows = packing.pack_documents(df, plans(spark, 8, 16, 32, 64, 128)).collect()
    assert {r.plan_id for r in rows} == {1, 2, 3, 4, 5} and len(rows) == 15
    assert sorted((r.doc_id, r.text_no) for r in rows if r.plan_id == 3) == [(1, 0), (1, 1), (2, 0)]


def test_hot_class_is_split():
    group, parts = packing.shard_plan({0: 10, 1: 10_000, 2: 5, 3: 2990}, 3000)
    assert parts[1] == 4 and group[0] == group[2] != group[1] and group[3] != group[0]


def test_shards_follow_similarity(spark):
    rng = np.random.default_rng(2)
    common = [f"word{i}" for i in range(30)]
    texts = [" ".join([*rng.permutation(common)[:20], *[f"topic{k}x{j}" for j in rng.permutation(8)[:6]]]) for k in range(40) for _ in range(15)]
    rows = packing.pack_documents(docs(spark, texts), plans(spark, 512), shard=150).collect()
    home = {r.doc_id: r.container.rpartition("-")[0] for r in rows}
    per_shard = np.unique(list(home.values()), return_counts=True)[1]
    assert len(home) == 600 and len(per_shard) > 3 and per_shard.max() <= 150
    together = [home[i] == home[j] for i in range(600) for j in range(i // 15 * 15, i) if j >= 0]
    assert np.mean(together) > 0.9


def test_like_documents_are_split_by_id(spark):
    rows = packing.pack_documents(docs(spark, ["same old text"] * 300), plans(spark, 64), shard=100).collect()
    per_shard = np.unique([r.container.rpartition("-")[0] for r in rows], return_counts=True)[1]
    assert per_shard.sum() == 300 and per_shard.max() < 150
