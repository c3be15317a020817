"""Near-duplicates by exact shingle similarity against all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from quire.llm import similar, simhash  # noqa: E402


def corpus():
    """Copies with a few words changed at all distances, short texts, and texts that share a long passage."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, texts = [word() for _ in range(60)], []
    for size in (1, 3, 5, 6, 8, 9, 10, 12, 20, 40, 90, 200, 400, 1500):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(base)
            for share in (0.004, 0.012, 0.02, 0.03):
                copy = [word() if rng.random() < share else w for w in base]
                texts += [copy, copy[: max(1, int(size * 0.85))], copy + [word() for _ in range(size // 6)]]
    texts += [passage + [word() for _ in range(rng.randrange(5, 60))] for _ in range(120)]
    return [" ".join(t) for t in texts]


def test_every_similar_pair_shares_a_key():
    sets = [similar.shingle_set(t, 5) for t in corpus()]
    keys = [set(similar.keys_of(s).tolist()) for s in sets]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if similar.similar(sets[i], sets[j])]
    assert len(close) > 500 and all(keys[i] & keys[j] for i, j in close)


def test_bounds_never_drop_a_similar_pair():
    sets = [similar.shingle_set(t, 5) for t in corpus()]
    n = np.array([len(s) for s in sets])
    bins = np.stack([np.frombuffer(similar.bins_of(s), "<u2") for s in sets]).astype(np.int32)
    ok = similar._possible(n[:, None], bins[:, None], n[None], bins[None])
    assert all(ok[i, j] for i in range(len(sets)) for j in range(i) if similar.similar(sets[i], sets[j]))


def test_the_stage_finds_all_groups(spark):
    """Every pair at 0.8 or more is linked, none below: eight fingerprint families left most near 0.8."""
    texts = corpus()
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [set(similar.shingle_set(t, 5).tolist()) for t in texts]
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})


def test_large_keys_in_blocks_lose_no_pair(spark):
    """Members of one key, in blocks of five, give the pairs that one group of all gives."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    sets = [similar.shingle_set(" ".join(base + [f"x{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))]), 5) for _ in range(23)]
    rows = [(1, similar.node_of(s), k, len(s), similar.bins_of(s)) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "mark long, node long, part long, n long, bins binary")
    found = []
    for most in (5, 100):
        keys = ["mark", "i", "j"]
        pairs = similar.dealt(df, most).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(similar._across, "a long, b long")
        found.append([tuple(r) for r in pairs.collect()])
    assert set(found[0]) == set(found[1]) and len(found[0]) == len(set(found[0])) > 20


def test_a_pair_is_made_under_one_of_its_keys_only(spark):
    """Copies of one text share many keys; before, each key made all their pairs again."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    sets = [similar.shingle_set(" ".join(base + [f"x{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))]), 5) for _ in range(23)]
    marks = [(mark, [k for k in range(23) if rng.random() < 0.6]) for mark in rng.sample(range(1, 1 << 40), 30)]
    rows = [(mark, similar.node_of(sets[k]), k, len(sets[k]), similar.bins_of(sets[k])) for mark, of in marks for k in of]
    df = spark.createDataFrame(rows, "mark long, node long, part long, n long, bins binary")
    keys, found = ["mark", "i", "j"], []
    for members, most in ((df, 100), (similar.marked(df), 100), (similar.marked(df), 5)):
        pairs = similar.dealt(members, most).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(similar._across, "a long, b long")
        found.append([tuple(r) for r in pairs.collect()])
    assert len(found[0]) > 5 * len(set(found[0])) > 100
    assert all(set(f) == set(found[0]) and len(f) == len(set(f)) for f in found[1:])


def test_more_keys_than_a_member_carries_lose_no_pair():
    """The rule by itself, with members of up to three times as many marks as they carry."""
    rng = np.random.default_rng(2)
    of = [np.sort(rng.choice(400, rng.integers(1, 3 * similar.MARKS), replace=False)) for _ in range(40)]
    low = similar.pa.array([m[: similar.MARKS].tolist() for m in of], similar.pa.list_(similar.pa.int64()))
    x, y = np.triu_indices(40, 1)
    made = np.zeros(len(x), np.int64)
    for mark in range(400):
        both = np.array([mark in of[a] and mark in of[b] for a, b in zip(x, y, strict=True)])
        made += both & ~similar._earlier(similar._below(low, mark), x, y)
    assert all((made[k] > 0) == bool(len(np.intersect1d(of[a], of[b]))) for k, (a, b) in enumerate(zip(x, y, strict=True)))


def test_simhash_links_near_copies_by_itself(spark, monkeypatch):
    """The stage's method is SimHash: without the exact way for what fingerprints miss, copies are still found."""
    monkeypatch.setattr(similar, "_keyed", lambda docs, n_words: docs.sparkSession.createDataFrame([], "fp long, key long"))
    rng = random.Random(7)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(1500)]
        texts += [" ".join(base), " ".join([*base[:700], "changed", *base[701:]]), " ".join([*base[:100], "other", *base[101:]])]
    texts += [texts[0].upper(), texts[0] + " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_filter(spark, docs, "").collect())
    assert set(range(0, 18, 3)) <= set(kept) and len(kept) <= 8


def test_direct_links_are_within_three_bits_and_connect_the_same():
    rng = np.random.default_rng(4)
    fps = [np.uint64(rng.integers(1 << 63))]
    for _ in range(60):
        fps.append(fps[rng.integers(len(fps))] ^ np.uint64(1 << int(rng.integers(64))))
    fps = np.unique(np.array(fps, np.uint64)).view(np.int64)
    for first in range(simhash.SEGMENTS):
        star, tree = simhash.stars(fps, first), simhash.stars(fps, first, direct=True)
        assert len(star) == len(tree) and {x for e in star for x in e} == {x for e in tree for x in e}
        assert all((a ^ b) & (1 << 64) - 1 and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in tree)
