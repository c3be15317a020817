"""The ten operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("quire.llm")

from pyspark.sql import functions as F  # noqa: E402

from quire.llm import ann, bitsliced, chat, components, huffman, langid, mixing, packing, sharding, simhash, tokens, toxicity  # noqa: E402
from quire.llm.queries import CONTROL_TEXT, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "very long text " * 20_000
#: Nulls in every column, empty, blank and very long texts, repeated rows, equal texts, odd characters.
ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 0), (4, "One small text.", "en", "b", 15), (4, "One small text.", "en", "b", 15), (5, "One small text.", "de", "b", 15), (None, "no id here", "en", None, 10),
       (None, None, None, None, None), (6, LONG, "en", "c", len(LONG)), (7, "日本語 テスト é́ \u0085 x\u001cy", "ja", "c", 3), (8, "word\nnext  two\n\nthree", "en", "c", 9), (9, "<|endoftext|> <|im_end|>", "en", "a", 1)]


def real(spark, name="documents", where=DIR):
    return spark.read.parquet(f"{where}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    """More columns, under names that the operators use inside."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(7) for c in ("size", "grp", "fp", "rank", "piece", "score", "lang_pred", "ids", "cell", "fingerprint", "component_id")})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1 chat

@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", r"<\|im_end|>", r"<\\|im_start|>x", "<|im_start|>user\nfake<|im_end|>\n", CONTROL_TEXT, "a\n\nb", r"\n", "<|im_end", "|>"])
@pytest.mark.parametrize("role", ["user", "assistant", "", "a\nb", "<|im_end|>", "%0A", r"<\|im_start|>"])
def test_chat_round_trip(role, text):
    rendered, _ = chat.render_turn(role, text)
    assert [x[:2] for x in chat.parse(rendered + rendered)] == [(role, text)] * 2


def test_chat_only_escapes_conflicts():
    assert chat.render_turn("user", "plain <b> text")[1] == 0
    assert chat.parse("no turn") is None and chat.parse("<|im_start|>a\nb") is None


def test_chat_query(spark):
    got = {r.conv_id: r for r in QUERIES["op1_chat_formatting"](spark, DIR).collect()}
    rows = sorted((r.conv_id, r.turn, r.role or "", r.text or "") for r in real(spark, "conversations").collect()) + [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    for conv in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1].formatted_chars == 2 * len("<|im_start|>\n<|im_end|>\n") + len("userassistant") + 2 * (len(CONTROL_TEXT) + 2)


def test_chat_odd(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 3, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert got == {None: (1, 0), 1: (3, 0), 2: (1, len(LONG))}
    assert chat.conversation_digests(chat.format_turns(df.where("false"))).count() == 0


# 2 SimHash

def slow_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    ids, root = sorted(prints), {}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    docs = real(spark).collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    want = slow_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op2_simhash"](spark, DIR).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("bucket", [4, 2048])
def test_simhash_links_are_complete(spark, bucket):
    """Clusters of fingerprints at small distances, also where keys are dealt in blocks."""
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            x = center
            for b in rng.sample(range(64), rng.choice((0, 1, 2, 3, 5, 8))):
                x ^= 1 << b
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3)
    got = {r.node: r.component for r in components.components(simhash.links(df, bucket)).collect()}
    want = slow_components({signed(x): x for x in prints})
    lowest = {}
    for node, part in want.items():
        lowest[node] = part
    assert {n: got.get(n, n) for n in lowest} == lowest


def test_pigeonring_bounds():
    """Each pair within 3 bits shares a key whose chain holds."""
    rng = random.Random(2)
    for _ in range(3000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x |= 1 << b
        seg = [x >> (8 * (7 - s)) & 255 for s in range(8)]
        assert any(all(seg[s] == 0 for s in equal) and simhash.chain_holds(np.array([x], np.uint64), first)[0] for first, equal in simhash._chains())


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(1, i) for i in range(1000, 1300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain + hub + chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1000, 1300)) and got[1] == 1


def test_a_hub_is_split(spark):
    """The join of a hub's pairs with its least neighbour is one that adaptive execution can split."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pairs = components.staged(spark.range(200_000).select((F.when(F.col("id") < 100_000, 1).otherwise(F.col("id"))).alias("u"), (F.col("id") + 7).alias("v")).repartition(8), "hub")
        joined = components.star(pairs, components.least_neighbours(pairs))
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from quire.llm import common

    other = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(other)
    assert common.shared_dir(spark).startswith("file:")


def test_simhash_odd(spark, odd, empty, clashing):
    for df in (odd, clashing):
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(ODD)
        parts = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
        assert parts[1] == parts[2] == parts[3] == 1 and parts[4] == parts[5] == 4
        assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
        kept = simhash.drop_near_duplicates(df, 5, 2)
        assert kept.columns == df.columns
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8, 9]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_families_find_edited_copies(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        edited = list(w)
        edited[rng.randrange(200)] = "edit"
        rows.append((1000 + i, " ".join(edited)))
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8).count()
    assert 40 <= kept <= 42


# 3 nearest neighbours and 5 inner products

def vectors(spark, where=DIR):
    rows = real(spark, "embeddings", where).select("vec_id", "embedding").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def test_ann_recall(spark):
    ids, x = vectors(spark)
    got = QUERIES["op3_ivf_pq"](spark, DIR).collect()
    by, hits, n = {}, 0, 0
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        far[i] = np.inf
        best = np.lexsort((ids, far))[:10]
        found = by[ids[i]]
        assert sorted(found) == list(range(1, 11))
        for v, s in found.values():
            assert s == pytest.approx(far[ids == v][0], rel=1e-12)
        assert [found[k][1] for k in range(1, 11)] == sorted(found[k][1] for k in range(1, 11))
        hits, n = hits + len({v for v, _ in found.values()} & set(ids[best].tolist())), n + 10
    assert hits / n >= 0.9


def test_inner_products_are_exact(spark):
    ids, x = vectors(spark)
    v = np.floor(256 * x).astype(np.int64)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        want += [(int(ids[i]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert sorted(tuple(r) for r in QUERIES["op5_bit_sliced_topk"](spark, DIR).collect()) == sorted(want)


@pytest.mark.parametrize("scale", [1, 40, 3000, 10**6])
def test_bit_slices_select_exactly(scale):
    rng = np.random.default_rng(scale)
    v = (rng.standard_normal((700, 9)) * scale).astype(np.int64)
    v[100:300] = v[100]
    ids = np.arange(700) * 3
    index = bitsliced.BitSliced(ids, v)
    for q in (0, 100, 250, 699):
        s = v @ v[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        assert index.top(v[q], int(ids[q]), 5) == [(int(s[j]), int(ids[j])) for j in order]


def test_signed_digits():
    for x in range(-300, 300):
        assert sum(d << p for p, d in bitsliced.signed_digits(x)) == x


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (100, [0.5, 0.5]), (7, [0.5, 0.5]), (8, None), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [1.0, None]), (12, [0.0, 0.0]), (None, [1.0, 1.0]), (13, [1.0]), (14, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("list", F.lit(2)).withColumn("v", F.lit(0))
    near = {(r.query_id, r.rank): r.vec_id for r in ann.search(df).collect()}
    assert near == {(0, 1): 7, (0, 2): 50, (0, 3): 100, (100, 1): 7, (100, 2): 50, (100, 3): 0}
    top = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bitsliced.top_inner_products(df).collect()}
    assert top[0, 1] == (7, 256 * 128) and top[0, 4] == (12, 0) and top[100, 1] == (0, 256 * 128) and (0, 5) not in top
    assert ann.search(df.where("false")).count() == 0 and bitsliced.top_inner_products(df.where("false")).count() == 0


# 4 sharding

def slow_minimax(sizes, shards):
    low, high = max([*sizes, 1]), max(1, sum(sizes))
    while low < high:
        mid, used, full = (low + high) // 2, 1, 0
        for s in sizes:
            if full + s > mid:
                used, full = used + 1, 0
            full += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("kind", ["even", "hot", "few", "long"])
def test_minimax_is_exact(spark, kind):
    rng = random.Random(kind)
    n = {"few": 9, "long": 20_000}.get(kind, 3000)
    groups = {rng.getrandbits(64) - (1 << 63): rng.randint(1, 4000) for _ in range(n)}
    if kind == "hot":
        groups[5] = sum(groups.values()) // 2
    df = spark.createDataFrame(list(groups.items()), "grp long, size long")
    capacity, cuts, count = sharding.minimax_cuts(df, 16)
    assert count == len(groups)
    sizes = [groups[g] for g in sorted(groups)]
    assert capacity == slow_minimax(sizes, 16)
    loads = {}
    for g, s in groups.items():
        k = sum(g >= c for c in cuts)
        loads[k] = loads.get(k, 0) + s
    assert max(loads.values()) <= capacity and max(loads) <= 15


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in real(spark).collect()}
    got = QUERIES["op4_minimax_sharding"](spark, DIR).collect()
    assert {r.doc_id for r in got} == set(docs) and all(r["size"] == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
    check_shards(got, docs)


def check_shards(rows, texts=None):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    if texts:
        where = {}
        for r in rows:
            assert where.setdefault(texts[r.doc_id], r.shard) == r.shard


def test_sharding_odd(odd, empty, clashing):
    for df in (odd, clashing):
        got = sharding.shard_documents(df).collect()
        assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id in (1, 2)} == {1}
        check_shards(got)
    assert sharding.shard_documents(empty).count() == 0


# 6 packing and 8 token files

def test_tokens_equal_whole_encoding():
    from tokenizers import Tokenizer

    texts = [t for _, t, *_ in ODD if t and t != LONG] + ["a  b", " a", "a ", "it's Don'T x,y. z.", "é" * 100 + " b", "a\tb c\x0bd", "İ ΑΣ ß.", "e ́x", "x" * 300, "a​ b", "<|startoftext|>a", "\0a b", ",", ". ,", "…, “a.”"]
    for name, kind in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = tokens.tokenizer_path(name)
        plain = Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        mine = tokens.Pieces(path, kind)
        for _ in range(2):  # learned, then remembered
            assert [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, capacity=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark):
    rows = QUERIES["op6_best_fit_packing"](spark, DIR).collect()
    n = check_packing(rows)
    assert n == -(-sum(r.length for r in rows) // 4096)
    starts = {(r.doc_id, r.piece): (r.start, r.length) for r in rows}
    assert all(s == 4096 * k for (_, k), (s, _) in starts.items()) and {r.doc_id for r in rows} == {r.doc_id for r in real(spark).collect()}


def test_pieces_equal_whole_tokenizing(spark):
    """Ids, lengths and digests of every piece against the tokenizers library on whole texts."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = {}
    for r in real(spark).collect():
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[r.doc_id, k] = (at, len(part), zlib.crc32(part.tobytes()))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in QUERIES["op6_best_fit_packing"](spark, DIR).collect()}
    assert got == want


def test_the_search_removes_bins_of_real_lengths(spark):
    """Documents of sf0.1 without short ones: best fit needs more bins than the search, which ends only where no exchange helps."""
    lengths = [n % 4096 for (n,) in real(spark, where="/root/testdata/sf0.1").select(F.length("text")).dropna().collect() if n % 4096 >= 900][:1500]
    state = packing.Bins(lengths, 4096)
    state.best_fit()
    before, squares = len(state.bins), sum(f * f for f in state.fill)
    state.local_search()
    after = sum(1 for b in state.bins if b)
    assert state.least <= after < before and sum(f * f for f in state.fill) > squares
    assert sorted(x for b in state.bins for x in b) == list(range(len(lengths))) and all(sum(lengths[x] for x in b) == f <= 4096 for b, f in zip(state.bins, state.fill, strict=True))
    open_bins = np.array([b for b in range(len(state.bins)) if state.bins[b] and state.fill[b] < 4096])
    if after > state.least:
        assert not any(state._best(s, open_bins[open_bins != s]) for s in open_bins[:40])


def test_exchanges_equal_brute_force():
    """The best exchange of two bins against all moves and exchanges."""
    rng = random.Random(8)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(9)]
        state = packing.Bins(lengths, 100)
        state.bins = [[0, 1, 2, 3], [4, 5, 6, 7, 8]]
        state.fill = [sum(lengths[x] for x in b) for b in state.bins]
        if max(state.fill) > 100:
            continue
        rises = [0]
        one, two = ([(), *((x,) for x in b), *((x, y) for k, x in enumerate(b) for y in b[k + 1 :])] for b in state.bins)
        for give in one[1:]:
            for take in two:
                if len(give) + len(take) <= 3 and 1 in (len(give), len(take)):
                    gain = sum(lengths[x] for x in give) - sum(lengths[x] for x in take)
                    if 0 < gain <= 100 - state.fill[1]:
                        rises.append((state.fill[0] - gain) ** 2 + (state.fill[1] + gain) ** 2 - state.fill[0] ** 2 - state.fill[1] ** 2)
        found = state._best(0, np.array([1]))
        gain = found[1] - found[2] if found else 0
        assert max(rises) == 2 * gain * (gain + state.fill[1] - state.fill[0])


def test_packing_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    rng = random.Random(1)
    items = spark.createDataFrame([(i, rng.choice((100, 700, 1500, 2100, 4096))) for i in range(700)], "ordinal long, length long")
    rows = packing.pack_pieces(packing.staged(items, "items")).collect()
    together = len(set(packing.pack([r.length for r in rows], 4096)[0]))
    assert len(rows) == 700 and check_packing(rows) <= together + 2


def test_local_search_empties_bins():
    state = packing.Bins([60, 60, 50, 50, 40, 40], 100)
    state.bins, state.fill = [[0], [1], [2, 4], [3, 5]], [60, 60, 90, 90]
    before = sum(f * f for f in state.fill)
    state.local_search()
    assert sum(1 for b in state.bins if b) == state.least == 3 and sum(f * f for f in state.fill) > before
    assert sorted(x for b in state.bins for x in b) == list(range(6))


def test_packing_odd(odd, empty, clashing):
    for df in (odd, clashing):
        rows = packing.pack_documents(df).collect()
        check_packing(rows)
        assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1} and len([r for r in rows if r.doc_id == 4]) == 2 and len([r for r in rows if r.doc_id == 6]) > 10
    assert packing.pack_documents(empty).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in real(spark).orderBy("doc_id").collect():
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op8_huffman_ids"](spark, DIR).collect()) == want


def test_token_files_odd(spark, odd, empty, clashing):
    for df in (odd, clashing):
        rows = huffman.read_ids(spark, huffman.write_ids(df), with_ids=True).orderBy("start").collect()
        assert len(rows) == len(ODD) and rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
        assert all(len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
        assert [r.doc_id for r in rows] == sorted((d[0] for d in ODD), key=lambda x: (x is not None, x or 0))
    assert huffman.read_ids(spark, huffman.write_ids(empty)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_huffman_codes(seed):
    rng = np.random.default_rng(seed)
    n = (1, 2, 300, 60_000)[seed]
    counts = np.zeros(65_000, np.int64)
    counts[rng.choice(65_000, n, replace=False)] = (rng.pareto(0.6, n) * 10).astype(np.int64) + 1
    lengths = huffman.code_lengths(counts)
    used = lengths[counts > 0].astype(int)
    assert (lengths[counts == 0] == 0).all() and used.max() <= 16 and (0.5**used).sum() <= 1
    if 1 < n < 1000:  # as good as unlimited Huffman, where that is no longer than the limit
        import heapq

        heap = [(int(c), i, 0) for i, c in enumerate(counts[counts > 0])]
        heapq.heapify(heap)
        cost, deepest = 0, 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost, deepest = cost + a[0] + b[0], max(a[2], b[2]) + 1
            heapq.heappush(heap, (a[0] + b[0], len(counts) + len(heap), deepest))
        assert (counts * lengths).sum() >= cost and ((counts * lengths).sum() == cost or deepest >= 16)
    p = counts / counts.sum()
    codes, table = huffman.canonical_codes(lengths), huffman.decode_table(lengths)
    blocks = [rng.choice(65_000, k, p=p) for k in (1, 255, 256, 257, 5000)]
    coded = [(*huffman.encode_block(b, codes, lengths), len(b)) for b in blocks]
    assert all((a == b).all() for a, b in zip(huffman.decode_blocks(coded, table), blocks, strict=True))


# 7 language identification and 10 toxicity

def test_language_query(spark):
    truth = {r.doc_id: r.lang for r in real(spark).collect()}
    rows = QUERIES["op7_language_id"](spark, DIR).collect()
    assert {r.doc_id for r in rows} == set(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.93 * len(held)


def test_language_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.new_params(3, rng).items()}
    check_gradients(p, *_lang_loss(p))


def _lang_loss(p):
    runs, y = [b"abc", b"d", b"efgh"], np.array([0, 2, 1])

    def loss(q):
        prob, mask, _ = langid.positions(q, runs)
        return -(np.log(prob[:, np.arange(3), y]) * mask[..., 0]).sum() / mask.sum()

    captured = {}

    class Stop(Exception):
        pass

    return runs, y, loss, captured, Stop


def check_gradients(p, runs, y, loss, captured, stop):
    """One training step's gradients against differences; the step's rule is replaced by one that keeps them."""
    from quire.llm import gru

    class Keep(gru.Adam):
        def step(self, grads, clip=1.0):
            captured.update({k: v.copy() for k, v in grads.items()})
            raise stop

    class OneRng:
        def choice(self, own, n):
            return np.resize(own, 1)

    original, makes, rng = gru.Adam, langid.new_params, np.random.default_rng
    gru.Adam, langid.new_params = Keep, lambda n, r: p
    try:
        np.random.default_rng = lambda seed=None: OneRng()
        with pytest.raises(stop):
            langid.train(runs, y, 3)
    finally:
        gru.Adam, langid.new_params, np.random.default_rng = original, makes, rng
    order = [int(np.flatnonzero(y == k)[0]) for k in range(3)]
    assert sorted(order) == [0, 1, 2]
    for name, g in captured.items():
        flat = np.argsort(-np.abs(g).reshape(-1))[:4]
        for i in flat:
            old = p[name].reshape(-1)[i]
            p[name].reshape(-1)[i] = old + 1e-3
            up = loss(p)
            p[name].reshape(-1)[i] = old - 1e-3
            down = loss(p)
            p[name].reshape(-1)[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4), name


def test_fast_states_equal_training_states():
    rng = np.random.default_rng(1)
    p = langid.new_params(4, rng)
    model = langid.Model(list("abcd"), p)
    runs = [b"some", b"runs", b"that", b"go  "]
    prob, mask, _ = langid.positions(p, runs)
    fast = langid.pooled(langid.Scorer(model).params, runs)
    np.testing.assert_allclose(fast, (prob * mask).sum(axis=0), rtol=1e-4)


def test_language_odd(spark, odd, empty, clashing):
    model = langid.fit(odd)
    for df in (odd, clashing):
        rows = langid.predict(df, model).collect()
        assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.text is None or not any(map(str.isalpha, r.text))} == {"und"}
        kept = langid.keep_identified(df, model)
        assert kept.columns == df.columns and kept.count() <= 8
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"} and langid.predict(empty, model).count() == 0


def toxic_corpus(n=900):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        w = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}" for _ in range(rng.choice((8, 40, 150)))]
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(("zzgrub", "vilthing", "scumbag"))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_learns_and_scores_whole_texts():
    rows = toxic_corpus()
    model = toxicity.train([t for i, t, _ in rows if i % 4 != 2], np.array([y for i, _, y in rows if i % 4 != 2]), 1 / 3)
    scorer = toxicity.Scorer(model)
    held = [r for r in rows if r[0] % 4 == 2]
    predicted = scorer.scores([t for _, t, _ in held]) >= toxicity.THRESHOLD
    assert (predicted == np.array([y for *_, y in held])).mean() >= 0.9
    clean = " ".join(t for _, t, y in held if not y)
    a, b = scorer.scores([clean * 3, clean + " scumbag vilthing " + clean])
    assert b > a
    assert scorer.scores([None, "", " 12 ."]).tolist() == [0, 0, 0]


def test_windows_overlap_and_cover():
    for n in (1, 15, 32, 33, 48, 49, 500):
        starts = toxicity.windows_of(n)
        covered = {w for s in starts for w in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_query(spark):
    rows = QUERIES["op10_toxicity"](spark, DIR).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_accuracy(spark):
    """Held-out labels of sf0.01: few teach (about forty toxic ones), yet most are right and toxic ones score higher."""
    where = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in real(spark, "labels", where).collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in QUERIES["op10_toxicity"](spark, where).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    bad, good = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert sum(p == y for _, p, y in held) >= 0.88 * len(held)
    assert sum(a > b for a in bad for b in good) >= 0.7 * len(bad) * len(good)


def test_long_documents_teach_by_windows_of_their_whole_text():
    place = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    text = " ".join(map(place, range(20_000)))
    windows, whole = toxicity.lessons_of(text, 5)
    assert not whole and len(windows) == toxicity.LESSONS and windows == toxicity.lessons_of(text, 5)[0] != toxicity.lessons_of(text, 6)[0]
    late = {place(i).encode() for i in range(10_000, 20_000)}
    assert 20 < sum(w[0] in late for w in windows) < toxicity.LESSONS - 20
    assert toxicity.lessons_of("a b", 1) == ([[b"a", b"b"]], True) and toxicity.lessons_of(None, 1) == ([], True)


def test_conflicting_labels_count_as_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i} word") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(20) for t in (0, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).constant == 1.0


def test_languages_are_bounded_and_long_documents_teach_from_all_of_their_text(spark):
    docs = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, max_langs=4)
    import pyarrow as pa

    text = " ".join(f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}" + "x" * (i // 64 % 7) for i in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text]), pa.array([12345])], names=["lang", "text", "_h"])
    (runs,) = next(iter(langid._lessons(200)([batch])))["runs"].to_pylist()
    assert len(runs) == 200 and runs != [w.encode() for w in text.split()[:200]]


def test_toxicity_odd(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (8, None), (99, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    for df in (odd, clashing):
        rows = toxicity.predict(df, model).collect()
        assert len(rows) == len(ODD) and all(r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
        assert toxicity.drop_toxic(df, model).columns == df.columns
    assert toxicity.predict(empty, model).count() == 0
    assert {r.score for r in toxicity.predict(odd, toxicity.fit(odd, labels.where("false"))).collect()} == {0.0}


# 9 mixing

def check_mix(rows, sources):
    taken, sizes, target = {}, {}, {}
    for r in rows:
        s = sources[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        sizes[s] = sizes.get(s, 0) + r["size"]
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted(target, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, mixing.weights_by_order(len(order)), strict=True))
    total = sum(sizes.values())
    share = sorted(order, key=lambda s: 3 * sizes[s] / weights[s])
    left, weight = total, sum(weights.values())
    for s in share:  # the fill level, one source after the other
        want = min(3 * sizes[s], left * weights[s] / weight)
        assert target[s] == pytest.approx(want, rel=1e-9)
        left, weight = left - want, weight - weights[s]
    return taken, target


def test_mixing_query(spark):
    docs = real(spark).collect()
    sources = {r.doc_id: r.source for r in docs}
    rows = QUERIES["op9_mixing"](spark, DIR).collect()
    assert {r.doc_id: r["size"] for r in rows} == {r.doc_id: len(words(r.text)) for r in docs}
    taken, target = check_mix(rows, sources)
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op9_mixing"](spark, DIR).collect()))


def test_splitting_tree_and_draws(spark):
    leaves = mixing.splitting_tree([1000, 10, 0, 357], 7, np.random.default_rng(1))
    assert leaves.sum(axis=0).tolist() == [1000, 10, 0, 357] and leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3
    mix = mixing.Mix(real(spark), shards=5)
    rows = mix.occurrences().collect()
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append(r.block)
    assert all(sorted(b) == list(range(len(b))) for b in per.values())  # disjoint, and none left out
    shards = [sum(r.shard == k for r in rows) for k in range(5)]
    assert max(shards) - min(shards) <= 3
    for k in range(5):  # the local shuffle numbers a shard without gaps, by key
        mine = sorted((r.place, r.shuffle_key) for r in rows if r.shard == k)
        assert [p for p, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_the_mix_follows_the_leaves_of_the_tree(spark):
    """The quotas of the leaves, rebuilt from the query's rows, are the tree's."""
    rows = QUERIES["op9_mixing"](spark, DIR).collect()
    mix = mixing.Mix(real(spark))
    source = {r.doc_id: r.source for r in real(spark).collect()}
    tree = mixing.splitting_tree([s["quota"] for s in mix.sources], 16, np.random.default_rng(mix.seed))
    got = np.zeros_like(tree)
    names = [s["source"] for s in mix.sources]
    for r in rows:
        for shard in r.shards:
            got[shard, names.index(source[r.doc_id])] += 1
    assert (got == tree).all()
    places = sorted((s, p) for r in rows for s, p in zip(r.shards, r.places, strict=True))
    assert places == [(k, p) for k in range(16) for p in range(int(tree[k].sum()))]


def test_mix_repeats_documents(spark):
    docs = real(spark)
    mix = mixing.Mix(docs)
    sizes = {r.doc_id: r["size"] for r in mix.documents().collect()}
    want = sorted((b.shard, b.shuffle_key, b.doc_id) for b in mix.occurrences().collect() if 2 * b.words >= sizes[b.doc_id])
    got = mix.repeat(docs).withColumn("file", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).select("file", "at", "doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(d for *_, d in want)
    # inside a partition rows come by shard and in the shard's local shuffle
    place = {}
    for k, (_, _, d) in enumerate(want):
        place.setdefault(d, []).append(k)
    for file in {r.file for r in got}:
        at = -1
        for d in (r.doc_id for r in got if r.file == file):
            at = next(k for k in place[d] if k > at)


def test_mixing_odd(spark, odd, empty, clashing):
    for df in (odd, clashing):
        mix = mixing.Mix(df)
        rows = mix.documents().collect()
        assert len(rows) == len(ODD) and {r["size"] for r in rows if r.doc_id in (1, 2, 3)} == {0}
        sizes = {(r.source, r["rank"]): r["size"] for r in mix.ranked.collect()}
        assert mix.repeat(df).columns == df.columns and mix.repeat(df).count() == sum(2 * b.words >= sizes[b.source, b["rank"]] for b in mix.occurrences().collect())
    assert mixing.Mix(empty).documents().count() == 0 and mixing.Mix(empty).repeat(empty).count() == 0


def test_targets_stop_at_three_times_the_size():
    assert mixing.fill_targets([10, 1000], [5, 1]) == [30.0, 980.0]
    assert mixing.fill_targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert mixing.fill_targets([], []) == []
