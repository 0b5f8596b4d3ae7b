"""Best-fit packing, hard negatives and the prefix trie against brute force, and on odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landloom.llm import bestfit, negatives, queries, trie

PATH = public_tokenizers.path("word_bpe_49k.json")


# Best-fit packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=25))
def test_search_keeps_every_piece_and_never_takes_more_bins(counts):
    start, least = bestfit.best_fit(counts, 60), bestfit.fewest(counts, 60)
    end = bestfit.improved(start, 60, least, 2_000)
    for bins in (start, end):
        held = Counter()
        for pattern, n in bins.items():
            assert sum(pattern) <= 60 and n > 0
            held.update({k: n * times for k, times in Counter(pattern).items()})
        assert held == Counter(counts)
    assert least <= end.total() <= start.total()
    assert sum(n * sum(p) ** 2 for p, n in end.items()) >= sum(n * sum(p) ** 2 for p, n in start.items())


def test_search_empties_bins_that_best_fit_leaves():
    rng = random.Random(3)
    pieces = []
    for _ in range(300):
        a, b = rng.randint(520, 800), rng.randint(520, 800)
        pieces += [a, b, 2048 - a - b]
    counts = Counter(pieces)
    start = bestfit.best_fit(counts, 2048).total()
    end = sum(n for n, _ in bestfit.pack_best(counts, 2048))
    assert bestfit.fewest(counts, 2048) == 300 and start > 320 and end < 300 + (start - 300) / 2


def exchanges_left(bins, max_len):
    """Whether a move, or an exchange of one for one or two for one, still raises squared fill; by trying all."""
    flat = [list(p) for p, n in bins.items() for _ in range(min(n, 2)) if sum(p) < max_len]
    sums = [[{(0,): 0} | {(x,): x for x in p}, {(x, y): x + y for i, x in enumerate(p) for y in p[i + 1 :]}] for p in flat]
    for i, p in enumerate(flat):
        for j, q in enumerate(flat):
            if i != j and sum(p) <= sum(q):
                pairs = [(g, s) for g in sums[i][0].values() for s in [*sums[j][0].values(), *sums[j][1].values()]] + [(g, s) for g in sums[i][1].values() for s in sums[j][0].values()]
                if any(0 < g - s <= max_len - sum(q) for g, s in pairs):
                    return True
    return False


def test_search_ends_where_no_exchange_gains():
    for seed in range(8):
        rng = random.Random(seed)
        counts = Counter(rng.randint(7, 29) for _ in range(60))
        end = bestfit.improved(bestfit.best_fit(counts, 60), 60, 0)
        assert not exchanges_left(end, 60)


@pytest.mark.parametrize("copies", [0, 40])
def test_best_packed_holds_every_id_once(spark, sf, copies):
    texts = [None, "", " ", "one", "two words", "x " * 5000, "don't <|endoftext|>", *["same text again"] * copies]
    docs = spark.createDataFrame([(None if k == 3 else k % 40, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({"piece": F.lit("clash"), "length": F.lit(1), "part": F.lit(2)})
    if copies:
        docs = docs.repartition(5).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("c").alias("piece"), F.lit(1).alias("length"), F.lit(2).alias("part")))
    tok, want, total = Tokenizer.from_file(PATH), Counter(), 0
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 7], "<u4")
        total += len(ids)
        want.update((r.doc_id, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(ids), 64)))
    got = bestfit.best_packed(docs, PATH, end_id=7, max_len=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= bestfit.fewest(Counter(r.length for r in got), 64) + 1 and len(by) >= -(-total // 64)
    assert bestfit.best_packed(docs.filter("false"), PATH).count() == 0


def test_op11_is_as_full_as_can_be(spark, sf):
    got = queries.op11_best_fit_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    tok = Tokenizer.from_file(PATH)
    n = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert got.groupby("doc_id").length.sum().to_dict() == n and got.sequence_id.nunique() <= -(-sum(n.values()) // 2048) + 1


# Hard negatives


def brute_negatives(rows, every, k_pos, k_neg, low, high, scale):
    usable = set()
    for vec_id, label, v in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x * scale) < negatives.LARGEST for x in v):
            usable.add((vec_id, label, tuple(int(np.floor(scale * x)) for x in v)))
    out, order = Counter(), lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a in usable:
        if a[0] is None or a[0] % every:
            continue
        scored = [(r[0], sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[1] == a[1]) for r in usable if r[0] != a[0]]
        for pid, ps, _ in sorted((r for r in scored if r[2]), key=order)[:k_pos]:
            hard = sorted((r for r in scored if not r[2] and low * ps <= 100 * r[1] <= high * ps), key=order)[:k_neg]
            out.update((a[0], pid, at + 1, n[0], ps, n[1]) for at, n in enumerate(hard))
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"q": F.lit("clash"), "chunk": F.lit(1), "score": F.lit(2)})


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rng = np.random.default_rng(seed)
    dims = 5
    centre = rng.normal(size=(4, dims))
    rows = [(k, 0 if rng.random() < 0.4 else int(rng.integers(0, 4)), [float(x) for x in np.round(centre[k % 4] + rng.normal(size=dims), 1 + seed % 2)]) for k in range(300)]
    rows += [(None, 1, [0.5] * dims), (None, 0, [1.5] * dims), (10, None, [1.0] * dims), (20, 1, None), (30, 2, [1.0, None, 2.0, 0.0, 0.0]), (40, 2, [float("nan")] * dims), (50, 1, [float("inf")] * dims)]
    rows += [(60, 3, [0.0] * dims), (70, 3, []), (71, 3, [9.0] * 7), (72, 0, [1e300] * dims), rows[0], rows[0], rows[5], (7, 2, [2.0] * dims), (10, 2, [2.0] * dims)]
    got = negatives.hard_negatives(vectors_of(spark, rows).repartition(3), every=10, positives=3, negatives=4, low=60, high=95, scale=16)
    want = brute_negatives(rows, 10, 3, 4, 60, 95, 16)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert negatives.hard_negatives(vectors_of(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 23])
def test_threshold_scan_is_exact_at_all_sizes_of_numbers(spark, size):
    rng = np.random.default_rng(size)
    rows = spark.createDataFrame([(k, 1, [int(x) for x in rng.integers(-size, size + 1, 6)], k) for k in range(400)], "vec_id long, label int, q array<int>, akey long").toArrow()
    lists = negatives.Lists(rows, 6, size)
    for anchor in [np.zeros(6, np.int64), *rng.integers(-size, size + 1, (20, 6))]:
        score = lists.q @ anchor
        spans = [(-(1 << 62), 1 << 62), (0, int(score.max())), (int(score.max()) + 1, 1 << 62), (int(np.median(score)), int(np.median(score)))]
        for (low, high), (places, scores) in zip(spans, lists.scan(anchor, np.arange(400) % 3 > 0, spans, 5), strict=True):
            want = sorted((-int(s), k) for k, s in enumerate(score) if k % 3 and low <= s <= high)[:5]
            assert [(-s, p) for s, p in zip(scores.tolist(), places.tolist(), strict=True)] == want


def test_op12_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = queries.op12_hard_negatives(spark, sf)
    want = duck.sql(negatives.hard_negatives_sql())
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall()) and got.count() > 50


# Prefix trie


def brute_trie(paths):
    """Nodes of {conv_id: [(key, chars), ...]} by comparing whole prefixes."""
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(t[0] for t in path[:d])].append(conv)
    chars = {tuple(t[0] for t in p[:d]): p[d - 1][1] if d else 0 for p in paths.values() for d in range(len(p) + 1)}
    out = Counter()
    for node, convs in members.items():
        children = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out[(min(convs), len(node), parent, len(convs), len(children), leaves, sum((len(members[n]) - 1) * chars[n] for n in below), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def brute_rebuilt(rows, group=100, heads=6):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns[conv].append((turn is not None, turn or 0, mark, (role, text)))
    own = {c: [((t[3]), len(t[3][1])) for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % heads, c - (abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def odd_turns(seed):
    rng = random.Random(seed)
    rows = [(100 * g + c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", None, "", "ccc"])) for g in range(4) for c in range(25) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1090) for t in range(3)]  # many copies of one path
    rows += [(2000, t, "user", "x" * (t % 3)) for t in range(60)] + [(2001, t, "user", "x" * (t % 3)) for t in range(61)]  # long paths that share much
    rows += [(None, 1, "user", "nobody's"), (-7, 1, "user", "a"), (-100, 1, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (777, 5, "user", "no base, short")]
    return rows


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 20_000), (2, 40), (3, 7), (4, 1)])
def test_trie_against_brute_force(spark, seed, shard_turns):
    rows = odd_turns(seed)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit("clash"), "shard": F.lit(1), "key": F.lit(2)}).repartition(5)
    convs = trie.rebuilt(trie.conversations(turns, trie.digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")))
    got = trie.prefix_trie(convs, shard_turns)
    want = brute_trie(brute_rebuilt(rows))
    assert Counter(map(tuple, got.collect())) == want


def test_trie_of_nothing_and_of_paths_without_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.shared_openings(none).count() == 0
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(201, 300)}
    short = [c for c in h if h[c] >= 1]
    rows = [(c, 0, "user", "gone") for c in short]  # fewer own turns than h, and no conversation 200
    got = trie.shared_openings(spark.createDataFrame(rows, none.schema)).collect()
    ends = hashlib.sha256(",".join(map(str, sorted(short))).encode()).hexdigest()
    assert list(map(tuple, got)) == [(min(short), 0, None, len(short), 0, 1, 0, ends)]


def test_copies_of_a_path_are_dealt_to_shards():
    sample = sorted([(b"a" * 32, k) for k in range(60)] + [(b"b" * 16 + bytes([k]) * 16, k) for k in range(20)])
    bounds = trie.splitters(sample, 8)
    assert len(bounds) == 7 and sum(key == b"a" * 32 and conv >= 0 for key, conv in bounds) >= 4
    assert trie.Skeleton(bounds).depth.count(0) == 1
    assert trie.common_turns(b"a" * 48, b"a" * 40 + b"b" * 24) == 2 and trie.common_turns(b"", b"a" * 16) == 0


def test_turns_of_nodes(spark):
    turns = spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    convs = trie.conversations(turns, trie.digest().alias("digest"), F.length("text").alias("chars"), "role", "text")
    got = trie.with_turns(trie.prefix_trie(convs.select("conv_id", F.transform("path", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("path"))), convs)
    assert sorted((r.depth, r.n_convs, r.turn and r.turn.text) for r in got.collect()) == [(0, 2, None), (1, 2, "hi"), (2, 1, "yes")]


def test_op13_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got, want = queries.op13_prefix_trie(spark, sf), duck.sql(trie.shared_openings_sql())
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())
