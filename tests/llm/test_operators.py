"""Each operator against brute force, on odd rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, mixture, passages, pii, quality, search, simhash, substrings, tokens, urlfilter
from fieldloom.llm.common import connected_components


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- SimHash ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(found: list[tuple[int | None, int]], radius: int) -> dict[int, int | None]:
    prints = sorted({f for _, f in found})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    low: dict[int, int] = {}
    for d, f in found:
        if d is not None:
            low[root(f)] = min(d, low.get(root(f), d))
    return {f: low.get(root(f)) for f in prints}


def test_simhash(docs, texts):
    got = sorted(rows_of(simhash.components(docs)), key=repr)
    prints = [(d, slow_fingerprint(t)) for d, t in texts]
    label = slow_components(prints, 3)
    want = [(d, f - (1 << 64) if f >> 63 else f, label[f]) for d, f in prints]
    assert got == sorted(want, key=repr)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(0, 6))
def test_forest_links_all_within_radius(seed, n, radius):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) % 2**64 for _ in range(n)], np.uint64)
    fps = np.unique(centres[rng.integers(0, 4, n)] ^ flips).view(np.int64)
    keys = np.sort(rng.integers(0, 3, len(fps)))
    src, dst = simhash.forest(keys, fps, radius)
    linked = Counter(zip(src.tolist(), dst.tolist(), strict=True))
    for k in np.unique(keys):
        own = [int(x) & (2**64 - 1) for x in fps[keys == k]]
        want = slow_components([(i, f) for i, f in enumerate(own)], radius)
        parent = {f: f for f in own}

        def root(f, parent=parent):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in linked:
            a, b = a & (2**64 - 1), b & (2**64 - 1)
            if a in parent and b in parent:
                assert (root(a) == root(b)) or parent.update({root(a): root(b)}) is None
        for f in own:
            for g in own:
                assert (want[f] == want[g]) == (root(f) == root(g))


def test_components_of_long_chains(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "src long, dst long")
    got = dict(rows_of(connected_components(edges)))
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}


def test_hot_buckets_are_split(spark):
    rng = random.Random(8)
    top = rng.getrandbits(40) << 24
    prints = sorted({top | rng.getrandbits(24) if rng.random() < 0.9 else rng.getrandbits(64) for _ in range(700)})
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(prints)]
    found = rows_of(simhash.links(spark.createDataFrame([(f,) for _, f in signed], "fp long"), 3, 40))
    label = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(found or [(0, 0)], "src long, dst long")).collect()}
    want = slow_components([(i, f & (2**64 - 1)) for i, f in signed], 3)
    groups = defaultdict(set)
    for _, f in signed:
        groups[label.get(f, f)].add(f & (2**64 - 1))
    other = defaultdict(set)
    for f, low in want.items():
        other[low].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_hot_sets_are_split(spark):
    from tests.llm.conftest import prose

    rng = random.Random(9)
    frame, rows = prose(rng, 120).split(), []
    for i in range(90):
        own = list(frame)
        own[rng.randrange(len(own))] = f"x{i}"
        if i % 3 == 0:
            for at in rng.sample(range(120), 4):
                own[at] = f"y{i}x{at}"
        rows.append((i, " ".join(own)))
    seen, sets = simhash.set_groups(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 5, 8, 8, 16)
    got = defaultdict(set)
    for r in seen.join(sets, ["set_a", "set_b"]).select("doc_id", "label").collect():
        got[r["label"]].add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, slow_groups(rows)))


def slow_groups(rows: list[tuple[int | None, str | None]], similarity: float = 0.8) -> list[set[int]]:
    """Numbers of rows by group, from all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    out = defaultdict(set)
    for i in range(len(rows)):
        out[root(i)].add(i)
    return list(out.values())


def slow_kept(rows: list[tuple[int | None, str | None]]) -> Counter:
    """The (doc_id, texts that may stay) of each group."""
    out = Counter()
    for group in slow_groups(rows):
        best = min(rows[i][0] if rows[i][0] is not None else 1 << 62 for i in group)
        own = None if best == 1 << 62 else best
        out[own, frozenset(rows[i][1] or "" for i in group if rows[i][0] == own)] += 1
    return out


def check_kept(kept, rows):
    want = slow_kept(rows)
    assert len(kept) == sum(want.values())
    for doc, text in kept:
        found = [k for k in want if k[0] == doc and (text or "") in k[1] and want[k]]
        assert len(found) == 1
        want[found[0]] -= 1


def test_keep_one(docs, texts):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    check_kept([(r["doc_id"], r["text"]) for r in kept.collect()], texts)


def test_keep_one_of_repeated_ids(spark):
    from tests.llm.conftest import prose

    rng = random.Random(11)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (7, e), (7, e), (None, e), (None, "x y"), (None, "x y"), (None, None), (None, "")]
    table = spark.createDataFrame([(*r, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, extra map<string,int>").repartition(5)
    kept = [(r["doc_id"], r["text"] or "") for r in simhash.keep_one(table).collect()]
    assert Counter(kept) == Counter([(3, a), (5, b), (7, c), (7, d), (7, e), (None, "x y"), (None, "")])


def test_templates_below_the_similarity_all_stay(spark):
    from tests.llm.conftest import prose

    rng = random.Random(5)
    frame, rows = prose(rng, 230).split(), []
    for i in range(60):  # pairs keep 0.6 to 0.79 of their shingles, and chain if a radius alone decides
        own = list(frame)
        for at in rng.sample(range(0, 226, 5), rng.randint(4, 7)):
            own[at] = f"own{i}x{at}"
        rows.append((i, " ".join(own)))
    check_kept([tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()], rows)


def test_similar_sets_group(spark):
    from tests.llm.conftest import prose

    rng = random.Random(4)
    rows, base = [], [prose(rng, 200).split() for _ in range(60)]
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        near = list(words)
        for at in rng.sample(range(10, 190), 1 + i % 3):  # each change costs five shingles of either side
            near[at] = "changed"
        rows.append((100 + i, " ".join(near)))
        rows.append((200 + i, " ".join(words[:60] + prose(rng, 140).split())))  # a passage in common is not a copy
    rows += [(300, rows[0][1].encode().upper().decode()), (301, "")]
    got = {d: c for d, _, _, c in rows_of(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got[300] == 0 and got[301] == 301
    assert all(got[100 + i] == i for i in range(60))
    assert all(got[200 + i] == 200 + i for i in range(60))


# --- search -----------------------------------------------------------------------------------------------------------


def slow_search(rows: list[tuple[int | None, str | None]], k: int) -> list[tuple[int, int, int, float]]:
    """(query_id, rank, doc_id, score) of all rows whose id is divisible by 20, from every pair of documents."""
    texts: dict[int, str] = {}
    for d, t in rows:
        if d is not None:
            texts[d] = f"{texts[d]}\n{t or ''}" if d in texts else t or ""
    bags = {d: Counter(re.findall(r"[^\W_]+", t.lower())) for d, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    out = []
    for q in sorted(bags):
        if q % 20:
            continue
        score = Counter()
        for w in bags[q]:
            idf = log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
            for d, b in bags.items():
                if b[w]:
                    score[d] += idf * (b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)))
        for rank, (s, d) in enumerate(sorted((-round(s, 9), d) for d, s in score.items())[:k], 1):
            out.append((q, rank, d, round(-s, 6)))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 25, 1500])
def test_search_is_exact(spark, tmp_path, monkeypatch, texts, shard_bytes):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(1000 + i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(400)]
    rows += [*texts, (1010, rows[0][1]), (1400, rows[0][1]), (-40, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in search.query(spark, str(tmp_path)).collect())
    assert [(q, n, d) for q, n, d, _ in got] == [(q, n, d) for q, n, d, _ in slow_search(rows, 10)]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, slow_search(rows, 10), strict=True))


def test_search_sends_queries_in_rounds(spark, tmp_path, monkeypatch):
    """The copies of queries that go to shards at a time stay under a share of the text; results stay exact."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(200)], k=30))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(search, "SHARD_BYTES", 2500)
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 2)
    sent, whole = [], search.search

    def spy(index, queries, n_docs, mean_length, shards, *rest):
        sizes = [len(r["data"]) for r in queries.collect()]
        sent.append((sum(sizes) * shards, len(sizes)))
        return whole(index, queries, n_docs, mean_length, shards, *rest)

    monkeypatch.setattr(search, "search", spy)
    got = sorted((r["query_id"], r["rank"], r["doc_id"]) for r in search.query(spark, str(tmp_path)).collect())
    assert got == [x[:3] for x in slow_search(rows, 10)]
    room = search.COPIES * sum(len(t) for _, t in rows)
    assert len(sent) > 1 and all(size <= 2 * room or blocks == 1 for size, blocks in sent)


def test_search_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(20, None), (None, "x"), (40, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert [search.query(spark, f"{tmp_path}/{x}").count() for x in "ab"] == [0, 0]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 16]))
def test_block_max_wand_is_exact(seed, dense):
    rng = np.random.default_rng(seed)
    n, vocabulary = int(rng.integers(1, 600)), int(rng.integers(1, 40))
    chance = rng.random(vocabulary) ** 3
    rows = [(np.flatnonzero(rng.random(vocabulary) < chance)) for _ in range(n)]
    ids = rng.permutation(10 * n)[:n].astype("<i8")
    length = rng.integers(1, 90, n).astype("<i4")
    runs, tfs = [], [rng.integers(1, 9, len(r)) for r in rows]
    for part in np.array_split(np.arange(n), 3):
        entries = sorted((int(t), i, int(f)) for i, d in enumerate(part) for t, f in zip(rows[d], tfs[d], strict=True))
        terms = sorted({t for t, _, _ in entries})
        counts = np.array([sum(x[0] == t for x in entries) for t in terms], np.int32)
        places = search.steps(np.array([x[1] for x in entries], "<u2"))
        runs.append(search.joined(ids[part], length[part], places, np.array([x[2] for x in entries], "<i4"), counts, search.text_bytes([f"t{t}" for t in terms])))
    was, (search.DENSE, search.ROOM) = (search.DENSE, search.ROOM), (dense, int(rng.integers(0, 9)))
    shard = search.Shard(runs, 40.0)
    search.DENSE, search.ROOM = was
    asked, wanted, k = [], [], int(rng.integers(1, 12))
    for _ in range(int(rng.integers(1, 5))):
        own = [t for t in range(vocabulary) if f"t{t}" in shard.numbers and rng.random() < 0.7]
        weight = {t: float(rng.random() * 5) + 0.01 for t in own}
        asked.append((np.array([shard.numbers[f"t{t}"] for t in own], np.int64), np.array([weight[t] for t in own])))
        score = Counter()
        for d in range(n):
            parts = [weight[int(t)] * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / 40))) for t, f in zip(rows[d], tfs[d], strict=True) if int(t) in weight]
            if parts:
                score[int(ids[d])] = sum(parts)
        wanted.append(score)
    for (found, got), score in zip(shard.search(asked, k), wanted, strict=True):
        want = sorted((-round(s, 9), d) for d, s in score.items())[:k]
        assert len(found) == len(want) and all(abs(s + w) < 1e-6 for s, (w, _) in zip(got, want, strict=True))
        assert all(d == e or abs(score[d] - score[e]) < 1e-8 for d, (_, e) in zip(found.tolist(), want, strict=True))


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_learns_lines(spark):
    from tests.llm.conftest import prose

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        text = "\n".join(prose(rng, 12) for _ in range(rng.randint(1, 8)))
        bad = i % 4 == 0
        if bad:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(not bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    field = quality.fit(docs, known)
    score = dict(rows_of(quality.score(docs, field)))
    held = {r[0] for r in rows_of(docs.select("doc_id").where(quality.held_out()))}
    assert held == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(score[i] >= 0.7) == bool(y) for i, y in labels if i in held]) > 0.97
    assert {r["doc_id"] for r in quality.keep_good(docs, field).collect()} == {i for i, s in score.items() if s >= 0.7}


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 3])
    unary, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, total = quality.chain(unary, counts, moves)
    want, all_log, want_pairs, at = [], 0.0, np.zeros((2, 2)), 0
    for n in counts:
        u = unary[at : at + n]
        weights, mass, moved = np.zeros(n), 0.0, np.zeros((2, 2))
        for x in np.ndindex(*[2] * n):
            w = np.exp(sum(u[i] * x[i] for i in range(n)) + sum(moves[a, b] for a, b in zip(x, x[1:], strict=False)))
            mass += w
            weights += w * np.array(x)
            for a, b in zip(x, x[1:], strict=False):
                moved[a, b] += w
        want += list(weights / mass)
        want_pairs += moved / mass
        all_log += np.log(mass)
        at += n
    assert np.allclose(good, want) and np.isclose(total, all_log) and np.allclose(pairs, want_pairs)


def slow_score(field, text: str) -> float:
    """A document's score from its lines' probabilities of being good, over all labellings for few lines, else forward and backward."""
    features, _, length = quality.line_features([text.encode()])
    unary = ((features - field.mean) / field.spread) @ field.weights
    n, step = len(unary), np.exp(field.moves)
    ahead, back = [[1.0, math.exp(unary[0])]], [[1.0, 1.0]]
    for t in range(1, n):
        now = [sum(ahead[-1][i] * step[i, j] for i in (0, 1)) * (math.exp(unary[t]) if j else 1.0) for j in (0, 1)]
        ahead.append([x / sum(now) for x in now])
    for t in range(n - 1, 0, -1):
        now = [sum(step[i, j] * (math.exp(unary[t]) if j else 1.0) * back[0][j] for j in (0, 1)) for i in (0, 1)]
        back.insert(0, [x / sum(now) for x in now])
    good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back, strict=True)]
    evidence = sum(g * (w + 1e-3) for g, w in zip(good, length, strict=True)) / sum(w + 1e-3 for w in length)
    return 1 / (1 + math.exp(-min(30, max(-30, field.slope * evidence + field.offset))))


def test_quality_query_by_hand(spark, docs, texts, labels, tmp_path):
    """Every score of the query, given the trained weights, and that they are trained on what they may be trained on."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    field = quality.fit(docs, labels)
    got = quality.query(spark, str(tmp_path)).collect()
    want = Counter((d, round(slow_score(field, t or ""), 6)) for d, t in texts)
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == want
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    same = quality.fit(docs, other)  # held-out labels don't count
    assert np.array_equal(field.weights, same.weights) and (field.slope, field.offset) == (same.slope, same.offset)


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {s for _, s in rows_of(quality.score(docs, quality.fit(docs, none)))} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None)], "doc_id long, quality int")
    assert all(0 <= s <= 1 for _, s in rows_of(quality.score(docs, quality.fit(docs, one))))


# --- decontamination --------------------------------------------------------------------------------------------------


def test_decontamination_catches_reordered_passages(spark):
    from tests.llm.conftest import prose

    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(20, ""), (21, None), (22, "two words"), (None, prose(rng, 9))]
    words = items[4][1].split()
    rows = [(0, "before " + items[3][1] + " after"), (1, " ".join([*words[15:], "gap", *words[:15]])), (2, " ".join(words[:6])), (3, prose(rng, 200)), (4, None), (5, ""), (6, "two words"), (7, "words two"), (8, items[3][1].upper() + " " + items[5][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (decontaminate.BLOCK_CHARS, 700):
        got = {(d, i): (round(c, 3), n) for d, i, c, n in rows_of(decontaminate.pairs(docs, bench, block_chars=chars))}
        assert set(got) == {(0, 3), (1, 4), (6, 22), (8, 3), (8, 5)}
        assert got[1, 4] == (1.0, 2)
        assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench, block_chars=chars).collect()} == {2, 3, 4, 5, 7}


def slow_tiles(a: list[int], b: list[int], least: int) -> int:
    """Words of b covered by greedy string tiling, by definition."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n
        covered += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=25), st.lists(st.integers(0, 3), min_size=3, max_size=20))
def test_tiles_match_the_definition(a, b):
    found = decontaminate.Index([(1, " ".join(f"w{x}" for x in b))], 3).tiles(" ".join(f"w{x}" for x in a))
    tiles = found[0][1] if found else []
    for n, t, i in tiles:
        assert a[t : t + n] == b[i : i + n] and n >= 3
    lengths = [n for n, _, _ in tiles]
    assert lengths == sorted(lengths, reverse=True)
    assert sum(lengths) == slow_tiles(a, b, 3)
    if tiles:
        assert lengths[0] == max(n for n in range(3, 26) for i in range(len(a)) for j in range(len(b)) if a[i : i + n] == b[j : j + n] and i + n <= len(a) and j + n <= len(b))


def test_tiles_of_a_repeated_word():
    import time

    index, start = decontaminate.Index([(1, "la " * 300), (2, "some words that stand alone here")]), time.process_time()
    assert index.matches("la " * 200_000 + "end", 0.5) == [(1, 1.0, 1)]
    assert time.process_time() - start < 60


def test_decontamination_of_a_table_by_brute_force(spark, docs, texts):
    bench = [(1, texts[12][1]), (2, texts[43][1][-200:]), (3, " ".join(texts[3][1].split()[5:30][::-1])), (4, None), (5, "la la la")]
    want = set()
    for d, t in texts:
        a = decontaminate.words(t or "")
        for i, u in bench:
            b = decontaminate.words(u or "")
            if b and len(a) < 400:
                n = slow_tiles(a, b, min(5, len(b)))
                want |= {(d, i, round(n / len(b), 9))} if n / len(b) >= 0.5 else set()
    short = docs.where("text is null or size(split(text, ' ')) < 400")
    got = {(d, i, round(c, 9)) for d, i, c, _ in rows_of(decontaminate.pairs(short, spark.createDataFrame(bench, "item_id long, text string")))}
    assert got == want and len(want) > 5


# --- exact substrings -------------------------------------------------------------------------------------------------


def slow_removed(rows: list[tuple[int | None, bytes]], least: int) -> list[bytes]:
    """What is left of each row."""
    first: dict[bytes, int] = {}
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - least + 1):
                s = b[i : i + least]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, b in rows:
        cut = np.zeros(len(b) + 1, int)
        if d is not None:
            for i in range(len(b) - least + 1):
                if first[b[i : i + least]] < d:
                    cut[i] += 1
                    cut[i + least] -= 1
        out.append(np.frombuffer(b, np.uint8)[np.cumsum(cut)[:-1] == 0].tobytes() if b else b"")
    return out


@pytest.mark.parametrize(("least", "gram", "hot"), [(50, 20, 1000), (24, 8, 1000), (50, 20, 1), (24, 8, 0)])
def test_substrings(docs, texts, least, gram, hot):
    raw = [(d, (t or "").encode()) for d, t in texts]
    want = Counter((d, len(b), k) for (d, b), k in zip(raw, slow_removed(raw, least), strict=True))
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in substrings.dedup(docs, least, gram, hot).collect())
    assert got == want


def test_substrings_in_shares(docs, texts, monkeypatch):
    """Only a share of the anchors' strings is on disk at a time, and results stay exact."""
    seen = []

    def spy(df, label):
        back = cut(df, label)
        if label == "substring-windows":
            seen.append({r["key"] for r in back.select("key").collect()})
        return back

    cut = substrings.cut
    monkeypatch.setattr(substrings, "cut", spy)
    monkeypatch.setattr(substrings, "WHOLE_BYTES", 0)
    raw = [(d, (t or "").encode()) for d, t in texts]
    want = Counter((d, len(b), k) for (d, b), k in zip(raw, slow_removed(raw, 24), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in substrings.dedup(docs, 24, 8, 1).collect()) == want
    assert len(seen) == substrings.PARTS and sum(map(len, seen)) == len(set().union(*seen)) and max(map(len, seen)) < sum(map(len, seen)) / 2


def test_substrings_travel_packed_by_documents(spark, monkeypatch):
    """Places and spans go between tasks in a few rows for each task, not in a row for each of them."""
    from tests.llm.conftest import prose

    rows = {}

    def spy(df, label):
        back = cut(df, label)
        rows[label] = rows.get(label, 0) + back.count()
        return back

    cut = substrings.cut
    monkeypatch.setattr(substrings, "cut", spy)
    rng = random.Random(6)
    shared = [prose(rng, 80) for _ in range(40)]
    raw = [(i, f"{prose(rng, 30)} {' '.join(rng.sample(shared, 4))}".encode()) for i in range(120)]
    docs = spark.createDataFrame([(d, b.decode()) for d, b in raw], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.dedup(docs).collect()}
    assert got == {d: k for (d, _), k in zip(raw, slow_removed(raw, 50), strict=True)}
    assert rows["substring-found"] < 1000 < rows["substring-windows"]


@pytest.mark.parametrize(("rows", "bin_bytes", "batch"), [(1, 1, 1), (7, 200, 3), (1 << 14, 1 << 15, 1000)])
def test_decisions_wherever_batches_end(rows, bin_bytes, batch, monkeypatch):
    """Equal windows have one anchor, so the strings of each are of letters of its own."""
    monkeypatch.setattr(substrings, "ROWS", rows)
    monkeypatch.setattr(substrings, "BIN_BYTES", bin_bytes)
    rng = random.Random(7)
    held = sorted((k, bytes(rng.choices((65 + 2 * k, 66 + 2 * k), k=rng.randint(8, 14))), rng.randint(0, 9)) for k in range(30) for _ in range(rng.choice((1, 2, 9))))
    rng.shuffle(held)
    held.sort(key=lambda x: x[0])
    key, strings, docs = map(list, zip(*held, strict=True))
    sid = substrings.string_ids(strings).tolist()
    table = pa.table([pa.array(key, pa.int64()), pa.array(sid, pa.int64()), pa.array(strings, pa.binary()), pa.array(docs, pa.int64()), pa.array(docs, pa.int64())], ["key", "sid", "string", "first_doc", "last_doc"])
    got = {}
    for out in substrings.decisions(8)(iter(table.to_batches(max_chunksize=batch))):
        for r in out.to_pylist():
            assert (r["key"], r["sid"]) not in got
            got[r["key"], r["sid"]] = [low for _, n, low in struct.iter_unpack("<3q", r["runs"]) for _ in range(n)]
    first = {}
    for k, string, doc in held:
        for i in range(len(string) - 7):
            first[k, string[i : i + 8]] = min(doc, first.get((k, string[i : i + 8]), doc))
    for k, s, string, doc in zip(key, sid, strings, docs, strict=True):
        lows = [first[k, string[i : i + 8]] for i in range(len(string) - 7)]
        assert got.get((k, s), [doc] * len(lows)) == lows


def test_equal_strings_of_many_slices_are_not_cut_up(spark, monkeypatch):
    from tests.llm.conftest import prose

    def never(*_):
        raise AssertionError("cut into windows")

    monkeypatch.setattr(substrings, "crowded_decisions", never)
    shared = prose(random.Random(5), 60)
    alike = spark.createDataFrame([(i, shared if i < 9 else shared + " x") for i in range(12)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.dedup(alike, hot=2).collect()}
    assert got == {0: shared.encode(), **{i: b"" for i in (*range(1, 9), 10, 11)}, 9: b" x"}


def test_anchors_agree_wherever_a_string_stands():
    rng = np.random.default_rng(1)
    shared = bytes(rng.integers(97, 105, 300).astype(np.uint8)) + b"ab" * 100
    for _ in range(20):
        left, right = (bytes(rng.integers(97, 105, rng.integers(0, 90)).astype(np.uint8)) for _ in range(2))
        text = left + shared + right
        data = np.frombuffer(text, np.uint8)
        at, begin, end = substrings.anchors(data, np.array([0, len(text)]), 50, 20)
        of = {j - len(left): int(a) - len(left) for a, b, e in zip(at, begin, end, strict=True) for j in range(b, e + 1)}
        assert sorted(of) == list(range(-len(left), len(text) - 49 - len(left)))
        inside = {j: a for j, a in of.items() if 0 <= j <= len(shared) - 50}
        if _ == 0:
            first = inside
        assert inside == first


@settings(max_examples=50, deadline=None)
@given(st.text("ab", min_size=1, max_size=60), st.integers(2, 12))
def test_intervals_have_right_prefixes(text, depth):
    symbols = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    order, prefix = substrings.expand_intervals(np.r_[symbols, 0], depth)
    whole = text + "$" * 80
    for i in range(1, len(order)):
        a, b = (whole[o:] if o < len(text) else "$" * 80 for o in (order[i - 1], order[i]))
        common = next((k for k in range(depth) if a[k] != b[k]), depth)
        if max(order[i - 1], order[i]) + depth <= len(text):  # past the end a suffix runs on from the start
            assert prefix[i] == common


# --- personal data ----------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_spans(text: str) -> list[str]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if holds[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("a1234. -+@()x9é", max_size=50))
def test_base_spans(text):
    got = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.spans(text, pii.anchors()) if k < 4]
    assert got == slow_spans(text)


def test_added_spans():
    text = 'my IBAN: GB82 WEST 1234 5698 7654 32, token = "04dbebab91ab85687d33" at https://x.example.org/a?b. account 12345678'
    found = {pii.KINDS[k]: text[a:b] for k, a, b in pii.spans(text, pii.anchors())}
    assert found["secret"] == "04dbebab91ab85687d33" and found["url"] == "https://x.example.org/a?b"
    assert "account" in found and pii.iban_holds("GB82 WEST 1234 5698 7654 32") and not pii.iban_holds("GB83 WEST 1234 5698 7654 32")


@pytest.mark.parametrize("cue", ["account", "acct ", "token", "token=", "password:", "a@", "+1 ", "1.", "1", "://", "x://", "IBAN DE11 ", "a.", "+(", "1 1-"])
def test_pii_takes_time_in_proportion(cue):
    import time

    text, start = cue * (1_000_000 // len(cue)), time.process_time()
    pii.spans(text, pii.anchors())
    assert time.process_time() - start < 10  # a quadratic reading of a megabyte takes half an hour


def test_pii_rows(docs, texts):
    got = {(r["doc_id"], r["base_sha256"]) for r in pii.find(docs).collect()}
    assert got == {(d, hashlib.sha256(",".join(slow_spans(t or "")).encode()).hexdigest()) for d, t in texts}


def test_search_multiplies_the_words_of_a_block_only():
    rng, n = np.random.default_rng(2), 6 * search.BLOCK
    terms = [f"{'ab'[i % 2]}{j}" for i in range(n) for j in rng.permutation(40)[:20]]  # two languages
    numbers = {w: i for i, w in enumerate(dict.fromkeys(terms))}
    term = np.array([numbers[w] for w in terms])
    order = np.argsort(term, kind="stable")
    place = np.repeat(np.arange(n, dtype="<u2"), 20)[order]
    run = search.joined(np.arange(n, dtype="<i8"), np.full(n, 20, "<i4"), search.steps(place), np.ones(len(term), "<i4"), np.bincount(term).astype("<i4"), search.text_bytes(list(numbers)))
    shard = search.Shard([run], 20.0)
    assert len(shard.block_most) == 80 and {len(t) for t in shard.tables} == {40}
    asked = [(np.array([shard.numbers[w] for w in terms[20 * i : 20 * i + 20]]), np.ones(20)) for i in range(0, n, 37)]
    for (own, _), (ids, scores) in zip(asked, shard.search(asked, 5), strict=True):
        by_hand = sorted((-round(len(set(own.tolist()) & {shard.numbers[w] for w in terms[20 * i : 20 * i + 20]}), 9), i) for i in range(n))[:5]
        assert [(-round(x), i) for x, i in zip(scores.tolist(), ids.tolist(), strict=True)] == by_hand


def test_search_scores_the_best_of_many_queries_together(monkeypatch):
    """One call for a block of queries, also where it is done in several parts; a posting takes 8 bytes."""
    rng, n = np.random.default_rng(5), 300
    terms = [f"w{j}" for _ in range(n) for j in rng.permutation(90)[:20]]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(terms))}
    term = np.array([numbers[w] for w in terms])
    order = np.argsort(term, kind="stable")
    place = np.repeat(np.arange(n, dtype="<u2"), 20)[order]
    run = search.joined(np.arange(n, dtype="<i8"), np.full(n, 20, "<i4"), search.steps(place), np.ones(len(term), "<i4"), np.bincount(term).astype("<i4"), search.text_bytes(list(numbers)))
    monkeypatch.setattr(search, "DENSE", 4)  # some words are rare, some common
    shard, calls = search.Shard([run], 20.0), []
    assert shard.postings.itemsize == 8
    monkeypatch.setattr(shard, "scores", lambda *x, real=shard.scores: calls.append(1) or real(*x))
    own = [np.array([shard.numbers[w] for w in terms[20 * i : 20 * i + 20]]) for i in range(n)]
    asked = [(own[i], rng.random(20) + 0.5) for i in range(0, n, 7)] + [(np.zeros(0, np.int64), np.zeros(0))]
    got = shard.search(asked, 5)
    assert len(calls) == 1 and len(asked) > search.SCORED and len(got[-1][0]) == 0
    for (words_, weights), (ids, scores) in zip(asked, got, strict=True):
        weight = dict(zip(words_.tolist(), weights.tolist(), strict=True))
        by_hand = sorted((-sum(weight.get(t, 0) for t in own[i].tolist()), i) for i in range(n) if weight)[:5]
        assert ids.tolist() == [i for _, i in by_hand] and np.allclose(scores, [-x for x, _ in by_hand])


# --- URL filter -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bits", "most"), [(12, 1 << 23), (2, 1 << 23), (12, 400)])
def test_cascade_is_exact(spark, monkeypatch, bits, most):
    keys = [(f"h{i}.example.org", i % 7 == 0) for i in range(600)] + [("", False)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    monkeypatch.setattr(urlfilter, "PARTS_AT_ONCE", 2)
    listed = universe.where("listed").select("key").union(spark.createDataFrame([("not.seen",), (None,), ("h0.example.org",)], "key string"))
    cascade = urlfilter.build(listed, universe, bits, most)
    got = {r["key"]: r["in"] for r in cascade.listed(universe.select("key"), "key", "in").collect()}
    assert got == dict(keys)
    assert (cascade.parts > urlfilter.PARTS_AT_ONCE) == (most == 400)
    none = urlfilter.build(universe.limit(0).select("key"), universe)
    assert none.listed(universe.select("key"), "key").where("listed").count() == 0


def test_url_verdicts(spark):
    urls = ["http://A.com/en/x", "https://example.com/en/7?q", "http://x.example.com/en/8", "http://xexample.com/en/7", "http://e.net/de/", "http://e.net/de", "ftp://casino-win.org/", "nourl", None, "http://example.net#/de/8", "x://y://z/en/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "<html>", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.hosts_with_label(pages, urlfilter.LISTED_LABELS)).collect()}
    assert got[0] == ("a.com", "/en/x", "com/en/", "block")
    assert got[1] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("com/en/", "block")
    assert got[4][2:] == ("net/de/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == ("casino-win.org", "/", None, "block")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("example.net", "", None, "allow") and got[10][:2] == ("y:", "//z/en/") and got[11][2] == "com/en/"


def test_url_rules_have_the_words_of_the_contract(spark):
    assert dict((at + start, what) for what, at, start in urlfilter.RULES) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://e.net/de/1", "http://example.net/de/7", "http://www.example.net/de/81", "http://casino-win.net/de/", "http://casino-win.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.hosts_with_label(pages, urlfilter.LISTED_LABELS)).collect()}
    assert got == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: (None, "block")}


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixture(spark, docs):
    mixed = mixture.mix(docs)
    assert set(docs.columns) <= set(mixed.columns)
    by_id = defaultdict(list)
    for r in mixed.collect():
        by_id[r["doc_id"], r["text"]].append((r["copies"], r["copy"]))
    for copies in by_id.values():
        n = copies[0][0]
        assert {c for _, c in copies} == set(range(1, n + 1)) and len({m for m, _ in copies}) == 1


def test_mixture_keeps_clashing_columns(spark, docs):
    assert mixture.mix(docs, added=False).columns == docs.columns
    assert {r["copies"] for r in mixture.mix(docs, added=False).select("copies").collect()} == {9}
    plain = Counter((r["doc_id"], r["text"]) for r in mixture.mix(docs).collect())
    assert Counter((r["doc_id"], r["text"]) for r in mixture.mix(docs, added=False).collect()) == plain


def test_poisson_counts_at_large_rates(spark):
    row = spark.createDataFrame([(1, "x", "s")], "doc_id long, text string, source string")
    got = mixture.rates(row, {"s": 1.0}, total=30000.0).first()
    assert got["rate"] == 30000.0 and got["cdf"] == sorted(got["cdf"]) and got["cdf"][-1] > 1 - 1e-9
    assert abs(got["cdf"][30000] - 0.5) < 0.01 and got["cdf"][0] == 0
    odd = spark.createDataFrame([(None, "x", None), (2, None, "s"), (2, None, "s")], "doc_id long, text string, source string")
    counts = Counter((r["doc_id"], r["source"]) for r in mixture.mix(odd, total=60.0).collect())
    assert counts[None, None] > 20 and counts[2, "s"] > 40 and counts[2, "s"] % 2 == 0


def test_poisson_means_and_weights(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'t' as text", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' else 'c' end as source")
    count = {r["source"]: r["count"] for r in mixture.mix(docs, {"a": 3.0, "b": 1.0}, total=2.0).groupBy("source").count().collect()}
    assert set(count) == {"a", "b"} and abs(count["a"] - 9000) < 500 and abs(count["b"] - 3000) < 300
    few = mixture.mix(spark.createDataFrame([(1, "x", "tiny"), (2, "y", "tiny")], "doc_id long, text string, source string"), {"tiny": 1.0}, total=900.0)
    assert abs(few.count() - 1800) < 250  # a large rate does not underflow


# --- token files ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(1, 64), st.integers(1, 9))
def test_frames_round_trip(values, lanes, every):
    data = np.array(values, np.uint16)
    ids, counts = np.unique(np.r_[data, [3]], return_counts=True)
    table = tokens.FrequencyTable.of_counts(ids.astype(np.int64), counts, 50)
    payload = tokens.encode_frame(data, table, lanes, every)
    assert tokens.decode_frame(payload, table).tolist() == values
    real = max(1, min(lanes, len(values) // 64))
    for point in range(0, -(-len(values) // (real * every)), 2):
        assert tokens.decode_frame(payload, table, point, 1).tolist() == values[point * real * every : (point + 1) * real * every]
    if payload:
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            tokens.decode_frame(bytes(broken), table)


def test_token_rows(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_table(docs).collect()]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter(want)
    got.sort(key=lambda r: r[1])
    assert [d for d, *_ in got] == sorted((d for d, *_ in got), key=lambda d: (d is not None, d or 0))
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n


@pytest.mark.parametrize("text", ["hello <|ENDOFTEXT|> you", "hello <|endoftext|> you", "a<|EndOfText|>b <|endoftext|> c", "<|StartOfText|><|startoftext|>", "<|ENDOFTE\u212aT|>"])
def test_special_tokens_in_any_case(text):
    import public_tokenizers

    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    ids, sizes = coder.encode(["before " + text, text, "plain words"], 2)
    assert ids[sizes[0] : sizes[0] + sizes[1]].tolist() == [*want, 2]


def test_token_files_stand_alone(spark, docs, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, vocabulary = f"file://{tmp_path}/out", public_tokenizers.path("word_bpe_49k.json")
    tokens.write(docs, path, vocabulary, order=[F.xxhash64("text", "doc_id")])
    tokenizer = Tokenizer.from_file(vocabulary)
    want = Counter((d, *tokenizer.encode(t or "", add_special_tokens=False).ids, 2) for d, t in texts)
    assert Counter((r["doc_id"], *r["ids"]) for r in tokens.read_ids(spark.newSession(), path).collect()) == want
    keys = {r["doc_id"]: r["h"] for r in docs.where("doc_id not in (53, 54)").select("doc_id", F.xxhash64("text", "doc_id").alias("h")).collect() if r["doc_id"] is not None}
    got = [r["doc_id"] for r in sorted(tokens.read(spark.newSession(), path).collect(), key=lambda r: r["start"]) if r["doc_id"] in keys]
    assert got == sorted(keys, key=keys.get)
    row = list(spark.read.parquet(f"{path}/table").first())
    row[5] = bytes(row[5][:-1]) + bytes([row[5][-1] ^ 1])
    with pytest.raises(ValueError, match="checksum"):
        tokens.FrequencyTable.unpack(row[0], row[1], row[2], bytes(row[4]), row[5], row[6])


# --- fuzzy passages ---------------------------------------------------------------------------------------------------


def test_passages(spark):
    from tests.llm.conftest import prose

    rng = random.Random(11)
    shared = prose(rng, 80).split()
    edited = list(shared)
    edited[20], edited[45] = "swapped", "other"
    del edited[60]
    rows = [(i, prose(rng, rng.randint(60, 200))) for i in range(60)]
    rows[10] = (10, rows[10][1] + " " + " ".join(shared))
    rows[30] = (30, " ".join(edited) + " " + rows[30][1])
    rows[50] = (50, rows[50][1] + " " + " ".join(shared[:55]) + " " + prose(rng, 30))
    rows += [(70, rows[5][1]), (71, None), (72, ""), (None, rows[5][1]), (73, " ".join(shared[:40])), (74, "so " * 90), (75, "a b so " + "so " * 80)]
    got = rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {(g[0], g[3]) for g in got} - {(50, 30)} == {(30, 10), (50, 10), (70, 5), (75, 74)}  # 50 has the same passage as 10, and may have it of 30 too
    for _, a, b, _, c, e, matches, identity in got:
        assert b - a >= 50 and e - c >= 50 and identity >= 0.8 and matches >= 0.8 * max(b - a, e - c)
    long = next(g for g in got if (g[0], g[3]) == (30, 10))
    assert long[2] - long[1] >= 75


def test_passages_with_scattered_partners(spark):
    from tests.llm.conftest import prose

    rng = random.Random(12)
    shared = prose(rng, 60).split()
    rows = [(500, prose(rng, 60) + " " + " ".join(shared)), (900, " ".join(shared) + " " + prose(rng, 60))]
    for i in range(54):  # every seed of 900 has another smallest and another next smaller document
        for low in (0, 600):
            rows.append((low + i, prose(rng, 40) + " " + " ".join(shared[i : i + 7]) + " " + prose(rng, 40)))
    got = rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert [(g[0], g[3]) for g in got] == [(900, 500)]
    assert got[0][2] - got[0][1] == 60


def test_passages_link_all_of_a_group(spark):
    """Every pair of differently edited copies is linked, not only those with the nearest smaller ones."""
    from tests.llm.conftest import prose

    rng = random.Random(23)
    shared = prose(rng, 90).split()
    rows = []
    for i in range(24):
        part = list(shared)
        for at in rng.sample(range(90), 4):
            part[at] = f"e{i}x{at}"
        rows.append((i, prose(rng, 20) + " " + " ".join(part) + " " + prose(rng, 20)))
    got = {(g[0], g[3]) for g in rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))}
    words = {d: np.array(passages.word_hashes(t), np.uint64) for d, t in rows}
    n = len(words[0])
    want = {(a, b) for a in words for b in words if b < a and passages.align(words[a], words[b], np.array([[0, 0, n]]), 50, 0.8)}
    assert len(want) > 200 and want <= got


def test_passages_link_all_of_a_crowd(spark, monkeypatch):
    """So is every pair of more copies than FULL, also where the crowd meets in parts; unless both hold what a smaller document has, too."""
    from tests.llm.conftest import prose

    rng = random.Random(29)
    shared, rows = prose(rng, 90).split(), []
    for i in range(150):
        part = list(shared)
        if i % 3:
            for at in rng.sample(range(90), 4):
                part[at] = f"e{i}x{at}"
        rows.append((i, prose(rng, 20) + " " + " ".join(part) + " " + prose(rng, 20)))
    words = {d: np.array(passages.word_hashes(t), np.uint64) for d, t in rows}
    n = len(words[0])
    want = {(a, b) for a in words for b in words if b < a and passages.align(words[a], words[b], np.array([[0, 0, n]]), 50, 0.8)}
    monkeypatch.setattr(passages, "PART", 40, raising=False)
    got = rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    linked = {(g[0], g[3]) for g in got}
    copies = defaultdict(set)  # documents that hold a passage of another one as it is
    for g in got:
        if g[7] == 1:
            copies[g[0]].add(g[3])
    assert len(want) > 9000

    def told(a: int, b: int, deep: int = 12) -> bool:
        """By itself, or between what either is a copy of."""
        a, b = max(a, b), min(a, b)
        return a == b or (a, b) in linked or deep > 0 and (any(told(c, b, deep - 1) for c in copies[a]) or any(told(a, c, deep - 1) for c in copies[b]))

    assert {(a, b) for a, b in want if a % 3 and b % 3} <= linked  # every one has edits of its own
    assert all(told(a, b) for a, b in want)


def test_passages_of_repeated_ids(spark):
    from tests.llm.conftest import prose

    rng = random.Random(21)
    shared, second = prose(rng, 80), prose(rng, 90)
    rows = [(1, prose(rng, 100)), (2, prose(rng, 50)), (2, prose(rng, 60) + " " + shared), (7, prose(rng, 70)), (7, shared + " " + prose(rng, 30)), (7, second), (7, second + " x"), (9, second), (9, second), (9, None)]
    got = {(g[0], g[3]) for g in rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {(7, 2), (9, 7)}


def covered(found, min_words: int = 50) -> dict[int, set[int]]:
    """Words of each document that lie in its passages."""
    out = defaultdict(set)
    for doc, start, end in found:
        out[doc] |= set(range(start, end))
    return out


def slow_covered(rows: list[tuple[int, str]]) -> dict[int, set[int]]:
    """Words in passages with a smaller document, from chains of all common words runs of four between all pairs."""
    words, out = {d: np.array(passages.word_hashes(t), np.uint64) for d, t in rows}, []
    places = {d: defaultdict(list) for d in words}
    for d, w in words.items():
        for i in range(len(w) - 3):
            places[d][tuple(w[i : i + 4].tolist())].append(i)
    for d in words:
        for e in words:
            if e < d and (both := places[d].keys() & places[e].keys()):
                diagonal = defaultdict(list)
                for k in both:
                    for i in places[d][k]:
                        for j in places[e][k]:
                            diagonal[i - j].append(i)
                fragments = []
                for shift, own in diagonal.items():
                    own.sort()
                    first = last = own[0]
                    for i in [*own[1:], 10**9]:
                        if i > last + 1:
                            fragments.append((first, first - shift, last - first + 4))
                            first = i
                        last = i
                for path in passages.chain(np.array(fragments, np.int64), passages.MAX_GAP):
                    out += [(d, s, t) for s, t, *_ in passages.align(words[d], words[e], path, 50, 0.8)]
    return covered(out)


@pytest.mark.parametrize("n", [60, 240])
def test_passages_against_all_pairs(spark, n):
    """How much of what chains over all pairs and all runs of four words find is found by way of seeds."""
    from tests.llm.conftest import prose

    rng = random.Random(n)
    pool, rows = [prose(rng, 90).split() for _ in range(n // 6)], []
    for i in range(n):
        own = prose(rng, rng.randint(10, 120)).split()
        if i % 2:
            part = list(rng.choice(pool))
            for at in range(len(part)):
                if rng.random() < 0.06:
                    part[at] = f"e{rng.randrange(10**9)}"
            own += part + prose(rng, rng.randint(0, 30)).split()
        rows.append((i, " ".join(own)))
    want = slow_covered(rows)
    got = covered((g[0], g[1], g[2]) for g in rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))))
    hit, all_ = sum(len(got[d] & want[d]) for d in want), sum(map(len, want.values()))
    assert hit >= 0.95 * all_ and sum(bool(got[d]) for d in want) >= 0.97 * len(want)
    assert sum(len(got[d] - want[d]) for d in got) <= 0.02 * all_


def test_passages_with_many_edits(spark):
    from tests.llm.conftest import prose

    rng = random.Random(13)
    rows = []
    for i in range(40):
        shared = prose(rng, 120).split()
        edited = [f"x{rng.randrange(10**9)}" if j % 6 == 5 else w for j, w in enumerate(shared)]  # no six words in a row stay
        rows += [(i, prose(rng, 60) + " " + " ".join(shared)), (100 + i, prose(rng, 70) + " " + " ".join(edited) + " " + prose(rng, 50))]
    got = rows_of(passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {(g[0], g[3]) for g in got} == {(100 + i, i) for i in range(40)}


def test_passages_align_no_chains_that_end_with_their_texts():
    """Seeds at the very end or beginning of texts, too short to become a passage, are told before words are fetched."""
    from tests.llm.conftest import prose

    rng = random.Random(31)
    shared = prose(rng, 12)
    texts = [prose(rng, 60) + " " + shared, prose(rng, 70) + " " + shared, shared + " " + prose(rng, 60), shared + " " + prose(rng, 70)]
    whole = prose(rng, 70)
    for rows, n in ((texts, 0), ([whole, "one more " + whole], 1)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows)], ["doc_id", "text"])
        sown = sorted((b for x in passages.seed_blobs(4, 5, 50, 1)(iter([batch])) for b in x.to_pylist()), key=lambda x: x["kind"])
        matched = list(passages.seed_matches(1)(iter([pa.RecordBatch.from_pylist(sown)])))
        assert sum(map(len, passages.chains(4, 32, 50)(iter(matched)))) == n


def test_passages_in_shares_of_documents(spark, monkeypatch):
    """Words that many chains want are kept once, travel in shares, and give what all at once give; a stretch may be longer than a piece."""
    from tests.llm.conftest import prose

    rng = random.Random(41)
    base, long = prose(rng, 500).split(), prose(rng, 5000)
    rows = [(0, " ".join(base)), (1, long), (2, prose(rng, 2300) + " " + long)]
    rows += [(10 + i, prose(rng, 40) + " " + " ".join(base[12 * i : 12 * i + 80]) + " " + prose(rng, 40)) for i in range(30)]
    table, kept, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), [], []

    def cut(df, label, real=passages.cut):
        out = real(df, label)
        labels.append(label)
        if label == "passage-words":
            kept.append(out.agg(F.sum(F.octet_length("words"))).first()[0])
        return out

    monkeypatch.setattr(passages, "cut", cut)
    whole = sorted(rows_of(passages.passages(table)))
    assert {(10 + i, 0) for i in range(30)} | {(2, 1)} <= {(r[0], r[3]) for r in whole}
    assert max(r[2] - r[1] for r in whole) > 2 * 2048
    words = sum(len(passages.word_hashes(t)) for _, t in rows)
    assert kept[0] <= passages.WORD_BYTES * words
    monkeypatch.setattr(passages, "WHOLE_BYTES", 1)
    monkeypatch.setattr(passages, "SHARE", 0.2)
    assert sorted(rows_of(passages.passages(table))) == whole
    assert labels.count("passage-found") > 1


@given(st.lists(st.integers(0, 9), max_size=9), st.lists(st.integers(0, 9), max_size=9))
@settings(max_examples=300, deadline=None)
def test_passages_columns_of_gaps(a, b):
    """Gaps with nothing in common, or only in place, take no table; they have a longest common subsequence all the same."""
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
    at = to = matches = 0
    for p, q, same in passages.common_subsequence(a, b):
        assert not (p and q) or same == (a[at] == b[to])
        at, to, matches = at + p, to + q, matches + same
    assert (at, to, matches) == (len(a), len(b), longest[-1][-1])


def test_passages_of_many_fragments_at_once():
    rng = np.random.default_rng(5)
    a, b, fragments = [], [], []
    for i in range(700):
        n = int(rng.integers(20, 200))
        words = rng.integers(0, 1 << 62, n + 40, dtype=np.uint64)
        x, y = (int(v) for v in rng.integers(0, 20, 2))
        own, other = words.copy(), words.copy()
        own[: x // 2] = 1
        changed = rng.random(len(own)) < rng.choice([0, 0.05, 0.15, 0.3])
        if i % 3 == 0:
            changed[n // 2 : n // 2 + int(rng.integers(0, 16))] = True  # two passages may be on either side
        own[changed] = rng.integers(0, 1 << 62, int(changed.sum()), dtype=np.uint64)
        own, other = np.r_[rng.integers(0, 9, x, dtype=np.uint64), own], np.r_[rng.integers(0, 9, y, dtype=np.uint64), other]
        begin = int(rng.integers(0, n))
        a.append(own)
        b.append(other)
        fragments.append((x + begin, y + begin, min(int(rng.integers(4, 60)), n + 40 - begin)))
    flat = [passages.flat_words(pa.array([passages.pack_words(w) for w in side])) for side in (a, b)]
    found, left = passages.align_fragments(*flat[0], *flat[1], np.array(fragments), 50, 0.8)
    want = {(i, *p) for i, f in enumerate(fragments) for p in passages.align(a[i], b[i], np.array([f]), 50, 0.8)}
    assert {tuple(x) for x in found.tolist()} == {x for x in want if x[0] not in set(left.tolist())}
    assert len(found) > 200 and 0 < len(left) < 200


def slow_chain(fragments) -> float:
    """Best chain score by looking at all pairs."""
    f = sorted(map(tuple, fragments.tolist()))
    score = []
    for i, (p, q, n) in enumerate(f):
        best = 0.0
        for j, (r, s, m) in enumerate(f[:i]):
            if r + m <= p and s + m <= q:
                best = max(best, score[j] - passages.GAP_COST * (p - r - m + q - s - m))
        score.append(n + best)
    return max(score)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(3, 9)), min_size=1, max_size=14, unique=True))
def test_chains_have_the_best_score(rows):
    fragments = np.array(rows, np.int64)
    own = passages.chain(fragments, 10**6)[0]
    score = own[:, 2].sum() - passages.GAP_COST * sum(int(b[0] - a[0] - a[2] + b[1] - a[1] - a[2]) for a, b in zip(own, own[1:], strict=False))
    assert abs(score - slow_chain(fragments)) < 1e-9


# --- all of them on odd tables ----------------------------------------------------------------------------------------


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")


@pytest.fixture(scope="session")
def benchmark(spark, texts):
    return spark.createDataFrame([(1, texts[12][1]), (2, None)], "item_id long, text string")


def test_every_operator_takes_odd_and_empty_tables(spark, docs, empty, labels, benchmark):
    for table, n in ((docs, docs.count()), (empty, 0)):
        field = quality.fit(table, labels)
        assert simhash.components(table).count() == n
        assert quality.score(table, field).count() == n
        assert pii.find(table).count() == n
        assert tokens.token_table(table).count() == n
        assert substrings.dedup(table).count() == n
        assert quality.keep_good(table, field).columns == table.columns
        assert decontaminate.keep_clean(table, benchmark).columns == table.columns
        assert (decontaminate.pairs(table, benchmark).count() > 0) == (n > 0)
        assert (mixture.mix(table).count() > 0) == (n > 0)
        assert (passages.passages(table).count() > 0) == (n > 0)
        assert simhash.keep_one(table).columns == table.columns
    assert decontaminate.pairs(docs, benchmark.limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(pages, urlfilter.hosts_with_label(pages, urlfilter.LISTED_LABELS)).count() == 0
