"""N-gram join, conversation trie and Merkle manifest against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordwood.llm import merkle, ngram_join, ordering, prefix_trie
from cordwood.llm.queries import QUERIES
from cordwood.llm.shared import Scratch

TURNS = "conv_id long, turn long, role string, text string"


def few_partitions(spark, monkeypatch, n):
    """So many partitions for sorts that rows of one group lie in several."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return lambda: spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture
def many_partitions(spark, monkeypatch):
    back = few_partitions(spark, monkeypatch, 7)
    yield
    back()


# Places in groups.


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_numbered(spark, many_partitions, monkeypatch, broadcast):
    monkeypatch.setattr(ordering, "BROADCAST_RUNS", broadcast)
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3 + i]), rng.randint(0, 50), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "g long, o long, i long").repartition(5)
    found, _ = ordering.numbered(Scratch(spark, "test"), frame, ["g"], ["o", "i"])
    expected = {}
    groups = defaultdict(list)
    for g, o, i in rows:
        groups[g].append((o, i))
    for g, members in groups.items():
        for k, (_, i) in enumerate(sorted(members)):
            expected[i] = (k, len(members))
    assert {r["i"]: (r["idx"], r["n"]) for r in found.collect()} == expected


# N-gram join.

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def brute_links(rows, width=5, percent=80):
    sets = []
    for row in rows:
        words = SPLIT.findall((row[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        n = max(1, len(words) - width + 1)
        sets.append({tuple(words[i : i + width]) for i in range(n)} if words else set())
    above = list(range(len(rows)))

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    above[find(i)] = find(j)
    least = defaultdict(set)
    for i, row in enumerate(rows):
        least[find(i)].add(row[0])
    expected = Counter()
    for i, row in enumerate(rows):
        known = [d for d in least[find(i)] if d is not None]
        expected[row[0], len(sets[i]), min(known) if known and sets[i] else row[0]] += 1
    return expected


def found_links(frame, **settings):
    found = ngram_join.jaccard_components(frame, ["doc_id"], ngram_join.Settings(**settings)).collect()
    assert all(r["row"]["doc_id"] == r["doc_id"] for r in found)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)


def test_join_on_hard_rows(make, rows):
    assert found_links(make(rows, extra=True)) == brute_links(rows)


def test_join_on_an_empty_table(no_docs):
    assert ngram_join.jaccard_components(no_docs, ["doc_id"]).count() == 0


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


def near_rows():
    """Chains of edits around the threshold, groups that share most of their text without
    being linked, and a passage that very many documents share."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        words = rng.choices(vocabulary, k=rng.choice([6, 12, 60, 150]))
        for _ in range(14):
            rows.append(edited(rng, words, rng.choice([0.0, 0.01, 0.02, 0.04])))
            if rng.random() < 0.4:
                words = rows[-1].split()
    passage = " ".join(rng.choices(vocabulary, k=70))
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(60)]
    rows += ["a b c", "A  B\tc", "a b", "", "x " * 40, "x " * 90]
    return [(i * 3 % 1000, t, "en", "a", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_join_near_the_threshold(make, monkeypatch, small):
    rows = near_rows()
    if small:
        # Few entries in a task, blocks of few nodes, several copies of a center, no broadcast.
        for name, value in dict(BLOCK=4, POSTED=256, COUNTED=500, COMMON=6, PAIRS_PER_COPY=3, BROADCAST_ROWS=0).items():
            monkeypatch.setattr(ngram_join, name, value)
    assert found_links(make(rows)) == brute_links(rows)


def test_join_with_other_settings(make):
    rows = near_rows()
    assert found_links(make(rows), width=3, percent=60, fragments=3) == brute_links(rows, 3, 60)


# Conversation trie.


def test_sums_of_digests():
    rng = np.random.default_rng(1)
    p = prefix_trie.MODULUS
    a, b = (rng.integers(0, p, 500, dtype=np.uint64) for _ in range(2))
    a[:2] = p - 1
    b[:2] = (p - 1, 0)
    assert prefix_trie._times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    e = rng.integers(0, 1 << 33, 50)
    assert prefix_trie._power(a[0], e).tolist() == [pow(int(a[0]), int(k), p) for k in e]
    starts = np.repeat([0, 100, 101], [100, 1, 399])
    expected = [sum(map(int, a[s : i + 1])) % p for i, s in enumerate(starts)]
    assert prefix_trie._running(a, starts).tolist() == expected


def test_slots():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 50, size=(n, 3), dtype=np.uint64), axis=0)
        table = prefix_trie.SlotTable(keys)
        assert sorted(table.slots.tolist()) == list(range(len(keys)))
        assert table.find(keys).tolist() == table.slots.tolist()
        assert set(table.find(keys + np.uint64(50)).tolist()) <= {-1}
    with pytest.raises(ValueError, match="equal digests"):
        prefix_trie.SlotTable(np.ones((2, 3), dtype=np.uint64))


def ordered_turns(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            told[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in told.items()}


def rebuilt(told):
    new = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        new[c] = told.get(base, [])[:h] + turns[h:]
    return new


def brute_trie(told):
    members = defaultdict(set)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    found = []
    for p, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(told[c]) == len(p))))
        above = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        found.append((min(convs), len(p), above, len(convs), children[p], leaves[p], saved[p], sha))
    return sorted(found, key=lambda r: r[:2])


def hard_turns():
    rng = random.Random(5)
    rows = [(7, t, "user", f"long {t % 3}") for t in range(400)]
    rows += [(8, t, "user", f"long {t % 3}") for t in range(390)]
    for c in range(-12, 90):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi", "hello é", ""])))
    for c in range(200, 300):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same again")]
    rows += [(None, 0, "user", "lost"), (301, None, None, None), (301, 0, "user", "x"), (302, 1, "user", "a")]
    rows += [(302, 1, "user", "b"), (302, 1, "user", "b"), (303, 2, "user", "y" * 70_000)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]


def trie_rows(frame):
    frame = frame.withColumnsRenamed({"saved_bytes": "saved", "saved_tokens": "saved"})
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=lambda r: r[:2])


def small_trie(monkeypatch):
    """Upper nodes in several bands, several shards in a task, several texts of ids."""
    for name, value in dict(LEAST_LIMIT=20, PART_LIMIT=30, SHARD_NODES=8, BAND_NODES=50, BROADCAST_NODES=0, IDS_PER_TEXT=3).items():
        monkeypatch.setattr(prefix_trie, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, many_partitions, monkeypatch, small):
    rows = hard_turns()
    if small:
        small_trie(monkeypatch)
    frame = spark.createDataFrame(rows, TURNS).repartition(3).selectExpr("*", "1 AS depth", "2 AS shard", "3 AS p1")
    assert trie_rows(prefix_trie.conversation_trie(frame)) == brute_trie(ordered_turns(rows))


def test_trie_of_rebuilt_conversations(spark, many_partitions, monkeypatch, tmp_path):
    small_trie(monkeypatch)
    rows = hard_turns()
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = brute_trie(rebuilt(ordered_turns(rows)))
    assert trie_rows(QUERIES["op12_hashed_trie"](spark, str(tmp_path))) == expected


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).count() == 0


# Merkle manifest.


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + arity]) for i in range(0, len(last), arity)])
    return levels


def path_of(levels, i, arity):
    path = []
    for nodes in levels[:-1]:
        run = nodes[i - i % arity : i - i % arity + arity]
        path.append((run[: i % arity], run[i % arity + 1 :]))
        i //= arity
    return path


def brute_manifest(rows, arity):
    def leaf(row, text):
        return sha(*map(field, (row[0], row[3], row[2], row[4], text)))

    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append(levels_of([leaf(r, r[1]) for r in groups[name]], arity))
    top = levels_of([tree[-1][0] for tree in trees], arity)
    found = []
    for k, (name, tree) in enumerate(zip(names, trees)):
        for i, row in enumerate(groups[name]):
            path = path_of(tree, i, arity) + path_of(top, k, arity)
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for left, right in path:
                node = sha(*left, node, *right)
            proof = sha(*(d for left, right in path for d in (*left, *right)))
            found.append((row[0], tree[0][i], tree[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(found, key=repr)


PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def merkle_rows(rng):
    sizes = {None: 5, "a": 1, "b": 2, "c": 3, "d": 10, "é": 28, "hot": 120, "": 4}
    rows = [(i, f"line {i}\nmore", "en", s, i) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(3, None, None, "hot", None), (3, "", None, "hot", 0), (3, "", None, "hot", 0), (None, "x", "de", "hot", 1)]
    rng.shuffle(rows)
    return rows


def test_manifest(spark, make, many_partitions, tmp_path):
    rows = merkle_rows(random.Random(9))
    make(rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_sibling_merkle"](spark, str(tmp_path)).select(PROOF).collect()
    expected = brute_manifest(rows, 3)
    assert sorted((tuple(r) for r in found), key=repr) == expected
    assert {r[-1] for r in expected} == {True, False}


@pytest.mark.parametrize("arity", [2, 4])
def test_manifest_of_other_arity(make, many_partitions, arity):
    rows = merkle_rows(random.Random(8))
    leaf = merkle.leaf_digest(*(F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")))
    found = merkle.manifest(make(rows, extra=True), ["doc_id", "row"], leaf, "source", ["doc_id"], arity)
    folded = merkle.hex_text(merkle.fold(F.col("leaf"), F.col("path")))
    proof = F.sha2(merkle.proof_text(F.col("path")), 256)
    told = found.select("row.doc_id", *(merkle.hex_text(F.col(n)) for n in ("leaf", "subroot", "root")), proof, folded)
    unchanged = [r[:5] for r in brute_manifest(rows, arity)]
    assert sorted((tuple(r)[:5] for r in told.collect()), key=repr) == sorted(unchanged, key=repr)
    assert all(r[5] == r[3] for r in told.collect())


def test_manifest_of_few_rows(make, no_docs):
    leaf = merkle.leaf_digest(F.col("doc_id"), F.col("text"))
    assert merkle.manifest(no_docs, ["doc_id"], leaf, "source", ["doc_id"], 3).count() == 0
    (one,) = merkle.manifest(make([(1, None, "en", None, 1)]), ["doc_id"], leaf, "source", ["doc_id"], 3).collect()
    expected = hashlib.sha256(b"1:1-").digest()
    assert one["leaf"] == one["subroot"] == one["root"] == expected and one["path"] == []
    with pytest.raises(ValueError, match="at least two"):
        merkle.manifest(no_docs, ["doc_id"], leaf, "source", ["doc_id"], 1)


def test_ranges_bound_overlaps(monkeypatch):
    """Whatever the sizes of two sets, their ranges allow the overlap that they have."""
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 5, 900, 1100, 2100, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        sets += [base, np.unique(np.r_[base[: int(0.9 * n) + 1], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)])]
    sets.append(np.arange(300, dtype=np.uint64))

    def described(hashes):
        bits = 8
        while (1024 << bits) < len(hashes) * 256:
            bits += 1
        counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return (counts if counts.max() < 255 else np.full(1 << bits, 255)).astype(np.uint8).tobytes()

    ranges = [described(s) for s in sets]
    assert {len(r) for r in ranges} == {256, 512, 1024, 2048}
    i, j = (a.ravel() for a in np.indices((len(sets), len(sets))))
    most = ngram_join._most_common(ranges, ranges, i, j)
    for a, b, bound in zip(i, j, most):
        assert len(np.intersect1d(sets[a], sets[b])) <= bound
