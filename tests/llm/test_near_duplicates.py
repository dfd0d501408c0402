import random

import numpy as np
import pytest
import xxhash

from locusframe.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest reachable id over fingerprints at most three bits apart."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_keys_lose_no_pair_within_three_bits():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    keys, owners = simhash.keys_of(values)
    mine = set(zip(keys.tolist(), owners.tolist()))
    for bits in range(4):
        other = values.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        keys, owners = simhash.keys_of(other)
        assert {o for k, o in zip(keys.tolist(), owners.tolist()) if (k, o) in mine} == set(range(len(values)))


def test_golay_table_is_perfect():
    _, patterns, sizes = simhash.golay_tables()
    assert set(sizes) == {1, 6}
    assert sizes.sum() == 1 + 23 + 253 + 1771 + 8855


@pytest.mark.parametrize("block", [4096, 5])
def test_components_equal_brute_force(spark, block, documents):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijk") * 3 for _ in range(400)) for _ in range(4)]
    texts = [None, "", " \n", "A b", "a B", "one", *base]
    for _ in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    out = simhash.near_duplicates(documents(list(enumerate(texts))), block=block).collect()
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.id: r.fp % 2**64 for r in out} == prints
    assert {r.id: r.component_id for r in out} == brute_components(prints)


def test_dense_cells_are_stars(spark):
    rng = np.random.default_rng(1)
    flips = [0] + [1 << int(a) for a in range(32)] + [1 << a | 1 << b for a in range(32) for b in range(a)]
    values = np.array(flips, np.uint64) ^ rng.integers(0, 2**64, dtype=np.uint64)
    rows = [(int(v),) for v in values.view(np.int64)]
    unique = spark.createDataFrame(rows, "node long").selectExpr("node", "node AS v0")
    for block in (4096, 100):
        found = simhash.links(unique, 3, block).collect()
        assert len(found) < 60 * len(values)
        root = {r[0]: r[0] for r in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in found:
            root[find(a)] = find(b)
        assert len({find(i) for i in root}) == 1


def test_long_text_in_pieces():
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_repeated_null_and_empty_rows(documents):
    out = simhash.near_duplicates(documents([(7, "x y z w"), (7, "x y z w"), (None, "x y z w"), (9, None)])).collect()
    assert sorted((str(r.id), r.component_id) for r in out) == [("7", 7), ("7", 7), ("9", 9), ("None", 7)]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_keys_tell_random_fingerprints_apart():
    """With 31 bits or more, few of many unrelated fingerprints share a key."""
    values = np.random.default_rng(9).integers(0, 2**64, 60_000, dtype=np.uint64)
    keys, owners = simhash.keys_of(values)
    counts = np.bincount(owners, minlength=len(values))
    assert counts.min() >= 14 and counts.max() <= 44
    _, members = np.unique(keys, return_counts=True)
    # 1.8 billion pairs and 44 kinds of keys give some 40 meetings; 21 bits gave 10,000 times as many.
    assert members.max() <= 3 and (members > 1).sum() < 300


def test_ids_that_are_no_numbers(spark):
    rows = [("b", "x y z w"), ("a", "x y z w"), (None, "x y z w"), ("c", "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS v0", "2 AS node", "'x' AS id")
    out = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.id), r.component_id) for r in out) == [("None", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    assert sorted(r.doc_id for r in simhash.first_of_each(docs, simhash.near_duplicates(docs)).collect()) == ["a", "c"]


def test_first_of_each_keeps_one_row_per_class(documents):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, "q r s"), (5, "t u v")]
    docs = documents(rows)
    kept = simhash.first_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [
        ("1", "A b c d e f"), ("5", "t u v"), ("None", "q r s")
    ]
