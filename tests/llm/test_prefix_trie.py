import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """All nodes of `{id: [(role, text), ...]}` or of `[(id, [(role, text), ...])]`, as rows."""
    pairs = conversations.items() if isinstance(conversations, dict) else conversations
    members, ends = defaultdict(list), defaultdict(list)
    for key, turns in pairs:
        turns = tuple(turns)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(key)
        ends[turns].append(key)
    rows = []
    for node, ids in members.items():
        under = [u for u in members if u[: len(node)] == node]
        rows.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
            sum(len(u) == len(node) + 1 for u in under),
            sum(not any(v[: len(u)] == u and len(v) > len(u) for v in under) for u in under),
            sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in under if u),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def rebuilt_by_hand(rows):
    own = defaultdict(list)
    for key, turn, role, text in rows:
        if key is not None:
            own[key].append((turn is not None, turn or 0, role or "", text or ""))
    own = {k: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for k, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def test_rebuilt_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", None, ""]))
            for c in range(60) if c % 7 for t in rng.sample(range(20), rng.randrange(1, 14))]
    rows += [(3, None, "user", "first"), (None, 1, "user", "no conversation")]
    rng.shuffle(rows)
    made = P.rebuilt(P.conversation_turns(table(spark, rows).repartition(3)))
    expected = rebuilt_by_hand(rows)
    digest = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    got = {r.id: [(x.digest, x.bytes) for x in r.turns] for r in made.collect()}
    assert got == {c: [(digest(r, t), len(t.encode())) for r, t in turns] for c, turns in expected.items()}
    assert any(not turns for turns in expected.values())
    assert rows_of(P.prefix_trie(P.paths(made), block_rows=7)) == brute(expected)


def path_rows(conversations):
    rows = []
    for key, turns in conversations:
        path = b"".join(hashlib.md5(f"{r}:{t}".encode()).digest() for r, t in turns)
        rows.append((key, path, [len(t.encode()) for _, t in turns]))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def merged_by_hand(rows, cuts):
    """The nodes of blocks that end at `cuts`, merged as the operator merges them."""
    done, merged, texts, parents = [], {}, defaultdict(list), {}
    edges = [0, *cuts, len(rows)]
    blocks = [rows[a:b] for a, b in zip(edges, edges[1:]) if a < b]
    for before, block in zip([None, *blocks], blocks):
        if before:
            joint = P._boundary(before[-1][1], block[0][1], block[0][2])
            for i, key in enumerate(joint["key"]):
                figures = [joint[name][i] for name in P.FIGURES]
                merged.setdefault(key, [joint["depth"][i], None, [0] * 4])
                merged[key][2] = [a + b for a, b in zip(merged[key][2], figures)]
        nodes = P.block_nodes(*map(list, zip(*block)))
        for i, kind in enumerate(nodes["kind"]):
            row = {name: nodes[name][i] for name in nodes}
            if kind == "node":
                done.append(row)
                continue
            entry = merged.setdefault(row["key"], [row["depth"], None, [0] * 4])
            entry[1] = row["conv_id"] if entry[1] is None else min(entry[1], row["conv_id"])
            entry[2] = [a + row[name] for a, name in zip(entry[2], P.FIGURES)]
            parents[row["key"]] = row["parent"]
            if row["ends"]:
                texts[row["key"]].append(row["ends"])
    out = []
    for key, (depth, low, figures) in merged.items():
        up = parents[key]
        ends = hashlib.sha256(",".join(texts[key]).encode()).hexdigest()
        out.append((low, depth, merged[up][1] if up else None, *figures, ends))
    for row in done:
        up = merged[row["parent"]][1] if row["parent"] else row["parent_conv_id"]
        out.append((row["conv_id"], row["depth"], up, *(row[f] for f in P.FIGURES), row["ends"]))
    return sorted(out, key=str)


turn = st.tuples(st.sampled_from("ua"), st.sampled_from(["", "x", "yé"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.lists(turn, max_size=5)), min_size=1, max_size=14), st.data())
def test_blocks_of_any_cut_give_the_whole_trie(conversations, data):
    rows = path_rows(conversations)
    cuts = sorted(data.draw(st.sets(st.integers(1, len(rows)), max_size=5)))
    assert merged_by_hand(rows, cuts) == brute(conversations)


def test_common_turns():
    a, b = bytes(range(16)), bytes(range(16, 32))
    assert P.common_turns(a + b, a + b) == 2 and P.common_turns(a + b, a + a) == 1
    assert P.common_turns(b"", a) == 0 and P.common_turns(b, a + b) == 0
    assert P.common_turns(a * 1000, a * 700 + b) == 700


@pytest.mark.parametrize("block_rows", [1, 3, 50])
def test_trie_over_partitions(spark, monkeypatch, block_rows):
    monkeypatch.setattr(P, "LEAST_PART_BYTES", 400)
    rng = random.Random(block_rows)
    texts = ["", "a", "long text", "ü"]
    conversations = [(i, [(rng.choice("ua"), rng.choice(texts)) for _ in range(rng.randrange(7))]) for i in range(150)]
    # A third of all are copies, and ids repeat.
    conversations += [(1000 + i, [("u", "copy"), ("a", "of")]) for i in range(75)]
    conversations += [(5, [("u", "a")]), (5, [("u", "a")])]
    rows = path_rows(conversations)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, path binary, sizes array<long>")
    assert rows_of(P.prefix_trie(df, block_rows=block_rows)) == brute(conversations)
    assert rows_of(P.prefix_trie(df, block_bytes=600, part_bytes=2000)) == brute(conversations)


def test_long_conversations_and_texts(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(3000)] + [(10, t, "user", f"turn {t}") for t in range(3000)]
    rows += [(15, 0, "user", "x" * 1_000_000), (20, 0, "user", "x" * 1_000_000)]
    df = table(spark, rows)
    got = P.prefix_trie(P.paths(P.conversation_turns(df))).collect()
    assert len(got) == 3002
    root = next(r for r in got if r.depth == 0)
    assert (root.n_convs, root.n_children, root.n_leaves) == (4, 2, 2)
    assert root.saved_tokens == 1_000_000 + sum(len(f"turn {t}") for t in range(3000))


def test_empty_and_clashing_columns(spark):
    df = table(spark, [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 1, None, None)])
    more = df.selectExpr("*", "1 AS id", "'k' AS key", "'p' AS path", "2 AS part", "'s' AS ends")
    got = rows_of(P.prefix_trie(P.paths(P.conversation_turns(more))))
    assert got == brute({1: [("user", "x"), ("user", "x")], 2: [("", "")]})
    empty = P.rebuilt(P.conversation_turns(df.limit(0)))
    assert P.prefix_trie(P.paths(empty)).collect() == []
