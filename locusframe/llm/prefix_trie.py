"""The trie of common beginnings of conversations, from neighbours in sorted order.

A conversation is the path of its turns, each turn a digest of role and text. Paths are sorted
over the cluster, and two neighbours share as many turns as their longest common prefix says.
Inside a block of sorted paths these prefixes are the edges of a union-find structure, which
takes them from the deepest up: a component is a run of neighbours, every merge makes (or widens)
a branching node, and a component that is lifted to a lower depth passes the nodes of one child on
its way.

A node that holds neither the first nor the last path of its block is complete. The others
are the contracted forest of the block, a node for each turn of two paths. They are merged
across boundaries by the digest of their path: members, children, leaves and savings add up, and
each boundary takes back what the nodes on both of its sides counted twice.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import stored
from locusframe.storage import broadcast_small

DIGEST = 16
# Paths that are merged at once, and bytes of paths in a partition.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 8 << 20
PART_BYTES, LEAST_PART_BYTES = 64 << 20, 1 << 20


# --- paths ----------------------------------------------------------------------------


def conversation_turns(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """`(id, turns)`: the turns of every conversation in order, `(digest, bytes)` each.

    Turns are ordered by number, NULL first; equal numbers by role, then by the digest of the
    text. A NULL role or text is empty. Rows without an id belong to no conversation and are left
    out. Texts are read and digested where they lie; 40 bytes of a turn are shuffled, and the
    turns of one conversation become one row of them.
    """
    role = F.coalesce(F.col(role_column).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.struct(
            F.col(turn_column).alias("turn"),
            role.alias("role"),
            F.md5(whole.cast("binary")).alias("digest"),
            F.octet_length(text).cast("bigint").alias("bytes"),
        ).alias("turn"),
    )
    turns = F.transform(
        F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))
    )
    return rows.groupBy("id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame, families: int = 5, most: int = 8) -> DataFrame:
    """Every conversation with the beginning of the first one of its family.

    The first `h` turns come from conversation `id - id % families`, where `h` is the CRC-32 of
    the decimal id modulo `most + 1`; the conversation's own turns follow after its first `h`.
    """
    turns = stored(turns, "turns")
    heads = turns.where(F.col("id") % families == 0).select(
        F.col("id").alias("family"), F.slice("turns", 1, most).alias("head")
    )
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % (most + 1)).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    own = F.slice("turns", h + 1, F.size("turns"))
    joined = turns.withColumn("family", F.col("id") - F.col("id") % families).join(heads, "family", "left")
    return joined.select("id", F.concat(head, own).alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """`(id, path, sizes)`: 16 bytes of digest per turn, whose order is that of the sequences."""
    return turns.select(
        "id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["bytes"]).alias("sizes"),
    )


# --- forests --------------------------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share at their beginning."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def node_keys(path: bytes, depth: int | None = None) -> list[bytes]:
    """A key for each beginning of a path, from the root to `depth` turns."""
    keys = [hashlib.md5(b"").digest()]
    for at in range(0, len(path) if depth is None else depth * DIGEST, DIGEST):
        keys.append(hashlib.md5(keys[-1] + path[at : at + DIGEST]).digest())
    return keys


NODE = (
    "kind string, key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, part bigint, block bigint, "
    "first binary, sizes array<bigint>, last binary"
)
_NAMES = [field.split()[0] for field in NODE.split(", ")]
_KINDS = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
_TYPES = [_KINDS[field.split()[1]] for field in NODE.split(", ")]


def _rows(**columns) -> Iterator[pa.RecordBatch]:
    """Batches of the columns given; the others are NULL."""
    n = len(next(iter(columns.values())))
    arrays = [
        pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind)
        for name, kind in zip(_NAMES, _TYPES)
    ]
    yield from pa.table(arrays, names=_NAMES).to_batches(max_chunksize=10_000)


def block_nodes(ids: list[int], paths: list[bytes], sizes: list[list[int]]) -> dict[str, list]:
    """All nodes of a block of sorted paths, as columns.

    Complete nodes have the digest of their ends, open ones the ends themselves and their key. A
    node whose parent is complete has `parent_conv_id`, any other the key of its parent.
    """
    n = len(ids)
    depths = [len(p) // DIGEST for p in paths]
    shared = np.array([common_turns(a, b) for a, b in zip(paths, paths[1:])], np.int64)
    first_keys, last_keys = node_keys(paths[0]), node_keys(paths[-1])
    names = ["kind", "key", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out: dict[str, list] = {name: [] for name in names}

    # Of the component that a root row stands for: the depth of its node, its rows, and the
    # figures of this node. `kids` are the numbers of its finished children.
    above = list(range(n))
    top, begin, stop = list(depths), list(range(n)), list(range(n))
    lowest, ended = list(ids), [1] * n
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]

    def find(row: int) -> int:
        while above[row] != row:
            above[row] = above[above[row]]
            row = above[row]
        return row

    def finish(c: int) -> None:
        """Report the node of a component, which becomes the one child of the node below it."""
        depth, low, high = top[c], begin[c], stop[c]
        keys = first_keys if low == 0 else last_keys if high == n - 1 else None
        members = high - low + 1
        total = saved[c] + ((members - 1) * sizes[low][depth - 1] if depth else 0)
        texts = ",".join(map(str, ids[low : low + ended[c]]))
        for node in kids[c]:
            if keys:
                out["parent"][node] = keys[depth]
            else:
                out["parent_conv_id"][node] = lowest[c]
        kids[c] = [len(out["kind"])]
        out["kind"].append("open" if keys else "node")
        out["key"].append(keys[depth] if keys else None)
        out["parent"].append(None)
        out["depth"].append(depth)
        out["conv_id"].append(lowest[c])
        out["parent_conv_id"].append(None)
        out["n_convs"].append(members)
        out["n_children"].append(children[c])
        leaves[c] = leaves[c] if children[c] else 1
        out["n_leaves"].append(leaves[c])
        out["saved_tokens"].append(total)
        out["ends"].append(texts if keys else hashlib.sha256(texts.encode()).hexdigest())
        top[c], children[c], saved[c], ended[c] = depth - 1, 1, total, 0

    for edge in np.argsort(-shared, kind="stable").tolist():
        depth, a, b = int(shared[edge]), find(edge), find(edge + 1)
        for c in (a, b):
            while top[c] > depth:
                finish(c)
        # The rows that end at a node come first among its rows.
        above[b] = a
        stop[a] = stop[b]
        lowest[a] = min(lowest[a], lowest[b])
        ended[a] += ended[b]
        children[a] += children[b]
        leaves[a] += leaves[b]
        saved[a] += saved[b]
        if len(kids[a]) < len(kids[b]):
            kids[a], kids[b] = kids[b], kids[a]
        kids[a] += kids[b]
        kids[b] = []
    root = find(0)
    while top[root] >= 0:
        finish(root)
    return out


def _boundary(last: bytes, first: bytes, sizes: list[int]) -> dict[str, list]:
    """What the nodes on both sides of a boundary counted twice, as columns of open nodes."""
    common = common_turns(last, first)
    tail = np.cumsum([0, *sizes[:common]]).tolist()
    # The path that ends the left side is no leaf if the right side goes on with it.
    leaf = -1 if common * DIGEST == len(last) else 0
    depths = list(range(common + 1))
    return {
        "kind": ["open"] * (common + 1),
        "key": node_keys(first, common),
        "depth": depths,
        "n_convs": [0] * (common + 1),
        "n_children": [-1 if d < common else 0 for d in depths],
        "n_leaves": [leaf] * (common + 1),
        "saved_tokens": [tail[common] - tail[max(d - 1, 0)] for d in depths],
    }


def _forests(block_rows: int, block_bytes: int):
    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        first = before = None
        ids, paths, sizes, held = [], [], [], 0

        def flush():
            nonlocal block, first, before, ids, paths, sizes, held
            if before is None:
                first = paths[0], sizes[0]
            else:
                yield from _rows(**_boundary(before, paths[0], sizes[0]))
            nodes = block_nodes(ids, paths, sizes)
            n = len(nodes["kind"])
            yield from _rows(**nodes, part=[part] * n, block=[block] * n)
            before, block = paths[-1], block + 1
            ids, paths, sizes, held = [], [], [], 0

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                ids.append(row[0])
                paths.append(row[1])
                sizes.append(row[2])
                held += len(row[1]) + 100
                if len(ids) >= block_rows or held >= block_bytes:
                    yield from flush()
        if ids:
            yield from flush()
        if first is not None:
            yield from _rows(kind=["edge"], part=[part], first=[first[0]], sizes=[first[1]], last=[before])

    return run


def _boundaries(batches):
    for batch in batches:
        for last, first, sizes in zip(*(column.to_pylist() for column in batch.columns)):
            yield from _rows(**_boundary(last, first, sizes))


def _digests(batches):
    """The digest of the ends of every key, whose parts follow each other."""
    key = state = None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"]
        )

    for batch in batches:
        for now, text in zip(batch.column(0), batch.column(1)):
            now, data = now.as_py(), text.as_py().encode()
            if now != key:
                if state:
                    yield row()
                key, state = now, hashlib.sha256(data)
            else:
                state.update(b"," + data)
    if state:
        yield row()


# --- the operator ---------------------------------------------------------------------

FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def prefix_trie(
    path_table: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per node of the trie of `(id, path, sizes)`, as `paths` makes them.

    `conv_id` is the smallest member, `depth` the turns of the node, `parent_conv_id` its
    parent's smallest member (NULL at the root), `n_convs` its members, `n_children` its children,
    `n_leaves` the childless nodes of its subtree, itself included, `saved_tokens` the bytes of
    last texts that its subtree shares, and `ends_sha256` the SHA-256 of the ids that end
    there, ascending and with commas between. Rows of equal path and id are members of their own.
    No path at all gives no node, not even a root.

    `path_table` is stored; blocks of paths have a bounded size, however many copies of a
    path there are. The ids that end at one node are digested one after the other, as their digest
    asks for, from one row per block.
    """
    table = stored(path_table, "paths")
    size = table.agg(F.coalesce(F.sum(F.length("path") + 8 * F.size("sizes") + 16), F.lit(0))).first()[0]
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // part_bytes), min(cores, size // LEAST_PART_BYTES))
    ordered = table.repartitionByRange(int(parts), "path", "id").sortWithinPartitions("path", "id")
    forests = stored(ordered.select("id", "path", "sizes").mapInArrow(_forests(block_rows, block_bytes), NODE), "forests")

    # A row per partition, so this window is short.
    edges = forests.where("kind = 'edge'")
    before = edges.withColumn("before", F.lag("last").over(Window.orderBy("part"))).where("before is not null")
    joints = before.select("before", "first", "sizes").mapInArrow(_boundaries, NODE)

    parts_of_open = forests.where("kind = 'open'")
    merged = (
        parts_of_open.union(joints)
        .groupBy("key")
        .agg(
            F.max("parent").alias("parent"),
            F.max("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(name).alias(name) for name in FIGURES),
        )
    )
    ended = parts_of_open.where("ends <> ''").select("key", "ends", "part", "block")
    ended = ended.repartition("key").sortWithinPartitions("key", "part", "block").select("key", "ends")
    digests = ended.mapInArrow(_digests, "key binary, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    merged = stored(
        merged.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "open-nodes"
    )

    names = ["conv_id", "depth", "parent_conv_id", *FIGURES, "ends_sha256"]
    whole = forests.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    inner = whole.where("parent is null").select(*names)
    outer = whole.where("parent is not null").drop("parent_conv_id")
    rest = outer.select("parent", *(n for n in names if n != "parent_conv_id")).unionByName(
        merged.select("parent", *(n for n in names if n != "parent_conv_id"))
    )
    parents = broadcast_small(merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    return inner.union(rest.join(parents, "parent", "left").select(*names))
