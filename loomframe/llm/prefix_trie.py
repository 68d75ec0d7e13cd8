"""Prefix trie of conversations by truncation peeling.

A conversation is a path: one fixed-width unit per turn, made of a digest of (role, text) and the bytes of the text.
Equal paths are counted before anything moves. The distinct paths are range-sorted, so that every subtree is a run
of them, and runs are cut into blocks. Inside a block the trie is peeled from the deepest turn on: conversations
that end at a depth join the nodes that survived from below, every node is settled, the last turn is stripped, and
what then has the same path is one node. Nodes are found and summed up in this one descent.

Only the nodes on the first and on the last path of a block may go on in a neighbouring block. They stay open: a
block passes them on as two *spines*, paths that carry per depth what the block has added up there. Spines are
peeled again in the same way, thousands of them per block, until one block is left. So no node, however many
conversations it holds (the root holds all), is ever gathered in one task, and the number of rounds does not
depend on the depth.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomframe.plans.checkpoints import materialize

UNIT = 24  # bytes of a turn in a path: 16 of the digest, 8 of the length of its text
BLOCK = 8192  # paths peeled together
BLOCK_BYTES = 32 << 20  # of their paths; four at least, so that a round always leaves fewer of them
PIECE = 1 << 16  # characters of an id list that travel as one row

NO_END = hashlib.sha256(b"").hexdigest()
ADDS = "array<struct<n long, least long, children long, leaves long, saved long, ends string>>"
ITEM = f"path binary, top int, adds {ADDS}"
NODE = "conv long, depth int, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OUT = f"{NODE}, node_key binary, parent_key binary, {ITEM}"


def turn_unit(role: Column, text: Column) -> Column:
    """Hex form of a turn's unit; null role and text are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(digest, F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 16, "0"))


def conversation_paths(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path) of each conversation, its turns by ``order`` (null first; equal ones by role, then digest).

    Rows without a conversation id belong to no conversation and are left out. Only digests and lengths move.
    """
    unit = turn_unit(F.col(role), F.col(text))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), F.lit("")).alias("r"), unit.alias("u")).alias("t"))
    units = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return units.select("conv", F.unhex(F.array_join("ts.u", "")).alias("path"))


# -- peeling, in Python ------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Add:
    """What a node has got so far from conversations that end there and from children that are settled."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None

    def take(self, other: Add) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


@dataclass(slots=True)
class Node:
    add: Add = field(default_factory=Add)
    passing: list = field(default_factory=list)  # (top, adds) of the items that reach this depth or deeper
    settled: list = field(default_factory=list)  # rows of children that wait for this node's smallest member


def peel(items: list[tuple[bytes, int, list[Add]]], first_round: bool, final: bool) -> tuple[list[tuple], list[tuple[bytes, int, list[Add]]]]:
    """(node rows, spines) of a block of items ``(path, top, adds)`` in ascending order of their paths.

    ``adds[k]`` belongs to the node at depth ``top + k`` on the path. Unless ``final``, nodes on the first and
    the last path stay open. From the second round on every node has been open, so earlier rows may ask for it
    by its key.
    """
    first, last = items[0][0], items[-1][0]
    ending = defaultdict(list)
    for path, top, adds in items:
        ending[len(path) // UNIT].append((path, top, adds))
    rows, open_adds = [], {}
    below: dict[bytes, Node] = {}  # nodes of the depth, by path
    for depth in range(max(ending), -1, -1):
        for path, top, adds in ending.get(depth, ()):
            below.setdefault(path, Node()).passing.append((top, adds))
        above: dict[bytes, Node] = {}
        for path, node in below.items():
            add = node.add
            for top, adds in node.passing:
                if top <= depth:
                    add.take(adds[depth - top])
            still = [x for x in node.passing if x[0] < depth]
            is_open = not final and (first.startswith(path) or last.startswith(path))
            parent = above.setdefault(path[:-UNIT], Node()) if depth else None
            if parent is not None:
                parent.passing += still
            if is_open:
                open_adds[path] = add
                key = hashlib.md5(path).digest()
                rows.extend((*row[:2], None, *row[3:], key) for row in node.settled)
                continue
            leaves = add.leaves if add.children else 1
            saved = add.saved + (add.n - 1) * int.from_bytes(path[-8:], "big")
            key = None if first_round else hashlib.md5(path).digest()
            row = (add.least, depth, None, add.n, add.children, leaves, saved, add.ends or NO_END, key)
            rows.extend((*child[:2], add.least, *child[3:], None) for child in node.settled)
            if parent is None:
                rows.append((*row, None))
            else:
                parent.settled.append(row)
                parent.add.take(Add(add.n, add.least, 1, leaves, saved))
        below = above
    spines = []
    if not final:
        spines.append((first, 0, [open_adds[first[: d * UNIT]] for d in range(len(first) // UNIT + 1)]))
        shared = next((d for d in range(min(len(first), len(last)) // UNIT) if first[d * UNIT : (d + 1) * UNIT] != last[d * UNIT : (d + 1) * UNIT]), min(len(first), len(last)) // UNIT)
        if len(last) // UNIT > shared:
            spines.append((last, shared + 1, [open_adds[last[: d * UNIT]] for d in range(shared + 1, len(last) // UNIT + 1)]))
    return rows, spines


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK) -> Iterator[list[tuple[bytes, int, list[Add]]]]:
    """Items of a task, in order, in blocks of bounded size."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for x in batch.slice(at, 256).to_pylist():
                held.append((x["path"], x["top"], [Add(**a) for a in x["adds"]]))
                size += len(x["path"]) * (1 if len(x["adds"]) == 1 else 8)
                if len(held) >= most or size >= BLOCK_BYTES and len(held) >= 4:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _peel_task(first_round: bool, final: bool, most: int):
    names = [part.split()[0] for part in OUT.split(", ")[:10]]
    adds_type = pa.list_(pa.struct([("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())]))
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A last round has one block by its size; should its single task see more, they are one block all the same.
        source = [[x for block in blocks(batches) for x in block]] if final else blocks(batches, most)
        for block in source:
            if not block:
                continue
            rows, spines = peel(block, first_round, final)
            for at in range(0, len(rows), BLOCK):
                part = list(zip(*rows[at : at + BLOCK]))
                n = len(part[0])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(part, kinds)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, adds_type)], [*names, "path", "top", "adds"])
            for path, top, adds in spines:
                coded = [{name: getattr(a, name) for name in Add.__slots__} for a in adds]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, k) for k in kinds), pa.array([path], pa.binary()), pa.array([top], pa.int32()), pa.array([coded], adds_type)], [*names, "path", "top", "adds"])

    return run


# -- digests of member lists -------------------------------------------------------------------------------------


def _pieces_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) rows as (key, first conv, comma-joined ids), a piece at a time."""
    key, held, size = None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out])], ["key", "first", "ids"])

    out = []
    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or size >= PIECE):
                out.append((key, held[0], ",".join(map(str, held))))
                held, size = [], 0
                if len(out) >= 1024:
                    yield piece()
                    out = []
            key = k
            held.append(conv)
            size += 8
    if held:
        out.append((key, held[0], ",".join(map(str, held))))
    if out:
        yield piece()


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one SHA-256 per key, fed piece by piece."""
    key, sha, out = None, None, []

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["key", "ends"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if sha is not None and k == key:
                sha.update(b",")
            else:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 1024:
            yield ready()
            out = []
    if sha is not None:
        out.append((key, sha.hexdigest()))
    if out:
        yield ready()


def member_digests(members: DataFrame) -> DataFrame:
    """(key, ends) from (key, conv): SHA-256 of the ascending decimal ids, comma-joined.

    Ids are range-sorted and joined into pieces, wherever the ranges cut a list; only pieces meet by key. The
    hash of one list is sequential by nature, so its pieces stream through one task, which holds one of them.
    """
    rows = members.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    pieces = rows.mapInArrow(_pieces_task, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digest_task, "key binary, ends string")


# -- the operator ------------------------------------------------------------------------------------------------


def prefix_trie(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie over (conv, path), as ``conversation_paths`` gives them.

    (conv, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): ``conv`` is the smallest
    member, ``parent`` that of the parent node (null at the root), ``saved_tokens`` the sum over the subtree of
    ``(n_convs - 1)`` times the bytes of each node's last text. Conversations without turns are members of the
    root. Repeated conversations share all their nodes; a conversation id given twice counts twice. An empty
    table has no nodes. One conversation's path must fit a row; the number of conversations of a node is not
    bounded. ``block`` paths (at least 4) are peeled together.
    """
    members = materialize(paths.select(F.unhex(F.md5("path")).alias("key"), "path", F.col("conv").cast("long").alias("conv")))
    counted = members.groupBy("key").agg(F.first("path").alias("path"), F.min("conv").alias("least"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    add = F.struct(F.col("n"), F.col("least"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.col("ends"))
    level = counted.join(member_digests(members), "key").select("path", (F.octet_length("path") / UNIT).cast("int").alias("top"), F.array(add).alias("adds"))
    level, rounds = materialize(level), []
    while True:
        count, size = level.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path") * F.when(F.size("adds") == 1, 1).otherwise(8)), F.lit(0))).first()
        if count == 0:
            break
        final = count <= 4 or count <= block and size <= BLOCK_BYTES
        parts = 1 if final else max(-(-count // block), -(-size // BLOCK_BYTES))
        placed = level.coalesce(1) if final else level.repartitionByRange(parts, "path")
        out = materialize(placed.sortWithinPartitions("path").mapInArrow(_peel_task(not rounds, final, block), OUT))
        rounds.append(out.filter("path IS NULL").drop("path", "top", "adds"))
        if final:
            break
        level = out.filter("path IS NOT NULL").select("path", "top", "adds")
    columns = [part.split()[0] for part in NODE.split(", ")]
    if not rounds:
        return paths.sparkSession.createDataFrame([], NODE)
    nodes = reduce(DataFrame.unionByName, rounds)
    settled = nodes.filter("parent_key IS NULL").select(*columns)
    # Children of a node that was open in their round ask for its smallest member. Few nodes are ever open.
    opened = nodes.filter("node_key IS NOT NULL").select(F.col("node_key").alias("parent_key"), F.col("conv").alias("parent"))
    waiting = nodes.filter("parent_key IS NOT NULL").drop("parent").join(opened, "parent_key")
    return settled.unionByName(waiting.select(*columns))
