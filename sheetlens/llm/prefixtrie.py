"""A trie of conversation prefixes, merged family by family.

Conversations of one base id are rebuilt on a shared head and form a family. A family is small:
its conversations are cogrouped with the base's, and one pass makes its trie. Only a family's
combined nodes are shuffled then, to find each node's members over all families; each family
adds up its own subtrees over the nodes that it owns, and one more merge by node adds the
families' sums. A node is owned by the family of its smallest member, so each counts once.

Tries are made of digests of turns and counts of words, not of texts. A node is known by the
SHA-256 of its parent's and its last turn's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_classes
from .text import saved

WORD = "[^\\x20\\x09-\\x0D]+"
ROOT = hashlib.sha256(b"root").digest()
NODES = "base long, node binary, parent binary, depth long, words long, n long, first long, n_ends long, ends array<long>"
SUMS = "node binary, parent_first long, children long, leaves long, saved long"


def turns_of(conversations: DataFrame, family: int, heads: int) -> DataFrame:
    """(base, conv_id, at, head, role, said, words, text): ``said`` is a turn's digest, ``head`` how many turns the base lends."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % family).cast("long").alias("base"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("head"), role.alias("role"),
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), text.alias("text"))


def _in_order(turns: DataFrame) -> DataFrame:
    """Each family's turns in order, in one partition; role and text, which break ties, go no further."""
    return turns.repartition("base").sortWithinPartitions("base", "conv_id", "at", "role", "text").select("base", "conv_id", "head", "said", "words")


def _conversations(table: pa.Table) -> dict[int, tuple[int, list[tuple[bytes, int]]]]:
    """conv_id to its head and its turns, in the order they come."""
    found: dict[int, tuple[int, list[tuple[bytes, int]]]] = {}
    for c, h, s, w in zip(*(table.column(k).to_pylist() for k in ("conv_id", "head", "said", "words"))):
        found.setdefault(c, (h, []))[1].append((s, w))
    return found


def family_trie(base: int, conversations: dict[int, tuple[int, list[tuple[bytes, int]]]]) -> list[tuple]:
    """The nodes of one family as rows of NODES, in order of depth."""
    lent = conversations.get(base, (0, []))[1]
    nodes: dict[bytes, list] = {}
    for c in sorted(conversations):
        head, own = conversations[c]
        path, parent, depth = [(b"", 0), *lent[:head], *own[head:]], None, 0
        for said, words in path:
            node = hashlib.sha256(parent + said).digest() if parent else ROOT
            row = nodes.setdefault(node, [base, node, parent, depth, words, 0, c, 0, []])
            row[5] += 1
            parent, depth = node, depth + 1
        row[7] += 1
        row[8].append(c)
    return sorted(map(tuple, nodes.values()), key=lambda r: r[3])


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


_NODES = pa.schema([("base", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), *((k, pa.int64()) for k in ("depth", "words", "n", "first", "n_ends")), ("ends", pa.list_(pa.int64()))])
_SUMS = pa.schema([("node", pa.binary()), *((k, pa.int64()) for k in ("parent_first", "children", "leaves", "saved"))])


def _build(members: pa.Table, heads: pa.Table) -> pa.Table:
    """Members and base of one family to its trie; either side may be empty."""
    base = (members if members.num_rows else heads).column("base")[0].as_py()
    return _columns(family_trie(base, {**_conversations(members), **_conversations(heads)}), _NODES)


def _add_up(nodes: pa.Table) -> pa.Table:
    """What one family adds to each of its nodes: children, leaves and saved words of the nodes it owns."""
    rows = sorted(nodes.select(["node", "parent", "depth", "words", "first", "all_n", "all_first", "all_ends"]).to_pylist(), key=lambda r: -r["depth"])
    by_node = {r["node"]: r for r in rows}
    sums = {r["node"]: [0, 0, 0] for r in rows}
    for r in rows:
        s = sums[r["node"]]
        owned = r["first"] == r["all_first"]
        if owned:
            s[1] += r["all_ends"] == r["all_n"]
            s[2] += (r["all_n"] - 1) * r["words"]
        if r["parent"] is not None:
            up = sums[r["parent"]]
            up[0] += owned
            up[1] += s[1]
            up[2] += s[2]
    return _columns([(r["node"], by_node[r["parent"]]["all_first"] if r["parent"] else None, *sums[r["node"]]) for r in rows], _SUMS)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends in the order of (node, block) to a hash for each node; a task holds one block and the state of one hash."""
    node, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]}, schema=pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n == node:
                state.update(b",")
            else:
                if node is not None:
                    yield row()
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
    if node is not None:
        yield row()


def _ends(nodes: DataFrame, block: int) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end; ids are gathered in blocks of families, in order."""
    # Families hold disjoint ranges of ids in the order of their bases, and so do blocks of families.
    return (
        nodes.filter("n_ends > 0").select("node", F.floor(F.col("base") / block).alias("_block"), F.struct("base", "ends").alias("_e"))
        .groupBy("node", "_block").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["ends"])).cast("array<string>"), ",").alias("ids"))
        .repartition("node").sortWithinPartitions("node", "_block").select("node", "ids").mapInArrow(_hash_ends, "node binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4, block: int = 100) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations; see the columns below.

    Conversation c takes the first h turns of its base, the conversation c - c % ``family`` (all
    if that has fewer, none if it doesn't exist), and then its own after its first h, where h is
    crc32 of its decimal id modulo ``heads``. Turns stand in the order of turn (null first),
    then role, then text; null roles and texts are empty, and rows repeated whole are turns of
    their own. Rows without a conv_id belong to no conversation and are left out; an empty
    table has no root. Columns other than conv_id, turn, role and text aren't read.

    A task holds the digests of one family, about 50 bytes a turn, and of the ids that end at a
    node those of ``block`` families; a node that very many conversations share is a row for
    each family before the merge and is combined in each task.
    """
    turns = turns_of(conversations, family, heads)
    bases, members = (_in_order(turns.filter(t)).groupBy("base") for t in ("conv_id = base", "conv_id <> base"))
    tries = saved(members.cogroup(bases).applyInArrow(_build, NODES))
    merged = saved(tries.groupBy("node").agg(
        F.sum("n").alias("all_n"), F.min("first").alias("all_first"), F.sum("n_ends").alias("all_ends"), F.min("depth").alias("all_depth"), F.count("*").alias("families")))
    known = join_classes(tries.drop("ends"), merged, ["node"], "families", ["base"])
    sums = known.groupBy("base").applyInArrow(_add_up, SUMS).groupBy("node").agg(
        F.max("parent_first").alias("parent_conv_id"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return (
        merged.join(sums, "node").join(_ends(tries, family * block), "node", "left")
        .select(F.col("all_first").alias("conv_id"), F.col("all_depth").alias("depth"), "parent_conv_id", F.col("all_n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "node"))
