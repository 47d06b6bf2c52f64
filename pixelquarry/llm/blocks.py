"""Similar pairs within groups, block against block inside tasks.

A group's members are dealt by a hash into ``blocks`` of a bounded number of rows and bytes. In the first round each block
is compared within itself and with the group's first block, its leaders, so what moves is in proportion to the members. In
a second round, for groups of several blocks only, the members outside a group's largest component are held against
all members of other components, block against block. No pair of a group is left out but those that
a path of links joins already. The pairs themselves never leave a task: of the similar ones only a spanning forest does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, least_roots
from .tables import Scratch

BLOCK_ROWS = 512
BLOCK_BYTES = 16 << 20
TASKS = "array<struct<task:bigint,role:int>>"

#: Of rows that lie by group, given each group's first row and the number of those of role 0, the similar pairs as row numbers.
Kernel = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def blocks_of(rows: Column, size: Column) -> Column:
    """How many blocks a group of so many rows and bytes is dealt into."""
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a stream sorted by ``key``, cut so that no group is in two tables; a group is the most that is held over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _forest(dealt: DataFrame, kernel: Kernel) -> DataFrame:
    """``a``-``b`` edges that join what the similar pairs within each ``task`` join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            table = table.combine_chunks()
            task, node, label, role = (table.column(c).to_numpy() for c in ("task", "node", "label", "role"))
            first = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
            own = np.add.reduceat((role == 0).astype(np.int64), first)
            root = np.arange(len(task))
            for a, b in kernel(table, first, own, label):
                root = least_roots(len(root), np.concatenate((a, np.arange(len(root)))), np.concatenate((b, root)))
            # A component's edges go out from its least leader, which other tasks name too, or from its least node.
            order = np.lexsort((node, role == 0, root))
            head = np.ones(len(order), dtype=bool)
            head[1:] = root[order][1:] != root[order][:-1]
            hub = np.empty(len(order), dtype=np.int64)
            hub[order] = order[head][np.cumsum(head) - 1]
            far = np.flatnonzero(node != node[hub])
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(node[hub[far]]), pa.array(node[far])], ["a", "b"])

    by_task = dealt.repartition("task").sortWithinPartitions("task", "role")
    return by_task.mapInArrow(run, "a long, b long")


def links_within(members: DataFrame, kernel: Kernel, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``label``: the components that similar pairs within groups make, of the nodes that have one.

    ``members`` has ``grp``, ``node``, ``blocks`` and the kernel's columns, and is read several times.
    """
    rest = [c for c in members.columns if c not in ("grp", "node", "blocks")]
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def dealt(rows: DataFrame, tasks: Column, label: str) -> DataFrame:
        return rows.select(F.inline(tasks), "node", F.col(label).alias("label"), *rest)

    def at(block: Column, role: Column, *more: Column) -> Column:
        return F.struct(F.xxhash64("grp", block, *more).alias("task"), role.alias("role"))

    leads = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: at(i, F.when(i == 0, 0).otherwise(1)))
    tasks = F.when(own == 0, leads).otherwise(F.array(at(own, F.lit(0))))
    links = scratch.stored(_forest(dealt(members, tasks, "node"), kernel), f"{name}-links")
    found = components(links)

    large = members.where("blocks > 1")
    if large.isEmpty():
        return found
    named = large.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = named.groupBy("grp", "label").agg(F.count("*").alias("n"))
    open_groups = parts.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
    open_groups = open_groups.select("grp", F.col("top.label").alias("top"), ((F.col("all") - F.col("top.n")) / F.col("all")).alias("share"))
    still = scratch.stored(named.join(open_groups, "grp"), f"{name}-open")
    if still.isEmpty():
        return found
    outer_blocks = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("blocks"))).cast("int")
    outer = F.pmod(F.xxhash64("node", F.lit(1)), outer_blocks).cast("int")
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: at(j, F.lit(0), outer))
    asking = F.transform(F.sequence(F.lit(0), outer_blocks - 1), lambda i: at(own, F.lit(1), i))
    tasks = F.concat(asking, F.when(F.col("label") != F.col("top"), asked).otherwise(F.array().cast(TASKS)))
    more = scratch.stored(_forest(dealt(still, tasks, "label"), kernel), f"{name}-links")
    return found if more.isEmpty() else components(links.union(more))

