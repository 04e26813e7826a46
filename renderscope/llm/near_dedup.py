"""Near-duplicates through a chosen-path similarity join.

Documents are word-shingle sets; equal sets are one vertex. In each of several
independent trees a vertex branches by minwise tokens: documents that agree on
a chosen place of their signatures go to the same node. Nodes of a few vertices
are compared exhaustively by signature, larger ones branch again by places not
used so far, and those that branching does not thin out (many near copies of
one text) are compared in pairs of blocks. What may be similar is then grouped
and confirmed on full shingle sets.

A pair at the threshold meets in one tree with 1 - (1 - s)^branches or better
and is missed by all with (1 - s)^(trees * branches): 3e-7 for s = 0.85. The
signature test leaves a margin of four and a half standard deviations.
Only spanning links leave a comparison, so their number is that of the vertices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renderscope.llm import shingles
from renderscope.llm.common import only_ids
from renderscope.llm.components import components
from renderscope.session import staged

#: Least similarity of a link, in percent.
PERCENT = 85
TREES = 4
#: Places chosen at a node.
BRANCHES = 2
#: Levels of a tree; each uses BRANCHES fresh places of its tree's share of the signature.
LEVELS = shingles.PLACES // (TREES * BRANCHES)
#: Vertices of a node that are compared at once.
SMALL = 64
#: Vertices, and shingles, of a block.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
COLUMNS = 1 << 13


# --- arrays --------------------------------------------------------------------


def spanning(similar: np.ndarray) -> list[tuple[int, int]]:
    """Links (first, other) that keep the components of a symmetric boolean matrix."""
    left = np.ones(len(similar), bool)
    out = []
    for i in range(len(similar)):
        if not left[i]:
            continue
        left[i] = False
        front = [i]
        while len(front):
            near = similar[front].any(axis=0) & left
            front = np.flatnonzero(near)
            left[front] = False
            out += [(i, int(j)) for j in front]
    return out


def agreeing(signature: np.ndarray, least: int) -> np.ndarray:
    """Pairs whose signatures agree in at least ``least`` places."""
    out = np.empty((len(signature), len(signature)), bool)
    for i in range(0, len(signature), 32):
        out[i : i + 32] = (signature[i : i + 32, None, :] == signature[None, :, :]).sum(axis=2) >= least
    return out


def overlapping(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs of sets with 100 * intersection >= percent * union, counted exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    common = np.zeros((n, n), np.float64)
    if n <= 3:
        for i in range(n):
            for j in range(i):
                common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        fresh = np.concatenate([[True], values[1:] != values[:-1]])
        place = np.cumsum(fresh) - 1
        held = np.bincount(place)
        shared = held[place] > 1
        renamed = np.cumsum(held > 1) - 1
        place, owner = renamed[place[shared]], owner[shared]
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            a, b = np.searchsorted(place, [first, first + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[a:b], place[a:b] - first] = 1
            common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return 100 * common >= percent * union


def _runs(names: list[pa.Array]) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    new = np.zeros(len(names[0]), bool)
    new[0] = True
    for column in names:
        values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _linked_groups(
    rows: DataFrame, keys: list[str], values: list[str], links: Callable[[pa.Table], list[tuple[int, int]]]
) -> DataFrame:
    """Links a, b of each group of ``rows``; groups are bounded and come in order, one at a time."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            table = table.combine_chunks()
            cuts = _runs([table.column(k).combine_chunks() for k in keys])
            for i, j in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield table.slice(i, j - i)
            rest = table.slice(cuts[-2])
        if rest is not None:
            yield rest

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list[bytes] = []
        second: list[bytes] = []
        for group in groups(batches):
            if group.num_rows > 1:
                found = links(group)
                v = group.column("v")
                first += [v[i].as_py() for i, _ in found]
                second += [v[j].as_py() for _, j in found]
            if len(first) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], schema=schema)
                first, second = [], []
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], schema=schema)

    dealt = rows.select(*keys, "v", *values).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(linked, "a binary, b binary")


def _block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of a group dealt into blocks, once for every pair of blocks that theirs is part of."""
    own = F.pmod(F.xxhash64("v"), F.col("_blocks"))
    return (
        rows.withColumn("_blocks", blocks.cast("long"))
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .withColumns({"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other")})
        .drop("_blocks", "_own", "_other")
    )


# --- the join ------------------------------------------------------------------


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, v (key of the set, null if empty), signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("v", pa.binary()), ("signature", pa.binary())])

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in shingles.text_runs(batch, 1):
                values, counts = shingles.shingle_sets(texts)
                rows = iter(shingles.signatures(values, counts))
                columns = [
                    batch.column(0).slice(start, len(texts)),
                    pa.array(counts, pa.int64()),
                    pa.array(shingles.set_keys(values, counts), pa.binary()),
                    pa.array([next(rows).tobytes() if n else None for n in counts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(profiled, "doc_id long, n_shingles long, v binary, signature binary")


def _place(tree: Column, level: int, branch: Column) -> Column:
    """Four bytes of the signature: a place that no other level of the tree uses."""
    at = (tree * LEVELS + level) * BRANCHES + branch
    return F.substring("signature", (at * 4 + 1).cast("int"), F.lit(4))


def _branched(rows: DataFrame, level: int) -> DataFrame:
    """Children of every row's node, without signatures: tree, node, v, parent_n."""
    node = F.xxhash64("node", "tree", "branch", F.lit(level), _place(F.col("tree"), level, F.col("branch")))
    return rows.withColumn("branch", F.explode(F.array(*map(F.lit, range(BRANCHES))))).select(
        "tree", node.alias("node"), "v", "parent_n"
    )


def candidate_links(vertices: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Spanning links a, b of vertices (v, signature) that may be similar.

    Rows travel by node without their signatures; only vertices that share a
    node with others fetch theirs again.
    """
    s = percent / 100
    margin = 4.5 * math.sqrt(s * (1 - s) / shingles.PLACES)
    least = max(1, math.floor((s - margin) * shingles.PLACES))

    def similar(group: pa.Table) -> list[tuple[int, int]]:
        data = b"".join(x.as_py() for x in group.column("signature"))
        return spanning(agreeing(np.frombuffer(data, np.uint32).reshape(group.num_rows, -1), least))

    rows = vertices.select(
        F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree"),
        F.lit(0).cast("long").alias("node"),
        "v",
        "signature",
        F.lit(None).cast("long").alias("parent_n"),
    )
    found = None
    for level in range(LEVELS):
        rows = _branched(rows, level)
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        rows = staged(rows.join(sizes, "node").join(vertices, "v"))
        small = rows.filter(F.col("n") <= SMALL)
        # Branching has not halved it: many near copies. Nor is there a further level after the last.
        thick = (F.col("n") * 2 >= F.coalesce(F.col("parent_n"), F.col("n") * 4)) | F.lit(level == LEVELS - 1)
        large = rows.filter(F.col("n") > SMALL)
        dense = _block_pairs(large.filter(thick), F.ceil(F.col("n") / BLOCK))
        links = _linked_groups(small, ["node"], ["signature"], similar)
        if level:
            links = links.union(_linked_groups(dense, ["node", "low", "high"], ["signature"], similar))
        found = staged(links) if found is None else found.union(staged(links))
        rows = large.filter(~thick).withColumn("parent_n", F.col("n")).drop("n")
        if rows.isEmpty():
            break
    return found


def confirmed_links(docs: DataFrame, members: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Spanning links a, b confirmed on full sets.

    ``members``: v, root, doc_id (a document with that set), n_shingles. Texts of
    those documents only are cut into shingles again.
    """
    names = pa.schema([("root", pa.binary()), ("v", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("shingles", pa.binary())])
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("long")
    # As many rows as documents with a candidate: the join is the same at every size.
    wanted = members.join(sizes, "root").select("doc_id", "v", "root", blocks.alias("blocks")).hint("merge")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in shingles.text_runs(batch, 0):
                values, counts = shingles.shingle_sets(part)
                keys = shingles.set_keys(values, counts)
                ends = np.cumsum(counts)
                rows = []
                for i, key in enumerate(keys):
                    if key != batch.column(1)[start + i].as_py():  # another row with that id
                        continue
                    rows.append((start + i, values[ends[i] - counts[i] : ends[i]].tobytes()))
                at = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).take(at),
                        batch.column(1).take(at),
                        batch.column(3).take(at),
                        pa.array([x for _, x in rows], pa.binary()),
                    ],
                    ["root", "v", "blocks", "shingles"],
                )

    rows = texts.select("text", "v", "root", "blocks").mapInArrow(sets, "root binary, v binary, blocks long, shingles binary")
    rows = _block_pairs(rows, F.col("blocks"))

    def similar(group: pa.Table) -> list[tuple[int, int]]:
        first: dict[bytes, int] = {}
        for i, v in enumerate(group.column("v")):
            first.setdefault(v.as_py(), i)  # rows that repeat an id bring a set twice
        at = list(first.values())
        values = [np.frombuffer(group.column("shingles")[i].as_buffer(), np.uint64) for i in at]
        return [(at[i], at[j]) for i, j in spanning(overlapping(values, percent))]

    return _linked_groups(rows, ["root", "low", "high"], ["shingles"], similar)


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id.

    Shingles are 5 words, A-Z lower-cased; a text of fewer words is one shingle.
    Documents are linked where 100 * intersection >= percent * union of their
    sets, and component_id is the smallest id that links lead to. Null and empty
    texts have no shingles and are linked with nothing. Rows that repeat an id
    are documents of their own. A null id is never the smallest beside others; a
    set that only rows without id have is linked with nothing. Empty input gives
    no rows; other columns are not looked at.
    """
    rows = staged(profiles(docs, id_col, text_col))
    classes = staged(
        rows.filter("v is not null")
        .groupBy("v")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    groups = components(candidate_links(classes.select("v", "signature"), percent))
    members = staged(groups.join(classes.drop("signature"), "v"))
    linked = components(confirmed_links(docs, members.filter("doc_id is not null"), percent, id_col, text_col))
    least = (
        linked.join(classes.select("v", "doc_id"), "v")
        .groupBy("root")
        .agg(F.min("doc_id").alias("component_id"))
        .join(linked, "root")
        .select("v", "component_id")
    )
    of_class = classes.join(least, "v", "left").select(
        "v", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return rows.select("doc_id", "n_shingles", "v").join(of_class, "v", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("v").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        F.hex("v").alias("class_id"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, of which one of each group stays."""
    kept = near_duplicates(docs, percent, id_col, text_col).filter("kept").withColumnRenamed("doc_id", id_col)
    return only_ids(docs, kept, id_col)
