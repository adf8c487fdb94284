"""Similarity classes of documents by the Jaccard similarity of their word shingles: a token-group matrix.

Exact: two sets link if ``100 * intersection >= percent * union``; a class is what links reach.

1. *Sets.* Documents of equal shingle sets become one set (groups of copies shrink inside the tasks).
2. *Prefix test.* With ``t = ceil(percent * n / 100)``, a set that links shares at least ``t`` of its n
   shingles. So of its n - t + l smallest hashes, l or more stand also among the smallest hashes of its partner.
   A set with too few prefix shingles that occur in any other set cannot link. Only sets that pass go on.
3. *Groups.* The same test on all shingles leaves the sets of which ``t`` shingles occur elsewhere. Those of like
   size whose smallest such shingle is equal form a group of at most ``group_size`` (larger ones are dealt by
   hash). Within a group all links are found by one matrix product.
4. *Matrix.* The token union of each group gives rows (token, group). A set looks for groups with smaller
   number. It needs ``t`` of its shingles in the group's union, so it has to probe only its ``n - t + 1``
   rarest shingles, and those that no smaller group has are spent without a probe. The members' probes are
   put together, so a token meets groups, not sets.
5. *Bound and open.* For groups that a probe joins, each set's overlap with the other group's union bounds its
   intersection with any member; only where it reaches ``t`` the group is opened and compared member by member.
6. *Classes.* Links, at most one for each set and connected part of a group, are joined to components.

No pair of copies is formed, and no pair inside a group leaves its task. A hot token costs rows only for
sets that have it among their rarest shingles.

Defined cases: null and empty texts and texts of white space have the empty set, which links with nothing; a
text of fewer words than a shingle has one shingle, its whole sequence; repeated rows are copies; a row
with a null id gets the class of its set where another row has that set, and null otherwise; an empty
table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.components import components
from oddsloom.llm.shingles import shingle_sets, slices
from oddsloom.session import materialize

GROUP_SIZE = 96
#: Survivors below this number are sent to all tasks (about 32 MB); above it, texts are shuffled to them.
BROADCAST_ROWS = 1_000_000
SHARE = 10  # the prefix is longer than needed by n / SHARE
MEMBER = "struct<node:bigint,root:bigint,n:int,tokens:binary>"


def _least_overlap(n, percent: int):
    return -(-percent * n // 100)


def _prefix(n: int, percent: int) -> int:
    return min(n, n - _least_overlap(n, percent) + max(1, n // SHARE))


def signatures(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, two hashes of the set, and its prefix (the smallest shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1):
                sets = shingle_sets(rows.column(1), words)
                first = [int(np.bitwise_xor.reduce(s)) if len(s) else 0 for s in sets]
                second = [int((s * (s | np.uint64(1))).sum()) if len(s) else 0 for s in sets]
                prefixes = [s[: _prefix(len(s), percent)] for s in sets]
                edges = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(np.array(first, np.uint64).view(np.int64)),
                        pa.array(np.array(second, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(edges), pa.array(np.concatenate(prefixes).view(np.int64))
                        ),
                    ],
                    ["doc_id", "n", "f1", "f2", "prefix"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n int, f1 long, f2 long, prefix array<long>"
    )


def _may_link(signed: DataFrame, percent: int) -> DataFrame:
    """Sets (node: smallest doc_id, n, f1, f2) that pass the prefix test."""
    sets = (
        signed.filter("n > 0 and doc_id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min("doc_id").alias("node"))
    )
    # A token of one set only has equal smallest and largest owners; copies count as one owner.
    private = (
        signed.filter("n > 0 and doc_id is not null")
        .select("f1", F.explode("prefix").alias("token"))
        .groupBy("token")
        .agg(F.min("f1").alias("f1"), F.max("f1").alias("other"))
        .filter("f1 = other")
        .groupBy("f1")
        .agg(F.count(F.lit(1)).alias("private"))
    )
    t = F.expr(f"({percent} * n + 99) div 100")
    prefix = F.least(F.col("n"), F.col("n") - t + F.greatest(F.lit(1), F.expr(f"n div {SHARE}")))
    needed = F.greatest(F.lit(1), F.expr(f"(({percent} * n + 99) div 100) div {SHARE}"))
    return (
        sets.join(private, "f1", "left")
        .filter(prefix - F.coalesce("private", F.lit(0)) >= needed)
        .select("node", "n", "f1", "f2")
    )


def _survivor_tokens(
    docs: DataFrame, passed: DataFrame, words: int, percent: int, doc_id: str, text: str
) -> DataFrame:
    """node, n, size class and all tokens of the sets in ``passed``."""
    step = math.log(100 / percent) if percent < 100 else math.log(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 2):
                sets = shingle_sets(rows.column(2), words)
                wanted = rows.column(1).to_pylist()
                keep = [
                    i
                    for i, s in enumerate(sets)
                    if len(s) and int(np.bitwise_xor.reduce(s).view(np.int64)) == wanted[i]
                ]
                sets = [sets[i] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(keep, pa.int64())),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([int(math.log(len(s)) / step + 1e-9) for s in sets], pa.int32()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "n", "class", "tokens"],
                )

    ids = passed.select(F.col("node").alias("__node"), "f1")
    if passed.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    found = texts.join(ids, F.col("__id") == F.col("__node")).select("__id", "f1", "__text")
    return found.mapInArrow(run, "node long, n int, class int, tokens binary")


def _exploded(frame: DataFrame, keys: str, tokens: int) -> DataFrame:
    """A row for each token of column ``tokens`` (binary, or an array of members), after the key columns."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.column(tokens)[row]
                if isinstance(held, pa.ListScalar):
                    parts = [np.frombuffer(m["tokens"].as_py(), np.int64) for m in held]
                    found = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
                else:
                    found = np.frombuffer(held.as_py(), np.int64)
                columns = [pa.repeat(batch.column(k)[row], len(found)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], [*names, "token"])

    return frame.mapInArrow(run, f"{keys}, token long")


def _with_partners(survivors: DataFrame, percent: int) -> DataFrame:
    """Survivors with enough shingles that occur elsewhere, and the smallest such shingle (``least``)."""
    of_token = Window.partitionBy("token")
    shared = (
        _exploded(survivors.select("node", "tokens"), "node long", 1)
        .withColumns({"first": F.min("node").over(of_token), "last": F.max("node").over(of_token)})
        .filter("first != last")
        .groupBy("node")
        .agg(F.min("token").alias("least"), F.count(F.lit(1)).alias("shared"))
    )
    return survivors.join(shared, "node").filter(f"100 * shared >= {percent} * n").drop("shared")


def sorted_runs(
    batches: Iterator[pa.RecordBatch], keys: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole runs of equal values in the first ``keys`` columns, with the runs' edges."""
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(edges) > 1:
            yield batch, edges
        carry = batch.slice(edges[-1])
    if carry is not None and carry.num_rows:
        yield carry, np.array([0, carry.num_rows])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two bounded lists, as a product of 0/1 matrices."""
    if len(left) * len(right) <= 4:
        return np.array(
            [[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]
        ).reshape(len(left), len(right))
    tokens = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def rows(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        made = np.zeros((len(sets), len(part)), np.float32)
        for row, s in zip(made, sets):
            at = np.searchsorted(part, s)
            at[at == len(part)] = 0
            row[at[part[at] == s]] = 1
        return made

    for at in range(0, len(tokens), 8192):
        part = tokens[at : at + 8192]
        out += rows(left, part) @ rows(right, part).T
    return np.rint(out).astype(np.int64)


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    common = overlaps(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None] - common
    return 100 * common >= percent * union


def _roots(nodes: list[int], linked: np.ndarray) -> list[int]:
    """Smallest node of each member's connected part."""
    root = np.array(nodes, np.int64)
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            return root.tolist()
        root = lower


def _groups(survivors: DataFrame, percent: int, group_size: int) -> DataFrame:
    """gid, class, members: bounded groups of like sets, each with the links inside it found."""
    hot = (
        survivors.groupBy("class", "least")
        .count()
        .filter(F.col("count") > group_size)
        .select("class", "least", F.ceil(F.col("count") / group_size).cast("int").alias("parts"))
    )
    hot = materialize(hot, "hot-groups")
    placed = survivors.join(hot, ["class", "least"], "left").select(
        F.xxhash64(
            "class",
            "least",
            F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))),
        ).alias("gid"),
        "class",
        "node",
        "n",
        "tokens",
    )
    kind = pa.list_(
        pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in sorted_runs(batches, 2):
            out: list[list] = [[], [], []]
            nodes = batch.column(2).to_pylist()
            tokens = batch.column(4).to_pylist()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                roots = nodes[a:b]
                if b - a > 1:
                    sets = [np.frombuffer(t, np.uint64) for t in tokens[a:b]]
                    roots = _roots(roots, _linked(sets, sets, percent))
                out[0].append(batch.column(0)[a].as_py())
                out[1].append(batch.column(1)[a].as_py())
                out[2].append(
                    [
                        {"node": v, "root": r, "n": len(t) // 8, "tokens": t}
                        for v, r, t in zip(nodes[a:b], roots, tokens[a:b])
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], kind)],
                ["gid", "class", "members"],
            )

    return (
        placed.repartition("gid")
        .sortWithinPartitions("gid", "class")
        .mapInArrow(run, f"gid long, class int, members array<{MEMBER}>")
    )


def _matrix(groups: DataFrame) -> DataFrame:
    """gid, class, token, lo, df: rows of the matrix for tokens that several groups have.

    ``lo`` is the smallest group with the token, ``df`` the number of groups with it.
    """

    rows = _exploded(groups, "gid long, class int", 2)
    of_token = Window.partitionBy("token")
    return rows.withColumns(
        {"lo": F.min("gid").over(of_token), "df": F.count(F.lit(1)).over(of_token)}
    ).filter("df > 1")


def _candidates(groups: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """target, gid: pairs of groups, ``target`` the smaller, that a probe of a member of ``gid`` joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shared = batch.column(3)[row].values
                token = shared.field("token").to_numpy().view(np.uint64)
                df = shared.field("df").to_numpy()
                order = np.argsort(token)
                token, df = token[order], df[order]
                wanted = np.zeros(len(token), bool)
                for member in batch.column(2)[row]:
                    mine = np.frombuffer(member["tokens"].as_py(), np.uint64)
                    at = np.searchsorted(token, mine)
                    at[at == len(token)] = 0
                    at = at[token[at] == mine]
                    n = len(mine)
                    # Probes that the bound asks for, less those spent on tokens no smaller group has.
                    probes = n - _least_overlap(n, percent) + 1 - (n - len(at))
                    if probes > 0:
                        wanted[at[np.lexsort((token[at], df[at]))[:probes]]] = True
                found = token[wanted].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found),
                        pa.repeat(batch.column(1)[row], len(found)),
                        pa.repeat(batch.column(0)[row], len(found)),
                    ],
                    ["token", "class", "gid"],
                )

    of_group = (
        matrix.filter("lo < gid")
        .groupBy("gid")
        .agg(F.collect_list(F.struct("token", "df")).alias("shared"))
    )
    probes = (
        groups.join(of_group, "gid")
        .select("gid", "class", "members", "shared")
        .mapInArrow(run, "token long, class int, gid long")
        # A partner's size is within a factor of 100 / percent: its class is the same or the next.
        .withColumns({"class": F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1))})
    )
    targets = matrix.select("token", "class", F.col("gid").alias("target"))
    hits = probes.join(targets, ["token", "class"]).filter("target < gid")
    return hits.select("target", "gid").distinct()


def _links_between(groups: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """a, b: a link for each set and connected part of a group that it reaches."""
    asking = candidates.join(groups.select("gid", F.col("members").alias("asking")), "gid")
    opened = asking.join(groups.select(F.col("gid").alias("target"), "members"), "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                out: list[list] = [[], []]
                members = batch.column(1)[row].as_py()
                sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
                union = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
                nodes, asked = [], []
                for q in batch.column(0)[row].as_py():
                    mine = np.frombuffer(q["tokens"], np.uint64)
                    at = np.searchsorted(union, mine)
                    at[at == len(union)] = 0
                    if int((union[at] == mine).sum()) >= _least_overlap(len(mine), percent):
                        nodes.append(q["node"])
                        asked.append(mine)
                if not asked:
                    continue
                linked = _linked(asked, sets, percent)
                roots = np.array([m["root"] for m in members])
                for node, hit in zip(nodes, linked):
                    for root in np.unique(roots[hit]).tolist():
                        out[0].append(node)
                        out[1].append(root)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return opened.select("asking", "members").mapInArrow(run, "a long, b long")


def similarity_classes(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the class) of every row of ``docs``."""
    signed = materialize(signatures(docs, words, percent, doc_id, text), "signatures")
    passed = materialize(_may_link(signed, percent), "may-link")
    survivors = materialize(
        _survivor_tokens(docs, passed, words, percent, doc_id, text), "survivor-tokens"
    )
    survivors = materialize(_with_partners(survivors, percent), "partnered")
    groups = materialize(_groups(survivors, percent, group_size), "groups")
    matrix = materialize(_matrix(groups), "matrix")
    inside = groups.select(F.explode("members").alias("m")).select(
        F.col("m.node").alias("a"), F.col("m.root").alias("b")
    )
    between = _links_between(groups, _candidates(groups, matrix, percent), percent)
    roots = components(inside.union(between))
    classes = materialize(
        signed.filter("n > 0 and doc_id is not null")
        .groupBy("f1", "f2", "n")
        .agg(F.min("doc_id").alias("node"))
        .join(roots, "node", "left")
        .select("f1", "f2", "n", F.coalesce("root", "node").alias("component")),
        "classes",
    )
    return signed.drop("prefix").join(classes, ["f1", "f2", "n"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )
