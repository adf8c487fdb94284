"""Hierarchical residual packing of token pieces into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces, the first of which takes the remainder. Full
pieces are sequences already. The rest are packed in rounds. In each round every task best-fits its items,
longest first; bins that are nearly full are final; the others go up as single items to a task that
serves several of the tasks below, until one is left.

After a round at most one bin of a task is at most half full, for two such bins would fit together. A
bin of more than half can only take one of those. So a task sends up its bin of at most half and, for it
and its neighbours' bins, its ``carried`` emptiest others; the rest are final. What meets in a task is thus
bounded by ``fan_in * (carried + 1)`` bins, and the tree has log(tasks) rounds.

Defined cases: null and empty texts have only their end id; a null id is an item like others; repeated rows
are items of their own; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm.byte_pair import encoder
from oddsloom.session import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
MEMBER = "struct<item:bigint,length:int>"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece of each document; ``with_ids`` adds the ids (binary, unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[], [], [], [], [], []]
                for key, ids in zip(part[0].to_pylist(), encode(part[1].to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    start = 0
                    for piece in range(-(-n // capacity)):
                        stop = start + (capacity if start or n % capacity == 0 else n % capacity)
                        view = ids[4 * start : 4 * stop]
                        for column, value in zip(
                            rows, (key, piece, start, stop - start, zlib.crc32(view), view)
                        ):
                            column.append(value)
                        start = stop
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(rows, kinds)][: 6 if with_ids else 5]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, shape)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions, best fit, in the order given.

    ``open_`` has a bit for each residual that some bin has, so the best fit is the lowest bit from
    the item's length up.
    """
    open_ = 0
    by_residual: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i, length in enumerate(lengths.tolist()):
        fits = open_ >> length
        if fits:
            residual = length + (fits & -fits).bit_length() - 1
            stack = by_residual[residual]
            which = stack.pop()
            if not stack:
                open_ &= ~(1 << residual)
        else:
            residual, which = capacity, len(bins)
            bins.append([])
        bins[which].append(i)
        left = residual - length
        if left:
            stack = by_residual.setdefault(left, [])
            stack.append(which)
            open_ |= 1 << left
    return bins


def _round(capacity: int, nearly_full: int, carried: int, last: bool):
    """Packs the items (``fill``, ``members``) of a partition; ``final`` tells the closed bins."""
    shape = pa.schema(
        [
            ("fill", pa.int32()),
            ("members", pa.list_(pa.struct([("item", pa.int64()), ("length", pa.int32())]))),
            ("final", pa.bool_()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, offsets, items, lengths = [], [np.zeros(1, np.int64)], [], []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            members = batch.column(1)
            flat = members.flatten()
            fills.append(batch.column(0).to_numpy())
            offsets.append(np.cumsum(pa.compute.list_value_length(members).to_numpy()) + offsets[-1][-1])
            items.append(flat.field("item").to_numpy())
            lengths.append(flat.field("length").to_numpy())
        if not fills:
            return
        fill, item, length = np.concatenate(fills), np.concatenate(items), np.concatenate(lengths)
        offset = np.concatenate(offsets)
        # One order for the same rows, so that a task that runs again packs them alike.
        order = np.lexsort((item[offset[:-1]], -fill))
        bins = best_fit(fill[order], capacity)
        total = np.array([fill[order[b]].sum() for b in bins])
        final = total >= nearly_full
        small = np.flatnonzero(~final)
        if last:
            final[:] = True
        elif len(small) > carried + 1:
            keep = small[np.argsort(total[small], kind="stable")[: carried + 1]]
            final[:] = True
            final[keep] = False
        for at in range(0, len(bins), 4096):
            out = bins[at : at + 4096]
            rows = [
                [
                    {"item": x, "length": y}
                    for i in b
                    for x, y in zip(
                        item[offset[order[i]] : offset[order[i] + 1]].tolist(),
                        length[offset[order[i]] : offset[order[i] + 1]].tolist(),
                    )
                ]
                for b in out
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(total[at : at + 4096].astype(np.int32)),
                    pa.array(rows, shape.field("members").type),
                    pa.array(final[at : at + 4096]),
                ],
                schema=shape,
            )

    return pack


def pack(
    items: DataFrame,
    capacity: int = 1024,
    nearly_full: int = 1016,
    carried: int = 255,
    fan_in: int = 8,
    tasks: int | None = None,
) -> DataFrame:
    """item, sequence_id and offset for each row of ``items`` (item bigint, unique; length int).

    Items must be 1 to ``capacity`` long. ``tasks`` is the number of tasks of the first round.
    """
    spark = items.sparkSession
    shape = f"fill int, members array<{MEMBER}>, final boolean"
    level = items.select(
        F.col("length").cast("int").alias("fill"),
        F.array(F.struct(F.col("item"), F.col("length").cast("int").alias("length"))).alias("members"),
    )
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = level.repartition(n, F.xxhash64(F.element_at("members", 1)["item"]))
    done = []
    while True:
        packed = level.mapInArrow(_round(capacity, nearly_full, carried, n == 1), shape)
        # The bins that stay and the bins that go on must come from one run of the task.
        packed = materialize(packed, "packing")
        done.append(packed.filter("final").select("members"))
        if n == 1:
            break
        n = math.ceil(n / fan_in)
        # The first item of a bin names it, so where it goes does not depend on the order of rows.
        level = packed.filter("not final").select("fill", "members")
        level = level.repartition(n, F.xxhash64(F.element_at("members", 1)["item"]))
    bins = done[0]
    for more in done[1:]:
        bins = bins.union(more)
    before = F.transform(
        F.sequence(F.lit(1), F.size("members")),
        lambda i: F.aggregate(
            F.slice("members", F.lit(1), i - 1), F.lit(0), lambda total, m: total + m["length"]
        ),
    )
    return (
        # An item is in one bin only, so the first one's number names the sequence.
        bins.select(
            F.element_at("members", 1)["item"].alias("sequence_id"),
            F.explode(F.arrays_zip("members", before.alias("offset"))).alias("m"),
        )
        .select(
            F.col("m.members.item").alias("item"),
            "sequence_id",
            F.col("m.offset").cast("long").alias("offset"),
        )
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, doc_id, text)
    # Written once: tokens are counted once, and each piece keeps its number.
    pieces = pieces.withColumns({"item": F.monotonically_increasing_id()})
    pieces = materialize(pieces, "pieces")
    full = pieces.filter(F.col("length") == capacity).select(
        "*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    placed = pack(rest.select("item", "length"), capacity)
    return full.unionByName(rest.join(placed, "item")).drop("item")
