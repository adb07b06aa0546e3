"""Top N items of every group by a loser-tree merge of sorted, bucketed runs.

Each task turns its rows into runs: rows with a normalised sort key (group, order, item)
whose bytes compare as the rows do, sorted, without copies, no more than N to a group.
That cut loses nothing, as the first N of a whole are among the first N of its parts, and
a group with millions of items leaves a task as N rows. Runs are stored by bucket of the
group, in blocks that name their first key and that of the block after them. Spark sorts a
bucket's blocks by first key, spilling as needed, and hands them on one by one. The loser
tree holds a run's next key before its block is there, and takes the block when that key
wins, so of each run one block at most is open. After N outputs of a group every run seeks
the next group; blocks within the finished group are passed over unopened.

Defined cases: a null group value is a group of its own; null and NaN order values come
last in either direction; rows that agree in group, order and item are copies and count
once; items compare by code point; -0.0 equals 0.0; numbers, decimals, dates, times and
truth values order in either direction, texts ascending only; an empty table gives no rows;
extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.session import plan_bytes

#: Rows that a task holds before it sorts them to runs.
RUN_ROWS = 200_000
#: Rows of a block, bytes of the table that one bucket stands for, and rows put out at once.
BLOCK_ROWS, BUCKET_BYTES, OUT_ROWS = 512, 64 << 20, 8192
_SIGN = np.uint64(1 << 63)


def _fixed(col: pa.Array, descending: bool) -> np.ndarray:
    """A flag that puts null last, and the value so that bytes compare as values: nine bytes a row, 17 for decimals."""
    null = pc.is_null(col, nan_is_null=True).to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(col.type):
        col = col.cast(pa.decimal128(38, col.type.scale))
        words = np.frombuffer(col.buffers()[1] if len(col) else b"", "<u8")[2 * col.offset : 2 * (col.offset + len(col))].reshape(-1, 2)
        bits = np.stack([words[:, 1] ^ _SIGN, words[:, 0]], axis=1)
    elif pa.types.is_floating(col.type):
        v = pc.fill_null(col.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
        bits = np.where(null, 0.0, v + 0.0).view(np.uint64)
        bits = np.where(bits & _SIGN, ~bits, bits ^ _SIGN)[:, None]
    else:
        if pa.types.is_date32(col.type):
            col = col.cast(pa.int32())
        bits = (pc.fill_null(col.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN)[:, None]
    bits = np.where(null[:, None], np.uint64(0), ~bits if descending else bits)
    return np.concatenate([null.astype(np.uint8)[:, None], np.ascontiguousarray(bits.astype(">u8")).view(np.uint8).reshape(len(col), -1)], axis=1)


def _part(col: pa.Array, descending: bool = False) -> pa.Array:
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        if descending:
            raise TypeError("text orders ascending only")
        if col.null_count == 0 and not pc.any(pc.match_substring(col, "\0"), min_count=0).as_py():
            return pc.binary_join_element_wise(b"\x00", col.cast(pa.binary()), b"\x00\x00", b"")
        return pa.array([b"\x01" if v is None else b"\x00" + v.encode().replace(b"\x00", b"\x00\xff") + b"\x00\x00" for v in col.to_pylist()], pa.binary())
    flat = np.ascontiguousarray(_fixed(col, descending))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def sort_keys(t: pa.Table, group: list[str], order: list[tuple[str, bool]], item: str) -> tuple[pa.Array, pa.Array]:
    """The group's bytes and the whole key of every row; order has (column, descending)."""
    col = lambda c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
    whole = lambda parts: pc.binary_join_element_wise(*parts, b"") if len(parts) > 1 else parts[0]
    groups = whole([_part(col(c)) for c in group])
    return groups, whole([groups, *(_part(col(c), d) for c, d in order), _part(col(item))])


class LoserTree:
    """Tournament over sorted runs: tree[0] is the run with the least key, each inner node the loser of its match."""

    def __init__(self, runs: list[list[bytes]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.tree = k, [-1] * k
        for r in range(k):
            self._replay(r)

    def _key(self, r: int) -> bytes | None:
        run, i = self.runs[r], self.at[r]
        return run[i] if i < len(run) else None

    def _replay(self, r: int) -> None:
        key, node, tree = self._key(r), (r + self.k) >> 1, self.tree
        while node:
            other = tree[node]
            if other < 0:  # still building: wait here for the opponent
                tree[node] = r
                return
            k = self._key(other)
            if k is not None and (key is None or k < key or (k == key and other < r)):
                tree[node], r, key = r, other, k
            node >>= 1
        tree[0] = r

    def least(self) -> tuple[int, bytes] | None:
        r = self.tree[0]
        key = self._key(r)
        return None if key is None else (r, key)

    def move(self, r: int, to: int) -> None:
        """Put the winner r's run to a later row."""
        self.at[r] = to
        self._replay(r)


@dataclass
class Block:
    """Some rows of a run, not opened yet; first is empty for the head of a run, which has no rows; following is the first key after it, None at the end."""

    run: int
    first: bytes
    following: bytes | None
    rows: bytes | None


class Merge:
    """The first n different keys of every group from the blocks of a bucket's runs, which come in the order of their first keys."""

    def __init__(self, n: int, keys_of):
        self.n, self.keys_of, self.opened, self.passed, self.most_open = n, keys_of, 0, 0, 0

    def taken(self, blocks: Iterator[Block]) -> Iterator[tuple[pa.Table, int, int]]:
        """(rows of a block, place in it, rank)."""
        heads, come = [], None
        for come in blocks:
            if come.first:
                break
            heads.append(come)
            come = None
        place = {b.run: r for r, b in enumerate(heads)}
        # A run is its open block's keys and groups; a key that waits for its block stands at the end.
        tree = LoserTree([[b.following] for b in heads])
        open_: list[tuple[pa.Table, list[bytes]] | None] = [None] * len(heads)
        group, count, last = None, 0, None
        while heads and (won := tree.least()) is not None:
            r, key = won
            now, i = open_[r], tree.at[r]
            if now is None or i == len(now[1]):  # the key waits for its block, which is the next to come
                b, come = (come, None) if come is not None else (next(blocks), None)
                if place[b.run] != r or b.first != key:
                    raise RuntimeError("blocks are out of order")
                done = count == self.n and group is not None and b.following is not None and b.following < group + b"\xff"
                if done:  # all of it belongs to a group that is complete
                    self.passed += 1
                    open_[r], keys = None, []
                else:
                    self.opened += 1
                    rows, groups, keys = self.keys_of(b.rows)
                    open_[r] = (rows, groups)
                    self.most_open = max(self.most_open, sum(x is not None for x in open_))
                tree.runs[r] = keys + ([b.following] if b.following is not None else [])
                tree.move(r, 0)
                continue
            rows, groups = now
            if groups[i] != group:
                group, count, last = groups[i], 0, None
            if count == self.n:  # seek: past the last row of this group in this block
                tree.move(r, bisect_left(groups, group + b"\xff", i))
            else:
                if key != last:
                    count, last = count + 1, key
                    yield rows, i, count
                tree.move(r, i + 1)


def _run(t: pa.Table, group: list[str], order: list[tuple[str, bool]], item: str, n: int) -> tuple[pa.Table, pa.Array]:
    """Sorted by key, each key once, at most n to a group; and the keys."""
    groups, keys = sort_keys(t, group, order, item)
    at = pc.sort_indices(keys)
    groups, keys = groups.take(at), keys.take(at)
    if len(keys) == 0:
        return t, keys
    new = lambda a: np.concatenate([[True], pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)])
    once = np.flatnonzero(new(keys))
    starts = np.flatnonzero(new(groups.take(pa.array(once))))
    rank = np.arange(len(once)) - np.repeat(starts, np.diff(np.append(starts, len(once))))
    kept = pa.array(once[rank < n])
    return t.take(at.take(kept)), keys.take(kept)


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def top_n(df: DataFrame, group: list[str], order: list[tuple[str, bool]], item: str, n: int, buckets: int | None = None) -> DataFrame:
    """group, order and item columns of the first n items of each group, and their rank from 1.

    buckets: how many parts the groups are spread over; by default four times spark.sql.shuffle.partitions, or as many as
    there are BUCKET_BYTES in the table, if Spark knows its size.
    """
    cols = list(dict.fromkeys([*group, *(c for c, _ in order), item]))
    if buckets is None:
        size = plan_bytes(df.select(*cols))
        buckets = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES) if size < 1 << 55 else 0)
    rows = df.select(*cols, F.pmod(F.xxhash64(*group), F.lit(buckets)).cast("int").alias("__bucket"))

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t, keys = _run(pa.Table.from_batches(held), ["__bucket", *group], order, item, n)
            held.clear()
            b = t["__bucket"].to_numpy()
            run = np.random.default_rng().integers(1 << 62)  # only tells runs apart
            t, cuts = t.drop_columns("__bucket"), np.flatnonzero(np.diff(b, prepend=-1, append=-1))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                starts = range(a, z, BLOCK_ROWS)
                first = [keys[i].as_py()[9:] for i in starts]  # without the bucket
                packed = [_pack(t.slice(i, min(BLOCK_ROWS, z - i))) for i in starts]
                made = [pa.array([b[a]] * (len(first) + 1), pa.int32()), pa.array([run] * (len(first) + 1), pa.int64()), pa.array([b"", *first], pa.binary()), pa.array([*first, None], pa.binary()), pa.array([None, *packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["bucket", "run", "first", "following", "rows"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= RUN_ROWS:
                yield from flush()
        if sum(x.num_rows for x in held):
            yield from flush()

    def keys_of(packed: bytes) -> tuple[pa.Table, list[bytes], list[bytes]]:
        t = pa.ipc.open_stream(packed).read_all()
        groups, keys = sort_keys(t, group, order, item)
        return t, groups.to_pylist(), keys.to_pylist()

    def to_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Block by block: only the columns' pieces of one row are made Python objects at a time.
        rows = ((b.column(0)[i].as_py(), Block(b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].as_py())) for b in batches for i in range(b.num_rows))
        for _, of_bucket in groupby(rows, key=lambda x: x[0]):
            kept: dict[int, tuple[pa.Table, list[int], list[int]]] = {}
            count = 0
            for t, i, rank in Merge(n, keys_of).taken(x[1] for x in of_bucket):
                at = kept.setdefault(id(t), (t, [], []))
                at[1].append(i)
                at[2].append(rank)
                count += 1
                if count == OUT_ROWS:
                    yield put(kept)
                    count = 0
            if kept:
                yield put(kept)

    def put(kept: dict) -> pa.RecordBatch:
        tables = [t.take(pa.array(i, pa.int64())).append_column("rank", pa.array(ranks, pa.int32())) for t, i, ranks in kept.values()]
        kept.clear()
        return pa.concat_tables(tables).combine_chunks().to_batches()[0]

    made = rows.mapInArrow(to_runs, "bucket int, run long, first binary, following binary, rows binary")
    runs = made.repartition("bucket").sortWithinPartitions("bucket", "first", "run")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__bucket")
    return runs.mapInArrow(to_top, f"{schema}, rank int")
