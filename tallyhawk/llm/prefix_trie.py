"""A trie of conversations by distributed burst tries.

A conversation is the sequence of its turns, a node every distinct sequence of first turns.
Turns are told by 16 bytes of a SHA-256 of role and text, so texts are never moved or
sorted; equal conversations are one sequence with a count before anything else happens.

A container holds the sequences that go on below one node, its head. At first all belong to
the root. A container with more than ``most`` turns is burst: its head becomes a node of the
upper trie, and its sequences are dealt to containers by their next turn. That goes on, some
levels at a time (4, then 8, 16, ...), for the sequences still in crowded containers, so a
long beginning that many share takes few rounds. What remains is dealt by container, sorted
by Spark as byte strings within each task, and swept: a container's sequences come in order,
each shares its first turns with the one before, and the shared depths give the nodes. A
container fits in memory by its bound (one sequence may be longer than the bound).

Below an upper node lie upper nodes and containers. Leaves and savings of containers are
added to their heads, then up the upper trie by pointers that double their reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import few, released, written

ROOT = bytes(16)
_ID = 16
_NOBODY = hashlib.sha256(b"").hexdigest()
#: Conversation ids of one stretch of so many are joined in one task; stretches are hashed one after the other.
_STRETCH = 1 << 16


def _sha128(c: Column) -> Column:
    return F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2 * _ID))


def turn_lists(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: turns by number (null first; ties by id) as structs of ``id`` (16 bytes) and ``chars``. Rows without a conversation take no part."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    one = F.struct(
        F.col(turn).alias("turn"),
        _sha128(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)).alias("id"),
        F.length(text_).alias("chars"),
    )
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("t"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_starts(lists: DataFrame, every: int = 100, modulus: int = 6) -> DataFrame:
    """``turn_lists`` with the first ``crc32(conv_id) % modulus`` turns of each replaced by those of conversation ``conv_id - conv_id % every``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    starts = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, modulus - 1).alias("start"))
    told = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(starts, "base", "left")
    none = F.array().cast("array<struct<id:binary,chars:int>>")
    begin = F.when(F.col("h") > 0, F.slice(F.coalesce("start", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    return told.select("conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _chain(ids: bytes, most: int) -> Iterator[bytes]:
    """Keys of the first ``most`` prefixes, from that of one turn on: each a hash of the key before and the turn."""
    key = ROOT
    for at in range(0, min(len(ids), _ID * most), _ID):
        key = hashlib.blake2b(key + ids[at : at + _ID], digest_size=_ID).digest()
        yield key


_PREFIX = "seq binary, key binary, parent binary, depth int, chars int, n long, first long, rest long"


def _prefixes(above: int, upto: int):
    """Rows of the prefixes of ``above + 1`` to ``upto`` turns of every sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                rows: list[tuple] = []
                for seq, ids, chars, n, first in zip(*(c.to_pylist() for c in batch.slice(at, 2048).columns), strict=True):
                    size, parent = len(ids) // _ID, ROOT
                    for depth, key in enumerate(_chain(ids, upto), 1):
                        if depth > above:
                            rows.append((seq, key, parent, depth, chars[depth - 1], n, first, size - depth))
                        parent = key
                if rows:
                    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    names = [c.split()[0] for c in _PREFIX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's members from its stretches, which come sorted; only the hash's state is kept."""
    seq, told = None, None
    for batch in batches:
        keys, hashes = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != seq:
                if told is not None:
                    keys.append(seq)
                    hashes.append(told.hexdigest())
                seq, told = key, hashlib.sha256(text.encode())
            else:
                told.update(b"," + text.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes)], ["seq", "ends"])
    if told is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([told.hexdigest()])], ["seq", "ends"])


def _sequences(lists: DataFrame) -> DataFrame:
    """``seq, ids, chars, n, first, ends`` of every distinct sequence."""
    blob = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    rows = lists.select("conv_id", blob.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars")).withColumn("seq", _sha128(F.col("ids")))
    rows = written(rows)
    distinct = rows.groupBy("seq").agg(F.first("ids").alias("ids"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    stretch = rows.groupBy("seq", F.expr(f"conv_id div {_STRETCH}").alias("stretch")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("told"))
    ends = stretch.repartition("seq").sortWithinPartitions("seq", "stretch").select("seq", "told").mapInArrow(_end_hashes, "seq binary, ends string")
    out = written(distinct.join(ends, "seq"))
    released(rows)
    return out


def _upper(seqs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Burst containers until none is crowded: (``key, parent, depth, chars, n, first`` of the nodes burst, ``seq, key, depth, first`` of every sequence's deepest one)."""
    whole = seqs.agg(F.sum("n").alias("n"), F.min("first").alias("first")).head()
    spark = seqs.sparkSession
    root = spark.createDataFrame([(ROOT, None, 0, 0, whole["n"], whole["first"])], "key binary, parent binary, depth int, chars int, n long, first long")
    upper, under = [root], []
    active, above, step = seqs.select("seq", "ids", "chars", "n", "first"), 0, 4
    top = active.select("seq", F.lit(ROOT).alias("key"), F.lit(0).alias("depth"), F.lit(whole["first"]).alias("head_first"))
    while True:
        rows = active.mapInArrow(_prefixes(above, above + step), _PREFIX)
        sizes = rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "chars")), F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("rest").alias("rest"))
        burst = written(sizes.where(F.col("rest") > most).drop("rest"))
        if not burst.head(1):
            released(burst)
            under.append(top)
            break
        upper.append(burst)
        heads = few(burst.select("key", F.col("first").alias("head_first")))
        deepest = rows.select("seq", "key", "depth").join(heads, "key").groupBy("seq").agg(F.max(F.struct("depth", "key", "head_first")).alias("m"))
        top = written(top.join(deepest, "seq", "left").select("seq", *(F.coalesce(f"m.{c}", c).alias(c) for c in ("key", "depth", "head_first"))))
        above += step
        step *= 2
        under.append(top.where(F.col("depth") < above))
        top = top.where(F.col("depth") == above)
        active = written(active.join(top.select("seq"), "seq", "left_semi"))
    for frames in (upper, under):
        while len(frames) > 1:
            frames.append(frames.pop(0).unionByName(frames.pop(0)))
    return upper[0], under[0]


_NODES = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("head", pa.binary()),
    ]
)
_NODES_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, head binary"


class _Container:
    """Nodes of one container while its sequences come in order: parallel lists, parents before children."""

    def __init__(self, head: bytes, depth: int, head_first: int):
        self.head, self.above, self.head_first = head, depth, head_first
        self.up, self.depth, self.chars, self.n, self.first, self.ends = [], [], [], [], [], []
        self.path: list[int] = []  # open nodes, from the top
        self.ids = b""

    def add(self, ids: bytes, chars: list[int], n: int, first: int, ends: str) -> None:
        size, shared = len(ids) // _ID, 0
        limit = min(len(self.path), size - self.above)
        while shared < limit and ids[(at := _ID * (self.above + shared)) : at + _ID] == self.ids[at : at + _ID]:
            shared += 1
        del self.path[shared:]
        for depth in range(self.above + shared + 1, size + 1):
            self.up.append(self.path[-1] if self.path else -1)
            self.path.append(len(self.depth))
            self.depth.append(depth)
            self.chars.append(chars[depth - 1])
            self.n.append(0)
            self.first.append(first)
            self.ends.append(_NOBODY)
        self.n[self.path[-1]] += n
        self.first[self.path[-1]] = min(first, self.first[self.path[-1]])
        self.ends[self.path[-1]] = ends
        self.ids = ids

    def rows(self) -> list[tuple]:
        count = len(self.up)
        children, leaves, saved = [0] * count, [0] * count, [0] * count
        for k in range(count - 1, -1, -1):
            leaves[k] = leaves[k] or 1
            saved[k] += (self.n[k] - 1) * self.chars[k]
            if (p := self.up[k]) >= 0:
                self.n[p] += self.n[k]
                self.first[p] = min(self.first[p], self.first[k])
                children[p] += 1
                leaves[p] += leaves[k]
                saved[p] += saved[k]
        return [
            (self.first[k], self.depth[k], self.first[p] if p >= 0 else self.head_first, self.n[k], children[k], leaves[k], saved[k], self.ends[k], None if p >= 0 else self.head)
            for k, p in enumerate(self.up)
        ]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sequences that come sorted by container and turns."""
    now, at, rows = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)

    for batch in batches:
        for begin in range(0, len(batch), 1024):
            for container, ids, chars, n, first, ends, head, depth, head_first in zip(*(c.to_pylist() for c in batch.slice(begin, 1024).columns), strict=True):
                if container != at:
                    if now:
                        rows += now.rows()
                    now, at = _Container(head, depth, head_first), container
                now.add(ids, chars, n, first, ends)
                if len(rows) > 20_000:
                    yield flush()
                    rows = []
    if now:
        rows += now.rows()
    if rows:
        yield flush()


def _rolled_up(upper: DataFrame) -> DataFrame:
    """``key, leaves, saved`` summed over the upper nodes below each (itself included): every round a node takes in those twice as far below."""
    t = upper.select("key", F.col("parent").alias("up"), "leaves", "saved")
    for _ in range(upper.agg(F.max("depth")).head()[0].bit_length()):
        added = t.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = t.select(F.col("key").alias("up"), F.col("up").alias("next"))
        t = written(
            t.join(added, "key", "left").join(jump, "up", "left")
            .select("key", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        )
    return t.select("key", "leaves", "saved")


def trie(lists: DataFrame, most: int = 1 << 15) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``lists`` has one row a conversation: ``conv_id`` and ``turns``, an array of structs of
    ``id`` (16 bytes) and ``chars``. Conversations without turns end at the root. No
    conversations give no nodes, not even a root. The least member and the depth tell a node.
    """
    seqs = _sequences(lists)
    if not seqs.head(1):
        return seqs.sparkSession.createDataFrame([], _NODES_SQL).drop("head")
    upper, under = _upper(seqs, most)
    under = under.withColumnRenamed("key", "head")
    rows = written(seqs.join(under, "seq"))
    inside = F.length("ids") > F.col("depth") * _ID
    dealt = rows.where(inside).withColumn("container", F.sha1(F.concat("head", F.expr(f"substring(ids, depth * {_ID} + 1, {_ID})"))))
    swept = written(
        dealt.repartition("container").sortWithinPartitions("container", "ids")
        .select("container", "ids", "chars", "n", "first", "ends", "head", "depth", "head_first").mapInArrow(_sweep, _NODES_SQL)
    )
    tops = swept.where(F.col("head").isNotNull())
    below = tops.groupBy(F.col("head").alias("key")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("kid_leaves"), F.sum("saved_tokens").alias("kid_saved"))
    upper_kids = upper.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("upper_kids"))
    ended = rows.where(~inside).select(F.col("head").alias("key"), "ends")
    zero = F.lit(0)
    heads = upper.join(below, "key", "left").join(upper_kids, "key", "left").join(ended, "key", "left")
    children = F.coalesce("kids", zero) + F.coalesce("upper_kids", zero)
    heads = written(
        heads.select(
            "key", "parent", "depth", "n", "first", children.alias("n_children"), F.coalesce("ends", F.lit(_NOBODY)).alias("ends"),
            (F.coalesce("kid_leaves", zero) + F.when(children == 0, 1).otherwise(0)).alias("leaves"),
            (F.coalesce("kid_saved", zero) + (F.col("n") - 1) * F.col("chars")).alias("saved"),
        )
    )
    above = heads.select(F.col("key").alias("parent"), F.col("first").alias("parent_first"))
    told = heads.drop("leaves", "saved").join(_rolled_up(heads), "key").join(above, "parent", "left")
    told = told.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("n_children").cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return swept.drop("head").unionByName(told)
