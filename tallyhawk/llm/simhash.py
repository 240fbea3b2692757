"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where over half of its word shingles' 64-bit
hashes have it. Fingerprints that differ in at most ``radius`` bits are linked.

Fingerprints are made distinct first, so copies cost one aggregation and no pair. The 64
bits are cut into ``blocks`` parts; two fingerprints within the radius agree in at least
``blocks - radius`` of them, so every combination of that many parts is a table whose key
both share, and no link is lost. A bucket is split into chunks of at most about ``CHUNK``
rows by hash; chunk against itself and chunk against chunk are compared as bit planes:
plane k holds bit k of many fingerprints, the XOR of two planes feeds saturating bitwise
counters through carry-save steps, and words whose lanes all exceed the radius are left
out of the remaining planes. A comparison gives only a spanning forest of its links, and
chunk against chunk only joins the chunks' own components, so the rows given stay linear
in the fingerprints however dense a bucket is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhawk.llm.common import written
from tallyhawk.llm.components import connected_components
from tallyhawk.llm.forest import merge

CHUNK = 1024
_SEED = 42
_STEP = 1 << 14
_SHIFTS = 64


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split() if text else []  # bytes.lower() touches A-Z only; split() takes ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    out = np.empty(len(words) - k + 1, np.uint64)
    for at in range(0, len(out), _STEP):
        upto = min(at + _STEP, len(out))
        pairs = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist(), strict=True)
        out[at:upto] = np.array([digest(joined[s:e], _SEED) for s, e in pairs], np.uint64)
    return out


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """[words, 64] from [words, n]: how many hashes have each bit. Every eighth bit is added up in bytes, 255 hashes at a time."""
    words, n = hashes.shape
    counts = np.zeros((words, 8, 8), np.int64)  # [word, bit in byte, byte]
    for at in range(0, n, 255 * 64):
        part = hashes[:, at : at + 255 * 64]
        lots = -(-part.shape[1] // 255)
        rows = np.zeros((words, 1, lots * 255), np.uint64)
        rows[:, 0, : part.shape[1]] = part
        bits = (rows >> np.arange(8, dtype=np.uint64)[:, None]) & np.uint64(0x0101010101010101)
        sums = bits.reshape(words, 8, lots, 255).sum(axis=3, dtype=np.uint64)
        counts += sums.astype("<u8").view(np.uint8).reshape(words, 8, lots, 8).sum(axis=2, dtype=np.int64)
    return counts.transpose(0, 2, 1).reshape(words, 64)


def _remixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """64 further bits from each hash (the finaliser of SplitMix64); word 0 is the hash itself."""
    if not word:
        return hashes
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * word % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint_of(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` uint64 whose bits are set where over half of the hashes (remixed for each word) have them; zero without hashes."""
    counts = _bit_counts(np.stack([_remixed(hashes, w) for w in range(words)]))
    return np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").view("<u8")


def fingerprint_bytes(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 for null or a text without words."""
    return int(fingerprint_of(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with the signed 64-bit column ``out``. Null or wordless text gives 0."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_bytes(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text).cast("binary")))


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """[bits, words] uint64: bit ``i`` of word ``w`` of plane ``k`` is bit k of fingerprint 64 w + i. Fingerprints are [n] or [n, words] uint64."""
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    wide = np.zeros((bits.shape[1], -(-n // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8")


def _within(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is at most ``radius``: compare the counters with it from the top bit."""
    less, same = np.zeros_like(over), ~np.zeros_like(over)
    for bit in reversed(range(len(counters))):
        if radius >> bit & 1:
            less |= same & ~counters[bit]
            same = same & counters[bit]
        else:
            same = same & ~counters[bit]
    return (less | same) & ~over


def _count(counters: list[np.ndarray], over: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Add two difference planes: one full adder at the lowest bit, then ripple its carry."""
    low = counters[0]
    half = low ^ x
    carry = (low & x) | (half & y)
    counters[0] = half ^ y
    for bit in range(1, len(counters)):
        counters[bit], carry = counters[bit] ^ carry, counters[bit] & carry
    over |= carry


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little").astype(bool)


def shifted_links(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes r for which r and r + shift are within the radius; ``valid`` masks lanes, packed as a plane."""
    hop, r = divmod(shift, 64)
    padded = np.concatenate([planes, np.zeros((len(planes), hop + 1), planes.dtype)], axis=1)
    w = np.nonzero(valid)[0]
    found = np.zeros_like(valid)
    width = radius.bit_length() or 1
    counters = [np.zeros(len(w), planes.dtype) for _ in range(width)]
    over = np.zeros(len(w), planes.dtype)
    r64, l64 = np.uint64(r), np.uint64(64 - r)

    def diff(k: int) -> np.ndarray:
        p = padded[k]
        other = p[w + hop] if r == 0 else (p[w + hop] >> r64) | (p[w + hop + 1] << l64)
        return p[w] ^ other

    for k in range(0, len(planes), 2):
        if k % 8 == 0 and k:
            live = (valid[w] & ~over) != 0
            if not live.any():
                return found
            if live.mean() < 0.7:
                w, over, counters = w[live], over[live], [c[live] for c in counters]
        _count(counters, over, diff(k), diff(k + 1))
    found[w] = _within(counters, over, radius) & valid[w]
    return found


def _shifted_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i before j, within the radius and of one group, for rows sorted by group.

    Groups of over ``_SHIFTS`` rows go in slabs; all others together, row against the next, the next but one, and so on.
    """
    _, first, inverse, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    for at, n in zip(first[size > _SHIFTS].tolist(), size[size > _SHIFTS].tolist(), strict=True):
        for i, j in cross_links(fp[at : at + n], fp[at : at + n], radius):
            once = i < j
            yield i[once] + at, j[once] + at
    size, group = size[inverse], inverse
    rows = np.nonzero(size <= _SHIFTS)[0]
    shift, planes, kept = 1, None, -1
    while True:
        live = size[rows] > shift
        if not live.any():
            return
        if planes is None or live.sum() < 0.7 * kept:
            rows = rows[live]
            planes, kept = bit_planes(fp[rows]), len(rows)
        same = np.zeros(planes.shape[1] * 64, bool)
        same[: len(rows) - shift] = group[rows[:-shift]] == group[rows[shift:]]
        hit = np.nonzero(_lanes(shifted_links(planes, shift, np.packbits(same, bitorder="little").view("<u8"), radius)))[0]
        if len(hit):
            yield rows[hit], rows[hit + shift]
        shift += 1


def group_links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``_shifted_pairs``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_shifted_pairs(fp, group, radius)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def group_forest(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group: label of each row = first row of its component within its group."""
    label = np.arange(len(fp))
    for i, j in _shifted_pairs(fp, group, radius):
        label = merge(label, i, j)
    return label


def cross_links(a: np.ndarray, b: np.ndarray, radius: int, slab: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with a[i] and b[j] within the radius: ``a`` in slabs against the planes of ``b``."""
    planes = bit_planes(b)
    full = np.zeros(planes.shape[1] * 64, bool)
    full[: len(b)] = True
    full = np.packbits(full, bitorder="little").view("<u8")
    for at in range(0, len(a), slab):
        part = a[at : at + slab]
        rows = np.arange(len(part))
        mask = np.where(
            np.unpackbits(np.ascontiguousarray(part.astype("<u8")).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little") > 0,
            np.uint64(0xFFFFFFFFFFFFFFFF),
            np.uint64(0),
        )
        counters = [np.zeros((len(part), len(full)), np.uint64) for _ in range(radius.bit_length() or 1)]
        over = np.zeros_like(counters[0])
        for k in range(0, len(planes), 2):
            if k % 8 == 0 and k:
                live = ((~over & full) != 0).any(axis=1)
                if not live.any():
                    rows = rows[:0]
                    break
                if live.mean() < 0.7:
                    rows, over, counters = rows[live], over[live], [c[live] for c in counters]
            _count(counters, over, planes[k] ^ mask[rows, k][:, None], planes[k + 1] ^ mask[rows, k + 1][:, None])
        if len(rows):
            hit = _within(counters, over, radius) & full
            at_row, at_lane = np.nonzero(np.stack([_lanes(h) for h in hit]))
            if len(at_row):
                yield rows[at_row] + at, at_lane


def _bucket_keys(blocks: int, radius: int) -> list[int]:
    """A mask of the bits of each combination of ``blocks - radius`` parts."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_CHUNKS = "a long, b long, slot int, bucket long, chunk int, chunks int, fps binary, labels binary"


def _chunk_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            fp = t["fp"].to_numpy().view(np.uint64)
            key = t[["slot", "bucket", "chunk"]].to_numpy()
            change = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
            group = np.cumsum(change) - 1
            label = group_forest(fp, group, radius)
            off = np.nonzero(label != np.arange(len(fp)))[0]
            rows = [pd.DataFrame({"a": fp[label[off]].view(np.int64), "b": fp[off].view(np.int64)})]
            first = np.nonzero(change)[0]
            last = np.append(first[1:], len(fp))
            for s, e in zip(first, last, strict=True):
                if t["chunks"].iat[s] > 1:
                    head = t.iloc[s]
                    rows.append(
                        pd.DataFrame(
                            {
                                "slot": [head["slot"]], "bucket": [head["bucket"]], "chunk": [head["chunk"]], "chunks": [head["chunks"]],
                                "fps": [fp[s:e].tobytes()], "labels": [(label[s:e] - s).astype(np.int32).tobytes()],
                            }
                        )
                    )
            for r in rows:
                if len(r):
                    yield pa.RecordBatch.from_pandas(r.reindex(columns=_SCHEMA.names), schema=_SCHEMA, preserve_index=False)

        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            part = batch.to_pandas()
            if not len(part):
                continue
            held.append(part)
            n += len(part)
            if n < 50_000:
                continue
            t = pd.concat(held, ignore_index=True)
            key = t[["slot", "bucket", "chunk"]].to_numpy()
            tail = int(np.nonzero((key != key[-1]).any(axis=1))[0][-1]) + 1 if (key != key[-1]).any() else 0
            if tail:
                yield from emit(t.iloc[:tail].reset_index(drop=True))
            held, n = [t.iloc[tail:]], len(t) - tail
        if held and n:
            yield from emit(pd.concat(held, ignore_index=True))

    return run


_SCHEMA = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("slot", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("fps", pa.binary()), ("labels", pa.binary())]
)


def _tile_links(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        (fa, fb), (la, lb) = [[np.frombuffer(x, t) for x in pdf[c]] for c, t in (("fps", np.uint64), ("labels", np.int32))]
        start = np.concatenate([la, lb + len(fa)]).astype(np.int64)
        label = start
        for i, j in cross_links(fa, fb, radius):
            label = merge(label, i, j + len(fa))
        fps = np.concatenate([fa, fb]).view(np.int64)
        own = np.nonzero((start == np.arange(len(start))) & (label != start))[0]
        return pd.DataFrame({"a": fps[label[own]], "b": fps[own]})

    return run


def links(fps: DataFrame, fp: str = "fingerprint", radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect whatever is linked."""
    spread = fps.select(F.col(fp).alias("fp")).select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(_signed(m)).alias("bucket")) for i, m in enumerate(_bucket_keys(blocks, radius))])
        ).alias("k"),
    ).select("fp", "k.slot", "k.bucket")
    large = (
        spread.groupBy("slot", "bucket").count().where(F.col("count") > CHUNK)
        .select("slot", "bucket", F.ceil(F.col("count") / (CHUNK * 0.8)).cast("int").alias("chunks"))
    )
    chunked = spread.join(large, ["slot", "bucket"], "left").select(
        "fp", "slot", "bucket",
        F.coalesce(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.lit(0)).alias("chunk"),
        F.coalesce("chunks", F.lit(1)).alias("chunks"),
    )
    found = written(
        chunked.repartition("slot", "bucket", "chunk").sortWithinPartitions("slot", "bucket", "chunk", "fp").mapInArrow(_chunk_links(radius), _CHUNKS)
    )
    tiles = (
        found.where(F.col("fps").isNotNull())
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .where(F.col("other") != F.col("chunk"))
        .select("slot", "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fps", "labels")
    )
    across = tiles.groupBy("slot", "bucket", "i", "j").applyInPandas(_tile_links(radius), "a long, b long")
    return found.where(F.col("a").isNotNull()).select("a", "b").union(across)


def simhash_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 5
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint (16 hex digits), component_id``.

    Null, empty and wordless texts have fingerprint zero and link with each other like any
    other equal fingerprints. Repeated rows of an id give a row each. ``component_id`` is
    the least id reachable by links; an empty table gives an empty result.
    """
    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(raw, out="fp", shingle=shingle).select("doc_id", "fp"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = connected_components(links(distinct, "fp", radius, blocks))
    rooted = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
