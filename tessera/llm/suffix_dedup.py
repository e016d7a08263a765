"""Removal of byte strings that repeat anywhere in the corpus, by prefix doubling on anchor positions.

A byte is removed if a string of LENGTH bytes that starts at two places covers it. Sorting every position is out of
reach, so positions meet through anchors: each window of LENGTH bytes names the smallest hash among its GRAM-byte strings
as its anchor, so equal windows have equal anchors at equal places, and consecutive windows of one anchor form one node
(one for about 140 bytes). Nodes are told apart by the GRAM bytes at their anchor first; what is unique there goes, and a
node whose whole reach recurs is settled at once. The others are cut into runs of STEP windows, and each run's first
place is ranked at lengths GRAM, 2 GRAM and LENGTH - STEP + 1: the rank at one length is the place in Spark's sort of the
pairs (rank at the length before, fingerprint of the bytes from there on), and a pair that occurs once goes before the next
length. Windows of the runs that are left are compared last, as pairs of their run's rank and fingerprints of LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, drop, running_totals, steps, table, written
from tessera.llm.words import mix

LENGTH = 400
GRAM = 128
STEP = 32
#: Bits of a place in a slice of documents: Arrow has no longer texts.
_PLACE = np.uint64(31)
#: Text bytes that one numpy step handles: some 20 arrays of 8 bytes for each live at once.
SLICE = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LETTERS = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) for s in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)]
_powers: list[np.ndarray] = []


class Fingerprints:
    """64-bit fingerprints of any strings of a byte array, from sums of letters times powers of an odd base; two kinds."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if not _powers or len(_powers[0]) < n:
            size = max(n, SLICE) + 1
            _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for base in _BASES for b in (base, pow(base, -1, 1 << 64))]
        self.sums = []
        for k in (0, 1):
            s = np.zeros(n, np.uint64)
            np.cumsum(_LETTERS[k][data] * _powers[2 * k][: n - 1], out=s[1:])
            self.sums.append(s)

    def of(self, start, end, kind: int = 0) -> np.ndarray:
        """Of data[start:end], elementwise; equal strings have equal ones wherever they stand."""
        s = self.sums[kind]
        return mix((s[end] - s[start]) * _powers[2 * kind + 1][start] + np.asarray(end - start).astype(np.uint64))


def _smallest(v: np.ndarray, size: int) -> np.ndarray:
    """Minima of every `size` consecutive values."""
    have, out = 1, v
    while have * 2 <= size:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _nodes(data: np.ndarray, off: np.ndarray, prints: Fingerprints, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, anchor, first and last window of each node, as places in data."""
    n = len(data)
    if n < length:
        return (np.empty(0, np.int64),) * 4
    if n >> int(_PLACE):
        raise ValueError("a text of 2 GB or more")
    at = np.arange(n - gram + 1)
    v = (prints.of(at, at + gram) >> _PLACE << _PLACE) | at.astype(np.uint64)
    anchor = (_smallest(v, length - gram + 1) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    sizes = np.diff(off)
    whole = np.flatnonzero(sizes >= length)
    windows = sizes[whole] - length + 1
    p = np.repeat(off[whole] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum()) if len(whole) else np.empty(0, np.int64)
    doc = np.repeat(whole, windows)
    a = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return doc[first], a[first], p[first], p[last]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Nodes: doc_id, a, lo, hi (anchor, first and last window in the document), core, and f1, f2 of the whole reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=SLICE):
            data, off = bytes_of(batch.column("text"))
            prints = Fingerprints(data)
            doc, a, lo, hi = _nodes(data, off, prints, length, gram)
            if not len(doc):
                continue
            core = prints.of(a, a + gram)
            # the fingerprint holds the node's place and extent around its anchor
            extent = mix((a - lo).astype(np.uint64) * np.uint64(1 << 20) + (a - hi).astype(np.uint64))
            f1, f2 = (prints.of(lo, hi + length, k) ^ extent for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array((x - off[doc]).astype(np.int32)) for x in (a, lo, hi)), _signed(core), _signed(f1), _signed(f2)], ["doc_id", "a", "lo", "hi", "core", "f1", "f2"])

    return docs.mapInArrow(run, "doc_id bigint, a int, lo int, hi int, core bigint, f1 bigint, f2 bigint")


def _cut_out(docs: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """The nodes' own bytes: doc_id, a, lo, hi, weight, bytes (of all their windows). parts: doc_id, nodes (an array of the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=SLICE):
            rows = []
            for doc, text, nodes in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                raw = text.encode()
                rows += [(doc, x["a"], x["lo"], x["hi"], x["weight"], raw[x["lo"] : x["hi"] + length]) for x in nodes if x["hi"] + length <= len(raw)]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "a", "lo", "hi", "weight", "bytes"])

    return docs.join(parts, "doc_id").select("doc_id", "text", "nodes").mapInArrow(run, "doc_id bigint, a int, lo int, hi int, weight int, bytes binary")


def _ranked(reach: DataFrame, length: int, gram: int, step: int, single: bool) -> DataFrame:
    """Each node's runs of windows, cut where their distance from the anchor is a multiple of `step` (single: every window):
    doc_id, a, lo, hi, weight, rank (the distance; single: the node's own), p1, p2, p3 (fingerprints of the bytes that all windows of
    such a run hold: the first `gram`, the next, the others), f1, f2 (of the run's whole reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "bytes", SLICE // 2):
            a, lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("a", "lo", "hi"))
            column = batch.column("bytes").cast(pa.large_binary())
            off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
            prints, base = Fingerprints(data), off[:-1] - off[0] - lo  # place in data of the document's byte 0
            size = 1 if single else step
            near, far = (a - hi) // size, (a - lo) // size
            n = far - near + 1
            row = np.repeat(np.arange(len(a)), n)
            m = np.repeat(near - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            first, last = np.maximum(lo[row], a[row] - m * size - size + 1), np.minimum(hi[row], a[row] - m * size)
            b = base[row]
            extent = mix((a[row] - first).astype(np.uint64) * np.uint64(1 << 20) + (a[row] - last).astype(np.uint64))
            fs = [prints.of(b + first, b + last + length, k) ^ extent for k in (0, 1)]
            columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (a[row], first, last)), batch.column("weight").take(pa.array(row))]
            if single:
                columns += [batch.column("rank").take(pa.array(row)), *(_signed(x) for x in fs)]
            else:
                # all windows at distances m*size .. m*size+size-1 hold the bytes from `begin` on
                begin = b + a[row] - m * size
                ends = [begin, begin + gram, begin + 2 * gram, begin - size + 1 + length]
                columns += [pa.array(m), *(_signed(prints.of(x, y, k)) for k, (x, y) in zip((0, 1, 0), zip(ends, ends[1:]), strict=True)), *(_signed(x) for x in fs)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, a int, lo int, hi int, weight int, rank bigint, " + ("" if single else "p1 bigint, p2 bigint, p3 bigint, ") + "f1 bigint, f2 bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    return reach.mapInArrow(run, schema)


def _longer(rows: DataFrame, more: str) -> DataFrame:
    """One round of doubling: rows whose pair (rank, `more`) occurs once go; the others' new rank is their pair's place in the sort of all pairs."""
    pairs = written(rows.groupBy("rank", more).agg(F.count("*").alias("n__")).where("n__ > 1"))
    # a table of its own, so that the join by a hot pair may be split
    ranks = written(running_totals(pairs, ["rank", more], "n__", "rank__").select("rank", more, "rank__"))
    out = written(rows.join(ranks, ["rank", more]).drop("rank", more).withColumnRenamed("rank__", "rank"))
    drop(rows, pairs, ranks)
    return out


def _settled(rows: DataFrame, core: str) -> tuple[DataFrame, DataFrame]:
    """One rerank. rows: doc_id, a, lo, hi, weight, core, f1, f2. Returns the runs all of whose windows recur (doc_id, lo, hi),
    and what the next length has to tell apart: one row for each class of equal runs, of weight 2 if the class is settled,
    where a core is held by several classes of which at least one is not."""
    # counts are tables of their own, so that a join by a hot core may be split
    many = written(rows.groupBy(core).agg(F.count("*").alias("n__")).where("n__ > 1").drop("n__"))
    again = written(rows.join(many, core, "left_semi"))
    drop(rows, many)
    classes = written(again.groupBy(core, "f1", "f2").agg(F.sum("weight").alias("w"), *(F.first(c).alias(c) for c in ("doc_id", "a", "lo", "hi"))))
    whole = written(classes.where("w > 1").select("f1", "f2").distinct())
    found = written(again.where("weight = 1").join(whole, ["f1", "f2"], "left_semi").select("doc_id", "lo", "hi"))
    drop(again, whole)
    open_ = classes.groupBy(core).agg(F.count("*").alias("n__"), F.min("w").alias("least__")).where("n__ > 1 and least__ = 1").drop("n__", "least__")
    open_ = written(open_)
    left = written(classes.join(open_, core, "left_semi").select("doc_id", "a", "lo", "hi", core, F.least("w", F.lit(2)).cast("int").alias("weight")))
    drop(classes, open_)
    return found, left


def recurring(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP) -> DataFrame:
    """doc_id, lo, hi: runs of windows (places of first bytes) that all recur. docs: doc_id (unique), text (not null).
    2 * gram < length - step + 1."""
    nodes = anchors(docs, length, gram).withColumn("weight", F.lit(1))
    found, left = _settled(written(nodes), "core")
    parts = left.groupBy("doc_id").agg(F.collect_list(F.struct("a", "lo", "hi", "weight")).alias("nodes"))
    reach = written(_cut_out(docs, parts, length))
    drop(left)
    runs = written(_ranked(reach, length, gram, step, False))
    for more in ("p1", "p2", "p3"):
        runs = _longer(runs, more)
    more, left = _settled(runs, "rank")
    found = found.union(more)
    windows = left.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}).join(reach.drop("weight"), ["doc_id", "a"])
    windows = windows.select("doc_id", "a", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "weight", "rank", F.expr(f"substring(bytes, lo2 - lo + 1, hi2 - lo2 + {length})").alias("bytes"))
    single = written(_ranked(windows, length, gram, step, True).select("doc_id", "lo", "hi", "weight", "rank", "f1", "f2"))
    drop(reach, left)
    twice = written(single.groupBy("rank", "f1", "f2").agg(F.sum("weight").alias("w")).where("w > 1").drop("w"))
    last = written(single.where("weight = 1").join(twice, ["rank", "f1", "f2"], "left_semi").select("doc_id", "lo", "hi"))
    drop(single, twice)
    return found.union(last)


def removed(docs: DataFrame, length: int = LENGTH, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, but for digest_only, kept (the remaining bytes) of every document.

    Null texts are empty; matches never cross documents; rows without a doc_id go. Rows that repeat a doc_id and its text count
    as two documents; one doc_id must not have two texts. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    per = recurring(docs.where(F.octet_length("text") >= length), length).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=SLICE):
            data, off = bytes_of(batch.column("text"))
            edges = np.zeros(len(data) + 1, np.int32)
            spans = batch.column("spans")
            rows = np.flatnonzero(~np.asarray(spans.is_null()))
            if len(rows):
                taken = spans.take(pa.array(rows))
                flat, base = taken.flatten(), np.repeat(off[rows], np.diff(taken.offsets.to_numpy()))
                np.add.at(edges, np.minimum(flat.field("lo").to_numpy() + base, len(data)), 1)
                np.add.at(edges, np.minimum(flat.field("hi").to_numpy() + base + length, len(data)), -1)
            gone = np.cumsum(edges)[:-1] > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            begins = off[:-1][off[:-1] < len(data)]
            head[begins] = gone[begins]  # a run does not go on into the next document
            counts = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, head)]
            n_gone, n_spans = (c[off[1:]] - c[off[:-1]] for c in counts)
            kept = [(data[x:y][~gone[x:y]] if g else data[x:y]).tobytes() for x, y, g in zip(off[:-1], off[1:], n_gone, strict=True)]
            out = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(n_gone), pa.array(n_spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(out if digest_only else [*out, pa.array(kept, pa.binary())], names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * (not digest_only)
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.join(per, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), digest_only=True)
