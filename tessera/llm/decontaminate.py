"""Benchmark decontamination by greedy string tiling.

Seeds (hashes of MATCH words in a row, rolling over the words) of the benchmark's items are joined with every document's
seeds; where an item's shared seeds could cover enough of it, the longest matches that do not overlap earlier ones are
marked again and again. A document is contaminated by an item of whose words the marked ones are at least THRESHOLD,
in whatever order the passages stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import steps, table, written
from tessera.llm.words import SPACE, mix, words

MATCH = 5
THRESHOLD = 0.8
#: Benchmark words up to which its seeds are sent to every task (about 40 bytes each); of a larger benchmark they are shuffled.
PASS_WORDS = 500_000
#: Words are what stands between white space, punctuation and control characters; A-Z count as a-z.
SEPARATOR = SPACE.copy()
SEPARATOR[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BASE = np.uint64(0xD6E8FEB86659FD93)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of every `size` words in a row."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + hashes[i : i + n]
    return mix(out)


def tile(item: np.ndarray, text: np.ndarray, size: int = MATCH) -> np.ndarray:
    """Greedy string tiling of two word sequences: which of the item's words are covered by matches of at least `size`
    words (the whole item, if shorter) that do not overlap in either; longest first, then the earliest in item and text."""
    size = min(size, len(item))
    marked, used = np.zeros(len(item), bool), np.zeros(len(text), bool)
    if not size or len(text) < size:
        return marked
    a, b = rolling(item, size), rolling(text, size)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(b)), n)
    i = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.empty(0, np.int64)
    if not len(i):
        return marked
    # seeds in a row on one diagonal are one match
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.ones(len(i), bool)
    first[1:] = (np.diff(i) != 1) | (np.diff(j - i) != 0)
    at = np.flatnonzero(first)
    heap = [(-(int(m) + size - 1), int(i[k]), int(j[k])) for k, m in zip(at, np.diff(np.append(at, len(i))), strict=True)]
    heapq.heapify(heap)
    while heap and not marked.all():
        m, x, y = heapq.heappop(heap)
        m = -m
        free = ~(marked[x : x + m] | used[y : y + m])
        if free.all():
            marked[x : x + m] = used[y : y + m] = True
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= size:
                heapq.heappush(heap, (s - e, x + s, y + s))
    return marked


def _index(items: list[np.ndarray]) -> dict[int, tuple]:
    """By seed length (shorter items have their own): sorted seeds, where their postings begin, postings' item and place."""
    out = {}
    for size in {min(MATCH, len(w)) for w in items if len(w)}:
        own = [k for k, w in enumerate(items) if min(MATCH, len(w)) == size]
        seeds = [rolling(items[k], size) for k in own]
        flat = np.concatenate(seeds)
        of, place = np.repeat(own, [len(s) for s in seeds]), np.concatenate([np.arange(len(s)) for s in seeds])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        out[size] = (keys, np.append(first, len(flat)), of[order], place[order], maybe)
    return out


def _found(docs: DataFrame, part: list[tuple[int, str]], threshold: float) -> DataFrame:
    """doc_id, item_id, coverage of every pair that reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(part)
    ready: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            hashes, cut, _, _ = words(pa.array([t or "" for _, t in sent.value], pa.string()), space=SEPARATOR)
            own = [hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            ready.extend([own, _index(own)])
        items, index = ready
        sizes = np.array([len(w) for w in items])
        for batch in steps(batches):
            hashes, cut, _, _ = words(batch.column("text"), space=SEPARATOR)
            out = []
            for size, (keys, first, of, place, maybe) in index.items():
                seeds = rolling(hashes, size)
                at = np.flatnonzero(maybe[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)])
                k = np.minimum(np.searchsorted(keys, seeds[at]), len(keys) - 1)
                ok = keys[k] == seeds[at]
                at, k = at[ok], k[ok]
                doc = np.searchsorted(cut, at, "right") - 1
                ok = at + size <= cut[doc + 1]  # within one document
                pairs = np.unique(doc[ok] * len(keys) + k[ok])  # a document's seed counts once
                doc, k = pairs // len(keys), pairs % len(keys)
                n = first[k + 1] - first[k]
                post = np.repeat(first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
                both = np.repeat(doc, n) * len(items) + of[post]
                by = np.argsort(both, kind="stable")
                both, begin, many = np.unique(both[by], return_index=True, return_counts=True)
                could = many * size >= threshold * sizes[both % len(items)]
                for p in np.flatnonzero(could).tolist():
                    d, item = divmod(int(both[p]), len(items))
                    edge = np.zeros(sizes[item] + 1, np.int64)
                    starts = place[post[by[begin[p] : begin[p] + many[p]]]]  # of the seeds that this document and this item share
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + size, -1)
                    if np.count_nonzero(np.cumsum(edge)) >= threshold * sizes[item]:
                        share = float(tile(items[item], hashes[cut[d] : cut[d + 1]], size).mean())
                        if share >= threshold:
                            out.append((d, item, share))
            if out:
                d, item, share = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([sent.value[i][0] for i in item], pa.int64()), pa.array(share)], ["doc_id", "item_id", "coverage"])

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint, coverage double")


def _seeds(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, words, size, seed: every seed of each row's text, once for each of the seed lengths (an item has its own alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashes, cut, _, _ = words(batch.column("text"), space=SEPARATOR)
            n = np.diff(cut)
            for size in sizes or range(1, MATCH + 1):
                seeds, at = rolling(hashes, size), np.arange(max(0, len(hashes) - size + 1))
                row = np.searchsorted(cut, at, "right") - 1
                ok = at + size <= cut[row + 1] if len(at) else np.zeros(0, bool)
                if not sizes:
                    ok &= np.minimum(n[row], MATCH) == size
                row, seeds = row[ok], seeds[ok]
                if sizes:  # a document's seed counts once
                    first = np.unique(np.stack([row.astype(np.uint64), seeds]), axis=1, return_index=True)[1] if len(row) else []
                    row, seeds = row[first], seeds[first]
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(n[row], pa.int64()), pa.array(np.full(len(row), size, np.int32)), pa.array(seeds.view(np.int64))], [key, "words", "size", "seed"])

    return rows.select(key, "text").mapInArrow(run, f"{key} bigint, words bigint, size int, seed bigint")


def _found_by_shuffle(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: seeds meet by a join, documents are read once for seeds and once for the pairs left.

    A document that an item contaminates shares at least `need` of its seeds, so it shares one of all but the need - 1 most
    frequent: only those are joined, and a passage that is everywhere brings no pairs. Tiling decides."""
    items = written(items.distinct().withColumn("item", F.monotonically_increasing_id()))
    own = written(_seeds(items, "item", []))
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # MATCH values at most
    docs = docs.withColumn("k", F.xxhash64("doc_id", "text"))  # equal rows share one, and others may: pairs are tiled
    keys = written(own.select("size", "seed").distinct())
    hits = written(_seeds(docs, "k", sizes).select("k", "size", "seed").join(keys, ["size", "seed"], "left_semi")) if sizes else None
    if hits is None:
        return docs.select("doc_id", F.lit(None).cast("bigint").alias("item_id"), F.lit(0.0).alias("coverage")).limit(0)
    often = written(hits.groupBy("size", "seed").agg(F.count("*").alias("n")))
    line = Window.partitionBy("item").orderBy("n", "seed")
    need = F.ceil(F.lit(threshold) * F.col("words") / F.col("size"))
    rare = own.join(often, ["size", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("at", F.row_number().over(line))
    rare = written(rare.where(F.col("at") <= F.col("words") - F.col("size") + 2 - need).where("n > 0").select("item", "size", "seed").distinct())
    pairs = written(hits.join(rare, ["size", "seed"]).select("k", "item").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sides = [words(batch.column(c), space=SEPARATOR)[:2] for c in ("benchmark__", "text")]
            share = []
            for i in range(batch.num_rows):
                a, b = (h[cut[i] : cut[i + 1]] for h, cut in sides)
                share.append(float(tile(a, b).mean()))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(share, pa.float64())], ["doc_id", "item_id", "coverage"])
            yield out.filter(pa.array(np.array(share) >= threshold))

    both = docs.join(pairs, "k").join(items.withColumnRenamed("text", "benchmark__"), "item")
    return both.select("doc_id", "text", "item_id", "benchmark__").mapInArrow(run, "doc_id bigint, item_id bigint, coverage double")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, coverage of every document and benchmark item (item_id, text) that it holds.

    Null, blank and wordless texts hold nothing and are held by nothing. An item shorter than MATCH words must stand in the document
    as a whole: an item of one word is held by every document with that word. Rows that repeat a doc_id or an item_id are each
    compared; equal benchmark rows count once. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    if total > PASS_WORDS:
        return written(_found_by_shuffle(docs, items, threshold))
    part = items.distinct().orderBy("item_id", "text").toArrow()  # PASS_WORDS words at most
    return written(_found(docs, list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)), threshold))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item, with their columns. If one of several rows of a doc_id holds one, all of them go;
    rows without a doc_id stay."""
    return docs.join(leaks(docs, benchmark, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, items (ids of the benchmark items held), coverage (the largest; 0 without any) for every document.

    Rows that repeat a doc_id are judged together; rows without one are not contaminated."""
    docs = table(spark, sf_dir, "documents")
    per = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
