"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct word shingles; two documents link when 100 * |A n B| >= 85 * |A u B|. Each set keeps its
first k shingles in one global order (k = n - ceil(0.85 n) + 1), so linked documents always retain a common value. Inverted
lists of the retained values give overlaps, the sketches of a pair bound the sets' difference from below (no link is lost
by that filter), and the exact Jaccard of the full sets confirms. Frequent values come last in the global order, so that a
passage which many documents share does not put them all into one list; any choice of them leaves the result the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, sent, steps, table, written
from tessera.llm.words import mix, shingles, words

#: Values that more distinct sets than this retain are moved to the end of the order.
FREQUENT = 32
#: As many of them at most, the most frequent first, so that their table (8 bytes each) is safe to send to every task.
MOST_FREQUENT = 500_000
#: Values are counted again until those found make up less than this share of all retained.
FREQUENT_SHARE = 0.02
#: Values from which the first, cheap round of links is made.
FIRST_VALUES = 8
#: Lists up to this length give their pairs; documents on longer ones are compared in blocks of about BLOCK.
LIST = 96
BLOCK = 512
LAST = np.int64(1) << np.int64(61)


def _keep(n: int, threshold: int) -> int:
    return n - (threshold * n + 99) // 100 + 1 if n else 0


def _order(values: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of each value in the global order, ascending: frequent values get a high bit."""
    values = values >> 1
    if len(frequent) and len(values):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        values = np.where(frequent[at] == values, values | LAST, values)
    return np.sort(values)


def sketches(docs: DataFrame, size: int = 5, threshold: int = 85, frequent=None) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (a digest of the set), sketch (the values retained)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value if frequent is not None else np.empty(0, np.int64)
        for batch in steps(batches):
            hashes, cut, _, _ = words(batch.column("text"))
            sets = shingles(hashes, cut, size)
            digests = [((int(mix(u := s.view(np.uint64)).sum()), int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum())) if len(s) else (0, 0)) for s in sets]
            rows = [_order(s, last)[: _keep(len(s), threshold)] for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else []))
            keys = np.array(digests, np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", "n", "k1", "k2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, sketch array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            hashes, cut, _, _ = words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingles(hashes, cut, size)], pa.binary())], ["doc_id", "vals"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, vals binary")


def _may_link(a: np.ndarray, b: np.ndarray, na: int, nb: int, threshold: int) -> bool:
    """False only if the sketches prove the sets too different: up to the smaller of the sketches' ends both are complete."""
    if threshold * max(na, nb) > 100 * min(na, nb):
        return False
    end = min(a[-1], b[-1])
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))
    return (100 + threshold) * differ <= (100 - threshold) * (na + nb)


def _likely(pairs: DataFrame, sk: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (batch.column(c) for c in ("sa", "sb"))
            oa, ob = (x.offsets.to_numpy() for x in (sa, sb))
            va, vb = (x.values.to_numpy() for x in (sa, sb))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = [_may_link(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], na[i], nb[i], threshold) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (sk.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    near = F.expr(f"{threshold} * greatest(na, nb) <= 100 * least(na, nb)")
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Texts travel, not sets: they are smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "ta"):
            ok = []
            sets = [shingles(*words(batch.column(c))[:2], size) for c in ("ta", "tb")]
            for u, v in zip(*sets, strict=True):
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * both >= threshold * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = docs.select("doc_id", "text").join(sent(ids), "doc_id", "left_semi")
    found = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return written(found.mapInArrow(run, "a bigint, b bigint"))


def _family_links(rows: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links between different components among documents on long lists, compared block by block on their full sets.

    rows: value, doc_id, n, comp, len. A document's family is its longest list; two documents that share a list meet in the
    task of their families' blocks, once, however many lists they share. A family is cut into blocks of about BLOCK documents
    and every two blocks meet in one task, so that no task holds a family and none is cut off. A task returns the links of
    a spanning forest, no more rows than it has documents."""
    import pandas as pd

    longest = rows.groupBy("doc_id").agg(F.max(F.struct("len", "value")).alias("m"), F.first("comp").alias("comp"))
    own = written(longest.select("doc_id", F.col("m.value").alias("fam"), "comp"))
    each = written(rows.select("doc_id", "value").join(own, "doc_id"))
    on = written(each.select("value", F.col("fam").alias("other")).distinct())
    meets = each.join(on, "value").select("doc_id", "comp", F.least("fam", "other").alias("p"), F.greatest("fam", "other").alias("q"), (F.col("fam") <= F.col("other")).alias("left")).distinct()
    meets = written(meets)
    counts = meets.groupBy("p", "q").agg(F.ceil(F.count_if("left") / BLOCK).alias("nl"), F.ceil(F.count_if(~F.col("left")) / BLOCK).alias("nr"))
    cut = meets.join(counts, ["p", "q"]).withColumn("same", F.expr("p = q"))
    cut = cut.withColumn("mine", F.expr("pmod(xxhash64(doc_id), if(left, nl, nr))")).withColumn("x", F.explode(F.expr("sequence(0, if(left and not same, nr, nl) - 1)")))
    cut = cut.withColumns({"i": F.expr("if(same, least(mine, x), if(left, mine, x))"), "j": F.expr("if(same, greatest(mine, x), if(left, x, mine))")}).withColumn("low", F.expr("if(same, mine = i, left)"))
    sets = written(_sets(docs.join(sent(own.select("doc_id")), "doc_id", "left_semi"), size), "none")
    blocks = cut.select("doc_id", "comp", "p", "q", "i", "j", "low").join(sets, "doc_id")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, comps, low = g.doc_id.to_numpy(), g.comp.to_numpy(), g.low.to_numpy()
        sets = [np.frombuffer(v, np.int64) for v in g.vals]
        sizes = np.array([len(s) for s in sets])
        rows_, cols = (np.arange(len(ids)),) * 2 if low.all() else (np.flatnonzero(low), np.flatnonzero(~low))
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(ids)), sizes)
        vocab, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # values of one document alone only count in its size
        place = np.full(len(vocab), -1)
        place[shared] = np.arange(len(shared))
        at = place[at]
        of, at = of[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        both = np.zeros((len(rows_), len(cols)), np.float32)
        for x in range(0, len(shared), 4096):
            a, b = np.searchsorted(at, [x, x + 4096])
            has = np.zeros((len(ids), 4096), np.float32)
            has[of[a:b], at[a:b] - x] = 1
            both += has[rows_] @ has[cols].T
        linked = (100 * both >= threshold * (sizes[rows_][:, None] + sizes[cols][None, :] - both)) & (comps[rows_][:, None] != comps[cols][None, :])
        root = {c: c for c in comps.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            i, j = rows_[i], cols[j]
            u, v = find(comps[i]), find(comps[j])
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return blocks.groupBy("p", "q", "i", "j").applyInPandas(run, "a bigint, b bigint")


def _with_component(ids: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return ids.withColumn("comp", F.col("doc_id"))
    return ids.join(comps.select(F.col("a").alias("doc_id"), F.col("b").alias("comp__")), "doc_id", "left").withColumn("comp", F.coalesce("comp__", "doc_id")).drop("comp__")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; doc_id is unique.

    Null or blank texts have an empty set, link with nothing and are kept. Columns other than doc_id and text are ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    all_ = written(sketches(docs, size, threshold))
    # equal sets are one class from here on; its smallest document stands for it
    classes = written(all_.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    members = written(all_.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    copies = written(members.where("doc_id != rep or n = 0").select("doc_id"))
    sk = all_.select("doc_id", "n", "sketch").join(sent(copies), "doc_id", "left_anti")
    known, share = np.empty(0, np.int64), 1.0
    while share > FREQUENT_SHARE and len(known) < MOST_FREQUENT:
        counts = sk.select(F.explode("sketch").alias("value")).groupBy("value").count()
        counts = written(counts.where(F.col("count") > FREQUENT).where(f"value < {int(LAST)}"))
        found = counts.orderBy(F.desc("count"), "value").limit(MOST_FREQUENT - len(known)).toArrow()
        if not found.num_rows:
            break
        known = np.union1d(known, found.column("value").to_numpy())
        share = found.column("count").to_numpy().sum() / sk.agg(F.sum(F.size("sketch"))).first()[0]
        last = spark.sparkContext.broadcast(known)
        sk = written(sketches(docs.join(sent(copies), "doc_id", "left_anti"), size, threshold, last).select("doc_id", "n", "sketch"))

    # first round: each document with the smallest one on the list of each of its first values
    few = sk.select("doc_id", "n", F.explode(F.slice("sketch", 1, FIRST_VALUES)).alias("value"))
    heads = few.groupBy("value").agg(F.min("doc_id").alias("b"), F.min_by("n", "doc_id").alias("nb"), F.count("*").alias("len")).where("len > 1")
    pairs = few.join(written(heads), "value").where(f"doc_id != b and {threshold} * greatest(n, nb) <= 100 * least(n, nb)").select(F.col("doc_id").alias("a"), "b").distinct()
    links = _confirmed(written(_likely(written(pairs), sk, threshold)), docs, size, threshold)
    comps = components(links)

    # second round: every retained value, where its list still spans more than one component
    rows = _with_component(sk, comps).select("doc_id", "n", "comp", F.explode("sketch").alias("value"))
    open_ = rows.groupBy("value").agg(F.count("*").alias("len"), F.min("comp").alias("lo__"), F.max("comp").alias("hi__")).where("lo__ != hi__").select("value", "len")
    rows = written(rows.join(sent(written(open_)), "value"))
    short = rows.where(f"len <= {LIST}")
    left, right = short.select("value", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca")), short.select("value", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = left.join(right, "value").where(f"a > b and ca != cb and {threshold} * greatest(na, nb) <= 100 * least(na, nb)").select("a", "b").distinct()
    pairs = written(_likely(pairs, sk, threshold))
    long_ = rows.where(f"len > {LIST}")
    more = _confirmed(pairs, docs, size, threshold)
    if long_.limit(1).count():
        more = more.union(written(_family_links(long_, docs, size, threshold)))
    comps = components(comps.select("a", "b").union(more))
    out = members.join(comps.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)
