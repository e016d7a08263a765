"""Token-ID output as a content-addressed store.

Every document's ids (and an end id) are cut into chunks where a rolling hash of the last ids says so, so equal passages
give equal chunks; each distinct chunk is stored once under its digest. A recipe lists a document's digests and carries
the Merkle root over them; recipes lie in ascending doc_id order, and manifest rows carry the Merkle root of each run of
recipes. Reading back recomputes each stored chunk's digest, each document's root and each run's; a chunk, a recipe or a
run that is lost, altered or moved raises.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as _chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, drop, running_totals, sent, steps, table, written
from tessera.llm.words import SPACE, Known, mix, powers

END = 0
#: The rolling hash looks at WINDOW ids; a chunk has 2**BITS ids in the mean, LEAST at least (but the last), MOST at most.
WINDOW, BITS, LEAST, MOST = 8, 9, 16, 4096
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Pieces that the library gets in one string, and strings in one call.
CHAIN, CALL = 500, 200
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?%$&*#")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_encoders: dict[str, "_Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """The tokenizers library over distinct pieces of text. Byte-level BPE splits text before every space that stands between
    two characters that are not white space, so a text's ids are its pieces' ids in turn; a piece is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.sizes[i] = len(piece)
        if len(self.sizes) > 1 << 16:
            raise ValueError(f"ids are stored in 16 bits; {path} has ids up to {len(self.sizes) - 1}")
        self.known = Known()
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.ids, self.ends = [np.empty(0, np.uint16)], [np.zeros(1, np.int64)]

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of pieces, and whether a piece begins with a lone space and may stand in a row of such pieces."""
        n = len(data)
        plain = ~SPACE[data] & (data != 127) & (data > 32)
        lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # of characters some of which are white space
        before = np.zeros(n, bool)
        before[1:] = plain[:-1]
        before[2:] &= ~(data[:-2] == 0xC2)
        before[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
        after = np.zeros(n, bool)
        after[:-1] = plain[1:] & ~lead[1:]
        between = before & after
        firsts = off[:-1][np.diff(off) > 0]
        between[firsts] = False
        between[firsts[1:] - 1] = False  # white space at a document's end
        lone = (data == 32) & between
        line = (data == 10) & between
        mark = np.zeros(n, bool)  # a mark right after a letter; no apostrophes (contractions), none of the special token
        mark[1:] = _MARK[data[1:]] & _LETTER[data[:-1]]
        cut = lone | line | mark
        cut[1:] |= line[:-1]
        cut[firsts] = True
        lone[firsts] = False
        starts = np.flatnonzero(cut)
        return starts, lone[starts]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after another, and where each one's begin; END closes each."""
        data, off = bytes_of(column)
        docs = len(off) - 1
        if not len(data):
            return np.full(docs, END, np.uint16), np.arange(docs + 1)
        starts, regular = self._pieces(data, off)
        lengths = np.diff(np.append(starts, len(data)))
        inside = np.arange(len(data)) - np.repeat(starts, lengths)
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[inside]
        hashes = mix(np.add.reduceat(terms, starts))
        distinct, at, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.clear()
        rows = self.known.find(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn(data, starts[at[new]], lengths[at[new]], regular[at[new]], off)
            self.known.add(distinct[new], rows[new])
        rows = rows[where]
        if len(self.ids) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        ids, ends = self.ids[0], self.ends[0]
        begin, count = ends[rows], ends[rows + 1] - ends[rows]
        per_doc = np.add.reduceat(np.append(count, 0), np.minimum(cut := np.searchsorted(starts, off[:-1]), len(starts))) * (np.diff(off) > 0)
        out_off = np.concatenate([[0], np.cumsum(per_doc + 1)])
        total = int(count.sum())
        flat = ids[np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)]
        out = np.full(out_off[-1], END, np.uint16)
        keep = np.ones(len(out), bool)
        keep[out_off[1:] - 1] = False
        out[keep] = flat
        return out, out_off

    def _learn(self, data, begins, lengths, regular, off) -> np.ndarray:
        """Encodes the pieces and returns their rows."""
        raw, stops = data.tobytes(), begins + lengths
        chained = regular & ~np.isin(stops, off[1:])  # pieces at a document's end may close with white space
        chain, alone = np.flatnonzero(chained), np.flatnonzero(~chained)
        parts = [chain[at : at + CHAIN] for at in range(0, len(chain), CHAIN)]
        texts = [b"".join(raw[b:e] for b, e in zip(begins[k].tolist(), stops[k].tolist(), strict=True)).decode() for k in parts]
        texts += [raw[b:e].decode() for b, e in zip(begins[alone].tolist(), stops[alone].tolist(), strict=True)]
        codes = [c.ids for i in range(0, len(texts), CALL) for c in self.library.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)]
        counts = []
        for k, code in zip(parts, codes, strict=False):
            # of pieces in a row, each has the ids that its bytes take
            last = np.searchsorted(np.cumsum(self.sizes[code]), np.cumsum(lengths[k])) + 1
            assert len(code) == last[-1]
            counts.append(np.diff(last, prepend=0))
        counts.append(np.array([len(c) for c in codes[len(parts) :]], np.int64))
        ids = np.fromiter(_chain.from_iterable(codes), np.uint16)
        rows = np.empty(len(begins), np.int64)
        rows[np.concatenate([chain, alone])] = sum(map(len, self.ends)) - 1 + np.arange(len(begins))
        self.ends.append(sum(map(len, self.ids)) + np.cumsum(np.concatenate(counts)))
        self.ids.append(ids)
        return rows


def _cuts(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of chunks: where the rolling hash's top bits are zero, at each document's end, and every MOST ids."""
    gear, rolled = mix(ids.astype(np.uint64) + np.uint64(1)), np.zeros(len(ids), np.uint64)
    for j in range(min(WINDOW, len(ids))):
        rolled[j:] += gear[: len(ids) - j] << np.uint64(j)
    cut = (mix(rolled) >> np.uint64(64 - BITS)) == 0
    inside = np.arange(len(ids)) - np.repeat(off[:-1], np.diff(off))
    cut &= inside >= LEAST
    cut[off[1:] - 1] = True
    ends = np.flatnonzero(cut) + 1
    sizes = np.diff(ends, prepend=0)
    if (sizes > MOST).any():
        more = [np.arange(e - s + MOST, e, MOST) for e, s in zip(ends[sizes > MOST], sizes[sizes > MOST], strict=True)]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """The root over digests in order; an odd one rises unpaired."""
    level = digests or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """uid (of the row), doc_id, n_tokens, root, addresses, chunks (ids as little-endian unsigned 16-bit) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        encoder, uid = _encoders[path], TaskContext.get().partitionId() << 40
        for batch in steps(batches, limit=2 << 20):
            ids, off = encoder.encode(batch.column("text"))
            ends = _cuts(ids, off)
            raw, at = ids.astype("<u2").tobytes(), np.concatenate([[0], ends]) * 2
            chunks = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            names = [address(c) for c in chunks]
            lists = pa.array(np.searchsorted(ends, off, "right"), pa.int32())
            cut = lists.to_pylist()
            roots = [merkle(names[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            uids = np.arange(uid, uid + batch.num_rows)
            uid += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(uids), batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(lists, pa.array(names, pa.binary())), pa.ListArray.from_arrays(lists, pa.array(chunks, pa.binary()))], ["uid", "doc_id", "n_tokens", "root", "addresses", "chunks"])

    return docs.select("doc_id", "text").mapInArrow(run, "uid bigint, doc_id bigint, n_tokens bigint, root binary, addresses array<binary>, chunks array<binary>")


@dataclass
class Store:
    chunks: DataFrame  # address, ids (binary): one row for each distinct chunk
    recipes: DataFrame  # run, doc_id, start, n_tokens, root, addresses: ascending doc_id
    manifest: DataFrame  # run, start, docs, tokens, root, runs (how many there are): one row for each run of recipes


#: Recipes of a run at most.
RUN = 10_000


def _recipe_digest(doc_id: int | None, start: int, n_tokens: int, root: bytes) -> bytes:
    return hashlib.blake2b(repr((doc_id, start, n_tokens)).encode() + root, digest_size=16).digest()


def _with_runs(recipes: DataFrame) -> DataFrame:
    """Recipes in ascending order of start, dealt by ranges of it, with run: RUN rows that follow each other at most have one number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, first = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(done, done + b.num_rows) // RUN), *b.columns], ["run", *b.schema.names])
            done += b.num_rows

    # a task that reads several files would hold stretches of recipes in any order
    return recipes.repartitionByRange("start").sortWithinPartitions("start").mapInArrow(number, "run bigint, doc_id bigint, start bigint, n_tokens bigint, root binary, addresses array<binary>")


def _runs(recipes: DataFrame) -> DataFrame:
    """run, start, docs, tokens, root of each run, from its recipes; a gap or an overlap inside a run raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for run, rows in zip(b.column("run").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rows = [(r["doc_id"], r["start"], r["n_tokens"], r["root"]) for r in rows]
                if any(x[1] + x[2] != y[1] for x, y in zip(rows, rows[1:])):
                    raise ValueError(f"the recipes of run {run} do not follow each other")
                out.append((run, rows[0][1], len(rows), sum(r[2] for r in rows), merkle([_recipe_digest(*r) for r in rows])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["run", "start", "docs", "tokens", "root"])

    # a group is a run: RUN rows of some 50 bytes at most
    rows = recipes.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("start", "doc_id", "n_tokens", "root"))).alias("rows"))
    return rows.mapInArrow(read, "run bigint, start bigint, docs bigint, tokens bigint, root binary")


def check_manifest(store: Store) -> None:
    """Raises if a run of recipes is not what the manifest says, or if runs do not follow each other from 0 on."""
    kept, found = store.manifest, _runs(store.recipes)
    both = kept.join(found.select("run", *[F.col(c).alias(f"{c}__") for c in ("start", "docs", "tokens", "root")]), "run", "full")
    off = both.where(" or ".join(f"not ({c} <=> {c}__)" for c in ("start", "docs", "tokens", "root"))).select("run").limit(1).collect()
    if off:
        raise ValueError(f"run {off[0].run} of recipes does not fit its root and counts in the manifest")
    ends = kept.select((F.col("start") + F.col("tokens")).alias("start"))
    lost = ends.join(kept.select("start"), "start", "left_anti").limit(2).count(), kept.where("start = 0").limit(2).count()
    many = kept.agg(F.count("*").alias("n"), F.min("runs").alias("lo"), F.max("runs").alias("hi")).first()
    if many.n and (lost != (1, 1) or many.lo != many.n or many.hi != many.n):
        raise ValueError("runs of the manifest do not follow each other")


def write_store(docs: DataFrame, path: str | None = None) -> Store:
    """Encodes whole texts (null: empty), stores distinct chunks once, and writes recipes and manifest.

    A null doc_id comes first; rows that repeat a doc_id each have a recipe, in any order among them. Other columns are ignored."""
    all_ = written(encoded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path or tokenizer_path()))
    each = all_.select("uid", F.posexplode("addresses").alias("seq", "address"))
    # every holder of a repeated chunk but its first, found on digests alone
    repeated = each.groupBy("address").agg(F.count("*").alias("c"), F.min(F.struct("uid", "seq")).alias("owner")).where("c > 1").select("address", "owner")
    repeated = written(repeated)  # a table of its own: the join may be split where one chunk is very common
    extra = written(each.join(repeated, "address").where("struct(uid, seq) != owner").select("uid", "seq"))
    chunks = all_.select("uid", F.posexplode(F.arrays_zip("addresses", "chunks")).alias("seq", "x")).select("uid", "seq", F.col("x.addresses").alias("address"), F.col("x.chunks").alias("ids"))
    chunks = written(chunks.join(sent(extra), ["uid", "seq"], "left_anti").select("address", "ids"))
    drop(repeated, extra)
    recipes = running_totals(all_.select("doc_id", "n_tokens", "root", "addresses"), "doc_id", "n_tokens", "start").select("doc_id", "start", "n_tokens", "root", "addresses")
    recipes = written(_with_runs(recipes))
    drop(all_)
    runs = written(_runs(recipes))
    return Store(chunks, recipes, written(runs.withColumn("runs", F.lit(runs.count()))))


def read_ids(store: Store) -> DataFrame:
    """doc_id, ids array<int>: documents put together again from recipes and chunks. A chunk that is not there raises."""
    parts = store.recipes.select("doc_id", "start", F.posexplode("addresses").alias("seq", "address")).join(store.chunks, "address", "left")
    parts = parts.withColumn("ids", F.coalesce("ids", F.raise_error(F.lit("a recipe names a chunk that is not stored")).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [np.frombuffer(b"".join(x["ids"] for x in sorted(p, key=lambda x: x["seq"])), "<u2").astype(np.int32) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(docs, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("seq", "ids")).alias("parts")).mapInArrow(run, "doc_id bigint, ids array<int>")


def _shift_tables(bits: int = 40) -> np.ndarray:
    """For each b, byte-indexed tables of the map that appending 2**b zero bytes makes of a CRC-32."""
    step = np.array([(c >> 8) ^ zlib_table[c & 255] for c in (1 << j for j in range(32))], np.uint32)
    out = np.zeros((bits, 4, 256), np.uint32)
    for b in range(bits):
        for byte in range(4):
            for j in range(8):
                on = (np.arange(256) >> j) & 1 == 1
                out[b, byte, on] ^= step[8 * byte + j]
        step = _apply(out[b], step)
    return out


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]


def _zero_byte_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


zlib_table = _zero_byte_table()
_shifts: list[np.ndarray] = []


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """CRC-32 of each row's parts one after another, from the parts' CRCs and sizes in bytes. cut: where rows begin."""
    if not _shifts:
        _shifts.append(_shift_tables())
    counts = np.diff(cut)
    out = np.zeros(len(counts), np.uint32)
    for k in range(int(counts.max(initial=0))):
        rows = np.flatnonzero(counts > k)
        at = cut[rows] + k
        c, n = out[rows], sizes[at]
        for b in range(int(n.max()).bit_length()):
            on = (n >> b) & 1 == 1
            c[on] = _apply(_shifts[0][b], c[on])
        out[rows] = c ^ crcs[at]
    return out


def verified(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: each stored chunk is read, its digest recomputed and its ids' CRC-32
    taken; a document's CRC-32 follows from its chunks'. A chunk, recipe or run that is lost or does not fit raises."""
    check_manifest(store)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, raws = b.column("address").to_pylist(), b.column("ids").to_pylist()
            if any(address(r) != a for a, r in zip(names, raws, strict=True)):
                raise ValueError("a stored chunk does not have the digest it is stored under")
            crcs = [zlib.crc32(np.frombuffer(r, "<u2").astype("<u4").tobytes()) for r in raws]
            yield pa.RecordBatch.from_arrays([b.column("address"), pa.array(crcs, pa.int64()), pa.array([len(r) // 2 for r in raws], pa.int64())], ["address", "crc", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("parts")
            flat, cut = parts.flatten(), parts.offsets.to_numpy()
            cut = cut - cut[0]
            if flat.field("crc").null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            crcs, n, names = flat.field("crc").to_numpy().astype(np.uint32), flat.field("n").to_numpy(), flat.field("address").to_pylist()
            if [merkle(names[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)] != b.column("root").to_pylist():
                raise ValueError("a recipe's chunks do not have its root")
            if (np.add.reduceat(n, cut[:-1]) != b.column("n_tokens").to_numpy()).any():
                raise ValueError("a recipe's chunks do not have its number of ids")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(joined_crc(crcs, n * 4, cut).astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    sums = store.chunks.mapInArrow(check, "address binary, crc bigint, n bigint")
    # a document's first place names it: each has one id at least
    parts = store.recipes.select("start", F.posexplode("addresses").alias("seq", "address")).join(sums, "address", "left")
    parts = parts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "crc", "n"))).alias("parts"))
    whole = store.recipes.select("doc_id", "start", "n_tokens", "root").join(parts, "start").select("doc_id", "start", "n_tokens", "root", "parts")
    return whole.mapInArrow(join, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(write_store(table(spark, sf_dir, "documents")))
