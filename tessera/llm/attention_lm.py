"""Language-model scoring: a causal self-attention model over subword ids, trained and run in numpy inside Spark tasks.

Texts become rows of whole slices: the ids of some documents one after another. A token's window is its own block and
the block before, so windows overlap and each token is scored once, from its document's last BLOCK to 2 * BLOCK ids.
Output is a softmax over classes of ids and one over a class's ids. Training is local: in every round tasks start from
the same parameters, train on their own share of documents, and the parameters are averaged. Every id of every training
document trains the network.

Word counts, for the base, are summed over all training documents and sent back to the slices, both by shuffles.
"""

from __future__ import annotations

import base64
import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bytes_of, crc_of, drop, steps, table, written
from tessera.llm.words import LOWER, mix, powers, words

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Text bytes of a slice; a longer document is a slice of its own.
SLICE = 4 << 20
BLOCK, HEADS, WIDTH, HIDDEN = 8, 1, 32, 32
#: Rounds, tokens that a task trains on at least in a round (fewer are seen again), blocks of a step, first step size.
ROUNDS, TASK_TOKENS, STEP_BLOCKS, RATE = 4, 600_000, 128, 0.02
#: A task gets up to LONGER times as many tokens, and its steps as many times the blocks, before there is a second one; beyond TASKS
#: tasks a round they get longer still, so that what is averaged does not grow with the input.
LONGER, TASKS = 4, 24
#: Entries of the word table that one group of words may hold on average.
GROUP = 1 << 21
#: Bytes of parameters in one row of the averaging.
PIECE = 1 << 16
#: Blocks whose states one step of scoring works out (few, so that they stay in a core's cache), and steps whose outputs are scored together.
RUN, TOGETHER = 256, 8
#: Slices of a file; bytes of rows that Spark hands to Python at once, about (a longer row is handed over alone).
FILE_SLICES, BATCH, _BATCH = 4, 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_OFF = np.float32(-1e9)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, whether an id's bytes begin a word (END does too), and END: the first free id."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    end = max(ranks.values()) + 1
    begins = np.zeros(end + 1, bool)
    begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    begins[end] = True
    # words are cut every 32 characters, so that one endless word costs no more than many short ones
    return tiktoken.Encoding("words", pat_str=r" ?[^ \t\n\x0b\x0c\r]{1,32}", mergeable_ranks=ranks, special_tokens={}), begins, end


def ids_of(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of lower-cased texts, END after each, and how many each text has. Distinct words of the slice are encoded once."""
    library, begins, end = _tokenizer(path)
    hashes, cut, starts, ends = words(column)
    docs = len(cut) - 1
    if not len(hashes):
        return np.full(docs, end, np.uint16), np.ones(docs, np.int64)
    raw = LOWER[bytes_of(column)[0]].tobytes()
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    text = b" " + b" ".join([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    flat = library.encode_to_numpy(text.decode(), disallowed_special=())
    begin = np.flatnonzero(begins[flat])
    lengths = np.diff(np.append(begin, len(flat)))[of]
    at = np.concatenate([[0], np.cumsum(lengths)])
    per = at[cut[1:]] - at[cut[:-1]] + 1
    out = np.full(at[-1] + docs, end, np.uint16)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    place = np.repeat(at[:-1] + np.repeat(np.arange(docs), np.diff(cut)), lengths) + inside
    out[place] = flat[np.repeat(begin[of], lengths) + inside]
    return out, per


def encoded(docs: DataFrame, learn: Column, id: str, path: str) -> DataFrame:
    """Slices: slice, ids of documents, whether the model may learn from each, how many subword ids each has, all those ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 32

        def one(docs: list, learn: list, per: list, ids: list) -> pa.RecordBatch:
            lists = [pa.array([docs], pa.list_(pa.int64())), pa.array([learn], pa.list_(pa.bool_())), pa.array([per], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), *lists, pa.array([b"".join(ids)], pa.binary())], ["slice", "docs", "learn", "per", "ids"])

        docs, learn, per, ids, held = [], [], [], [], 0
        for batch in steps(batches, limit=SLICE // 2):
            size = len(bytes_of(batch.column("text"))[0])
            if docs and held + size > SLICE:
                yield one(docs, learn, per, ids)
                docs, learn, per, ids, held = [], [], [], [], 0
                no += 1
            own, each = ids_of(batch.column("text"), path)
            docs, learn, per, held = docs + batch.column("id").to_pylist(), learn + batch.column("learn").to_pylist(), per + each.tolist(), held + size
            ids.append(own.astype("<u2").tobytes())
        if docs:
            yield one(docs, learn, per, ids)

    rows = docs.select(F.col(id).cast("bigint").alias("id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, "slice bigint, docs array<bigint>, learn array<boolean>, per array<int>, ids binary")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("slice")[i].as_py(), batch.column("docs")[i].as_py(), np.array(batch.column("learn")[i].as_py(), bool), np.array(batch.column("per")[i].as_py(), np.int64), np.frombuffer(batch.column("ids")[i].as_buffer(), "<u2")


def word_hashes(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (and ENDs) begin, and the hash of the ids of each."""
    at = np.flatnonzero(begins[ids])
    inside = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
    terms = (ids.astype(np.uint64) + np.uint64(1)) * powers(int(inside.max()) + 1)[inside]
    return at, mix(np.add.reduceat(terms, at))


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark hands rows to Python BATCH bytes at a time: the 64 MB of its setting are held several times over, outside the heap of the JVM and in Python, by every task."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


# ---- base: counts of words ----


def counted(slices: DataFrame, path: str, bits: int) -> DataFrame:
    """slice, part, counts: how often the slice's distinct words, in order of hash, occur in all training documents; part
    is the first `bits` bits of a hash. Rows of slice -1 have the number of distinct training words instead.

    A group holds one entry of 12 bytes for each word of its part in each slice, GROUP on average."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = _tokenizer(path)[1]
        for no, _, learn, per, ids in _slices(batches):
            at, hashes = word_hashes(ids, begins)
            taken = np.repeat(learn, per)[at]
            own, of = np.unique(hashes, return_inverse=True)
            n = np.bincount(of, taken, len(own)).astype("<u4")
            part = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            parts, first = np.unique(part, return_index=True)
            cuts = [*first.tolist(), len(own)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(parts, pa.int64()), "slice": pa.array([no] * len(parts), pa.int64()),
                "hashes": pa.array([own[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                "n": pa.array([n[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            })

    def back(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, "<u8") for h in rows.column("hashes").to_pylist()]
        own, of = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(of, np.concatenate([np.frombuffer(n, "<u4") for n in rows.column("n").to_pylist()]), len(own)).astype("<i8")
        cuts = np.cumsum([0, *map(len, hashes)]).tolist()
        counts = [total[of[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        known = np.array([np.count_nonzero(total)], "<i8").tobytes()
        part = rows.column("part")[0].as_py()
        return pa.table({"slice": pa.array([*rows.column("slice").to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(hashes) + 1), pa.int64()), "counts": pa.array([*counts, known], pa.binary())})

    return slices.mapInArrow(out, "part bigint, slice bigint, hashes binary, n binary").groupBy("part").applyInArrow(back, "slice bigint, part bigint, counts binary")


# ---- the network ----


def new_model(seen: np.ndarray, counts: np.ndarray, ids: int, seed: int = 11) -> dict:
    """Untrained parameters for the ids `seen` (END apart, ordered by their bytes) with their counts; `ids` is the vocabulary's size with END.

    Row 0 is END and the beginning, the last row stands for all ids never seen, each as likely as the others."""
    size = len(seen) + 2
    classes = int(np.ceil(np.sqrt(size)))
    members = -(-size // classes)
    rng = np.random.default_rng(seed)
    row = np.full(ids, size - 1, np.int32)
    row[seen], row[ids - 1] = np.arange(1, size - 1), 0
    c = np.full(classes * members, 1e-9)
    c[:size] = counts + 0.5
    c = c.reshape(classes, members)

    def normal(*shape, scale=1.0):
        return (rng.standard_normal(shape) * scale / np.sqrt(WIDTH)).astype(np.float32)

    weights = {
        "embed": normal(size, WIDTH, scale=2.0), "near": np.tile(-0.1 * np.arange(2 * BLOCK, dtype=np.float32), (HEADS, 1)) * np.array([[1.0], [4.0]], np.float32)[:HEADS],
        "query": normal(WIDTH, WIDTH), "key": normal(WIDTH, WIDTH), "value": normal(WIDTH, WIDTH), "mixed": normal(WIDTH, WIDTH),
        "up": normal(WIDTH, HIDDEN), "up_bias": np.zeros(HIDDEN, np.float32), "down": normal(HIDDEN, WIDTH, scale=0.7), "down_bias": np.zeros(WIDTH, np.float32),
        "class": normal(WIDTH, classes, scale=0.3), "class_bias": np.log(c.sum(axis=1)).astype(np.float32) - np.float32(np.log(c.sum())),
        "member": normal(classes, members, WIDTH, scale=0.3), "member_bias": (np.log(c) - np.log(c.sum(axis=1, keepdims=True))).astype(np.float32),
    }
    return {"weights": weights, "row": row, "members": members, "unseen": max(1, ids - 1 - len(seen))}


def blocks(rows: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of `per` rows each, in whole blocks: inputs, targets, whether a place is real, whether a block begins a document."""
    count = -(-per // BLOCK)
    begin = np.concatenate([[0], np.cumsum(count)])
    offsets = np.concatenate([[0], np.cumsum(per)])
    place = np.repeat(begin[:-1] * BLOCK - offsets[:-1], per) + np.arange(len(rows))
    y, x, real = np.zeros(begin[-1] * BLOCK, np.int32), np.zeros(begin[-1] * BLOCK, np.int32), np.zeros(begin[-1] * BLOCK, bool)
    x[place], real[place] = rows, True
    y[1:] = x[:-1]
    y[begin[:-1] * BLOCK] = 0
    first = np.zeros(begin[-1], bool)
    first[begin[:-1]] = True
    return y.reshape(-1, BLOCK), x.reshape(-1, BLOCK), real.reshape(-1, BLOCK), first


#: From each place of a block to each of its window: how far back, and what lies ahead.
_BACK = np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)
_AHEAD = _BACK < 0


def _by_head(x: np.ndarray) -> np.ndarray:
    return x.reshape(*x.shape[:2], HEADS, WIDTH // HEADS).transpose(0, 2, 1, 3)


def _flat(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.transpose(0, 2, 1, 3)).reshape(x.shape[0], x.shape[2], WIDTH)


def _window(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.concatenate([np.zeros_like(x[:1]), x[:-1]]), x], axis=1)


def gradients(w: dict, members: int, y: np.ndarray, x: np.ndarray, real: np.ndarray, first: np.ndarray) -> tuple[float, dict]:
    """Mean loss (natural log) of some consecutive blocks, and its gradient by each parameter."""
    n, scale = max(1, int(real.sum())), np.float32(1 / np.sqrt(WIDTH // HEADS))
    first = first.copy()
    first[0] = True
    e = w["embed"][y]
    into = np.concatenate([w["query"], w["key"], w["value"]], axis=1)
    lines = lambda z: z.reshape(-1, z.shape[-1])
    q, k, v = np.split((lines(e) @ into).reshape(*e.shape[:2], -1), 3, axis=2)
    qh, kh, vh = _by_head(q), _by_head(_window(k)), _by_head(_window(v))
    a = qh @ kh.transpose(0, 1, 3, 2)
    a *= scale
    a += np.where(_AHEAD, _OFF, w["near"][:, np.maximum(_BACK, 0)])
    a[first, :, :, :BLOCK] = _OFF
    a -= a.max(axis=3, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=3, keepdims=True)
    o = _flat(a @ vh)
    u = lines(e) + lines(o) @ w["mixed"]
    r = u @ w["up"]
    r += w["up_bias"]
    np.maximum(r, 0, out=r)
    # by class from here on, so that the places of a class are a slice
    order = np.argsort((x.ravel() // members).astype(np.uint16), kind="stable")
    h = u + r @ w["down"] + w["down_bias"]
    h, t, weight = h[order], x.ravel()[order], (real.ravel() / np.float32(n)).astype(np.float32)[order]
    c, m, at = t // members, t % members, np.arange(len(t))
    g, loss = {}, 0.0

    def softmax(l, chosen, weight):
        """Loss of rows of logits; these become the gradient by them."""
        l -= l.max(axis=1, keepdims=True)
        rows = at[: len(l)]
        picked = l[rows, chosen]
        np.exp(l, out=l)
        total = l.sum(axis=1)
        l *= (weight / total)[:, None]
        l[rows, chosen] -= weight
        return -float(((picked - np.log(total)) * weight).sum())

    p = h @ w["class"]
    p += w["class_bias"]
    loss += softmax(p, c, weight)
    g["class"], g["class_bias"], dh = h.T @ p, p.sum(axis=0), p @ w["class"].T
    g["member"], g["member_bias"] = np.zeros_like(w["member"]), np.zeros_like(w["member_bias"])
    cut = np.searchsorted(c, np.arange(w["class"].shape[1] + 1)).tolist()
    for z, (begin, to) in enumerate(zip(cut, cut[1:], strict=False)):
        if begin < to:
            own = h[begin:to]
            p = own @ w["member"][z].T
            p += w["member_bias"][z]
            loss += softmax(p, m[begin:to], weight[begin:to])
            g["member"][z], g["member_bias"][z] = p.T @ own, p.sum(axis=0)
            dh[begin:to] += p @ w["member"][z]
    back = np.empty_like(dh)
    back[order] = dh
    dh = back
    dr = dh @ w["down"].T
    dr *= r > 0
    g["down"], g["down_bias"] = r.T @ dh, dh.sum(axis=0)
    g["up"], g["up_bias"] = u.T @ dr, dr.sum(axis=0)
    du = dh + dr @ w["up"].T
    g["mixed"] = lines(o).T @ du
    do = _by_head((du @ w["mixed"].T).reshape(e.shape))
    ds = do @ vh.transpose(0, 1, 3, 2)
    ds -= (ds * a).sum(axis=3, keepdims=True)
    ds *= a
    whole = np.where(_AHEAD, 0, ds.sum(axis=0))
    g["near"] = np.stack([np.bincount(np.maximum(_BACK, 0).ravel(), whole[i].ravel(), 2 * BLOCK) for i in range(HEADS)]).astype(np.float32)
    parts = [_flat(ds @ kh) * scale]
    for d in (_flat(ds.transpose(0, 1, 3, 2) @ qh) * scale, _flat(a.transpose(0, 1, 3, 2) @ do)):
        d[:-1, BLOCK:] += d[1:, :BLOCK]
        parts.append(d[:, BLOCK:])
    d = lines(np.concatenate(parts, axis=2))
    g["query"], g["key"], g["value"] = np.split(lines(e).T @ d, 3, axis=1)
    de = du + d @ into.T
    order = np.argsort(y.ravel().astype(np.uint16), kind="stable")
    rows, at = np.unique(y.ravel()[order], return_index=True)
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][rows] = np.add.reduceat(de[order], at)
    return loss, g


def train(w: dict, members: int, chunks: Iterator[list[np.ndarray]], expected: int, rate: float, fall: float, seed: int) -> dict:
    """Adam over documents (arrays of rows) that come in lists, shuffled within a list, of about `expected` tokens in all.

    All are seen at least once, a single list until about TASK_TOKENS tokens are expected to be; the step size goes from rate to rate * fall."""
    rng = np.random.default_rng(seed)
    w = {k: v.copy() for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    chunks = iter(chunks)
    docs, later = next(chunks, []), next(chunks, None)
    own = max(expected, sum(map(len, docs)))
    epochs = max(1, round(TASK_TOKENS / max(1, own))) if later is None else 1
    size = STEP_BLOCKS * min(LONGER, max(1, own // TASK_TOKENS))
    total, step = max(1, epochs * -(-own // (BLOCK * size))), 0
    while docs:
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            y, x, real, begins = blocks(np.concatenate([docs[i] for i in order]), np.array([len(docs[i]) for i in order]))
            for at in range(0, len(y), size):
                part = slice(at, at + size)
                _, g = gradients(w, members, y[part], x[part], real[part], begins[part])
                step += 1
                now = rate * (1 - (1 - fall) * min(1.0, step / total)) * min(1.0, step / 20)
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, d in g.items():
                    d = d / max(1.0, norm)
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.02 * (d * d - second[k])
                    w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)
        docs, later = later, next(chunks, None)
    return w


class Scorer:
    """Log probabilities by a model; what depends on one id alone is looked up in one table."""

    def __init__(self, model: dict) -> None:
        w = self.w = model["weights"]
        self.model, e, head = model, w["embed"], WIDTH // HEADS
        scale = np.float32(1 / np.sqrt(head))
        # what a head reads is added up after the mixing matrix, so the matrix can be applied to the values beforehand
        mixed = [(e @ w["value"][:, h * head : (h + 1) * head]) @ w["mixed"][h * head : (h + 1) * head] for h in range(HEADS)]
        self.table = np.ascontiguousarray(np.concatenate([e + w["down_bias"], e @ w["query"] * scale, e @ w["key"], *mixed], axis=1))
        self.bias = np.where(_AHEAD, _OFF, w["near"][:, np.maximum(_BACK, 0)]).astype(np.float32)
        longest = [np.sqrt((self.table[:, i * WIDTH : (i + 1) * WIDTH] ** 2).sum(axis=1).max()) for i in (1, 2)]
        self.safe = longest[0] * longest[1] + w["near"].max() < 80  # no exp of a weight can overflow
        self.member, self.rows, self.spaces = w["member"].transpose(0, 2, 1), np.arange(RUN * BLOCK), {}
        # the way up sees the mixed state without the bias of the way down
        self.up = w["up_bias"] - w["down_bias"] @ w["up"]

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array that later steps use again: fresh memory costs more than what is computed in it."""
        size = int(np.prod(shape))
        if len(self.spaces.get(name, ())) < size:
            self.spaces[name] = np.empty(size, np.float32)
        return self.spaces[name][:size].reshape(shape)

    def _states(self, y: np.ndarray, before: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        """What the network makes of blocks y (before: the block before them): WIDTH numbers a place, written to `out`."""
        w, n, head = self.w, len(y), WIDTH // HEADS
        g = np.take(self.table, np.concatenate([before[None], y]).ravel(), axis=0, out=self._space("g", (n + 1) * BLOCK, self.table.shape[1]), mode="clip")
        line, item = g.strides

        def window(column: int, width: int, back: int) -> np.ndarray:
            return np.lib.stride_tricks.as_strided(g[(1 - back) * BLOCK :, column:], (n, (1 + back) * BLOCK, width), (BLOCK * line, line, item), writeable=False)

        u = out.reshape(n, BLOCK, WIDTH)
        u[:] = g[BLOCK:, :WIDTH].reshape(n, BLOCK, WIDTH)
        for h in range(HEADS):
            s = np.matmul(window(WIDTH + h * head, head, 0), window(2 * WIDTH + h * head, head, 1).transpose(0, 2, 1), out=self._space("s", n, BLOCK, 2 * BLOCK))
            s += self.bias[h]
            s[first, :, :BLOCK] = _OFF
            if not self.safe:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            o = np.matmul(s, window((3 + h) * WIDTH, WIDTH, 1), out=self._space("o", n, BLOCK, WIDTH))
            o /= s.sum(axis=2, keepdims=True)
            u += o
        r = np.matmul(out, w["up"], out=self._space("r", n * BLOCK, HIDDEN))
        r += self.up
        np.maximum(r, 0, out=r)
        out += np.matmul(r, w["down"], out=self._space("d", n * BLOCK, WIDTH))

    def _chosen(self, h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
        """Adds to `out` the log of the softmax of h @ weights + bias at each row's target."""
        for at in range(0, len(h), RUN * BLOCK):
            part = slice(at, min(at + RUN * BLOCK, len(h)))
            n = part.stop - at
            l = np.matmul(h[part], weights, out=self._space("l", n, weights.shape[1]))
            l += bias
            picked = l[self.rows[:n], target[part]]
            with np.errstate(over="ignore"):
                sums = np.exp(l, out=l).sum(axis=1)
            if 1e-30 < sums.min() and sums.max() < 1e30:
                np.log(sums, out=sums)
            else:  # out of the floats' range: once more, from each row's largest
                l = h[part] @ weights + bias
                top = l.max(axis=1, keepdims=True)
                sums = np.log(np.exp(l - top).sum(axis=1)) + top[:, 0]
            out[part] += picked - sums

    def _logs(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        w, members = self.w, self.model["members"]
        c = (t // members).astype(np.uint16)
        order = np.argsort(c, kind="stable")  # by class from here on
        h, c, m = np.take(h, order, axis=0, out=self._space("sorted", *h.shape), mode="clip"), c[order], (t % members)[order]
        out = np.zeros(len(t), np.float32)
        self._chosen(h, w["class"], w["class_bias"], c, out)
        cut = np.searchsorted(c, np.arange(w["class"].shape[1] + 1))
        for z in np.flatnonzero(np.diff(cut)):
            part = slice(cut[z], cut[z + 1])
            self._chosen(h[part], self.member[z], w["member_bias"][z], m[part], out[part])
        back = np.empty_like(out)
        back[order] = out
        return back

    def tokens(self, ids: np.ndarray, per: np.ndarray) -> np.ndarray:
        """The natural log of each id's probability after those before it in its document."""
        rows = self.model["row"][ids]
        y, x, real, first = blocks(rows, per)
        out = np.empty(x.shape, np.float32)
        for at in range(0, len(y), RUN * TOGETHER):
            to = min(at + RUN * TOGETHER, len(y))
            h = self._space("h", (to - at) * BLOCK, WIDTH)
            for a in range(at, to, RUN):
                b = min(a + RUN, to)
                self._states(y[a:b], y[a - 1], first[a:b], h[(a - at) * BLOCK : (b - at) * BLOCK])
            out[at:to] = self._logs(h, x[at:to].ravel()).reshape(-1, BLOCK)
        out = out[real].astype(np.float64)
        out[rows == len(self.w["embed"]) - 1] -= np.log(self.model["unseen"])
        return out


# ---- Spark: training and scoring ----


def _training(slices: DataFrame, r: int, parts: int) -> DataFrame:
    """key, doc, ids of the training documents of round r: those whose hash falls into `parts` of the ROUNDS parts from r on; key is a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, docs, learn, per, ids in _slices(batches):
            own = mix(np.array([d or 0 for d in docs], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            ends = np.cumsum(per)
            turn = ((own & np.uint64(1023)).astype(np.int64) % ROUNDS - r) % ROUNDS
            chosen = np.flatnonzero(learn & (turn < parts))
            for at in range(0, len(chosen), 4096):
                some = chosen[at : at + 4096]
                yield pa.RecordBatch.from_pydict({"key": pa.array(own[some].view(np.int64)), "doc": pa.array([docs[i] for i in some], pa.int64()), "ids": pa.array([ids[ends[i] - per[i] : ends[i]].tobytes() for i in some], pa.binary())})

    return slices.mapInArrow(run, "key bigint, doc bigint, ids binary")


def _lists(batches: Iterator[pa.RecordBatch], row: np.ndarray, seen: dict) -> Iterator[list[np.ndarray]]:
    """The documents' rows in lists of about two times TASK_TOKENS, so that memory does not follow a task's share. seen: first document, tokens."""
    docs, n = [], 0
    for batch in batches:
        for d, i in zip(batch.column("doc").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            docs.append((d, i))
            n += len(i) // 2
            seen["first"], seen["n"] = min(d, seen.get("first", d)), seen.get("n", 0) + len(i) // 2
            if n >= 2 * TASK_TOKENS:
                yield [row[np.frombuffer(i, "<u2")] for _, i in sorted(docs)]
                docs, n = [], 0
    if docs:
        yield [row[np.frombuffer(i, "<u2")] for _, i in sorted(docs)]


def fit(slices: DataFrame, tokens: int, path: str) -> dict:
    """A model from the training documents of written slices; `tokens` is how many ids these have."""
    spark = slices.sparkSession
    _, _, end = _tokenizer(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for _, _, learn, per, ids in _slices(batches):
            total += np.bincount(ids[np.repeat(learn, per)], minlength=end + 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    # at most one row for each id of the vocabulary
    per = {r.id: r.n for r in slices.mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    library = _tokenizer(path)[0]
    seen = np.array(sorted((i for i in per if i != end), key=library.decode_single_token_bytes), np.int64)
    model = new_model(seen, np.array([per.get(end, 0), *(per[i] for i in seen), 0], float), end + 1)
    # a round's documents are a ROUNDS-th of all, or as many parts as give one task enough to do
    parts = min(ROUNDS, -(-ROUNDS * TASK_TOKENS // max(1, tokens)))
    share = tokens * parts // ROUNDS
    tasks = min(TASKS, max(1, share // (LONGER * TASK_TOKENS)))
    for r in range(ROUNDS if tokens else 0):
        sent = spark.sparkContext.broadcast(model)
        rate, fall = RATE * (1 - r / ROUNDS), 1 - 1 / (ROUNDS - r + 0.1)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate, fall=fall, r=r) -> Iterator[pa.RecordBatch]:
            m, seen = sent.value, {}
            w = train(m["weights"], m["members"], _lists(batches, m["row"], seen), share // tasks, rate, fall, seed=r)
            for k, v in w.items() if seen else ():
                raw = v.tobytes()
                cuts = range(0, len(raw), PIECE)
                yield pa.RecordBatch.from_pydict({"name": [k] * len(cuts), "at": pa.array(cuts, pa.int64()), "first": pa.array([seen["first"]] * len(cuts), pa.int64()), "n": pa.array([seen["n"]] * len(cuts), pa.int64()), "v": pa.array([raw[c : c + PIECE] for c in cuts], pa.binary())})

        # in the order of a hash, so that a list holds documents of all kinds
        own = _training(slices, r, parts).repartition(tasks).sortWithinPartitions("key", "doc", "ids")
        mean = own.select("doc", "ids").mapInArrow(run, "name string, at bigint, first bigint, n bigint, v binary").groupBy("name", "at").applyInArrow(_mean, "name string, at bigint, v binary")
        got = {}
        for row in mean.collect():  # the model once, whose size is bounded by the vocabulary
            got.setdefault(row.name, []).append((row["at"], bytes(row.v)))
        weights = {k: np.frombuffer(b"".join(v for _, v in sorted(got[k])), np.float32).reshape(old.shape).copy() for k, old in model["weights"].items()}
        model = model | {"weights": weights}
    return model


def _mean(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("first")
    n = np.array(rows.column("n").to_pylist(), float)
    total = sum(k * np.frombuffer(v, np.float32).astype(float) for k, v in zip(n, rows.column("v").to_pylist(), strict=True))
    return pa.table({"name": rows.column("name")[:1], "at": rows.column("at")[:1], "v": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def scored(docs: DataFrame, learn: Column, id: str = "doc_id", path: str | None = None) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row; the model learns from rows where `learn` is true.

    Null texts are empty: one token, the end. Repeated ids are rows of their own, and all of them count. Without rows to
    learn from the counts are 0 and the network is untrained. Words are counted by 64-bit hashes of their ids."""
    with _small_batches(docs.sparkSession):
        return _scored(docs, learn, id, path or vocabulary_path())


def _scored(docs: DataFrame, learn: Column, id: str, path: str) -> DataFrame:
    # a reader or writer of Parquet holds many rows of a file at once, and these are rows of megabytes
    slices = written(encoded(docs, learn, id, path), maxRecordsPerFile=str(FILE_SLICES))
    begins = _tokenizer(path)[1]
    ids = F.aggregate(F.zip_with("per", "learn", lambda p, l: F.when(l, p).otherwise(0)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    tokens, every = slices.agg(F.coalesce(F.sum(ids), F.lit(0)), F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, every / 2 / GROUP)))))
    found = written(counted(slices, path, bits))
    distinct = sum(int.from_bytes(r.counts, "little") for r in found.where("slice = -1").select("counts").collect())  # one row for each of 2**bits groups

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for _, _, own, per, i in _slices(batches):
            n += int(np.count_nonzero(begins[i] & np.repeat(own, per)))
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    train_tokens = slices.mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sent = slices.sparkSession.sparkContext.broadcast(fit(slices, tokens, path))
    share = train_tokens + distinct + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for _, names, _, per, i in _slices(left.to_batches()):
            at, hashes = word_hashes(i, begins)
            _, of = np.unique(hashes, return_inverse=True)
            c = np.frombuffer(b"".join(right.sort_by("part").column("counts").to_pylist()), "<i8")[of]
            first = np.concatenate([[0], np.cumsum(per)[:-1]])
            word = np.searchsorted(at, first)
            sums = [np.add.reduceat(v, word) for v in (np.ones(len(c), np.int64), (c > 0).astype(np.int64), np.log10((c + 1) / share))]
            logs = np.add.reduceat(_scorer(sent).tokens(i, per), first) / np.log(10)
            parts.append(pa.table({"id": pa.array(names, pa.int64()), "n_tokens": sums[0], "n_known": sums[1], "base_score": sums[2], "score": logs}))
        return pa.concat_tables(parts) if parts else pa.table({"id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    out = slices.groupBy("slice").cogroup(found.where("slice >= 0").groupBy("slice")).applyInArrow(run, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id), "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


_scorers: dict = {}


def _scorer(sent) -> Scorer:
    """One scorer for each worker and broadcast model."""
    if sent.value["weights"]["embed"] is not _scorers.get("of"):
        _scorers.clear()
        _scorers["of"], _scorers["scorer"] = sent.value["weights"]["embed"], Scorer(sent.value)
    return _scorers["scorer"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of("doc_id"), F.lit(7)) == 2
    out = scored(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
