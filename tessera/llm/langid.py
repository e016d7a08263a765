"""Language ID by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability; a word's probability is the sum, over all ways to
cut it into pieces, of the product of their probabilities (a forward pass), and a text's is the product of its words'.
The probabilities are fitted by expectation maximisation, whose expected piece counts Spark adds up over the distinct
words of a bounded sample of labelled documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_of, steps, table, written
from tessera.llm.words import Known, mix, words

#: Labelled documents of each language that the fit may use; they are those with the smallest hashes of doc_id.
FIT_DOCS = 4_000
ROUNDS = 3
#: Longer runs of letters than this teach as several words (scoring takes them whole, rescaled every RESCALE letters).
RUN, RESCALE = 30, 16
#: Places of a lattice (rows x letters) that are held at once.
PLACES = 1 << 18
#: Added to each expected count, so that no piece is impossible.
SMOOTH = 0.05
REMEMBERED = 500_000
_BASES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_MASK = np.uint64((1 << 22) - 1)
_models: dict[str, "_Scorer"] = {}


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(path: str) -> list[str]:
    """All lower-case letter pieces of a sentencepiece vocabulary, a word's begin marked by a space, and all their letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", " ").lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
    found = {p for p in found if p.lstrip(" ").isalpha() and p.rfind(" ") <= 0}
    return sorted(found | {c for p in found for c in p} | {" "})


def clean(word: bytes, most: int | None = RUN) -> list[str]:
    """A word's runs of letters joined, lower-case, with a mark for its begin, cut into `most` letters each (None: as one string);
    none without letters."""
    text = word.decode("utf-8", "replace").lower()
    if not text.isalpha():
        text = "".join(c for c in text if c.isalpha())
    return [(" " if i == 0 else "") + text[i : i + most] for i in range(0, len(text), most)] if most else [" " + text] * bool(text)


class _Scorer:
    def __init__(self, hashes: np.ndarray, probs: np.ndarray, longest: int = 32):
        """hashes: sorted, of the vocabulary; probs: (vocabulary + unknown letter + none, languages); longest: letters of a piece at most."""
        self.hashes, self.probs, self.longest = hashes, probs, longest
        self.maybe = np.zeros(int(_MASK) + 1, bool)
        self.maybe[(hashes & _MASK).astype(np.int64)] = True
        self.known = Known()
        self.scores: list[np.ndarray] = []

    def _lattice(self, letters: np.ndarray, begins: int) -> np.ndarray:
        """Piece ids (length - 1, row, begin) of the first `begins` places of letters (rows, places; 0 past a row's end)."""
        rows, top, none = len(letters), letters.shape[1], len(self.probs) - 1
        ids = np.full((min(self.longest, top), rows, begins), none, np.int32)
        sums = np.zeros((rows, begins), np.uint64)
        for k in range(len(ids)):
            room = min(begins, top - k)
            sums = sums[:, :room] + letters[:, k : k + room] * _BASES[k]
            at = np.flatnonzero(self.maybe[(sums & _MASK).astype(np.int64)] & (letters[:, k : k + room] > 0))
            h = sums.ravel()[at]
            pos = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ok = self.hashes[pos] == h
            at, pos = at[ok], pos[ok]
            ids[k, at // room, at % room] = pos
            if k == 0:
                ids[0][(ids[0] == none) & (letters[:, :room] > 0)] = none - 1  # an unknown letter
        return ids

    @staticmethod
    def _letters(runs: list[str], sizes: np.ndarray) -> np.ndarray:
        letters = np.zeros((len(runs), int(sizes.max())), np.uint64)
        letters[np.arange(letters.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        return letters

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """(begin, row, language): the probability of the letters before each begin."""
        n, top, langs = ids.shape[1], ids.shape[2], self.probs.shape[1]
        alpha = np.zeros((top + 1, n, langs))
        alpha[0] = 1
        for j in range(1, top + 1):
            for k in range(min(len(ids), j)):
                piece = ids[k, :, j - k - 1]
                if (piece != len(self.probs) - 1).any():
                    alpha[j] += alpha[j - k - 1] * self.probs[piece]
        return alpha

    def _by_length(self, runs: list[str]) -> Iterator[np.ndarray]:
        """Rows of one length, or of nearly one where they are long, in slices of about PLACES letters."""
        sizes = np.array([len(r) for r in runs])
        order = np.argsort(sizes, kind="stable")
        kind = np.where(sizes <= RUN + 1, sizes, RUN + 1 + np.ceil(8 * np.log2(np.maximum(sizes, RUN + 1) / (RUN + 1))).astype(np.int64))
        cut = np.flatnonzero(np.diff(kind[order], prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(runs)], strict=True):
            step = max(1, min(8192, PLACES // int(sizes[order[b - 1]])))
            for x in range(a, b, step):
                yield order[x : min(x + step, b)]

    def logs(self, runs: list[str]) -> np.ndarray:
        """Log-probabilities (runs, languages): a forward pass over each whole run, however long. Only the places that a piece
        can still reach are held, and they are rescaled now and then."""
        langs, none = self.probs.shape[1], len(self.probs) - 1
        out = np.zeros((len(runs), langs))
        for rows in self._by_length(runs):
            sizes = np.array([len(runs[i]) for i in rows])
            letters, ring = self._letters([runs[i] for i in rows], sizes), self.longest + 1
            open_, scale = np.zeros((ring, len(rows), langs)), np.zeros((len(rows), langs))
            open_[0] = 1
            top, same = letters.shape[1], (sizes == sizes[0]).all()
            block = max(64, PLACES // len(rows))
            for j in range(top + 1):
                if j % block == 0 and j < top:
                    ids = self._lattice(letters[:, j : j + block + self.longest - 1], min(block, top - j))
                here = open_[j % ring]
                done = slice(None) if same and j == top else np.flatnonzero(sizes == j) if not same else []
                if same and j == top or not same and len(done):
                    out[rows[done]] = np.log(here[done] + 1e-300) + scale[done]
                if j < top:
                    for k in range(len(ids)):
                        piece = ids[k, :, j % block]
                        if (piece != none).any():
                            open_[(j + k + 1) % ring] += here * self.probs[piece]
                    here[:] = 0
                    if j % RESCALE == RESCALE - 1:
                        most = open_.max(axis=0)
                        most[most <= 0] = 1
                        open_ /= most
                        scale += np.log(most)
        return out

    def expected(self, runs: list[str], lang: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces, languages) of words of known language, RUN letters long at most: one E step."""
        counts = np.zeros_like(self.probs)
        for rows in self._by_length(runs):
            sizes = np.array([len(runs[i]) for i in rows])
            ids = self._lattice(self._letters([runs[i] for i in rows], sizes), int(sizes.max()))
            top, n, of = ids.shape[2], np.arange(len(rows)), lang[rows]
            alpha = self.forward(ids)[:, n, of]
            beta = np.zeros((top + 1, len(rows)))
            beta[top] = 1
            for i in range(top - 1, -1, -1):
                for k in range(min(len(ids), top - i)):
                    beta[i] += self.probs[ids[k, :, i], of] * beta[i + k + 1]
            scale = weight[rows] / np.maximum(alpha[top], 1e-300)
            for i in range(top):
                for k in range(min(len(ids), top - i)):
                    np.add.at(counts, (ids[k, :, i], of), alpha[i] * self.probs[ids[k, :, i], of] * beta[i + k + 1] * scale)
        counts[-1] = 0
        return counts

    def documents(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities (documents, languages) and whether a document has a letter."""
        hashes, cut, starts, ends = words(column)
        docs, langs = len(cut) - 1, self.probs.shape[1]
        if not len(hashes):
            return np.zeros((docs, langs)), np.zeros(docs, bool)
        from tessera.llm.common import bytes_of

        distinct, at, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.scores = []
        rows = self.known.find(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = bytes_of(column)[0].tobytes()
            runs = [clean(raw[starts[at[i]] : ends[at[i]]], None) for i in new]
            flat = [r for x in runs for r in x]
            logs = self.logs(flat) if flat else np.zeros((0, langs))
            own = np.zeros((len(new), langs + 1))
            owner = np.repeat(np.arange(len(new)), [len(x) for x in runs])
            np.add.at(own, owner, np.column_stack([logs, np.ones(len(flat))]))
            rows[new] = sum(map(len, self.scores)) + np.arange(len(new))
            self.known.add(distinct[new], rows[new])
            self.scores.append(own.astype(np.float32))
        if len(self.scores) > 1:
            self.scores = [np.concatenate(self.scores)]
        rows = rows[where]
        total = np.zeros((docs, langs + 1))
        full = np.flatnonzero(np.diff(cut))
        total[full] = np.add.reduceat(self.scores[0][rows].astype(np.float64), cut[:-1][full])
        return total[:, :langs], total[:, langs] > 0


def _hashes(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([np.sum(np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64) * _BASES[: len(p)]) for p in vocab], np.uint64)
    return np.unique(h, return_index=True)


def _counted(sample: DataFrame) -> DataFrame:
    """lang, run, c: the runs of letters of the sample's words, counted over all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.common import bytes_of

        for batch in steps(batches):
            hashes, cut, starts, ends = words(batch.column("text"))
            if not len(hashes):
                continue
            raw = bytes_of(batch.column("text"))[0].tobytes()
            langs, of = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for k in range(len(langs)):
                own = np.repeat(of == k, np.diff(cut))
                _, at, c = np.unique(hashes[own], return_index=True, return_counts=True)
                at = np.flatnonzero(own)[at]
                rows = [(r, n) for b, e, n in zip(starts[at], ends[at], c.tolist(), strict=True) for r in clean(raw[b:e])]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([str(langs[k])] * len(rows), pa.string()), "run": pa.array([r for r, _ in rows], pa.string()), "c": pa.array([n for _, n in rows], pa.int64())})

    return sample.select("text", "lang").mapInArrow(run, "lang string, run string, c bigint").groupBy("lang", "run").agg(F.sum("c").alias("c"))


def fit(labelled: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> dict:
    """A model from labelled documents (doc_id, text, lang): languages in order, vocabulary hashes, piece probabilities.

    Its size is that of the vocabulary times the number of languages. Rows without lang or text do not count."""
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null and text is not null")
    per = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    langs = sorted(per)
    vocab = pieces(path or vocabulary_path())
    (hashes, _), longest = _hashes(vocab), max(map(len, vocab))
    if not langs:
        return {"id": uuid.uuid4().hex, "langs": [], "hashes": hashes, "longest": longest, "probs": np.zeros((len(hashes) + 2, 0))}
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, fit_docs / per[l]))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    counted = written(_counted(sample))
    place = {l: i for i, l in enumerate(langs)}
    probs = np.full((len(hashes) + 2, len(langs)), 1 / len(hashes))
    probs[-2], probs[-1] = 1e-6, 0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((hashes, probs, longest))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, total = _Scorer(*sent.value), 0
            for b in batches:
                if b.num_rows:
                    total = total + scorer.expected(b.column("run").to_pylist(), np.array([place[x] for x in b.column("lang").to_pylist()]), b.column("c").to_numpy().astype(float))
            if not np.isscalar(total):
                piece, lang = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "c": total[piece, lang]})

        found = counted.mapInArrow(expect, "piece int, lang int, c double").groupBy("piece", "lang").agg(F.sum("c").alias("c")).toPandas()
        counts = np.zeros_like(probs)
        counts[found.piece.to_numpy(), found.lang.to_numpy()] = np.round(found.c.to_numpy(), 6)
        counts[:-1] += SMOOTH
        probs = counts / counts.sum(axis=0)
    return {"id": uuid.uuid4().hex, "langs": langs, "hashes": hashes, "longest": longest, "probs": probs}


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score (or what `names` calls them) (the language's share of the text's probability) to doc_id or the columns in `keep`.

    Texts that are null or without a letter: und, 0. Only text is looked at."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if m["id"] not in _models:
            _models.clear()
            _models[m["id"]] = _Scorer(m["hashes"], m["probs"], m["longest"])
        scorer, known = _models[m["id"]], [*m["langs"], "und"]
        for batch in steps(batches, "text__"):
            if m["langs"]:
                logs, some = scorer.documents(batch.column("text__"))
                best = np.where(some, logs.argmax(axis=1), len(known) - 1)
                score = np.where(some, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            else:
                best, score = np.full(batch.num_rows, len(known) - 1), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([known[i] for i in best], pa.string()), pa.array(score)], [*keep, *names])

    return docs.select(*keep, F.col("text").alias("text__")).mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of("doc_id"), F.lit(4)) == 2
    return predict(docs, fit(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
