import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import attention_lm as al

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered(text)), None]


def base(rows):
    """The contract's counts and base, word by word. rows: (doc_id, text) -> [(doc_id, n_tokens, n_known, train_tokens, base)]."""
    c = Counter()
    for d, text in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(tokens(text))
    n, v = sum(c.values()), len(c)
    return [(d, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, text in rows for t in [tokens(text)]]


@pytest.fixture(scope="module")
def made():
    """A random model of 32 rows over ids 10 to 39, END 49."""
    rng = np.random.default_rng(0)
    model = al.new_model(np.arange(10, 40), rng.integers(1, 100, 32).astype(float), 50)
    model["weights"] = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in model["weights"].items()}
    return model


def naive(model, ids):
    """Log probabilities of all rows at every place of one document, one place and one window at a time."""
    w = {k: v.astype(float) for k, v in model["weights"].items()}
    rows = model["row"][ids]
    y = np.concatenate([[0], rows[:-1]])
    head, out = al.WIDTH // al.HEADS, []
    for t in range(len(ids)):
        begin = max(0, (t // al.BLOCK - 1) * al.BLOCK)
        e = w["embed"][y[begin : t + 1]]
        mixed = []
        for h in range(al.HEADS):
            part = slice(h * head, (h + 1) * head)
            k, v, q = (e @ w["key"])[:, part], (e @ w["value"])[:, part], (e[-1] @ w["query"])[part]
            s = k @ q / math.sqrt(head) + w["near"][h, np.arange(t - begin, -1, -1)]
            a = np.exp(s - s.max())
            mixed.append(a @ v / a.sum())
        u = e[-1] + np.concatenate(mixed) @ w["mixed"]
        state = u + np.maximum(u @ w["up"] + w["up_bias"], 0) @ w["down"] + w["down_bias"]
        c = state @ w["class"] + w["class_bias"]
        m = w["member"] @ state + w["member_bias"]
        out.append((c - np.log(np.exp(c).sum()))[:, None] + m - np.log(np.exp(m).sum(axis=1))[:, None])
    return np.array([x.ravel() for x in out]), rows


def test_scores_equal_a_loop_over_tokens(made):
    rng = np.random.default_rng(1)
    per = np.array([1, 40, 16, 17, 33, 90, 2])
    ids = rng.integers(8, 42, per.sum())
    ids[np.cumsum(per) - 1] = 49
    got, at = al.Scorer(made).tokens(ids, per), 0
    for n in per:
        logs, rows = naive(made, ids[at : at + n])
        want = logs[np.arange(n), rows] - np.where(rows == 31, np.log(made["unseen"]), 0)
        assert np.allclose(got[at : at + n], want, atol=2e-4)
        # over all members of all classes, empty ones included, probabilities come to one
        assert np.allclose(np.exp(logs).sum(axis=1), 1)
        at += n


def test_steps_of_scoring_do_not_show(made, monkeypatch):
    rng = np.random.default_rng(2)
    per = rng.integers(1, 100, 30)
    ids = rng.integers(8, 42, per.sum())
    whole = al.Scorer(made).tokens(ids, per)
    monkeypatch.setattr(al, "RUN", 3)
    assert np.allclose(al.Scorer(made).tokens(ids, per), whole, atol=1e-4)


def test_extreme_weights_stay_finite(made):
    big = made | {"weights": {k: v * 60 for k, v in made["weights"].items()}}
    assert np.isfinite(al.Scorer(big).tokens(np.arange(10, 40), np.array([30]))).all()


def test_gradients_by_differences(made):
    rng = np.random.default_rng(3)
    w = {k: v.astype(float) for k, v in made["weights"].items()}
    per = np.array([5, 40, 1, 33])
    parts = al.blocks(rng.integers(0, 32, per.sum()), per)
    _, g = al.gradients(w, made["members"], *parts)
    for k in w:
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in w[k].shape)
            old, sides = w[k][i], []
            for e in (1e-5, -1e-5):
                w[k][i] = old + e
                sides.append(al.gradients(w, made["members"], *parts)[0])
            w[k][i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - g[k][i]) < 1e-5


def test_ids_are_those_of_each_word():
    path = al.vocabulary_path()
    library, _, end = al._tokenizer(path)
    texts = ["The the THE", None, "", " \n", "Ünïcode – 日本語\x0bword\x1cother", "x" * 100 + " tail", "ÀÉ"]
    ids, per = al.ids_of(pa.array(texts), path)
    want = [[*(i for w in tokens(t)[:-1] for i in library.encode_ordinary(" " + w)), end] for t in texts]
    assert per.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def check(df, rows):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df), key=repr)
    assert got == sorted(((d, t, k, n, round(b, 6)) for d, t, k, n, b in base(rows)), key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in df)
    assert all(r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in df)


def test_given_documents(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = al.query(spark, SF).collect()
    check(df, rows)
    # the rows' order and slices change nothing but rounding
    monkeypatch.setattr(al, "SLICE", 20_000)
    monkeypatch.setattr(al, "GROUP", 5_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    again = {r.doc_id: r for r in al.scored(docs, al.F.pmod(al.crc_of("doc_id"), al.F.lit(7)) != 2).collect()}
    assert all(math.isclose(r.base_score, again[r.doc_id].base_score) and math.isclose(r.score, again[r.doc_id].score, rel_tol=1e-3) for r in df)


def test_held_out_documents_are_likelier_than_by_counts(spark):
    """From a thousand documents on the network beats the counts on texts it never saw; on 200 the counts, whose unknown words cost little, are ahead."""
    df = al.query(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(df) > 100 and sum(r.score for r in df) > 0.985 * sum(r.base_score for r in df)


def test_odd_rows(spark, odd, clash, tmp_path, monkeypatch):
    monkeypatch.setattr(al, "TASK_TOKENS", 20_000)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    clash(odd).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    check(al.query(spark, str(tmp_path / "odd")).collect(), rows)
    odd.where("false").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert al.query(spark, str(tmp_path / "empty")).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = [(held, "Nothing to learn from."), (None, "Nor here.")]
    spark.createDataFrame(alone, "doc_id bigint, text string").write.parquet(str(tmp_path / "held" / "documents.parquet"))
    check(al.query(spark, str(tmp_path / "held")).collect(), alone)


def test_parameters_are_averaged_by_tokens():
    v = [np.array([1.0, 2.0], np.float32), np.array([4.0, 5.0], np.float32)]
    out = al._mean(pa.table({"name": ["a", "a"], "at": [0, 0], "first": [2, 1], "n": [1, 2], "v": pa.array([x.tobytes() for x in v], pa.binary())}))
    assert np.frombuffer(out.column("v")[0].as_py(), np.float32).tolist() == [3.0, 4.0]


def test_every_training_document_trains_the_network(spark, docs):
    """However many tokens there are: each document here has a word of its own, and the parameters of all its ids must have moved."""
    path = al.vocabulary_path()
    library, _, end = al._tokenizer(path)
    own = [w for i in range(97, 123) for j in range(97, 123) for w in [chr(i) + chr(j)] if len(library.encode_ordinary(" " + w)) == 1][:80]
    assert len(own) == 80
    slices = al.written(al.encoded(docs([(i, f"{w} {w}") for i, w in enumerate(own)]), al.F.lit(True), "doc_id", path))
    model = al.fit(slices, 10**9, path)
    seen = np.flatnonzero(model["row"][:end] < len(model["weights"]["embed"]) - 1)
    assert len(seen) == 80
    before = al.new_model(np.array(sorted(seen, key=library.decode_single_token_bytes)), np.ones(82), end + 1)["weights"]["embed"]
    assert (np.abs(model["weights"]["embed"] - before)[:-1].max(axis=1) > 0).all()


def test_a_long_share_is_trained_on_in_lists(made, monkeypatch):
    monkeypatch.setattr(al, "TASK_TOKENS", 50)
    row, seen = made["row"], {}
    ids = [np.array([10 + i % 30] * (1 + i % 7) + [49], "<u2") for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(100), pa.int64()), "ids": pa.array([i.tobytes() for i in ids], pa.binary())})
    lists = list(al._lists(iter([batch.slice(0, 40), batch.slice(40)]), row, seen))
    assert len(lists) > 3 and sum(map(len, lists)) == 100 and seen == {"first": 0, "n": sum(map(len, ids))}
    assert max(sum(map(len, x)) for x in lists) < 2 * al.TASK_TOKENS + 8

    def loss(w):
        x = np.concatenate([row[i] for i in ids])
        return al.gradients(w, made["members"], *al.blocks(x, np.array([len(i) for i in ids])))[0]

    w = al.train(made["weights"], made["members"], iter(lists), sum(map(len, ids)), 0.02, 0.5, 0)
    assert loss(w) < loss(made["weights"])
    assert all(np.array_equal(a, b) for a, b in zip(al.train(made["weights"], made["members"], iter([]), 10, 0.02, 0.5, 0).values(), made["weights"].values(), strict=True))


def test_memory_follows_neither_batches_nor_files(spark, monkeypatch):
    """Rows reach Python in small batches and lie in small files, and slices are filled across batches all the same."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"word{i % 5} other words {i}") for i in range(60)], "doc_id bigint, text string").coalesce(1)
    key, records = al._BATCH, "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(records, "7")
    try:
        rows = al.encoded(docs, F.col("doc_id") % 2 == 0, "doc_id", al.vocabulary_path()).collect()
    finally:
        spark.conf.unset(records)
    assert len(rows) == 1 and rows[0].docs == list(range(60)) and rows[0].learn == [i % 2 == 0 for i in range(60)] and 2 * sum(rows[0].per) == len(rows[0].ids)
    seen, before = [], spark.conf.get(key)
    monkeypatch.setattr(al, "written", lambda df, kept=al.written, **options: seen.append((spark.conf.get(key), options)) or kept(df, **options))
    al.scored(docs, F.lit(False))
    assert [a for a, _ in seen] == [str(al.BATCH)] * 2 and seen[0][1] == {"maxRecordsPerFile": str(al.FILE_SLICES)} and spark.conf.get(key) == before
