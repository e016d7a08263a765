import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import token_store as ts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(ts.tokenizer_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, ts.END]


def test_encoder_is_the_library(library):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "bc", "é", " ", "　", "'s", "'", "12", ".", ",", "!!", "<|endoftext|>", "\t", "x y", "日本", "\x85", " ", "😀", "\x00", "\x7f", "|", "…", ". A"]
    texts = [None, "", " ", " a", "a ", "\n", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000))]
    e = ts._Encoder(ts.tokenizer_path())
    for at in range(0, len(texts), 250):
        ids, off = e.encode(pa.array(texts[at : at + 250], pa.string()))
        for i, t in enumerate(texts[at : at + 250]):
            assert ids[off[i] : off[i + 1]].tolist() == ids_of(library, t), repr(t)


def test_joined_crc():
    rng = random.Random(2)
    rows = [[rng.randbytes(rng.choice([0, 1, 5, 300])) for _ in range(rng.randrange(1, 6))] for _ in range(20)]
    flat = [p for r in rows for p in r]
    got = ts.joined_crc(np.array([zlib.crc32(p) for p in flat], np.uint32), np.array([len(p) for p in flat]), np.cumsum([0, *map(len, rows)]))
    assert got.tolist() == [zlib.crc32(b"".join(r)) for r in rows]


def test_round_trip(docs, clash, library):
    rng = random.Random(3)
    passage = " ".join(f"word{rng.randrange(900)}" for _ in range(1500))
    rows = [(9, "last"), (3, passage), (1, None), (2, ""), (4, passage), (5, "intro " + passage + " end"), (6, "a b c"), (7, "x" * 30_000), (8, "Ünï 日本\n")]
    store = ts.write_store(clash(docs(rows)))
    want, at = {}, 0
    for d, t in sorted(rows):
        ids = ids_of(library, t)
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ts.verified(store).collect()} == want
    assert {r.doc_id: r.ids for r in ts.read_ids(store).collect()} == {d: ids_of(library, t) for d, t in rows}
    assert store.chunks.count() == store.chunks.select("address").distinct().count()
    held = store.recipes.select(F.explode("addresses").alias("x"))
    assert held.count() > held.distinct().count()  # copies and shared passages are stored once
    assert store.manifest.agg(F.sum("docs"), F.sum("tokens")).first() == (9, at)


def test_damage_is_found(docs):
    store = ts.write_store(docs([(1, "some text"), (2, "other text")]))
    broken = ts.Store(store.chunks.withColumn("ids", F.expr("concat(ids, X'0000')")), store.recipes, store.manifest)
    with pytest.raises(Exception, match="digest"):
        ts.verified(broken).collect()
    swapped = ts.Store(store.chunks, store.recipes.withColumn("root", F.unhex(F.lit("00" * 16))), store.manifest)
    with pytest.raises(Exception, match="root"):
        ts.verified(swapped).collect()


def test_loss_is_found(docs):
    store = ts.write_store(docs([(i, f"text number {i} " * i) for i in range(1, 6)]))
    lost = store.chunks.where(F.col("address") != F.lit(store.chunks.first().address))
    for damaged in (
        ts.Store(lost, store.recipes, store.manifest),
        ts.Store(store.chunks, store.recipes.where("doc_id != 5"), store.manifest),
        ts.Store(store.chunks, store.recipes.where("doc_id != 2"), store.manifest),
        ts.Store(store.chunks, store.recipes.where("run = -1"), store.manifest),
        ts.Store(store.chunks, store.recipes.withColumn("doc_id", 6 - F.col("doc_id")), store.manifest),
        ts.Store(store.chunks, store.recipes.withColumn("start", F.col("start") + 1), store.manifest),
        ts.Store(store.chunks, store.recipes, store.manifest.withColumn("tokens", F.col("tokens") + 1)),
    ):
        with pytest.raises(Exception, match="not stored|manifest|follow"):
            ts.verified(damaged).collect()
    with pytest.raises(Exception, match="not stored"):
        ts.read_ids(ts.Store(lost, store.recipes, store.manifest)).collect()


def test_a_run_that_is_lost_is_found(docs, monkeypatch):
    monkeypatch.setattr(ts, "RUN", 2)
    store = ts.write_store(docs([(i, f"text {i}") for i in range(9)]).coalesce(1))
    assert store.manifest.count() >= 5 and ts.verified(store).count() == 9
    for run in [r.run for r in store.manifest.collect()]:
        keep = F.col("run") != run
        with pytest.raises(Exception, match="follow|manifest"):
            ts.verified(ts.Store(store.chunks, store.recipes.where(keep), store.manifest.where(keep))).collect()


def test_wide_ids_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    wide = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w0"))
    wide.save(str(tmp_path / "wide.json"))
    with pytest.raises(ValueError, match="16 bits"):
        ts._Encoder(str(tmp_path / "wide.json"))


def test_odd_rows(odd, docs):
    got = ts.verified(ts.write_store(odd)).orderBy("start").collect()
    assert len(got) == 9 and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert ts.verified(ts.write_store(docs([]))).count() == 0
