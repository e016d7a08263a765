import re
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from tessera.llm import decontaminate, token_store
from tessera.llm.words import words
from tests.llm.test_mixing import targets
from tests.llm.test_pipeline_near import kept as near_kept

SF = "/root/testdata/sf0.001"


def coverage(item, text):
    """Bounds on the share of the item's words that tiling marks: the longest common run, and all words in common runs of a seed's length."""
    (a, ca, *_), (b, cb, *_) = (words(pa.array([x]), space=decontaminate.SEPARATOR) for x in (item, text))
    a, b = a[: ca[1]].tolist(), b[: cb[1]].tolist()
    if not a:
        return 0.0, 0.0
    size = min(decontaminate.MATCH, len(a))
    runs = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
    starts = [i for i in range(len(a) - size + 1) if tuple(a[i : i + size]) in runs]
    longest, joined = 0, " ".join(map(str, b)) + " "
    for i in starts:
        k = size
        while i + k <= len(a) and " " + " ".join(map(str, a[i : i + k])) + " " in " " + joined:
            longest, k = max(longest, k), k + 1
    return longest / len(a), len({i + k for i in starts for k in range(size)}) / len(a)


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = cp.written(stage(spark, docs, SF))
        kept[name] = (before, docs)
        assert docs.columns == columns
        assert {tuple(r) for r in docs.drop("lang").collect()} <= {tuple(r) for r in before.drop("lang").collect()}
    before, after = kept["language_id"]
    assert after.count() >= 0.98 * before.count()
    before, after = kept["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == near_kept([(r.doc_id, r.text) for r in before.collect()], cp.NEAR)
    before, after = kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stays = {r.doc_id for r in after.collect()}
    assert 0 < before.count() - len(stays) < before.count() / 2
    for r in before.collect():
        least, most = zip(*(coverage(i, r.text) for i in items), strict=True)
        assert max(least) < decontaminate.THRESHOLD if r.doc_id in stays else max(most) >= decontaminate.THRESHOLD, r.doc_id
    before, after = kept["mixing"]
    sizes, taken, largest = ({} for _ in range(3))
    for df, out in ((before, sizes), (after, taken)):
        for r in df.collect():
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            out[r.source] = out.get(r.source, 0) + n
            largest[r.source] = max(largest.get(r.source, 0), n)
    # a document stays if at least half of it is taken, so each source is within its cut documents of its target
    for source, target in targets(sizes, cp.MIX, cp.ONCE).items():
        assert abs(taken.get(source, 0) - target) <= 2 * largest[source] + 0.03 * target, source
    out = cp.STAGES[-1][1](spark, docs, SF).orderBy("doc_id").collect()
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(token_store.tokenizer_path()), 0
    for r, d in zip(out, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows(spark, odd, clash, tmp_path):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    for name, rows in (("odd", clash(odd)), ("empty", odd.where("false"))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = cp.run(spark, str(tmp_path / name)).collect()
        assert all(r.n_tokens >= 1 for r in out)
