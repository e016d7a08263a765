import corpus_pipeline as cp
from tests.llm.test_minhash_dedup import sets

SF = "/root/testdata/sf0.001"


def kept(rows, percent=80):
    """doc_ids that stay, by comparing all pairs. rows: (doc_id, text)."""
    rows = sorted(rows)
    s, root = sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {d for i, (d, _) in enumerate(rows) if find(i) == i}


def copies():
    """Pairs of texts of 44 words, 40 shingles each, whose last 0 to 5 words differ: similarities 1, 0.951, 0.905, 0.860, 0.818, 0.778."""
    rows = []
    for k in range(6):
        words = [f"b{k}w{i}" for i in range(44)]
        rows += [(100 * k, " ".join(words)), (100 * k + 1, " ".join(words[: 44 - k] + [f"b{k}x{i}" for i in range(k)]))]
    return rows


def test_near_copies_from_four_fifths_on_go(spark, docs):
    rows = copies()
    out = {r.doc_id for r in cp.near_duplicates(spark, docs(rows), "").collect()}
    assert out == kept(rows) == {0, 100, 200, 300, 400, 500, 501}


def test_stage_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null")
    out = {r.doc_id for r in cp.near_duplicates(spark, table, SF).collect()}
    assert out == kept([(r.doc_id, r.text) for r in table.collect()])
