import random

from tessera.llm import mixing


def targets(sizes, share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = sum(w[s] for s in names if s not in capped)
        level = (share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)) / free if free else 0
        more = {s for s in names if s not in capped and w[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= more


def test_targets_and_takes(docs, clash, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["b", "a", "a", "a", "a", "É", "c", None, ""])) for i in range(700)]
    df = clash(docs(rows))
    got = mixing.mix(df).orderBy("doc_id").collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = targets(sizes), {}
    for r, (_, t, _, s) in zip(got, rows, strict=True):
        assert r.size == len(t.split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 3 * mixing.BLOCK, (s, taken[s], want[s])
    assert mixing.mix(df).orderBy("doc_id").collect() == got


def test_quotas_are_the_highest_quotients(spark):
    shares = [53.0, 24.0, 23.0, 23.0, 0.0, 7.5]
    df = spark.createDataFrame([("k", i, s, 30) for i, s in enumerate(shares)], "key string, shard int, share double, cap bigint")
    for seats in (0, 1, 2, 7, 40, 100):
        have = [0] * len(shares)
        for _ in range(seats):
            best = max(((s / (2 * n + 1), -i) for i, (s, n) in enumerate(zip(shares, have)) if n < 30 and s > 0), default=None)
            if best:
                have[-best[1]] += 1
        got = [r.q for r in mixing._quotas(df, seats).orderBy("shard").collect()]
        assert got == have, (seats, got, have)


def test_odd_rows(odd, docs):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([(1, None), (2, "")])).collect()] == [0, 0]
