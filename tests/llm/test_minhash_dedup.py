import random
import re

import pytest

from tessera.llm import minhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(texts):
    s, root = sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 85 * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(x), find(i)) for i, x in enumerate(s)]


def corpus():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    prose = lambda n: rng.choices(vocab, k=n)
    passage = prose(30)
    texts = []
    for _ in range(25):
        base = prose(rng.choice([3, 5, 6, 40, 120]))
        texts.append(base)
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
    texts += [prose(60) + passage + prose(60) for _ in range(30)] + [passage + prose(rng.randrange(6)) for _ in range(20)]
    family = prose(80)
    for _ in range(160):  # alike, but most not enough
        copy = list(family)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(80)] = rng.choice(vocab)
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + [None, "", " \n ", "Same Words Here", "same words\there", "É é"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("limits", [{}, {"LIST": 6, "BLOCK": 20}], ids=["usual", "long-lists"])
def test_equals_brute_force(docs, clash, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(minhash_dedup, k, v)
    texts = corpus()
    got = minhash_dedup.near_duplicates(clash(docs(list(enumerate(texts))))).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == brute(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(odd, docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(odd).collect()]
    assert (1, 0, 1) in got and (2, 0, 2) in got and (5, 1, 4) in got and (4, 1, 4) in got and len(got) == 9
    assert minhash_dedup.near_duplicates(docs([])).count() == 0
