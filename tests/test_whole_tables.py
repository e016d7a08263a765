"""Plans that run over whole tables, by brute force on the small ones."""

import difflib
import re

from tessera.plans.catalogue import QUERIES
from tessera.sources.mapping import Catalogue

SF = "/root/testdata/sf0.001"


def test_missing_works_of_all_items(spark):
    items = Catalogue(spark, SF).items.select("series", "title", "size").collect()
    norm = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()

    def alike(w, t):
        return 1.0 if w == t else 0.88 if t and (t in w or w in t) else difflib.SequenceMatcher(None, w, t, autojunk=False).ratio()

    have = {}
    for r in items:
        if r["size"] > 25:
            have.setdefault(r.series, set()).add(norm(r.title))
    want = {(r.series, r.title) for r in items if r.series in have and max(alike(norm(r.title), t) for t in have[r.series]) < 0.85}
    assert {tuple(r) for r in QUERIES["missing_works"](spark, SF).collect()} == want
    assert {t.split()[1] for _, t in want} > {"anvil"}


def test_every_list_stays_or_retires(spark):
    c = Catalogue(spark, SF)
    lists, members = c.lists.collect(), {}
    for r in c.list_members.collect():
        members.setdefault(r["list"], set()).add(r.item)
    want = set()
    for nation in {r.nation for r in lists}:
        kept, *retired = sorted((r for r in lists if r.nation == nation), key=lambda r: (-r.quality, r.id))
        had, moved = members.get(kept.id, set()), set().union(*(members.get(r.id, set()) for r in retired))
        if retired:
            want.add((kept.id, len(had), len(moved - had), len(had | moved)))
    assert {tuple(r) for r in QUERIES["list_consolidation"](spark, SF).collect()} == want


def test_all_comparable_shelves(spark):
    shelves = {}
    for r in Catalogue(spark, SF).shelves.collect():
        shelves.setdefault(r.person, set()).add(r.item)
    big = {p: i for p, i in shelves.items() if len(i) >= 20}
    pairs = {(a, b) for a in big for b in big if a < b and len(big[a] & big[b]) >= 6}
    got = QUERIES["shelf_only_a_b"](spark, SF).collect()
    assert {(r.a, r.b) for r in got} == pairs and pairs
    for part, of in (("shared", lambda x, y: x & y), ("only_a", lambda x, y: x - y), ("only_b", lambda x, y: y - x)):
        mine = [r for r in got if r.part == part]
        assert all(r.item in of(big[r.a], big[r.b]) for r in mine)
        assert len(mine) == sum(min(24, len(of(big[a], big[b]))) for a, b in pairs)
