import json
import random

import pytest

from gleaner.plans import catalog, streams  # noqa: F401 (adds its queries)
from gleaner.sources import paged
from gleaner.sources.readers import MARKER, store
from tests.compare import SF, compare

ITEM = "id long, at long, name string"


class Feed:
    """Pages of a growing list; ``each`` call may put new items at the head."""

    def __init__(self, items, size, grow=0):
        self.items, self.size, self.grow, self.calls = sorted(items, key=lambda i: (i["at"] is not None, i["at"], i["id"]), reverse=True), size, grow, 0

    def page(self, number):
        self.calls += 1
        got = self.items[(number - 1) * self.size : number * self.size]
        top = self.items[0]["at"] if self.items else 0
        self.items = [{"id": -self.calls * 100 - g, "at": top + 1 + g, "name": "new"} for g in reversed(range(self.grow))] + self.items
        return got


def feed(n, size, grow=0, seed=1):
    rng = random.Random(seed)
    return Feed([{"id": i, "at": rng.randrange(n // 2 + 1), "name": f"n{i}"} for i in range(n)], size, grow)


@pytest.mark.parametrize("grow", [0, 3])
@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (5, 5), (200, 7), (90, 4)])
def test_search(n, size, grow):
    pages = feed(n, size, grow)
    keys = sorted([i["at"], i["id"]] for i in pages.items)
    for mark in [None, *keys[::40], [10**9, 0]]:
        unknown = [k for k in keys if mark is None or k > mark]
        for most in (1, 10, 10**6):
            fresh = feed(n, size, grow)
            end = paged.Listing(fresh, ["at", "id"]).end_of_run(mark, most)
            if len(unknown) >= most:
                assert end == unknown[most - 1]
            elif not grow:
                assert end == (unknown[-1] if unknown else mark)
            if end is None or end == mark:
                continue
            parts = paged.Listing(fresh, ["at", "id"]).ranges(mark, end, 4)
            assert len(parts) <= 4 + (grow > 0)
            got = []
            for low, high in parts:
                listing = paged.Listing(fresh, ["at", "id"])
                got += [k for k, _ in listing.between(low, high, listing.first_page(high))]
            held = [k for k in got if k in unknown]
            assert held == sorted([k for k in unknown if k <= end], reverse=True) and len({tuple(k) for k in got}) == len(got)


def test_driver_looks_at_few_pages():
    pages = feed(100_000, 10)
    paged.Listing(pages, ["at", "id"]).end_of_run(None, 50)
    assert pages.calls < 60


def test_items_without_key_repeats_and_order():
    rows = [{"id": 3, "at": 9}, {"id": 3, "at": 9}, {"id": None, "at": 8}, {"at": 7}, {"id": 1, "at": 2}]
    listing = paged.Listing(Feed([], 2), ["at", "id"])
    listing.client.items = rows
    assert [k for k, _ in listing.between(None, None, 1)] == [[9, 3], [2, 1]]
    assert listing.first_page([8, 0]) == 2
    listing.client.items, listing.client.size = rows[::-1], 9
    with pytest.raises(ValueError):
        list(listing.between(None, None, 1))


def land(folder, items, size):
    for n in range(0, len(items), size):
        at = folder / f"page={n // size + 1}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part-0.json").write_text("\n".join(json.dumps(i) for i in items[n : n + size]))


def test_runs_restarts_and_torn_runs(spark, tmp_path):
    items = [{"id": i, "at": 1000 - i // 2, "name": None if i % 5 else "é "} for i in range(100)]
    items.sort(key=lambda i: (i["at"], i["id"]), reverse=True)
    pages, state, checkpoint = tmp_path / "pages", str(tmp_path / "state"), str(tmp_path / "checkpoint")
    source = paged.paged_source("landed_test", paged.LandedPages)

    def run(most):
        paged.pull(spark, source, ITEM, ["at", "id"], state, checkpoint, [955, 10**9], most, path=str(pages), tasks="3")

    def runs():
        out = {}
        for r in paged.pulled(spark, state, ITEM).collect():
            out.setdefault(r.run, []).append((r.at, r.id, r.name))
        return {k: sorted(v) for k, v in out.items()}

    want = sorted((i["at"], i["id"], i["name"]) for i in items if i["at"] > 955)
    run(10)
    assert runs() == {}
    land(pages, items[60:], 9)
    run(10)
    old = [w for w in want if w[1] in {i["id"] for i in items[60:]}]
    assert runs() == {1: old[:10]}  # Run 0 found nothing.
    land(pages, items, 9)
    run(10)
    assert runs() == {1: want[:10], 2: want[10:20]}
    # A run that was torn before it was complete, with its commit missing, is done again, and then the next one.
    fs, marker = store(spark, f"{state}/v=00000002/{MARKER}")
    fs.delete(marker, True)
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    assert runs() == {1: want[:10]}
    run(10)
    assert runs()[2] == want[10:20] and sorted(sum(runs().values(), [])) == want[: 10 * len(runs())]
    run(0)
    run(0)
    assert sorted(sum(runs().values(), [])) == want


def test_query(spark):
    compare(spark, SF, catalog.QUERIES["s_paged_pull"], catalog.ORACLES["s_paged_pull"])
