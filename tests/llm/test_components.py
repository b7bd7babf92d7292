"""Components that further links join, against a plain union-find: the links already gone through are not gone through again."""

import pytest

pytest.importorskip("pyarrow")
from quarry.llm import near_duplicates  # noqa: E402

FIRST = [(i, i + 7) for i in range(0, 300, 3)] + [(900, 901), (901, 902)]
MORE = [(0, 400), (400, 401), (1, 902), (500, 501), (7, 14), (298, 500)]


def brute(links):
    comp = {x: x for pair in links for x in pair}
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


@pytest.mark.parametrize("few", [None, 0])  # in one partition; by rounds
def test_further_links_join_components(spark, monkeypatch, few):
    gone_through, whole = [], near_duplicates.components
    monkeypatch.setattr(near_duplicates, "components", lambda links, n=None: gone_through.append(links.count()) or whole(links, n))
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    before = near_duplicates.merged(None, table(FIRST), few)
    rows = near_duplicates.merged(before, table(MORE), few).collect()
    assert {r.id: r.comp for r in rows} == brute(FIRST + MORE)
    assert len(rows) == len(brute(FIRST + MORE))
    assert gone_through == [len(FIRST), len(MORE)]


def test_release_collects_the_drivers_garbage(spark):
    from quarry.llm.common import release

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    release(spark)
    assert sum(b.getCollectionCount() for b in beans()) > before
