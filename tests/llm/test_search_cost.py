import tracemalloc

import numpy as np

from twinsift.llm import hnsw


def test_a_graph_grows_by_whole_batches_and_compares_them_in_small_tiles(monkeypatch):
    rows = np.random.default_rng(4).integers(0, 2**63, (2500, 12)).astype(np.uint64)
    sizes, peaks, compare = [], [], hnsw.within_batch

    def noted(queries, *rest):
        sizes.append(len(queries))
        tracemalloc.start()
        try:
            return compare(queries, *rest)
        finally:
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    monkeypatch.setattr(hnsw, "within_batch", noted)
    hnsw.near_pairs(rows, np.arange(len(rows)), 76)
    assert sizes == [1024, 1024, 451]
    assert max(peaks) < 4e6


def test_a_batch_finds_the_nearest_of_its_earlier_members():
    rows = np.random.default_rng(5).integers(0, 2**63, (300, 12)).astype(np.uint64)
    packing, nodes = hnsw.Packing(1000, 768), np.arange(500, 800)
    got = hnsw.within_batch(rows, nodes, 16, packing)
    for i in range(300):
        apart = np.bitwise_count(rows[:i] ^ rows[i]).sum(axis=1, dtype=np.int64)
        want = np.sort(packing.keys(apart, nodes[:i], 0))[:16]
        assert (got[i, : len(want)] == want).all() and (got[i, len(want) :] == packing.empty).all()


def test_links_of_free_places_lead_nowhere():
    rows = np.random.default_rng(6).integers(0, 2**63, (4, 12)).astype(np.uint64)
    layer = np.array([[1, 0], [0, 1], [3, 2], [2, 3]], np.int32)  # the second place of every node is free
    packing = hnsw.Packing(4, 768)
    beam = hnsw.beam_search(rows, layer, rows[:1], np.array([[1, -1]]), 4, packing)
    assert sorted(packing.node(beam[beam != packing.empty]).tolist()) == [0, 1]
