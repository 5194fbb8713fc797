"""Word vectors by skip-gram with a Huffman tree, against slopes and paths worked out one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import docvectors as D
from topicloom.operators import skipgram as S


def paths(tree):
    """``(node, turn)`` of each word from the word up, one by one."""
    found = []
    for word in range(len(tree.word_parent)):
        node, turn, path = int(tree.word_parent[word]), int(tree.word_side[word]), []
        while node >= 0:
            path.append((node, turn))
            node, turn = int(tree.node_parent[node]), int(tree.node_side[node])
        found.append(path)
    return found


def test_huffman_paths_are_shortest():
    counts = np.array([40, 30, 20, 10, 9, 9, 5, 1, 1])
    found = paths(S.huffman(counts))
    assert len({tuple(p) for p in found}) == len(counts)
    assert sum(2.0 ** -len(p) for p in found) == 1
    # the sum of the weights of all joined pairs, smallest first
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        cost += (pair := heap.pop(0) + heap.pop(0))
        heap = sorted([*heap, pair])
    assert sum(n * len(p) for n, p in zip(counts.tolist(), found)) == cost


@pytest.mark.parametrize("top", [1, 4, 1000])
def test_step_takes_the_slopes_of_all_pairs(top):
    rng = np.random.default_rng(3)
    tree = S.huffman(np.sort(rng.integers(5, 900, 60))[::-1])
    trainer = S.Trainer(tree, 6, 11, top=top)
    trainer.node_rows[:] = rng.normal(0, 0.5, trainer.node_rows.shape)
    # one word so often that its rows go beyond the rounds of sums
    words = np.where(rng.random(300) < 0.3, 7, rng.integers(0, 60, 300))
    (run, before, after), = S.runs(words, np.array([1, 0, 120, 2, 177]), 10_000)
    rows, nodes = trainer.word_rows.astype(float), trainer.node_rows.astype(float)
    reach = np.random.default_rng([11, 0]).integers(1, S.WINDOW + 1, len(run))
    d_rows, d_nodes, path = np.zeros_like(rows), np.zeros_like(nodes), paths(tree)
    for at in range(len(run)):
        for other in range(at - min(reach[at], before[at]), at + min(reach[at], after[at]) + 1):
            if other != at:
                for node, turn in path[run[at]]:
                    wrong = 1 - turn - 1 / (1 + np.exp(-rows[run[other]] @ nodes[node]))
                    d_rows[run[other]] += wrong * nodes[node]
                    d_nodes[node] += wrong * rows[run[other]]
    trainer.step(run, before, after, 0.3)
    for got, was, slope in ((trainer.word_rows, rows, d_rows), (trainer.node_rows, nodes, d_nodes)):
        want = was + 0.3 * slope / np.sqrt(S.FIRST_SUM + (slope**2).mean(axis=1, keepdims=True))
        assert np.abs(got - want).max() < 1e-4
    assert set(np.flatnonzero(trainer.met)) == set(run[(before > 0) | (after > 0)])


def test_runs_keep_sentences_whole():
    lengths = np.array([0, 3, 2500, 1000, 0, 1, 40])
    words = np.arange(lengths.sum())
    got = [np.concatenate(x) for x in zip(*S.runs(words, lengths, 1200))]
    assert got[0].tolist() == words.tolist()
    sizes = [3, 1000, 1000, 500, 1000, 1, 40]
    assert got[1].tolist() == [i for n in sizes for i in range(n)]
    assert got[2].tolist() == [n - 1 - i for n in sizes for i in range(n)]


def test_sums_of_rows():
    rng = np.random.default_rng(5)
    at = np.where(rng.random(4000) < 0.4, 3, rng.integers(0, 900, 4000))
    rows = rng.normal(0, 1, (4000, 5))
    want = np.zeros((1000, 5))
    np.add.at(want, at, rows)
    assert np.abs(S._sum_rows(rows, at, 1000) - want).max() < 1e-9


def test_words_of_the_same_texts_come_together(spark):
    rng = np.random.default_rng(9)
    halves = [[f"{half}{i}" for i in range(12)] for half in ("left", "right")]
    texts = [(i, " ".join(rng.choice(halves[i % 2], 40)) + f" rare{i}") for i in range(400)] + [(1000, None), (1001, "!"), (1002, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = D.train_word_vectors(docs, "text", 8, partitions=2).toPandas().set_index("word")["vec"]
    assert set(found.index) == {w for half in halves for w in half}
    units = {w: np.array(v) / np.linalg.norm(v) for w, v in found.items()}
    inside = np.mean([units[a] @ units[b] for half in halves for a in half for b in half if a != b])
    across = np.mean([units[a] @ units[b] for a in halves[0] for b in halves[1]])
    assert inside > 0.8 > 0.2 > across
    # the same on every call, and each text the mean of its words
    again = D.train_word_vectors(docs, "text", 8, partitions=2)
    assert {r["word"]: r["vec"] for r in again.collect()} == {w: list(v) for w, v in found.items()}
    pooled = {r["doc_id"]: r["vec"] for r in D.pooled_vectors(docs, again, "doc_id", "text").collect()}
    assert set(pooled) == set(range(400))
    want = np.mean([found[w] for w in texts[0][1].split() if w in found.index], axis=0)
    assert np.abs(np.array(pooled[0]) - want).max() < 1e-5


def test_words_without_neighbours_keep_their_first_vectors(spark):
    docs = spark.createDataFrame([(i, "alone") for i in range(6)] + [(9, "once")], "doc_id long, text string")
    (row,) = D.train_word_vectors(docs, "text", 4, seed=3).collect()
    assert row["word"] == "alone"
    assert np.allclose(row["vec"], S.start_rows(np.array([0]), 4, 3)[0])
    with pytest.raises(ValueError, match="no word occurs"):
        D.train_word_vectors(docs.where(F.col("doc_id") == 9), "text", 4)
