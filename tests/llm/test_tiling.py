import random

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import textops, tiling


def hashes(text):
    starts, ends, _ = textops.words(*textops.utf8(pa.array([text])))
    return textops.word_hashes(textops.utf8(pa.array([text]))[1], starts, ends)


def plainly(doc, item, least):
    """Greedy string tiling by trying all places again for each tile."""
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not in_doc[p + n] and not in_item[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        n, q, p = best
        if n < least:
            return sum(in_item)
        in_doc[p : p + n] = in_item[q : q + n] = [True] * n


@pytest.mark.parametrize("letters,hits", [(2, 1 << 20), (3, 7), (9, 50)])
def test_tiles_equal_plain_greedy_tiling(monkeypatch, letters, hits):
    monkeypatch.setattr(tiling, "_HITS", hits)
    rng = random.Random(letters)
    for _ in range(60):
        doc = [rng.choice("abcdefghi"[:letters]) for _ in range(rng.randint(0, 40))]
        item = [rng.choice("abcdefghi"[:letters]) for _ in range(rng.randint(1, 20))]
        if rng.random() < 0.5 and len(item) > 8:
            doc += item[6:] + item[:6]
        least = min(5, len(item))
        items = tiling.Items([7], [" ".join(item)], 5, 0.0)
        got = {i: covered for i, covered, _ in tiling.score(hashes(" ".join(doc)), items)}
        assert got.get(0, 0) == plainly(doc, item, least)


def test_repetitive_pairs_stay_small(monkeypatch):
    monkeypatch.setattr(tiling, "_HITS", 10_000)
    doc, items = hashes("a " * 3000), tiling.Items([1], ["a " * 400], 5, 0.6)
    assert tiling.score(doc, items) == [(0, 400, 2996 * 396)]


def test_edges(spark):
    rng = random.Random(3)
    words = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(30)) for _ in range(4)]
    bench = spark.createDataFrame([(5, words[0], 1), (3, words[0], 1), (9, "few words", 1), (10, None, 1), (None, words[1], 1)], "item_id long, text string, coverage int")
    docs = spark.createDataFrame([(1, words[0], "x"), (1, words[0], "x"), (2, None, "x"), (3, "", "x"), (4, "x few words y", "x"), (None, words[0], "x"), (6, "z " * 300_000 + words[0], "x"), (7, words[1], "x"), (8, words[2], "x")], "doc_id long, text string, item_id string")
    got = [tuple(r) for r in tiling.decontaminate(docs, bench).collect()]
    tie = (True, 3, 1.0)  # of equal coverage the smallest item
    clean = (False, None, 0.0)
    assert sorted(got, key=str) == sorted([(1, *tie), (1, *tie), (2, *clean), (3, *clean), (4, True, 9, 1.0), (None, *clean), (6, *tie), (7, *clean), (8, *clean)], key=str)
    assert tiling.decontaminate(docs.limit(0), bench).count() == 0 and tiling.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    several = tiling.decontaminate(docs, bench, block_bytes=1).collect()  # a block an item
    assert sorted(map(tuple, several), key=str) == sorted(got, key=str)
    assert np.isclose(min(r.coverage for r in several), 0)
