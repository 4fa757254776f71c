"""The steps of op3 one after another without Spark, with limits so small that every bound is met."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from leafmill.llm import repeats as R


def brute(texts):
    owner = {}
    for doc, text in sorted(texts):
        for i in range(len(text) - 49):
            owner.setdefault(text[i : i + 50], doc)
    out = {}
    for doc, text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49):
            if owner[text[i : i + 50]] < doc:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc] = (len(text), int(gone.sum()), sum(g and not p for p, g in zip([False, *gone], gone, strict=False)), hashlib.sha256(kept).hexdigest())
    return out


def listed(batches):
    return [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def dealt(rows, schema, step):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return [x for k in sorted(by) for x in listed(step(iter([R._batch(by[k], schema)])))]


def steps(texts, buckets=5, parts=7, scans=1):
    """(fragment rows, result) of the steps; ``scans`` readers share the rows of text, in pieces."""
    docs = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.array([t.decode() for _, t in texts])], ["doc_id", "text"])
    rows = listed(R._text_batches(iter([docs])))
    cut = [len(rows) * i // scans for i in range(scans + 1)]
    keys = [k for a, b in zip(cut, cut[1:], strict=False) if a < b for k in listed(R._key_batches(buckets)(iter([R._batch(rows[a:b], R._TEXTS)])))]
    marks = dealt(keys, R._KEYS, R._mark_batches)
    schema = "pack long, kind long, at long, b long, w binary, x binary, y binary, z binary"
    parcels = [(p, 0, at, 0, *x, None) for p, at, *x in rows] + [(p, 1, at, b, *x, None, None) for p, at, b, *x in marks]

    def together(parcels):
        random.shuffle(parcels)
        return iter([R._batch(sorted(parcels, key=lambda r: r[:3]), schema)])

    fragments = listed(R._fragment_batches(buckets, parts)(together(parcels)))
    verdicts = dealt(fragments, R._FRAGMENTS, R._owner_batches)
    parcels += [(p, 2, at, b, *x) for p, at, b, *x in verdicts]
    got = {r[0]: r[1:5] for r in listed(R._cut_batches(buckets, parts)(together(parcels)))}
    return rows, fragments, got


def corpus():
    rng = random.Random(5)
    line = "this line of some sixty bytes stands in nearly all the documents"
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
    texts = [" ".join([word() for _ in range(rng.randint(0, 25))] + [line] * rng.randint(0, 2) + [word() for _ in range(rng.randint(0, 25))]) for _ in range(60)]
    texts += texts[:5] + ["a" * 300, "a" * 120, "", "short", "x" * 49]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(d, t.encode()) for d, t in zip(ids, texts, strict=True)]


@pytest.mark.parametrize("scans", [1, 3])
@pytest.mark.parametrize("heavy", [0, 4, 1 << 16])
def test_bounded_steps_give_the_results_of_brute_force(monkeypatch, heavy, scans):
    monkeypatch.setattr(R, "PACK", 4000)
    monkeypatch.setattr(R, "ROW", 700)
    monkeypatch.setattr(R, "HEAVY", heavy)
    texts = corpus()
    rows, _, got = steps(texts, scans=scans)
    assert got == brute(texts)
    longest = max(len(t) for _, t in texts)
    assert all(len(r[4]) <= max(700, longest) for r in rows) and len({r[0] for r in rows}) < len(rows)


def test_contexts_of_a_common_string_do_not_meet_in_one_task(monkeypatch):
    rng = random.Random(3)
    texts = [(i, (f"{rng.random():.30f}"[2:30] + "a very common passage that is one byte short of 50"[:49] + f"{rng.random():.30f}"[2:30]).encode()) for i in range(400)]

    def most(heavy):
        monkeypatch.setattr(R, "HEAVY", heavy)
        _, fragments, got = steps(texts)
        assert got == brute(texts)
        return max(Counter(int(k) for r in fragments for k in R._numbers(r[3], np.uint64)).values())

    monkeypatch.setattr(R, "PACK", 1000)
    assert most(1 << 16) > 100 and most(50) <= 64
