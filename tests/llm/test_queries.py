"""The registered queries on the smallest tables, and every operator on the awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import chat, exact, langid, minhash, mixing, queries, repeats, textops, tiling, toxicity, urls

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(300)]


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- queries -------------------------------------------------------------------


def test_toxicity_query(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, SF).collect()}
    known = documents()
    assert set(rows) == {d["doc_id"] for d in known}
    for d in known:
        r = rows[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    texts = {}
    for d in known:  # equal texts have equal scores, whatever else their rows hold
        texts.setdefault(d["text"] or "", set()).add(rows[d["doc_id"]].score)
    assert all(max(s) - min(s) < 1e-5 for s in texts.values())


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(5)
    vile = ["vile", "nasty", "awful"]
    rows = [(i, prose(rng, 40) + (f" {rng.choice(vile)}" if i % 5 == 0 else ""), "en", int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").coalesce(2)
    labels = docs.select("doc_id", "toxic")
    lies = labels.select("doc_id", F.when(textops.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    a, b = ({r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.classify(docs, toxicity.train(docs, x)).collect()} for x in (labels, lies))
    assert a == b
    held = [(a[i][1], t) for i, _, _, t in rows if a[i][2]]
    caught = sum(p for p, t in held if t) / sum(t for _, t in held)
    assert caught > 0.9 and sum(p for p, t in held if not t) / len(held) < 0.03
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert len(kept & {r[0] for r in rows if not r[3]}) > 1150 and len(kept & {r[0] for r in rows if r[3]}) < 40


def test_language_query(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op8_language_id"](spark, SF).collect()}
    known = documents()
    langs = {d["lang"] for d in known if d["lang"]}
    right = total = 0
    for d in known:
        r = rows[d["doc_id"]]
        held = zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2
        letters = any(c.isalpha() for c in d["text"] or "")
        assert r.held_out == held and (r.lang_pred in langs if letters else r.lang_pred == "und") and 0 <= r.score <= 1
        if held and letters and d["lang"] and len(d["text"]) > 100:
            total += 1
            right += r.lang_pred == d["lang"]
    assert total > 20 and right / total > 0.95


def test_repeats_query(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_suffix_array_dedup"](spark, SF).collect()}
    first = {}
    for d in sorted(documents(), key=lambda d: d["doc_id"]):
        b = (d["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first.setdefault(hashlib.blake2b(b[p : p + 50], digest_size=12).digest(), d["doc_id"]) < d["doc_id"]:
                gone[p : p + 50] = True
        r = rows[d["doc_id"]]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == int(gone[:1].sum()) + int((gone[1:] > gone[:-1]).sum())


def components_by_force(texts):
    """(sizes of the shingle sets, smallest id reachable) of texts by id."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_query(spark):
    rows = queries.QUERIES["op1_minhash_near_dedup"](spark, SF).collect()
    want = components_by_force({d["doc_id"]: d["text"] for d in documents()})
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_no_banded_pair_at_the_limit_falls_under_the_sketch_bound():
    """Pairs at a similarity of just 0.75: how many of 128 coordinates agree, and how many share a band."""
    rng = np.random.default_rng(3)
    parts, first = [], [0]
    for _ in range(1500):
        n = int(rng.integers(8, 400)) * 7
        x = rng.integers(0, 2**63, n * 8 // 7, dtype=np.uint64)
        parts += [x[:n], x[n // 7 :]]  # 6 of 8 sevenths are shared
        first += [first[-1] + n, first[-1] + n + len(x) - n // 7]
    s = minhash.sketch(np.concatenate(parts), np.array(first))
    agree = s[::2] == s[1::2]
    assert agree.sum(axis=1).min() >= minhash._AGREE
    assert agree.reshape(1500, -1, minhash.BAND_ROWS).all(axis=2).any(axis=1).all()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {d["doc_id"]: d for d in documents()}
    at, ids = docs, set(known)
    for name, stage in corpus_pipeline.STAGES:
        if name == "source_mixing":  # few domains: the many of the tables take minutes to compile
            at = at.withColumn("source", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(3))))
        out = stage(spark, at, SF).collect()
        now = {r.doc_id for r in out}
        assert now <= ids
        if name != "source_mixing":
            assert at.columns == docs.columns and len(out) == len(now) and all(r.text == known[r.doc_id]["text"] for r in out)
        if name == "exact_dedup":
            best = {}
            for i in ids:
                key = exact_key(known[i]["text"])
                best[key] = max(best.get(key, i), i)
            assert now == set(best.values())
        if name == "near_dedup":
            comp = components_by_force({i: known[i]["text"] for i in ids})
            assert now == {i for i in ids if comp[i][1] == i}
        if name == "source_mixing":
            assert now == ids  # a least rate of 1 loses none
        docs.where(F.col("doc_id").isin(*now)).coalesce(2).write.parquet(str(tmp_path / name))
        at, ids = spark.read.parquet(str(tmp_path / name)), now


def exact_key(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_result_columns(spark, name):
    want = {
        "op1_minhash_near_dedup": "doc_id n_shingles component_id kept", "op3_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op5_toxicity": "doc_id held_out score predicted", "op7_url_filter": "page_id host path rule verdict", "op8_language_id": "doc_id held_out lang_pred score",
    }
    df = queries.QUERIES[name](spark, SF) if name in want else None
    assert df is None or set(want[name].split()) <= set(df.columns)


# ---- awkward inputs ------------------------------------------------------------

AWKWARD = [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (1, "other text of the same id", None), (2, None, "en"), (3, "", None), (4, " \t\n", "de"), (None, "a b c d e f", "en"), (None, None, None), (5, "é Ü ß 漢字 😀", "de"), (6, "long " * 30_000, "en"), (7, "A B C D E F", None), (8, "x" * 70, "fr"), (9, "y" + "x" * 70, "fr")]
CLASHES = ["copies", "rate", "_gone", "copy", "_id", "_text", "_y", "_lang", "row", "key", "size", "kept", "score", "found", "n", "rep", "b", "pack", "domain", "words", "_n", "_rank"]

OPERATORS = {
    "near": lambda s, d, k: minhash.near_duplicates(d),
    "decontamination": lambda s, d, k: tiling.decontaminate(d, s.createDataFrame([(0, "a b c d e f")], "item_id long, text string")),
    "repeats": lambda s, d, k: repeats.remove_repeats(d),
    "exact": lambda s, d, k: exact.exact_duplicates(d),
    "toxicity": lambda s, d, k: toxicity.classify(d, toxicity.train(d, k)),
    "mixing": lambda s, d, k: mixing.mix(d, mixing.source_labels(d, k)),
    "urls": lambda s, d, k: urls.filter_urls(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.concat(F.lit("http://x.net/de/"), F.substring("text", 1, 40)))),
    "language": lambda s, d, k: langid.identify(d, langid.train(d)),
    "chat": lambda s, d, k: chat.preference_segments(d.withColumns({"pair_id": F.col("doc_id"), "side": F.when(F.col("lang") == "en", "chosen").otherwise("rejected"), "turn": F.col("doc_id"), "role": F.col("lang")})),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame([(i, t, lang, lang) for i, t, lang in AWKWARD], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 0), (6, 1), (99, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    clashing = docs.withColumns({c: F.lit("z") for c in CLASHES})
    plain, clash = (sorted(str(r.asDict()) for r in OPERATORS[name](spark, d, labels).collect()) for d in (docs, clashing))
    assert plain == clash and plain
    if name != "chat":
        assert len(plain) == len(AWKWARD)
    empty = OPERATORS[name](spark, docs.limit(0), labels.limit(0)).collect()
    assert empty == []


def test_filters_keep_columns_whatever_their_names(spark):
    docs = spark.createDataFrame([(i, t, lang, lang) for i, t, lang in AWKWARD], "doc_id long, text string, lang string, source string").withColumns({c: F.lit("z") for c in [*CLASHES, "_keep_id", "_sha_of", "_keep_of"]})
    labels = spark.createDataFrame([(1, 0), (3, 0)], "doc_id long, toxic int")
    for kept in (exact.keep_one_each(docs), toxicity.reject_toxic(docs, labels), corpus_pipeline.near_dedup(spark, docs, SF), corpus_pipeline.decontamination(spark, docs, SF)):
        assert kept.columns == docs.columns and kept.count() > 0
    ids = sorted((r.doc_id, exact_key(r.text)) for r in exact.keep_one_each(docs).collect() if r.doc_id is not None)
    best = {}
    for i, t, _ in AWKWARD:
        best[exact_key(t)] = max(best.get(exact_key(t), -1), -1 if i is None else i)
    assert ids == sorted((i, t) for t, i in best.items())
