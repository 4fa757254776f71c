"""Training over all labelled rows, in several shards."""

import random

from leafmill.llm import textops as T
from leafmill.llm import toxicity
from pyspark.sql import functions as F


def test_every_labelled_row_counts(spark):
    ids = spark.range(8400).where(T.fold(F.col("id"), 5) != 0).orderBy(F.xxhash64("id"))
    ids = [r.id for r in ids.collect()]
    assert len(ids) > 6400
    rng, late = random.Random(1), set(ids[6300:])  # no sample of the 6000 smallest hashes has these
    word = lambda: rng.choice("alpha beta gamma delta river stone cloud window garden paper".split())
    rows = [(i, " ".join([word() for _ in range(6)] + (["zorgblat"] if i in late else ["vile"] if n % 9 == 0 else [])), "en", int(i in late or n % 9 == 0)) for n, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"), shard_rows=1500)
    new = spark.createDataFrame([(1, "river zorgblat stone", "en"), (2, "river vile stone", "en"), (3, "river cloud stone", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.predicted for r in toxicity.classify(new, model).collect()} == {1: 1, 2: 1, 3: 0}
