import math
import random
from collections import Counter

from leafmill.llm import urls


def corpus(rng):
    tops = ["com/en/", "net/de/", "org/es/", "fr/x/"]
    rows = [(i, f"http://{rng.choice('abé')}{rng.randint(0, 9)}.{rng.choice(tops)}{''.join(rng.choice('xyzü漢😀') for _ in range(rng.randint(0, 12)))}") for i in range(300)]
    return [*rows, (300, None), (None, ""), (301, "http://a.fr"), (301, "http://a.fr")]


def brute(judged, body):
    """Score of a body from all n-grams of the judged bodies that training sees."""
    logs = {}
    for verdict in ("allow", "block"):
        grams = Counter()
        for v, b in judged:
            x = urls._shape(b)
            if v == verdict:
                grams.update(x[k : i + 1] for i in range(1, len(x)) for k in range(max(0, i - 4), i + 1))
        x, logs[verdict] = urls._shape(body), 0.0
        for i in range(1, len(x)):
            p = 1 / 128
            for k in range(i, max(0, i - 4) - 1, -1):
                after = [n for g, n in grams.items() if g[:-1] == x[k:i]]
                if after:
                    p = (grams[x[k : i + 1]] + len(after) * p) / (sum(after) + len(after))
            logs[verdict] += math.log(p)
    return (logs["allow"] - logs["block"]) / max(1, len(urls._shape(body)) - 1)


def test_scores_use_all_ngrams_whether_broadcast_or_joined(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(corpus(random.Random(3)), "page_id long, url string")
    near = urls.filter_urls(pages).collect()
    far = urls.filter_urls(pages, types=10).collect()
    key = lambda r: (r.page_id is None, r.page_id, r.host, r.path, r.rule or "", r.verdict)
    near, far = sorted(near, key=key), sorted(far, key=key)
    assert [key(r) for r in near] == [key(r) for r in far] and len(near) == 304
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(near, far, strict=True))
    bodies = spark.createDataFrame([(r.rule is not None, r.verdict, r.host + r.path) for r in near], "ruled boolean, verdict string, body string")
    judged = [(r.verdict, r.body) for r in bodies.where(F.col("ruled") & (F.pmod(F.xxhash64("body"), F.lit(5)) != 0)).collect()]
    for r in near[::30]:
        assert abs(r.score - brute(judged, r.host + r.path)) < 1e-9
