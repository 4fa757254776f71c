import unicodedata
from collections import Counter

from leafmill.operators import audit


def test_retention_counts_characters_after_nfkc(spark):
    rows = [(1, "\uff21\uff22\uff23\u3000x", "ABC x"), (2, "\ufb01ne", "fine"), (3, "e\u0301t\u00e9", "\u00e9te\u0301"), (4, "AAB", "\uff21B"), (5, "\u3000 ", "a"), (6, "ab", None), (7, None, "a"), (8, "\u2460\u00bd", "1")]
    got = {r.id: (r.matched, r.expected) for r in audit.text_retention(spark.createDataFrame(rows, "id long, ref string, act string"), "id", "ref", "act").collect()}
    for i, a, b in rows:
        x, y = (Counter("".join(unicodedata.normalize("NFKC", t or "").split())) for t in (a, b))
        assert got[i] == (sum((x & y).values()), sum(x.values()))
