"""The URL models' counts are exact, however many grams there are."""

import random
from collections import Counter

import numpy as np
import pytest

from methgrid.llm import urls

RULES = [("block", "net", "/"), ("allow", "org", "/")]


def slow_scores(trained, texts):
    models = []
    for rows in trained:
        grams, contexts = Counter(), Counter()
        for t in rows:
            for at, byte in enumerate(t):
                for k in range(urls.ORDER + 1):
                    context = (k, *[None] * max(0, k - at), *t[max(0, at - k) : at])
                    grams[context, byte] += 1
                    contexts[context] += 1
        models.append((grams, contexts, Counter(c for c, _ in grams)))
    out = []
    for t in texts:
        total = 0.0
        for at, byte in enumerate(t):
            logs = []
            for grams, contexts, kinds in models:
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    context = (k, *[None] * max(0, k - at), *t[max(0, at - k) : at])
                    if contexts[context]:
                        p = (grams[context, byte] + kinds[context] * p) / (contexts[context] + kinds[context])
                logs.append(np.log(p))
            total += logs[0] - logs[1]
        out.append(total / max(1, len(t)))
    return out


def test_scores_of_many_grams_are_exact(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789ü") for _ in range(n))
    rows = [(k, f"http://{word(8)}.{r.choice(['org', 'net', 'com'])}/{word(40)}") for k in range(600)] + [(900, None), (901, "http://a.com"), (902, "http://a.org/x"), (903, "http://a.org/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.page_id: x for x in urls.judge(df, RULES).collect()}
    assert len(got) == len(rows)
    held = {x.page_id for x in df.selectExpr("page_id", "xxhash64(coalesce(substring_index(url, '://', -1), '')) AS h").collect() if x.h % urls.FOLDS == 0}
    text = {k: (x.host + x.path).encode() for k, x in got.items()}
    trained = [[text[k] for k, x in got.items() if x.rule == rule and k not in held] for rule in ("org/", "net/")]
    want = slow_scores(trained, [text[k] for k in got])
    assert [x.score for x in got.values()] == pytest.approx(want, rel=1e-9, abs=1e-9)
