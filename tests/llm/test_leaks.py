"""Seeds against brute force over every place of every item."""

import random
import re

import numpy as np
import pytest

from methgrid.llm import decontam, queries

BREAK = re.compile(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+")


def split(text):
    return [w for w in BREAK.split((text or "").lower()) if w]


def slow_leaks(docs, items, percent=decontam.PERCENT, window=decontam.WINDOW):
    number, out = {}, set()
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], int)
    coded = [(j, code(t)) for j, t in items]
    for i, t in docs:
        d = code(t)
        for j, x in coded:
            if len(x) < decontam.LEAST:
                continue
            w = min(window, len(x))
            for at in range(-len(x) + w, len(d) - w + 1):
                lo, hi = max(0, -at), min(len(x), len(d) - at)
                sums = np.r_[0, np.cumsum(d[at + lo : at + hi] == x[lo:hi])]
                if len(sums) > w and ((sums[w:] - sums[:-w]) * 100 >= percent * w).any():
                    out.add((i, j))
                    break
    return out


def test_recall_on_the_smallest_tables(spark):
    docs, items = (queries.table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    want = slow_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got <= want and len(got) >= 0.9 * len(want) and want


@pytest.mark.parametrize("portion", [decontam.PORTION, 64])
def test_short_items_with_changed_words(spark, monkeypatch, portion):
    monkeypatch.setattr(decontam, "PORTION", portion)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in range(3, 16)] + [(None, "null id but six words here")]
    docs = []
    for j, t in items:
        w = t.split()
        for k in range(len(w)):
            docs.append((len(docs), " ".join([word() for _ in range(r.randrange(9))] + w[:k] + ["changed"] + w[k + 1 :] + [word() for _ in range(9)])))
    docs += [(900, "and " * 300), (901, None)]
    items.append((50, "and " * 40))
    frames = [spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id"))]
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(*frames).collect()}
    assert got == slow_leaks(docs, items) and (900, 50) in got


def test_several_slices_keep_and_drop_the_same_rows(spark, monkeypatch):
    items = [(k, " ".join(f"a{k}x{j}" for j in range(20))) for k in range(12)]
    docs = [(k, t + " and more") for k, t in items] + [(None, items[0][1]), (None, "clean text of no item at all"), (77, None), (77, "")]
    frames = [spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id"))]
    whole = sorted(map(str, decontam.decontaminate(*frames).collect()))
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    assert sorted(map(str, decontam.decontaminate(*frames).collect())) == whole and len(whole) == 3
