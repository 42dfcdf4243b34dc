"""The battery's statistics against plain Python, and long texts."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from methgrid.llm import secrets

BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"


def slow_statistics(x, size):
    """Chi-squared, runs and serial correlation as their textbook formulas have them."""
    n, mean = len(x), sum(x) / len(x)
    chi = sum((x.count(k) - n / size) ** 2 / (n / size) for k in range(1, size + 1))
    up = [2 * y > size for y in x]
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    around = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    return chi, sum(up), runs, around / sum((y - mean) ** 2 for y in x)


def slow_score(token, alphabet):
    x = [alphabet.index(c) + 1 for c in token]
    n, size = len(x), len(alphabet)
    chi, high, runs, serial = slow_statistics(x, size)
    f = size - 1
    z = [((chi / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))]
    expected = 2 * high * (n - high) / n + 1
    z.append((runs - expected) / math.sqrt((expected - 1) * (expected - 2) / (n - 1)))
    z.append(serial * math.sqrt(n))
    return min(1.0, 3 * min(math.erfc(abs(v) / math.sqrt(2)) for v in z))


def test_battery_against_textbook_formulas(spark):
    r = random.Random(21)
    tokens = ["".join(r.choice(BASE64) for _ in range(n)) + "+/" for n in (30, 60, 200, 700) for _ in range(15)]
    tokens += ["".join(sorted(t)) for t in tokens[:20]] + [("aB3+/" * 40)[:n] for n in (40, 100)]
    got = {x.t: x.p for x in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t")).alias("p")).collect()}
    for t in tokens:
        assert got[t] == pytest.approx(slow_score(t, secrets.ALPHABETS["base64"]), abs=0.002), t


def test_long_tokens_and_many_matches(spark):
    r = random.Random(22)
    long = "".join(r.choice(BASE64) for _ in range(40_000))
    many = " ".join(f"{k:016x}" for k in range(50_000))
    rows = [(1, f"x {long} y"), (2, many), (3, "a-" * 1000 + "1"), (4, "ab-" * 5000 + "cd"), (5, "A" * 50_000), (6, "token=" * 20_000)]
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert [(s.s, s.e) for s in got[1]] == [(2, 40_002)]
    assert [(s.s, s.e) for s in got[2]] == [(17 * k, 17 * k + 16) for k in range(50_000)]
    assert all(not [x for x in got[k] if x.k == 3] for k in (3, 5))


def test_limits_by_family_and_length():
    def rows(family, k, bins):
        return [{"one_case": family, "length_class": k, "bin": b, "candidates": c, "controls": w} for b, (c, w) in bins.items()]

    low = secrets.lowest_bins(rows(False, 4, {0: (0, 990), 1: (5, 9), 10: (400, 0)}) + rows(True, 4, {0: (400, 990), 5: (3, 10)}))
    assert low[False][4] == 1  # 400 of 405 where 1 of 1000 control tokens passes
    assert low[True][4] == secrets.BINS + 1  # the few above are what prose would give
    none = secrets.lowest_bins([])
    assert [none[False][k] == 1 for k in range(10)] == [n >= 32 for n in secrets.LENGTHS] and [none[True][k] == 1 for k in range(10)] == [n >= 64 for n in secrets.LENGTHS]


def test_keys_of_one_case_beside_words(spark):
    r = random.Random(23)
    prose = ["the", "river", "ran", "past", "old", "mill", "and", "over", "stones", "where", "children", "used", "to", "play", "every", "summer", "until", "bridge", "was", "built"]
    text = lambda: " ".join(r.choice(prose) for _ in range(150))
    key = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(130))
    rows = [(k, text()) for k in range(1500)] + [(2000 + k, f"{text()} {key()} {text()}") for k in range(60)] + [(3000 + k, f"{text()} {'-'.join(r.choice(prose) for _ in range(40))} {text()}") for k in range(60)]
    got = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(len(got[2000 + k]) for k in range(60)) >= 45
    assert not any(got[k] for k in got if k < 2000 or k >= 3000)


def test_base_columns_in_sql(spark):
    import duckdb

    from methgrid.llm import queries

    data = "/root/testdata/sf0.01"
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    want = duckdb.execute(
        f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, ?, 1), lambda x: length(x) >= 12)),
                   len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)),
                   len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16))
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM '{data}/documents.parquet')""",
        [assign],
    ).fetchall()
    got = [(x.doc_id, x.n_assign, x.n_access, x.n_hex) for x in queries.op7_secret_battery(spark, data).collect()]
    assert sorted(got) == sorted(want) and any(x[1] or x[3] for x in want)
