"""Random keys pass for random in each encoding, however long they are."""

import random
import string
import uuid

from pyspark.sql import functions as F

from methgrid.llm import secrets

BASE62 = string.digits + string.ascii_letters


def test_long_random_keys_pass(spark):
    r = random.Random(9)
    alphabets = {"base62": BASE62, "base58": "".join(c for c in BASE62 if c not in "0OIl"), "base64": BASE62 + "+/", "base64url": BASE62 + "-_"}
    rows = [(f"{name} {n}", "".join(r.choice(a) for _ in range(n)) + "=" * (name == "base64")) for name, a in alphabets.items() for n in (43, 256, 1024) for _ in range(40)]
    rows += [("uuid", str(uuid.UUID(int=r.getrandbits(128), version=4))) for _ in range(60)]
    rows += [("dashed", "-".join(f"{r.getrandbits(32):08X}" for _ in range(8))) for _ in range(60)]
    df = spark.createDataFrame(rows, "kind string, token string").repartition(4)
    shares = {x.kind: x.share for x in df.groupBy("kind").agg(F.avg((secrets.randomness(F.col("token")) * secrets.BINS >= 1).cast("int")).alias("share")).collect()}
    assert min(shares.values()) >= 0.75, shares


def test_odd_tokens_have_a_score(spark):
    tokens = ["=" * 16, "a" + "=" * 15, "-" * 20, "_" * 16, "key=" + "b" * 20, "aa-bb-cc-dd-ee-ff", "2024-01-02-03-04-05", "A+b/c-d_e=f+g/h-", "a" * 10 + "=" * 6]
    got = [x.p for x in spark.createDataFrame([(t,) for t in tokens], "token string").select(secrets.randomness(F.col("token")).alias("p")).collect()]
    assert all(p is not None and 0 <= p <= 1 for p in got)
