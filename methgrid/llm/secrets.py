"""Secret scanning by patterns and a battery of randomness tests, in DataFrame functions only.

Long runs of key characters are candidates. For each, the encoding is inferred
and three tests ask whether its symbols could be drawn evenly at random:
chi-squared uniformity over the alphabet, runs above and below the alphabet's
middle, and serial correlation. A candidate's score is the smallest p-value
times three.

How high a score must be is settled by false-discovery control, for each class
of lengths and for two families apart: candidates in one case (words, words
joined by signs, or keys of letters alone) and all others. The control group
is prose, which holds no keys: every document gives the letters of one place in
it, without long runs, squeezed to one token of a class's length, in lower case
for the first family and with each word's first letter raised for the second.
The share of control tokens above a score tells how many candidates above it
are false; ``FALSE_SHARE`` of those reported may be. A class with too few
control tokens is judged by those of shorter classes too, which pass more
often; where even these are too few (small tables, other scripts), a candidate
of at least ``ALONE`` characters passes with a score of one bin or more.

All texts are read once: spans and scores are written, and the limits and the
verdicts come from that table. Time grows in proportion to a token's length and
nearly so to the number of matches.

Cases: null and empty texts have no spans; repeated rows get equal spans; equal
starts sort by kind; an empty table gives an empty result; columns whose names
clash with the results are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methgrid.llm.exprs import later, let, paired, upto
from methgrid.llm.store import keep

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
CANDIDATE = r"([A-Za-z0-9+/_=-]{16,})"
#: What a text with any assignment of 12 characters, and with any of the other three, must hold; both are cheap to look for.
ASSIGNED = r"""[:=]\x20*+["']?[A-Za-z0-9+/_.=-]{12}"""
LONG_RUN = "^(?:[A-Za-z0-9+/_=-]{0,15}+[^A-Za-z0-9+/_=-]++)*+[A-Za-z0-9+/_=-]{16}"
#: What words in one case, single or joined by signs, never hold.
NOT_ONE_CASE = "[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"
#: Hex digits in groups, as in UUIDs; digits alone may be dates. Possessive, so that long tokens need no deep recursion.
DASHED = "^(?:[0-9a-f]{2,}+(?:-[0-9a-f]{2,}+)++|[0-9A-F]{2,}+(?:-[0-9A-F]{2,}+)++)$"
PADDED = "^([^=]+)={1,6}$"
KINDS = ["assign", "access", "hex", "random"]
#: Alphabets by encoding in their own order, smallest first; a candidate has the first that holds all its symbols, padding and the dashes of grouped hex set aside.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=",
}
#: Lower ends of the classes of lengths.
LENGTHS = [16, 20, 24, 28, 32, 40, 48, 64, 96, 128]
FALSE_SHARE = 0.05
BINS = 20
#: Control tokens by which a class of lengths can be judged.
ENOUGH = 20
#: Least lengths of candidates in one case and of others that pass by their score alone where the control group is too small.
ALONE = {True: 64, False: 32}
SCORED = "array<struct<s:int,e:int,length_class:int,bin:int,one_case:boolean>>"
PLACES = "array<struct<s:int,k:int,e:int,g:string>>"


def scan_of(values: Column, op: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """Running totals of an array under ``op``, by steps of doubled width."""
    shifted = lambda a, by: F.concat(F.array_repeat(neutral, by), F.slice(a, F.lit(1), F.size(a) - by))
    widths = lambda n: F.transform(upto(F.ceil(F.log2(n.cast("double"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(widths(F.size(values)), values, lambda a, by: F.zip_with(a, shifted(a, by), op)))


def found(text: Column, pattern: str, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches whose group has ``least`` characters, as structs of start, kind's place, end and group."""
    rank = F.lit(KINDS.index(kind))

    def spans(found_: Column) -> Column:
        # what lies before and between the matches gives their places
        parts = F.zip_with(F.transform(found_["m"], lambda x: F.length(x)), F.slice(found_["p"], F.lit(1), F.size(found_["m"])), lambda n, gap: F.struct(n.alias("n"), F.length(gap).alias("gap")))
        ends = lambda z: scan_of(F.transform(z, lambda x: x["n"] + x["gap"]), lambda a, b: a + b, F.lit(0))
        placed = lambda z: F.zip_with(F.arrays_zip(z.alias("z"), found_["g"].alias("g")), ends(z), lambda x, e: F.struct((e - x["z"]["n"]).alias("s"), rank.alias("k"), e.alias("e"), x["g"].alias("g")))
        return let(parts, lambda z: F.filter(placed(z), lambda x: F.length(x["g"]) >= least))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("g"), F.split(text, pattern).alias("p"))
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.array().cast(PLACES))


def base_spans(text: Column) -> Column:
    """The pattern matches of a text, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(PLACES)
    assigned = F.when(text.rlike(ASSIGNED), found(text, ASSIGN, 12, "assign")).otherwise(none)
    rest = F.when(text.rlike(LONG_RUN), F.concat(found(text, ACCESS, 18, "access"), found(text, HEX, 16, "hex"))).otherwise(none)
    return F.sort_array(F.concat(assigned, rest))


def tail(z: Column) -> Column:
    """The two-sided tail of the normal distribution (a logistic approximation, right to 0.0002)."""
    a = F.least(F.abs(z), F.lit(30.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * a + F.lit(0.07056) * a * a * a))


def statistics(x: Column, size: Column) -> Column:
    """Over the symbols' numbers ``x``, in whole numbers: n, the sums of the numbers, of their squares and of neighbours' products, the sum of squared counts, how many lie above the alphabet's middle, and the runs above and below it. Each step per symbol is one simple function."""
    zero = F.lit(0).cast("long")
    added = lambda a, y: a + y
    count = lambda c: (F.size(x) - F.size(F.array_remove(x, c))).cast("long")
    upper = F.transform(x, lambda y: y * 2 > size)
    return let(
        upper,
        lambda up: F.struct(
            F.size(x).cast("long").alias("n"),
            F.aggregate(x, zero, added).alias("total"),
            F.aggregate(x, zero, lambda a, y: a + y * y).alias("squares"),
            F.aggregate(paired(x, later(x, 1), lambda a, b: a * b), zero, added).alias("lagged"),
            F.aggregate(F.transform(F.array_distinct(x), count), zero, lambda a, n: a + n * n).alias("counts"),
            F.size(F.array_remove(up, False)).alias("high"),
            (F.size(F.array_remove(paired(up, later(up, 1), lambda a, b: a != b), False)) + 1).alias("runs"),
            F.get(x, F.lit(0)).alias("first"),
            F.get(x, F.size(x) - 1).alias("last"),
            size.cast("double").alias("size"),
        ),
    )


def randomness(token: Column) -> Column:
    """Three times the smallest p-value of the battery, 1 at most: how well the token passes for random."""

    def encoding(symbols: Column) -> Column:
        out = F.lit(ALPHABETS["mixed"])
        for name in [*ALPHABETS][-2::-1]:
            members = ALPHABETS[name].replace("-", r"\-")
            out = F.when(symbols.rlike(f"^[{members}]+$"), ALPHABETS[name]).otherwise(out)
        return F.struct(symbols.alias("symbols"), out.alias("alphabet"))

    def battery(v: Column) -> Column:
        n, total, size, high = (v[c].cast("double") for c in ("n", "total", "size", "high"))
        chi = size / n * v["counts"] - n
        freedom = size - 1
        # Wilson and Hilferty: the cube root of chi-squared is nearly normal; too even counts speak against random as well
        z_chi = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        expected = 2 * high * (n - high) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, (v["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(30.0)
        # the products' sum about the mean, from the sums of the plain values
        mean = total / n
        around = v["lagged"] - mean * (2 * total - v["first"] - v["last"]) + (n - 1) * mean * mean
        variance = v["squares"] - mean * total
        z_serial = F.when(variance > 1e-9, around / F.greatest(variance, F.lit(1e-9)) * F.sqrt(n)).otherwise(30.0)
        return F.least(F.lit(1.0), 3 * F.least(tail(z_chi), tail(z_runs), tail(z_serial)))

    def placed(v: Column) -> Column:
        numbers = F.transform(F.split(v["symbols"], ""), lambda c: F.instr(v["alphabet"], c).cast("long"))
        return let(numbers, lambda x: let(statistics(x, F.length(v["alphabet"])), battery))

    dashed = token.rlike(DASHED) & token.rlike("[a-fA-F]")
    bare = F.when(dashed, F.replace(token, F.lit("-"), F.lit(""))).otherwise(F.regexp_replace(token, PADDED, "$1"))
    return let(bare, lambda symbols: let(encoding(symbols), placed))


def length_class(token: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(F.length(token) >= least, k).otherwise(out)
    return out


def bin_of(token: Column) -> Column:
    return F.floor(randomness(token) * BINS).cast("int")


def candidates(text: Column, base: Column) -> Column:
    """Candidates that touch no pattern match: start, end, length class, score's bin, and whether it is in one case."""

    def free(runs: Column) -> Column:
        # both lists are in order of place; the pattern match that begins last before a run's end, and the furthest end up to there, tell
        ends = scan_of(F.transform(base, lambda b: b["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
        return let(ends, lambda far: let(F.transform(base, lambda b: b["s"]), lambda starts: F.filter(runs, lambda c: let(below(starts, c["e"]), lambda n: (n == 0) | (F.get(far, n - 1) <= c["s"])))))

    runs = found(F.coalesce(text, F.lit("")), CANDIDATE, LENGTHS[0], "random")
    scored = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), length_class(c["g"]).alias("length_class"), bin_of(c["g"]).alias("bin"), (~c["g"].rlike(NOT_ONE_CASE)).alias("one_case"))
    return F.transform(let(runs, lambda r: F.when(F.size(r) > 0, free(r)).otherwise(r)), scored)


def below(starts: Column, limit: Column) -> Column:
    """How many of the sorted ``starts`` lie below ``limit``, by bisection."""
    bounds = F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts).cast("double") + 1)).cast("int"))

    def halved(a: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        return F.when(a["lo"] >= a["hi"], a).when(F.get(starts, mid) < limit, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

    return F.aggregate(steps, bounds, lambda a, _: halved(a), lambda a: a["lo"])


def control(text: Column) -> Column:
    """A text's control token: its length class, family and score's bin; null for texts with too few letters at the place that the text's hash picks."""
    draw = F.pmod(F.xxhash64(text), F.lit(1 << 30))

    def token(d: Column) -> Column:
        k = F.pmod(d, F.lit(len(LENGTHS))).cast("int")
        length = F.get(F.array(*[F.lit(x) for x in LENGTHS]), k)
        lower = F.pmod(F.floor(d / len(LENGTHS)), F.lit(2)) == 0
        room = F.greatest(F.length(text) - length * 3, F.lit(0)) + 1
        part = F.substring(text, F.pmod(F.floor(d / (2 * len(LENGTHS))), room.cast("long")).cast("int") + 1, length * 3)
        prose = F.initcap(F.regexp_replace(part, r"^\S++|\S++$|\S{16,}", ""))
        letters = F.substring(F.regexp_replace(prose, "[^A-Za-z]+", ""), F.lit(1), length)
        return F.struct(k.alias("length_class"), length.alias("length"), lower.alias("one_case"), F.when(lower, F.lower(letters)).otherwise(letters).alias("token"))

    scored = lambda v: F.when(F.length(v["token"]) == v["length"], F.struct(v["length_class"].alias("length_class"), v["one_case"].alias("one_case"), bin_of(v["token"]).alias("bin")))
    return let(draw, lambda d: let(token(d), scored))


def lowest_bins(rows: list) -> dict[bool, list[int]]:
    """For both families and each class of lengths the lowest bin whose false discoveries stay within FALSE_SHARE; BINS + 1 where none does. ``rows`` count candidates and control tokens by family, class and bin."""
    out = {}
    for family in (True, False):
        own = [r for r in rows if r["one_case"] == family]
        out[family] = []
        for k, least in enumerate(LENGTHS):
            low = k
            while low and sum(r["controls"] for r in own if low <= r["length_class"] <= k) < ENOUGH:
                low -= 1
            controls, here = [r for r in own if low <= r["length_class"] <= k], [r for r in own if r["length_class"] == k]
            n, m = sum(r["controls"] for r in controls), sum(r["candidates"] for r in here)
            best = BINS + 1
            if n < ENOUGH:
                best = 1 if least >= ALONE[family] else best
            else:
                for bin_ in range(BINS, -1, -1):
                    passed = sum(r["controls"] for r in controls if r["bin"] >= bin_) + 1  # one more than seen
                    hits = sum(r["candidates"] for r in here if r["bin"] >= bin_)
                    if hits and passed / (n + 1) * m <= FALSE_SHARE * hits:
                        best = bin_
            out[family].append(best)
    return out


def fit(detected: DataFrame) -> dict[bool, list[int]]:
    """lowest_bins() over all rows; a row for each family, class and bin comes to the driver."""
    each = detected.select(F.explode("__candidates").alias("c")).select("c.one_case", "c.length_class", "c.bin", F.lit(1).alias("candidates"), F.lit(0).alias("controls"))
    prose = detected.filter("__control IS NOT NULL").select("__control.one_case", "__control.length_class", "__control.bin", F.lit(0).alias("candidates"), F.lit(1).alias("controls"))
    counted = [x.groupBy("one_case", "length_class", "bin").agg(F.sum("candidates").alias("candidates"), F.sum("controls").alias("controls")) for x in (each, prose)]
    return lowest_bins([r for x in counted for r in x.collect()])


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those to ``carry``, else all) with ``base_spans`` and ``spans``: arrays of start, kind and end in code points, by start, then kind."""
    made = ("base_spans", "spans", "__base", "__candidates", "__control")
    rest = [c for c in (docs.columns if carry is None else carry) if c not in made]
    body = F.coalesce(docs[text], F.lit(""))
    plain = lambda base: F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    some = lambda base: F.when(body.rlike(LONG_RUN), candidates(body, base)).otherwise(F.array().cast(SCORED))
    both = let(base_spans(body), lambda base: F.struct(plain(base).alias("base"), some(base).alias("candidates")))
    detected = docs.select(*[docs[c] for c in rest], both.alias("__both"), control(body).alias("__control"))
    detected = keep(detected.select(*rest, F.col("__both.base").alias("__base"), F.col("__both.candidates").alias("__candidates"), "__control"), "detected")
    limits = fit(detected)
    one, other = (F.array(*[F.lit(x) for x in limits[family]]) for family in (True, False))
    good = F.filter("__candidates", lambda c: c["bin"] >= F.when(c["one_case"], F.get(one, c["length_class"])).otherwise(F.get(other, c["length_class"])))
    random = F.transform(good, lambda c: F.struct(c["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), c["e"].alias("e")))
    return detected.select(*rest, F.col("__base").alias("base_spans"), F.sort_array(F.concat("__base", random)).alias("spans"))


def shown(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span replaced by ``mark``; spans that overlap become one."""

    def joined(far: Column) -> Column:
        # a span that begins at or behind all earlier ends opens a new gap
        heads = F.filter(upto(F.size(spans)), lambda i: (i == 0) | (F.get(spans, i)["s"] >= F.get(far, i - 1)))
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(far, i - 1))
        gaps = F.transform(heads, lambda i: F.substring(text, before(i) + 1, F.get(spans, i)["s"] - before(i)))
        return F.concat(F.array_join(gaps, mark), F.lit(mark), F.substring(text, F.get(far, F.size(far) - 1) + 1, F.length(text)))

    ends = scan_of(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return F.when(F.size(spans) > 0, let(ends, joined)).otherwise(text)
