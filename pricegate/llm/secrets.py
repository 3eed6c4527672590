"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The base patterns, and the least length of group 2 of "assign". The others have
#: it in the pattern, which finds the same, as their matches are whole runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ["assign", "access", "hex", "random"]

#: What may be a random token: a run of the widest alphabet with a digit and a letter in it.
LEAST_RANDOM = 20
TOKEN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{{{LEAST_RANDOM},}}+={{0,2}}"
#: Encodings in the order tried, each with the characters it takes; a token has the first that takes it whole.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Encodings whose symbols may stand in groups with dashes between them, as in a UUID; tried first.
GROUPED = ["hex", "upper hex"]
#: Chebyshev coefficients for the complementary error function, good to 1.2e-7 of it.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: Spans of a text that are handled together.
BLOCK = 256
#: Share of false discoveries of non-randomness, and steps of -log10(p) in the counts.
FDR, STEP, TOP = 0.05, 0.02, 15.0


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _blocks(items: Column) -> Column:
    """An array cut into consecutive arrays of at most BLOCK items, none of them empty.

    What would grow with the square of a text's spans is done within blocks and over blocks.
    """
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK).cast("int"), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    return F.filter(cut, lambda b: F.size(b) > 0)


def _begins(blocks: Column, after) -> Column:
    """Where each block begins, and where the last one ends: from 0 on, ``after(at, block)`` follows each block."""
    return F.aggregate(blocks, F.array(F.lit(0)), lambda at, b: F.concat(at, F.array(after(F.element_at(at, -1), b).cast("int"))))


def _spans(text: Column, pattern: str, kind: str, keep=lambda m: m != "", group: int = 0) -> Column:
    """Array of (start, kind rank, end, token) for the leftmost matches that do not overlap.

    Splitting by the pattern gives the stretches between the matches, so a running sum of
    lengths gives their places in code points. ``keep``: condition on the match (or group).
    """
    found, between = _matches(text, pattern), F.split(text, pattern, -1)
    shown = _matches(text, pattern, group) if group else found
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("whole"), shown.alias("shown"))
    rank = F.lit(KINDS.index(kind))
    kind_of = "struct<start:int,rank:int,end:int,token:string>"
    none = F.array().cast(f"array<{kind_of}>")

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["gap"])
        end = begin + F.length(m["whole"])
        one = F.array(F.struct(begin.alias("start"), rank.alias("rank"), end.alias("end"), m["whole"].alias("token")).cast(kind_of))
        return F.struct(end.alias("at"), F.when(keep(m["shown"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        begins = _begins(blocks, lambda at, b: F.aggregate(b, at, lambda n, m: n + F.length(m["gap"]) + F.length(m["whole"])))
        within = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), within))

    return F.when(F.exists(shown, keep), _let(_let(pairs, _blocks), placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start and then kind."""
    parts = [_spans(text, ASSIGN, "assign", lambda m: F.length(m) >= LEAST_ASSIGNED, 2), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")]
    return F.array_sort(F.concat(*parts))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal law, to 1.2e-7 of its value far out, too."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + x / 2)
    series = F.lit(0.0)
    for c in reversed(ERFC):
        series = series * t + c
    tail = t * F.exp(-x * x + series) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _gamma_tail(z: Column, skew: Column) -> Column:
    """Upper tail at z of a gamma law shifted to mean 0 and scaled to variance 1, of the given positive skewness, by its cube root."""
    shape = 4 / (skew * skew)
    root = F.pow(F.greatest(1 + z / F.sqrt(shape), F.lit(0.0)), F.lit(1 / 3))
    return _normal_tail((root - 1 + 1 / (9 * shape)) * 3 * F.sqrt(shape))


def battery(token: Column) -> Column:
    """Struct (encoding, n, p) of a token: Simes' combination of three p-values of randomness.

    Uniformity: chi-squared of the symbol counts. It grows with the number of equal pairs of
    symbols, whose mean, variance and skewness under equal chances are exact for any length;
    a gamma law with these gives the tail, also for few symbols of a large alphabet. Runs:
    Wald-Wolfowitz on symbols of the upper and lower half of the alphabet. Serial: lag-one
    correlation of the symbols' places. Null where no encoding takes the token.
    """
    bare = F.rtrim(F.translate(token, "=", " "))
    whole = lambda chars: f"[{chars.replace('-', chr(92) + '-')}]+"
    grouped = lambda b: [F.when(b.rlike(f"^{whole(ALPHABETS[k])}(-{whole(ALPHABETS[k])})+$"), F.lit(k)) for k in GROUPED]
    name = lambda b: F.coalesce(*grouped(b), *[F.when(b.rlike(f"^{whole(chars)}$"), F.lit(k)) for k, chars in ALPHABETS.items()])
    known = _let(bare, lambda b: F.struct(b.alias("bare"), name(b).alias("name")))
    return _let(known, lambda t: F.when(t["name"].isNotNull(), _let(_let(_let(_let(t, _alphabet), _places), _sums), lambda s: _let(_scores(s), _combined))))


def _alphabet(t: Column) -> Column:
    found = F.coalesce(*[F.when(t["name"] == k, F.lit(v)) for k, v in ALPHABETS.items()])
    bare = F.when(t["name"].isin(*GROUPED), F.translate(t["bare"], "-", "")).otherwise(t["bare"])
    return F.struct(bare.alias("bare"), t["name"].alias("name"), found.alias("alphabet"))


def _places(t: Column) -> Column:
    """Each symbol's place in the alphabet."""
    drawn = F.transform(F.filter(F.split(t["bare"], ""), lambda c: c != ""), lambda c: F.instr(t["alphabet"], c).cast("double") - 1)
    return F.struct(drawn.alias("x"), F.length(t["alphabet"]).cast("double").alias("a"), t["name"].alias("name"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _sums(t: Column) -> Column:
    """Length, mean, symbols in the upper half, and the sum of squared symbol counts of a token."""
    x, a = t["x"], t["a"]
    # each of the sorted symbols adds 2 * (equal ones before it) + 1 to the sum of squares
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(-1.0).alias("k"), F.lit(0.0).alias("s"))
    before = lambda s, v: F.when(s["last"] == v, s["k"] + 1).otherwise(0.0)
    squares = F.aggregate(F.array_sort(x), start, lambda s, v: F.struct(v.alias("last"), before(s, v).alias("k"), (s["s"] + 1 + 2 * before(s, v)).alias("s")), lambda s: s["s"])
    n = F.size(x).cast("double")
    high = _total(F.transform(x, lambda v: (v >= a / 2).cast("double")))
    return F.struct(x.alias("x"), a.alias("a"), t["name"].alias("name"), n.alias("n"), (_total(x) / n).alias("mean"), high.alias("high"), squares.alias("squares"))


def _scores(t: Column) -> Column:
    """Of the three tests: standard score and skewness of the equal pairs, and two-sided standard scores of the others."""
    x, a, n, mean, high = t["x"], t["a"], t["n"], t["mean"], t["high"]
    q, pairs = 1 / a, n * (n - 1) / 2
    variance = pairs * q * (1 - q)
    third = variance * (1 - 2 * q) + n * (n - 1) * (n - 2) * q * q * (1 - q)
    equal = ((t["squares"] - n) / 2 - 0.5 - pairs * q) / F.sqrt(variance)  # half a pair less, as they are whole
    skew = third / (variance * F.sqrt(variance))
    after, before = F.slice(x, 2, F.size(x)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    turns = 1 + _total(F.zip_with(before, after, lambda u, v: ((u >= a / 2) != (v >= a / 2)).cast("double")))
    product = 2 * high * (n - high)
    spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9)))
    squared = _total(F.transform(x, lambda v: (v - mean) * (v - mean)))
    lagged = _total(F.zip_with(before, after, lambda u, v: (u - mean) * (v - mean)))
    serial = F.abs(lagged / F.greatest(squared, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    return F.struct(t["name"].alias("name"), n.alias("n"), equal.alias("equal"), skew.alias("skew"), (F.abs(turns - 1 - product / n) / spread).alias("runs"), serial.alias("serial"))


def _combined(t: Column) -> Column:
    two = lambda z: F.least(2 * _normal_tail(z), F.lit(1.0))
    p = F.array_sort(F.array(_gamma_tail(t["equal"], t["skew"]), two(t["runs"]), two(t["serial"])))
    simes = _let(p, lambda q: F.least(3 * q[0], 1.5 * q[1], q[2]))
    return F.struct(t["name"].alias("encoding"), t["n"].cast("int").alias("n"), simes.alias("p"))


def random_candidates(text: Column) -> Column:
    """Array of (start, rank, end, token, test) for the tokens that an encoding takes."""
    found = _spans(text, TOKEN, "random")
    tested = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), battery(s["token"]).alias("test")))
    return F.filter(tested, lambda s: s["test"].isNotNull())


def stratum(n: Column) -> Column:
    """Length class within which discoveries are controlled: lengths that differ by less than a factor of sqrt(2)."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def _step(p: Column) -> Column:
    return F.floor(F.least(-F.log10(F.greatest(p, F.lit(1e-300))), F.lit(TOP)) / STEP).cast("int")


def limits(candidates: DataFrame) -> DataFrame:
    """(stratum, least): steps of -log10(p) from which a token of the stratum counts as not random.

    Benjamini-Hochberg at FDR over all tokens of the corpus, by their counts in each step: a
    step is rejected if p at its edge is at most FDR times the share of tokens at or beyond
    it. So of the tokens that are called not random, and so not reported, FDR at most are
    random on average, at every length: what is bounded is how many random tokens are
    missed. How many of the reported ones are no secrets is not, since what else looks
    random is unknown. A stratum has at most TOP / STEP + 1 rows, and there are two for each doubling of length.
    """
    from pyspark.sql import Window

    counts = candidates.groupBy("stratum", "step").agg(F.count("*").alias("k"))
    tail = Window.partitionBy("stratum").orderBy(F.desc("step"))
    held = counts.select("stratum", "step", F.sum("k").over(tail).alias("beyond"), F.sum("k").over(Window.partitionBy("stratum")).alias("all"))
    return held.filter(F.pow(F.lit(10.0), -F.col("step") * STEP) <= FDR * F.col("beyond") / F.col("all")).groupBy("stratum").agg(F.min("step").alias("least"))


def _limits_of(rows: DataFrame) -> dict[int, int]:
    """The limits over column ``random`` of all rows: two entries at most for each doubling of length."""
    tokens = rows.filter(F.size("random") > 0).select(F.explode("random").alias("s"))
    found = limits(tokens.select(stratum(F.col("s.test.n")).alias("stratum"), _step(F.col("s.test.p")).alias("step")))
    return {r["stratum"]: r["least"] for r in found.collect()}


def _all_spans(base: Column, random: Column, limit: dict[int, int]) -> Column:
    """Base spans, and random tokens that pass the tests and touch no base span, in order."""
    least = lambda n: F.coalesce(*[F.when(stratum(n) == k, F.lit(v)) for k, v in sorted(limit.items())], F.lit(1 << 30))
    passed = F.filter(random, lambda s: _step(s["test"]["p"]) < least(s["test"]["n"]))
    zone = lambda b: F.struct(F.array_min(b["start"]).alias("start"), F.array_max(b["end"]).alias("end"), b.alias("spans"))
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    free = _let(F.transform(_blocks(base), zone), lambda zones: F.filter(passed, lambda s: ~F.exists(zones, lambda z: meets(s, z) & F.exists(z["spans"], lambda b: meets(s, b)))))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.array_sort(F.concat(plain(base), plain(free)))


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null counts as empty; a document without a match has zero counts and the hash of the empty
    string. Repeated rows give repeated results, an empty table none. The random spans rest on
    limits over the tokens of all documents.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select("doc_id", base_spans(whole).alias("base"), random_candidates(whole).alias("random")), "spans")
    limit = _limits_of(rows)
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    spans = _all_spans(F.col("base"), F.col("random"), limit)
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_line(F.col("base")).cast("binary"), 256).alias("base_sha256"), _line(spans).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each span, or run of overlapping spans; the spans are in order of start."""

    def stretch(block: Column, start: Column, end: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(acc["held"], acc["at"] - start + 1, s["start"] - acc["at"])
            out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mask)))
            return F.struct(acc["held"].alias("held"), F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        begin = F.struct(F.substring(text, start + 1, end - start).alias("held"), start.alias("at"), F.lit("").alias("out"))
        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    def joined(t: Column) -> Column:
        n = F.size(t["blocks"])
        bounds = F.zip_with(F.slice(t["begins"], 1, n), F.slice(t["begins"], 2, n), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
        parts = F.zip_with(t["blocks"], bounds, lambda b, x: stretch(b, x["start"], x["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(t["begins"], -1) + 1, F.length(text)))

    begins = lambda blocks: F.struct(blocks.alias("blocks"), _begins(blocks, lambda at, b: F.greatest(at, F.array_max(b["end"]))).alias("begins"))
    return _let(_let(_blocks(spans), begins), joined)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; n_chars, if there, follows the text.

    All rows and columns stay; a text without secrets, or null, is left as it is. Spans that
    overlap are masked as one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    held = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc")  # so that no column of theirs is one of ours
    found = stored(docs.select(held, base_spans(whole).alias("base"), random_candidates(whole).alias("random")), "found")
    rows = found.select("doc", _all_spans(F.col("base"), F.col("random"), _limits_of(found)).alias("spans"))
    own, hit = F.col("doc")[text], F.size("spans") > 0
    new = {c: F.col("doc")[c] for c in docs.columns}
    new[text] = F.when(hit, _masked(own, F.col("spans"), mask)).otherwise(own)
    rows = rows.select("doc", "spans", new[text].alias("masked"))
    new[text] = F.col("masked")
    if "n_chars" in new:
        new["n_chars"] = F.when(hit, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return rows.select(*[v.alias(c) for c, v in new.items()])
