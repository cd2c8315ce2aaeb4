"""Secrets in texts: three fixed patterns, then a battery of randomness tests, DataFrame functions only.

Every maximal run of 20 or more letters, digits and ``+/_-`` that no pattern covers is a candidate.
Its encoding is inferred from the signs it holds, and under that alphabet's uniform law it is
tested four ways: chi-squared over single signs, chi-squared over classes of signs, the number of
runs above and below the alphabet's middle, and the correlation of neighbours. A key passes all.

Short strings pass such tests by chance, however ordinary they are. So each candidate is also held
against a fixed law of ordinary strings: words of a language in one case or with capitals, joined by
numbers and ``+/_-``, as a chain over the kinds of signs with a frequency for each letter. If a string
follows that law, its probability under the alphabet's uniform law exceeds that under the ordinary one
t times with a probability of at most 1 / t (Markov), at every length and without an estimate. The
inverse of this ratio, times the number of alphabets, is the probability that goes into the
Benjamini-Hochberg rule in a class of lengths, which keeps the share of false reports below ``fdr`` as
far as ordinary strings follow the law.

What is never reported: strings of less than 20 signs, letters of one case alone (or with one capital
in front) and digits alone, which are words and numbers far more often than keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.spans import let, no_spans, scan
from prosemill.llm.common import materialize, text_or_empty

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets by inferred encoding, in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "letters": "abcdefghijklmnopqrstuvwxyz",
}
#: The law of ordinary strings. Kinds of signs are capitals, small letters, digits, others.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_-"]
FIRST_KIND = [0.25, 0.55, 0.1, 0.1]
NEXT_KIND = [[0.62, 0.23, 0.05, 0.1], [0.03, 0.84, 0.03, 0.1], [0.04, 0.04, 0.72, 0.2], [0.2, 0.55, 0.15, 0.1]]
#: Letters a to z in a thousand of English ones, mixed with an even share for other languages.
LETTERS = [82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 1.5, 20, 1]
EVEN_SHARE = 0.15
#: Uniform laws that an encoding is inferred from: hex and base36 in two cases, base32, base64.
UNIFORM_LAWS = 6
#: A class of lengths is a power of two; all lengths from 2 ** LONGEST are one class.
LONGEST = 12
#: A hundredth of a power of ten is the width of a bin of probabilities.
BINS, LEAST_BIN = 100, 3000


def _found(text: Column, pattern: str, may_hold: Column, good=None) -> Column:
    """``array<struct<start, end>>`` of the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches alternate, so their lengths add up to positions.
    ``good(whole, group 2)`` says which matches count.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if good else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("m"), group.alias("g"))
    end = lambda at, x: at + F.length(x["gap"]) + F.length(x["m"])

    def span(at: Column, x: Column) -> Column:
        keep = good(x["m"], x["g"]) if good else F.lit(True)
        return F.struct((at + F.length(x["gap"])).alias("start"), end(at, x).alias("end"), x["m"].alias("m"), keep.alias("keep"))

    spans = let(parts, lambda p: scan(p, F.lit(0), end, span, "struct<start:int,end:int,m:string,keep:boolean>"))
    kept = F.transform(F.filter(spans, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")))
    return F.when(may_hold, kept).otherwise(no_spans())


def _uncovered(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span; both are sorted, and candidates don't overlap.

    Sorted together, a span that begins before a candidate reaches into it if the farthest end so
    far does; one that begins inside it comes right after it.
    """
    mark = lambda c, free: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(free).alias("free"), s["end"].alias("end"), (s["m"] if free else F.lit(None).cast("string")).alias("m")))
    both = F.array_sort(F.concat(mark(candidates, True), mark(base, False)))

    def judged(all_: Column) -> Column:
        numbered = F.transform(all_, lambda s, k: F.struct(s["start"].alias("start"), s["free"].alias("free"), s["end"].alias("end"), s["m"].alias("m"), F.get(all_, k + 1).alias("next")))
        reach = lambda at, s: F.when(s["free"], at).otherwise(F.greatest(at, s["end"]))
        nothing_inside = lambda s: s["next"].isNull() | s["next"]["free"] | (s["next"]["start"] >= s["end"])
        out = lambda at, s: F.when(s["free"] & (at <= s["start"]) & nothing_inside(s), F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")))
        return F.filter(scan(numbered, F.lit(0), reach, out, "struct<start:int,end:int,m:string>"), lambda s: s.isNotNull())

    return F.when(F.size(candidates) > 0, let(both, judged)).otherwise(no_spans())


def normal_tail(z: Column) -> Column:
    """Probability that a normal variable exceeds ``z``; absolute error below 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) * 0.3989422804014327
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi_z(chi: Column, freedom: Column) -> Column:
    """A chi-squared value as a normal one (cube-root rule)."""
    scale = 2.0 / (9.0 * freedom)
    return (F.cbrt(chi / freedom) - (1 - scale)) / F.sqrt(scale)


def ordinary_law(s: Column) -> Column:
    """Natural logarithm of a candidate's probability under the law of ordinary strings."""
    numbers = lambda xs: F.split(F.lit(",".join(f"{x:.9f}" for x in xs)), ",").cast("array<double>")
    letters = [math.log((1 - EVEN_SHARE) * x / sum(LETTERS) + EVEN_SHARE / 26) for x in LETTERS]
    within = numbers([*letters, *letters, *[-math.log(10)] * 10, *[-math.log(4)] * 4])
    # Row 0 is a string's start, row k what follows a sign of kind k - 1.
    steps = numbers([math.log(x) for row in [FIRST_KIND, *NEXT_KIND] for x in row])
    signs = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit("".join(KINDS)), c) - 1)
    kind = lambda v: F.when(v < 26, 0).when(v < 52, 1).when(v < 62, 2).otherwise(3)
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("sum"))

    def add(acc: Column, v: Column) -> Column:
        return F.struct((kind(v) + 1).alias("row"), (acc["sum"] + F.get(within, v) + F.get(steps, acc["row"] * 4 + kind(v))).alias("sum"))

    return F.aggregate(signs, start, add, lambda acc: acc["sum"])


def battery(s: Column) -> Column:
    """``struct<n, encoding, ordinary, evidence, p>`` of a candidate string.

    ``evidence``: minus the decimal logarithm of the probability that an ordinary string speaks as
    much for its alphabet's uniform law. ``p``: the smallest of the four probabilities times four;
    small if it isn't random under its alphabet.
    """
    ordinary = s.rlike("^[A-Z]?[a-z]+$") | s.rlike("^[A-Z]+$")
    encoding = (
        F.when(ordinary, "letters")
        .when(s.rlike("^[0-9]+$"), F.lit(None).cast("string"))
        .when(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$"), "hex")
        .when(s.rlike("^[A-Z2-7]+$"), "base32")
        .when(s.rlike("^[a-z0-9]+$") | s.rlike("^[A-Z0-9]+$"), "base36")
        .otherwise("base64")
    )
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), encoding)
    folded = F.when(encoding.isin("hex", "base36", "letters"), F.lower(s)).otherwise(F.translate(s, "-_", "+/"))
    # Each step's values are named before the next one uses them: lambdas are the only let.
    first = F.struct(encoding.alias("e"), ordinary.alias("o"), alphabet.alias("a"), folded.alias("f"), F.length(s).cast("double").alias("n"), ordinary_law(s).alias("law"))
    return F.transform(F.array(first), _tested)[0]


def _tested(x: Column) -> Column:
    n, k = x["n"], F.length(x["a"]).cast("double")
    letters = F.filter(F.split(x["a"], ""), lambda c: c != "")
    counts = F.transform(letters, lambda c: n - F.length(F.replace(x["f"], c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * c)
    chi = _chi_z(squares * k / n - n, k - 1)
    # Classes: capitals, small letters, digits, others; vowels and consonants where there are only letters.
    where = F.when(x["e"] == "letters", F.lit("letters")).otherwise(F.lit("others"))
    left = lambda of, signs: F.length(of) - F.length(F.translate(of, signs, ""))
    sets = ["aeiou", "bcdfghjklmnpqrstvwxyz"]
    others = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/"]
    pairs = lambda group: F.array(*[F.struct(left(x["f"], g).cast("double").alias("seen"), (n * left(x["a"], g) / k).alias("due")) for g in group])
    classes = F.filter(F.when(where == "letters", pairs(sets)).otherwise(pairs(others)), lambda c: c["due"] > 0)
    class_chi = F.aggregate(classes, F.lit(0.0), lambda acc, c: acc + (c["seen"] - c["due"]) * (c["seen"] - c["due"]) / c["due"])
    class_z = F.when(F.size(classes) > 1, _chi_z(class_chi, (F.size(classes) - 1).cast("double"))).otherwise(F.lit(0.0))
    values = F.transform(F.filter(F.split(x["f"], ""), lambda c: c != ""), lambda c: F.instr(x["a"], c).cast("double") - 1)
    evidence = (-n * F.log(k) - x["law"] - math.log(UNIFORM_LAWS)) / math.log(10)
    second = F.struct(evidence.alias("evidence"), x["e"].alias("e"), x["o"].alias("o"), n.alias("n"), k.alias("k"), chi.alias("chi"), class_z.alias("cls"), values.alias("v"))
    return F.transform(F.array(second), _sequential)[0]


def _sequential(x: Column) -> Column:
    n, v = x["n"], x["v"]
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = lambda c: c >= x["k"] / 2
    above = F.size(F.filter(v, high)).cast("double")
    below = n - above
    runs = 1.0 + F.size(F.filter(pairs, lambda p: high(p["a"]) != high(p["b"])))
    due = 2 * above * below / n + 1
    spread = (due - 1) * (due - 2) / (n - 1)
    runs_z = F.when(spread > 0, (runs - due) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(40.0))
    mean = F.aggregate(v, F.lit(0.0), lambda acc, c: acc + c) / n
    around = F.aggregate(v, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
    along = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
    serial_z = F.when(around > 0, (along / F.greatest(around, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
    two = lambda z: 2 * normal_tail(F.abs(z))
    p = F.least(F.lit(1.0), 4 * F.least(normal_tail(x["chi"]), normal_tail(x["cls"]), two(runs_z), two(serial_z)))
    return F.struct(x["n"].cast("int").alias("n"), x["e"].alias("encoding"), x["o"].alias("ordinary"), x["evidence"].alias("evidence"), p.alias("p"))


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)), F.lit(LONGEST)).cast("int")


def _by_class(found: dict[int, float], key: Column, default: float) -> Column:
    """A value for each class of lengths; there are at most LONGEST of them."""
    out = F.lit(float(default))
    for k, v in sorted(found.items()):
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def find_secrets(docs: DataFrame, alpha: float = 0.01, fdr: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row of ``docs``.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start and then kind
    (assign, access, hex, random); ``base_sha256`` is the SHA-256 of that list without ``random``.
    A candidate is ``random`` if its battery's probability is above ``alpha`` and it is a discovery
    at the rate ``fdr``. Null and empty texts have no spans, and the SHA-256 of the empty list. Ids
    aren't looked at: null and repeated ids are rows of their own; other columns are ignored. An
    empty table gives an empty result.
    """
    text = F.col("t")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    assign = _found(text, ASSIGN, text.rlike("(?i)password|passwd|secret|token|api_?key"), lambda m, g: F.length(g) >= ASSIGN_LEAST)
    # A run that is too short holds no longer one, so these two may ask for the length at once.
    access = _found(text, ACCESS.replace("+", f"{{{ACCESS_LEAST - 4},}}"), text.contains("AKIA"))
    hexes = _found(text, HEX.replace("+", f"{{{HEX_LEAST},}}"), text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"))
    candidates = _found(text, CANDIDATE, text.rlike(CANDIDATE.replace(",", "")))
    rows = rows.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hexes"), candidates.alias("candidates"))
    kinds = [("assign", "assign"), ("access", "access"), ("hex", "hexes")]
    base = F.concat(
        *[
            F.transform(c, (lambda k, name: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))(k, name))
            for k, (name, c) in enumerate(kinds)
        ]
    )
    rows = rows.select("doc_id", F.array_sort(base).alias("base"), "candidates")
    free = _uncovered(F.col("candidates"), F.col("base"))
    tested = F.filter(
        F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), battery(c["m"]).alias("b"))),
        lambda c: c["b"]["encoding"].isNotNull(),
    )
    rows = materialize(rows.select("doc_id", "base", tested.alias("tested")), "secrets")

    each = rows.select(F.explode("tested.b").alias("b")).select("b.*").withColumn("cls", _length_class(F.col("n")))

    def bin_of(evidence: Column) -> Column:
        return F.least(F.greatest(F.floor(evidence * BINS), F.lit(0)), F.lit(LEAST_BIN)).cast("int")

    bins = each.where("not ordinary").groupBy("cls", bin_of(F.col("evidence")).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy("cls").orderBy(F.desc("bin"))
    ranked = bins.select("cls", "bin", F.sum("k").over(up).alias("rank"), F.sum("k").over(Window.partitionBy("cls")).alias("all"))
    least = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS))) <= fdr * F.col("rank") / F.col("all"))
    # At most LONGEST rows come to the driver, whatever the input's size.
    limits = {r["cls"]: r["bin"] for r in least.groupBy("cls").agg(F.min("bin").alias("bin")).collect()}

    def secret(c: Column) -> Column:
        b = c["b"]
        limit = _by_class(limits, _length_class(b["n"]), LEAST_BIN + 1)
        return ~b["ordinary"] & (b["p"] > alpha) & (bin_of(b["evidence"]) >= limit)

    random = F.transform(
        F.filter("tested", secret),
        lambda c: F.struct(c["start"].alias("start"), F.lit(len(kinds)).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")),
    )
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return rows.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", random))).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )
