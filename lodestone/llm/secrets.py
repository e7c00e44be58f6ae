"""Secret scan: fixed forms, and strings that a battery of randomness tests takes for keys (built-in functions only).

Fixed forms are three regular expressions (assignments, access key ids, long hexadecimal runs). For everything else the
scan takes tokens of 20 or more characters from the alphabets of common encodings, infers the encoding, and tests
whether the token looks drawn evenly from that alphabet:

* chi-squared: are the symbols used evenly;
* runs: does the sequence cross the alphabet's middle as often as chance does;
* serial correlation: does a symbol say anything about the next one.

The least of the three p-values, times three, is the token's fit. Benjamini and Hochberg's procedure over the fits of all candidates says
which tokens are not drawn evenly, with a bounded share of wrong refusals; these are ordinary. The other side of the
decision is how surprising the token would be in ordinary text, where neighbours seldom differ in kind (small letter,
capital, digit) and some letters are rare: the likelihood of that text over that of even draws from the encoding's
alphabet bounds the token's p-value. It depends on the length, so short tokens need clearer signs. The same procedure
over these p-values bounds the share of false finds among the candidates. P-values are rounded up to a grid of fixed
size, so two small histograms find the thresholds. Tokens whose characters are of one kind (digits, or letters
of one case) never change kind: they are no finds, since nothing tells them from numbers and long words.

Spans are in code points, end exclusive. A null text is empty and has no spans. Rows with equal ids are scanned one by
one, extra columns are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, text_of

#: The forms. The value of an assignment is group 2, of 12 or more characters.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings in the order in which they are tried: name, the token's form, the alphabet.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: In ordinary text at most this share of neighbours differ in kind: in tokens of one case, and of both.
ORDINARY_CHANGES = (0.02, 0.05)
#: Letters by their frequency in European languages, and the share of ordinary text's letters that each part is taken to have.
LETTERS = (("etaoinsr", 0.64), ("dlcumhgbpf", 0.28), ("jkqvwxyz", 0.08))
LEAST_SHARE = 0.001
#: Shares that are allowed: of keys among the tokens refused as ordinary, and of false finds.
REFUSED_SHARE, FALSE_SHARE = 0.01, 0.01
#: Steps of the p-value grid per factor of ten, and its end.
GRID, GRID_END = 20, 30
SPAN = "struct<start:int,end:int,m:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str, block: int = 256) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches, in code points.

    Splitting at the pattern gives the gaps, extracting gives the matches; positions are running sums of both. The sums
    run within blocks of matches, and over blocks, so a text with many matches stays cheap.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def spans(gaps: Column) -> Column:
        pairs = F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            F.slice(gaps, 1, F.size(gaps) - 1),
            lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m")),
        )
        return let(pairs, in_blocks)

    def in_blocks(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(block)), lambda s: F.slice(pairs, s, F.lit(block)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), within)))

    def starts(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        width = lambda b: F.aggregate(b, F.lit(0), lambda a, p: a + p["g"] + p["n"])
        return F.aggregate(
            blocks, zero, lambda a, b: F.struct((a["at"] + width(b)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
        )

    def within(pairs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), none.alias("out"))

        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + p["g"]
            span = F.struct(begin.alias("start"), (begin + p["n"]).alias("end"), p["m"].alias("m"))
            return F.struct((begin + p["n"]).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(pairs, zero, step, lambda a: a["out"])

    return F.when(text.rlike(pattern), let(F.split(text, pattern), spans)).otherwise(none)


def upper_normal(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def encoding_of(token: Column, pick: int) -> Column:
    """Of the first encoding whose form the token has: the name (pick 0) or the alphabet (pick 2)."""
    out = F.lit(None).cast("string")
    for e in reversed(ENCODINGS):
        out = F.when(token.rlike(e[1]), F.lit(e[pick])).otherwise(out)
    return out


def p_chi(x: Column, k: Column) -> Column:
    """Are the symbols used evenly? Chi-squared of k - 1 degrees by Wilson and Hilferty's cube root."""
    n = F.size(x).cast("double")
    counts = F.transform(F.array_distinct(x), lambda s: F.size(F.filter(x, lambda y: y == s)).cast("double"))
    chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) - n
    spread = 2.0 / (9.0 * (k - 1))
    return upper_normal((F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1.0 - spread)) / F.sqrt(spread))


def _next(x: Column) -> Column:
    return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def p_runs(x: Column, k: Column) -> Column:
    """Wald and Wolfowitz's runs above and below the middle of the alphabet; one side only, or none: zero."""
    n = F.size(x).cast("double")
    is_high = F.transform(x, lambda s: s * 2 >= k)

    def of(high: Column) -> Column:
        h = F.size(F.filter(high, lambda b: b)).cast("double")
        runs = F.size(F.filter(_next(high), lambda p: p["a"] != p["b"])).cast("double") + 1
        mean = 2 * h * (n - h) / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        return F.when((h == 0) | (h == n), F.lit(0.0)).otherwise(2 * upper_normal(F.abs(runs - mean) / spread))

    return let(is_high, of)


def p_serial(x: Column, k: Column) -> Column:
    """Does a symbol say anything about the next? All symbols equal: zero."""
    n = F.size(x).cast("double")

    def of(mean: Column) -> Column:
        var = F.aggregate(x, F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean))
        cov = F.aggregate(_next(x), F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
        return F.when(var == 0, F.lit(0.0)).otherwise(2 * upper_normal(F.abs(F.try_divide(cov, var) + 1.0 / n) * F.sqrt(n)))

    return let(F.aggregate(x, F.lit(0.0), lambda a, s: a + s) / n, of)


def p_random(token: Column) -> Column:
    """The least p-value of the three tests, for three tests; null where no encoding fits."""
    body = F.regexp_replace(F.translate(token, "_-", "/+"), "=+$", "")

    def with_alphabet(abc: Column) -> Column:
        folded = F.when(F.upper(abc) == abc, F.upper(body)).otherwise(body)
        symbols = F.transform(F.array_remove(F.split(folded, ""), ""), lambda ch: (F.call_function("instr", abc, ch) - 1).cast("double"))
        k = F.length(abc).cast("double")
        return let(symbols, lambda x: F.least(F.lit(1.0), 3.0 * F.least(p_chi(x, k), p_runs(x, k), p_serial(x, k))))

    return let(encoding_of(token, 2), lambda abc: F.when(abc.isNotNull(), with_alphabet(abc)))


def drawn(abc: str) -> tuple[float, list[float]]:
    """For symbols drawn evenly from an alphabet: the chance that neighbours differ in kind, and of a letter to be in each of LETTERS."""
    kinds = [sum(c.islower() for c in abc), sum(c.isupper() for c in abc), sum(c.isdigit() for c in abc)]
    letters = [c.lower() for c in abc if c.isalpha()]
    return (sum(kinds) ** 2 - sum(k * k for k in kinds)) / len(abc) ** 2, [sum(c in part for c in letters) / max(len(letters), 1) for part, _ in LETTERS]


def p_ordinary(token: Column) -> Column:
    """A bound on the chance that ordinary text looks as much like even draws from the token's alphabet: one over the likelihood ratio of the two.

    The ratio is that of the neighbours' changes of kind, times that of the letters. By Markov's inequality, ordinary text exceeds a
    ratio r with a chance of 1 / r at most. One without changes of kind is ordinary.
    """
    pairs = F.greatest(F.length(token) - 1, F.lit(1)).cast("double")
    changes = F.regexp_count(token, F.lit(r"(?<=[a-z])[A-Z0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z])[0-9a-z]")).cast("double")
    letters = [F.regexp_count(F.lower(token), F.lit(f"[{part}]")).cast("double") for part, _ in LETTERS]

    def ratio(abc: str) -> Column:
        usual = ORDINARY_CHANGES[0 if abc.upper() == abc else 1]
        change, shares = drawn(abc)
        change = min(max(change, LEAST_SHARE), 1 - LEAST_SHARE)
        parts = [n * math.log(max(share, LEAST_SHARE) / text) for n, share, (_, text) in zip(letters, shares, LETTERS, strict=True)]
        return sum(parts, changes * math.log(change / usual) + (pairs - changes) * math.log((1 - change) / (1 - usual)))

    out = F.lit(0.0)
    for _, form, abc in reversed(ENCODINGS):
        out = F.when(token.rlike(form), ratio(abc)).otherwise(out)
    return F.when(changes == 0, F.lit(1.0)).otherwise(F.exp(-F.greatest(out, F.lit(0.0))))


def grid_step(p: Column) -> Column:
    """The step of the p-value grid: p <= 10 ** (-step / GRID)."""
    return F.least(F.lit(GRID * GRID_END), F.floor(-F.log10(F.greatest(p, F.lit(10.0**-GRID_END))) * GRID)).cast("int")


def discovery_step(histogram: list[tuple[int, int]], share: float = FALSE_SHARE) -> int:
    """Benjamini and Hochberg over (step, number of tokens): tokens at this step or beyond are found."""
    total, above, best = sum(n for _, n in histogram), 0, GRID * GRID_END + 1
    for step, n in sorted(histogram, reverse=True):
        above += n
        if total * 10 ** (-step / GRID) <= share * above:
            best = step
    return best


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """One row per document: id, base and found, both array<struct<start, rank, end>> in order; rank is the kind's place in KINDS."""
    t = F.col("_t")
    rows = df.select(F.col(id_col).alias("_id"), text_of(text).alias("_t"))
    group2 = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 12
    ranked = lambda spans, rank: F.transform(spans, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"]))
    rows = rows.select(
        "_id",
        ranked(F.filter(match_spans(t, ASSIGN), group2), 0).alias("a"),
        ranked(match_spans(t, ACCESS), 1).alias("k"),
        ranked(match_spans(t, HEX), 2).alias("h"),
        match_spans(t, CANDIDATE).alias("c"),
    )
    rows = rows.select("_id", F.sort_array(F.concat("a", "k", "h")).alias("base"), "c")
    apart = F.filter("c", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.select("_id", "base", apart.alias("c"))
    judged = F.transform(
        "c", lambda s: F.struct(s["start"], s["end"], grid_step(p_random(s["m"])).alias("fit"), grid_step(p_ordinary(s["m"])).alias("step"))
    )
    rows = materialize(rows.select("_id", "base", F.filter(judged, lambda s: s["fit"].isNotNull()).alias("c")), "secrets")
    # At most GRID * GRID_END + 1 rows of either kind, whatever the corpus.
    steps = F.explode(F.flatten(F.transform("c", lambda s: F.array(F.struct(F.lit("fit").alias("kind"), s["fit"].alias("at")), F.struct(F.lit("step").alias("kind"), s["step"].alias("at"))))))
    histogram = rows.select(steps.alias("s")).groupBy("s.kind", "s.at").agg(F.count("*").alias("n")).collect()
    refused, least = (discovery_step([(r["at"], r["n"]) for r in histogram if r["kind"] == kind], part) for kind, part in (("fit", REFUSED_SHARE), ("step", share)))
    found = F.filter("c", lambda s: (s["fit"] < refused) & (s["step"] >= least))
    return rows.select(F.col("_id").alias(id_col), "base", F.sort_array(F.concat("base", ranked(found, 3))).alias("found"))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def secret_report(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    of_kind = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scan(df, id_col, text).select(
        id_col, of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(render(F.col("base")).cast("binary"), 256).alias("base_sha256"), render(F.col("found")).alias("spans"),
    )
