"""Secret scan: three fixed patterns and a randomness test battery, in DataFrame functions only.

The battery takes every run of 20 or more encoding characters, infers the
encoding (hex, base 32, 36, 62 or 64) and tests the symbols for what a random
string would show: a chi-squared test of alphabet uniformity over character
classes, a runs test about the middle of the alphabet, and a lag-one serial
correlation test. Fisher's method joins the three p-values. Ordinary words
heap up near zero, random strings spread evenly, so the share of ordinary
strings among those above a cut can be estimated from the counts (Storey's
estimator, mirrored): for each length class the cut is the lowest that keeps
that share within the false-discovery rate.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Fixed patterns of the three base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]{24,}"
#: A run of one base 64 alphabet that does not go on in the other, or else a part of a mixed run; '=' only as padding.
TOKEN = r"(?:[A-Za-z0-9_-]{20,}+(?![+/])|[A-Za-z0-9+/]{20,}+(?![_-])|[A-Za-z0-9]{20,}+)(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
KINDS = ("assign", "access", "hex", "random")

RATE = 0.05
#: Strings above the last cut that an estimate needs; the cut where not even all length classes together have as many.
LEAST, FALLBACK = 50, 0.2
LENGTHS = (20, 24, 32, 48, 64, 128)
CUTS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (name, test, alphabet); the first that fits a string is its encoding.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex upper", "^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base36 upper", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64 url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
EVERY = UPPER + LOWER + DIGITS + "+/-_"


def cell(c: str) -> int:
    """Character classes of the uniformity test."""
    if c.isdigit():
        return 0 if c < "5" else 1
    if not c.isalpha():
        return 8
    part = 0 if c.lower() in "aeiou" else 1 if c.lower() < "n" else 2
    return 2 + part + (3 if c.isupper() else 0)


CELLS = "".join(str(cell(c)) for c in EVERY)


def running(lengths: Column) -> Column:
    """Sums of the elements before each, in blocks: no step copies an array as often as it has elements."""
    block, total = 256, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def before(lengths: Column, bases: Column, i: Column) -> Column:
    block = 256
    here = F.floor(i / block).cast("int")
    inside = F.aggregate(F.slice(lengths, here * block + 1, (i % block).cast("int")), F.lit(0).cast("long"), lambda a, y: a + y)
    return F.element_at(bases, here + 1) + inside


def located(df: DataFrame, name: str, pattern: str, wanted: Column) -> DataFrame:
    """Add {name}_m, the matches of `pattern` in t, and {name}_s, their starts in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            f"{name}_m": F.when(wanted, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none),
            f"{name}_p": F.when(wanted, F.split("t", pattern, -1)).otherwise(none),
        }
    )
    m, p, n = F.col(f"{name}_m"), F.col(f"{name}_p"), F.col(f"{name}_n")
    # lengths of text between matches and of matches, in turn
    df = df.withColumn(f"{name}_n", F.flatten(F.zip_with(p, m, lambda a, b: F.array(F.char_length(F.coalesce(a, F.lit(""))).cast("long"), F.char_length(F.coalesce(b, F.lit(""))).cast("long")))))
    df = df.withColumn(f"{name}_b", running(n))
    return df.withColumn(f"{name}_s", F.transform(m, lambda _, i: before(n, F.col(f"{name}_b"), i * 2 + 1))).drop(f"{name}_p", f"{name}_n", f"{name}_b")


def _literal(values: list, quote: bool = False) -> str:
    return "array(" + ", ".join(f"'{x}'" if quote else x if isinstance(x, str) else f"{x}D" for x in values) + ")"


def battery(tokens: str) -> str:
    """SQL for the array of (p, c) of an array of strings without padding: Fisher's joint p-value, length class.

    p is null for digits alone, for strings that mix alphabets and for those too short without padding. Each nested
    transform adds one step, so nothing is computed twice.
    """
    alphabets = [a for _, _, a in ENCODINGS]
    shares = [[sum(cell(x) == c for x in a) / len(a) for c in range(9)] for a in alphabets]
    free = [sum(x > 0 for x in row) - 1.0 for row in shares]
    masks = ["0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for a in alphabets]
    encoding = f"CASE WHEN char_length(x) < {LENGTHS[0]} OR x RLIKE '^[0-9]*$' THEN NULL " + " ".join(f"WHEN x RLIKE '{test}' THEN {k}" for k, (_, test, _) in enumerate(ENCODINGS)) + " END"
    count = lambda text, piece: f"(y.n - char_length(replace({text}, '{piece}', '')))"
    # Classes without a share have no symbols in the string, so their terms are 0 / 1.
    chi = " + ".join(f"pow({count('y.cells', c)}, 2) / (y.n * if(get(y.shares, {c}) > 0, get(y.shares, {c}), 1D))" for c in range(9)) + " - y.n"
    serial = """aggregate(split(y.x, ''), named_struct('s', 0D, 'q', 0D, 'p', 0D, 'last', cast(null as double), 'first', cast(null as double)),
        (a, c) -> named_struct('s', a.s + instr(y.alphabet, c), 'q', a.q + pow(instr(y.alphabet, c), 2), 'p', a.p + coalesce(a.last, 0D) * instr(y.alphabet, c),
                               'last', cast(instr(y.alphabet, c) as double), 'first', coalesce(a.first, cast(instr(y.alphabet, c) as double))),
        a -> try_divide(a.p - a.s / y.n * (2 * a.s - a.first - a.last) + (y.n - 1) * pow(a.s / y.n, 2), nullif(a.q - a.s * a.s / y.n, 0D)) * sqrt(y.n))"""
    runs = "1 + (y.n - char_length(replace(y.bits, '01', ''))) / 2 + (y.n - char_length(replace(y.bits, '10', ''))) / 2"
    steps = [
        ("x", f"named_struct('x', x, 'n', cast(greatest(char_length(x), {LENGTHS[0]}) AS double), 'e', {encoding})"),
        (
            "y",
            f"""named_struct('x', y.x, 'n', y.n, 'alphabet', get({_literal(alphabets, True)}, y.e), 'shares', get({_literal([_literal(r) for r in shares])}, y.e), 'df', get({_literal(free)}, y.e),
                'cells', translate(y.x, '{EVERY}', '{CELLS}'), 'bits', translate(y.x, get({_literal(alphabets, True)}, y.e), get({_literal(masks, True)}, y.e)))""",
        ),
        ("y", f"named_struct('n', y.n, 'df', y.df, 'chi', {chi}, 'runs', {runs}, 'ones', {count('y.bits', 0)}, 'serial', {serial})"),
        ("y", "named_struct('n', y.n, 'df', y.df, 'chi', y.chi, 'runs', y.runs, 'mean', 2 * y.ones * (y.n - y.ones) / y.n + 1, 'serial', y.serial)"),
        (
            "y",
            """named_struct('n', y.n, 'known', y.df IS NOT NULL, 'z', array(
                (cbrt(greatest(y.chi, 0D) / y.df) - (1 - 2 / (9 * y.df))) / sqrt(2 / (9 * y.df)),
                try_divide(y.runs - y.mean, nullif(sqrt(greatest((y.mean - 1) * (y.mean - 2) / (y.n - 1), 0D)), 0D)),
                y.serial))""",
        ),
        # P(|Z| > |z|) by a rational approximation of the error function
        ("y", "named_struct('n', y.n, 'known', y.known, 'z', y.z, 't', transform(y.z, z -> 1 / (1 + 0.3275911D * abs(z) / sqrt(2D))))"),
        (
            "y",
            """named_struct('n', y.n, 'known', y.known, 'z', y.z, 'p', zip_with(y.z, y.t, (z, t) ->
                t * (0.254829592D + t * (-0.284496736D + t * (1.421413741D + t * (-1.453152027D + t * 1.061405429D)))) * exp(-z * z / 2)))""",
        ),
        # uniformity is one-sided; a test without spread (one symbol only) counts as failed
        ("y", "named_struct('n', y.n, 'known', y.known, 'p', array(if(get(y.z, 0) > 0, get(y.p, 0) / 2, 1 - get(y.p, 0) / 2), get(y.p, 1), get(y.p, 2)))"),
        ("y", "named_struct('n', y.n, 'known', y.known, 'log', aggregate(y.p, 0D, (a, p) -> a + ln(greatest(coalesce(p, 0D), 1e-12D))))"),
        # the upper tail of chi-squared with 6 degrees of freedom at -2 * log
        ("y", "named_struct('p', if(y.known, exp(y.log) * (1 - y.log + y.log * y.log / 2), NULL), 'c', " + " + ".join(f"if(y.n >= {x}, 1, 0)" for x in LENGTHS) + ")"),
    ]
    out = tokens
    for name, step in steps:
        out = f"transform({out}, {name} -> {step})"
    return out


def cuts(tested: DataFrame, rate: float) -> dict[int, float]:
    """Lowest admitted p-value by length class, from the counts over all strings (a row a class: bounded).

    A class with fewer than LEAST strings above the last cut takes the counts
    of all classes; if these are too few as well, the cut is FALLBACK and no
    rate is claimed.
    """
    p = F.col("x.p")
    counts = tested.select(F.explode_outer("tested").alias("x")).where("x.p is not null").groupBy(F.col("x.c").alias("c")).agg(*(F.count(F.when(p > t, 1)).alias(f"n{k}") for k, t in enumerate(CUTS)))
    rows = {r["c"]: np.array(r[1:], dtype=float) for r in counts.collect()}
    return {c: x for c, n in rows.items() if (x := _cut(n, sum(rows.values()), rate)) is not None}


def _cut(own: np.ndarray, every: np.ndarray, rate: float) -> float | None:
    """Lowest cut that keeps the estimated share of ordinary strings within `rate`; None if no cut does."""
    n = own if own[-1] >= LEAST else every
    if n[-1] < LEAST:
        return FALLBACK
    random = n[-1] / (1 - CUTS[-1])
    return min((t for t, x in zip(CUTS, n, strict=True) if 1 - random * (1 - t) / x <= rate), default=None)


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Secrets in every whole text of `docs` (doc_id, text), one row a document.

    Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans.
    spans lists kind:start:end in code points by start, then kind (assign,
    access, hex, random); base_sha256 is the hash of that list without random
    ones. Null and empty texts have no spans. Repeated rows are scanned once
    each, a null doc_id stays null, an empty table gives no rows.
    """
    df = spanned(docs.select("doc_id", text_of().alias("t")), rate)
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda x: F.array_join(F.transform(F.array_sort(x), lambda y: F.concat_ws(":", F.get(names, y["kind"]), y["start"].cast("string"), y["end"].cast("string"))), ",")
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(told(F.concat("assign", "access", "hex")), 256).alias("base_sha256"),
        told(F.concat("assign", "access", "hex", "random")).alias("spans"),
    )


def spanned(df: DataFrame, rate: float) -> DataFrame:
    """Add the columns assign, access, hex and random: arrays of (start, kind, end) in t."""
    df = tested_tokens(df)
    cut = cuts(df, rate)
    low = F.lower("t")
    said = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in ASSIGN_WORDS))
    df = located(df, "assign", ASSIGN, said)
    df = df.withColumn("assign_v", F.when(F.size("assign_m") > 0, F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")))
    df = located(df, "access", ACCESS, F.contains("t", F.lit("AKIA")))
    df = located(df, "hex", HEX, F.col("t").rlike(HEX))
    df = located(df, "random", TOKEN, F.size("tested") > 0)

    def spans(name: str, keep) -> Column:
        m, s, rank = F.col(f"{name}_m"), F.col(f"{name}_s"), KINDS.index(name)
        one = lambda text, i: F.struct(F.get(s, i).alias("start"), F.lit(rank).alias("kind"), (F.get(s, i) + F.char_length(text)).alias("end"))
        return F.filter(F.transform(m, lambda text, i: F.when(keep(text, i), one(text, i))), lambda x: x.isNotNull())

    admitted = F.create_map(*(F.lit(x) for kv in cut.items() for x in kv)) if cut else F.lit(None).cast("map<int,double>")
    tested = F.col("tested")
    return df.withColumns(
        {
            "assign": spans("assign", lambda _, i: F.char_length(F.get(F.col("assign_v"), i)) >= ASSIGN_LEAST),
            "access": spans("access", lambda x, _: F.char_length(x) >= ACCESS_LEAST),
            "hex": spans("hex", lambda *_: F.lit(True)),
            "random": spans("random", lambda _, i: F.coalesce(F.get(tested, i)["p"] > F.try_element_at(admitted, F.get(tested, i)["c"]), F.lit(False))),
        }
    )


def tested_tokens(df: DataFrame) -> DataFrame:
    """Add tested, the array of (p, c) for the encoding runs of t: joint p-value and length class."""
    found = F.when(F.col("t").rlike(TOKEN), F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    bare = F.transform(found, lambda x: F.rtrim(x, F.lit("=")))
    return df.withColumn("bare", bare).withColumn("tested", F.expr(battery("bare"))).drop("bare")


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret in text replaced by `mark`; rows and columns stay, n_chars (if there) follows the text.

    Spans that overlap or touch are replaced as one. Null texts stay null.
    """
    df = spanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of().alias("t")), rate)
    df = df.select("row", "t", F.array_sort(F.concat(*KINDS)).alias("all"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substr(F.col("t"), a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        more = F.when((x["start"] > a["at"]) | (a["out"] == ""), F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"].cast("int")).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("all", start, step, lambda a: F.concat(a["out"], F.substr(F.col("t"), a["at"] + 1, F.char_length("t"))))
    df = df.select("row", F.when(F.size("all") > 0, made).otherwise(F.col("row.text")).alias("new"))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("new").isNull(), F.col("row.n_chars") if "n_chars" in kinds else F.lit(None)).otherwise(F.char_length("new")).cast(kinds.get("n_chars", "long"))}
    return df.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
