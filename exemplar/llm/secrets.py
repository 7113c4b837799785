"""Secret scan with Spark expressions only: base patterns and a randomness test battery.

``scan`` finds, per text, the base kinds (assign, access, hex) and, beside them,
random-looking tokens.  Every token of 20 or more characters of the base-64 alphabets
is a candidate, words included; its encoding is inferred (decimal, hex, base32, lower
case and digits, base64), and the battery tests it against that alphabet:

* chi-squared uniformity of its symbols (Wilson-Hilferty normal approximation),
* runs above and below the middle of the alphabet,
* lag-1 serial correlation of the symbol numbers.

A candidate is random if none of the three rejects randomness at ``PASS`` and
its chi-squared statistic is too small for text, whose symbols are unevenly used:
under text it is non-central with ``TEXT_EXCESS`` per symbol.  The text p-values go
through Benjamini-Hochberg control at ``RATE`` over all candidates of a length
class (powers of two), from a histogram of p-values, so short tokens need more.  Only a token
with fewer than two symbols (padding) can't be tested.

Defined results: null text is empty and has no spans; repeated rows each get their
own result; an empty table gives an empty result; the caller names the columns to
carry along, other columns are ignored.  Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Fixed values of the base patterns: kind, pattern, shortest group, which group.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
)
#: Patterns that find the same spans with less work: a run too short for the kind can hold no match that counts.
FASTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Level below which one test of the battery rejects randomness.
PASS = 0.001
#: False-discovery rate within a length class.
RATE = 0.05
#: Per symbol, how much text exceeds the chi-squared statistic of uniform symbols, by alphabet size.
TEXT_EXCESS = {10: 0.9, 16: 0.9, 32: 1.0, 36: 1.3, 64: 2.5}
_BLOCK = 64


def prefix_sums(lengths: Column) -> Column:
    """Sums of all elements before each element; blocks keep it near linear for long arrays."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_BLOCK)),
        lambda i: F.slice(lengths, i + 1, _BLOCK),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    with_base = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<base:int,block:array<int>>>").alias("out")),
        lambda acc, b: F.struct(
            (acc["at"] + total(b)).alias("at"),
            F.array_append(acc["out"], F.struct(acc["at"].alias("base"), b.alias("block"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.flatten(
        F.transform(with_base, lambda w: F.transform(w["block"], lambda _, j: w["base"] + total(F.slice(w["block"], 1, j))))
    )


def _spans(df: DataFrame, name: str, pattern: str, keep) -> DataFrame:
    """Adds array column ``name`` of (start, end, kind, value) of the matches that ``keep`` accepts."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn("_found", found)
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.transform(F.split("text", pattern, -1), lambda g: F.char_length(g))))
    steps = F.transform(F.sequence(F.lit(1), F.size("_found")), lambda i: F.get("_gaps", i - 1) + F.char_length(F.get("_found", i - 1)))
    df = df.withColumn("_steps", F.when(F.size("_found") > 0, steps))
    df = df.withColumn("_before", F.when(F.size("_found") > 0, prefix_sums(F.col("_steps"))))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("_found") - 1),
        lambda i: F.struct(
            (F.get("_before", i) + F.get("_gaps", i)).alias("start"),
            (F.get("_before", i) + F.get("_steps", i)).alias("end"),
            F.lit(name).alias("kind"),
            F.get("_found", i).alias("value"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    df = df.withColumn(name, F.when(F.size("_found") > 0, F.filter(spans, keep)).otherwise(empty))
    return df.drop("_found", "_gaps", "_steps", "_before")


def _normal_cdf(z: Column) -> Column:
    """Logistic approximation, error below 0.0002; the argument is held within +-6."""
    z = F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def _tested(value: Column) -> Column:
    """(size of the inferred alphabet, symbol numbers) of a candidate."""
    decimal = value.rlike("^[0-9]+$")
    hexa = value.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    base32 = value.rlike("^[A-Z2-7]+=*$")
    lower = value.rlike("^[a-z0-9]+$")
    size = F.when(decimal, 10).when(hexa, 16).when(base32, 32).when(lower, 36).otherwise(64)
    digits = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    alphabet = (
        F.when(hexa, F.lit("0123456789abcdef"))
        .when(base32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        .when(lower, digits)
        .otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    )
    body = F.regexp_replace(F.translate(F.when(hexa, F.lower(value)).otherwise(value), "-_", "+/"), "=+$", "")
    symbols = F.transform(F.split(body, ""), lambda c: F.position(c, alphabet) - 1)
    return F.struct(size.alias("size"), F.filter(symbols, lambda x: x >= 0).alias("symbols"))


def _battery(t: Column) -> Column:
    """``t``: (size, symbols).  Struct (n, passes, p)."""
    k = t["size"].cast("double")
    x = t["symbols"]
    n = F.size(x).cast("double")
    counts = F.transform(F.array_distinct(x), lambda s: F.size(F.filter(x, lambda y: y == s)).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n
    df = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = 1 - _normal_cdf(z_chi)
    # runs of symbols in the upper and lower half of the alphabet
    high = F.size(F.filter(x, lambda y: y * 2 >= t["size"])).cast("double")
    low = n - high
    pairs = F.sequence(F.lit(1), F.size(x) - 1)
    runs = 1 + F.size(
        F.filter(pairs, lambda i: (F.get(x, i) * 2 >= t["size"]) != (F.get(x, i - 1) * 2 >= t["size"]))
    ).cast("double")
    mean = 1 + 2 * high * low / n
    var = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    p_runs = F.when(var > 0, 2 * (1 - _normal_cdf(F.abs(runs - mean) / F.sqrt(var)))).otherwise(F.lit(0.0))
    # lag-1 serial correlation of symbol numbers
    m = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
    den = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - m) * (y - m))
    num = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (F.get(x, i) - m) * (F.get(x, i - 1) - m))
    p_serial = F.when(den > 0, 2 * (1 - _normal_cdf(F.abs(num / den + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0))
    excess = F.lit(None).cast("double")
    for size, value in TEXT_EXCESS.items():
        excess = F.when(t["size"] == size, F.lit(value)).otherwise(excess)
    p_text = _normal_cdf((chi - (df + n * excess)) / F.sqrt(2 * (df + 2 * n * excess)))
    return F.struct(
        F.size(x).alias("n"),
        ((p_chi >= PASS) & (p_runs >= PASS) & (p_serial >= PASS)).alias("passes"),
        p_text.alias("p"),
    )


def _long_enough(pattern: str, least: int, group: int):
    if group:
        return lambda s: F.char_length(F.regexp_extract(s["value"], pattern, group)) >= least
    return lambda s: F.char_length(s["value"]) >= least


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _bin(p: Column) -> Column:
    """Twentieths of a decade of p, 0 (p = 1) to 400."""
    return F.least(F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-20)))), F.lit(400)).cast("int")


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``spans``: array of (start, end, kind, value) by start, then kind as listed."""
    return _scan(docs, carry).select("_row.*", "spans")


def _scan(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``_row`` (struct of the carried columns, whatever their names) and ``spans``.

    The hits are written to the shared folder once, because the false-discovery
    threshold needs all candidates before any is decided.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in carry]).alias("_row")
    df = docs.select(row, F.coalesce(docs["text"], F.lit("")).alias("text"))
    for kind, pattern, least, group in BASE:
        keep = _long_enough(pattern, least, group)
        df = _spans(df, kind, FASTER.get(kind, pattern), keep)
    testable = lambda s: s["value"].rlike("[^=]=*[^=]")
    df = _spans(df, "random", CANDIDATE, testable)
    df = df.withColumn("_symbols", F.transform("random", lambda s: _tested(s["value"])))
    df = df.withColumn(
        "random",
        F.transform(
            "random",
            lambda s, i: F.struct(s["start"], s["end"], s["kind"], s["value"], _battery(F.get("_symbols", i)).alias("test")),
        ),
    )
    hits = written(df.drop("_symbols", "text"), "secret-hits")

    # Benjamini-Hochberg from counts: the largest bin whose candidates up to it satisfy p <= rate * rank / total
    tests = hits.select(F.explode("random").alias("r")).select("r.test.*").where("n > 1")
    bins = tests.groupBy(_length_class(F.col("n")).alias("len_class"), F.when(F.col("passes"), _bin(F.col("p"))).otherwise(0).alias("bin")).count()
    by_class = bins.groupBy("len_class").agg(F.collect_list(F.struct("bin", "count")).alias("bins"))  # 401 bins at most
    total = F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b["count"])
    rank = lambda x: F.aggregate(F.filter("bins", lambda y: y["bin"] >= x["bin"]), F.lit(0).cast("long"), lambda a, y: a + y["count"])
    accepted = F.filter("bins", lambda x: F.pow(F.lit(10.0), -x["bin"] / 20) <= RATE * rank(x) / total)
    thresholds = by_class.select("len_class", F.array_min(F.transform(accepted, lambda x: x["bin"])).alias("least"))
    # one row: a map with an entry per power of two of token lengths, so 31 entries at most
    thresholds = thresholds.where("least IS NOT NULL").agg(
        F.map_from_entries(F.collect_list(F.struct("len_class", "least"))).alias("thresholds")
    )
    df = hits.join(F.broadcast(thresholds), how="left")  # a single row
    random = F.filter(
        "random",
        lambda s: s["test"]["passes"]
        & (s["test"]["n"] > 1)
        & (_bin(s["test"]["p"]) >= F.coalesce(F.element_at("thresholds", _length_class(s["test"]["n"])), F.lit(1000))),
    )
    random = F.transform(random, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))
    order = lambda a: F.transform(a, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"], s["kind"], s["value"]))
    every = F.array_sort(F.concat(*[order(F.col(k)) for k in KINDS[:3]], order(random)))
    plain = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    return df.select("_row", F.transform(every, plain).alias("spans"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones merged) replaced by ``mark``; a null text without spans stays null."""
    found = _scan(docs, tuple(docs.columns)).withColumn("text", F.col("_row")["text"])
    spans = F.col("spans")
    some = F.size(spans) > 0
    # ends so far, and the spans that begin at or after all ends before them
    ends = F.aggregate(
        spans,
        F.array().cast("array<int>"),
        lambda acc, s: F.array_append(acc, F.greatest(s["end"], F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    df = found.withColumn("_ends", F.when(some, ends))
    heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get("_ends", i - 1)))
    df = df.withColumn("_heads", F.when(some, heads))
    before = lambda h, k: F.when(k == 0, 0).otherwise(F.get("_ends", h - 1))
    pieces = F.transform(
        "_heads", lambda h, k: F.concat(F.substring("text", before(h, k) + 1, F.get(spans, h)["start"] - before(h, k)), F.lit(mark))
    )
    rest = F.substr(F.col("text"), F.element_at("_ends", -1) + 1)
    df = df.withColumn("_new", F.when(some, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))
    out = []
    for c in docs.columns:
        old = F.col(f"_row.`{c}`")
        if c == "text":
            old = F.col("_new")
        elif c == "n_chars":
            old = F.when(some, F.char_length("_new").cast("long")).otherwise(old)
        out.append(old.alias(c))
    return df.select(*out)
