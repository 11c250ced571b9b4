"""Quality rules as a bitmask ledger: measured once, judged by any policy later.

``ledger`` evaluates every rule once per document and keeps the failure bits and the
measurements. A policy is a mask of rules with a version; ``verdicts`` applies one,
and ``ablations`` tells from the counts of bit patterns what each rule rejects, what
it alone rejects and what would be kept without it. DataFrame functions only; nothing
is shuffled but the counts of bit patterns.

Repeated windows are found by sorting 64-bit hashes of eight words within the
document; documents whose window hashes are all distinct skip the sort.

Defined results: null and empty texts have no words, so they fail ``short``; rows
with ids that repeat or are null are judged each; texts may be of any length; extra
columns stay in ``ledger``, and one whose name clashes with a column that is added is
kept there as ``<name>_in``; ``keep_good`` returns its input's columns as they were;
an empty table gives an empty ledger and zero counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` holds; ``bit`` never changes once published."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("short", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines and n_dup_lines >= 3"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 40 * n_words"),
)


def mask(*names: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in names)


BASE = mask("short", "repeated_windows")
# Version -> rules that reject.
POLICIES = {"base": BASE, "1": BASE | mask("symbols", "repeated_lines"), "2": BASE | mask("symbols", "repeated_lines", "short_words", "long_words")}
CURRENT = "2"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, whatever the optimizer does."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_positions(windows: Column) -> Column:
    """Sorted positions of the windows that occur twice or more."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        twin = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.transform(F.filter(s, lambda e, k: twin(e, k + 1) | ((k > 0) & twin(e, k - 1))), lambda e: e["i"])

    return F.array_sort(let(pairs, twins))


def repeat_words(hashes: Column) -> Column:
    """Number of words that windows which occur twice or more cover."""
    window = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1)))), F.lit(0), lambda a, x: a + x)

    counted = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(repeated_positions(w), covered)).otherwise(0)
    return F.when(F.size(hashes) > WINDOW, let(windows, counted)).otherwise(0)


#: What ``ledger`` and ``verdicts`` add.
ADDED = ("n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "failed", "base_failed", "kept")


def set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with the names that are needed here free: clashing columns get the first ``_in`` name that isn't taken."""
    taken = {*docs.columns, *ADDED}
    for name in docs.columns:
        if name in ADDED or name in ("_of_words", "_of_lines"):
            new = f"{name}_in"
            while new in taken:
                new += "_in"
            taken.add(new)
            docs = docs.withColumnRenamed(name, new)
    return docs


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements that rules read."""
    docs = set_aside(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), let(F.transform(w, lambda x: F.xxhash64(x)), repeat_words).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    n_chars = F.char_length(text)
    found = docs.withColumns({"_of_words": both, "_of_lines": line_counts, "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"), "n_symbols": (n_chars - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")})
    added = {f: F.col(f"{of}.{f}").cast("long") for of, fields in (("_of_words", ("n_words", "n_repeat_words")), ("_of_lines", ("n_lines", "n_dup_lines"))) for f in fields}
    return found.withColumns(added).drop("_of_words", "_of_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with measurements and ``failed``: a bit for each rule that fails."""
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0).cast("long"))
    return measured(docs).withColumn("failed", bits.cast("long"))


def verdicts(of: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` by a policy; base failures are never kept."""
    rejecting = POLICIES[version] | BASE
    return of.withColumns({"base_failed": F.col("failed").bitwiseAND(BASE) != 0, "kept": F.col("failed").bitwiseAND(rejecting) == 0})


def keep_good(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows that a policy keeps, with their columns as they were."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return verdicts(ledger(rows), version).filter("kept").select("row.*")


def ablations(of: DataFrame) -> DataFrame:
    """Per policy version and rule in it: documents it fails, it alone rejects, and kept without it."""
    counts = of.groupBy("failed").agg(F.count("*").alias("n"), F.sum(F.bit_count("failed")).alias("n_bits"))
    cases = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(r.name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(1 << r.bit).cast("long").alias("bit")) for v, m in POLICIES.items() for r in RULES if m >> r.bit & 1))
    flat = counts.withColumn("case", F.explode(cases)).select("*", "case.*")
    within = F.col("failed").bitwiseAND(F.col("mask"))
    sums = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return flat.groupBy("version", "rule").agg(sums(within.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), sums(within == F.col("bit")).alias("n_only"), sums((within == 0) | (within == F.col("bit"))).alias("n_kept_without"))
