"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for every text. The ledger keeps, per document, the measurements and one failure bit per rule;
policies are versioned masks over those bits, so a new policy, or the effect of leaving a rule out, is a bitwise aggregation
over the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"
SPACES = " \t\n\x0b\f\r"

#: Rules in the order of their bits. Each is a condition on the measurements that holds when the text fails.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 10 * word_chars",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
    "shouting": "2 * n_upper > n_letters",
    "few_letters": "10 * n_letters < 6 * word_chars",
}

#: Versioned policies: the rules whose failure rejects a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "word_length", "shouting", "few_letters"),
}


def mask(policy: str, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> int:
    """The bits of a policy's rules."""
    names = list(rules)
    return sum(1 << names.index(r) for r in policies[policy])


def _repeat_words(words: Column, n: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more in ``words``.

    Most texts repeat nothing and stop at the distinct count. For the others windows are sorted by their 64-bit hashes. Up to
    1,023 windows the low ten bits of the hash give way to the window's place, and one primitive sort brings equal windows
    together with their places (54 bits tell so few windows apart); of longer texts whole hash and place are sorted side by side.
    """
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        by_size = F.when(F.size(h) < 1 << 10, _covered(h, 10)).otherwise(_covered_long(h))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(by_size)

    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(_bind(hashes, covered))


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` refers to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _covered(h: Column, bits: int) -> Column:
    """Words covered by the windows of ``h`` that are there twice: the union of [p, p + 2] over their places p."""
    low = F.lit((1 << bits) - 1).cast("bigint")
    tagged = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))))

    def pairs(s: Column) -> Column:
        equal = lambda x, y: F.when(x.bitwiseXOR(y).between(0, (1 << bits) - 1), F.array(x, y))
        return F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), equal), lambda p: p.isNotNull())

    return _union(F.transform(F.array_distinct(F.flatten(_bind(tagged, pairs))), lambda x: x.bitwiseAND(low)))


def _covered_long(h: Column) -> Column:
    """As :func:`_covered`, by whole hashes."""
    tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))

    def pairs(s: Column) -> Column:
        equal = lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
        return F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), equal), lambda p: p.isNotNull())

    return _union(F.array_distinct(F.flatten(_bind(tagged, pairs))))


def _union(places: Column) -> Column:
    """The size of the union of [p, p + 2] over ``places``."""
    return _bind(F.sort_array(places), lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(3).cast("bigint"), F.coalesce(y - x, F.lit(3).cast("bigint")))), F.lit(0).cast("bigint"), lambda a, x: a + x))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` to one row of measurements per row: words, characters, symbols, lines, repeats, letters.

    A null or empty text has no words and zeros throughout. Texts of any length are measured whole. Repeated rows are
    measured each on its own; other columns of ``docs`` take no part, whatever their names. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    words = F.split(F.trim(F.col("t"), F.lit(SPACES)), SPACE)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_CHAR))
    first = base.select(
        "doc_id",
        F.when(F.col("t").rlike(WORD_CHAR), words).otherwise(F.array().cast("array<string>")).alias("words"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).cast("bigint").alias("d")))[0].alias("lines"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{L}+", ""))).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
    )
    n = F.size("words")
    return first.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).alias("n_dup_lines"),
        _repeat_words(F.col("words"), n).cast("bigint").alias("n_repeat_words"),
        F.col("lines.n").alias("n_lines"),
        "n_letters",
        "n_upper",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """Measurements with ``fail_bits``: bit i is set where rule i of ``rules`` fails. Defined for every row (see measure)."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, rule in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("fail_bits", total)


def apply_policy(rows: DataFrame, policy: str, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Adds ``kept``: no bit of the policy is set."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy, policies, rules)).cast("bigint")) == 0)


def ablations(rows: DataFrame, policy: str, policies: Mapping[str, tuple[str, ...]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """What each rule of a policy does: texts it fails, and texts that only it fails (kept again if it were left out).

    The ledger is counted by its pattern of the policy's bits; all else is bit arithmetic over the patterns, of which there are
    no more than subsets of rules. ``n`` counts the ledger's rows, ``any_bits`` and ``all_bits`` are the bitwise OR and AND over the
    rejected ones.
    """
    m = mask(policy, policies, rules)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg(F.count("*").alias("texts"))
    names = list(rules)
    counts = []
    for r in policies[policy]:
        k = names.index(r)
        counts.append(F.struct(F.lit(r).alias("rule"), F.coalesce(F.sum(F.getbit("bits", F.lit(k)) * F.col("texts")), F.lit(0)).alias("fails"), F.coalesce(F.sum(F.when(F.col("bits") == 1 << k, F.col("texts"))), F.lit(0)).alias("alone")))
    rejected = F.when(F.col("bits") != 0, F.col("bits"))
    one = patterns.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n"), F.bit_or(rejected).alias("any_bits"), F.bit_and(rejected).alias("all_bits"), F.array(*counts).alias("each"))
    return one.select("n", "any_bits", "all_bits", F.inline("each"))
