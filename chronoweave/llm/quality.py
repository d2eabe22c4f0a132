"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is measured and evaluated once per document. The ledger keeps the measurements and one
integer of failure bits (bit k is rule k of RULES). A policy is a version name and the mask of the
rules it enforces: a document is kept when its failure bits and the policy's mask have no bit in
common. Policies can change without another look at the texts, and the ablation counts (what each
rule alone removes, what removing it from the policy would bring back) are aggregates over the bits.

Cases: a null text has no words and all counts 0, and fails ``few_words``; texts without words are
the same; repeated rows each give a row; an empty table gives an empty ledger; ``apply_rules`` passes
every column through, whatever its name; ``ledger`` puts its own columns in place of the input's columns of
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS

SYMBOLS = "#*$%&|<>"
NGRAM = 5

#: Bit k of the ledger is rule k. Each is a condition over the measurements, in whole numbers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("mean_word_short", "word_chars < 2 * n_words"),
    ("mean_word_long", "word_chars > 20 * n_words"),
    ("symbol_heavy", "2 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines > 3 and 2 * n_dup_lines > n_lines"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Versioned policies: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-v1": ("few_words", "repeated_windows"),
    "production-v1": ("few_words", "repeated_windows", "mean_word_short", "mean_word_long", "symbol_heavy", "duplicate_lines"),
    "production-v2": ("few_words", "repeated_windows", "mean_word_short", "mean_word_long", "symbol_heavy", "duplicate_lines", "symbol_ratio"),
    # As v2 in what it keeps: whatever fails symbol_heavy fails symbol_ratio.
    "production-v3": ("few_words", "repeated_windows", "mean_word_short", "mean_word_long", "duplicate_lines", "symbol_ratio"),
}
PRODUCTION = "production-v3"


def mask_of(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measurements to the rows, in place of columns of their names. One pass, no exchange."""
    names = [c for c in docs.columns if c not in (*MEASURES, "failures")]
    own = [f"_row_{k}" for k in range(len(names))]
    out = docs.select(F.coalesce("text", F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)])
    words = F.filter(F.split("_text", f"[{WORD_SEPARATORS}]+"), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WORD_SEPARATORS}]"))
    out = out.withColumns({"_words": words, "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": windows(F.col("_words")),
    })
    # Where no two windows are equal, which is most texts, nothing has to be put in order.
    differ = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    in_order = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(~differ, in_order))
    out = out.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(repeated(F.col("_sorted"))).cast("long"))
    # A generator of one row: filters on the measurements stay above it instead of being pushed
    # into the measuring, which would do that work again for each use.
    return out.select(*[F.col(o).alias(c) for c, o in zip(names, own)], F.inline(F.array(F.struct(*MEASURES))))


def windows(words: Column) -> Column:
    """The hash of each five neighbouring words."""
    n = F.size(words) - NGRAM + 1
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(NGRAM)]))


def repeated(sorted_windows: Column) -> Column:
    """How many words stand in windows whose hash has an equal neighbour, from (hash, position) in order."""
    def again(x: Column, k: Column) -> Column:
        below, above = F.get(sorted_windows, k - 1), F.get(sorted_windows, k + 1)
        return F.coalesce(below["h"] == x["h"], F.lit(False)) | F.coalesce(above["h"] == x["h"], F.lit(False))

    starts = F.array_sort(F.transform(F.filter(sorted_windows, again), lambda x: x["i"]))
    state = F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-NGRAM).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(NGRAM), i - a["last"])).alias("n"), i.alias("last")),
    )
    return F.coalesce(state["n"], F.lit(0))


def ledger(docs: DataFrame) -> DataFrame:
    """The rows with the measurements and ``failures``, an integer of failure bits."""
    bits = F.lit(0).cast("long")
    for k, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failures", bits)


def store(docs: DataFrame, folder: str) -> None:
    """Write the ledger without the texts. Policies and ablations then need nothing else."""
    ledger(docs).drop("text").write.parquet(folder)


def passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def apply_rules(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The input's rows and columns that the policy keeps."""
    names = docs.columns
    own = [f"_row_{k}" for k in range(len(names))]
    renamed = docs.select(F.col("text").alias("text"), *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)])
    return ledger(renamed).where(passes(policy)).select(*[F.col(o).alias(c) for c, o in zip(names, own)])


def ablations(ledger_rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept without it)."""
    mask = mask_of(policy)
    bits = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    rules = [(k, name) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    sums = ledger_rows.agg(
        F.bit_or(bits).alias("any_failed"),
        *[F.count_if(bits.bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias(f"f{k}") for k, _ in rules],
        *[F.count_if(bits == (1 << k)).alias(f"o{k}") for k, _ in rules],
    )
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), F.col(f"f{k}").alias("n_failed"), F.col(f"o{k}").alias("n_only"))
        for k, name in rules
    ])))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = ~passes("base-v1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passes(PRODUCTION)).alias("kept"), "failures",
    )


OP5_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n USING (doc_id)),
f AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
    + 8 * (word_chars > 20 * n_words)::INT + 16 * (2 * n_symbols > n_words)::INT
    + 32 * (n_lines > 3 AND 2 * n_dup_lines > n_lines)::INT + 64 * (10 * n_symbols > n_words)::INT)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failures & ~16 = 0 AS kept, failures FROM f
"""
