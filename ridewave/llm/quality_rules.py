"""Quality rules as a ledger of failure bits, in DataFrame functions only.

``ledger`` evaluates every rule once: it measures each text and sets one bit of ``failures`` for each rule the text fails,
without deciding anything.  The ledger is a narrow table that is stored; ``apply_policy`` reads decisions from its bits, so
a new policy needs no text, and ``ablations`` counts what each rule of a policy does by combining the rows of equal bits
first: at most 2**rules rows stay, whatever the number of documents.

A policy is versioned and never changed: its ``hard`` rules reject alone, ``limit`` or more of its ``soft`` rules reject together.

Words in repeated 5-word windows are found inside a row, without a shuffle: windows become numbers whose upper bits are a
hash and whose lower bits are the position, sorted as plain longs; windows whose hash bits meet a neighbour's are compared
as words.  A hash alone never decides.

Defined results: a null or empty text has all measurements 0 and fails ``few_words`` only; repeated rows give equal
results, each on its own; a null doc_id stays null; an empty table gives no rows; other columns are ignored but for those
named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.llm.common import WORD, written

WINDOW = 5
NO_BLANK = r"\x20\x09-\x0D"
NO_SYMBOLS = r"[^#*$%&|<>]+"
LETTER_WORD = rf"\p{{L}}[^{NO_BLANK}]*+"  # from a word's first letter to its end: one match a word

#: Each rule, in the order of its bit, with the condition that a text fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("no_letters", "10 * n_letter_words < 7 * n_words"),
    ("capitals", "10 * n_capitals > 3 * word_chars"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    ("few_distinct", "10 * n_distinct_words < n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capitals", "n_distinct_words")


def mask(names: Sequence[str]) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in set(names))


@dataclass(frozen=True)
class Policy:
    """Which failures reject a document."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    limit: int = 1

    def rejects(self, failures: Column, without: int = 0) -> Column:
        """Whether the bits reject, if the rules of the mask ``without`` are left out."""
        hard, soft = mask(self.hard) & ~without, mask(self.soft) & ~without
        return (failures.bitwiseAND(F.lit(hard).cast("long")) != 0) | (F.bit_count(failures.bitwiseAND(F.lit(soft).cast("long"))) >= self.limit)


BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICIES = (BASE, Policy("corpus-1", ("few_words", "repeated_words", "symbols", "no_letters", "capitals"),
                         ("repeated_lines", "word_length", "few_distinct"), 2))


def _repeated_starts(codes: str, bits: str) -> Column:
    """Positions whose code shares its upper bits with a neighbour in the sorted ``codes``."""
    key = lambda x: F.call_function("shiftrightunsigned", x, F.col(bits))
    meets = lambda x, i: F.coalesce(key(x) == key(F.get(codes, i - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(codes, i + 1)), F.lit(False))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1
    return F.transform(F.filter(codes, meets), lambda x: x.bitwiseAND(low).cast("int"))


def measured(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep`` and the measurements of every text."""
    text = F.coalesce(documents["text"], F.lit(""))
    kept = [documents[k] for k in dict.fromkeys(["doc_id", *keep])]
    rows = documents.select(F.struct(*kept).alias("kept"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumns({"n": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    # windows as numbers: hash bits above, position below
    rows = rows.withColumn("bits", F.length(F.bin("n")))
    window = lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)])
    codes = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.call_function("shiftleft", window(i), F.col("bits")).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("codes", F.when(F.col("n") >= WINDOW, F.sort_array(codes)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("open", _repeated_starts("codes", "bits"))
    # candidates compared as words
    rows = rows.withColumn("named", F.sort_array(F.transform("open", lambda i: F.struct(F.slice("words", i + 1, F.lit(WINDOW)).alias("w"), i.alias("at")))))
    twin = lambda x, i: F.coalesce(x["w"] == F.get("named", i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("named", i + 1)["w"], F.lit(False))
    rows = rows.withColumn("starts", F.sort_array(F.transform(F.filter("named", twin), lambda x: x["at"])))
    covered = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    only = lambda others: F.length(F.regexp_replace("text", others, "")).cast("long")
    return rows.select(
        "kept.*", F.col("n").cast("long").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        only(NO_SYMBOLS).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(LETTER_WORD)).cast("long").alias("n_letter_words"),
        only("[^A-Z]+").alias("n_capitals"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct_words"))


def ledger(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, the measurements and ``failures``: bit i is set where rule i of ``RULES`` fails."""
    rows = measured(documents, keep)
    zero = F.lit(0).cast("long")
    bits = [F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(zero) for i, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return rows.withColumn("failures", total)


def apply_policy(stored: DataFrame, policy: Policy) -> DataFrame:
    """The ledger's rows with ``kept``, the policy's verdict, and ``policy``, its version."""
    return stored.withColumns({"kept": ~policy.rejects(F.col("failures")), "policy": F.lit(policy.version)})


def ablations(stored: DataFrame, policies: Sequence[Policy] = POLICIES, by: Sequence[str] = ()) -> DataFrame:
    """What every rule does in every policy: version, rule, the columns of ``by``, and counts of documents and words.

    ``failed`` fail the rule, ``rejected`` are rejected by the whole policy, ``saved`` would be kept if the rule were left out;
    ``failed_words`` and ``saved_words`` count their words.  ``together`` holds the bits that fail in any document the rule
    rejects, ``always`` those that fail in all of them (null: none).
    """
    bits = F.col("failures")
    cube = stored.groupBy(*by, "failures").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"))
    out = None
    for policy in policies:
        rules = [name for name, _ in RULES if name in policy.hard + policy.soft]
        facts = F.array(*[F.struct(F.lit(name).alias("rule"), (bits.bitwiseAND(F.lit(mask([name])).cast("long")) != 0).alias("fails"),
                                   policy.rejects(bits).alias("out"), (~policy.rejects(bits, mask([name]))).alias("kept")) for name in rules])
        rows = cube.select(*by, "failures", "documents", "words", F.explode(facts).alias("f"))
        fails, saved = F.col("f.fails"), F.col("f.out") & F.col("f.kept")
        count = lambda which, what: F.coalesce(F.sum(F.when(which, F.col(what))), F.lit(0)).cast("long")
        table = rows.groupBy(F.lit(policy.version).alias("policy"), F.col("f.rule").alias("rule"), *by).agg(
            count(fails, "documents").alias("failed"), count(F.col("f.out"), "documents").alias("rejected"), count(saved, "documents").alias("saved"),
            count(fails, "words").alias("failed_words"), count(saved, "words").alias("saved_words"),
            F.bit_or(F.when(fails & F.col("f.out"), bits)).alias("together"), F.bit_and(F.when(fails & F.col("f.out"), bits)).alias("always"))
        out = table if out is None else out.unionByName(table)
    return out


def quality_rules(documents: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The stored ledger's measurements, ``base_failed`` and the policy's verdict, one row a document."""
    stored = written(ledger(documents), "quality-ledger")
    verdict = apply_policy(stored, policy)
    failed = BASE.rejects(F.col("failures"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                          (F.col("kept") & ~failed).alias("kept"), "n_lines", "n_letter_words", "n_capitals", "n_distinct_words", "failures", "policy")


_BITS = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES))
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words FROM d),
 p AS (SELECT r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
 g AS (SELECT r, i, n, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
 twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c, d, e) AS copies FROM g WHERE i + {WINDOW - 1} <= n),
 hit AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM twice, range({WINDOW}) AS x(j) WHERE copies > 1 GROUP BY r),
 dist AS (SELECT r, count(DISTINCT word) AS n_distinct_words, count(*) FILTER (regexp_matches(word, '\p{{L}}')) AS n_letter_words FROM p GROUP BY r),
 l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
 ll AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY r),
 m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{NO_BLANK}]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_letter_words, 0) AS BIGINT) AS n_letter_words,
  CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals, CAST(coalesce(n_distinct_words, 0) AS BIGINT) AS n_distinct_words
  FROM w LEFT JOIN hit USING (r) LEFT JOIN dist USING (r) LEFT JOIN ll USING (r)),
 f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask(BASE.hard)} <> 0 AS base_failed,
 failures & {mask(POLICIES[-1].hard)} = 0 AND bit_count(failures & {mask(POLICIES[-1].soft)}) < {POLICIES[-1].limit} AS kept,
 n_lines, n_letter_words, n_capitals, n_distinct_words, failures, '{POLICIES[-1].version}' AS policy FROM f"""
