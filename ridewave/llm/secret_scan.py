"""Secret scans, in DataFrame functions only: fixed patterns, and character Markov models for what they miss.

Spans of a pattern are found with the pattern's matches and the pieces between them, whose lengths add up to the
positions.  Two first-order character models, one of random strings and one of ordinary words, score every
remaining token of 20 or more characters: a token whose mean log-likelihood ratio by character pair reaches ``least_ratio`` is a
span of kind markov, unless it overlaps a base span.

The ordinary model counts the character pairs of the words of 8 or more characters of all documents, but for base matches; equal words
combine before their pairs are counted, and a token in question that occurs only once does not vouch for itself.  The random model is trained on a labelled sample of bounded size: ``sample_strings``
digests in base 64, twice, and in lower-case and upper-case hexadecimal.  The model is one row of 67 * 67 ratios, so the join
that brings it to the documents is with a single row.

Defined results: a null or empty text has no spans; equal spans of different kinds are both kept; repeated rows give equal
results; without training documents only base spans are found; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds, the group that is measured and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more characters: shorter matches hold no longer one
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 or more characters, likewise
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # a place for any other character
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The spans (start, rank, kind, end) of a pattern's leftmost matches whose group has ``least`` characters."""
    whole = f"({pattern})"
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(1)), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(group + 1)), lambda x: F.length(x))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    folded = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("length"), sizes.alias("size")), start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["length"], F.lit(0))).alias("at"),
            F.when(x["size"] >= least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                (acc["at"] + x["gap"] + x["length"]).alias("end"))))).otherwise(acc["out"]).alias("out")))
    return F.when(text.rlike(pattern), folded["out"]).otherwise(F.array().cast(SPAN))


def pair_codes(token: Column) -> Column:
    """Codes of the neighbouring character pairs of a token."""
    alphabet = F.lit(ALPHABET)
    place = lambda i: F.instr(alphabet, F.substring(token, i, F.lit(1)))
    return F.when(F.length(token) > 1, F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: place(i) * SIZE + place(i + 1))
                  ).otherwise(F.array().cast("array<int>"))


def markov_ratios(documents: DataFrame, sample_strings: int = 4000, smoothing: float = 20.0) -> DataFrame:
    """One row: ratios, array<double> by pair code, of ln P(second | first) under the random and the ordinary model.

    P(second | first) leans on P(second) with the weight of ``smoothing`` observations.  No row without ordinary tokens.
    """
    blanked = F.col("text")
    for _, pattern, _, _ in BASE:
        blanked = F.regexp_replace(blanked, pattern, " ")
    words = documents.select(F.explode(F.regexp_extract_all(blanked, F.lit(r"([A-Za-z0-9+/_=-]{8,})"), F.lit(1))).alias("token"))
    seen = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR length(token) < 20")
    ordinary = seen.select(F.lit(0).alias("random"), "token", "n")
    digest = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    random = documents.sparkSession.range(sample_strings).select(F.lit(1).alias("random"), F.explode(F.array(
        F.rtrim(F.base64(F.unhex(digest("a"))), F.lit("=")), F.rtrim(F.base64(F.unhex(digest("b"))), F.lit("=")),
        digest("c"), F.upper(digest("d")))).alias("token"), F.lit(1).cast("long").alias("n"))
    pairs = ordinary.unionByName(random).select("random", F.explode(pair_codes(F.col("token"))).alias("pair"), "n")
    counts = pairs.groupBy("random", "pair").agg(F.sum("n").alias("count"))
    table = counts.groupBy().agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("random") == k, F.struct("pair", "count")))).alias(f"n{k}") for k in (0, 1)])
    cells, marks = F.sequence(F.lit(0), F.lit(SIZE * SIZE - 1)), F.sequence(F.lit(0), F.lit(SIZE - 1))
    zero = F.lit(0.0).cast("double")
    counted = lambda n: F.transform(cells, lambda i: F.coalesce(F.try_element_at(n, i), F.lit(0)).cast("double"))
    by_first = lambda c: F.transform(marks, lambda r: F.aggregate(F.slice(c, r * SIZE + 1, SIZE), zero, lambda a, x: a + x))
    by_second = lambda c: F.transform(marks, lambda s: F.aggregate(
        marks, F.lit(0.5).cast("double"), lambda a, r: a + F.element_at(c, r * SIZE + s + 1)))
    share = lambda c: F.transform(c, lambda x: x / F.aggregate(c, zero, lambda a, y: a + y))
    full = table.where("size(n0) > 0 AND size(n1) > 0").select(counted("n0").alias("c0"), counted("n1").alias("c1"))
    full = full.select("c0", "c1", by_first("c0").alias("f0"), by_first("c1").alias("f1"), by_second("c0").alias("s0"), by_second("c1").alias("s1"))
    full = full.select("c0", "c1", "f0", "f1", share("s0").alias("s0"), share("s1").alias("s1"))

    def chance(k: int, i: Column) -> Column:
        first, second = F.floor(i / SIZE).cast("int") + 1, i % SIZE + 1
        return (F.element_at(f"c{k}", i + 1) + smoothing * F.element_at(f"s{k}", second)) / (F.element_at(f"f{k}", first) + smoothing)

    return full.select(F.transform(cells, lambda i: F.log(chance(1, i)) - F.log(chance(0, i))).alias("ratios"))


def find_secrets(documents: DataFrame, least_ratio: float = 1.0, **training) -> DataFrame:
    """doc_id, base (spans of the patterns) and added (spans of the models), each sorted by start, then kind."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    base = texts.withColumn("base", F.array_sort(F.concat(*[spans(text, *[k, i, p, g, n]) for i, (k, p, g, n) in enumerate(BASE)])))
    tokens = spans(text, "markov", len(BASE), TOKEN, 0, 20)
    open_tokens = F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    asked = base.withColumn("asked", open_tokens)
    model = markov_ratios(documents, **training)
    # the model is a single row (or none), so every document meets it once at most
    scored = asked.join(F.broadcast(model.limit(1)), F.lit(True), "left")
    ratio = lambda t: F.aggregate(
        pair_codes(F.substring("text", t["start"] + 1, t["end"] - t["start"])), F.lit(0.0), lambda a, p: a + F.element_at("ratios", p + 1)
    ) / (t["end"] - t["start"] - 1)
    added = F.when((F.size("asked") > 0) & F.col("ratios").isNotNull(), F.filter("asked", lambda t: ratio(t) >= least_ratio)).otherwise(F.array().cast(SPAN))
    return scored.select("doc_id", "base", added.alias("added"))


def listed(found: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digest(documents: DataFrame, **settings) -> DataFrame:
    found = find_secrets(documents, **settings)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
