"""Spelling variants: one-edit neighbourhoods over a reduced alphabet, joined to the reduced vocabulary, checked on the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import written

# Symbols that the letters are hashed to; at most 10, a symbol is a digit.
SYMBOLS = 3
# Fixed value: the letters of the contract.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, least: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, run): the maximal runs of ``least`` or more letters, A-Z lower-cased."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{int(least)},}}"), F.lit(0)))
    run = F.col("run")
    # lower() is exact and fast where every letter is one byte; elsewhere it would change accented capitals.
    plain = F.octet_length(run) == F.length(run)
    return docs.select("doc_id", found.alias("run")).withColumn("run", F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)))


def thinned(runs: DataFrame, every: int = 31) -> Column:
    """The run, less one letter where ``every`` divides the hash of document and run."""
    run = F.col("run")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(words: DataFrame, least_letters: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n) of the words long and frequent enough; a hot word is counted before the shuffle."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _reduced(word: Column, symbols: int) -> Column:
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))
    return F.array_join(F.transform(letters, lambda x: F.pmod(F.crc32(x), F.lit(symbols)).cast("string")), "")


def _half(length: Column) -> Column:
    """Letters of the half that one edit leaves as it is."""
    return F.floor((length - 1) / 2).cast("int")


def _sides(at: Column, length: Column) -> Column:
    """What the first and the last half of a word say, for a neighbour of ``length`` letters.

    One edit lies behind the first half or before the last one, so near words agree in one of the two.
    """
    half = _half(length)
    first = F.struct(F.lit(False).alias("late"), F.substring(at, F.lit(1), half).alias("same"))
    last = F.struct(F.lit(True).alias("late"), F.right(at, half).alias("same"))
    return F.array(first, last)


def _dealt(words: DataFrame) -> DataFrame:
    """Rows of ``words`` (with ``length`` of the neighbour sought) by what stays the same."""
    rows = words.withColumn("side", F.explode(_sides(F.col("word"), F.col("length")))).select("*", "side.late", "side.same").drop("side")
    return rows.withColumn("deal", F.xxhash64("late", "same", "length")).drop("same")


def _neighbourhood(r: Column, own: Column, length: Column, late: Column, symbols: int) -> Column:
    """The reduced words of ``length`` at one edit from ``r`` behind its first half, or (late) before its last, each once."""
    alphabet = F.array(*[F.lit(str(s)) for s in range(symbols)])
    half = _half(length)
    low = F.when(late, F.lit(0)).otherwise(half)
    before = lambda i: F.substring(r, F.lit(1), i)
    symbol = lambda i: F.substring(r, i + 1, F.lit(1))
    behind = lambda i: F.substring(r, i + 1, own)

    def places(last: Column) -> Column:
        """From ``low`` to ``last``, or to the last place before the half."""
        top = F.when(late, F.least(half - 1, last)).otherwise(last)
        return F.when(top >= low, F.sequence(low, top)).otherwise(F.expr("cast(array() as array<int>)"))

    def deleted(i: Column) -> Column:
        # Of a run of one symbol it does not matter which goes.
        return F.when((i == low) | (symbol(i) != symbol(i - 1)), F.concat(before(i), behind(i + 1)))

    def replaced(i: Column) -> Column:
        return F.transform(alphabet, lambda s: F.when(s != symbol(i), F.concat(before(i), s, behind(i + 1))))

    def inserted(i: Column) -> Column:
        return F.transform(alphabet, lambda s: F.when((i == low) | (s != symbol(i - 1)), F.concat(before(i), s, behind(i))))

    shorter = F.transform(places(own - 1), deleted)
    alike = F.concat(F.array(r), F.flatten(F.transform(places(own - 1), replaced)))
    longer = F.flatten(F.transform(places(own), inserted))
    return F.array_compact(F.when(length < own, shorter).when(length > own, longer).otherwise(alike))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, other, other_n): every ordered pair of words at exactly one inserted, deleted or replaced letter.

    Letters are hashed to a few symbols. Of each reduced word the full one-edit
    neighbourhood is generated, and joined to the reduced vocabulary; what meets is
    checked on the words themselves. Near words share their first or last half, so a
    word and its neighbourhood are dealt by that half and the neighbour's length: what
    is shuffled is eight rows a word, and the neighbourhood is made behind the shuffle.
    """
    spark = words.sparkSession
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    # Both sides lie by ``deal`` already, so the join needs no exchange.
    spark.conf.set(name, "false")
    try:
        return written(_met(words, symbols))
    finally:
        spark.conf.set(name, before)


def _met(words: DataFrame, symbols: int) -> DataFrame:
    own = F.length("word")
    sought = words.withColumn("length", F.explode(F.array(own - 1, own, own + 1))).where("length > 0")
    around = _neighbourhood(F.col("r"), own, F.col("length"), F.col("late"), symbols)
    asked = (
        _dealt(sought.select("word", "length"))
        .repartition("deal")
        .withColumn("r", _reduced(F.col("word"), symbols))
        .select("deal", "late", "word", F.explode(around).alias("v"))
        .select(F.xxhash64("v").alias("key"), "deal", "late", "word")
    )
    held = (
        _dealt(words.withColumn("length", own))
        .repartition("deal")
        .select(
            F.xxhash64(_reduced(F.col("word"), symbols)).alias("key"),
            "deal",
            F.col("word").alias("other"),
            F.col("n").alias("other_n"),
            F.col("length").alias("other_length"),
        )
    )
    half = _half(F.col("other_length"))
    # A pair that agrees in both halves is named by the first.
    named_before = F.col("late") & (F.substring("word", F.lit(1), half) == F.substring("other", F.lit(1), half))
    near = (F.levenshtein(F.col("word"), F.col("other"), 1) == 1) & ~named_before
    return asked.join(held, ["key", "deal"]).where(near).select("word", "other", "other_n")


def _followed(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) for (word, form): the forms followed to the last by doubling the stride.

    A step multiplies the count by ``ratio`` at least, so ``most`` bounds the steps.
    """
    steps = 0
    while ratio**steps <= most:
        steps += 1
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length()):
        roots = written(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return roots


def group_spellings(words: DataFrame, ratio: int = 10, symbols: int = SYMBOLS) -> DataFrame:
    """One row per word with its commoner form: word, form, root (string), n, n_near, form_n (long).

    words: (word, n), words distinct, n at least 1; rows with a null word are left
    out, and other columns are not carried. Two words are near at exactly one edit by
    code points. The form is the near word of largest n (ties: the smallest in
    code-point order) if its n is at least ``ratio`` times the word's, else null. The root
    follows forms to the last; a word without form is its own. No word gives no row.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms may lead in circles")
    words = written(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other"))
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.minus") >= F.col("n") * ratio
    judged = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.other")).alias("form"),
            F.when(fits, -F.col("best.minus")).alias("form_n"),
        )
    )
    most = judged.agg(F.max("n")).first()[0] or 1
    roots = _followed(judged.where("form is not null"), most, ratio)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
