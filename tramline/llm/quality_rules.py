"""Quality rules by divergence from language references, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import SPACES, let, words, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Character classes as patterns; each character is counted in the first that fits.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:'\"()-]", r"[#*$%&|<>!?@^~_=+/\\\[\]{}`]", r"\p{L}")
#: A word is common in a language if this share of the words of a text is it, on the mean of the language's texts. So a
#: language has at most 1 / COMMON_SHARE common words.
COMMON_SHARE = 0.005
#: Hash buckets of words, many more than the common words of a language.
BUCKETS = 4096


def n_repeat_words(w: Column, n: int = 5) -> Column:
    """Words in windows of n words that the text has twice or more.

    Windows are compared by a 64-bit hash. If all differ nothing is sorted; else the windows are sorted by hash, those
    with an equal neighbour kept, and the union of their places measured. Linear space and n log n time in a text."""

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(a) - n)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(n)])), covered)

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, union))

    def union(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + (i + n - F.greatest(i, a["end"]))).cast("long").alias("n"), (i + n).alias("end")), lambda a: a["n"])

    return F.when(F.size(w) >= n, let(w, of)).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column) -> dict[str, Column]:
    """The plain counts of a text; ``words`` must be a column made before."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return {
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def class_histogram(text: Column) -> Column:
    """array<double>: characters of each class, and the rest, counted on the text without those of the classes before."""

    def step(left: Column, i: int) -> list[Column]:
        if i == len(CLASSES):
            return [F.length(left)]
        return [F.length(left) - F.length(F.regexp_replace(left, CLASSES[i], "")), *step(F.regexp_replace(left, CLASSES[i], ""), i + 1)]

    # nested bindings, so that each class's pattern runs once
    def nest(left: Column, i: int, counts: list[Column]) -> Column:
        if i == len(CLASSES):
            return F.array(*[c.cast("double") for c in [*counts, F.length(left)]])
        return let(F.regexp_replace(left, CLASSES[i] + "+", ""), lambda rest: nest(rest, i + 1, [*counts, F.length(left) - F.length(rest)]))

    return nest(text, 0, [])


def small_words(text: Column) -> Column:
    """array<string> of the words in small letters, punctuation and all."""
    return F.filter(F.split(F.lower(text), SPACES), lambda x: x != "")


def common_words(texts: DataFrame, share: float, least_words: int, least_docs: int) -> DataFrame:
    """``_lang, _list``: the common words of each language (with a letter) in order, from the rows of ``texts(_lang, text)`` with
    ``least_words`` words or more; languages of fewer than ``least_docs`` such rows have none.

    Two passes, both summed on the map side, so no language is one group. The first sums shares by (language, hash bucket
    of the word): a word is in no bucket of less than its own share, so words of lighter buckets are not common and need
    no row of their own. The second counts the words of heavy buckets, at most 1 / ``share`` a language, and decides by
    their exact sums. A list has at most 1 / ``share`` words."""
    # texts that are too short are null arrays, which the outer explode turns into a null word without a share
    rows = texts.select("_lang", let(small_words(F.col("text")), lambda w: F.when(F.size(w) >= least_words, w)).alias("w"))
    word, bucket = F.col("word"), F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    # a null at the end of each array counts the texts
    ended = rows.select("_lang", (F.lit(1.0) / F.size("w")).alias("part"), F.explode_outer(F.concat("w", F.array(F.lit(None).cast("string")))).alias("word"))
    totals = ended.groupBy("_lang", F.when(word.isNotNull(), bucket).otherwise(-1).alias("_bucket")).agg(F.sum(F.when(word.isNotNull(), F.col("part")).when(F.col("part").isNotNull(), 1.0)).alias("part"))
    n = F.max(F.when(F.col("_bucket") == -1, F.col("part"))).over(Window.partitionBy("_lang"))
    # the sum of a bucket may be rounded otherwise than that of its word
    heavy = totals.select("_lang", "_bucket", "part", n.alias("n")).where((F.col("n") >= least_docs) & (F.col("_bucket") >= 0) & (F.col("part") >= share * (1 - 1e-6) * F.col("n")))
    heavy = written(heavy.select("_lang", "_bucket", "n"), "heavy")
    each = rows.select("_lang", (F.lit(1.0) / F.size("w")).alias("part"), F.explode_outer("w").alias("word")).withColumn("_bucket", bucket)
    sums = each.join(heavy, ["_lang", "_bucket"]).groupBy("_lang", "n", "word").agg(F.sum("part").alias("part"))
    # only the few words over the limit meet in a group; the pattern sees those alone
    lists = sums.where(F.col("part") >= share * F.col("n")).groupBy("_lang").agg(F.collect_list("word").alias("_list"))
    return lists.select("_lang", F.sort_array(F.filter("_list", lambda x: x.rlike(r"\p{L}"))).alias("_list")).where(F.size("_list") > 0)


def word_histogram(text: Column, common: Column) -> Column:
    """array<double>: how often each word of ``common`` (array<string>) stands in the text, and all other words."""

    def of(ws: Column) -> Column:
        hits = F.filter(ws, lambda x: F.array_contains(common, x))
        return let(hits, lambda h: F.concat(F.transform(common, lambda c: F.size(F.filter(h, lambda x: x == c)).cast("double")), F.array((F.size(ws) - F.size(h)).cast("double"))))

    return let(small_words(text), of)


def shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(c, lambda x: F.when(s > 0, x / s).otherwise(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of two arrays of shares."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def mean_shares(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``_lang`` and the mean of the arrays of a column, place by place."""
    each = rows.select("_lang", F.posexplode(column).alias("i", "x")).groupBy("_lang", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("_lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(name))


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", class_limit: float = 0.25, word_limit: float = 0.85, least_chars: int = 200, least_words: int = 60, least_docs: int = 5, common_share: float = COMMON_SHARE) -> DataFrame:
    """Every row with its counts, its distances to the reference of its language, and the verdict.

    A language's common words are counted over all its texts (``common_words``). Its reference is the mean share, over all
    its texts that pass the base rules, of each character class and of each common word; a language of fewer than
    ``least_docs`` such texts has none. Lists and references are at most a few hundred numbers a language; the optimizer
    checks their size before it broadcasts them.
    A row is kept if it passes the base rules, its class distance is at most ``class_limit``, and its word distance at most
    ``word_limit`` of the distance that a text without any common word has. A distance of a text shorter than its guard
    (``least_chars``, ``least_words``), or without a reference, does not count.

    Null text: no words, so base_failed. Rows of a null lang are a language of their own, ``und``. Repeated rows each get
    their own verdict; other columns are not read; an empty table gives an empty result."""
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # written first, so that the optimizer knows how small it is and no text moves to meet it
    lists = written(common_words(own, common_share, least_words, least_docs).withColumnRenamed("_lang", "_l"), "common")
    t = F.col("text")
    rows = own.join(lists, F.col("_lang") == F.col("_l"), "left").select(
        "_key", "_lang",
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        *[c.alias(n) for n, c in base_counts(t).items()],
        shares(class_histogram(t)).alias("_classes"), F.when(F.col("_list").isNotNull(), shares(word_histogram(t, F.col("_list")))).alias("_common"),
    )
    rows = rows.select("*", F.col("_w")["n_words"].alias("n_words"), F.col("_w")["n_repeat_words"].alias("n_repeat_words")).drop("_w")
    # counts and shares, a few hundred bytes a row, are needed twice: for the references and for the verdicts
    rows = written(rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "counts")
    passed = rows.where(~F.col("base_failed"))
    enough = passed.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_docs)
    references = enough.join(mean_shares(passed, "_classes", "_ref_classes"), "_lang").join(mean_shares(passed, "_common", "_ref_common"), "_lang", "left")
    none = F.transform(F.col("_ref_common"), lambda x, i: F.when(i == F.size("_ref_common") - 1, 1.0).otherwise(0.0))
    references = references.withColumn("_none", js_distance(none, F.col("_ref_common")))
    # written as the lists are, so that a language's rows are not dealt to one task to meet them
    out = rows.join(written(references, "references"), "_lang", "left")
    out = out.withColumn("class_distance", js_distance(F.col("_classes"), F.col("_ref_classes"))).withColumn("word_distance", js_distance(F.col("_common"), F.col("_ref_common")) / F.nullif(F.col("_none"), F.lit(0.0)))
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= class_limit) | (F.col("word_chars") < least_chars)
    usual = (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= word_limit) | (F.col("n_words") < least_words)
    return out.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near & usual).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
