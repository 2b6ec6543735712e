"""Quality rules whose thresholds come from mergeable quantile sketches of each language and source.

DataFrame functions only. Every measure of a document is a whole number (shares are in thousandths). A sketch of a
group is the count of each bucket, where a bucket keeps the leading ``BITS`` binary digits of the value: relative error
under 1/64 at any size. Sketches merge by adding counts, so Spark combines them on the map side, a hot source costs no more
than a small one, and a language's sketch is the sum of its sources' sketches.

Null texts count as empty; null languages and sources are groups like any other; an empty table gives an empty result.
Repeated rows are judged alike, each on its own. The columns of a document travel in a struct, so any names are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from releaselens.llm.common import WORD, free_name, text_digest
from releaselens.session import materialize

BITS = 7
#: Measure: the least upper distance from the third quartile that counts as far, and whether low values are far too.
RULES = {
    "symbol_share": (20, False),
    "dup_line_share": (150, False),
    "repeat_share": (150, False),
    "mean_word_length": (2000, True),
    "upper_share": (150, False),
}
#: Distances from the quartiles in interquartile ranges, and the fewest documents that a group's own sketch needs.
FENCE, MIN_DOCS, MIN_WORDS, MAX_REPEAT = 3, 100, 50, 50
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def text_measures(text: Column) -> list[Column]:
    """Word array and plain counts of each whole text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    return [
        words.alias("_words"),
        without(SPACE).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
    ]


def _windows(words: str) -> Column:
    w = F.col(words)
    return F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )


def _sorted_windows(words: str) -> Column:
    """(hash, window, place) in order, only for texts where a window's hash occurs twice: else none can repeat."""
    w = F.col(words)
    entry = lambda i: F.struct(
        F.get(F.col("_hashes"), i).alias("h"),
        F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"),
        i.alias("i"),
    )
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    return F.when(again, F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), entry)))


def _repeated_places() -> Column:
    """Places of windows that equal another, ascending."""
    s = F.col("_sorted")
    same = lambda a, b: (a["h"] == b["h"]) & (a["s"] == b["s"])
    marked = F.transform(
        s,
        lambda x, k: F.when(
            F.coalesce(same(F.get(s, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, k + 1), x), F.lit(False)),
            x["i"],
        ),
    )
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _covered() -> Column:
    """Words in windows that start at the ascending places: three each, less what the next one also covers."""
    p = F.col("_places")
    own = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, all by default) with the counts and shares of each document.

    Texts are measured in place: no shuffle and no explosion, so a long text costs what its length costs.
    """
    keep = docs.columns if keep is None else keep
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), *text_measures(F.col(f"`{text}`")))
    df = df.withColumn("_hashes", _windows("_words"))
    df = df.withColumn("_sorted", _sorted_windows("_words"))
    df = df.withColumn("_places", _repeated_places())
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_repeat_words", _covered())
    df = df.drop("_words", "_hashes", "_sorted", "_places")
    share = lambda a, b: F.when(F.col(b) > 0, F.expr(f"({a} * 1000) div {b}")).otherwise(F.lit(0).cast("long"))
    return df.select(
        "*",
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word_length"),
        share("n_upper", "word_chars").alias("upper_share"),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def bucket(value: Column) -> Column:
    """The value with all but its leading binary digits cleared."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts of every measure of each group: ``by``, ``measure``, ``bucket``, ``n``."""
    long = measured.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in RULES])
        ).alias("_e"),
    )
    return long.groupBy(*by, "_e.measure", "_e.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Add up sketches of finer groups."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Upper and lower fence of each measure of each group, one row a group, from its sketch.

    The quartile is the lowest bucket with at least that share of the documents at or below it. A group has at most a few
    hundred buckets, which bounds the window.
    """
    group = Window.partitionBy(*by, "measure")
    at = sketch.select(
        *by,
        "measure",
        "bucket",
        F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("n").over(group).alias("_all"),
    )
    quartile = lambda k: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * k, F.col("bucket")))
    q = at.groupBy(*by, "measure").agg(
        F.max("_all").alias("_all"), quartile(1).alias("_q1"), quartile(3).alias("_q3")
    )
    out = [F.max("_all").alias("_docs")]
    for m, (least, low) in RULES.items():
        far = F.greatest((F.col("_q3") - F.col("_q1")) * FENCE, F.lit(least).cast("long"))
        mine = F.col("measure") == m
        out.append(F.max(F.when(mine, F.col("_q3") + far)).alias(f"_high_{m}"))
        if low:
            out.append(F.max(F.when(mine, F.col("_q1") - far)).alias(f"_low_{m}"))
    return q.groupBy(*by).agg(*out)


def thresholds(fine: DataFrame, lang: str, source: str) -> DataFrame:
    """One row for each language and source: the fences of the group, or of a larger one where it is small."""
    def packed(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
        f = fences(sketch, by)
        return f.select(*by, F.struct(*[c for c in f.columns if c not in by]).alias(name))

    own = packed(fine, [lang, source], "_own")
    by_lang = merge(fine, [lang])
    langs = packed(by_lang, [lang], "_by_lang").withColumnRenamed(lang, "_l")
    # one row, joined on a key taken from data so that it stays an equi-join
    every = packed(merge(by_lang, []).withColumn("_at", F.col("n") * 0), ["_at"], "_every")
    joined = own.withColumn("_zero", F.col("_own._docs") * 0).join(langs, own[lang].eqNullSafe(langs["_l"]))
    joined = joined.join(every, joined["_zero"] == every["_at"])
    large = lambda c: F.when(F.col(f"{c}._docs") >= MIN_DOCS, F.col(c))
    return joined.select(lang, source, F.coalesce(large("_own"), large("_by_lang"), F.col("_every")).alias("_f"))


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None
) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``), measures, ``base_failed`` and ``kept`` of each document.

    A document fails the base rules if it has under ``MIN_WORDS`` words or over ``MAX_REPEAT`` per cent of them in
    repeated windows. The others are judged by the fences of their language and source, or of the language (or of all
    documents) where the group has under ``MIN_DOCS``; fences come from documents that pass the base rules.
    The measured rows are written once, so texts are measured once for the sketches and the verdicts.
    """
    keep = docs.columns if keep is None else keep
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    every = list(dict.fromkeys([*keep, lang, source]))
    table = measures(docs, text, every).select(
        F.struct(*[F.col(f"doc.`{c}`") for c in keep]).alias("doc"),
        F.col(f"doc.`{lang}`").alias("_lang"),
        F.col(f"doc.`{source}`").alias("_source"),
        *COUNTS,
        *RULES,
        failed.alias("base_failed"),
    )
    table, l, s = materialize(table), "_lang", "_source"
    limits = thresholds(sketches(table.where(~F.col("base_failed")), [l, s]), l, s)
    limits = limits.withColumnsRenamed({l: "_tl", s: "_ts"})
    df = table.join(limits, table[l].eqNullSafe(limits["_tl"]) & table[s].eqNullSafe(limits["_ts"]), "left")
    far = F.lit(False)
    for m, (_, low) in RULES.items():
        far = far | F.coalesce(F.col(m) > F.col(f"_f._high_{m}"), F.lit(False))
        if low:
            far = far | F.coalesce(F.col(m) < F.col(f"_f._low_{m}"), F.lit(False))
    return df.select("doc", *COUNTS, *RULES, "base_failed", (~(F.col("base_failed") | far)).alias("kept"))


def kept_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only.

    A verdict follows from text, language and source, so rejected ones are joined by these; texts are not written.
    """
    d, columns = free_name(docs, "_digest"), {c: F.col(f"`{c}`") for c in (text, lang, source)}
    plain = docs.select(
        columns[text].alias("text"), columns[lang].alias("lang"), columns[source].alias("source"), text_digest(text).alias("d")
    )
    verdicts = judge(plain, keep=["d", "lang", "source"]).where("not kept")
    names = {c: free_name(docs, f"_bad_{c}") for c in ("d", "lang", "source")}
    bad = verdicts.select(*[F.col(f"doc.{c}").alias(name) for c, name in names.items()]).distinct()
    rows = docs.withColumn(d, text_digest(text))
    same = (F.col(f"`{d}`") == F.col(names["d"])) & columns[lang].eqNullSafe(F.col(names["lang"]))
    same = same & columns[source].eqNullSafe(F.col(names["source"]))
    return rows.join(bad, same, "left_anti").drop(d)
