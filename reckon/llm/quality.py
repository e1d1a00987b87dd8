"""Quality rules by distribution divergence, in DataFrame functions only.

One pass over all documents works out the base measures, a histogram of character classes and one of common words, and
stores them: 66 numbers for each document. The histograms' sums for each value of lang are the references. A document goes
if a base rule fails, or if it is long enough to be judged and the Jensen-Shannon distance (0 to 1) of its histograms from
its language's is too large. The references are a few numbers for each language: up to ``LITERALS`` of them go into the
plan, so the second step reads only numbers, needs no join and shuffles nothing; more of them are joined.

Defined results: null texts count as empty; documents under a guard's length are not judged by that distance. Every value
of lang has a reference, however few documents it has. What a reference tells grows with the words that it has from other
documents: the distance counts in full where they are many and less, without a step, where ``DOUBT`` words or fewer stand
behind it, so a clean document in a language that hardly occurs isn't judged by a handful of others. A lang that is null or names no language (``NO_LANGUAGE``) enters
no reference; such a document is held against the reference that is nearest by words. Empty tables work; repeated rows each get their row; very long texts are measured whole. Columns are picked by name;
the measures' names replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import common as C

#: Besides null: blank, and the ISO 639 codes for undetermined, several, uncoded and no language.
NO_LANGUAGE = ("", "mis", "mul", "und", "zxx")
#: Words of others at which a reference tells half.
DOUBT = 2000
#: How many references are put into the plan as literals; the rows are the same if more are joined.
LITERALS = 256
#: Frequent function words of German, English, Spanish and French; other languages' words count as others.
COMMON = (
    "a al as at au auf be by con das de del dem den der des die du ein el en est et for für im in is ist it la las le les "
    "los mit nicht of on para par pas pour que qui se sich su sur that the to un una und une von was with y zu"
).split()
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
#: Guards and limits of the method: words needed before a distance is judged, and the largest distance that is kept.
GUARD_CLASSES, FAR_CLASSES = 50, 0.24
GUARD_WORDS, FAR_WORDS = 150, 0.21


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once: a lambda's argument is never expanded into its body."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the text has twice. Windows are hashed to 64 bits; only where some repeat are they
    sorted to find their places."""
    windows = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(F.lit(3), b - a))
        return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(3), lambda x, y: x + y)).otherwise(0)

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places))

    return let(windows, count)


def class_histogram(text: Column, word_chars: Column) -> Column:
    """Characters: lower case and other letters, upper case, digits, marks, white space."""
    upper, digit, mark = (F.regexp_count(text, F.lit(p)).cast("long") for p in (r"\p{Lu}", r"\p{N}", r"[^\p{L}\p{M}\p{N}\s]"))
    length = F.length(text).cast("long")
    return let(F.array(upper, digit, mark, length - word_chars), lambda x: F.concat(F.array(length - F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)), x))


def word_histogram(words: Column) -> Column:
    """Occurrences of each common word, and of all others together."""
    common = F.filter(F.transform(words, lambda x: F.lower(x)), lambda x: x.isin(*COMMON))
    size = lambda x: F.size(x).cast("long")
    return let(common, lambda x: F.array(*[size(x) - size(F.array_remove(x, c)) for c in COMMON], size(words) - size(x)))


def distance(histogram: Column, reference: Column) -> Column:
    """Jensen-Shannon distance to base 2 of two histograms; 0 where one of them is empty."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def of(n: Column, m: Column) -> Column:
        terms = F.zip_with(histogram, reference, lambda a, b: let(F.struct((a / n).alias("p"), (b / m).alias("q")), lambda x: (part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2))
        return F.sqrt(F.greatest(total(terms), F.lit(0.0)))

    return F.coalesce(let(F.struct(total(histogram).alias("n"), total(reference).alias("m")), lambda x: F.when((x["n"] > 0) & (x["m"] > 0), of(x["n"], x["m"])).otherwise(0.0)), F.lit(0.0))


def histograms(text: Column) -> Column:
    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(words_of(t), lambda w: F.struct(class_histogram(t, word_chars(w)).alias("classes"), word_histogram(w).alias("common"))))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def measures(text: Column) -> Column:
    """All measures of one text as a struct; every intermediate is a lambda's argument, so nothing is worked out twice."""

    def all_of(t: Column, w: Column, n: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), n.alias("word_chars"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), repeated_lines(t).cast("long").alias("n_dup_lines"), repeated_words(w).cast("long").alias("n_repeat_words"),
            class_histogram(t, n).alias("classes"), word_histogram(w).alias("common"),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(words_of(t), lambda w: let(word_chars(w), lambda n: all_of(t, w, n))))


def language(df: DataFrame, lang_column: str) -> Column:
    """The value of lang; null where it names no language."""
    lang = F.col(f"`{lang_column}`").cast("string") if lang_column in df.columns else F.lit(None).cast("string")
    return F.when(~F.lower(F.trim(lang)).isin(*NO_LANGUAGE), lang)


def references(df: DataFrame, lang: Column, histogram: Column) -> DataFrame:
    """(l, r): the histogram sums r.c and r.w of each language."""
    rows = df.select(lang.alias("l"), histogram["classes"].alias("classes"), histogram["common"].alias("common")).filter("l is not null")
    sums = rows.groupBy("l").agg(F.array(*[F.sum(F.get("classes", F.lit(i))).cast("double") for i in range(5)]).alias("c"), F.array(*[F.sum(F.get("common", F.lit(i))).cast("double") for i in range(len(COMMON) + 1)]).alias("w"))
    return sums.select("l", F.struct("c", "w", F.aggregate("w", F.lit(0.0), lambda a, b: a + b).alias("n")).alias("r"))


def against(histogram: Column, reference: Column) -> Column:
    """Both distances of a text from one reference, and its words; 0 where that is null."""
    return F.struct(distance(histogram["common"], reference["w"]).alias("words"), distance(histogram["classes"], reference["c"]).alias("classes"), F.coalesce(reference["n"], F.lit(0.0)).alias("n"))


def literals(known: list) -> Column:
    """References as an array of the plan."""
    numbers = lambda x: f"array({','.join(f'{v!r}D' for v in x)})"
    return F.expr(f"array({','.join(f'struct({numbers(x.r.c)} AS c, {numbers(x.r.w)} AS w, {x.r.n!r}D AS n)' for x in known)})")


def nearest(histogram: Column, known: list) -> Column:
    """Both distances from the reference that is nearest by words."""
    return let(histogram, lambda h: F.array_min(F.transform(literals(known), lambda r: against(h, r))))


def by_literals(df: DataFrame, known: list, histogram: Column, lang: Column, name: str) -> DataFrame:
    """``df`` with the distances ``name``, all references being literals of the plan."""
    if not known:
        return df.withColumn(name, F.struct(F.lit(0.0).alias("words"), F.lit(0.0).alias("classes"), F.lit(0.0).alias("n")))
    own = F.element_at(F.map_from_arrays(F.array(*[F.lit(x.l) for x in known]), literals(known)), lang)
    return df.withColumn(name, F.when(lang.isNull(), nearest(histogram, known)).otherwise(let(own, lambda r: against(histogram, r))))


def by_joins(df: DataFrame, known: DataFrame, histogram: Column, lang: Column, name: str, scratch: C.Scratch) -> DataFrame:
    """The same for any number of references: a document's own one is joined; for those without a language the nearest one
    is a minimum over all, ``LITERALS`` or so at a time."""
    known = scratch.write(known)
    key, ref = C.unused(df.columns, "__key", "__ref")
    named = df.filter(lang.isNotNull()).join(known.select(F.col("l").alias(key), F.col("r").alias(ref)), lang == F.col(key), "left")
    named = named.withColumn(name, let(F.col(ref), lambda r: against(histogram, r))).drop(key, ref)
    nameless, parts = df.filter(lang.isNull()).withColumn(name, F.lit(None).cast("struct<words:double,classes:double,n:double>")), -(-known.count() // LITERALS)
    for k in range(parts):
        rows = known.filter(F.pmod(F.xxhash64("l"), F.lit(parts)) == k).collect()  # about LITERALS
        if rows:
            nameless = nameless.withColumn(name, F.array_min(F.array_compact(F.array(F.col(name), nearest(histogram, rows)))))
    return named.unionByName(nameless)


def judge(df: DataFrame, text_column: str = "text", lang_column: str = "lang", corpus: DataFrame | None = None, carry: tuple[str, ...] | None = None, scratch: C.Scratch | None = None) -> DataFrame:
    """The columns of ``df`` named in ``carry`` (default: all) with the measures, the two distances, base_failed and kept.
    References come from ``corpus`` (default: ``df`` itself). The result reads tables of ``scratch``, which whoever gives one
    drops when it is done with."""
    scratch = scratch or C.Scratch(df.sparkSession)
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
    names = [c for c in C.others(df, *added) if carry is None or c in carry]
    lang_name, m_name, far_name = C.unused(df.columns, "__lang", "__m", "__far")
    stored = scratch.write(df.select(*[F.col(f"`{c}`") for c in names], language(df, lang_column).alias(lang_name), measures(F.col(f"`{text_column}`")).alias(m_name)))
    lang, m = F.col(lang_name), F.col(m_name)
    known = references(stored, lang, m) if corpus is None else references(corpus, language(corpus, lang_column), histograms(F.col(f"`{text_column}`")))
    rows = known.limit(LITERALS + 1).collect()
    out = by_literals(stored, rows, m, lang, far_name) if len(rows) <= LITERALS else by_joins(stored, known, m, lang, far_name, scratch)
    far = F.col(far_name)
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    others_ = F.greatest(F.col(far_name)["n"] - F.when(lang.isNotNull() if corpus is None else F.lit(False), m["n_words"]).otherwise(0), F.lit(0.0))
    beyond = lambda distance_, limit: distance_ * others_ > F.lit(limit) * (others_ + DOUBT)
    off = ((m["n_words"] >= GUARD_CLASSES) & beyond(far["classes"], FAR_CLASSES)) | ((m["n_words"] >= GUARD_WORDS) & beyond(far["words"], FAR_WORDS))
    values = [*[m[c] for c in added[:5]], far["classes"], far["words"], failed, ~failed & ~off]
    return out.select(*[F.col(f"`{c}`") for c in names], *[c.alias(n) for n, c in zip(added, values, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document of ``documents``."""
    scratch = C.Scratch(spark)
    out = judge(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=("doc_id",), scratch=scratch)
    return scratch.finished(out.drop("class_distance", "word_distance"))
