"""How far the sources of each language differ in their terms, by wide vectors of counts; built-in functions only.

Words are counted once per (lang, source, term) with partial aggregates; of each (lang, term) the counts then meet in one row, the
term's vector over all sources of the language.  Higher-order functions turn counts into shares and emit the differences of
all pairs of sources, which partial aggregates sum: what leaves a task is at most one row for each pair of sources.

A language's row (its sources and their totals) goes to the vectors by broadcast up to BROADCAST_GROUPS groups in all, beyond
that by a join on the language and a share of the terms.  So no language, source or term meets in one task.

Defined results: a null text, language or source is ''; a group without terms, or of a language that keeps none, still
has its pairs; the least group of one source has none; repeated rows count as often as they occur; ties go by name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.base import shares, written

#: What stands between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 30
TOP_TERMS = 50
#: Shares are in units of one part in SCALE; each term counts as PRIOR more occurrences.
SCALE = 1_000_000_000
PRIOR = 5
#: (lang, source) groups up to which the languages' rows are broadcast: some 10 MB.
BROADCAST_GROUPS = 100_000
#: Bytes of vectors in a share when they are not.
SHARE_BYTES = 64 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; texts of ASCII alone take Spark's fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n occurrences, d documents): each text is read once, as its words and as its different words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"), F.split(lower_ascii(text), BETWEEN).alias("words"))
    kinds = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("words").alias("w")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.array_distinct("words").alias("w")))
    both = words.select("lang", "source", F.explode(kinds).alias("k")).select("lang", "source", "k.n", "k.d", F.explode("k.w").alias("term"))
    return both.where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(count: str, total: str) -> str:
    """SQL: 1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), exact also where the product passes 64 bits."""
    below, most = f"({total} + {PRIOR}L * v)", (2**63 - 1) // SCALE - PRIOR
    return f"(1L + if({count} <= {most}L, ({SCALE}L * ({count} + {PRIOR}L)) div {below}, (cast({count} + {PRIOR}L as decimal(27, 0)) * {SCALE}) div {below}))"


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, total, counts): each term that at least `min_docs` documents of the language hold, counts by source."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    rows = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return rows.where(f"d >= {min_docs}").drop("d")


def languages(docs: DataFrame, vectors: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, v kept terms, total, sources as an array of (source, total) by name), one row for each language."""
    groups = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source")).distinct()
    sums = vectors.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sum(F.coalesce("n", F.lit(0))).alias("total"), F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("total")))).alias("sources"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"))
    return sources.join(kept, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), "total", "sources")


def _with_language(vectors: DataFrame, langs: DataFrame, term: str) -> DataFrame:
    """Each row of `vectors` with its language's row."""
    if langs.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= BROADCAST_GROUPS:
        return vectors.join(F.broadcast(langs), "lang")
    n = shares(vectors, SHARE_BYTES)
    dealt = langs.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return vectors.withColumn("share", F.pmod(F.xxhash64(term), F.lit(n)).cast("int")).join(dealt, ["lang", "share"]).drop("share")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): of each (lang, source) its distance to each other source of the language
    (part `pair`, the sum of all differences of shares), and the terms it uses more than the language (part `term`)."""
    vectors = written(term_vectors(docs, min_docs, text_col, lang_col, source_col).withColumnRenamed("total", "used"), "divergence-vectors")
    langs = written(languages(docs, vectors.withColumnRenamed("used", "total"), lang_col, source_col), "divergence-languages")
    counted = _with_language(vectors, langs, "term").withColumn("c", F.expr("transform(sources, s -> coalesce(counts[s.source], 0L))"))
    wide = counted.select("lang", "term", "sources", "c", F.expr(f"zip_with(sources, c, (s, n) -> {_share('n', 's.total')})").alias("p"), F.expr(_share("used", "total")).alias("q"))

    # one row for each source i, then the differences to all later ones
    emitted = wide.select("lang", "p", F.posexplode("p").alias("i", "own")).select("lang", "i", F.posexplode(F.expr("transform(slice(p, i + 2, size(p)), x -> abs(x - own))")).alias("k", "f"))
    sums = written(emitted.groupBy("lang", "i", "k").agg(F.sum("f").alias("f")), "divergence-sums")
    pairs = langs.select("lang", "sources", F.posexplode("sources").alias("i", "one")).select("lang", "i", "one", F.posexplode(F.expr("slice(sources, i + 2, size(sources))")).alias("k", "other"))
    pairs = pairs.join(sums, ["lang", "i", "k"], "left").select("lang", F.col("one.source").alias("a"), F.col("other.source").alias("b"), F.coalesce("f", F.lit(0)).alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    more = F.expr("filter(arrays_zip(sources, c, p), x -> x.c > 0 and x.p > q)")
    terms = wide.select("lang", "term", "q", F.explode(more).alias("x")).select("lang", F.col("x.sources.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("x.p - q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top_terms}")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
