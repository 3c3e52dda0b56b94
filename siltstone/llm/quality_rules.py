"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

Only DataFrame functions. A document's measures never leave its row until the narrow measures are joined with the thresholds; the
text is read once and not shuffled.

The sketch is a histogram with relative-error bins of integers: values below 32 have bins of their own, larger ones 16 bins for each
power of two, so a quantile is at most 1/16 too low. Sketches merge by adding counts, so the sketch of a language is the sum of its
sources' sketches, and Spark's partial aggregation builds them before the shuffle: a hot source costs a few hundred rows a task.

Defined cases: a null text has no words and fails the base rules; null language or source form a group of their own; groups with few
documents take the thresholds of their language, languages with few take those of all documents; a measure on a fence is inside (ties); repeated rows
count and repeat; a very long text is measured whole, its words in one row; an empty table gives no rows; a kept column with the name of one of the operator's
own gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siltstone.llm.common import WHITE, Scratch, documents, packed, unpacked

SYMBOLS = "#*$%&|<>"
#: Documents that a group needs for thresholds of its own.
MIN_DOCS = 200
#: Fences lie this many spreads beyond the quartiles.
FENCE = 3
#: Measure: (smallest spread, whether low values fail too). Shares count in 1/10000, the mean word length in 1/100 characters.
MEASURES = {"symbols": (300, False), "repeats": (1000, False), "dup_lines": (2000, False), "word_length": (100, True)}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_w", F.filter(F.split(F.translate("_t", WHITE, " " * len(WHITE)), " "), lambda x: x != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    # Each 3-word window as one string with its place; only texts that hold a window twice are sorted.
    pairs = F.zip_with("_w", F.slice("_w", F.lit(2), F.size("_w")), lambda a, b: F.concat(a, F.lit(" "), b))
    df = df.withColumn("_p", pairs)
    df = df.withColumn("_g", F.slice(F.zip_with("_p", F.slice("_w", F.lit(3), F.size("_w")), lambda a, b: F.concat(a, F.lit(" "), b)), F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))))
    df = df.withColumn("_again", F.size("_g") > F.size(F.array_distinct("_g")))
    df = df.withColumn("_s", F.when(F.col("_again"), F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    df = df.withColumn("_q", F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")), lambda a, b: F.when(a.x == b.x, F.array(a.i, b.i))))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter("_q", lambda x: x.isNotNull()))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc.n,
    )
    return df.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def measure_columns() -> dict[str, Column]:
    """The measures as integers."""
    share = lambda a, b: F.floor(10000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "symbols": share("n_symbols", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "word_length": F.floor(100 * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).cast("long"),
    }


def bin_of(v: Column) -> Column:
    """The sketch's bin: grows with the value."""
    power = F.length(F.bin(v)) - 1
    return F.when(v < 32, v).otherwise((power - 4) * 16 + F.call_function("shiftright", v, power - 4))


def bin_floor(b: Column) -> Column:
    """The smallest value of a bin."""
    power = F.floor(b / 16) + 3
    return F.when(b < 32, b).otherwise(((b % 16 + 16) * F.pow(F.lit(2), power - 4)).cast("long"))


def sketches(measures: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, bin, n): one mergeable sketch for each group and measure."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m_{k}").alias("value")) for k in MEASURES]))
    long = measures.select(*keys, each.alias("e")).select(*keys, "e.measure", "e.value")
    return long.withColumn("bin", bin_of(F.col("value"))).groupBy(*keys, "measure", "bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_docs, low_<measure>, high_<measure>) from the quartiles of the sketches."""
    group = [*keys, "measure"]
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    cum = sketch.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(4 * F.col("cum") >= q * F.col("total"), F.col("bin")))
    quartiles = cum.groupBy(*group).agg(bin_floor(at(1)).alias("q1"), bin_floor(at(3)).alias("q3"), F.max("total").alias("total"))
    cols = [F.max("total").alias("n_docs")]
    for k, (least, low) in MEASURES.items():
        spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        cols.append(F.max(F.when(F.col("measure") == k, F.col("q3") + spread)).alias(f"high_{k}"))
        cols.append(F.max(F.when(F.col("measure") == k, F.col("q1") - spread if low else F.lit(-1))).alias(f"low_{k}"))
    return quartiles.groupBy(*keys).agg(*cols)


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, fences): of the group, else of its language, else of all documents."""
    names = [f"{side}_{k}" for k in MEASURES for side in ("low", "high")]
    own = fences(sketch, "lang", "source").withColumnRenamed("n_docs", "n_own")
    lang = fences(merged(sketch, "lang"), "lang").select(F.col("lang").alias("l_lang"), F.col("n_docs").alias("n_lang"), *[F.col(x).alias(f"l_{x}") for x in names])
    all_ = fences(merged(sketch)).select(*[F.col(x).alias(f"a_{x}") for x in names])
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(all_))  # one row
    pick = lambda x: F.when(F.col("n_own") >= min_docs, F.col(x)).when(F.col("n_lang") >= min_docs, F.col(f"l_{x}")).otherwise(F.col(f"a_{x}"))
    return joined.select("lang", "source", *[pick(x).alias(x) for x in names])


def apply_rules(docs: DataFrame, scratch: Scratch, *keep: str, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (keep, counts, base_failed, kept): a document is kept if it passes the base rules and lies within its group's fences."""
    narrow = measured(packed(docs, keep, F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))).drop("text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    narrow = narrow.withColumn("base_failed", base).withColumns({f"m_{k}": c for k, c in measure_columns().items()})
    narrow = scratch.write(narrow, "measures")
    limits = thresholds(scratch.write(sketches(narrow.where("NOT base_failed"), "lang", "source"), "sketches"))
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = narrow.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for k in MEASURES:
        inside = inside & F.col(f"m_{k}").between(F.col(f"low_{k}"), F.col(f"high_{k}"))
    joined = joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
    return unpacked(joined, keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", *[f"m_{k}" for k in MEASURES], "kept")


def op5_quality_rules(spark, sf_dir):
    found = apply_rules(documents(spark, sf_dir), Scratch(spark, "op5"), "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _fence_sql(level: str, keys: str) -> str:
    """SQL of ``fences`` over the table ``s_<level>``."""
    group = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    cols = ""
    for k, (least, low) in MEASURES.items():
        cols += f", max(CASE WHEN measure = '{k}' THEN q3 + {FENCE} * greatest(q3 - q1, {least}) END) AS high_{k}"
        cols += f", max(CASE WHEN measure = '{k}' THEN " + (f"q1 - {FENCE} * greatest(q3 - q1, {least})" if low else "-1") + f" END) AS low_{k}"
    edge = "CASE WHEN b < 32 THEN b ELSE (b % 16 + 16) * CAST(pow(2, b // 16 - 1) AS BIGINT) END"
    return f"""
c_{level} AS (SELECT *, sum(n) OVER (PARTITION BY {group}measure ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {group}measure) AS total FROM s_{level}),
e_{level} AS (SELECT {group}measure, min(CASE WHEN 4 * cum >= total THEN bin END) AS b1, min(CASE WHEN 4 * cum >= 3 * total THEN bin END) AS b3, max(total) AS total
  FROM c_{level} GROUP BY {group}measure),
q_{level} AS (SELECT {group}measure, total, {edge.replace("b ", "b1 ")} AS q1, {edge.replace("b ", "b3 ")} AS q3 FROM e_{level}),
f_{level} AS (SELECT {group}max(total) AS n_docs{cols} FROM q_{level} {by})"""


def _sql() -> str:
    names = [f"{side}_{k}" for k in MEASURES for side in ("low", "high")]
    pick = ", ".join(f"CASE WHEN o.n_docs >= {MIN_DOCS} THEN o.{x} WHEN l.n_docs >= {MIN_DOCS} THEN l.{x} ELSE a.{x} END AS {x}" for x in names)
    inside = " AND ".join(f"m_{k} BETWEEN low_{k} AND high_{k}" for k in MEASURES)
    union = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, m_{k} AS v FROM m WHERE NOT base_failed" for k in MEASURES)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH r AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM r),
g AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id),
c AS (SELECT w.id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM w LEFT JOIN p ON p.id = w.id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CAST(floor(10000 * n_symbols / greatest(word_chars, 1)) AS BIGINT) AS m_symbols, CAST(floor(10000 * n_repeat_words / greatest(n_words, 1)) AS BIGINT) AS m_repeats,
  CAST(floor(10000 * n_dup_lines / greatest(n_lines, 1)) AS BIGINT) AS m_dup_lines, CAST(floor(100 * word_chars / greatest(n_words, 1)) AS BIGINT) AS m_word_length FROM c),
u AS ({union}),
s_own AS (SELECT lang, source, measure, CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> (length(bin(v)) - 5)) END AS bin, count(*) AS n FROM u GROUP BY ALL),
s_lang AS (SELECT lang, measure, bin, sum(n) AS n FROM s_own GROUP BY ALL),
s_all AS (SELECT measure, bin, sum(n) AS n FROM s_own GROUP BY ALL),
{_fence_sql("own", "lang, source")},
{_fence_sql("lang", "lang")},
{_fence_sql("all", "")},
t AS (SELECT o.lang, o.source, {pick} FROM f_own o JOIN f_lang l ON o.lang IS NOT DISTINCT FROM l.lang, f_all a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, true) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": _sql()}
