"""Entity detection by patterns, reconciliation of detections, counts."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.catalog import PATTERNS
from palimpsest.functions.text import normal_placeholder, strip
from palimpsest.sources.shared import stored

#: Unicode classes, case ignored: as the patterns are meant.
FLAGS = "(?iU)"
STRIDE = 1_000_000_000
#: A detection in the list of its document.
HIT = "struct<seq:bigint,original:string,placeholder:string,category:string,confidence:double,reason:string>"
PATTERN_CONFIDENCE, PATTERN_REASON = 0.8, "Detected by pattern matching"


def _gate(text: Column, category: str, pattern: str) -> Column | None:
    """A cheap test that every text with a hit of a catalogue pattern passes; None for other patterns."""
    if (category, pattern) not in _CATALOGUE:
        return None
    for ending, needed in _NEEDED.items():
        if pattern.endswith(ending):
            return F.rlike(text, F.lit(needed))
    mark = "@" if category == "EMAIL" else "%" if pattern.endswith("%") else pattern.lstrip("\\")[0]
    if mark in "@%$£€":
        return F.contains(text, F.lit(mark))
    return F.rlike(text, F.lit(r"\p{IsDigit}")) if category in ("DATE", "PERCENTAGE", "PHONE") else None


_CATALOGUE = {(c, x) for c, _, x in PATTERNS}
#: Letters that stand in every hit of the patterns with such an end. Only ſ is another form of one of them. What one of several begins
#: with is tested first, as most places are passed over by that.
_NEEDED = {
    "percent": "[pP][eE][rR][cC][eE][nN][tT]", r"per\s*cent": "[cC][eE][nN][tT]", "|per month)": r"(?i)(?=[.am])(?:\.a\.|annu|month)", "|euros?)": "(?i)(?=[ugepd])(?:u[sſ]d|gbp|eur|pound|dollar)",
}


def _quick(pattern: str) -> str:
    """A catalogue pattern in a form with the same matches that the engine follows faster.

    What a number can't give back to what follows it is not tried again (a digit, comma or point begins nothing of that),
    and what a match can begin with is tested before the end of a word is. A run of words is followed in a loop instead of one call
    deeper for each; a word before white space ends at a boundary anyway, so only the last one is tested twice.
    """
    pattern = pattern.replace(r"(?:\s+[A-Z][a-z]+)+\b", r"(?:\s+[A-Z][a-z]+\b)++")
    if pattern.startswith(r"[\d,]+"):
        pattern = pattern.replace(r"[\d,]+(?:\.\d{1,2})?\s*", r"[\d,]++(?:\.\d{1,2}+)?+\s*+", 1)
    pattern = pattern.replace(r"\d+\.?\d*\s*", r"\d++\.?+\d*+\s*+").replace(r"[A-Za-z0-9._%+-]+@", "[A-Za-z0-9._%+-]++@")
    for start, first in ((r"\b(?:Jan", "[JFMASOND][AEPUCO][NBRYLGPTVC]"), (r"\b(?:Q", "[QH][1-4]"), (r"\b(?:Mr", "[MD][RSI]"), ("(?:USD", "[UGEJCA][SBUPHA][DPRYF]")):
        if pattern.startswith(start):
            return f"(?={first}){pattern}"
    return pattern


_QUICK = {x: _quick(x) for _, _, x in PATTERNS}


def usable_patterns(spark: SparkSession, patterns=PATTERNS) -> tuple[list[tuple[int, str, str, str]], list[tuple[str, str, str]]]:
    """Patterns that the engine of the executors understands, each with its place, and (category, pattern, message) of the others.

    Each is compiled by the expression that will run it, over an empty text, without a job.
    """
    good, bad = [], []
    for k, (category, placeholder, pattern) in enumerate(patterns):
        try:
            spark.sql("SELECT regexp_extract_all('', :p, 0)", args={"p": FLAGS + pattern}).collect()
            good.append((k, category, placeholder, pattern))
        except PySparkException as e:
            bad.append((category, pattern, e.getCondition() or str(e)))
    return good, bad


def placed(patterns) -> list[tuple[int, str, str, str]]:
    """Patterns (category, placeholder, pattern) with their places; those that have them (some of a list) as they are."""
    return [x if len(x) == 4 else (k, *x) for k, x in enumerate(patterns)]


def found_by(text: Column, category: str, pattern: str, none: Column | None = None) -> Column:
    """The texts that a pattern finds; ``none`` or null where its gate shows that there are none."""
    found = F.regexp_extract_all(text, F.lit(FLAGS + _QUICK.get(pattern, pattern)), F.lit(0))
    return found if (gate := _gate(text, category, pattern)) is None else F.when(gate, found).otherwise(none)


def hits_in(text: Column, patterns=PATTERNS) -> Column:
    """Every hit of every pattern in a text, as a list of ``HIT``.

    A pattern of the catalogue runs, in its quick form, only over texts that hold the mark, digit or letters it needs. ``patterns`` are
    (category, placeholder, pattern), or (place, category, placeholder, pattern) where some of a list are left out.
    """
    every = placed(patterns)
    if not every:
        return F.array().cast(f"array<{HIT}>")

    def hits(k: int, category: str, placeholder: str, pattern: str):
        found = found_by(text, category, pattern, F.array().cast("array<string>"))
        told = (F.lit(placeholder).alias("placeholder"), F.lit(category).alias("category"), F.lit(PATTERN_CONFIDENCE).alias("confidence"), F.lit(PATTERN_REASON).alias("reason"))
        return F.transform(found, lambda m, i: F.struct((F.lit(k * STRIDE).cast("long") + i).alias("seq"), m.alias("original"), *told))

    return F.concat(*[hits(*x) for x in every])


def detect(docs: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Every hit of every pattern: doc_id, seq, original, placeholder, category, confidence, reason.

    ``seq`` orders hits by category, pattern and place. All patterns are applied
    in one projection and one explode, with no Python and no shuffle.
    """
    return (
        docs.select("doc_id", F.explode(hits_in(F.col("text"), patterns)).alias("hit"))
        .select("doc_id", "hit.*")
        .filter((F.col("original") != "") & ~F.startswith("original", F.lit("{{")))
    )


def hit_lists(docs: DataFrame, patterns=PATTERNS) -> DataFrame:
    """``detect`` with the hits of a row as one list (doc_id, hits).

    Lists are not tested for being empty: such a test would be made where they are, and run all patterns again.
    """
    return docs.select("doc_id", hit_list(F.col("text"), patterns).alias("hits"))


def hit_list(text: Column, patterns=PATTERNS) -> Column:
    """What ``detect`` finds in a text, as a list."""
    return F.filter(hits_in(text, patterns), lambda h: (h["original"] != "") & ~F.startswith(h["original"], F.lit("{{")))


def grounded(replies: DataFrame) -> DataFrame:
    """Model detections (with the chunk's text) whose original stands in the chunk, with their position there."""
    return (
        replies.filter((F.coalesce("original", F.lit("")) != "") & F.contains("text", F.col("original")))
        .withColumn("placeholder", normal_placeholder(F.coalesce("placeholder", F.lit("{{UNKNOWN}}")), F.coalesce("category", F.lit("UNKNOWN"))))
        .withColumn("position_in_chunk", F.call_function("instr", F.col("text"), F.col("original")) - 1)
    )


def grounded_hits(hits: Column, text: Column) -> Column:
    """``grounded`` of a list of (seq, original, placeholder, category, confidence, reason) from one text, without positions."""
    kept = F.filter(hits, lambda h: (F.coalesce(h["original"], F.lit("")) != "") & F.contains(text, h["original"]))
    placeholder = lambda h: normal_placeholder(F.coalesce(h["placeholder"], F.lit("{{UNKNOWN}}")), F.coalesce(h["category"], F.lit("UNKNOWN")))
    return F.transform(kept, lambda h: F.struct(h["seq"], h["original"], placeholder(h).alias("placeholder"), h["category"], h["confidence"], h["reason"]))


def best_of_each(detections: DataFrame) -> DataFrame:
    """Of detections equal but for case and outer white space the most confident, the first of equal ones.

    ``group_seq`` is the first appearance of the group.
    """
    key = F.lower(strip(F.col("original")))
    row = F.struct("original", "placeholder", "category", "confidence", "reason", "seq")
    return (
        detections.groupBy("doc_id", key.alias("_key"))
        .agg(F.max_by(row, F.struct(F.col("confidence"), -F.col("seq"))).alias("w"), F.min("seq").alias("group_seq"))
        .select("doc_id", "w.*", "group_seq")
    )


def maximal(detections: DataFrame, in_row: int | None = None) -> DataFrame:
    """Without those whose text is part of another detection's text in the same document.

    A document's detections are compared in one row. With ``in_row``, for corpora of very large documents, only those
    that hold so many characters at most are; those of larger ones meet in a join (``inside_others``), which splits a
    document over tasks. Detections are stored then, as both ways read them. Joins are merges: detections compress so well
    that Spark would take a table that doesn't fit the driver for one to send to all.
    """
    if in_row is None:
        return _maximal_in_rows(detections)
    sized = stored(detections, "detections").withColumn("_size", F.sum(F.length("original") + 1).over(W.partitionBy("doc_id")))
    large = sized.filter(F.col("_size") > in_row).drop("_size")
    kept = large.join(inside_others(large).hint("merge"), ["doc_id", "original"], "left_anti").select(detections.columns)
    return _maximal_in_rows(sized.filter(F.col("_size") <= in_row).drop("_size")).select(detections.columns).unionByName(kept)


def _maximal_in_rows(detections: DataFrame) -> DataFrame:
    """``maximal`` with a row for each document.

    The distinct texts of a document are joined by a separator; a text that is part of another one occurs there
    more than once. So each detection is read once and compared with one string, and no row meets another.
    """
    # The longest text always stays, so no list is empty; the outer form spares a test of that, which would filter twice.
    return _maximal_lists(_listed(detections)).select("doc_id", F.explode_outer("hits").alias("_row")).select("doc_id", "_row.*")


def _maximal_lists(lists: DataFrame) -> DataFrame:
    """Lists (doc_id, hits) without those that are part of another of their list."""
    joined = F.concat(F.lit("\x00"), F.array_join(F.array_distinct(F.transform("hits", lambda r: r["original"])), "\x00"), F.lit("\x00"))
    once = lambda r: F.length("_all") - F.length(F.replace(F.col("_all"), r["original"], F.lit(""))) <= F.length(r["original"])
    return lists.withColumn("_all", joined).select("doc_id", F.filter("hits", once).alias("hits"))


#: Characters of a gram by which texts meet.
GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, none of a shorter one."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, F.lit(n))))


def inside_others(detections: DataFrame) -> DataFrame:
    """(doc_id, original): texts that are part of another text of the same document.

    A text is looked for by its rarest gram in the document, or by itself where it is no longer than a gram; those
    that hold the gram are compared with it. Counting, choosing and meeting are joins on document and gram.
    """
    texts = detections.select("doc_id", "original").distinct()
    grams = texts.select("doc_id", "original", F.explode(_grams(F.col("original"), GRAM)).alias("gram"))
    counts = grams.groupBy("doc_id", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts.hint("merge"), ["doc_id", "gram"]).groupBy("doc_id", "original").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    # Shorter texts are few kinds: a document's lengths of such texts are at most GRAM - 1.
    short = texts.filter(F.length("original") < GRAM)
    lengths = short.groupBy("doc_id").agg(F.collect_set(F.length("original")).alias("lengths"))
    parts = texts.join(lengths.hint("merge"), "doc_id").select("doc_id", "original", F.explode(F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains("lengths", n), _grams(F.col("original"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM)])))).alias("gram"))
    asked = rarest.unionByName(short.withColumn("gram", F.col("original")))
    met = asked.join(grams.unionByName(parts).withColumnRenamed("original", "around").hint("merge"), ["doc_id", "gram"])
    return met.filter((F.col("around") != F.col("original")) & F.contains("around", F.col("original"))).select("doc_id", "original").distinct()


def longest_first(detections: DataFrame) -> DataFrame:
    """Adds ``ord``: longest originals first, then first appearance."""
    return detections.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.length("original")), "group_seq")))


def _listed(detections: DataFrame) -> DataFrame:
    rest = [c for c in detections.columns if c != "doc_id"]
    return detections.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("hits"))


def _first_of_each(sorted_hits: str) -> Column:
    """Of a sorted list the first of all with one key."""
    return F.filter(sorted_hits, lambda x, i: (i == 0) | ~F.get(F.col(sorted_hits), i - 1)["k"].eqNullSafe(x["k"]))


def distinct_maximal_lists(lists: DataFrame) -> DataFrame:
    """``distinct_maximal`` with a row (doc_id, hits) for each document, its detections in their order (``longest_first``).

    A document's hits are of one row when they are found, so they are compared there: as lists sorted by key, best first, and
    by key, earliest first, whose heads pair up. No detection is a row of its own on the way. Lists without equal keys are not sorted by them.
    """
    rest = [f.name for f in lists.schema["hits"].dataType.elementType.fields]
    key = lambda r: F.lower(strip(r["original"])).alias("k")
    differ = (F.size("hits") < 2) | (F.size(F.array_distinct(F.transform("hits", key))) == F.size("hits"))
    alone = F.transform("hits", lambda r: F.struct((-F.length(r["original"])).alias("n"), r["seq"].alias("group_seq"), *[r[c].alias(c) for c in rest]))
    rows = lists.withColumn("_best", F.when(~differ, F.sort_array(F.transform("hits", lambda r: F.struct(key(r), r["confidence"].alias("c"), (-r["seq"]).alias("s"), r.alias("r"))), asc=False)))
    rows = rows.withColumn("_early", F.sort_array(F.transform("_best", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"))), asc=False))
    best = F.zip_with(_first_of_each("_best"), _first_of_each("_early"), lambda x, y: F.struct((-F.length(x["r"]["original"])).alias("n"), (-y["s"]).alias("group_seq"), *[x["r"][c].alias(c) for c in rest]))
    best = F.when(F.col("_best").isNull(), alone).otherwise(best)
    return _maximal_lists(rows.select("doc_id", best.alias("hits"))).withColumn("hits", F.sort_array("hits"))


def _grouped(lists: DataFrame, dealt: bool) -> DataFrame:
    """Lists with one row for each document.

    They are dealt to all tasks: lists compress so well that Spark would gather them in a few, which grow with the input.
    """
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (lists if dealt else lists.repartition(n, "doc_id")).groupBy("doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _exploded(lists: DataFrame) -> DataFrame:
    # The outer form spares a test for empty lists before, which would make the lists twice.
    rows = lists.select("doc_id", F.posexplode_outer("hits").alias("_at", "_hit")).filter("_hit is not null")
    return rows.select("doc_id", "_hit.*", (F.col("_at") + 1).alias("ord")).drop("n")


def distinct_maximal(detections: DataFrame, dealt: bool = False) -> DataFrame:
    """The best of each group of equal detections, without those that are part of another.

    Detections are dealt by document once, which both steps need and a later order by document too; ``dealt`` says
    that they lie so already.
    """
    return reconcile(detections, dealt).drop("ord")


def reconcile(detections: DataFrame, dealt: bool = False) -> DataFrame:
    """The detections that a document's substitution uses, in their order."""
    return _exploded(distinct_maximal_lists(_listed(detections if dealt else detections.repartition("doc_id"))))


def reconciled_lists(lists: DataFrame, dealt: bool = False) -> DataFrame:
    """``reconcile`` of ``hit_lists``, still with a list for each document."""
    return distinct_maximal_lists(_grouped(lists, dealt))


def reconcile_lists(lists: DataFrame, dealt: bool = False) -> DataFrame:
    """``reconcile`` of ``hit_lists``."""
    return _exploded(reconciled_lists(lists, dealt))


def of_category(detections: DataFrame, *categories: str) -> DataFrame:
    return detections.filter(F.col("category").isin(*categories))


def patterns_of(*categories: str) -> list[tuple[int, str, str, str]]:
    """The catalogue's patterns of some categories, each with its place; all that ``of_category`` keeps of a detection comes from them."""
    return [(k, *x) for k, x in enumerate(PATTERNS) if x[0] in categories]


def counts_by_category(detections: DataFrame) -> DataFrame:
    return detections.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
