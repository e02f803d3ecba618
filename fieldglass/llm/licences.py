"""Licence scans by a trained paragraph classifier, with Spark expressions and Spark ML only.

A multinomial logistic regression over sparse word n-grams names the licence family of a paragraph or
says unknown. It is fitted on a fixed set of notices with words dropped and other text around them,
and on bounded numbers of paragraphs of the corpus; the least chance that counts is set on held-out
paragraphs. A predicted family is reported as confirmed if one of its notices is found in the
paragraph, compared by n-grams. A paragraph ends at a blank line or at a line that ends a sentence; in
paragraphs of several lines every run of lines as long as a notice can be is judged, so wrapped notices
are found wherever they stand.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.licence_texts import OTHER, TEMPLATES
from fieldglass.llm.tables import keep_once

UNKNOWN = "unknown"
COPIES = 24  # disturbed copies of each notice
SHUFFLED = 6  # copies of each longer notice with its words in another order, taken as unknown
SAMPLED_PER_TEXT = 3
TRAIN_PARAGRAPHS = 4_000  # paragraphs of the corpus, on average; those without a licence word and far from every notice are unknown
UNLIKE = 0.2  # share of a notice's n-grams that an unknown paragraph of the corpus holds at most
# Fixed value: paragraphs of the corpus with these words are not labelled, as they may be notices in other words.
LICENCE_WORDS = (
    r"licen[cs]|copyright|\(c\)|©|permission|permitted|redistribut|rights? (?:are )?reserved|reserved rights|public domain|spdx|warrant(?:y|ies)"
    r"|creative commons|\bcc0\b|\bcc by\b|open[- ]source|free software|\b[al]?gpl|\bgnu\b|\bbsd\b|\bmpl\b|copyleft|unencumbered")
CONFIRMED = 0.6  # share of a notice's n-grams in the paragraph
LEAST_CHANCE = 0.5
QUIET = 0.999  # share of held-out unknown paragraphs that must stay below the least chance
# Words that say nothing about licences when alone in an n-gram.
COMMON = (
    "a above all an and any are as at be been but by can do for from had has have he his if in is it its may no not of on one only "
    "or other part she so that the their these they this to under use used was were when which will with work you your"
).split()
OWN_COLUMNS = ("_row", "_paragraphs", "licences", "paragraphs", "confirmed", "chance")
SEPARATOR = r"[^\p{L}\p{N}.]+"


def words_of(text: Column | str) -> Column:
    """Lower-case words; a full stop stays inside a number or name but not at its end."""
    flat = F.regexp_replace(F.lower(text), r"\.(?![\p{L}\p{N}])", " ")
    return F.filter(F.split(flat, SEPARATOR), lambda w: w != "")


def once(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _run(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i + 1, n), " ")


def grams_of(words: Column) -> Column:
    """Distinct runs of two and three words."""
    def runs(w: Column) -> Column:
        parts = []
        for n in (2, 3):
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _run(w, n)))
        return F.array_distinct(F.concat(*parts))

    return once(words, runs)


def _telling(grams: Column) -> Column:
    """N-grams with one word at least that is not common."""
    common = F.array(*map(F.lit, COMMON))
    return F.filter(grams, lambda g: F.size(F.array_except(F.split(g, " "), common)) > 0)


def _vocabulary(spark: SparkSession) -> list[str]:
    """The telling n-grams of the notices: as many features as the fixed notices give."""
    grams = spark.createDataFrame(TEMPLATES, "family string, text string").select(F.explode(_telling(grams_of(words_of("text")))).alias("g"))
    return sorted(r["g"] for r in grams.distinct().collect())


def paragraphs_of(text: Column | str) -> Column:
    """Paragraphs with their inner line ends; lines of comment marks only are blank."""
    flat = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\r\x02", "")
    unmarked = F.regexp_replace(flat, r"(?im)^[^\p{L}\p{N}\n]*(?:dnl|rem)[\x20\t]+", "")
    ended = F.regexp_replace(unmarked, r"([.!?])(?=[^\p{L}\p{N}\n]*+\n)", "$1\x02")
    cut = F.regexp_replace(ended, r"\n(?:[^\p{L}\p{N}\n]*+\n)+|\x02[^\n]*+\n", "\x02")
    return F.filter(F.split(cut, "\x02"), lambda p: p.rlike(r"[\p{L}\p{N}]"))


LONGEST = max(len(t.split()) for _, t in TEMPLATES)  # words of a notice


def _windows(paragraph: Column, anchored) -> Column:
    """(first, last, text) of the runs of lines that can be a notice, and of each line: a run is a line and what follows until LONGEST words."""
    def of_lines(lines: Column) -> Column:
        def from_line(i: Column) -> Column:
            def with_words(rest: Column) -> Column:
                # Words of the lines after line i, before line i + k.
                def before(k: Column) -> Column:
                    return F.aggregate(F.slice(rest, 1, k - 1), F.lit(0), lambda a, n: a + n)

                return F.filter(F.sequence(F.lit(0), F.size(rest)), lambda k: (k == 0) | (before(F.greatest(k, F.lit(1))) < LONGEST))

            # An n-gram spans three lines at most, as every line has a word.
            near = anchored(F.array_join(F.slice(lines, i + 1, 3), " "))
            counts = F.transform(F.slice(lines, i + 2, LONGEST + 1), lambda t: F.size(words_of(t)))
            ends = F.when(near, once(counts, with_words)).otherwise(F.array().cast("array<int>"))
            return F.transform(ends, lambda k: F.struct(
                i.alias("first"), (i + k).alias("last"), F.array_join(F.slice(lines, i + 1, k + 1), " ").alias("text")))

        single = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.get(lines, F.lit(0)).alias("text")))
        return F.when(F.size(lines) == 1, single).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), from_line)))

    return once(F.filter(F.split(paragraph, "\n"), lambda t: t.rlike(r"[\p{L}\p{N}]")), of_lines)


class Model:
    """Weights of the n-grams that count, per family; `families` ends with unknown."""

    def __init__(self, families: list[str], intercepts: list[float], weights: dict[str, list[float]], least: float):
        self.families, self.intercepts, self.weights, self.least = families, intercepts, weights, least
        common = set(COMMON)
        # An n-gram needs each of its words, so its rarest-looking word tells where it may be: exact, and cheap to test.
        self.anchors = sorted({max((w for w in gram.split(" ") if w not in common), key=len) for gram in weights})


def _notices(spark: SparkSession, paragraphs: DataFrame) -> DataFrame:
    """(family, text): each notice as it is, with words dropped, and with corpus words before and after; notices with words in hashed order are unknown."""
    base = spark.createDataFrame(TEMPLATES, "family string, text string").select(
        "family", F.split("text", " ").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    index = F.sequence(F.lit(0), F.size("w") - 1)
    # Copy 0 is whole; the others lose a growing share of their words, the first and last fifth never more than others.
    kept = F.filter(F.zip_with("w", index, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.pmod(
        F.xxhash64(F.array_join("w", " "), F.col("copy"), s["i"]), F.lit(100)) >= F.when(F.col("copy") % 3 == 0, 0).otherwise(F.col("copy") % 8 * 2))
    disturbed = base.withColumn("t", F.array_join(F.transform(kept, lambda s: s["w"]), " "))
    around = paragraphs.select(F.pmod(F.xxhash64("text"), F.lit(len(TEMPLATES) * COPIES)).alias("k"), F.substring("text", 1, 200).alias("extra"))
    around = around.groupBy("k").agg(F.min("extra").alias("extra"))
    numbered = disturbed.withColumn("k", F.pmod(F.xxhash64("t", "copy"), F.lit(len(TEMPLATES) * COPIES)))
    joined = numbered.join(around, "k", "left")
    framed = joined.select("family", F.when(F.col("copy") % 2 == 0, F.col("t")).otherwise(
        F.concat_ws(" ", F.col("extra"), F.col("t"), F.col("extra"))).alias("text"))
    mixed = base.where((F.size("w") > 8) & (F.col("copy") < SHUFFLED)).select(F.lit(UNKNOWN).alias("family"), F.array_join(F.transform(F.array_sort(F.transform(
        "w", lambda w, i: F.struct(F.xxhash64(w, i, F.col("copy")).alias("h"), w.alias("w")))), lambda s: s["w"]), " ").alias("text"))
    return framed.unionByName(mixed)


def _unlike_notices(spark: SparkSession, paragraphs: DataFrame) -> DataFrame:
    """The paragraphs that are no notice, in whatever words."""
    notices = [r["g"] for r in spark.createDataFrame(TEMPLATES, "family string, text string").select(_telling(grams_of(words_of("text"))).alias("g")).collect()]
    known = F.array(*[F.array(*map(F.lit, g)) for g in notices if g])
    share = once(grams_of(words_of("text")), lambda grams: F.array_max(F.transform(known, lambda g: F.size(F.array_intersect(g, grams)) / F.size(g))))
    return paragraphs.where(~F.lower("text").rlike(LICENCE_WORDS)).where(F.coalesce(share, F.lit(0.0)) < UNLIKE)


def fit(docs: DataFrame, text_column: str = "text", train_paragraphs: int = TRAIN_PARAGRAPHS) -> Model:
    """The classifier for a corpus: only the bounded training rows and the model leave the executors.

    Corpus paragraphs that share much with a notice or have a licence word have no label and are left out
    of the training and of the paragraphs that set the least chance.
    """
    spark = docs.sparkSession
    rows = docs.select(text_column).agg(F.count("*").alias("n")).first()["n"]
    share = int(min(1.0, train_paragraphs / SAMPLED_PER_TEXT / max(1, rows)) * (1 << 30))
    chosen = docs.where(F.pmod(F.xxhash64(text_column), F.lit(1 << 30)) < share).select(once(
        F.transform(paragraphs_of(text_column), lambda x: F.translate(x, "\n", " ")), lambda p: F.slice(F.array_sort(F.transform(p, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("p")))), 1, SAMPLED_PER_TEXT)).alias("s"))
    sample = keep_once(chosen.select(F.explode("s").alias("s")).select(F.col("s.p").alias("text")), "licence-sample")
    clean = _unlike_notices(spark, sample)
    other = spark.createDataFrame([(UNKNOWN, t) for t in OTHER], "family string, text string")
    labelled = _notices(spark, clean).unionByName(other).unionByName(clean.select(F.lit(UNKNOWN).alias("family"), "text"))
    families = [*sorted({f for f, _ in TEMPLATES}), UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = keep_once(labelled.select(label.alias("label"), grams_of(words_of("text")).alias("grams"), F.xxhash64("text").alias("h")), "licence-training")
    held = F.pmod(F.col("h"), F.lit(5)) == 0
    notices = rows.where(F.col("label") < len(families) - 1)
    counter = CountVectorizerModel.from_vocabulary(_vocabulary(spark), inputCol="grams", outputCol="features", minTF=1.0)
    counter.setBinary(True)
    data = counter.transform(rows)
    # Unknown paragraphs weigh as much together as the notices do.
    ratio = notices.count() / max(1, rows.where(F.col("label") == len(families) - 1).count())
    data = data.withColumn("importance", F.when(F.col("label") == len(families) - 1, min(1.0, ratio)).otherwise(1.0))
    fitted = LogisticRegression(
        family="multinomial", weightCol="importance", regParam=2e-5, elasticNetParam=0.2, maxIter=60, standardization=False).fit(data.where(~held))
    chance = vector_to_array("probability")
    judged = fitted.transform(data.where(held & (F.col("label") == len(families) - 1))).select(
        F.array_max(F.slice(chance, 1, len(families) - 1)).alias("p"))
    loudest = judged.agg(F.percentile("p", QUIET)).first()[0]
    coefficients, vocabulary = fitted.coefficientMatrix.toArray(), counter.vocabulary
    used = [j for j in range(len(vocabulary)) if abs(coefficients[:, j]).max() > 1e-9]
    weights = {vocabulary[j]: [float(x) for x in coefficients[:, j]] for j in used}
    return Model(families, [float(x) for x in fitted.interceptVector], weights, max(LEAST_CHANCE, loudest or 0.0))


def scan(docs: DataFrame, model: Model, text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, paragraphs). Rows are those of `docs` without the text, with `_row`; paragraphs hold what was found:
    `_row`, position (number of the paragraph that is not blank, from 0), first and last (its lines that hold the
    notice), family, chance, containment, confirmed. Of runs of lines that overlap, the one that holds most of a
    notice counts, then the shortest.

    A paragraph without any n-gram of the model is unknown by its intercepts and not listed. Null text
    has no paragraphs. Texts are read whole; of each paragraph only its n-grams of the model are
    written. Columns of `docs` with the names of the operator's own are left out.
    """
    spark = docs.sparkSession

    def anchored(p: Column) -> Column:
        return F.exists(F.split(F.lower(p), SEPARATOR), lambda w: F.rtrim(w, F.lit(".")).isin(model.anchors))

    def hits(p: Column) -> Column:
        empty = F.array().cast("array<string>")
        return F.when(anchored(p), F.filter(grams_of(words_of(p)), lambda g: g.isin(list(model.weights)))).otherwise(empty)

    text = F.coalesce(F.col(text_column), F.lit(""))
    windows = F.flatten(F.transform(paragraphs_of(text), lambda p, i: F.when(anchored(p), F.transform(_windows(p, anchored), lambda w: F.struct(
        i.alias("position"), w["first"].alias("first"), w["last"].alias("last"), hits(w["text"]).alias("grams")))).otherwise(
            F.array().cast("array<struct<position:int,first:int,last:int,grams:array<string>>>"))))
    listed = F.filter(windows, lambda s: F.size(s["grams"]) > 0)
    kept = [c for c in docs.columns if c not in (text_column, *OWN_COLUMNS)]
    rows = keep_once(docs.select(*kept, F.monotonically_increasing_id().alias("_row"), F.when(anchored(text), listed).alias("_paragraphs")), "licence-rows")
    found = rows.select("_row", F.explode("_paragraphs").alias("p")).select("_row", "p.position", "p.first", "p.last", "p.grams")
    n = len(model.families)
    weights = spark.createDataFrame(sorted(model.weights.items()), "gram string, w array<double>")
    # The model has as many rows as the fixed notices have n-grams.
    place = ["_row", "position", "first", "last"]
    scored = found.select(*place, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy(*place).agg(
        F.array(*[F.sum(F.get("w", F.lit(i))) for i in range(n)]).alias("sums"), F.collect_set("gram").alias("grams"))
    logits = F.zip_with("sums", F.array(*map(F.lit, model.intercepts)), lambda a, b: a + b)
    top = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    names = F.array(*map(F.lit, model.families))
    judged = scored.withColumn("logits", logits).select(
        *place, "grams", F.get(names, F.array_position("logits", top).cast("int") - 1).alias("family"), (1 / total).alias("chance"))
    known = judged.where((F.col("family") != UNKNOWN) & (F.col("chance") > model.least))
    notices = spark.createDataFrame(TEMPLATES, "family string, text string").select("family", F.filter(
        _telling(grams_of(words_of("text"))), lambda g: g.isin(list(model.weights))).alias("notice"))
    of_family = notices.where(F.size("notice") > 0).groupBy("family").agg(F.collect_list("notice").alias("notices"))
    shown = known.join(F.broadcast(of_family), "family").withColumn("containment", F.array_max(F.transform(
        "notices", lambda g: F.size(F.array_intersect(g, F.col("grams"))) / F.size(g))))
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.col("containment")).alias("rank"), (F.col("last") - F.col("first")).alias("length"), "first", "last", "family", "chance", "containment")))

    def chosen(windows: Column) -> Column:
        return F.aggregate(windows, F.slice(windows, 1, 0), lambda kept, w: F.when(
            F.exists(kept, lambda k: (k["first"] <= w["last"]) & (w["first"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(w))))

    one_each = shown.groupBy("_row", "position").agg(ranked.alias("w")).select("_row", "position", F.explode(chosen(F.col("w"))).alias("w"))
    return rows.drop("_paragraphs"), one_each.select(
        "_row", "position", "w.first", "w.last", "w.family", "w.chance", "w.containment", (F.col("w.containment") >= CONFIRMED).alias("confirmed"))


def families_of_documents(docs: DataFrame, text_column: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of `docs` without their text, with licences (confirmed families, sorted, comma-joined), paragraphs found, confirmed, chance (the greatest)."""
    model = model or fit(docs, text_column)
    rows, found = scan(docs, model, text_column)
    found = keep_once(found, "licence-paragraphs")
    summed = found.groupBy("_row").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
        F.count("*").alias("paragraphs"), F.count_if("confirmed").alias("confirmed"), F.max("chance").alias("chance"))
    return rows.join(summed, "_row", "left").drop("_row").withColumns({
        "licences": F.coalesce("licences", F.lit("")), "paragraphs": F.coalesce("paragraphs", F.lit(0)), "confirmed": F.coalesce("confirmed", F.lit(0))})
