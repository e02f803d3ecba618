"""Language identification by Bayesian evidence fusion.

The posterior of a language is its text likelihood times the chance of the declared markup language
given the language times a prior. Priors are smoothed level by level: all rows, address suffix,
domain, host; each level's counts are a grouped aggregate and lean on the level above. A row's own
vote is taken out of the counts it is judged by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import IDENTITY, keep_once, spare_names, with_identity
from fieldglass.llm.texthash import groups_of_texts, mix

BUCKETS = 1 << 15  # hashed letter trigrams
TRAIN_ROWS = 500  # distinct labelled texts per language, on average, that the text model is fitted on
EVIDENCE = 100  # trigrams that count at most: letters of one text are not independent
FLOOR = 0.05  # added to every bucket
PRIOR_STRENGTH = 20.0  # rows that the level above weighs
UNKNOWN_SHARE = 0.001  # prior of "none of the languages"
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"
_BLOCK = 1 << 19
_SLICE = 1 << 16  # trigrams hashed together: the steps of a hash each make a copy
_TABLES = 64  # languages whose counts a task holds at once
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point to lower-case letter, 0 for anything else; one entry for all beyond the basic plane."""
    global _LETTER
    if _LETTER is None:
        table = np.zeros(0x10001, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[0x10000] = 0x10000
        _LETTER = table
    return _LETTER


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of each text, runs of other characters read as one space, and their places."""
    points = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, 0x10000)]
    del points
    keep = letter != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    kept_before = np.zeros(len(keep) + 1, np.int32 if len(keep) < 1 << 31 else np.int64)
    np.cumsum(keep, out=kept_before[1:])
    bounds = np.zeros(len(texts) + 1, np.int64)
    bounds[1:] = kept_before[np.cumsum([len(t) + 1 for t in texts])]
    del kept_before
    letters = letter[keep]
    del letter, keep
    if len(letters) < 3:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    # Trigrams within a text: its kept characters but the last two; those of spaces only cannot occur.
    inside = np.ones(len(letters), bool)
    inside[bounds[1:] - 1] = inside[np.maximum(bounds[1:] - 2, 0)] = False
    starts = np.flatnonzero(inside[:-2])
    places = np.searchsorted(starts, bounds)
    code = letters[starts].astype(np.uint64)
    code *= np.uint64(0x9E3779B1)
    code += letters[starts + 1]
    code *= np.uint64(0x85EBCA77)
    code += letters[starts + 2]
    del letters, starts, inside
    buckets = np.empty(len(code), np.int32)
    for lo in range(0, len(code), _SLICE):
        buckets[lo: lo + _SLICE] = mix(code[lo: lo + _SLICE]) >> np.uint64(49)
    return buckets, places


def language_tag(column: Column) -> Column:
    """Primary subtag of a declared language, null if there is none."""
    tag = F.regexp_extract(F.lower(column), r"^\s*([a-z]{2,3})(?![a-z])", 1)
    return F.when(tag != "", tag)


class TextModel:
    """Counts of trigram buckets by language, without the empty ones; `model[k]` is the log chance of every bucket."""

    def __init__(self, languages: int, language: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((bucket, language))
        self.starts = np.searchsorted(language[order], np.arange(languages + 1))
        self.buckets, self.counts = bucket[order].astype(np.int32), n[order].astype(np.float32)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at, table = slice(self.starts[k], self.starts[k + 1]), np.full(BUCKETS, FLOOR)
        table[self.buckets[at]] += self.counts[at]
        return np.log(table / table.sum()).astype(np.float32)

    def __array__(self, dtype: type | None = None, copy: bool | None = None) -> np.ndarray:
        return np.array([self[k] for k in range(len(self))], dtype or np.float32).reshape(len(self), BUCKETS)

    def __eq__(self, other: object) -> np.ndarray:
        return np.asarray(self) == np.asarray(other)

    __hash__ = None


def fit_text_model(labelled: DataFrame, text_column: str, label_column: str, train_rows: int = TRAIN_ROWS) -> tuple[list[str], TextModel]:
    """(languages, model) from rows with a label; every label is a language, however many there are.

    The model is fitted on about `train_rows` distinct texts of each, chosen by a hash of the text, on
    all if there are fewer; copies count once. Counts are a grouped aggregate, and only the model comes
    to the driver: it grows with the languages, not with the rows.
    """
    # One row per label and text: two hashes stand for the text.
    given = labelled.select(F.col(text_column).alias("text"), F.col(label_column).alias("label")).where("label is not null")
    texts = given.groupBy("label", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(31), "text").alias("g")).agg(F.count("text").alias("filled"))
    found = texts.groupBy("label").agg(F.count_if(F.col("filled") > 0).alias("texts")).orderBy("label").collect()
    languages = [r["label"] for r in found]
    index = {label: i for i, label in enumerate(languages)}
    share = F.create_map(*[x for r in found for x in (
        F.lit(r["label"]), F.lit(int(min(1.0, train_rows / max(1, r["texts"])) * (1 << 30))))]) if found else F.create_map().cast("map<string,int>")
    chosen = given.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("label")]).distinct()

    def rows_of(totals: dict[int, np.ndarray]) -> pd.DataFrame:
        at = {k: np.nonzero(t)[0] for k, t in totals.items()}
        return pd.DataFrame({
            "language": np.concatenate([np.full(len(b), k, np.int32) for k, b in at.items()]),
            "bucket": np.concatenate([b.astype(np.int32) for b in at.values()]),
            "n": np.concatenate([totals[k][b] for k, b in at.items()])})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, part in batch.dropna().groupby("label")["text"]:
                values, k = list(part), index[label]
                if k not in totals and len(totals) == _TABLES:
                    yield rows_of(totals)
                    totals = {}
                for lo, hi in groups_of_texts([len(t) for t in values], _BLOCK):
                    totals[k] = totals.get(k, 0) + np.bincount(trigrams(values[lo:hi])[0], minlength=BUCKETS)
        if totals:
            yield rows_of(totals)

    counted = chosen.mapInPandas(count, "language int, bucket int, n bigint")
    summed = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return languages, TextModel(len(languages), *(summed[c].to_numpy() for c in ("language", "bucket", "n")))


def text_evidence(text: Column, model: TextModel | np.ndarray) -> Column:
    """Struct (letters, evidence): trigrams seen, and the log likelihood of each language and last of none of them.

    The likelihood is the mean over all trigrams of the whole text times their number, at most
    EVIDENCE. None of the languages means all trigrams alike. One language's table is spread out at a time.
    """
    flat = -math.log(BUCKETS)

    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, counts, rows = list(texts), [], []
            for lo, hi in groups_of_texts([len(t) for t in values], _BLOCK):
                codes, places = trigrams(values[lo:hi])
                n = np.diff(places)
                sums = np.zeros((hi - lo, len(model) + 1))
                if len(codes):
                    for k in range(len(model)):
                        totals = np.concatenate([np.zeros(1), np.cumsum(model[k][codes], dtype=np.float64)])
                        sums[:, k] = totals[places[1:]] - totals[places[:-1]]
                sums[:, -1] = flat * n
                sums *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
                counts.append(n)
                rows += list(sums)
            yield pd.DataFrame({"letters": np.concatenate(counts) if counts else [], "evidence": pd.Series(rows, dtype=object)})

    return F.pandas_udf(evidence, "letters bigint, evidence array<double>")(F.coalesce(text, F.lit("")))


def best_of(scores: Column | str) -> Column:
    """Position of the greatest value, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once per row, however often a lambda in `body` reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _by_position(entries: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(key, array, _n): per key the counts n of positions `_own`, 0 where there is none, and their sum."""
    positions = F.sequence(F.lit(0), F.lit(size - 1))
    dense = _once(F.map_from_entries(F.collect_list(F.struct("_own", "n"))), lambda counts: F.transform(
        positions, lambda i: F.coalesce(counts[i], F.lit(0).cast("bigint"))))
    return entries.groupBy(key).agg(dense.alias(name), F.sum("n").alias("_n"))


def identify(
    rows: DataFrame, text_column: str, declared_column: str, levels: list[str], languages: list[str], model: TextModel | np.ndarray,
    keep: list[str], strength: float = PRIOR_STRENGTH,
) -> DataFrame:
    """`keep` columns and text_language, language, posterior, accepted for every row.

    `levels` are columns from coarse to fine, such as suffix, domain, host; nulls are a group of
    their own. A text without letter trigrams is `und` and not accepted, whatever it declares;
    null text is empty. An undeclared or unknown declared language is one more declared value. Kept
    columns may have any name but those of the four results.
    """
    size = len(languages) + 1
    index = F.create_map(*[F.lit(x) for i, l in enumerate(languages) for x in (l, i)]) if languages else F.create_map().cast("map<string,int>")
    level_names = [f"_level_{i}" for i in range(len(levels))]
    scored = rows.select(
        F.struct(*keep).alias("_kept"), *[F.col(c).alias(n) for c, n in zip(levels, level_names, strict=True)],
        F.coalesce(index[language_tag(F.col(declared_column))], F.lit(size - 1)).alias("_declared"),
        text_evidence(F.col(text_column), model).alias("_t"))
    scored = keep_once(scored.select("_kept", *level_names, "_declared", "_t.*").withColumn(
        "_own", F.when(F.col("letters") > 0, best_of("evidence")).otherwise(size - 1)), "language-evidence")
    voting = scored.where("letters > 0")

    # Chances of each declared value by text language: a row per declared value, one count added by half.
    pairs = keep_once(voting.groupBy("_own", "_declared").agg(F.count("*").alias("n")), "language-pairs")
    overall = np.full(size, 0.5 * size)
    for r in pairs.groupBy("_own").agg(F.sum("n").alias("n")).collect():
        overall[r["_own"]] += r["n"]
    totals = F.array(*[F.lit(float(x)) for x in overall])
    positions = F.sequence(F.lit(0), F.lit(size - 1))
    nothing = F.array_repeat(F.lit(0).cast("bigint"), size)
    chances = _by_position(pairs, "_declared", size, "_counts").select("_declared", F.zip_with(
        "_counts", totals, lambda n, t: F.log((n + 0.5) / t)).alias("_chances"))
    never = F.array(*[F.lit(float(x)) for x in np.log(0.5 / overall)])
    overall[-1] = 0
    prior = overall / max(overall.sum(), 1.0) * (1 - UNKNOWN_SHARE)
    prior[-1] = UNKNOWN_SHARE

    judged = scored.join(chances, "_declared", "left").withColumn("_prior", F.array(*[F.lit(float(p)) for p in prior]))
    for name in level_names:
        counted = voting.groupBy(F.col(name).alias("_key"), "_own").agg(F.count("*").alias("n"))
        votes = _by_position(counted, "_key", size, "_votes")
        judged = judged.join(votes, judged[name].eqNullSafe(votes["_key"]), "left").drop("_key")
        own_vote = F.when(F.col("letters") > 0, F.col("_own")).otherwise(-1)
        others = F.zip_with(F.coalesce("_votes", nothing), positions, lambda n, i: n - (own_vote == i).cast("int"))
        total = F.coalesce("_n", F.lit(0)) - (F.col("letters") > 0).cast("int")
        judged = judged.withColumn("_prior", F.zip_with(
            others, "_prior", lambda n, p: (n + strength * p) / (total + strength))).drop("_votes", "_n")
    evidence = F.zip_with("evidence", F.coalesce("_chances", never), lambda e, c: e + c)
    fused = judged.withColumn("_log", F.zip_with(evidence, "_prior", lambda e, p: e + F.log(p)))
    weight = _once(F.array_max("_log"), lambda top: F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    names = F.array(*map(F.lit, [*languages, UNKNOWN]))
    out = fused.withColumn("_best", F.when(F.col("letters") > 0, best_of("_log")).otherwise(size - 1))
    return out.select(
        "_kept.*", names[F.col("_own")].alias("text_language"), names[F.col("_best")].alias("language"),
        F.when(F.col("letters") > 0, F.lit(1.0) / weight).otherwise(1.0).alias("posterior"),
    ).withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= LEAST_POSTERIOR))


def page_evidence(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The pages with `_text` (markup removed), `_declared` (the html element's lang), `_suffix`, `_domain`, `_host`."""
    from fieldglass.llm.url_rules import host_of

    html = F.coalesce(F.col(html_column), F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    host = F.regexp_replace(host_of(url_column), r"^.*@|:\d*$", "")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    return pages.withColumns({
        "_text": body, "_declared_lang": F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1),
        "_host": F.array_join(labels, "."), "_domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "_suffix": F.coalesce(F.get(labels, F.size(labels) - 1), F.lit("")),
    })


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", declared_column: str = "lang", host_column: str = "source") -> DataFrame:
    """The rows of `docs` whose language is identified; columns unchanged, whatever their names.

    Rows without letters, or in no known language, go.
    """
    labelled = docs.select(F.col(text_column).alias("text"), language_tag(F.col(declared_column)).alias("label"))
    languages, model = fit_text_model(labelled, "text", "label")
    plain = docs.select(*[F.col(c).alias(n) for c, n in ((id_column, "id"), (text_column, "text"), (declared_column, "declared"), (host_column, "host"))])
    judged = identify(with_identity(plain, "id", "text"), "text", "declared", ["host"], languages, model, IDENTITY)
    # Equal rows but for their source or declared language may be judged apart: all go only if all are rejected.
    gone = judged.groupBy(*IDENTITY).agg(F.max("accepted").alias("any")).where("not any").select(*IDENTITY)
    names = spare_names(docs, *IDENTITY)
    named = with_identity(docs, id_column, text_column, names)
    return named.join(keep_once(gone, "rejected").toDF(*names), names, "left_anti").select(*docs.columns)
