"""Secret scans that link the parts of a credential.

Strong parts are reported wherever they stand. A weak part (a short hex run, a bare access
identifier, a long mixed token, an account name) is reported only when a part of a complementary
role lies in its scope: access identifiers, secrets and endpoints belong together. Scopes are
intervals of code points, and parts meet in an interval join on (document, place bucket). Parts that
overlap say nothing about each other. Paths, named commits and parts of an address are no secrets, except
a password before its host and the value of a signature or key parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm.tables import keep_once, spare_names

# Base patterns and their least lengths.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE_KINDS = ["assign", "access", "hex"]

# Weak candidates and the role of each kind of part.
WEAK_KINDS = ["short_access", "short_hex", "mixed", "account", "endpoint"]
KINDS = [*BASE_KINDS, *WEAK_KINDS]
ROLE = {
    "assign": "secret", "access": "access", "hex": "secret", "short_access": "access", "short_hex": "secret",
    "mixed": "secret", "account": "access", "endpoint": "endpoint",
}
COMPLEMENTS = {"access": ["secret"], "secret": ["access", "endpoint"], "endpoint": ["secret"]}
RUN = re.compile(r"[A-Za-z0-9+/_]{8,}")
SHORT_ACCESS = re.compile(r"(?<![A-Za-z0-9])A[KS]IA(?=[A-Z]*[0-9])[A-Z0-9]{4,}(?![A-Za-z0-9])")  # of any length that is no base match
SHORT_HEX = re.compile(r"[0-9a-f]{12,23}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).{20,}", re.DOTALL)
ACCOUNT_WORDS = ("user", "login", "client", "account")
ACCOUNT = re.compile(
    r"\b(?:user(?:name)?|login|client_?id|account)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9._-]{3,}", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"\b[A-Za-z][A-Za-z0-9+.:-]{1,30}://[^\s\"'<>]{4,}", re.ASCII)
# Secrets inside an address: a password before the host, a signature or key parameter, a field behind a comma.
INNER = re.compile(
    r"://[^\s/?#@:]*:(?P<password>[^\s/?#@]+)@|[?&;](?:[a-z_.-]*sig(?:nature)?|[a-z_.-]*key|pwd|auth)=(?P<value>[^&#;,\s]+)"
    r"|[,;](?P<field>[A-Za-z0-9+/_]+)(?![^,;])", re.ASCII | re.IGNORECASE)
COMMIT = re.compile(r"\b(?:commits?|revision|rev|sha-?1?|changeset|checkout|cherry-pick(?:ed)?|merged?|reverts?|git|index|fixes)\b[^A-Za-z0-9]{1,4}$|[0-9a-f]{7}\.\.\.?$", re.IGNORECASE)
PATH_START = re.compile(r"/?(?:[a-z][a-z]+/){2}|/[a-z]{2,}/")
PATH_END = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,4}(?![A-Za-z0-9])")
WORD_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SCOPE = 200  # code points between two parts of one credential

OWN_COLUMNS = ("_row", "_weak", "_parts", "base", "linked")
_DIGIT = re.compile(r"[0-9]")
SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
PARTS = T.StructType([T.StructField("strong", T.ArrayType(SPAN)), T.StructField("weak", T.ArrayType(SPAN))])


def strong_parts(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches of a whole text: leftmost, not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _DIGIT.search(text) or len(text) >= 24:
        out += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _has_account_word(low: str) -> bool:
    return any(w in low for w in ACCOUNT_WORDS)


def _is_path(text: str, start: int, end: int) -> bool:
    """A run that is a file path or words joined by signs: random tokens have letters alone between other kinds."""
    run = text[start:end]
    if "/" in run and (PATH_START.match(run) or PATH_END.match(text, end) or run[0] == "/" and text[max(0, start - 1):start] in (".", "~")):
        return True
    segments = [WORD_PIECE.findall(x) for x in re.split(r"[/_]+", run) if x]
    if len(segments) < 2:
        return False
    pieces = [p for s in segments for p in s]
    alone = any(len(p) == 1 and p.isalpha() for s in segments if len(s) > 1 for p in s)
    return not alone and sum(map(len, pieces)) >= 2.5 * len(pieces)


def _secret_kind(value: str) -> int | None:
    if SHORT_HEX.fullmatch(value):
        return None if value.isdigit() else KINDS.index("short_hex")
    return KINDS.index("mixed") if MIXED.fullmatch(value) else None


def _address_parts(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(addresses, parts): whole addresses, and as candidates the secrets inside them and what is left as endpoint."""
    addresses, parts = [], []
    for m in ENDPOINT.finditer(text):
        start, end = m.span()
        addresses.append((start, end))
        first, inner_end = start, end
        for inner in INNER.finditer(text, start, end):
            span = inner.span(inner.lastgroup)
            kind = _secret_kind(unquote(inner[inner.lastgroup]))
            if kind is None or inner.lastgroup == "field" and _is_path(text, *span):
                continue
            parts.append((kind, *span))
            if inner.lastgroup == "password":
                first = span[1] + 1
            else:
                inner_end = min(inner_end, span[0])
        parts.append((KINDS.index("endpoint"), first, inner_end))
    return addresses, parts


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no strong part."""
    addresses, found = _address_parts(text) if "://" in text else ([], [])
    if _DIGIT.search(text):
        at = 0
        for m in RUN.finditer(text):
            run, (start, end) = m[0], m.span()
            if run.isalpha():
                continue
            while at < len(addresses) and addresses[at][1] <= start:
                at += 1
            inside = at < len(addresses) and addresses[at][0] <= start
            if inside:
                continue
            if SHORT_HEX.fullmatch(run):
                if not run.isdigit() and not COMMIT.search(text[max(0, start - 24):start]):
                    found.append((KINDS.index("short_hex"), start, end))
            elif MIXED.fullmatch(run) and not _is_path(text, start, end):
                found.append((KINDS.index("mixed"), start, end))
        found += [(KINDS.index("short_access"), *m.span()) for m in SHORT_ACCESS.finditer(text)]
    if ("=" in text or ":" in text) and _has_account_word(text.lower()):
        found += [(KINDS.index("account"), *m.span()) for m in ACCOUNT.finditer(text)]
    if not found:
        return []
    found.sort(key=lambda s: (s[1], s[0], s[2]))
    out, at, reach = [], 0, -1
    for span in found:
        while at < len(strong) and strong[at][1] < span[2]:
            reach = max(reach, strong[at][2])
            at += 1
        if reach <= span[1]:
            out.append(span)
    return out


def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            strong = strong_parts(text) if isinstance(text, str) else []
            rows.append((strong, weak_parts(text, strong) if isinstance(text, str) else []))
        yield pd.DataFrame(rows, columns=["strong", "weak"])


def scan(docs: DataFrame, text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row of `docs` without its text, with `_row` and arrays `base` and `linked` of spans (kind, start, end).

    Kinds are positions in KINDS. `linked` holds the weak candidates that a complementary part
    confirms, `base` the strong parts. Null text is empty. Repeated rows and null ids are rows of
    their own: rows are told apart by a number given when the parts are written. Long texts are read
    whole; their parts meet in buckets of one scope, so no document is one group. Columns of `docs` with
    the names of the operator's own are left out.
    """
    extract = F.pandas_udf(_extract, PARTS)
    kept = [c for c in docs.columns if c not in (text_column, *OWN_COLUMNS)]
    parts = docs.select(*kept, extract(F.coalesce(text_column, F.lit(""))).alias("_parts"))
    parts = keep_once(parts.select(
        *kept, F.monotonically_increasing_id().alias("_row"), F.col("_parts.strong").alias("base"), F.col("_parts.weak").alias("_weak"),
    ), "credential-parts")
    return parts.join(link(parts, scope), "_row", "left").drop("_weak").withColumn(
        "linked", F.coalesce("linked", F.array().cast(T.ArrayType(SPAN))))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row, linked): weak candidates with a complementary part within the scope that does not overlap them."""
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])])
    wants = F.create_map(*[y for r, c in COMPLEMENTS.items() for y in (F.lit(r), F.array(*map(F.lit, c)))])
    open_rows = parts.where(F.size("_weak") > 0)
    weak = open_rows.select("_row", F.explode("_weak").alias("w")).select(
        "_row", F.col("w.kind").alias("kind"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    every = open_rows.select("_row", F.explode(F.concat("base", "_weak")).alias("p")).select(
        "_row", role[F.col("p.kind")].alias("role"), F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))
    # A candidate's scope covers few buckets; a part is filed under each bucket it touches.
    scopes = weak.withColumn("want", F.explode(wants[role[F.col("kind")]])).withColumn("bucket", F.explode(F.sequence(
        F.floor((F.greatest(F.col("start") - scope, F.lit(0))) / scope), F.floor((F.col("end") + scope) / scope))))
    filed = every.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("p_start") / scope), F.floor(F.col("p_end") / scope))))
    met = scopes.join(
        filed, (scopes["_row"] == filed["_row"]) & (scopes["bucket"] == filed["bucket"]) & (F.col("want") == F.col("role"))
        & (F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") >= F.col("start") - scope)
        & ((F.col("p_end") <= F.col("start")) | (F.col("p_start") >= F.col("end"))), "left_semi")
    spans = met.select("_row", F.struct("kind", "start", "end").alias("span")).distinct()
    return spans.groupBy("_row").agg(F.sort_array(F.collect_list("span")).alias("linked"))


def span_text(spans: str) -> F.Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_column: str = "text", size_column: str | None = "n_chars", scope: int = SCOPE) -> DataFrame:
    """The rows with every reported span replaced by its kind in angle brackets; overlapping spans become one.

    Texts without a span come back as they are, null included, and so does their size. Columns are
    unchanged, whatever their names. Nothing is written here: the caller's table is the only copy. As
    texts are long, they go to Python a hundred at a time, not in Arrow batches of ten thousand.
    """
    def cut(text: str | None) -> str | None:
        return None if text is None else redacted(text, scope)

    clean, = spare_names(docs, "_clean")
    new = docs.withColumn(clean, F.udf(cut, "string", useArrow=False)(text_column))
    changed = F.col(clean) != F.col(text_column)
    out = {text_column: F.col(clean)}
    if size_column:
        out[size_column] = F.when(changed, F.length(clean).cast(docs.schema[size_column].dataType)).otherwise(F.col(size_column))
    return new.withColumns(out).select(*docs.columns)


def linked_in_text(text: str, strong: list, weak: list, scope: int) -> list[tuple[int, int, int]]:
    """The interval join within one text already at hand: both lists lie by start, a window slides over the parts."""
    parts = sorted([*strong, *weak], key=lambda s: s[1])
    longest = max((p[2] - p[1] for p in parts), default=0)
    out, low = [], 0
    for kind, start, end in weak:
        while low < len(parts) and parts[low][1] < start - scope - longest:
            low += 1
        for other, p_start, p_end in parts[low:]:
            if p_start > end + scope:
                break
            if p_end >= start - scope and (p_end <= start or p_start >= end) and ROLE[KINDS[other]] in COMPLEMENTS[ROLE[KINDS[kind]]]:
                out.append((kind, start, end))
                break
    return out


def redacted(text: str, scope: int = SCOPE) -> str:
    strong = strong_parts(text)
    weak = weak_parts(text, strong)
    spans = sorted([*strong, *linked_in_text(text, strong, weak, scope)], key=lambda s: (s[1], s[0]))
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
