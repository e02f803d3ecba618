"""The operators bound to the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import (
    credentials, fingerprints, language, licences, minhash, mixing, nearest, packing, phrases, sharding, spelling, url_rules, vectors,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


URL_RULES_SQL = """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) as rule,
    arg_max(verdict, length(rule_host) + length(rule_path)) as verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id
)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict
from parts left join best using (page_id)
"""


@query("op3_url_rules", URL_RULES_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), url_rules.rule_table(spark, url_rules.RULES))


MIX_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, row_number() over (order by source nulls last) - 1 as k from sources
), capped as (
  select *, (case k % 3 when 0 then 5 when 1 then 2 else 1 end)::double as weight, 3 * source_size as cap from ranked
), ratios as (
  select *, cap / weight as ratio, sum(source_size) over () as total, sum(weight) over () as all_weights from capped
), levels as (
  select *, (total - coalesce(sum(cap) over before, 0))::double / (all_weights - coalesce(sum(weight) over before, 0)) as own_level
  from ratios window before as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)
), level as (
  select max(own_level) filter (own_level <= ratio) as level from levels
), targets as (
  select source, k, source_size, case when level is null or level >= ratio then cap::double else level * weight end as target,
    greatest(1, ceil(source_size / {mixing.BLOCK_WORDS}.0))::bigint as n_blocks
  from levels, level
), passes as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from targets
), placed as (
  select doc_id, size, p.*, ('0x' || substr(md5('block|' || coalesce(doc_id::varchar, '-')), 1, 12))::bigint % n_blocks as block,
    target - passes * source_size as left_over
  from sized join passes p on sized.source is not distinct from p.source
), block_words as (
  select k, block, sum(size)::bigint as words from placed group by k, block
), block_ends as (
  select k, block, words, sum(words) over (partition by k order by block) as through from block_words
), drawn as (
  select placed.*, through, words, through <= left_over and left_over > 0 as in_full,
    sum(size) over (partition by k, block
      order by ('0x' || substr(md5('edge|' || coalesce(doc_id::varchar, '-')), 1, 12))::bigint, doc_id, size
      rows between unbounded preceding and current row) as own_through
  from placed join block_ends using (k, block)
)
select doc_id, size, source_size, target, size * (passes + case
    when in_full then 1
    when through - words < left_over and size > 0 and own_through - size / 2.0 <= left_over - (through - words) then 1
    else 0 end)::bigint as taken
from drawn
"""


@query("op7_mixing", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.allocate(table(spark, folder, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SHARD_SQL = f"""
with recursive sized as (
  select doc_id, strlen(coalesce(text, ''))::bigint as bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '-') || '|' || md5(coalesce(text, ''))), 1, 12))::bigint as hash from documents
), keyed as (
  select doc_id, bytes, substr(hash::bit::varchar, 17) as bits from sized
), open as (
  select doc_id, bytes, bits, 0 as depth, sum(bytes) over () as shard_bytes, count(*) over () as shard_rows from keyed
  union all
  select doc_id, bytes, bits, depth + 1, sum(bytes) over (partition by substr(bits, 1, depth + 1)),
    count(*) over (partition by substr(bits, 1, depth + 1))
  from open where shard_bytes > {sharding.LIMIT} and shard_rows > 1 and depth < {sharding.CONTENT_BITS}
)
select doc_id, bytes, substr(bits, 1, depth) as shard, depth, shard_bytes::bigint as shard_bytes, shard_rows
from open where shard_bytes <= {sharding.LIMIT} or shard_rows = 1
"""


@query("op8_sharding", SHARD_SQL)
def shard(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_credentials")
def scan_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.scan(table(spark, folder, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(i).eqNullSafe)).cast("long").alias(f"n_{k}") for i, k in enumerate(credentials.BASE_KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(credentials.span_text("base"), 256).alias("base_sha256"),
        credentials.span_text(F.concat("base", "linked")).alias("spans"))


NEAR_SQL = """
with recursive words as (
  select doc_id, [w for w in regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') if w <> ''] as w from documents
), grams as (
  select doc_id, w, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as g from words
), classes as (
  select min(doc_id) as node, w, any_value(g) as g from grams group by w
), flat as (
  select node, len(g) as n, unnest(g) as s from classes
), shared as (
  select a.node as a, b.node as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n_both
  from flat a join flat b on a.s = b.s and a.node < b.node group by 1, 2
), links as (
  select a, b from shared where n_both >= 0.8 * (na + nb - n_both) - 1e-9
), sym as (
  select a, b from links union select b, a from links
), reach as (
  select node as start, node from classes
  union
  select reach.start, sym.b from reach join sym on reach.node = sym.a
), component as (
  select start as node, min(node) as component_id from reach group by start
)
select doc_id, component_id, doc_id = component_id as kept
from grams join classes using (w) join component using (node)
"""


@query("op6_near_duplicates", NEAR_SQL)
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "component_id", "kept")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_packing")
def pack_documents(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, folder, "documents"), tokenizer_path())
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


@query("op1_language")
def identify_language(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (declared language and source) and pages (html language and address) in one run of the text model."""
    documents, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    labelled = documents.select("text", language.language_tag(F.col("lang")).alias("label"))
    languages, model = language.fit_text_model(labelled, "text", "label")
    columns = ["text_language", "language", F.round("posterior", 6).alias("posterior"), "accepted"]
    of_documents = language.identify(documents, "text", "lang", ["source"], languages, model, ["doc_id"])
    of_pages = language.identify(
        language.page_evidence(pages), "_text", "_declared_lang", ["_suffix", "_domain", "_host"], languages, model, ["page_id"])
    return of_documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), *columns).unionByName(
        of_pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *columns))


VECTOR_SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), sized as (
  select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from usable
), links as (
  select a.vec_id as a, b.vec_id as b from sized a join sized b
    on a.label = b.label and a.vec_id <> b.vec_id and a.size > 0 and b.size > 0 and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach as (
  select vec_id as start, vec_id as node from embeddings
  union
  select reach.start, links.b from reach join links on reach.node = links.a
), component as (
  select start as vec_id, min(node) as component_id from reach group by start
), counts as (
  select a as vec_id, count(*) as n_links from links group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings left join counts using (vec_id) join component using (vec_id)
"""


@query("op4_vector_copies", VECTOR_SQL)
def vector_copies(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query("op5_fingerprints")
def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, folder, "documents"))


@query("op2_licences")
def scan_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.families_of_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return found.withColumn("chance", F.round("chance", 6))


# The crc32 of each `<id>:<run>`, byte by byte over a table made by its rule; near words share a form with one code point left out.
SPELLING_SQL = """
with recursive crc_bits(i, c, k) as (
  select i, i::ubigint, 0 from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from crc_bits where k < 8
), crc_table as (
  select list(c order by i) as crc from crc_bits where k = 8
), runs as (
  select coalesce(doc_id::varchar, '') as id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), distinct_runs as (
  select id, run, count(*) as n, hex(encode(id || ':' || run)) as bytes from runs group by id, run
), hashed as (
  select run, n, xor(list_reduce(
      list_prepend(4294967295::ubigint, [('0x' || bytes[2 * i - 1 : 2 * i])::ubigint for i in range(1, length(bytes) // 2 + 1)]),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255)::int + 1])), 4294967295::ubigint) as h
  from distinct_runs, crc_table
), spelt as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
), words as (
  select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by word having sum(n) >= 3
), shorter as (
  select word, n, i, length(word) as size, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from words, lateral (select unnest(range(1, length(word) + 1)) as i)
), near as (
  select a.word, b.word as near, b.n as near_n from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word
), best as (
  select word, count(*)::bigint as n_near, max(near_n) as form_n, arg_min(near, row(-near_n, near)) as form from near group by word
), formed as (
  select w.word, case when form_n >= 2 * n then form end as form, n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * n then form_n end as form_n
  from words w left join best using (word)
), chain as (
  select word, word as here, 0 as steps from formed
  union all
  select chain.word, formed.form, steps + 1 from chain join formed on chain.here = formed.word where formed.form is not null
), roots as (
  select word, arg_max(here, steps) as root from chain group by word
)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""


@query("op13_spelling", SPELLING_SQL)
def group_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.counted(spelling.misspelt_counts(table(spark, folder, "documents"))))


PHRASE_SQL = """
with texts as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from texts
), words as (
  select lang, [w for w in regexp_split_to_array(piece, '[\\x20\\x09]+') if w <> ''] as w from pieces
), sizes as (
  select lang, sum(len(w))::hugeint as n from words group by lang
), placed as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
), spans as (
  select lang, w[i : i + k - 1] as p from placed, range(1, 6) t(k) where i + k - 1 <= len(w)
), phrases as (
  select lang, p, count(*)::hugeint as f from spans group by lang, p having count(*) >= 100
), covered as (
  select lang, p, max(f) as longer from (
    select lang, p[1 : len(p) - 1] as p, f from phrases where len(p) > 2 union all select lang, p[2 : len(p)], f from phrases where len(p) > 2) group by lang, p
), open as (
  select lang, p, f from phrases left join covered using (lang, p) where len(p) > 1 and coalesce(longer < f, true)
), cuts as (
  select lang, p, f as a, unnest(range(1, len(p))) as k from open
), scored as (
  select c.lang, c.p, c.k, c.a, l.f as l, r.f as r, n, 1000 * a * n // (l.f * r.f) as score
  from cuts c join phrases l on l.lang = c.lang and l.p = c.p[1 : c.k] join phrases r on r.lang = c.lang and r.p = c.p[c.k + 1 : len(c.p)]
  join sizes on sizes.lang = c.lang
), weakest as (
  select lang, array_to_string(p, ' ') as phrase, unnest(arg_min({'a': a, 'l': l, 'r': r, 'n': n, 'score': score}, row(score, k))) from scored group by lang, p
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
  a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from weakest qualify rank <= 2000
"""


@query("op11_phrases", PHRASE_SQL)
def mine_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op12_nearest")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
