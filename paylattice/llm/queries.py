"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylattice.llm import (
    chat, jaccard_join, line_dedup, mixing, packing, periodic, quality_rules, sharding, simhash, suffix_dedup, topk,
    url_filter, whitening,
)
from paylattice.llm.common import let, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def query(name: str):
    def add(build):
        QUERIES[name] = build
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_quality_rules")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.quality_verdicts(docs, table(spark, folder, "labels"))
    return judged.select(
        "doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality_rules.base_failed(F.col("m")).alias("base_failed"), "kept",
    )


# Rules of the registered url query: verdict, host, path. Fixed values.
URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]


@query("op8_url_filter")
def _(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("page_id", "url_filter.*")


SQL["op8_url_filter"] = r"""
WITH located AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule
  FROM located)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op9_two_pass_shuffle")
def _(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.scatter_and_shuffle(table(spark, folder, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "place.shard", "place.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_event_chat")
def _(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    # a stored turn is one event that states its whole message
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    events = turns.withColumns({"seq": place, "message": place, "kind": F.lit("message")})
    rendered = chat.render(chat.fold(events))
    read = rendered.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for mark in chat.CONTROLS:
        out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return out


SQL["op2_event_chat"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')})
    + CASE WHEN role = 'assistant' THEN 5 + 5 + 4 ELSE 6 + 5 + 7 END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op4_block_topk")
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", topk.integer_vector(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


SQL["op4_block_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op1_flow_mix")
def _(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op3_nnls_packing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op6_line_chunks")
def _(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.remove_repeated_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "line_dedup.*", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query("op10_suffix_array")
def _(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeated_strings(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", *[f"suffix_dedup.{c}" for c in ("n_bytes", "n_removed", "n_spans")],
        F.sha2("suffix_dedup.kept", 256).alias("kept_sha256"),
    )


@query("op5_chosen_path_join")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def planted_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, drawn by the checksum of the id, repeat a part of their words."""
    split = docs.select("doc_id", "text", words(F.col("text")).alias("w"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10).cast("long")
    first = F.when(n > 0, g % n)
    period = F.lit(1).cast("long") + F.floor((n - first) / (F.lit(3) + g % 8)).cast("long")
    chosen = F.coalesce((F.col("h") % 10 == 0) & (n > 0), F.lit(False))
    repeated = F.array_join(periodic.repeat_words(F.col("w"), first, period), " ")
    return split.select("doc_id", F.when(chosen, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(planted_texts(table(spark, folder, "documents").select("doc_id", "text")))
    runs = F.col("periodic.runs")
    listed = F.array_join(
        F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )
    best = periodic.strongest(runs)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        let(best, lambda b: (1000 * b["length"] - 1000 * b["length"] % b["period"]) / b["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("periodic.collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


# All equal five-word windows of a text, gaps and islands per lag, and of nested runs the smallest period.
SQL["op13_periodic_runs"] = rf"""
WITH split AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), {WORD_SQL}) AS w,
    4294967295 - list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, v: CASE WHEN v >= 0 THEN xor(c, v)
        ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END) AS h
  FROM documents),
drawn AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS chosen FROM split),
placed AS (SELECT *, CASE WHEN chosen THEN g % n END AS a FROM drawn),
sized AS (SELECT *, CASE WHEN chosen THEN 1 + (n - a) // (3 + g % 8) END AS p FROM placed),
docs AS (
  SELECT d, doc_id, CASE WHEN chosen THEN
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w, n
  FROM sized),
word AS (SELECT d, unnest(range(n)) AS i, unnest(w) AS x FROM docs),
grams AS (
  SELECT d, i, array_to_string([x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o], ' ') AS x
  FROM word WINDOW o AS (PARTITION BY d ORDER BY i) QUALIFY lead(x, 4) OVER o IS NOT NULL),
pairs AS (
  SELECT a.d, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.d, b.i - a.i ORDER BY a.i) AS island
  FROM grams a JOIN grams b ON a.d = b.d AND a.x = b.x AND a.i < b.i),
stretch AS (
  SELECT d, min(i) AS start, max(i) - min(i) + 5 + q AS length, q AS period FROM pairs GROUP BY d, q, island),
long_enough AS (SELECT * FROM stretch WHERE length >= greatest(6, 4 * period)),
runs AS (
  SELECT * FROM long_enough r WHERE NOT EXISTS (
    SELECT 1 FROM stretch s WHERE s.d = r.d AND s.period < r.period AND s.start <= r.start
      AND s.start + s.length >= r.start + r.length)),
best AS (
  SELECT * FROM runs a QUALIFY row_number() OVER (PARTITION BY d ORDER BY
    CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (
  SELECT d, count(*) AS n_runs,
    string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT word.d, string_agg(x, ' ' ORDER BY word.i) AS collapsed
  FROM word LEFT JOIN gone ON word.d = gone.d AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (d) LEFT JOIN best USING (d) LEFT JOIN kept USING (d)
"""


@query("op11_simhash_trie")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op12_block_whitening")
def _(spark: SparkSession, folder: str) -> DataFrame:
    x = whitening.fixed_point(F.col("embedding"), scale=64, shift=1_000_000)
    rows = whitening.whiten(table(spark, folder, "embeddings").select("vec_id", x.alias("vector")), components=32)
    pairs = F.arrays_zip("whitening.whitened", "whitening.explained")
    return rows.select("vec_id", "whitening.*", F.posexplode(pairs).alias("place", "pair")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "pair.whitened", "pair.explained",
        "identity_error",
    )
