"""One query for each operator, over its whole table."""

from __future__ import annotations

from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraload.llm import language, toxicity
from terraload.llm.catalog import ORACLES, QUERIES, register, table
from terraload.llm.decontaminate import contamination
from terraload.llm.merkle import manifest
from terraload.llm.mixing import mix
from terraload.llm.neardup import near_duplicates
from terraload.llm.paragraphs import repeated_passages
from terraload.llm.periods import periodic_runs
from terraload.llm.quality import BASE_FEATURES, judge
from terraload.llm.rollup import TokenRollup
from terraload.llm.token_files import token_digests
from terraload.llm.vector_files import top_k
from terraload.llm.warc import round_trip
from terraload.runtime import new_path

__all__ = ["ORACLES", "QUERIES"]


def vocabulary(name: str) -> str:
    """A file of the public vocabularies; installed on every machine at the same place."""
    return str(Path(find_spec("public_tokenizers").origin).with_name(name))


def fold(n: int) -> Column:
    """The remainder that says which documents labels may be learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@register("op1_toxicity_mil")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return toxicity.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted", "offending")


OP2_SQL = """
WITH hashed AS (
    SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
owned AS (
    SELECT *, max(page_id) OVER (PARTITION BY hex) AS owner,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INTEGER, 1)
            FOR i IN range(32)], '') AS payload_digest
    FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM owned
"""


@register("op2_warc_round_trip", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url", "record_id", "refers_to_id", "payload")


@register("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


OP4_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
    FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight FROM sources),
filled AS (
    SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS taken,
        sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        1.5 * (sum(source_size) OVER ())::BIGINT::DOUBLE AS budget
    FROM weighed),
price AS (SELECT arg_min((budget - taken) / open, cap / weight) AS price FROM filled WHERE cap > (budget - taken) / open * weight),
goals AS (
    SELECT source, source_size, CASE WHEN cap > price * weight THEN price * weight ELSE cap::DOUBLE END AS target
    FROM weighed, price),
placed AS (
    SELECT sized.*, source_size, target, round(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
    FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE
        (budget // source_size) * size + greatest(0, least(size, budget % source_size - earlier)) END::BIGINT AS taken
FROM placed
"""


@register("op4_mix_sources", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs.where(fold(5) != 0)))
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


@register("op6_token_rollup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go in, in a batch that comes twice; copies of earlier texts go out; texts that
    lose marks by cleaning are counted again."""
    docs = table(spark, sf_dir, "documents")
    totals = TokenRollup(spark, new_path(spark, "rollup"))
    version, tokenizer = "word_bpe_49k", vocabulary("word_bpe_49k.json")
    totals.insert("load", docs, version, tokenizer)
    totals.insert("load", docs, version, tokenizer)
    keyed = docs.select("doc_id", F.md5("text").alias("text_key"))
    firsts = keyed.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    firsts.where("n > 1").write.parquet(path := new_path(spark, "firsts"))
    copies = keyed.join(spark.read.parquet(path), "text_key").where("doc_id > first")
    totals.delete("copies", copies)
    cleaned = F.regexp_replace("text", "[*&$%#@]+", "")
    totals.revise("clean", docs.where(cleaned != F.col("text")).withColumn("text", cleaned), version, tokenizer)
    return totals.totals()


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP7_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase FROM starts),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM places),
hits AS (SELECT doc_id, i, n, item FROM runs JOIN windows USING (phrase, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@register("op7_fm_index_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = """
WITH parts AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1),
        lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM parts q JOIN parts c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@register("op8_vector_top_k", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@register("op9_paragraph_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@register("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("group", "text_key")


#: DuckDB SQL: a table for CRC-32, and the CRC-32 of a whole number's decimal digits.
_CRC_TABLE = """
crc_table(places) AS (
    SELECT list(c ORDER BY i) FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, u: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS bytes(i)))"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda c, d: xor(places[1 + (xor(c, d) & 255)], c >> 8)))"""



OP11_SQL = rf"""
WITH {_CRC_TABLE},
split AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_CRC} AS h
    FROM documents, crc_table),
shaped AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM split),
marked AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM shaped),
docs AS (
    SELECT k, doc_id, n, CASE WHEN planted
        THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % p])) ELSE w END AS w FROM marked),
words AS (SELECT k, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs),
numbered AS (SELECT k, n, i, dense_rank() OVER (ORDER BY word) AS word FROM words),
equal AS (
    SELECT x.k, y.i - x.i AS q, x.i FROM numbered x JOIN numbered y ON x.k = y.k AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
    SELECT k, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM equal) GROUP BY k, q, island
    HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
    SELECT * FROM stretches AS s WHERE NOT EXISTS (
        FROM stretches AS t WHERE t.k = s.k AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
best AS (SELECT k, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'q': q}}, (length / q, -start, -q)) AS b,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM runs GROUP BY k),
dropped AS (SELECT DISTINCT k, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period,
    (1000 * b.l // b.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the texts, by their id's CRC-32, repeat a stretch of their words up to the end."""
    h, found = F.crc32(F.col("doc_id").cast("string")), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, found))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence("a", F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # Exact: lengths and periods below 2**26 words have quotients that differ as doubles if they differ at all.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("ratio"), (-r["start"]).alias("s"),
                                                              (-r["period"]).alias("q"), r["length"].alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], F.concat_ws(",", r["length"], F.concat(r["period"].cast("string"), F.lit("\n"))))), "")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.q")).alias("period"),
        F.expr("(1000 * b.length) div -b.q").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
    SELECT row_number() OVER () AS k, doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
        CASE WHEN {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_field(_LOWERED)}) END AS other
    FROM documents, crc_table),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
    FROM leaves),
nodes(source, level, place, h, n) AS (
    SELECT source, 0, place, leaf, n FROM placed
    UNION ALL
    SELECT source, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16 FROM nodes WHERE n > 1
    GROUP BY source, level, place // 16, n),
runs AS (SELECT source, level, place // 16 AS parent, list(h ORDER BY place) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
walk(k, source, level, place, folded, proof) AS (
    SELECT k, source, 0, place, coalesce(other, leaf), '' FROM placed
    UNION ALL
    SELECT k, walk.source, walk.level + 1, place // 16,
        sha256(array_to_string(run[1:place % 16], '') || folded || array_to_string(run[place % 16 + 2:], '')),
        proof || array_to_string(run[1:place % 16], '') || array_to_string(run[place % 16 + 2:], '')
    FROM walk JOIN runs ON walk.source IS NOT DISTINCT FROM runs.source AND walk.level = runs.level AND place // 16 = parent),
low AS (SELECT * FROM walk QUALIFY level = max(level) OVER (PARTITION BY k)),
subroots AS (
    SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, place, h, n) AS (
    SELECT 0, place, subroot, n FROM subroots
    UNION ALL
    SELECT level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, place // 16, n),
top_runs AS (SELECT level, place // 16 AS parent, list(h ORDER BY place) AS run FROM tops WHERE n > 1 GROUP BY ALL),
climb(k, level, place, folded, proof) AS (
    SELECT k, 0, subroots.place, folded, proof FROM low JOIN subroots ON low.source IS NOT DISTINCT FROM subroots.source
    UNION ALL
    SELECT k, climb.level + 1, place // 16,
        sha256(array_to_string(run[1:place % 16], '') || folded || array_to_string(run[place % 16 + 2:], '')),
        proof || array_to_string(run[1:place % 16], '') || array_to_string(run[place % 16 + 2:], '')
    FROM climb JOIN top_runs ON climb.level = top_runs.level AND place // 16 = parent),
high AS (SELECT * FROM climb QUALIFY level = max(level) OVER (PARTITION BY k))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN high USING (k) JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source, (SELECT h AS root FROM tops WHERE n = 1)
"""


@register("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's CRC-32 is divisible by 5 are checked with a text in small letters."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, small)
    return manifest(table(spark, sf_dir, "documents"), changed).proofs().drop("source")


OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (VALUES (3), (10)) AS sizes(n))),
again AS (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY k, n, phrase) > 1),
covered AS (
    SELECT k, count(DISTINCT p) FILTER (n = 3) AS r3, count(DISTINCT p) FILTER (n = 10) AS r10
    FROM (SELECT k, n, unnest(range(i, i + n)) AS p FROM again) GROUP BY k),
facts AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r3, 0)::BIGINT AS n_repeat_words,
        coalesce(r10, 0) AS r10, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
        len(list_filter(w, lambda x: x LIKE '%!!')) AS exclaimed,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
        coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest,
        len(list_filter(lines, lambda l: l LIKE '-%' OR l LIKE '*%')) AS bullets,
        len(list_filter(lines, lambda l: l LIKE '%...')) AS cut
    FROM docs LEFT JOIN covered USING (k)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
        OR 10 * n_dup_lines > 3 * n_lines OR 2 * capitals > letters OR 10 * exclaimed > n_words OR 10 * lettered < 7 * n_words
        OR longest > 1000 OR 10 * bullets > 9 * n_lines OR 10 * cut > 3 * n_lines OR 10 * r10 > 3 * n_words) AS kept
FROM based
"""


@register("op13_quality_cascade", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *BASE_FEATURES, "base_failed", "kept")
