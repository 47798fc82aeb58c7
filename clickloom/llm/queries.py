"""The operators as queries over the given tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import (
    chunked_bpe,
    decontaminate,
    licenses,
    lm,
    packing,
    periodic,
    quality,
    simhash,
    spelling,
    token_files,
    toxicity,
    urls,
)
from clickloom.llm.line_dedup import LineIndex
from clickloom.llm.texts import crc32_rest
from clickloom.session import scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and its SQL twin if there is one."""

    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A-Z in lower case, all else as it is.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The white space of words and lines.
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op7_line_dedup",
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    keyed AS (
        SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines),
    frequent AS (
        SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    flagged AS (
        SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))
            AS kept_sha256
    FROM flagged GROUP BY doc_id
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is in ten documents or more, dropped from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = LineIndex.build(docs, threshold=10, min_chars=1).strip(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WORDS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")},
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@query(
    "op4_decontaminate",
    f"""
    WITH items AS (
        SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
        FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
    docs AS (
        SELECT doc_id, {_WORDS} AS w FROM documents),
    grams AS (
        SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
        FROM docs, (SELECT DISTINCT len(win) AS n FROM windows),
            unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
    hits AS (
        SELECT g.doc_id, g.i, g.n, v.item_id FROM grams g JOIN windows v ON g.win = v.win),
    words AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
    owners AS (
        SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
        coalesce(o.n_items, 0)::BIGINT AS n_items, sha256(coalesce(o.ids, '')) AS items_sha256,
        coalesce(h.n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN owners o ON d.doc_id = o.doc_id
    """,
)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside ten-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the bit-packed token files and back."""
    path = scratch_path(spark, "token-files")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary, end_id=2)
    docs = token_files.read(spark, path).select(
        "part",
        "shard",
        "first",
        F.col("key").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    found = token_files.with_starts(stored(docs, "token-counts"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    placed = packing.pack(table(spark, sf_dir, "documents"), vocabulary, end_id=0, length=2048)
    return placed.withColumnRenamed("key", "doc_id")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most three bits, step by step."""
    groups = simhash.near_copies(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return groups.toDF("doc_id", "fingerprint", "component_id")


def _left_sql(text: str, pattern: str) -> str:
    return f"length(regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g'))"


_ENDS = quality.ENDS.replace("'", "''")


@query(
    "op6_quality_rules",
    f"""
    WITH docs AS (
        SELECT doc_id, body, string_split(body, chr(10)) AS parts,
            regexp_extract_all(body, '[^ \\t\\n\\x0B\\f\\r]+') AS w
        FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)),
    lines AS (
        SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
    judged AS (
        SELECT doc_id, pos, line, regexp_matches(line, '{quality.WORD}') AS real,
            regexp_matches(line, '{quality.WORD}') AND (
                {_left_sql("line", quality.NOT_SIGNS)}
                    > {quality.SIGN_SHARE}::DOUBLE * length(line)
                OR ({_left_sql("line", quality.NOT_BARS)} >= 2 AND
                    {_left_sql("line", quality.NOT_BARS)}
                        > {quality.BAR_SHARE}::DOUBLE * length(line))
                OR (length(line) <= {quality.MENU_CHARS}
                    AND NOT regexp_matches(line, '{_ENDS}'))
                OR (length(line) <= {quality.PHRASE_CHARS}
                    AND regexp_matches(lower(line), '{quality.PHRASES}'))) AS bad
        FROM lines),
    by_doc AS (
        SELECT doc_id, count(*) FILTER (bad) AS n_bad_lines,
            count(*) FILTER (real) - count(DISTINCT line) FILTER (real) AS n_dup_lines,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS good
        FROM judged GROUP BY doc_id),
    grams AS (
        SELECT doc_id, i, list_slice(w, i, i + 7) AS win
        FROM docs, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i)),
    twice AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM grams),
    repeats AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 8)) AS u(p)
        WHERE twice.n > 1 GROUP BY doc_id),
    figures AS (
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
            length(array_to_string(d.w, ''))::BIGINT AS word_chars,
            {_left_sql("body", quality.SYMBOLS)}::BIGINT AS n_symbols,
            b.n_dup_lines::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
            b.n_bad_lines::BIGINT AS n_bad_lines,
            CASE WHEN body = '' THEN 0.0::DOUBLE
                ELSE 1 - length(b.good)::DOUBLE / length(body)::DOUBLE END AS lost_share
        FROM docs d JOIN by_doc b ON d.doc_id = b.doc_id
            LEFT JOIN repeats r ON d.doc_id = r.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_share <= 0.5 AS kept
    FROM figures
    """,
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of the line-first rules for every document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_bad_lines",
        "base_failed",
        "kept",
    )


#: Verdict, host and path.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def _shrunk_sql(name: str, source: str, parents: str, by: str) -> str:
    """A level: its strength from the spread about the rates above, then its shrunk rates."""
    return f"""
    {name}_k AS (
        SELECT 1 / CASE WHEN units <= up_units OR n - squares / n - (units - up_units) <= 0
            THEN {urls.LEAST_RHO}::DOUBLE ELSE least({urls.MOST_RHO}::DOUBLE, greatest(
                {urls.LEAST_RHO}::DOUBLE,
                (spread - (units - up_units)) / (n - squares / n - (units - up_units)))) END - 1
            AS k
        FROM (SELECT count(*) AS units, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS squares,
                sum(n * pow(x / n - up, 2) / (up * (1 - up))) AS spread
            FROM {source} WHERE n > 0), (SELECT {parents} AS up_units)),
    {name} AS (
        SELECT {by}, n, x, k, (x + k * up) / (n + k) AS mean FROM {source}, {name}_k)"""


@query(
    "op10_url_filters",
    f"""
    WITH parsed AS (
        SELECT page_id, CASE WHEN has THEN {_LOWER.format("regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1)")}
                ELSE '' END AS host,
            CASE WHEN has THEN regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
        FROM (SELECT page_id, coalesce(url, '') AS u, contains(coalesce(url, ''), '://') AS has
            FROM pages)),
    known AS (
        SELECT doc_id, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
    base AS (
        SELECT host, host.string_split('.')[-2:].array_to_string('.') AS domain,
            host.string_split('.')[-1] AS suffix, count(bad) AS n,
            (count(*) FILTER (bad))::DOUBLE AS x
        FROM parsed p LEFT JOIN known k
            ON k.doc_id = TRY_CAST(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) AS BIGINT)
        GROUP BY host),
    total AS (SELECT sum(x) / sum(n) AS up FROM base),
    s0 AS (
        SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(up) AS up FROM base, total
        GROUP BY suffix),
    {_shrunk_sql("s1", "s0", "1", "suffix")},
    d0 AS (
        SELECT domain, suffix, sum(b.n) AS n, sum(b.x) AS x, any_value(s1.mean) AS up
        FROM base b JOIN s1 USING (suffix) GROUP BY domain, suffix),
    {_shrunk_sql("d1", "d0", "(SELECT count(*) FROM s1)", "domain, suffix")},
    h0 AS (
        SELECT host, b.n, b.x, d1.mean AS up FROM base b JOIN d1 USING (domain, suffix)),
    {_shrunk_sql("h1", "h0", "(SELECT count(*) FROM d1)", "host")},
    bounds AS (
        SELECT host, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (n + k + 1)) AS bound FROM h1),
    rules(verdict, rule_host, rule_path) AS (
        VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
    fitting AS (
        SELECT page_id, rule_host || rule_path AS rule, verdict, row_number() OVER (
            PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
        FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
            AND starts_with(path, rule_path))
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(
            f.verdict, CASE WHEN b.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
        round(b.bound, 6) AS bad_bound
    FROM parsed p JOIN bounds b USING (host)
        LEFT JOIN fitting f ON f.page_id = p.page_id AND f.place = 1
    """,
)
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation for every page.

    A page shows the document whose number its path holds; that document's label is its outcome.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.regexp_extract("path", r"\A/[^/]*/([0-9]+)", 1).try_cast("long")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    outcomes = (
        urls.parsed(pages, "url")
        .select(F.col("page_id").alias("key"), shown.alias("doc_id"))
        .join(labels, "doc_id")
        .select("key", "bad")
    )
    judged = urls.judge(pages, outcomes, URL_RULES)
    return judged.withColumn("bad_bound", F.round("bad_bound", 6)).withColumnRenamed(
        "key", "page_id"
    )


_TEMPLATE_ROWS = ", ".join(
    f"({i}, '{name}', '{body}')" for i, (name, body) in enumerate(licenses.TEMPLATES)
)
_STOPS = ", ".join(f"'{w}'" for w in licenses.STOP_WORDS)
#: Every 64th document of a source and language is its folder's licence file.
_PATH_SQL = """source || '/' || lang || '/' || (doc_id // 64)::VARCHAR || '/' ||
    CASE WHEN doc_id % 64 = 0 THEN 'LICENSE.' ELSE '' END || doc_id::VARCHAR"""


def _terms_sql(text: str) -> str:
    return f"""list_filter(regexp_extract_all(lower({text}), '{licenses.TERM}'),
        lambda t: t NOT IN ({_STOPS}))"""


@query(
    "op1_license_scan",
    f"""
    WITH files AS (SELECT {_PATH_SQL} AS path, text FROM documents),
    lines AS (SELECT path, unnest(string_split(text, chr(10))) AS unit FROM files),
    templates(template, licence, body) AS (VALUES {_TEMPLATE_ROWS}),
    tt AS (
        SELECT template, licence, term, count(*) AS tf FROM (
            SELECT template, licence, unnest({_terms_sql("body")}) AS term FROM templates)
        GROUP BY ALL),
    words AS (SELECT DISTINCT term FROM tt),
    marked AS (
        SELECT DISTINCT path, unit, TRUE AS line, {_terms_sql("unit")} AS terms FROM lines
        UNION ALL
        SELECT DISTINCT path, text, FALSE, {_terms_sql("text")} FROM files
        WHERE path LIKE '%/LICENSE.%'),
    units AS (
        SELECT path, unit, line, terms FROM marked
        WHERE NOT line OR list_has_any(terms, (SELECT list(term) FROM words))),
    total AS (SELECT ln(count(*) + 1.0::DOUBLE) + 1 AS rare FROM lines),
    df AS (
        SELECT term, count(*) AS df FROM (
            SELECT unnest(list_distinct({_terms_sql("unit")})) AS term FROM lines)
        WHERE term IN (SELECT term FROM words) GROUP BY term),
    idf AS (
        SELECT term, rare - ln(coalesce(df, 0) + 1.0::DOUBLE) AS idf
        FROM words LEFT JOIN df USING (term), total),
    tw AS (
        SELECT template, licence, term,
            tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY template)) AS share
        FROM tt JOIN idf USING (term)),
    vectors AS (
        SELECT path, unit, line, term, idf, tf * coalesce(idf, rare) AS weight FROM (
            SELECT path, unit, line, term, count(*) AS tf FROM (
                SELECT path, unit, line, unnest(terms) AS term FROM units) GROUP BY ALL)
        LEFT JOIN idf USING (term), total),
    sizes AS (SELECT path, unit, line, sum(pow(weight, 2)) AS square FROM vectors GROUP BY ALL),
    scored AS (
        SELECT path, licence, round(sum(weight * share) / sqrt(any_value(square)), 6) AS score
        FROM vectors JOIN tw USING (term) JOIN sizes USING (path, unit, line)
        GROUP BY path, unit, line, template, licence),
    own AS (
        SELECT path, licence, score, row_number() OVER (
            PARTITION BY path ORDER BY score DESC, licence) AS place
        FROM scored WHERE score >= 0.6),
    granted AS (
        SELECT regexp_replace(path, '/[^/]*$', '') AS folder, licence, score, path
        FROM own WHERE place = 1 AND path LIKE '%/LICENSE.%')
    SELECT regexp_extract(f.path, '([0-9]+)$', 1)::BIGINT AS doc_id, f.path,
        coalesce(o.licence, g.licence) AS licence, coalesce(o.score, g.score) AS score,
        CASE WHEN o.path IS NOT NULL THEN 'own' WHEN g.path IS NOT NULL THEN 'inherited'
            ELSE 'none' END AS how, coalesce(o.path, g.path) AS from_path
    FROM (SELECT DISTINCT path FROM files) f LEFT JOIN own o ON o.path = f.path AND o.place = 1
        LEFT JOIN granted g ON g.folder = regexp_replace(f.path, '/[^/]*$', '')
    """,
)
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, laid out as files in folders by source, language and number."""
    number = F.floor(F.col("doc_id") / 64).cast("string")
    name = F.concat(F.when(F.col("doc_id") % 64 == 0, "LICENSE.").otherwise(""), F.col("doc_id"))
    files = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", number, name).alias("path"), "text"
    )
    found = licenses.scan(files, threshold=0.6)
    doc_id = F.regexp_extract("path", r"([0-9]+)\z", 1).cast("long")
    return found.select(doc_id.alias("doc_id"), *found.columns)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_rest(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    labels = labels.select(F.col("doc_id").alias("key"), (F.col("toxic") == 1).alias("toxic"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).withColumnRenamed("key", "doc_id")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        toxicity.offending(F.col("sentences")).alias("offending"),
    )


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from those outside the held-out seventh."""
    held_out = crc32_rest(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, ~held_out)
    return scored.select(
        F.col("key").alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a file of ranks, and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole, parts = chunked_bpe.encode(table(spark, sf_dir, "documents"), ranks)
    return chunked_bpe.digests(whole, parts, ranks).withColumnRenamed("key", "doc_id")


def _periodic_copy(docs: DataFrame) -> DataFrame:
    """Every tenth document (by crc32 of its id, a null id as the empty text) made periodic from
    word ``a`` on, with period ``p``."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    chosen = (number % 10 == 0).alias("chosen")
    docs = docs.select("doc_id", "text", chosen, F.floor(number / 10).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("chosen"), split))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    altered = F.expr(
        "array_join(slice(concat(slice(words, 1, cast(a AS int)), flatten(array_repeat("
        "slice(words, cast(a AS int) + 1, cast(p AS int)), cast((n - a) div p AS int) + 1))),"
        " 1, n), ' ')"
    )
    text = F.when(F.col("chosen") & (F.col("n") > 0), altered).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents: how many, the one with the most periods, and digests."""
    found = periodic.find(_periodic_copy(table(spark, sf_dir, "documents")))
    # More periods win; of equal ones the first in order stays.
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda top, run: F.when(
            run["length"] * top["period"] > top["length"] * run["period"], run
        ).otherwise(top),
    )
    lines = F.transform(
        "runs",
        lambda run: F.format_string("%d,%d,%d\n", run["start"], run["length"], run["period"]),
    )
    found = found.withColumn("best", best)
    return found.select(
        F.col("key").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE found AS (
        SELECT doc_id, run, count(*) AS c FROM (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")},
                '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
        WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (
        SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits
        FROM found),
    hashed AS (
        SELECT run, c, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length(digits), 2),
                lambda i: CAST('0x' || substr(digits, i, 2) AS BIGINT))),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
                lambda d, bit: xor(d >> 1, 3988292384::BIGINT * (d & 1)))), 4294967295::BIGINT) AS h
        FROM bytes),
    words AS (
        SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
            SELECT c, CASE WHEN h % 31 = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    shorter AS (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b
            ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
        UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
    ranked AS (
        SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
            row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place
        FROM near),
    formed AS (
        SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
            CASE WHEN r.other_n >= 10 * w.n THEN r.other END AS form,
            CASE WHEN r.other_n >= 10 * w.n THEN r.other_n END AS form_n
        FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
    led AS (
        SELECT word, word AS root FROM formed WHERE form IS NULL
        UNION ALL SELECT f.word, l.root FROM led l JOIN formed f ON f.form = l.word)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN led USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter taken out by the crc32 of document and word,
    with their near words and the form they lead to."""
    runs = spelling.runs(table(spark, sf_dir, "documents"), "A-Za-z\u00c0-\u00ff", min_chars=7)
    named = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), "word")
    hashed = F.crc32(named.cast("binary"))
    short = spelling.without(F.col("word"), hashed % F.length("word"))
    words = runs.select(F.when(hashed % 31 == 0, short).otherwise(F.col("word")).alias("word"))
    counted = words.where(F.length("word") >= 7).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.group(counted.where("n >= 2"))
