"""Queries of the text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, line_dedup, packing, periodic_runs, pii, pivot_search, simhash, spelling, token_counts, toxicity, url_filter

CONTROL = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn int, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_chats(turns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.link_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.judge_lines(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), "removed", "n_links", "classes")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, cut = pii.fit(docs)
    return pii.digest(pii.find_pii(docs, model, cut))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), change=periodic_runs.planted).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_url_filter": op3_url_filter,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": r"""
        WITH RECURSIVE p AS (
            SELECT page_id, url, html FROM pages
        ), edges AS (
            SELECT DISTINCT url AS a, regexp_extract(html, '<link [^>]*rel="canonical"[^>]*href="([^"]+)', 1, 'i') AS b FROM p WHERE contains(html, 'canonical')
        ), both_ways AS (
            SELECT a, b FROM edges WHERE b <> '' UNION SELECT b, a FROM edges WHERE b <> ''
        ), reach(url, other) AS (
            SELECT a, a FROM both_ways UNION SELECT r.url, e.b FROM reach r JOIN both_ways e ON e.a = r.other
        ), urls AS (
            SELECT url FROM p UNION SELECT other FROM reach
        ), cut AS (
            SELECT url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM urls
        ), rules(rule, name, start, verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), own AS (
            SELECT url, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
            FROM cut LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL
        ), marks AS (
            SELECT r.url, bool_or(o.verdict = 'allow') AS allowed, bool_or(o.verdict = 'block') AS blocked FROM reach r JOIN own o ON o.url = r.other GROUP BY 1
        )
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN own ON own.url IS NOT DISTINCT FROM p.url LEFT JOIN marks ON marks.url = p.url
    """,
    "op2_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), f AS (
            SELECT *, length(role) + 24 + length(CASE WHEN regexp_matches(text, '<\\+\||<\|im_start\|>|<\|im_end\|>') THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END) AS size FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(size)::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id
    """,
    "op4_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op11_spelling_variants": """
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents
        ), low AS (
            SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
            FROM runs WHERE length(r) >= 7 GROUP BY ALL
        ), coded AS (
            SELECT *, list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: unicode(x)) AS points FROM low
        ), steps AS (
            -- each byte of the UTF-8, then eight shifts (-1)
            SELECT * EXCLUDE points, flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x, -1, -1, -1, -1, -1, -1, -1, -1]
                ELSE [192 | (x >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 | (x & 63), -1, -1, -1, -1, -1, -1, -1, -1] END)) AS todo FROM coded
        ), hashed AS (
            SELECT * EXCLUDE todo, xor(list_reduce(list_prepend(4294967295::BIGINT, todo::BIGINT[]),
                lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295::BIGINT) AS h FROM steps
        ), words AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed
        ), v AS (
            SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), lacking AS (
            SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)
        ), pairs AS (
            SELECT a.word, b.word AS near FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT l.word, v.word FROM lacking l JOIN v ON v.word = l.rest
            UNION SELECT v.word, l.word FROM lacking l JOIN v ON v.word = l.rest
        ), ranked AS (
            SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
                row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS r
            FROM pairs p JOIN v ON v.word = p.near
        ), judged AS (
            SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * v.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * v.n THEN r.near_n END AS form_n
            FROM v LEFT JOIN ranked r ON r.word = v.word AND r.r = 1
        ), walk(word, place, depth) AS (
            SELECT word, word, 0 FROM judged UNION ALL SELECT w.word, j.form, depth + 1 FROM walk w JOIN judged j ON j.word = w.place WHERE j.form IS NOT NULL
        ), roots AS (SELECT word, arg_max(place, depth) AS root FROM walk GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
    """,
    "op12_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
}
