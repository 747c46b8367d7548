"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, filter_audit, html_text, langid, licenses, minhash, periodic, pii, sentencepiece_viterbi, token_files, toxicity
from .common import LOWER, UPPER, WORD, table


def tokenizer_path(name: str) -> str:
    """Where this machine has a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest_match=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of every tenth document (by a checksum of its id) repeat with a period from some place on."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(table(spark, sf_dir, "documents"), texts=False, change=planted))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_html_extraction,
        op3_nearest_neighbours,
        op4_decontamination,
        op5_sentencepiece,
        op6_license_scan,
        op7_personal_data,
        op8_near_duplicates,
        op9_token_files,
        op10_language_id,
        op11_bpe,
        op12_periodic_runs,
        op13_filter_audit,
    )
}
#: Words of a text in DuckDB, as a list.
SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE_SQL: dict[str, str] = {
    "op13_filter_audit": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
            FROM documents),
        f AS (
            SELECT doc_id, part,
                   CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS fails
            FROM t),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
        k AS (
            SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
            FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (
            SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
        p AS (SELECT *, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM s),
        r AS (
            SELECT *, contains(fails, letter) AS here, translate(before, fails, '') <> before AS gone FROM k, p),
        g AS (
            SELECT part, filter_order, step, letter,
                   sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN here AND NOT gone AND good = 1 THEN n ELSE 0 END) AS good_lost,
                   sum(CASE WHEN here AND NOT gone AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
            FROM r GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM g""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {SQL_WORDS} AS w FROM benchmark),
        bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        bk AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM bn),
        bp AS (SELECT item_id, n, k AS j, array_to_string(w[k:k + n - 1], ' ') AS win FROM bk),
        bw AS (SELECT DISTINCT item_id, n, win FROM bp),
        sizes AS (SELECT DISTINCT n FROM bn),
        dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
        hits AS (
            SELECT doc_id, k, dk.n, item_id FROM dk
            JOIN bw ON bw.n = dk.n AND bw.win = array_to_string(w[k:k + dk.n - 1], ' ')),
        steps AS (
            SELECT doc_id, dk.n, item_id, k, j, k - row_number() OVER (PARTITION BY doc_id, dk.n, item_id, j - k ORDER BY k) AS run FROM dk
            JOIN bp ON bp.n = dk.n AND bp.win = array_to_string(w[k:k + dk.n - 1], ' ')),
        runs AS (SELECT doc_id, item_id, min(k) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + n - 1 AS words FROM steps GROUP BY doc_id, n, item_id, j - k, run),
        tops AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, doc_word, item_id, item_word) AS place FROM runs),
        spans AS (SELECT DISTINCT doc_id, k, n FROM hits),
        places AS (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM spans),
        n_hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM places GROUP BY 1),
        named AS (SELECT DISTINCT doc_id, item_id FROM hits),
        n_named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM named GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
               CAST(coalesce(words, 0) AS BIGINT) AS longest_words, doc_word AS longest_at, tops.item_id AS longest_item, item_word AS longest_item_word
        FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN n_named USING (doc_id) LEFT JOIN tops ON tops.doc_id = d.doc_id AND place = 1""",
    "op3_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_reduce(list_transform(range(1, len(q.embedding) + 1),
                       lambda i: q.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE), lambda x, y: x + y) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.embedding) = len(c.embedding)
            WHERE q.vec_id % 20 = 0),
        r AS (
            SELECT query_id, vec_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n
            FROM p)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op6_license_scan": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
        w AS (SELECT doc_id, low, regexp_extract_all(low, '{WORD}') AS w FROM d),
        p AS (
            SELECT doc_id, low, len(w) AS n_words,
                   list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
                   list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
                   list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl
            FROM w),
        b AS (
            SELECT doc_id, n_words, list_concat(mit, list_concat(apache, gpl)) AS places,
                   list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS named
            FROM p),
        t AS (SELECT label, list_distinct(string_split(txt, ' ')) AS words FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in licenses.TEMPLATES)}) AS v(label, txt)),
        tm AS (SELECT label, words, len(words) AS n, CAST(ceil(len(words) * {licenses.THRESHOLD} - 1e-9) AS BIGINT) AS m FROM t),
        l0 AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, unnest(range(0, len(string_split(low, chr(10))))) AS i FROM d),
        l1 AS (SELECT doc_id, i, regexp_extract_all(line, '{WORD}') AS words FROM l0),
        l2 AS (SELECT doc_id, words, sum(len(words)) OVER (PARTITION BY doc_id ORDER BY i) AS e, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS further FROM l1 WHERE len(words) > 0),
        pa AS (SELECT doc_id, unnest(string_split_regex(low, '{licenses.BREAK}')) AS part FROM d),
        blocks AS (
            SELECT doc_id, len(words) > 2 * {licenses.REACH} AS paragraph, list_distinct(words) AS words FROM l2
            UNION ALL SELECT doc_id, FALSE, list_distinct(words[k * {licenses.REACH} + 1:k * {licenses.REACH} + 2 * {licenses.REACH}])
            FROM (SELECT doc_id, words, unnest(range(0, CAST(ceil(len(words) / {licenses.REACH}) AS BIGINT) - 1)) AS k FROM l2 WHERE len(words) > 2 * {licenses.REACH})
            UNION ALL SELECT l2.doc_id, FALSE, list_distinct(w.w[CAST(greatest(e - {licenses.REACH}, 0) + 1 AS BIGINT):CAST(e + {licenses.REACH} AS BIGINT)]) FROM l2 JOIN w USING (doc_id) WHERE further IS NOT NULL
            UNION ALL SELECT doc_id, TRUE, list_distinct(regexp_extract_all(part, '{WORD}')) FROM pa),
        f AS (
            SELECT doc_id, label, max(len(list_intersect(lw.words, tm.words)) / n) AS share
            FROM blocks lw JOIN tm ON len(lw.words) >= m AND (NOT paragraph OR n >= {licenses.LONG}) AND len(list_intersect(lw.words, tm.words)) >= m GROUP BY 1, 2),
        g AS (SELECT doc_id, list(label) AS found, max(share) AS share FROM f GROUP BY 1)
        SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base,
               list_min(places) AS first_word, list_max(places) AS last_word,
               array_to_string(list_sort(named), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(named, coalesce(found, [])))), ',') AS labels,
               CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
        FROM b LEFT JOIN g USING (doc_id)""",
    "op8_near_duplicates": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        k AS (SELECT doc_id, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS sh FROM k),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id),
        m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
