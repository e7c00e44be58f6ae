"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, conversations, decontaminate, exact, fst_tokens, line_dedup, ppm, quality, secrets, simhash, spelling, urls, warc
from lodestone.llm.common import table


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fst_tokens.with_token_counts(docs, vocabulary("byte_bpe_50k.json"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.RULES + urls.PATTERNS).select("page_id", "host", "path", "rule", "verdict")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"))


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the cleaned text, and the numbers of the deleted lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs)
    return found.select("doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"))


#: Pages to a WARC file.
PAGES_A_FILE = 256


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in which a second replica of the pages differs: one in 97 has a changed byte, one in 211 is lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = pages.where(F.coalesce(F.col("page_id") % 211 != 5, F.lit(True))).withColumn(
        "html", F.when((F.col("page_id") % 97 == 13) & (F.octet_length("html") > 0), F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    )
    file = F.floor(F.col("page_id") / PAGES_A_FILE).cast("long")
    found = warc.audit(warc.leaves(pages, file), warc.leaves(damaged, file))
    return found.select("id", "file", "start", "end", "problem").withColumnRenamed("id", "page_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversations.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select(*[c for c in nodes.columns if c != "ends"], F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_simhash_near_duplicates, op3_url_filter, op4_bpe_round_trip, op5_ppm_scores, op6_quality_rules, op7_benchmark_decontamination, op8_line_dedup, op9_warc_fixity, op10_secret_scan, op11_conversation_trie, op12_spelling_variants, op13_exact_duplicates)}

_HEAD = len("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:" + "0" * 64 + ">\r\nWARC-Target-URI: \r\nContent-Type: text/html\r\nContent-Length: " + "\r\n\r\n" * 2)

#: The white space between words.
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda w: w <> '')"
_LINES = r"list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
_HOST = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END"

#: The filter's own verdict: one alternation for each kind of rule.
_HOST_FORMS = "|".join(["|".join(urls.HOST_WORDS), *(f"({'|'.join(a)})-([^.@:/]*-)?({'|'.join(b)})" for a, b in urls.HOST_PAIRS)])
_PATH_FORMS = f"/({'|'.join(urls.PATH_PIECES)})([./]|$)|[.]({'|'.join(urls.FILE_ENDS)})$"
_OWN_VERDICT = f"(regexp_matches(host, '(^|[.@-])({_HOST_FORMS})([.@:-]|$)') OR regexp_matches(path, '{_PATH_FORMS}', 'is'))"

#: CRC-32 of a text by the rule of its table: crcs(t) has the table, _crc the expression over it.
_CRCS = "crcs(tbl) AS (SELECT list(x ORDER BY i) FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS x FROM range(256) r(i)))"


def _crc(text: str) -> str:
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(0, CAST(length({digits}) / 2 AS BIGINT)), lambda i: CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": f"""
        WITH hosts AS (SELECT page_id, url, {_HOST} AS raw FROM pages),
        parts AS (
          SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3 + length(raw)), '^[^?#]*') ELSE '' END AS path
          FROM hosts
        ),
        rules(h, p, v) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for v, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")))}),
        fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {_OWN_VERDICT} THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN fits USING (page_id)
    """,
    # Every pair of equal lines, not fingerprints: runs of 50 or more words that any earlier place has.
    "op8_line_dedup": f"""
        WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        worded AS (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(13)) AS l, least(50, len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda w: w <> ''))) AS n FROM split),
        rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM worded WHERE n > 0),
        pairs AS (SELECT a.doc_id, a.k, a.pos, a.n, b.doc_id AS other, a.k - b.k AS shift FROM rows a JOIN rows b ON a.l = b.l AND (b.doc_id, b.k) < (a.doc_id, a.k)),
        islands AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY k) AS island FROM pairs),
        runs AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, other, shift, island) AS size FROM islands),
        gone AS (SELECT DISTINCT doc_id, pos FROM runs WHERE size >= 50),
        cut AS (SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed_lines, count(*) AS n_removed FROM gone GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM split ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
        FROM documents d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op6_quality_rules": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        counts AS (
          SELECT doc_id, t, {_WORDS} AS w, len({_LINES}) AS n_lines, len({_LINES}) - len(list_distinct({_LINES})) AS n_dup_lines,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
                 length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) * 2 > length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS capitals
          FROM docs
        ),
        windows AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS ws FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM counts WHERE len(w) >= 8)),
        often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, ws) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM often) GROUP BY doc_id),
        base AS (SELECT c.*, len(w) AS n_words, coalesce(v.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(v.n, 0) > 30 * len(w) AS base_failed FROM counts c LEFT JOIN covered v USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols * 10 > n_words * 3 OR n_dup_lines * 10 > n_lines * 3 OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR capitals) AS kept
        FROM base
    """,
    # Every prefix of every conversation as a list, and every node with all nodes above it.
    "op11_conversation_trie": f"""
        WITH {_CRCS},
        placed AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % 100 AS base, {_crc("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM placed), crcs),
        whole AS (SELECT v.c, v.base, 0 AS side, pos, t FROM convs v JOIN placed p ON p.c = v.base WHERE pos < h UNION ALL SELECT v.c, v.base, 1, pos, t FROM convs v JOIN placed p ON p.c = v.c WHERE pos >= h),
        seqs AS (SELECT v.c, coalesce(list(w.t ORDER BY side, pos) FILTER (w.c IS NOT NULL), []) AS s FROM convs v LEFT JOIN whole AS w(c, base, side, pos, t) USING (c) GROUP BY v.c),
        members AS (SELECT c, list_slice(s, 1, d) AS p, d, d = len(s) AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
        nodes AS MATERIALIZED (SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY p),
        kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
        sized AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].text) END AS saved FROM nodes n LEFT JOIN kids k USING (p)),
        above AS (SELECT list_slice(p, 1, d) AS p, saved, n_children FROM (SELECT p, saved, n_children, unnest(range(0, depth + 1)) AS d FROM sized)),
        sums AS (SELECT p, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY p)
        SELECT CAST(s.depth AS BIGINT) AS depth, s.conv_id, CASE WHEN s.depth > 0 THEN up.conv_id END AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
        FROM sized s JOIN sums USING (p) LEFT JOIN nodes up ON up.p = list_slice(s.p, 1, s.depth - 1) AND s.depth > 0
    """,
    # All pairs by the words that one deletion leaves.
    "op12_spelling_variants": f"""
        WITH RECURSIVE {_CRCS},
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        hashed AS (SELECT run, n, {_crc("d || ':' || run")} AS h FROM (SELECT d, run, count(*) AS n FROM runs GROUP BY ALL), crcs),
        cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT word, rest FROM less SEMI JOIN words w ON w.word = less.rest UNION SELECT rest, word FROM less SEMI JOIN words w ON w.word = less.rest),
        best AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY w.n DESC, encode(near)) AS form, max(w.n) AS form_n FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
        forms AS MATERIALIZED (SELECT word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON way.at = forms.word WHERE forms.form IS NOT NULL)
        SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word JOIN forms final ON final.word = way.at WHERE final.form IS NULL
    """,
    "op13_exact_duplicates": f"""
        WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
        FROM norm WINDOW same AS (PARTITION BY t)
    """,
    "op9_warc_fixity": f"""
        WITH sized AS (
          SELECT page_id, page_id // {PAGES_A_FILE} AS file, {_HEAD} + strlen(coalesce(url, '')) + strlen(coalesce(html, '')) + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) AS size,
                 CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 97 = 13 AND strlen(html) > 0 THEN 'changed' END AS problem
          FROM pages
        ), placed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY file ORDER BY page_id) AS BIGINT) AS "end" FROM sized)
        SELECT page_id, file, "end" - size AS start, "end", problem FROM placed WHERE problem IS NOT NULL
    """,
}
