"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_jobs.llm.bpe import encode_and_decode
from transcript_jobs.llm.embedding_duplicates import near_embeddings
from transcript_jobs.llm.fill_in_middle import fill_in_middle, restore
from transcript_jobs.llm.fingerprints import fingerprint_with_next
from transcript_jobs.llm.licenses import scan_licenses
from transcript_jobs.llm.line_quality import judge_quality
from transcript_jobs.llm.manifest import build_manifest, folded, hex_text, leaf_digest, proof_digest
from transcript_jobs.llm.near_duplicates import near_duplicates
from transcript_jobs.llm.perspectives import rotate_perspectives
from transcript_jobs.llm.source_mix import mix_sources
from transcript_jobs.llm.token_counts import count_tokens
from transcript_jobs.llm.token_files import read_token_files, write_token_files
from transcript_jobs.llm.toxicity import fit, fold, score_toxicity
from transcript_jobs.plans.scratch import Scratch

#: Target weights of the mix: five sources count twice, the others once; what has no known source counts once in all.
MIX = {f"src{i}": 2.0 if i < 5 else 1.0 for i in range(20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(encoded: DataFrame) -> DataFrame:
    """Counts and hashes of ids and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').root}/ids"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    ids = read_token_files(spark, path)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), MIX, other_weight=1.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op5_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string")))
    return rendered.withColumn("mask", F.array_join(spans, ","))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and a check of rows of which those with an even CRC-32 of the id have lost their line breaks."""
    struck = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & (F.instr("text", "\n") > 0)
    changed = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", "\n", ""))
    made = build_manifest(table(spark, sf_dir, "documents"), also={"tampered": F.when(struck, F.unhex(changed))})
    again = folded(F.coalesce(hex_text(F.col("tampered")), F.col("leaf")), F.col("proof"))
    checked = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("removed_lines")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_token_files,
        op3_source_mix,
        op4_toxicity,
        op5_weighted_fingerprints,
        op6_near_duplicates,
        op7_perspectives,
        op8_near_embeddings,
        op9_bpe_round_trip,
        op10_token_counts,
        op11_fill_in_middle,
        op12_merkle_manifest,
        op13_line_quality,
    )
}
ORACLES = {
    "op3_source_mix": """
        WITH weights AS (SELECT 'src' || i AS name, CASE WHEN i < 5 THEN 2.0::DOUBLE ELSE 1.0 END AS w FROM range(20) t(i) UNION ALL SELECT '', 1.0),
        docs AS (SELECT d.*, coalesce(k.name, '') AS known FROM documents d LEFT JOIN weights k ON d.source = k.name AND k.name <> ''),
        counts AS (SELECT known, count(*)::DOUBLE AS n FROM docs GROUP BY known),
        rates AS (SELECT known, sum(n) OVER () * w / sum(w) OVER () / n AS mean FROM counts JOIN weights ON known = name),
        steps AS (SELECT known, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY known ORDER BY k) AS step FROM rates, range(200) t(k)),
        drawn AS (SELECT *, ('0x' || substr(md5('0:1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM docs),
        counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM steps s WHERE s.known = d.known AND s.step <= d.u) AS n FROM drawn d)
        SELECT doc_id, text, lang, source, n_chars, c::INTEGER AS copy, md5('0:order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || c) AS mix_key
        FROM (SELECT *, unnest(range(1, n + 1)) AS c FROM counted)""",
    "op6_near_duplicates": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS sh FROM words),
        items AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
        low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.low, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(l.low, s.doc_id)) AS kept
        FROM sets s LEFT JOIN low l ON l.a = s.doc_id""",
    "op7_perspectives": """
        WITH lines AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
        people AS (SELECT DISTINCT conv_id, alone, speaker AS perspective FROM lines WHERE speaker <> 'system'),
        seen AS (SELECT l.*, perspective, speaker = perspective AS own,
                 CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user:' || replace(replace(speaker, '<|', '< |'), '|>', '| >') || '|>' END AS head
                 FROM lines l JOIN people p ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.alone IS NOT DISTINCT FROM p.alone),
        placed AS (SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, alone, perspective ORDER BY turn NULLS FIRST, speaker, text
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM seen)
        SELECT conv_id, perspective, count(*)::INTEGER AS n_turns,
               string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY begins) AS rendered,
               coalesce(string_agg(CASE WHEN own THEN begins::BIGINT || '-' || (begins + length(text) + 7)::BIGINT END, ',' ORDER BY begins), '') AS mask
        FROM placed GROUP BY conv_id, alone, perspective""",
    "op8_near_embeddings": """
        WITH RECURSIVE good AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
                                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON n.a = vec_id LEFT JOIN low l ON l.a = vec_id""",
    "op11_fill_in_middle": r"""
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                       list_transform(range(4), lambda k: ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8 * k + 1, 8))::BIGINT) AS h FROM documents),
        cuts AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS hi,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:n], ''), '') AS s FROM cuts)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM parts""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE rows_ AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, text,
                 concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
                 list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes FROM documents),
        hashed AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS stripped,
                 xor(list_reduce([4294967295::BIGINT] || bytes, lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) AS crc FROM rows_),
        leaves AS (SELECT doc_id, tree, leaf, CASE WHEN crc % 2 = 0 THEN stripped ELSE leaf END AS tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
        nodes(lvl, tree, pos, n, d) AS (SELECT 0, tree, pos, n, leaf FROM leaves
                 UNION ALL SELECT lvl + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, pos // 3, n),
        subs AS (SELECT tree, lvl AS height, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(lvl, pos, n, d) AS (SELECT 0, pos, n, subroot FROM subs UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
        every AS (SELECT lvl, tree, pos, n, d FROM nodes UNION ALL SELECT lvl, NULL, pos, n, d FROM tops),
        steps AS (SELECT lvl, tree, pos, coalesce(string_agg(d, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before_,
                 coalesce(string_agg(d, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after_ FROM every WHERE n > 1 WINDOW w AS (PARTITION BY lvl, tree, pos // 3 ORDER BY pos)),
        climb(id, tree, lvl, pos, d, proof) AS (SELECT concat(tree, ':', pos), tree, 0, pos, tampered, '' FROM leaves
                 UNION ALL SELECT id, c.tree, c.lvl + 1, c.pos // 3, sha256(before_ || d || after_), proof || before_ || after_ FROM climb c JOIN steps s ON s.lvl = c.lvl AND s.tree = c.tree AND s.pos = c.pos),
        inner_ AS (SELECT c.id, c.d, c.proof, s.subroot, s.pos, n.doc_id, n.leaf FROM climb c JOIN subs s ON s.tree = c.tree AND c.lvl = s.height JOIN leaves n ON concat(n.tree, ':', n.pos) = c.id),
        up(id, lvl, pos, d, proof) AS (SELECT id, 0, pos, d, proof FROM inner_
                 UNION ALL SELECT id, u.lvl + 1, u.pos // 3, sha256(before_ || d || after_), proof || before_ || after_ FROM up u JOIN steps s ON s.lvl = u.lvl AND s.tree IS NULL AND s.pos = u.pos)
        SELECT i.doc_id, i.leaf, i.subroot, r.d AS root, sha256(u.proof) AS proof_sha256, u.d AS folded_root, u.d = r.d AS verified
        FROM inner_ i JOIN up u ON u.id = i.id JOIN tops r ON r.n = 1 AND r.lvl = u.lvl""",
    "op13_line_quality": r"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
        cut AS (SELECT id, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
        grams AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
        again AS (SELECT id, i FROM grams QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
        repeats AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY id),
        norms AS (SELECT id, host, text, list_filter(list_transform(ls, lambda x: trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM cut),
        parts AS (SELECT id, host, text, x, len(string_split(x, ' ')) AS n FROM (SELECT id, host, text, unnest(ls) AS x FROM norms)),
        hosts AS (SELECT host, greatest(20, least(1000, floor(count(DISTINCT text) * 0.005::DOUBLE))) AS most FROM docs GROUP BY host),
        often AS (SELECT host, x FROM parts JOIN hosts USING (host) GROUP BY host, x, most HAVING count(DISTINCT text) > most),
        gone AS (SELECT id, sum(n)::BIGINT AS removed_words FROM parts JOIN often USING (host, x) GROUP BY id),
        counted AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
                    FROM cut LEFT JOIN repeats USING (id) LEFT JOIN gone USING (id)),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, NOT base_failed AND n_words - removed_words >= 0.3::DOUBLE * n_words AS kept FROM failed""",
}
