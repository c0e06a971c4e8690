"""The queries of this subpackage: thin readings of its operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import alignment, bytebpe, codes, lines, mixing, packing, permutation, sharding, simhash, tokenfiles, topk, toxicity, warc
from marrow.llm.shared import crc_of_id, table, work_dir


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write_archive(pages, work_dir(spark, "warc"))
    return warc.read_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def fitted_toxicity(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The toxicity model, learned only from rows whose crc32(doc_id as text) mod 5 is not 0."""
    return toxicity.fit(docs, labels, crc_of_id() % 5 != 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=50, k=5)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    decoded = bytebpe.decode(bytebpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_tokenizer() -> str:
    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.dedup_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    tokenfiles.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer(), path)
    return tokenfiles.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=20, k=20)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, model = (Path(public_tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), spec.decode(), model)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_topk": op3_topk,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_permutation": op10_permutation,
    "op11_codes": op11_codes,
    "op12_mixing": op12_mixing,
    "op13_alignment": op13_alignment,
}



def codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Plain Lloyd rounds, unrolled: every part meets every entry."""
    steps = []
    for i in range(rounds + 1):
        # Distance and index in one number, so that ties go to the lower index.
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT rid, part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, z) + list_inner_product(z, z)) * 256 + entry)::BIGINT AS k
            FROM parts JOIN c{i} USING (part) GROUP BY rid, part
        )""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(m, z) AS z FROM c{i} LEFT JOIN (
                SELECT part, entry, list(v ORDER BY place) AS m FROM (
                    SELECT part, k % 256 AS entry, place, floor(sum(x[place]) / count(*)) AS v FROM a{i}, (SELECT unnest(range(1, len(x) + 1)) AS place FROM parts LIMIT 16) GROUP BY ALL
                ) GROUP BY ALL
            ) USING (part, entry)
        )""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, w, row_number() OVER (ORDER BY vec_id, w) AS rid FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        ), parts AS MATERIALIZED (SELECT rid, part, w[part * len(w) // 4 + 1 : (part + 1) * len(w) // 4] AS x FROM v, range(4) t(part)
        ), c0 AS (SELECT part, rid - 1 AS entry, x AS z FROM parts WHERE rid <= 256
        ), {", ".join(steps)}, coded AS (
            SELECT rid, string_agg(printf('%02x', k % 256), '' ORDER BY part) AS code, sum(k // 256)::BIGINT AS error FROM a{rounds} GROUP BY rid
        ), books AS (SELECT sha256(string_agg(z_text, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(z::BIGINT[], ',') AS z_text FROM c{rounds}))
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (rid), books
    """


ORACLES = {
    "op11_codes": codes_sql(),
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM q GROUP BY payload_digest)
        SELECT page_id, payload_bytes, q.payload_digest AS payload_digest,
               CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM q JOIN f ON q.payload_digest = f.payload_digest
    """,
    "op3_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5
    """,
    "op8_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
        ), keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
        ), repeated AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ), marked AS (
            SELECT doc_id, pos, line, (keeper IS NOT NULL AND keeper <> doc_id) AS gone
            FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
