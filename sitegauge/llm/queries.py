"""Registered queries over the driver's tables, next to the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import (
    alignment,
    bpe,
    exact,
    hosts,
    merkle,
    mixing,
    ordinal,
    packing,
    pagediff,
    prefixes,
    secrets,
    simhash,
    suffixes,
)
from sitegauge.llm.common import materialised, table

LEAST_TAIL = 0.5
TOKEN_LIMIT = 2048
ROW_TOKENS = 2048
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op1_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.candidates(table(spark, sf_dir, "documents"), path_col="source")
    return secrets.scored(found, secrets.train(spark)).select(
        "doc_id", "start", "end", "kind", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret"
    )


def op3_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    counted = prefixes.all_prefixes(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    whole = F.element_at("prefix_tokens", -1).cast("long")
    return counted.select(
        "doc_id", "n_bytes", whole.alias("n_tokens"), (whole > TOKEN_LIMIT).alias("over_limit"),
        prefixes.units_within(TOKEN_LIMIT).alias("units_within"), prefixes.longest_within(TOKEN_LIMIT).alias("characters_within"),
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings: 0 for bad text, 1 for good text that is toxic, 2 for good text."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def graded(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    return ordinal.score(docs, ordinal.fit(docs, ratings))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graded(table(spark, sf_dir, "documents"), grades(spark, sf_dir))
    return scored.select(
        "doc_id",
        F.round("expected_grade", 6).alias("expected_grade"),
        F.round("tail_probability", 6).alias("tail_probability"),
        ordinal.accepted(scored, LEAST_TAIL).alias("accepted"),
    )


def op5_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op7_page_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_template")


def op8_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    ids = packing.encoded(table(spark, sf_dir, "documents"), ranks, vocabulary, public_tokenizers.PATTERN)
    rows = packing.packed(ids, ROW_TOKENS, pad=50256)
    return rows.select(
        "block", "row", "doc_ids", "piece_starts", "cu_seqlens", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


EXACT_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = suffixes.benchmark_matches(docs.select("doc_id", "text"), bench)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


MATCH_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
found AS (SELECT doc_id, i, g.n AS n, item_id FROM grams g JOIN win USING (n, t)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found) f, unnest(range(f.i, f.i + f.n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op11_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = {"text": F.translate("text", hosts.UPPER, hosts.LOWER)}
    touched = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select(
        "doc_id",
        "lang",
        merkle.leaf(*[F.col(c) for c in values]).alias("leaf"),
        F.when(touched, merkle.leaf(*[lowered.get(c, F.col(c)) for c in values])).alias("tampered"),
    )
    sealed = merkle.manifest(materialised(rows, "merkle-leaves"), "lang", "doc_id")
    seen = merkle.with_folded_root(sealed.withColumn("seen", F.coalesce("tampered", "leaf")), "seen")
    as_text = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    proof = F.sha2(F.lower(F.hex("witness")), 256).alias("proof_sha256")
    return seen.select("doc_id", *as_text, proof, (F.col("folded_root") == F.col("root")).alias("verified"))


def merkle_sql(levels: int = 8, top_levels: int = 4) -> str:
    """The trees level by level, for up to 8 ** levels rows in a group and 8 ** top_levels groups."""

    def framed(text: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def climb(name: str, rows: str, many: int) -> list[str]:
        """``rows`` (k, g, i, n, d, seen): the digests, then for each row what its proof and folded root are so far."""
        steps = [f"{name}n0 AS (SELECT g, i, n, d FROM {rows})", f"{name}p0 AS (SELECT k, g, i, n, seen, '' AS proof FROM {rows})"]
        for at in range(many):
            steps.append(f"{name}r{at} AS MATERIALIZED (SELECT g, i // 8 AS r, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {name}n{at} WHERE n > 1 GROUP BY ALL)")
            steps.append(
                f"{name}n{at + 1} AS MATERIALIZED (SELECT g, r AS i, (n + 7) // 8 AS n, sha256(array_to_string(ds, '')) AS d FROM {name}r{at} "
                f"UNION ALL SELECT g, i, n, d FROM {name}n{at} WHERE n = 1)"
            )
            steps.append(
                f"{name}p{at + 1} AS MATERIALIZED (SELECT k, p.g, r AS i, (p.n + 7) // 8 AS n, "
                "sha256(array_to_string(ds[1:i % 8], '') || seen || array_to_string(ds[i % 8 + 2:], '')) AS seen, "
                f"proof || array_to_string(ds[1:i % 8], '') || array_to_string(ds[i % 8 + 2:], '') AS proof FROM {name}p{at} p "
                f"JOIN {name}r{at} q ON p.g IS NOT DISTINCT FROM q.g AND p.i // 8 = q.r UNION ALL SELECT k, g, i, n, seen, proof FROM {name}p{at} WHERE n = 1)"
            )
        return steps

    lowered = f"translate(text, '{hosts.UPPER}', '{hosts.LOWER}')"
    byte = "list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = "[CAST(ascii(d) AS BIGINT) for d in string_split(CAST(doc_id AS VARCHAR), '')]"
    crc = f"xor(list_reduce({codes}, lambda c, d: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH l AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang AS g, {framed("text")} AS d, {framed(lowered)} AS other, {crc} AS crc FROM documents),
rows AS MATERIALIZED (SELECT k, doc_id, g, d, CASE WHEN crc % 3 = 0 THEN other ELSE d END AS seen,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
{", ".join(climb("a", "rows", levels))},
subs AS (SELECT g, d FROM an{levels}),
groups AS MATERIALIZED (SELECT p.k, 0 AS g, s.i, s.n, s.d, p.seen, p.proof AS lower FROM ap{levels} p
  JOIN (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subs) s ON p.g IS NOT DISTINCT FROM s.g),
tops AS (SELECT DISTINCT g, i, n, d FROM groups),
{", ".join(climb("b", "groups", top_levels)).replace("bn0 AS (SELECT g, i, n, d FROM groups)", "bn0 AS (SELECT g, i, n, d FROM tops)")}
SELECT rows.doc_id, rows.d AS leaf, subs.d AS subroot, bn{top_levels}.d AS root, sha256(groups.lower || bp{top_levels}.proof) AS proof_sha256,
       bp{top_levels}.seen AS folded_root, bp{top_levels}.seen = bn{top_levels}.d AS verified
FROM rows JOIN groups USING (k) JOIN bp{top_levels} USING (k) JOIN subs ON rows.g IS NOT DISTINCT FROM subs.g, bn{top_levels}
"""


def op12_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    shown = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = materialised(rows.select(*[c for c in rows.columns if c not in ("text", "groups")], shown), "aligned")
    held = materialised(alignment.chunk_pairs(rows), "aligned-pairs")
    counts = alignment.pair_counts(held, alignment.pieces(b))
    weighed = alignment.weighed(rows, held, counts)
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SOURCE_WEIGHTS = [5, 2, 1]


def op13_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.assigned(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)
    return mix.select("doc_id", "size", "source_size", "target", "taken", "shards")


# Name to query and SQL, which is None where SQL can't express the operator.
QUERIES = {
    "op1_simhash_vp_trees": (op1_simhash_vp_trees, None),
    "op2_forest_secrets": (op2_forest_secrets, None),
    "op3_prefix_counts": (op3_prefix_counts, None),
    "op4_ordinal_quality": (op4_ordinal_quality, None),
    "op5_segment_tree_bpe": (op5_segment_tree_bpe, None),
    "op6_host_trust": (op6_host_trust, hosts.judged_sql(URL_RULES)),
    "op7_page_differences": (op7_page_differences, None),
    "op8_packed_rows": (op8_packed_rows, None),
    "op9_exact_dedup": (op9_exact_dedup, EXACT_SQL),
    "op10_suffix_arrays": (op10_suffix_arrays, MATCH_SQL),
    "op11_merkle_witnesses": (op11_merkle_witnesses, merkle_sql()),
    "op12_pointer_jumping": (op12_pointer_jumping, None),
    "op13_splitting_tree_mix": (op13_splitting_tree_mix, None),
}
