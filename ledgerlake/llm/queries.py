"""The corpus operators' queries, as ``__spark_entry__`` lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, language, line_dedup, merkle, ngram_join, packing, pii, quality, secret_scan, spelling, suffix_dedup, token_store
from .common import table
from .tokens import vocabulary


def op1_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    machine = quality.train(docs, labels, ~quality.held_out(), metadata=("n_chars",))
    got = quality.score(docs, machine, threshold=0.7)
    return got.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    references = language.learn(docs, ~quality.held_out())
    got = language.identify(docs.select("doc_id", "text"), references)
    return got.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score")


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_multi_index_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_template_tree_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_column_wise_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"), length=200)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    return got.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.item_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op8_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_kind("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return got.select("doc_id", *counts, pii.digest(F.col("base")).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op9_bit_plane_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.new_store(spark)
    token_store.write_token_ids(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=2)
    return token_store.read_token_ids(spark, path, with_ids=False)


def op10_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op11_zstandard_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secret_scan.find_secrets(docs, secret_scan.learn_dictionary(docs))
    counts = [F.size(secret_scan.of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(secret_scan.span_text(secret_scan.of_kind("spans", "assign", "access", "hex")), 256)
    return got.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.span_text("spans").alias("spans"))


def op12_anagram_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least=7, occurrences=2, times=10)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    # One more than n_chars, as a decimal: the largest number has a next one too.
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1)
    forged = F.when(more.isNotNull(), merkle.leaf("doc_id", "source", "lang", more, "text"))
    got = merkle.manifest(docs, merkle.new_store(spark), fields, tree="lang", order="doc_id", forged=forged)
    folded = merkle.folded(F.coalesce("forged", "leaf"), F.col("sides"), F.col("siblings"))
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return got.select("doc_id", "leaf", "subroot", "root", proof, folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_factorisation_quality,
        op2_cross_parsing_language,
        op3_parity_sketch_join,
        op4_multi_index_near_vectors,
        op5_template_tree_line_dedup,
        op6_column_wise_repeats,
        op7_benchmark_decontamination,
        op8_information_theoretic_pii,
        op9_bit_plane_token_ids,
        op10_best_two_fit_packing,
        op11_zstandard_secrets,
        op12_anagram_spelling_variants,
        op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found}


#: Shingles as text, pairs by shared shingles, and what links reach.
OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 2, 1) + 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 90 * (len(sa.sh) + len(sb.sh) - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS t FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.t)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(t) FROM r WHERE r.v = s.doc_id) AS component_id FROM s
"""

#: All pairs by cosine in double precision.
OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS v, vec_id AS t FROM v UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.t)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, (SELECT min(t) FROM r WHERE r.v = vec_id) AS component_id,
  vec_id = (SELECT min(t) FROM r WHERE r.v = vec_id) AS kept FROM v
"""

#: Words numbered, windows as joined text, hits as numbers of words.
OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i+9], ' ') AS t FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN win ON dw.t = win.t AND dw.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


#: CRC-32 of a list of byte values named ``bytes``, by a table ``t`` of the 256 byte values' own.
CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
CRC = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"

#: Near words by what is left of them without one letter, and its place.
OP12 = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (
  SELECT run, {CRC} AS h FROM (
    SELECT run, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS bytes FROM r), crc),
w AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM l a JOIN l b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM l JOIN w ON l.rest = w.word
  UNION SELECT w.word, w.n, l.word, l.n FROM l JOIN w ON l.rest = w.word),
s AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM p GROUP BY 1),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN near END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN s USING (word)),
c AS (SELECT word, word AS pos, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.pos AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""

#: Levels by recursion; each leaf's steps as a side and a sibling.
OP13 = rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
d AS (
  SELECT k.doc_id, coalesce('=' || lang, '') AS tree, n_chars, {CRC} % 7 = 0 AND n_chars IS NOT NULL AS told,
    coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, row_number() OVER () AS rid
  FROM (SELECT *, list_transform(string_split(id, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS bytes FROM k) k, crc),
e AS (
  SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN told THEN sha256(head || strlen(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) || tail) END AS forged FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM e),
v AS (
  SELECT tree, 0 AS lv, pos, n, leaf AS x FROM b
  UNION ALL SELECT tree, lv + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(x, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY tree, lv, pos // 2),
s AS (SELECT tree, x, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM v WHERE n = 1),
u AS (
  SELECT 0 AS lv, pos, n, x FROM s
  UNION ALL SELECT lv + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(x, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lv, pos // 2),
low AS (
  SELECT b.rid, g.lv AS step, CASE WHEN o.x IS NULL THEN 'N' WHEN (b.pos >> g.lv) % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(o.x, '') AS way
  FROM b JOIN (SELECT DISTINCT tree, lv FROM v WHERE n > 1) g USING (tree) LEFT JOIN v o ON o.tree = b.tree AND o.lv = g.lv AND o.pos = xor(b.pos >> g.lv, 1)),
top AS (
  SELECT s.tree, 1000 + g.lv AS step, CASE WHEN o.x IS NULL THEN 'N' WHEN (s.pos >> g.lv) % 2 = 0 THEN 'R' ELSE 'L' END || coalesce(o.x, '') AS way
  FROM s JOIN (SELECT DISTINCT lv FROM u WHERE n > 1) g ON true LEFT JOIN u o ON o.lv = g.lv AND o.pos = xor(s.pos >> g.lv, 1)),
ways AS (SELECT rid, list(way ORDER BY step) AS ws FROM (SELECT * FROM low UNION ALL SELECT b.rid, step, way FROM b JOIN top USING (tree)) GROUP BY 1),
done AS (
  SELECT b.doc_id, b.leaf, s.x AS subroot, (SELECT x FROM u WHERE n = 1) AS root, coalesce(ws, []) AS ws, coalesce(forged, leaf) AS mine FROM b JOIN s USING (tree) LEFT JOIN ways USING (rid)),
folds AS (
  SELECT *, list_reduce(list_prepend(mine, ws), lambda acc, w: CASE w[1] WHEN 'L' THEN sha256(w[2:] || acc) WHEN 'R' THEN sha256(acc || w[2:]) ELSE sha256(acc) END) AS folded_root FROM done)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(ws, lambda w: w[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_parity_sketch_join": OP3,
        "op4_multi_index_near_vectors": OP4,
        "op7_benchmark_decontamination": OP7,
        "op12_anagram_spelling_variants": OP12,
        "op13_merkle_manifest": OP13,
    }
