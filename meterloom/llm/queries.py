"""The queries of this folder: each applies one operator to a whole table of the driver."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, centroids, decontaminate, fingerprint, langid, lm, maintext, neardup, phrases, pieces, quality, substring, warc
from .rows import held_out, learned, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of ids with remainder 1 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(learned(F.col("doc_id"), 3, 1))
    model = quality.train(quality.labelled(docs, labels, "quality"))
    out = quality.score_rows(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and of its edited text, with the likeness to that and to the next document."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = maintext.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows which start in a document with a smaller id."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT g, min(doc_id) AS lo FROM x GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN m USING (g) WHERE doc_id > lo),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
l AS (SELECT doc_id, count(r.k) AS n_removed, string_agg(word, ' ' ORDER BY w.k) FILTER (WHERE r.k IS NULL) AS kept FROM w LEFT JOIN r USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id)
"""


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; ids with remainder 2 are never learned from."""
    out = lm.score_texts(table(spark, sf_dir, "documents"), learned(F.col("doc_id"), 7, 2))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document: the smallest id of all that near-copies connect it with."""
    return neardup.groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back and put together again."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path, payloads=False)).select(F.col("metadata.page_id").cast("long").alias("page_id"), "capture.type", "capture.digest", "capture.payload_bytes", F.coalesce("capture.payload_sha1", "capture.digest").alias("sha1"))
    held = captures.filter("type = 'response'").groupBy("digest").agg(F.max(F.struct("page_id", "payload_bytes")).alias("held"))
    again = F.col("type") == "revisit"
    return captures.join(held, "digest").select("page_id", F.when(again, F.col("held.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.when(again, F.col("held.page_id")).alias("refers_to"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM s),
p AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
h AS (SELECT doc_id, p.m, i, item_id FROM p JOIN s ON p.g = s.g AND p.m = s.m),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Token ids of every document and the bytes they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(ranks_file))
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, packed=True)
    out = bpe.decode(ids, ranks, keep=("doc_id", "ids"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; texts of ids with remainder 1 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(docs.filter(learned(F.col("doc_id"), 3, 1)))
    out = langid.identify(docs, profiles)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words stand together most beyond chance."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest(range(1, 6)) AS m),
f AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, sizes WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN (
      SELECT lang, a, array_to_string(list_slice(g, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, a, g, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT lang, a, m, string_split(phrase, ' ') AS g, unnest(range(2, m)) AS k FROM f WHERE m > 2))) b
      ON b.lang = f.lang AND b.phrase = f.phrase AND 100 * b.a >= 100 * f.a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(g, 1, k), ' ') AS x, array_to_string(list_slice(g, k + 1, m), ' ') AS y
         FROM (SELECT lang, phrase, a, m, string_split(phrase, ' ') AS g, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
scored AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, k, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y JOIN total t ON t.lang = c.lang
           ANTI JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Token ids of every document, with the end id, and the text they decode to."""
    vocabulary = pieces.read_vocabulary(public_tokenizers.path(model))
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary, keep=("doc_id", "ids"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every whole vector after five rounds from 40 starts."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = 5) -> str:
    away = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {away}, 'c': c}}) AS b FROM k, c{i} GROUP BY r)")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(fresh, m) AS m FROM c{i} LEFT JOIN (
  SELECT c, list(x ORDER BY j) AS fresh FROM (
    SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
      SELECT b.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN k USING (r), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL)) GROUP BY c) USING (c))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT c, m FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM k) WHERE c < 40),
{", ".join(steps[:-1])},
t AS (SELECT b.c AS c, sum(b.d) AS s FROM a{rounds} GROUP BY ALL)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(t.s AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(s) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN k USING (r) JOIN t ON t.c = a.b.c JOIN c{rounds} USING (c)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality, op2_fingerprint, op3_main_text, op4_substring, op5_language_model, op6_near_duplicates, op7_warc, op8_decontaminate, op9_byte_bpe, op10_language, op11_collocations, op12_sentencepiece, op13_centroids)}
ORACLE: dict[str, str] = {"op4_substring": OP4_SQL, "op8_decontaminate": OP8_SQL, "op11_collocations": OP11_SQL, "op13_centroids": _op13_sql()}
