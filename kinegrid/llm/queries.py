"""The registered queries op1 to op13, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, codes, jaccard, language, licences, lines, packing, pii, resample, simhash, superkmers, warc
from .common import load


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(load(spark, sf_dir, "documents"), words=4, percent=85)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.train(docs.where(F.coalesce(~held_out, F.lit(True))))
    return language.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_repeats(load(spark, sf_dir, "documents"), size=20)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


def op11_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_personal_data": op2_personal_data,
    "op3_language_id": op3_language_id,
    "op4_line_chunks": op4_line_chunks,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_multi_index_hashing": op6_multi_index_hashing,
    "op7_super_kmers": op7_super_kmers,
    "op8_licence_scan": op8_licence_scan,
    "op9_simhash": op9_simhash,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_legacy_archives": op11_legacy_archives,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}


def _crc32(blob: str) -> str:
    """SQL of the CRC-32 of a blob; `tab` has the table of the CRCs of bytes."""
    octets = f"list_transform(range(1, 2 * octet_length({blob}), 2), lambda i: ('0x' || substr(hex({blob}), i, 2))::UBIGINT)"
    return f"xor(4294967295::UBIGINT, list_reduce({octets}, lambda c, o: xor(c >> 8, t[((xor(c, o) & 255) + 1)::BIGINT]), 4294967295::UBIGINT))"


def _resampling() -> str:
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::UBIGINT) ELSE {0} >> 1 END"
    table = "SELECT i::UBIGINT AS v, i FROM range(256) r(i)"
    for _ in range(8):
        table = f"SELECT {step.format('v')} AS v, i FROM ({table})"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH tab AS (SELECT list(v ORDER BY i) AS t FROM ({table})),
      d AS (SELECT doc_id, {words} AS w FROM documents),
      f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
      b AS (SELECT {words} AS w FROM benchmark),
      a AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b),
      h AS (SELECT g, {_crc32("encode(g)")} % 10000 AS k FROM (SELECT g FROM f UNION SELECT g FROM a), tab),
      s AS (SELECT k, count(*) AS n FROM f JOIN h USING (g) GROUP BY k), t AS (SELECT k, count(*) AS n FROM a JOIN h USING (g) GROUP BY k),
      gain AS (SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
        FROM (SELECT range AS k FROM range(10000)) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
      w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN h USING (g) JOIN gain USING (k) GROUP BY doc_id),
      x AS (SELECT d.doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || sha256('7:' || d.doc_id)[1:8])::UBIGINT AS h FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
      y AS (SELECT doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
      r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM y WHERE words >= 20)
      SELECT y.doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM r) // 100 THEN place END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id"""


def _vector_codes(rounds: int = 6) -> str:
    cte = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        "part AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM v, range(8) r(p))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        cte.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := {distance}, e := e)) AS m FROM part JOIN book{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            sums = f"SELECT p, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM part JOIN near{r} USING (vec_id, p), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL"
            means = f"SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM ({sums}) GROUP BY p, e"
            cte.append(f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN ({means}) m USING (p, e))")
    return f"""WITH {", ".join(cte)},
      coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
      labelled AS (SELECT v.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM coded JOIN v ON v.vec_id = coded.vec_id)
      SELECT *, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM labelled"""


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL: dict[str, str] = {
    "op1_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
      link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
      edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
      reach AS (SELECT a AS i, a AS j FROM edge UNION SELECT r.i, e.b FROM reach r JOIN edge e ON e.a = r.j),
      root AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i),
      degree AS (SELECT a AS i, count(*) AS n_links FROM edge GROUP BY a),
      same AS (SELECT b AS i, min(a) AS class_id FROM (SELECT a, b, c FROM p UNION ALL SELECT b, a, c FROM p) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c = x.n AND c = y.n GROUP BY b)
      SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(same.class_id, d.doc_id), d.doc_id) AS class_id, coalesce(root.component_id, d.doc_id) AS component_id, coalesce(degree.n_links, 0) AS n_links
      FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN root ON root.i = d.doc_id LEFT JOIN degree ON degree.i = d.doc_id LEFT JOIN same ON same.i = d.doc_id""",
    "op7_super_kmers": f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
      win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
      dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
      gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM dup)),
      pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
      kept AS (SELECT pos.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY pos.p) FILTER (gone.p IS NULL) AS text FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY 1)
      SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op11_legacy_archives": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
      q AS (SELECT *, array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> j) & 31) + 1)::INT, 1)), '')), '') AS payload_digest FROM p)
      SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
      FROM (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM q)""",
    "op12_importance_resampling": _resampling(),
    "op13_vector_codes": _vector_codes(),
}
