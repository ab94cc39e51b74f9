"""The registered queries: each applies one operator with production parameters to its whole table and returns the digest that its contract names."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontam, fim, langid, linededup, merkle, minhash, mixing, pivots, quality, sharding, tokenio, toxicity
from docloom.llm.common import id_fold, materialize, read, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether a row is of the held-out fold; one without an id is not."""
    return F.coalesce(id_fold(doc_id, folds) == fold, F.lit(False)).alias("held_out")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op1_mixing by source, which SQL can say."""
    sizes = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(mixing.word_count("text")).alias("source_size"))
    filled = mixing.water_fill(materialize(mixing.cyclic_weights(sizes), "sources"))
    return filled.select("source", "source_size", "weight", F.round("target", 3).alias("target"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit_on(docs.where(id_fold("doc_id", 3) != 1))
    return langid.identify(docs, model, reject=False).select("doc_id", held_out("doc_id", 3, 1), "lang_pred", "score", "accepted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read(spark, sf_dir, "documents"), shards=24)


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.similar_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op7_tokenio(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenio.write_ids(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenio.read_ids(spark, path, with_ids=False)


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades are labels.quality; fitted on rows whose crc32(doc_id as text) mod 4 is not 2. kept: P(grade of at least the second) >= 0.5."""
    docs = read(spark, sf_dir, "documents")
    ratings = read(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2).select("doc_id", F.col("quality").cast("double").alias("grade"))
    graded = quality.grade(docs, quality.fit_on(docs, ratings))
    return graded.select("doc_id", held_out("doc_id", 4, 2), "expected_grade", F.col("tail").alias("tail_prob"), "kept")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what a copy folds to in which some rows have n_chars one higher."""
    docs = read(spark, sf_dir, "documents")
    touched = F.coalesce(id_fold("doc_id", 7) == 0, F.lit(False))
    copy = merkle.record(["doc_id", "source", "lang", F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars")), "text"])
    rows = merkle.folded(merkle.manifest(docs, carry={"presented": copy}), "presented")
    shown = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    proof = F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256)
    return rows.select("doc_id", *[v.alias(k) for k, v in shown.items()], proof.alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path, packed=True), path)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "mix_targets": mix_targets,
    "op2_langid": op2_langid,
    "op3_toxicity": op3_toxicity,
    "op4_decontam": op4_decontam,
    "op5_sharding": op5_sharding,
    "op6_linededup": op6_linededup,
    "op7_tokenio": op7_tokenio,
    "op8_pivots": op8_pivots,
    "op9_quality": op9_quality,
    "op10_minhash": op10_minhash,
    "op11_merkle": op11_merkle,
    "op12_fim": op12_fim,
    "op13_bpe": op13_bpe,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPONENTS = (
    "links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs), reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x), "
    "comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)"
)
def _leaf(n_chars: str) -> str:
    fields = [f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c}), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a short ASCII text: eight steps of shift and mask a character."""
    eight = "list_reduce(list_prepend(xor(c, o), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, o: {eight}), 4294967295)"


#: SQL for the operators that SQL can express; hashes, classifiers and the coder are held against brute force in tests.
ORACLES: dict[str, str] = {
    "mix_targets": (
        "WITH s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents) GROUP BY source), "
        "w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s), "
        "c AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w) "
        "SELECT source, source_size, weight, round(least(cap, weight * (SELECT level FROM c WHERE level <= ratio ORDER BY ratio, source LIMIT 1)), 3) AS target FROM c"
    ),
    "op4_decontam": (
        "WITH word_re AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS r), "
        f"d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, r), []) AS l FROM documents, word_re), i AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, r) AS l FROM benchmark, word_re), "
        "win AS (SELECT DISTINCT item_id, least(len(l), 13) AS m, array_to_string(l[p : p + least(len(l), 13) - 1], ' ') AS k FROM (SELECT item_id, l, unnest(range(1, greatest(len(l) - 13, 0) + 2)) AS p FROM i WHERE len(l) > 0)), "
        "gram AS (SELECT doc_id, m, p, array_to_string(l[p : p + m - 1], ' ') AS k FROM (SELECT doc_id, l, m, unnest(range(1, len(l) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(l) >= m)), "
        "hits AS (SELECT doc_id, p, gram.m, item_id FROM gram JOIN win ON gram.k = win.k AND gram.m = win.m), "
        "hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id), "
        "hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id) "
        "SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(l), false) AS contaminated "
        "FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"
    ),
    "op6_linededup": (
        f"WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, list_sort(list_distinct(regexp_extract_all({_LOWER.format('unnest(x)')}, '[^\\x20\\x09-\\x0D]+'))) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), "
        "u AS (SELECT t, min({d: doc_id, l: line}) AS at, len(t) AS n, row_number() OVER () AS id FROM l WHERE len(t) > 0 GROUP BY t), tok AS (SELECT id, n, unnest(t) AS w FROM u), "
        "df AS (SELECT w, count(*) AS c FROM tok GROUP BY w), pre AS (SELECT id, n, w FROM (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS p FROM tok JOIN df USING (w)) WHERE p <= n - (4 * n + 4) // 5 + 1), "
        "cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.w = b.w AND a.id <> b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)), "
        "near AS (SELECT DISTINCT y.id FROM cand JOIN u x ON x.id = cand.a JOIN u y ON y.id = cand.b WHERE x.at < y.at AND 100 * len(list_intersect(x.t, y.t)) >= 80 * (x.n + y.n - len(list_intersect(x.t, y.t)))), "
        "gone AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed_lines FROM l JOIN u USING (t) LEFT JOIN near USING (id) WHERE near.id IS NOT NULL OR u.at <> {d: doc_id, l: line} GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents) LEFT JOIN gone USING (doc_id)"
    ),
    "op8_pivots": (
        "WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0), "
        f"pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95), {_COMPONENTS}, n AS (SELECT x, count(*) AS k FROM links GROUP BY x) "
        "SELECT vec_id, coalesce(k, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN comp ON comp.x = vec_id LEFT JOIN n ON n.x = vec_id"
    ),
    "op10_minhash": (
        f"WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS l FROM documents WHERE text IS NOT NULL), "
        "s AS (SELECT DISTINCT doc_id, l[p] || CASE WHEN len(l) > 1 THEN ' ' || l[p + 1] ELSE '' END AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS p FROM d WHERE len(l) > 0)), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id "
        f"WHERE 5 * least(na.n, nb.n) >= 4 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))), {_COMPONENTS} "
        "SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id <= coalesce(c, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.x = doc_id"
    ),
    "op11_merkle": (
        f"WITH RECURSIVE leaf AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS shown FROM documents), "
        "pos AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM leaf), "
        "tree AS (SELECT lang, 0 AS lvl, i, c, leaf AS h FROM pos UNION ALL SELECT lang, lvl + 1, i // 2, any_value((c + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE c > 1 GROUP BY lang, lvl + 1, i // 2), "
        "subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM tree WHERE c = 1), "
        "tops AS (SELECT 0 AS lvl, i, c, subroot AS h FROM subs UNION ALL SELECT lvl + 1, i // 2, any_value((c + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE c > 1 GROUP BY lvl + 1, i // 2), "
        "sib AS (SELECT doc_id, lvl, h FROM pos JOIN tree ON pos.lang IS NOT DISTINCT FROM tree.lang AND tree.i = xor(pos.i >> lvl, 1)), "
        "topsib AS (SELECT lang, lvl, h FROM subs JOIN tops ON tops.i = xor(subs.i >> lvl, 1)), "
        "proof AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY lvl)) AS p FROM (SELECT * FROM sib UNION ALL SELECT doc_id, lvl + 1000, h FROM pos JOIN topsib ON pos.lang IS NOT DISTINCT FROM topsib.lang) GROUP BY doc_id), "
        "low AS (SELECT doc_id, lang, 0 AS lvl, i, c, shown AS h FROM pos UNION ALL SELECT low.doc_id, lang, low.lvl + 1, i // 2, (c + 1) // 2, sha256(CASE WHEN i % 2 = 1 THEN s.h || low.h ELSE low.h || coalesce(s.h, '') END) FROM low LEFT JOIN sib s ON s.doc_id = low.doc_id AND s.lvl = low.lvl WHERE c > 1), "
        "high AS (SELECT doc_id, low.lang, 0 AS lvl, subs.i, subs.c, h FROM low JOIN subs ON low.lang IS NOT DISTINCT FROM subs.lang WHERE low.c = 1 UNION ALL "
        "SELECT doc_id, high.lang, high.lvl + 1, i // 2, (c + 1) // 2, sha256(CASE WHEN i % 2 = 1 THEN s.h || high.h ELSE high.h || coalesce(s.h, '') END) FROM high LEFT JOIN topsib s ON s.lang IS NOT DISTINCT FROM high.lang AND s.lvl = high.lvl WHERE c > 1) "
        "SELECT pos.doc_id, leaf, subroot, root, high.h AS folded_root, coalesce(p, sha256('')) AS proof_sha256, high.h = root AS verified FROM pos JOIN subs ON pos.lang IS NOT DISTINCT FROM subs.lang "
        "JOIN high ON high.doc_id = pos.doc_id AND high.c = 1 LEFT JOIN proof ON proof.doc_id = pos.doc_id, (SELECT h AS root FROM tops WHERE c = 1)"
    ),
    "op12_fim": (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS l, sha256('42:' || doc_id) AS h FROM documents), "
        "e AS (SELECT *, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d), "
        "f AS (SELECT doc_id, t, len(l) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, "
        "array_to_string(l[1:least(h1, h2)], '') AS p, array_to_string(l[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(l[greatest(h1, h2) + 1:], '') AS s FROM e) "
        "SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, "
        "sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"
    ),
}
