"""The queries over the operators of this subpackage, with their production parameters, and oracles where SQL can say one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, chat, decontamination, fim, hmm, jaccard, langid, licenses, nearest, packing, resampling, sharding, toxicity, wavelet
from shelfmark.llm.wordcols import CAPITALS, SMALL, WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.external_shuffle(_table(spark, sf_dir, "documents"), n_shards=24))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversation_digest(chat.prefix_target_examples(turns.unionByName(extra)))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_documents(wavelet.write_shards(_table(spark, sf_dir, "documents"), bpe.tokenizer_path(), end_id=2))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def _fold(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), _fold(3) != 1)
    return scored.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"), _fold(7) != 2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _fold(5) != 0)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), bpe.tokenizer_path(), capacity=1024, end_id=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, least_words=20, max_order=1, buckets=10_000, seed=2024)


PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), PHRASES)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, percent=50, spm_percent=80))


QUERIES = {
    "op1_shards": op1_shards, "op2_chat": op2_chat, "op3_wavelet": op3_wavelet, "op4_toxicity": op4_toxicity, "op5_nearest": op5_nearest, "op6_hmm": op6_hmm,
    "op7_language": op7_language, "op8_packing": op8_packing, "op9_decontamination": op9_decontamination, "op10_jaccard": op10_jaccard,
    "op11_resampling": op11_resampling, "op12_licenses": op12_licenses, "op13_fim": op13_fim}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}')"
_HEX = lambda of, group: f"CAST('0x' || substr(sha256({of}), {8 * group + 1}, 8) AS BIGINT)"


def _licenses_sql(k: int = 3, gap: int = 2, least_share: float = 0.7, longest: float = 1.5) -> str:
    """The whole scan over runs of ``k`` words as text; every template has as many words at least."""
    texts = [(label, exact, " ".join(licenses.template_words(text))) for exact, given in ((True, PHRASES), (False, licenses.NOTICES)) for label, text in given]
    values = ", ".join(f"({i}, '{label}', {exact}, '{text}')" for i, (label, exact, text) in enumerate(texts))
    return f"""WITH t AS (SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n_template, len(string_split(text, ' ')) - {k - 1} AS n_runs FROM (VALUES {values}) v(template, label, phrase, text)),
        q AS (SELECT template, q, array_to_string(w[q + 1:q + {k}], ' ') AS run FROM (SELECT template, w, unnest(range(0, n_runs)) AS q FROM t)),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT r, p, array_to_string(w[p + 1:p + {k}], ' ') AS run FROM (SELECT r, w, unnest(range(0, len(w) - {k - 1})) AS p FROM d WHERE len(w) >= {k})),
        v AS (SELECT p.r, q.template, p.p - q.q AS diagonal, q.q, p.p FROM p JOIN q ON p.run = q.run),
        g AS (SELECT r, template, diagonal, count(*) AS hits, min(p) AS a, max(p) + {k} AS b FROM v GROUP BY ALL),
        c AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS chain FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {gap} THEN 0 ELSE 1 END AS fresh FROM g)),
        h AS (SELECT c.r, c.template, c.chain, count(DISTINCT v.q) AS hits, min(v.p) AS a, max(v.p) + {k} AS b FROM c JOIN v ON v.r = c.r AND v.template = c.template AND v.diagonal = c.diagonal GROUP BY ALL),
        n AS (SELECT h.r, label, phrase, template, a, b, hits / n_runs AS share FROM h JOIN t USING (template) WHERE b - a <= {longest} * n_template),
        i AS (SELECT *, sum(apart) OVER (PARTITION BY r, phrase ORDER BY a, b, template) AS island FROM (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY r, phrase ORDER BY a, b, template
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM n)),
        s AS (SELECT r, label, phrase, FALSE AS exact, a, share, share = max(share) OVER (PARTITION BY r, phrase, island) AS best FROM i
            UNION ALL SELECT g.r, label, phrase, TRUE, a, 1.0, TRUE FROM g JOIN t USING (template) WHERE hits = n_runs),
        f AS (SELECT r, count(*) FILTER (phrase AND exact) AS n_base, min(a) FILTER (phrase AND exact) AS first_word, max(a) FILTER (phrase AND exact) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase AND exact) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase AND exact OR NOT phrase AND best AND share >= {least_share}) AS labels, CAST(max(share) AS DOUBLE) AS score FROM s GROUP BY r)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN f USING (r)"""


#: crc32 of a word's UTF-8 bytes, from the polynomial: a table of 256 remainders, then byte by byte.
_CRC = """c AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i))"""


def _resampling_sql(buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> str:
    byte = "(16 * (instr('0123456789ABCDEF', substr(x, 2 * k + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * k + 2, 1)) - 1)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: {byte})), lambda s, b: xor(s >> 8, crc[xor(s, b) % 256 + 1])), 4294967295)"
    return f"""WITH {_CRC}, d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        a AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d), b AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
        k AS MATERIALIZED (SELECT word, CAST({crc} AS BIGINT) % {buckets} AS bucket FROM (SELECT word, hex(encode(word)) AS x, crc FROM (SELECT word FROM a UNION SELECT word FROM b), c)),
        s AS (SELECT bucket, count(*) AS s FROM a JOIN k USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY 1),
        g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM a) + {buckets}.0::DOUBLE)) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + {buckets}.0::DOUBLE)))) AS BIGINT) AS gain
            FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM a JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
        o AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
            + CAST(floor(-1000 * ln(-ln(({_HEX(f"'{seed}:' || doc_id", 0)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
        e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank FROM o WHERE n_features >= {least_words})
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM e) // 100 THEN rank END AS rank FROM o LEFT JOIN e USING (r)"""


_DRAWS = ", ".join(_HEX("'42:' || doc_id", i) + f" AS h{i + 1}" for i in range(4))
_FIM_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{fim.UNIT}') AS u, {_DRAWS} FROM documents),
    k AS (SELECT *, len(u) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
    p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM p"""

ORACLES: dict[str, str] = {
    "op11_resampling": _resampling_sql(),
    "op12_licenses": _licenses_sql(),
    "op13_fim": _FIM_SQL,
    "op2_chat": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
        SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
        n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, 13 + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l'))
        + length(text) + length(regexp_replace(text, '<\\*\|', '#', 'g')) * 0 + len(regexp_extract_all(text, '<\\*\|')) + 11 AS chars FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        e AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op5_nearest": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op10_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, m.m) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) m ON m.a = d.doc_id""",
}
