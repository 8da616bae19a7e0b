"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import align, chat, chunks, jaccard, langid, licenses, mixing, negatives, pieces, quality_rules, scoring, tokens, vectors
from tidewatch.llm.graph import stored
from tidewatch.llm.registry import query
from tidewatch.session import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(rf"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, len(embedding) AS dim, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
         AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS fit
  FROM embeddings),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id
  WHERE a.fit AND b.fit AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id""")
def op6_embedding_near_dedup(spark, folder):
    return vectors.embedding_components(table(spark, folder, "embeddings"))


@query(rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
         lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op10_ngram_jaccard_join(spark, folder):
    return jaccard.jaccard_components(table(spark, folder, "documents"), size=3, per_cent=90)


@query()
def op1_sentencepiece(spark, folder):
    docs = table(spark, folder, "documents")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return coded.select("doc_id", "n_tokens", "ids_crc32", F.crc32("decoded").alias("decoded_crc32"), "round_trip")


@query()
def op5_token_ids(spark, folder):
    out = new_folder(spark, "token-ids")
    tokens.write_ids(table(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokens.read_ids(spark, out)


@query()
def op9_substring_dedup(spark, folder):
    return chunks.repeated_spans(table(spark, folder, "documents"))


@query()
def op7_hidden_markov_scores(spark, folder):
    return scoring.hmm_scores(table(spark, folder, "documents"))


def quality_sql() -> str:
    """The measures, the exact binomial test of each cutoff and the verdicts, in SQL."""
    tests = [(rule, cut) for rule, cuts in quality_rules.GRID.items() for cut in cuts]
    risk, rules = quality_rules.RISK, list(quality_rules.GRID)
    tail = f"""list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END
      - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))"""
    measures = ", ".join(rules)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3),
         lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4])) AS g
  FROM w WHERE len(w) >= 5),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN twice USING (doc_id, g))
  GROUP BY doc_id),
m AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END::BIGINT AS symbol_share,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END::BIGINT AS line_share,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END::BIGINT AS repeat_share,
         CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END::BIGINT AS mean_length
  FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
c AS (
  SELECT stratum, count(*) AS n, [{", ".join(f"{{'rule': '{r}', 'cut': {c}, 'k': count(*) FILTER ({r} >= {c})}}" for r, c in tests)}] AS t
  FROM v JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
e AS (SELECT stratum, n, unnest(t, recursive := true) FROM c),
f AS (
  SELECT stratum, rule, min(cut) AS cut FROM e
  WHERE CASE WHEN k < n * {risk} THEN {tail} ELSE 1 END
        <= {quality_rules.CONFIDENCE} / ((SELECT count(*) FROM c) * {len(tests)})
  GROUP BY stratum, rule),
x AS (SELECT stratum, {", ".join(f"min(cut) FILTER (rule = '{r}')::INTEGER AS {r}_cut" for r in rules)} FROM f GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} >= {r}_cut, false)" for r in rules)}) AS kept,
       {measures}, {", ".join(f"{r}_cut" for r in rules)}
FROM v LEFT JOIN x USING (stratum)"""


@query(quality_sql())
def op4_quality_rules(spark, folder):
    return quality_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: The mixture that is asked for: whole weights of domains, languages and sources.
WEIGHTS = {
    "domain": {"web": 50, "books": 30, "code": 20},
    "lang": {"en": 40, "de": 20, "fr": 20, "es": 20},
    "source": {"src0": 2},
}
SHARE, EPOCHS = 0.8, 2
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN right(source, 1) IN ('4', '5', '6') THEN 'books' ELSE 'code' END"


def mixing_sql() -> str:
    def weight(name):
        return f"CASE x.{name} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {w}' for k, w in WEIGHTS[name].items())} ELSE 1 END"

    levels, steps = mixing.LEVELS, []
    for depth, name in enumerate(levels):
        parent, own = levels[:depth], levels[: depth + 1]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        join = f"JOIN b{depth} USING ({', '.join(parent)})" if parent else ", b0"
        steps.append(f"""
c{depth} AS (SELECT {", ".join(f"x.{c}" for c in own)}, most, {weight(name)} AS weight, budget
  FROM (SELECT {", ".join(own)}, sum(tokens)::BIGINT * {EPOCHS} AS most FROM leaves GROUP BY ALL) x {join}),
o{depth} AS (SELECT *, coalesce(sum(most) OVER p, 0) AS pm, coalesce(sum(weight) OVER p, 0) AS pw, sum(weight) OVER a AS aw FROM c{depth}
  WINDOW p AS ({by} ORDER BY most::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({by})),
f{depth} AS (SELECT *, most * (aw - pw) <= (budget - pm) * weight AS is_full FROM o{depth}),
b{depth + 1} AS (SELECT {", ".join(own)}, CASE WHEN is_full THEN most ELSE (budget - coalesce(sum(most) FILTER (is_full) OVER a, 0)) * weight
  // (aw - coalesce(sum(weight) FILTER (is_full) OVER a, 0)) END AS budget FROM f{depth} WINDOW a AS ({by}))""")
    return rf"""
WITH t AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
b0 AS (SELECT floor(sum(tokens) * {SHARE}::DOUBLE)::BIGINT AS budget FROM leaves),{",".join(steps)},
p AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epoch, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM leaves JOIN b3 USING (domain, lang, source)),
r AS (SELECT t.*, epoch, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('7|' || epoch::BIGINT || '|' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM t JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (epoch + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r"""


@query(mixing_sql())
def op8_mixing(spark, folder):
    return mixing.mixed(table(spark, folder, "documents"), F.expr(DOMAIN), SHARE, EPOCHS, WEIGHTS)


@query()
def op3_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    return langid.fused(langid.document_evidence(docs), langid.text_model(docs), ["doc_id"])


@query()
def page_language(spark, folder):
    model = langid.text_model(table(spark, folder, "documents"))
    return langid.fused(langid.page_evidence(table(spark, folder, "pages")), model, ["page_id"])


@query()
def op2_license_scan(spark, folder):
    return licenses.license_spans(table(spark, folder, "documents"))


#: A conversation whose texts are control strings, formatted with all others.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query(rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS begins,
        length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS role_chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN begins THEN {len(chat.START) + 1 + len(chat.END)} + role_chars ELSE {len(chat.NEXT)} END)::BIGINT AS formatted_chars,
       count(*) FILTER (begins) AS n_blocks
FROM o GROUP BY conv_id""")
def op13_chat_formatting(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat.digests(stored(chat.formatted(rows.unionByName(own)), "chat"))


@query()
def op12_cross_tokenizer_alignment(spark, folder):
    names = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.alignment(table(spark, folder, "documents"), *names)


@query("""
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS own, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER w::INTEGER AS rank, n.other AS negative_id, p.score AS positive_score,
       n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)
QUALIFY rank <= 10""")
def op11_hard_negatives(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings").withColumn("label", moved))
