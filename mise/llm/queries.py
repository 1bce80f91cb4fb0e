"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bench_decontam, chat_quotes, fill_in_middle, lang_id, license_scans, pii, quality_rules, secret_scans,
               sentencepiece_codec, simhash_neardup, token_counts, toxicity, vector_codes)
from .common import crc_mod3, read


def op1_chat_quotes(spark, sf_dir):
    return chat_quotes.reply_ordered(read(spark, sf_dir, "conversations"))


def chat_quotes_derived(spark, sf_dir):
    """The given conversations quote nothing: each message quotes an earlier one, line by line, in part or wrapped anew."""
    said = read(spark, sf_dir, "conversations")
    before = said.select("conv_id", F.col("turn").alias("quoted"), F.col("text").alias("source"))
    rows = said.withColumn("quoted", F.col("turn") - 1 - F.col("turn") % 2).join(before, ["conv_id", "quoted"], "left")
    flat = F.replace("source", F.lit("\n"), F.lit(" "))
    style = (F.col("conv_id") + F.col("turn")) % 4
    quote = (F.when(style == 0, F.concat(F.lit("> "), F.replace("source", F.lit("\n"), F.lit("\n> "))))
             .when(style == 1, F.concat(F.lit("> "), F.array_join(F.slice(F.split(flat, " "), 3, 12), " ")))
             .when(style == 2, F.concat(F.lit("> "), F.regexp_replace(flat, "((?:[^ ]+ ){6})", "$1\n> "))))
    quoting = F.coalesce(F.concat(quote, F.lit("\n"), F.col("text")), F.col("text"))
    return chat_quotes.reply_ordered(rows.select("conv_id", "turn", "role", quoting.alias("text")))


def op2_bench_decontam(spark, sf_dir):
    return bench_decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    order = quality_rules.plan_rules(docs)
    return quality_rules.report(docs, order).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op4_license_scans(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scans.scan(docs, license_scans.fit(docs))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), license_scans.families().alias("families"),
                        F.size(F.filter("licenses", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
                        F.size(F.filter("licenses", lambda x: x["family"] == license_scans.UNKNOWN)).cast("long").alias("n_unknown"))


def op5_pii(spark, sf_dir):
    found = pii.scan(read(spark, sf_dir, "documents"))
    counts = [pii.n_of("base", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs, keep_text=False)


def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model, keep_text=False)


def op8_secret_scans(spark, sf_dir):
    found = secret_scans.with_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *(secret_scans.n_base(k).alias(f"n_{k}") for k in secret_scans.KINDS),
                        F.sha2(F.col("base_joined"), 256).alias("base_sha256"), secret_scans.joined_spans().alias("spans"),
                        "n_layers", "max_depth", "n_oversized")


def op9_lang_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(crc_mod3(F.col("doc_id")) == 1, F.lit(False)))
    model = lang_id.fit(docs.where(crc_mod3(F.col("doc_id")) != 1))
    return lang_id.predict(docs.drop("lang"), model, keep_text=False)


def op10_simhash_neardup(spark, sf_dir):
    found = simhash_neardup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_neardup.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark, sf_dir):
    return vector_codes.compressed(read(spark, sf_dir, "embeddings")).drop("label")


def op12_fill_in_middle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle.transform(docs, keep_text=False, keep_output=False)


def op13_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, keep_text=False)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_chat_quotes, op2_bench_decontam, op3_quality_rules, op4_license_scans, op5_pii, op6_sentencepiece, op7_toxicity,
    op8_secret_scans, op9_lang_id, op10_simhash_neardup, op11_vector_codes, op12_fill_in_middle, op13_token_counts, pipeline,
    chat_quotes_derived)}


_DERIVED_SQL = r"""derived AS (
  SELECT a.conv_id, a.turn, a.role, coalesce(CASE (a.conv_id + a.turn) % 4
      WHEN 0 THEN '> ' || replace(b.text, chr(10), chr(10) || '> ')
      WHEN 1 THEN '> ' || array_to_string(string_split(replace(b.text, chr(10), ' '), ' ')[3:14], ' ')
      WHEN 2 THEN '> ' || regexp_replace(replace(b.text, chr(10), ' '), '((?:[^ ]+ ){6})', '\1' || chr(10) || '> ', 'g') END || chr(10) || a.text, a.text) AS text
  FROM conversations AS a LEFT JOIN conversations AS b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 - a.turn % 2),"""


def _chat_sql(table: str, ctes: str = "") -> str:
    norm = r"lower(trim(regexp_replace({}, '[ \t\n\x0B\f\r>]+', ' ', 'g')))"

    def units(source: str, out: str, keys: str) -> str:
        """Units of (keys, ls): whole, paragraphs, lines and windows of five words, each once."""
        return f"""
{out}_w AS (SELECT {keys}, string_split({norm.format("array_to_string(ls, ' ')")}, ' ') AS w FROM {source}),
{out}_l AS (SELECT rid0, {keys}, i, line, {norm.format('line')} = '' AS blank FROM (SELECT row_number() OVER () AS rid0, * FROM {source}), LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i)),
{out}_p AS (SELECT {keys}, string_agg(line, ' ' ORDER BY i) AS u FROM (
    SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY rid0 ORDER BY i) AS par FROM {out}_l) WHERE NOT blank GROUP BY rid0, par, {keys}),
{out} AS (
  SELECT DISTINCT * FROM (
    SELECT {keys}, u, length(u) AS weight, false AS gram FROM (
      SELECT {keys}, {norm.format('u')} AS u FROM (
        SELECT {keys}, array_to_string(ls, ' ') AS u FROM {source} UNION ALL SELECT * FROM {out}_p UNION ALL SELECT {keys}, line FROM {out}_l)) WHERE u <> ''
    UNION ALL SELECT {keys}, array_to_string(w[i:i + 4], ' '), length(array_to_string(w[i:i + 4], ' ')) // 5, true FROM {out}_w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)))"""
    return f"""
WITH RECURSIVE {ctes}""" + r"""
m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) AS ls FROM """ + table + r"""),
l0 AS (SELECT rid, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM m),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS depth,
              regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS bare FROM l0),
l AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY rid ORDER BY i), 0) AS after,
             i - row_number() OVER (PARTITION BY rid, depth ORDER BY i) AS run FROM l1),
own AS (SELECT rid, trim(string_agg(bare, chr(10) ORDER BY i)) AS body FROM l
        WHERE depth = 0 AND NOT (after > 0 AND regexp_matches(line, '(?i)^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb\b.*|el\b.*\bescribió)\s*:\s*$'))
        GROUP BY rid),
b AS (SELECT rid, conv_id, turn, role, coalesce(body, '') AS body FROM m LEFT JOIN own USING (rid)),
runs AS (SELECT rid, conv_id, turn, depth, run, list(bare ORDER BY i) AS ls FROM l WHERE depth > 0 GROUP BY ALL),
talks AS (SELECT DISTINCT conv_id FROM runs),
qs AS (SELECT conv_id, turn, depth, ls FROM runs WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
hs AS (SELECT conv_id, turn, string_split(body, chr(10)) AS ls FROM b SEMI JOIN talks USING (conv_id) WHERE turn IS NOT NULL),""" + units(
        "qs", "q", "conv_id, turn, depth") + "," + units("hs", "h", "conv_id, turn") + r""",
first AS (SELECT conv_id, u, gram, min(turn) AS reply_to FROM h GROUP BY ALL),
near AS (SELECT q.conv_id, q.turn, q.depth, q.u, max(h.turn) AS reply_to FROM q JOIN h ON h.conv_id = q.conv_id AND h.u = q.u AND NOT h.gram AND h.turn < q.turn
         WHERE NOT q.gram AND q.weight < 8 GROUP BY ALL),
met AS (SELECT q.*, f.reply_to FROM q JOIN first AS f ON f.conv_id = q.conv_id AND f.u = q.u AND f.gram = q.gram
        WHERE (q.gram OR q.weight >= 8) AND f.reply_to < q.turn
        UNION ALL SELECT q.*, n.reply_to FROM q JOIN near AS n ON n.conv_id = q.conv_id AND n.turn = q.turn AND n.depth = q.depth AND n.u = q.u WHERE NOT q.gram),
grams AS (SELECT conv_id, turn, depth, count(*) AS n FROM q WHERE gram GROUP BY ALL),
c AS (SELECT met.conv_id, met.turn, met.depth, reply_to, sum(CASE WHEN NOT gram THEN weight ELSE 0 END)
             + CASE WHEN 2 * count(*) FILTER (WHERE gram) >= any_value(n) THEN sum(CASE WHEN gram THEN weight ELSE 0 END) ELSE 0 END AS weight
      FROM met LEFT JOIN grams AS g ON g.conv_id = met.conv_id AND g.turn = met.turn AND g.depth = met.depth GROUP BY ALL),
best AS (SELECT conv_id, turn, reply_to FROM c WHERE weight > 0
         QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth, weight DESC, reply_to DESC) = 1),
tree AS (SELECT DISTINCT conv_id, reply_to AS turn, reply_to AS thread, 0::BIGINT AS depth, [reply_to] AS path FROM best
             WHERE NOT EXISTS (SELECT 1 FROM best AS o WHERE o.conv_id = best.conv_id AND o.turn = best.reply_to)
         UNION ALL SELECT best.conv_id, best.turn, tree.thread, tree.depth + 1, list_append(tree.path, best.turn)
             FROM tree JOIN best ON best.conv_id = tree.conv_id AND best.reply_to = tree.turn),
n AS (SELECT rid, count(*) AS n_quotes, max(depth) AS quote_depth FROM runs GROUP BY rid),
o AS (SELECT b.conv_id, b.turn, b.role, b.body, coalesce(n.n_quotes, 0)::BIGINT AS n_quotes, coalesce(n.quote_depth, 0)::BIGINT AS quote_depth,
             best.reply_to, coalesce(tree.thread, b.turn) AS thread, coalesce(tree.depth, 0)::BIGINT AS depth, tree.path
      FROM b LEFT JOIN n ON n.rid = b.rid LEFT JOIN best ON best.conv_id = b.conv_id AND best.turn = b.turn
      LEFT JOIN tree ON tree.conv_id = b.conv_id AND tree.turn = b.turn)
SELECT * EXCLUDE (path), row_number() OVER (ORDER BY conv_id NULLS FIRST, thread NULLS FIRST, path NULLS LAST, turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position FROM o"""


def _codes_sql() -> str:
    """Six rounds and the last assignment, each point measured against all 16 entries of its part."""
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.x)])::BIGINT"
    steps = [r"""
v AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, q) AS rid, len(q) // 8 AS w FROM v),
p AS MATERIALIZED (SELECT rid, k, q[k * w + 1:(k + 1) * w] AS x FROM r, range(8) AS t(k)),
b0 AS (SELECT k, rid - 1 AS e, x FROM p WHERE rid <= 16)"""]
    for i in range(7):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT p.rid, p.k, min({{'d': {gap}, 'e': b.e}}) AS best FROM p JOIN b{i} AS b ON b.k = p.k GROUP BY ALL)""")
        if i < 6:
            steps.append(f"""
m{i} AS (SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
          SELECT k, e, i, sum(c) AS s, count(*) AS n FROM (
              SELECT a.k, a.best.e AS e, unnest(range(1, len(p.x) + 1)) AS i, unnest(p.x) AS c
              FROM a{i} AS a JOIN p ON p.rid = a.rid AND p.k = a.k) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce([x::BIGINT for x in m.x], b.x) AS x FROM b{i} AS b LEFT JOIN m{i} AS m ON m.k = b.k AND m.e = b.e)""")
    return "WITH" + ",".join(steps) + """,
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b6),
c AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, sum(best.d)::BIGINT AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM r JOIN c USING (rid), books"""


ORACLE = {
    "op1_chat_quotes": _chat_sql("conversations"),
    "chat_quotes_derived": _chat_sql("derived", _DERIVED_SQL),
    "op3_quality_rules": r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
    FROM documents),
places AS (SELECT rid, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM d),
windows AS (SELECT rid, n, i, CASE WHEN i <= n - 4 THEN array_to_string(w[i:i + 4], ' ') END AS k FROM places),
counted AS (SELECT rid, i, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY rid, k) > 1 THEN 1 ELSE 0 END AS twice FROM windows),
covered AS (SELECT rid, max(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM counted),
repeats AS (SELECT rid, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY rid),
f AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
           length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
           length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
           len([x for x in w if regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')]) AS n_letter_words
    FROM d LEFT JOIN repeats USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 100 * n_dup_lines > 60 * n_lines
            OR NOT (2 * n_words <= word_chars AND word_chars <= 25 * n_words) OR 100 * n_upper > 50 * (n_upper + n_lower)
            OR 10 * n_exclaim > 4 * n_words OR 100 * n_letter_words < 50 * n_words) AS kept
FROM b""",
    "op11_vector_codes": _codes_sql(),
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
x AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:len(l)], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, len(l)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM x""",
}
