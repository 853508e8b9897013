"""Registered queries: BLEU, token profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators.bleu import RULES, corpus_bleu
from labelflow.operators.runs import RANGE, lagged, ranged
from labelflow.operators.tokens import TARGET_LIMIT, token_profile, truncate_tokens
from labelflow.plans.registry import register
from labelflow.sources.tables import read_table


def _tok_sql(x: str) -> str:
    e = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        e = f"replace({e}, '{a}', '{b}')"
    e = f"(' ' || {e} || ' ')"
    for pattern, repl in RULES:
        e = f"regexp_replace({e}, '{pattern}', '{repl.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({e}, '\\s+'), lambda t: t <> '')"


BLEU_SQL = f"""WITH c AS (SELECT conv_id, turn, role, text,
                  lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
           FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn,
                        CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, md5(coalesce(text, '')))),
pairs AS (SELECT concat_ws('-', coalesce(CAST(conv_id AS VARCHAR), 'x'), turn, role) AS rid, text AS hyp, prev_text AS ref FROM c
          WHERE role = 'assistant' AND prev_role = 'user'),
tok AS (SELECT rid, {_tok_sql('hyp')} AS ht, {_tok_sql('ref')} AS rt FROM pairs),
ords AS (SELECT * FROM range(1, 5) o(n)),
hg AS (SELECT rid, n, array_to_string(ht[i:i + n - 1], ' ') AS gram
       FROM (SELECT rid, ht, n, unnest(range(1, len(ht) - n + 2)) AS i FROM tok, ords)),
rg AS (SELECT rid, n, array_to_string(rt[i:i + n - 1], ' ') AS gram
       FROM (SELECT rid, rt, n, unnest(range(1, len(rt) - n + 2)) AS i FROM tok, ords)),
hc AS (SELECT rid, n, gram, count(*) AS c FROM hg GROUP BY ALL),
rc AS (SELECT rid, n, gram, count(*) AS c FROM rg GROUP BY ALL),
m AS (SELECT hc.n, sum(least(hc.c, coalesce(rc.c, 0))) AS correct, sum(hc.c) AS total
      FROM hc LEFT JOIN rc USING (rid, n, gram) GROUP BY hc.n),
st AS (SELECT
   coalesce((SELECT correct FROM m WHERE n = 1), 0) AS c1, coalesce((SELECT total FROM m WHERE n = 1), 0) AS t1,
   coalesce((SELECT correct FROM m WHERE n = 2), 0) AS c2, coalesce((SELECT total FROM m WHERE n = 2), 0) AS t2,
   coalesce((SELECT correct FROM m WHERE n = 3), 0) AS c3, coalesce((SELECT total FROM m WHERE n = 3), 0) AS t3,
   coalesce((SELECT correct FROM m WHERE n = 4), 0) AS c4, coalesce((SELECT total FROM m WHERE n = 4), 0) AS t4,
   (SELECT sum(len(ht)) FROM tok) AS sys_len, (SELECT sum(len(rt)) FROM tok) AS ref_len),
z AS (SELECT *, c1 + c2 + c3 + c4 > 0 AS anyc,
        (CASE WHEN t1 > 0 AND c1 = 0 THEN 1 ELSE 0 END) AS z1,
        (CASE WHEN t1 > 0 AND c1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN t2 > 0 AND c2 = 0 THEN 1 ELSE 0 END) AS z2,
        (CASE WHEN t1 > 0 AND c1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN t2 > 0 AND c2 = 0 THEN 1 ELSE 0 END)
          + (CASE WHEN t3 > 0 AND c3 = 0 THEN 1 ELSE 0 END) AS z3,
        (CASE WHEN t1 > 0 AND c1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN t2 > 0 AND c2 = 0 THEN 1 ELSE 0 END)
          + (CASE WHEN t3 > 0 AND c3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN t4 > 0 AND c4 = 0 THEN 1 ELSE 0 END) AS z4
      FROM st),
p AS (SELECT *,
  CASE WHEN NOT anyc OR t1 = 0 THEN 0.0 WHEN c1 = 0 THEN 100.0 / (pow(2, z1) * t1) ELSE 100.0 * c1 / t1 END AS p1,
  CASE WHEN NOT anyc OR t2 = 0 THEN 0.0 WHEN c2 = 0 THEN 100.0 / (pow(2, z2) * t2) ELSE 100.0 * c2 / t2 END AS p2,
  CASE WHEN NOT anyc OR t3 = 0 THEN 0.0 WHEN c3 = 0 THEN 100.0 / (pow(2, z3) * t3) ELSE 100.0 * c3 / t3 END AS p3,
  CASE WHEN NOT anyc OR t4 = 0 THEN 0.0 WHEN c4 = 0 THEN 100.0 / (pow(2, z4) * t4) ELSE 100.0 * c4 / t4 END AS p4,
  CASE WHEN sys_len < ref_len THEN CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END
       ELSE 1.0 END AS bp
  FROM z)
SELECT round(CASE WHEN anyc AND p1 > 0 AND p2 > 0 AND p3 > 0 AND p4 > 0
                  THEN bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0 END, 6) AS score,
       round(bp, 6) AS bp, sys_len::BIGINT AS sys_len, ref_len::BIGINT AS ref_len,
       round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4
FROM p"""


def _role_order():
    return F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)


def assistant_vs_user(conversations):
    """(rid, hyp, ref): each assistant turn against the user turn right
    before it in the same conversation (a system prompt and the first user
    message may share turn 0: the system row comes first; rows of one turn and
    role go by their text's digest).

    Turns are dealt to tasks by ranges of (conversation, turn), so a
    conversation of any length spreads over many; ``_range`` stays, the pairs
    are partitioned by it."""
    c = conversations.select("conv_id", "turn", "role", "text", _role_order().alias("_ord"),
                             F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    order = ["turn", "_ord", "_digest"]
    turns = ranged(c, [F.col(x) for x in ("conv_id", *order)], "turns")
    paired = lagged(turns, order, "conv_id", ["role", "text"])
    return paired.filter((F.col("role") == "assistant") & (F.col("prev_role") == "user")).select(
        RANGE, F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("x")), "turn", "role").alias("rid"),
        F.col("text").alias("hyp"), F.col("prev_text").alias("ref"))


@register("corpus_bleu", BLEU_SQL)
def q_corpus_bleu(spark, sf):
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    # of the assistant rows of a turn only the first follows a user row, so each rid is one pair
    return corpus_bleu(assistant_vs_user(conv), "hyp", "ref", "rid", distinct_ids=True)


TOKENS_SQL = "len(regexp_extract_all({x}, '\\S+'))::BIGINT"


def _quantile_sql(p: float) -> str:
    return f"quantile_disc(i, {p})::BIGINT AS p{round(100 * p)}"


@register("token_profile", f"""SELECT source AS dataset_name, count(*) AS n,
  max(i) AS max_tokens, {', '.join(_quantile_sql(p) for p in (0.5, 0.95, 0.99))},
  count(*) FILTER (WHERE i > 320) AS n_over_320, count(*) FILTER (WHERE i > 512) AS n_over_512
FROM (SELECT source, {TOKENS_SQL.format(x="coalesce(text, '')")} AS i FROM documents) t GROUP BY source""")
def q_token_profile(spark, sf):
    d = read_table(spark, sf, "documents", "source", "text").withColumnRenamed("source", "dataset_name")
    return token_profile(d, "text", by=("dataset_name",))


@register("token_profile_targets", f"""SELECT role AS task, count(*) AS n, max(i) AS max_tokens,
  {', '.join(_quantile_sql(p) for p in (0.5, 0.95, 0.99))},
  count(*) FILTER (WHERE i > 40) AS n_over_40, sum(least(i, 40))::BIGINT AS kept_tokens,
  sum(i)::BIGINT AS all_tokens
FROM (SELECT role, {TOKENS_SQL.format(x="coalesce(text, '')")} AS i FROM conversations) t GROUP BY role""")
def q_token_profile_targets(spark, sf):
    c = read_table(spark, sf, "conversations", "role", "text").withColumnRenamed("role", "task")
    return token_profile(c, "text", by=("task",), limits=(TARGET_LIMIT,), cut_at=TARGET_LIMIT)


@register("truncate_tokens", """SELECT conv_id, turn, role,
  array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 40), ' ') AS target FROM conversations""")
def q_truncate_tokens(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return c.select("conv_id", "turn", "role", truncate_tokens("text", TARGET_LIMIT).alias("target"))
