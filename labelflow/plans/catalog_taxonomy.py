"""Registered queries: taxonomy lookups, option lists, hierarchy rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import options as O
from labelflow.plans.registry import register
from labelflow.sources import taxonomy as TX
from labelflow.sources.tables import read_table


def values_sql(mapping: dict, cols=("key", "name")) -> str:
    def q(v):
        return "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in mapping.items())
    return f"(VALUES {rows}) AS t({', '.join(cols)})"


TAX_SQL = f"tx AS (SELECT * FROM {values_sql(TX.EVENT_TAXONOMY)})"


def _events(spark, sf, *cols):
    return read_table(spark, sf, "events", *(cols or ("event_id", "event_type")))


def _tax(spark):
    return TX.taxonomy_dim(spark, TX.EVENT_TAXONOMY, "events")


@register("taxonomy_dim", f"""WITH {TAX_SQL}
SELECT 'events' AS taxonomy, tx.key, tx.name, count(e.event_id) AS n
FROM tx LEFT JOIN events e ON e.event_type = tx.key GROUP BY tx.key, tx.name""")
def q_taxonomy_dim(spark, sf):
    """The dimension with the rows that carry each key."""
    n = _events(spark, sf).groupBy(F.col("event_type").alias("key")).agg(F.count("event_id").alias("n"))
    return _tax(spark).join(n, "key", "left").select(
        "taxonomy", "key", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@register("taxonomy_from_table", """SELECT DISTINCT 'nation_region' AS taxonomy, CAST(n.n_nationkey AS VARCHAR) AS key,
  r.r_name AS name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""")
def q_taxonomy_from_table(spark, sf):
    n = read_table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    r = read_table(spark, sf, "region", "r_regionkey", "r_name")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return TX.taxonomy_from_table(j, "n_nationkey", "r_name", "nation_region")


@register("map_labels_drop_unmapped", f"""WITH {TAX_SQL}
SELECT e.event_id, e.event_type AS orig_label, tx.name AS label
FROM events e JOIN tx ON tx.key = e.event_type""")
def q_map_labels(spark, sf):
    m = TX.map_labels(_events(spark, sf), "event_type", _tax(spark))
    return m.select("event_id", "orig_label", "label")


@register("default_label_switch", f"""WITH {TAX_SQL}
SELECT e.event_id, e.event_type AS y_default, tx.name AS y_mapped
FROM events e JOIN tx ON tx.key = e.event_type""")
def q_default_label_switch(spark, sf):
    m = TX.map_labels(_events(spark, sf), "event_type", _tax(spark), out_col="name",
                      keep_original=None)
    a = TX.default_label_switch(m, "event_type", "name", True, "y_default")
    b = TX.default_label_switch(a, "event_type", "name", False, "y_mapped")
    return b.select("event_id", "y_default", "y_mapped")


@register("semi_join_presence", f"""WITH {TAX_SQL}
SELECT key, name FROM tx WHERE key IN (SELECT event_type FROM events)""")
def q_semi_join_presence(spark, sf):
    return TX.present_labels(_tax(spark), _events(spark, sf), "event_type").select("key", "name")


@register("label_range_filter", """SELECT vec_id, label AS class_number FROM embeddings
WHERE label BETWEEN 2 AND 5""")
def q_label_range_filter(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "label")
    return e.filter(F.col("label").between(2, 5)).select("vec_id", F.col("label").alias("class_number"))


L2_SQL = """h AS (SELECT r.r_name AS l2, n.n_name AS name FROM nation n JOIN region r
               ON r.r_regionkey = n.n_regionkey WHERE n.n_nationkey < 20
      UNION ALL SELECT 'NAMED_1' AS l2, n_name AS name FROM nation WHERE n_name LIKE '%1%')"""


def _hierarchy(spark, sf):
    """Two-level hierarchy derived from nation/region: region groups for
    nations 0-19 plus an overlapping group of nations whose name contains a
    1; nations 20, 22-24 are in none."""
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region", "r_regionkey", "r_name")
    reg = (n.filter(F.col("n_nationkey") < 20).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("l2"), F.col("n_name").alias("name")))
    even = n.filter(F.col("n_name").contains("1")).select(F.lit("NAMED_1").alias("l2"),
                                                          F.col("n_name").alias("name"))
    return reg.unionByName(even)


@register("l2_rollup", f"""WITH {L2_SQL},
c AS (SELECT n.n_name AS name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT h.l2, count(*) AS n FROM c LEFT JOIN h ON h.name = c.name GROUP BY h.l2""")
def q_l2_rollup(spark, sf):
    c = read_table(spark, sf, "customer", "c_nationkey")
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name")
    names = c.join(n, c.c_nationkey == n.n_nationkey).select("n_name")
    return TX.l2_rollup(names, "n_name", _hierarchy(spark, sf))


PRESENT_SQL = f"""{TAX_SQL},
m AS (SELECT DISTINCT tx.key, tx.name FROM tx JOIN (SELECT DISTINCT event_type FROM events) e
      ON e.event_type = tx.key)"""


def _present(spark, sf):
    return _events(spark, sf, "event_type").withColumnRenamed("event_type", "key")


@register("option_numbering", f"""WITH {PRESENT_SQL}
SELECT row_number() OVER (ORDER BY key)::BIGINT AS option_no, key, name AS label FROM m""")
def q_option_numbering(spark, sf):
    m = _tax(spark).join(_present(spark, sf).distinct(), "key", "left_semi")
    return O.option_numbering(m, "key", "name")


@register("prompt_options_taxonomy", f"""WITH {PRESENT_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY key) AS i FROM m)
SELECT 'numbered' AS group_key,
       'OPTIONS' || chr(10) || string_agg(' ' || i || '. ' || name || ' ' || chr(10), '' ORDER BY key)
       AS prompt_options FROM r
UNION ALL
SELECT 'bullet', 'OPTIONS' || chr(10) || string_agg('# ' || name || ' ' || chr(10), '' ORDER BY key) FROM r
UNION ALL
SELECT 'default_labels',
       'OPTIONS' || chr(10) || string_agg(' ' || i || '. ' || key || ' ' || chr(10), '' ORDER BY key) FROM r""")
def q_prompt_options_taxonomy(spark, sf):
    pres, tax = _present(spark, sf), _tax(spark)
    parts = [("numbered", dict()), ("bullet", dict(bullet="#")),
             ("default_labels", dict(use_default_labels=True))]
    outs = [O.prompt_options_taxonomy(pres, tax, **kw).select(F.lit(k).alias("group_key"),
                                                               "prompt_options")
            for k, kw in parts]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


# extra accepted names for one event type (label expansion)
EVENT_EXPANSION = {"error": ["Bug Report", "Crash", "Failure"]}


@register("prompt_options_expanded", f"""WITH {PRESENT_SQL},
x AS (SELECT m.*, e.names FROM m LEFT JOIN (SELECT 'error' AS key,
        {list(EVENT_EXPANSION['error'])} AS names) e USING (key)),
r AS (SELECT *, sum(CASE WHEN names IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY key
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM x)
SELECT 'OPTIONS' || chr(10) || string_agg(CASE WHEN names IS NULL
          THEN ' ' || i || '. ' || name || ' ' || chr(10)
          ELSE array_to_string(list_transform(names, lambda n: '# ' || n || chr(10)), '') END,
        '' ORDER BY key) || ' # other # general # unknown ' AS prompt_options FROM r""")
def q_prompt_options_expanded(spark, sf):
    exp = TX.expansion_dim(spark, EVENT_EXPANSION)
    return O.prompt_options_expanded(_present(spark, sf), _tax(spark), exp)


@register("templated_dataset", f"""WITH {PRESENT_SQL}
SELECT name AS label, c::BIGINT AS copy, 'This sentence is ' || name AS text
FROM m, range(1, 9) r(c)""")
def q_templated_dataset(spark, sf):
    from labelflow.operators.options import templated_dataset

    m = _tax(spark).join(_present(spark, sf).distinct(), "key", "left_semi")
    return templated_dataset(m.select(F.col("name").alias("label")), "label", 8)
