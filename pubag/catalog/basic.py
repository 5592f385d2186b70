"""Registered queries: sources, projections, filters, joins, sets, aggregates, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import SEED, r6, with_sql
from pubag.functions import nulls, scalar
from pubag.operators import relational as R
from pubag.operators import sampling as S
from pubag.sources import io
from pubag.sources.fixtures import DOCS, LINES, pu_docs, pu_lines, table

FEATS = DOCS.features
F7 = FEATS + ["f7"]


# --- IO -------------------------------------------------------------------------

def io1_read_features(spark, sf):
    """IO1: a feature table read with an explicit column list (pruned Parquet scan)."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
                           T.StructField("lang", T.StringType())])
    return io.read_features(spark, f"{sf}/documents.parquet", schema)


def io3_write_table(spark, sf):
    """IO3: write the feature table to the shared folder and read it back."""
    df = pu_docs(spark, sf).select("doc_id", "grp", "y", *F7)
    path = io.write_table(df, io.scratch_path(spark, "io3"))
    return spark.read.parquet(path).select("doc_id", "grp", "y", *[r6(c).alias(c) for c in F7])


def io4_write_scores(spark, sf):
    """IO4: key + score as CSV with a header, read back with an explicit schema."""
    df = pu_docs(spark, sf).select("doc_id", R_score())
    path = io.write_scores(df, "doc_id", "score", io.scratch_path(spark, "io4"))
    back = spark.read.option("header", True).schema("doc_id bigint, score double").csv(path)
    return back.select("doc_id", r6("score").alias("score"))


def R_score():
    return F.try_divide(F.col("f4"), F.col("f1")).alias("score")


def io5_write_matrix(spark, sf):
    """IO5: class means per (group, class) pivoted to a matrix and written as CSV."""
    long = pu_docs(spark, sf).groupBy("grp", "y").agg(F.avg("f1").alias("v"))
    path = io.write_matrix(long.withColumn("y", F.concat(F.lit("y"), F.col("y").cast("string"))),
                           "grp", "y", "v", io.scratch_path(spark, "io5"), ["y0", "y1"])
    back = spark.read.option("header", True).schema("grp string, y0 double, y1 double").csv(path)
    return back.select("grp", r6("y0").alias("y0"), r6("y1").alias("y1"))


# --- PR ---------------------------------------------------------------------------

def pr1_select_feature(spark, sf):
    return R.select_feature(pu_docs(spark, sf), FEATS, 2, key="doc_id")


def pr2_feature_slice(spark, sf):
    d = pu_docs(spark, sf).select("doc_id", "grp", "source", "y", "y_true", *F7)
    return R.feature_slice(d, 10, 12).select("f6", r6("f7").alias("f7"))


def pr3_drop_columns(spark, sf):
    return R.drop_columns(pu_docs(spark, sf), ["source", "y_true", "f7"])


def pr5_feature_sets(spark, sf):
    """PR5: per variant (only f7 / base six / all seven) the row sum of its features."""
    d = pu_docs(spark, sf)
    outs = []
    for name, cols in R.feature_sets(FEATS, ["f7"]).items():
        s = None
        for c in cols:
            s = F.coalesce(F.col(c), F.lit(0.0)) if s is None else s + F.coalesce(F.col(c), F.lit(0.0))
        outs.append(d.select(F.lit(name).alias("variant"), "doc_id", r6(s).alias("fsum")))
    return R.union_tables(outs)


def pr6_with_label(spark, sf):
    u = pu_docs(spark, sf).filter(F.col("y") == 0)
    return R.with_label(u, 1).select("doc_id", "y")


def pr9_to_vector(spark, sf):
    from pyspark.ml.functions import vector_to_array
    v = R.to_vector(pu_docs(spark, sf), F7)
    return v.select("doc_id", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


# --- FI ---------------------------------------------------------------------------

def fi1_split_pu(spark, sf):
    p, u = R.split_pu(pu_docs(spark, sf))
    return p.select("doc_id", F.lit("P").alias("part")).unionByName(u.select("doc_id", F.lit("U").alias("part")))


def _scored(spark, sf):
    return pu_docs(spark, sf).select("doc_id", "y", "f1", R_score())


def fi2_reliable_negatives(spark, sf):
    return R.reliable_negatives(_scored(spark, sf), 0.005).select("doc_id")


def fi3_pseudo_positives(spark, sf):
    return R.pseudo_positives(_scored(spark, sf), 0.03).select("doc_id")


def fi4_class_filter(spark, sf):
    return R.class_filter(pu_lines(spark, sf), 1).select(*LINES.key)


def fi5_background_only(spark, sf):
    return R.background_only(_scored(spark, sf)).select("doc_id", r6("score").alias("score"))


# --- JO ---------------------------------------------------------------------------

LK2 = ["l_orderkey", "l_linenumber"]


def jo1_anti_by_key(spark, sf):
    """JO1: remove every line whose (orderkey, linenumber) is held out, duplicates included."""
    li = pu_lines(spark, sf)
    held = S.sample_n(li.select(*LK2).distinct(), 500, LK2, SEED, "held")
    return R.anti_by_key(li, held, LK2).select(*LINES.key)


def jo2_semi_by_key(spark, sf):
    d = _scored(spark, sf)
    keys = R.pseudo_positives(d, 0.03)
    return R.semi_by_key(pu_docs(spark, sf), keys, "doc_id").select("doc_id", "grp", "y")


def jo5_pair_groups(spark, sf):
    d = pu_docs(spark, sf)
    p, u = R.split_pu(d)
    counts = S.group_counts(p)
    return R.pair_groups(counts, u).groupBy("grp").agg(F.first("n").alias("n_pos"),
                                                       F.count(F.lit(1)).cast("bigint").alias("n_neg"))


def jo7_threshold_grid(spark, sf):
    """JO7: the 45 (lo <= hi) cells of a 9-value grid with class sizes under each cell.

    A cell's sizes depend on one threshold each: 18 conditional sums, one row, then the cells."""
    values = [i / 100 for i in range(1, 10)]
    sc = _scored(spark, sf).filter(F.col("y") == 0)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    sums = sc.agg(*[count(F.col("score") < v).alias(f"lo{k}") for k, v in enumerate(values)],
                  *[count(F.col("score") > v).alias(f"hi{k}") for k, v in enumerate(values)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"lo{i}").alias("n_neg"), F.col(f"hi{j}").alias("n_pseudo"))
                      for i, j, _, _ in R.threshold_cells(values)])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def jo8_score_features(spark, sf):
    sc = _scored(spark, sf).select("doc_id", "score")
    return R.score_features(sc, pu_docs(spark, sf).select("doc_id", "f2"), "doc_id").select(
        "doc_id", "f2", r6("score").alias("score"))


# --- SE ---------------------------------------------------------------------------

def se1_union_tables(spark, sf):
    d = pu_docs(spark, sf)
    a = d.filter(F.col("grp") == "en").select("doc_id", "f1", "f7")
    b = d.filter(F.col("grp") != "en").select("doc_id", "f1")
    return R.union_tables([a, b]).select("doc_id", "f1", r6("f7").alias("f7"))


def se2_build_training(spark, sf):
    d = pu_docs(spark, sf)
    p, u = R.split_pu(d)
    neg = S.sample_balanced(u, p, "doc_id", SEED)
    return R.build_training(p.select("doc_id", "y"), neg.select("doc_id", "y"))


def se3_augment_positives(spark, sf):
    d = _scored(spark, sf)
    p = d.filter(F.col("y") == 1).select("doc_id", "y")
    pseudo = R.pseudo_positives(d.filter(F.col("y") == 0), 0.03).select("doc_id", "y")
    return R.augment_positives(p, pseudo)


def se5_complement(spark, sf):
    d = pu_docs(spark, sf)
    inbag = S.sample_n(d.filter(F.col("y") == 0), 100, "doc_id", SEED, "bag0")
    return R.complement(d.filter(F.col("y") == 0), inbag, "doc_id").select("doc_id")


# --- AG ---------------------------------------------------------------------------

def ag1_class_means(spark, sf):
    m = nulls.class_means(pu_docs(spark, sf), F7)
    return m.select("y", *[r6(f"mean_{c}").alias(f"mean_{c}") for c in F7])


def ag2_group_counts(spark, sf):
    return S.group_counts(pu_docs(spark, sf).filter(F.col("y") == 1))


def ag3_class_counts(spark, sf):
    return R.class_counts(pu_lines(spark, sf))


def ag4_positive_count(spark, sf):
    return R.positive_count(pu_docs(spark, sf), parts=["grp"])


def ag6_class_domain(spark, sf):
    return R.class_domain(table(spark, sf, "embeddings").select(F.col("label").alias("cls")))


def ag15_result_matrix(spark, sf):
    """AG15: documents per (class, group) as a class x group matrix."""
    long = pu_docs(spark, sf).groupBy("y", "grp").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return R.result_matrix(long, "y", "grp", "n")


# --- SC ---------------------------------------------------------------------------

def sc1_fill_zero(spark, sf):
    return nulls.fill_zero(pu_docs(spark, sf), ["f7"]).select("doc_id", r6("f7").alias("f7"))


def sc2_fill_class_mean(spark, sf):
    return nulls.fill_class_mean(pu_docs(spark, sf), ["f7"]).select("doc_id", "y", r6("f7").alias("f7"))


def sc3_keep_null(spark, sf):
    d = nulls.keep_null(pu_docs(spark, sf), ["f7"])
    return d.groupBy("y").agg(F.sum(F.when(F.col("f7").isNull(), 1).otherwise(0)).cast("bigint").alias("n_null"))


def sc5_safe_ratio(spark, sf):
    return pu_docs(spark, sf).select("doc_id", r6(scalar.safe_ratio("f3", "f4")).alias("ratio"))


def sc6_log_proba(spark, sf):
    return _scored(spark, sf).select("doc_id", r6(scalar.log_proba("score")).alias("log_score"))


QUERIES = {
    "io1_read_features": io1_read_features, "io3_write_table": io3_write_table,
    "io4_write_scores": io4_write_scores, "io5_write_matrix": io5_write_matrix,
    "pr1_select_feature": pr1_select_feature, "pr2_feature_slice": pr2_feature_slice,
    "pr3_drop_columns": pr3_drop_columns, "pr5_feature_sets": pr5_feature_sets, "pr6_with_label": pr6_with_label,
    "pr9_to_vector": pr9_to_vector,
    "fi1_split_pu": fi1_split_pu, "fi2_reliable_negatives": fi2_reliable_negatives,
    "fi3_pseudo_positives": fi3_pseudo_positives, "fi4_class_filter": fi4_class_filter,
    "fi5_background_only": fi5_background_only,
    "jo1_anti_by_key": jo1_anti_by_key, "jo2_semi_by_key": jo2_semi_by_key, "jo5_pair_groups": jo5_pair_groups,
    "jo7_threshold_grid": jo7_threshold_grid, "jo8_score_features": jo8_score_features,
    "se1_union_tables": se1_union_tables, "se2_build_training": se2_build_training,
    "se3_augment_positives": se3_augment_positives, "se5_complement": se5_complement,
    "ag1_class_means": ag1_class_means, "ag2_group_counts": ag2_group_counts, "ag3_class_counts": ag3_class_counts,
    "ag4_positive_count": ag4_positive_count, "ag6_class_domain": ag6_class_domain,
    "ag15_result_matrix": ag15_result_matrix,
    "sc1_fill_zero": sc1_fill_zero, "sc2_fill_class_mean": sc2_fill_class_mean, "sc3_keep_null": sc3_keep_null,
    "sc5_safe_ratio": sc5_safe_ratio, "sc6_log_proba": sc6_log_proba,
}

# ---------------------------------------------------------------------------------- SQL

D = [Q.PU_DOCS]
SCORE = "f4 / nullif(f1, 0)"
SCORED = f"scored AS (SELECT doc_id, y, f1, {SCORE} AS score FROM pu_docs)"
LKT = Q.keytext(LK2)


def _w(body, extra=()):
    return with_sql(D + list(extra), body)


SQL = {
    "io1_read_features": "SELECT doc_id, n_chars, lang FROM documents",
    "io3_write_table": _w("SELECT doc_id, grp, y, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in F7) + " FROM pu_docs"),
    "io4_write_scores": _w(f"SELECT doc_id, {Q.r6(SCORE)} AS score FROM pu_docs"),
    "io5_write_matrix": _w(f"""SELECT grp, {Q.r6('avg(CASE WHEN y = 0 THEN f1 END)')} AS y0,
 {Q.r6('avg(CASE WHEN y = 1 THEN f1 END)')} AS y1 FROM pu_docs GROUP BY grp"""),
    "pr1_select_feature": _w("SELECT doc_id, f3, y FROM pu_docs"),
    "pr2_feature_slice": _w(f"SELECT f6, {Q.r6('f7')} AS f7 FROM pu_docs"),
    "pr3_drop_columns": _w("SELECT doc_id, grp, y, f1, f2, f3, f4, f5, f6 FROM pu_docs"),
    "pr5_feature_sets": _w(
        f"SELECT 'F1' AS variant, doc_id, {Q.r6('coalesce(f7, 0.0)')} AS fsum FROM pu_docs UNION ALL "
        f"SELECT 'F6', doc_id, {Q.r6(' + '.join(f'coalesce({c}, 0.0)' for c in FEATS))} FROM pu_docs UNION ALL "
        f"SELECT 'F7', doc_id, {Q.r6(' + '.join(f'coalesce({c}, 0.0)' for c in F7))} FROM pu_docs"),
    "pr6_with_label": _w("SELECT doc_id, 1 AS y FROM pu_docs WHERE y = 0"),
    "fi1_split_pu": _w("SELECT doc_id, CASE WHEN y = 1 THEN 'P' ELSE 'U' END AS part FROM pu_docs"),
    "fi2_reliable_negatives": _w("SELECT doc_id FROM scored WHERE score < 0.005", [SCORED]),
    "fi3_pseudo_positives": _w("SELECT doc_id FROM scored WHERE score > 0.03", [SCORED]),
    "fi4_class_filter": with_sql([Q.PU_LINES], "SELECT " + ", ".join(Q.LINES_KEY) + " FROM pu_lines WHERE y = 1"),
    "fi5_background_only": _w(f"SELECT doc_id, {Q.r6('score')} AS score FROM scored WHERE y = 0", [SCORED]),
    "jo1_anti_by_key": with_sql([Q.PU_LINES, f"""held AS (
  SELECT l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM pu_lines) k
  ORDER BY {Q.hk(SEED, 'held', LKT)}, l_orderkey, l_linenumber LIMIT 500)"""],
        "SELECT " + ", ".join(Q.LINES_KEY) + " FROM pu_lines l WHERE NOT EXISTS (SELECT 1 FROM held h "
        "WHERE h.l_orderkey = l.l_orderkey AND h.l_linenumber = l.l_linenumber)"),
    "jo2_semi_by_key": _w("SELECT doc_id, grp, y FROM pu_docs WHERE doc_id IN (SELECT doc_id FROM scored WHERE score > 0.03)",
                          [SCORED]),
    "jo5_pair_groups": _w("""SELECT p.grp, p.n AS n_pos, CAST(count(*) AS BIGINT) AS n_neg
FROM (SELECT grp, CAST(count(*) AS BIGINT) AS n FROM pu_docs WHERE y = 1 GROUP BY grp) p
JOIN pu_docs u ON u.grp = p.grp AND u.y < 1 GROUP BY p.grp, p.n"""),
    "jo8_score_features": _w(f"SELECT doc_id, f2, {Q.r6('score')} AS score FROM scored JOIN pu_docs USING (doc_id, y, f1)",
                             [SCORED]),
    "se1_union_tables": _w(f"SELECT doc_id, f1, {Q.r6('f7')} AS f7 FROM pu_docs WHERE grp = 'en' UNION ALL "
                           "SELECT doc_id, f1, NULL FROM pu_docs WHERE grp <> 'en'"),
    "se2_build_training": _w(f"""SELECT doc_id, y FROM pu_docs WHERE y = 1 UNION ALL
SELECT doc_id, y FROM (SELECT doc_id, y FROM pu_docs WHERE y < 1
  ORDER BY {Q.hk(SEED, 'balanced', Q.vc('doc_id'))}, doc_id
  LIMIT (SELECT count(*) FROM pu_docs WHERE y = 1))"""),
    "se3_augment_positives": _w("SELECT doc_id, y FROM pu_docs WHERE y = 1 UNION ALL "
                                "SELECT doc_id, 1 FROM scored WHERE y = 0 AND score > 0.03", [SCORED]),
    "se5_complement": _w(f"""SELECT doc_id FROM pu_docs WHERE y = 0 AND doc_id NOT IN (
  SELECT doc_id FROM pu_docs WHERE y = 0 ORDER BY {Q.hk(SEED, 'bag0', Q.vc('doc_id'))}, doc_id LIMIT 100)"""),
    "ag1_class_means": _w("SELECT y, " + ", ".join(f"{Q.r6(f'avg({c})')} AS mean_{c}" for c in F7)
                          + " FROM pu_docs GROUP BY y"),
    "ag2_group_counts": _w("SELECT grp, CAST(count(*) AS BIGINT) AS n FROM pu_docs WHERE y = 1 GROUP BY grp"),
    "ag3_class_counts": with_sql([Q.PU_LINES], "SELECT y, CAST(count(*) AS BIGINT) AS n FROM pu_lines GROUP BY y"),
    "ag4_positive_count": _w("SELECT grp, CAST(sum(y) AS BIGINT) AS n_pos FROM pu_docs GROUP BY grp"),
    "ag6_class_domain": "SELECT cls, CAST(row_number() OVER (ORDER BY cls) - 1 AS INTEGER) AS code "
                        "FROM (SELECT DISTINCT label AS cls FROM embeddings)",
    "ag15_result_matrix": _w("SELECT y, " + ", ".join(
        f"CAST(sum(CASE WHEN grp = '{g}' THEN 1 END) AS BIGINT) AS {g}" for g in ["de", "en", "es", "fr"])
        + " FROM pu_docs GROUP BY y"),
    "sc1_fill_zero": _w(f"SELECT doc_id, {Q.r6('coalesce(f7, 0.0)')} AS f7 FROM pu_docs"),
    "sc2_fill_class_mean": _w(f"SELECT doc_id, y, {Q.r6('coalesce(f7, avg(f7) OVER (PARTITION BY y))')} AS f7 FROM pu_docs"),
    "sc3_keep_null": _w("SELECT y, CAST(sum(CASE WHEN f7 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null "
                        "FROM pu_docs GROUP BY y"),
    "sc5_safe_ratio": _w(f"SELECT doc_id, {Q.r6('f3 / nullif(f4, 0)')} AS ratio FROM pu_docs"),
    "sc6_log_proba": _w(f"SELECT doc_id, {Q.r6('CASE WHEN score > 0 THEN ln(score) END')} AS log_score FROM scored",
                        [SCORED]),
}

# JO7: the grid is 9 x 9 thresholds with lo <= hi, written plainly
SQL["jo7_threshold_grid"] = _w("""SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j,
 CAST(sum(CASE WHEN s.score < (a.i + 1) / 100.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
 CAST(sum(CASE WHEN s.score > (b.i + 1) / 100.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pseudo
FROM range(0, 9) a(i) JOIN range(0, 9) b(i) ON a.i <= b.i, (SELECT * FROM scored WHERE y = 0) s
GROUP BY 1, 2""", [SCORED])

# PR9: the assembled vector (nulls kept as NaN) as an array of doubles
SQL["pr9_to_vector"] = _w("SELECT doc_id, [" + ", ".join(
    f"CASE WHEN {c} IS NULL THEN 'NaN'::DOUBLE ELSE {Q.r6(c)} END" for c in F7) + "] AS features FROM pu_docs")
