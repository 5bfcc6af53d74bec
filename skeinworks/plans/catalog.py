"""One query for each operator, over the spatial tables of :mod:`fixtures`, with the same in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import cohort as C
from ..operators import dataset as D
from ..operators import lines as L
from ..operators import metrics as M
from ..operators import profiles as P
from ..operators import regions as R
from ..operators import voxels as V
from . import fixtures as fx
from .fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
GRID = fx.GRID
I, C3 = ["subject", "bundle"], ["x", "y", "z"]
AFFINE = np.array([[-1.25, 0.0, 0.0, 90.0], [0.0, 1.25, 0.0, -126.0], [0.0, 0.1, 1.25, -72.0], [0.0, 0.0, 0.0, 1.0]])


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


def r6(c, name: str | None = None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def r6v(v, name: str):
    return F.transform(v, lambda x: F.round(x, 6) + F.lit(0.0)).alias(name)


# Sources, catalogue, sampling


#: A number as :func:`format_number` writes it; p of Student's t, in closed form for whole degrees of freedom.
FMT = r"CASE WHEN abs({x})>1e-5 THEN regexp_replace(printf('%.6f',CAST(round({x},6) AS DOUBLE)),'(\.\d+?)0*$','\1') ELSE printf('%.2e',CAST({x} AS DOUBLE)) END"
T2P = """CASE WHEN ({v})%2=0 THEN 1-abs({t})/sqrt({v}+{t}*{t})*list_sum(list_transform(range(0,CAST(({v})//2 AS BIGINT)), lambda k: exp(lgamma(k+0.5)-lgamma(k+1))/sqrt(pi())*pow(({v})/({v}+{t}*{t}),k)))
 ELSE 1-2/pi()*(atan(abs({t})/sqrt({v}))+CASE WHEN ({v})>1 THEN abs({t})/sqrt({v}+{t}*{t})*list_sum(list_transform(range(0,CAST((({v})-1)//2 AS BIGINT)), lambda k: exp(lgamma(k+1)-lgamma(k+1.5))*sqrt(pi())/2*pow(({v})/({v}+{t}*{t}),k+0.5))) ELSE 0 END) END"""


def own_folder(spark, name):
    import uuid

    from .stash import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql("SELECT CAST(subject AS VARCHAR) AS subject_id, CAST(grp AS DOUBLE) AS \"group\", CAST(age AS DOUBLE) AS age, CAST(sex AS DOUBLE) AS sex, 'mean' AS directive, 'group' AS mode FROM cohort", "cohort"))
def s1_read_cohort(spark, d):
    from ..sources.cohort_files import read_cohort

    path = own_folder(spark, "cohort")
    rows = fx.cohort(spark, d).select(F.concat_ws(" ", "subject", "grp", "age", "sex").alias("value"))
    head = spark.createDataFrame([("# value = mean",), ("subject_id group age sex",)], "value string")
    head.union(rows).write.text(path)
    table, directives, mode = read_cohort(spark, path)
    return table.select("*", F.lit(directives["value"]).alias("directive"), F.lit(mode).alias("mode"))


@query(sql("SELECT CAST(subject AS VARCHAR) AS subject, bundle, CAST(row_number() OVER (PARTITION BY subject,bundle ORDER BY position)-1 AS INT) AS position, round(mean,6) AS mean FROM (SELECT s.subject,s.position,b.bundle,p.mean FROM (SELECT DISTINCT subject,position FROM profiles) s CROSS JOIN (SELECT DISTINCT bundle FROM profiles) b LEFT JOIN profiles p ON p.subject=s.subject AND p.position=s.position AND p.bundle=b.bundle)", "profiles"))
def s2_read_profiles(spark, d):
    from ..sources.cohort_files import read_profiles, wide_profiles

    path = own_folder(spark, "wide")
    wide = wide_profiles(fx.profiles(spark, d), ["A", "N", "R"], by=("subject",)).repartition("subject").sortWithinPartitions("subject", "position").drop("position")
    wide.write.partitionBy("subject").csv(path, sep=";", header=True)
    long = read_profiles(spark, f"{path}/subject=*/*.csv", r"subject=([^/]*)/")
    # Missing cells of the wide table read back as null.
    return long.select("subject", "bundle", "position", r6("mean"))


@query(sql("SELECT subject, position, A, N, R FROM (SELECT * FROM (SELECT subject, position, bundle, round(mean,6) AS mean FROM profiles) PIVOT (first(mean) FOR bundle IN ('A','N','R') GROUP BY subject, position))", "profiles"))
def s3_wide_profiles(spark, d):
    from ..sources.cohort_files import wide_profiles

    return wide_profiles(rounded(fx.profiles(spark, d), "mean"), ["A", "N", "R"], by=("subject",))


@query(sql("SELECT CAST(row_number() OVER (ORDER BY vec_id)-1 AS INT) AS idx, CAST(1000*(vec_id%4) AS DOUBLE) AS bval, round(pred[1],5) AS gx, round(pred[2],5) AS gy, round(pred[3],5) AS gz FROM vectors", "vectors"))
def s4_ingest_gradients(spark, d):
    from ..sources.cohort_files import ingest_gradients

    path = own_folder(spark, "gradients")
    v = fx.vectors(spark, d)
    row = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", c.cast("double").alias("v")))), lambda s: F.format_string("%.15f", s["v"])), " ")
    v.agg(row(F.col("vec_id") % 4 * 1000).alias("value")).write.text(f"{path}/bvals")
    v.agg(F.array_join(F.array(*(row(F.col("pred")[k]) for k in range(3))), "\n").alias("value")).write.text(f"{path}/bvecs")
    out = ingest_gradients(spark, f"{path}/bvals", f"{path}/bvecs")
    return out.select("idx", "bval", *(F.round(c, 5).alias(c) for c in ("gx", "gy", "gz")))


@query(sql("SELECT bundle, " + FMT.format(x="avg(mean)") + " AS mean, " + FMT.format(x="(round(max(mean),3)*1e-6)") + " AS small, CAST(count(*) AS VARCHAR) AS n FROM profiles GROUP BY bundle", "profiles"))
def s9_write_results(spark, d):
    from ..sources.cohort_files import write_results

    path = own_folder(spark, "results")
    results = fx.profiles(spark, d).groupBy("bundle").agg(F.avg("mean").alias("mean"), (F.round(F.max("mean"), 3) * 1e-6).alias("small"), F.count("*").alias("n"))
    write_results(results, path)
    return spark.read.csv(path, header=True)


def catalog_rows():
    from ..sources.catalog import bundle_names

    own = set(bundle_names("profiles"))
    return [(n, i, n in own) for i, n in enumerate(["BG", *bundle_names("all")])]


@query("WITH c(bundle,idx,in_profiles) AS (VALUES " + ",".join(f"('{n}',{i},{str(p).lower()})" for n, i, p in catalog_rows()) + ") SELECT bundle, CAST(idx AS INT) AS idx, in_profiles, count(l_partkey) AS n FROM c LEFT JOIN lineitem ON l_partkey%73=idx GROUP BY ALL")
def s10_bundle_catalog(spark, d):
    from ..sources.catalog import bundle_catalog

    rows = fx.table(spark, d, "lineitem").select((F.col("l_partkey") % 73).cast("int").alias("idx"), "l_partkey")
    return bundle_catalog(spark).join(rows, "idx", "left").groupBy("bundle", "idx", "in_profiles").agg(F.count("l_partkey").alias("n"))


@query(sql("SELECT subject, bundle, x, y, z, value FROM voxels WHERE value<>0", "voxels"))
def s5_read_images(spark, d):
    from ..sources.formats import read_files, write_images

    path = own_folder(spark, "images")
    name = F.concat_ws("/", "subject", F.concat("bundle", F.when(F.col("bundle") == "N", ".nii.gz").otherwise(".nii")))
    write_images(fx.voxels(spark, d).withColumn("path", name).withColumn("channel", F.lit(0)), path, (*GRID, 1), AFFINE)
    back = read_files(spark, "nifti", path, range_bytes=200_000)
    return back.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("int").alias("subject"), F.substring(F.split_part("path", F.lit("/"), F.lit(2)), 1, 1).alias("bundle"), *C3, "value")


#: Whole lines, numbered within their file, by the points' number, ends and sums.
LINE_SUMS = """SELECT subject,bundle,CAST(row_number() OVER (PARTITION BY subject,bundle ORDER BY line_id) AS INT) AS nth,n_points,first_x,last_z,sum_y FROM (
 SELECT subject,bundle,line_id,count(*) AS n_points,arg_min({x},pos) AS first_x,arg_max({z},pos) AS last_z,round(sum({y}),3) AS sum_y FROM line_points GROUP BY ALL)"""


def line_sums(lines):
    """By file: what :data:`LINE_SUMS` has."""
    keys = [F.split_part("path", F.lit("/"), F.lit(1)).cast("int").alias("subject"), F.regexp_extract("path", r"/(.*)\.", 1).alias("bundle")]
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line_id")).alias("nth")
    ends = [F.element_at("points", 1)["x"].alias("first_x"), F.element_at("points", -1)["z"].alias("last_z")]
    return lines.select(*keys, nth, F.size("points").cast("long").alias("n_points"), *ends, F.round(L.total(F.col("points.y")), 3).alias("sum_y"))


@query(sql(LINE_SUMS.format(x="x", y="y", z="z"), "line_points"))
def s6_read_polylines(spark, d):
    from ..sources.formats import read_files, write_lines

    path = own_folder(spark, "tck")
    write_lines(fx.lines(spark, d).withColumn("path", F.format_string("%d/%s.tck", "subject", "bundle")), path, "tck", ["line_id"], datatype="Float64LE")
    return line_sums(read_files(spark, "tck", path, range_bytes=3000))


@query(sql(LINE_SUMS.format(x="CAST(CAST(x AS FLOAT) AS DOUBLE)", y="CAST(CAST(y AS FLOAT) AS DOUBLE)", z="CAST(CAST(z AS FLOAT) AS DOUBLE)"), "line_points"))
def s8_write_trk(spark, d):
    from ..sources.formats import read_files, write_lines

    path = own_folder(spark, "trk")
    write_lines(fx.lines(spark, d).withColumn("path", F.format_string("%d/%s.trk", "subject", "bundle")), path, "trk", ["line_id"], shape="50,50,50")
    return line_sums(read_files(spark, "trk", path))


@query(sql("SELECT bundle, count(*) AS n, round(sum(value),4) AS total FROM voxels GROUP BY 1", "voxels"))
def s7_write_by_bundle(spark, d):
    from ..sources.images import write_by_bundle

    path = own_folder(spark, "bundles")
    write_by_bundle(fx.voxels(spark, d), path)
    return spark.read.parquet(path).groupBy("bundle").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(sql("SELECT subject, bundle, count(DISTINCT line_id) AS n_lines, count(*) AS n_points FROM line_points GROUP BY ALL", "line_points"))
def s8_write_polylines(spark, d):
    import uuid

    from ..sources.images import write_polylines
    from .stash import shared_dir

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = fx.lines(spark, d)
    write_polylines(lines, path)
    back = spark.read.schema(lines.schema).parquet(path)
    return back.groupBy("subject", "bundle").agg(F.count("*").alias("n_lines"), F.sum(F.size("points")).alias("n_points"))


HASH = "CAST(('0x' || substr(md5({}),1,12))::BIGINT AS DOUBLE)/281474976710656"


@query("SELECT s_suppkey AS subject, CASE WHEN u < 0.33 THEN 'a' WHEN u < 0.66 THEN 'b' ELSE 'c' END AS variant FROM (SELECT s_suppkey, " + HASH.format("'5:' || s_suppkey") + " AS u FROM supplier)")
def s11_choose_variant(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"))
    return D.choose_variant(s, {"a": 0.33, "b": 0.33, "c": 0.34}, 5)


@query(sql("SELECT CAST(0 AS INT) AS subject, CAST(9-x AS INT) AS x, y, z, round(-pred[1]*abs(cand[7])+0.0,6) AS vx, round(pred[2]*abs(cand[7])+0.0,6) AS vy, round(-cand[1]*abs(cand[8])+0.0,6) AS wx FROM vectors", "vectors"))
def s12_load_dyads(spark, d):
    v = fx.vectors(spark, d).withColumn("subject", F.lit(0))
    on = ["subject", *C3]
    d1, d2 = v.select(*on, F.col("pred").alias("v")), v.select(*on, F.slice("cand", 1, 3).alias("v"))
    f1, f2 = v.select(*on, F.abs(F.col("cand")[6]).alias("value")), v.select(*on, F.abs(F.col("cand")[7]).alias("value"))
    out = D.load_dyads(d1, d2, None, [f1, f2], (10, 10, 5))
    return out.select(*on, r6(F.col("v")[0], "vx"), r6(F.col("v")[1], "vy"), r6(F.col("v")[3], "wx"))


@query("SELECT o_custkey AS subject, o_orderpriority AS file FROM orders WHERE o_orderstatus='O' GROUP BY ALL EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus='F'")
def s13_check_completeness(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("file"), "o_orderstatus")
    return D.check_completeness(o.where("o_orderstatus = 'O'").drop("o_orderstatus").distinct(), o.where("o_orderstatus = 'F'"))


# Values and predicates


@query(sql("SELECT subject,bundle,x,y,z, CAST(value>=0.5 AS INT) AS value FROM voxels", "voxels"))
def p1_binarize(spark, d):
    return V.binarize(fx.voxels(spark, d), 0.5)


@query(sql("SELECT subject,bundle,x,y,z, CAST(value >= CASE bundle WHEN 'A' THEN 0.3 WHEN 'N' THEN 0.4 ELSE 0.5 END AS INT) AS value FROM voxels", "voxels"))
def p2_binarize_by_bundle(spark, d):
    return V.binarize_by_bundle(fx.voxels(spark, d), {"A": 0.3, "N": 0.4})


@query(sql("SELECT subject,bundle,x,y,z, CASE WHEN value<0.4 THEN 0.0 ELSE value END AS value FROM voxels", "voxels"))
def p3_zero_below(spark, d):
    return V.zero_below(fx.voxels(spark, d), 0.4)


@query(sql("SELECT subject,bundle,x,y,z, round(greatest(value-0.5,0),6) AS value FROM voxels", "voxels"))
def p4_clip_negative(spark, d):
    return rounded(V.clip_negative(fx.voxels(spark, d).withColumn("value", F.col("value") - 0.5)), "value")


@query(sql("SELECT subject,bundle,x,y,z, CASE WHEN x%7=0 THEN 0.0 WHEN x%7=1 THEN 0.0 ELSE value END AS value FROM voxels", "voxels"))
def p5_fill_nan(spark, d):
    v = fx.voxels(spark, d)
    return V.fill_nan(v.withColumn("value", F.when(F.col("x") % 7 == 0, F.lit(float("nan"))).when(F.col("x") % 7 == 1, F.lit(None)).otherwise(F.col("value"))))


@query(sql("SELECT v.* FROM voxels v SEMI JOIN (SELECT DISTINCT x,y,z FROM voxels WHERE value>=0.9) m USING (x,y,z)", "voxels"))
def p6_apply_mask(spark, d):
    v = fx.voxels(spark, d)
    return V.apply_mask(v, v, 0.9, C3).select(*I, *C3, "value")


@query(sql("SELECT * FROM voxels WHERE bundle IN ('A','R')", "voxels"))
def p7_select_bundles(spark, d):
    return V.select_bundles(fx.voxels(spark, d), "A, R", ["A", "N", "R"])


N3 = "sqrt({0}[1]*{0}[1]+{0}[2]*{0}[2]+{0}[3]*{0}[3])"


@query(sql(f"SELECT vec_id, CAST({N3.format('pred')} > 0.1 AS INT) AS value FROM vectors", "vectors"))
def p8_mask_from_vectors(spark, d):
    return V.mask_from_vectors(fx.vectors(spark, d).select("vec_id", "pred"), 0.1, "pred")


@query(sql(f"SELECT vec_id, CASE WHEN {N3.format('pred')} > CASE bundle WHEN 0 THEN 0.3 ELSE 0.2 END THEN round(pred[1],6) ELSE 0 END AS vx FROM vectors", "vectors"))
def p9_drop_small_vectors(spark, d):
    out = V.drop_small_vectors(fx.vectors(spark, d), 0.2, {0: 0.3}, "pred")
    return out.select("vec_id", r6(F.col("pred")[0], "vx"))


CROSS = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(a,b,c)"
INSIDE = "x+a BETWEEN 0 AND 49 AND y+b BETWEEN 0 AND 49 AND z+c BETWEEN 0 AND 49"


@query(sql(f"SELECT DISTINCT subject, CAST(x+a AS INT) AS x, CAST(y+b AS INT) AS y, CAST(z+c AS INT) AS z FROM (SELECT subject,x,y,z FROM voxels GROUP BY ALL HAVING max(value)>0.9), {CROSS} WHERE {INSIDE}", "voxels"))
def p10_brain_mask(spark, d):
    return V.brain_mask_simple(fx.voxels(spark, d), GRID, 0.9)


@query(sql("SELECT subject,bundle,CAST(x-10 AS INT) AS x,y,CAST(z-25 AS INT) AS z,value FROM voxels WHERE x>=10 AND z>=25", "voxels"))
def p11_enforce_shape(spark, d):
    return V.enforce_shape(fx.voxels(spark, d), GRID, (40, 60, 25))


@query(sql("SELECT subject,x,y,z, CAST(max(CASE bundle WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS INT) AS label FROM voxels WHERE value>0 GROUP BY ALL", "voxels"))
def p12_label_map(spark, d):
    return V.to_label_map(fx.voxels(spark, d), ["A", "N", "R"])


@query(sql("SELECT subject, count(*) AS n_rows, count(*) FILTER (bundle='BG') AS background FROM (SELECT subject,bundle FROM voxels UNION ALL SELECT s.subject,'BG' FROM (SELECT DISTINCT subject FROM voxels) s, range(50) a(x), range(50) b(y), range(50) c(z) WHERE NOT EXISTS (SELECT 1 FROM voxels v WHERE v.subject=s.subject AND v.x=a.x AND v.y=b.y AND v.z=c.z AND v.value>0)) GROUP BY 1", "voxels"))
def p13_add_background(spark, d):
    out = V.add_background(fx.voxels(spark, d), GRID)
    return out.groupBy("subject").agg(F.count("*").alias("n_rows"), F.sum((F.col("bundle") == "BG").cast("long")).alias("background"))


@query(sql("SELECT v.* FROM voxels v JOIN (SELECT subject, CAST(floor((min(x)+max(x))/2) AS INT) AS mx FROM voxels WHERE value<>0 GROUP BY 1) m ON v.subject=m.subject AND v.x=m.mx", "voxels"))
def p14_middle_slice(spark, d):
    return V.middle_slice(fx.voxels(spark, d), "x").select(*I, *C3, "value")


# Joins


TWO = "a AS (SELECT subject,x,y,z,value FROM voxels WHERE bundle='A'), b AS (SELECT subject,x,y,z,value FROM voxels WHERE bundle='N')"
SC = ["subject", *C3]


def two(spark, d):
    v = fx.voxels(spark, d)
    return v.where("bundle = 'A'").select(*SC, "value"), v.where("bundle = 'N'").select(*SC, "value")


@query(sql(f"+{TWO} SELECT subject,x,y,z,coalesce(a.value,0) AS value_a, coalesce(b.value,0) AS value_b FROM a FULL OUTER JOIN b USING (subject,x,y,z)", "voxels"))
def j1_join_voxels(spark, d):
    return V.join_voxels(*two(spark, d), "full_outer", SC)


@query(sql(f"+{TWO} SELECT subject,x,y,z,value,'in' AS side FROM a SEMI JOIN b USING (subject,x,y,z) UNION ALL SELECT subject,x,y,z,value,'out' FROM a ANTI JOIN b USING (subject,x,y,z)", "voxels"))
def j2_semi_anti(spark, d):
    a, b = two(spark, d)
    return V.mask_semi(a, b, SC).withColumn("side", F.lit("in")).unionByName(V.mask_anti(a, b, SC).withColumn("side", F.lit("out")))


POINTS3 = "image AS (SELECT x,y,z,max(value) AS value FROM voxels GROUP BY ALL)"


def image3(spark, d):
    return fx.voxels(spark, d).groupBy(*C3).agg(F.max("value").alias("value"))


@query(sql(f"+{POINTS3} SELECT p.subject,p.bundle,line_id,pos,coalesce(value,0) AS value FROM line_points p LEFT JOIN image i ON i.x=CAST(trunc(p.x) AS INT) AND i.y=CAST(trunc(p.y) AS INT) AND i.z=CAST(trunc(p.z) AS INT)", "voxels", "line_points"))
def j3_lookup_voxel(spark, d):
    one = image3(spark, d).withColumn("all_", F.lit(1))
    return L.lookup_voxel(fx.line_points(spark, d).withColumn("all_", F.lit(1)), one, ["all_"]).select("subject", "bundle", "line_id", "pos", "value")


@query(sql(f"""+{POINTS3}, corners AS (SELECT p.*, i, j, k, floor(x)+i AS cx, floor(y)+j AS cy, floor(z)+k AS cz,
 (CASE i WHEN 1 THEN x-floor(x) ELSE 1-(x-floor(x)) END)*(CASE j WHEN 1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE k WHEN 1 THEN z-floor(z) ELSE 1-(z-floor(z)) END) AS w
 FROM line_points p, range(2) a(i), range(2) b(j), range(2) c(k) WHERE x BETWEEN 0 AND 49 AND y BETWEEN 0 AND 49 AND z BETWEEN 0 AND 49),
 got AS (SELECT c.subject,c.bundle,line_id,pos,sum(w*value) AS s FROM corners c JOIN image m ON m.x=cx AND m.y=cy AND m.z=cz WHERE w>0 GROUP BY ALL)
 SELECT p.subject,p.bundle,p.line_id,p.pos,round(coalesce(s,0),6) AS sample FROM line_points p LEFT JOIN got USING (subject,bundle,line_id,pos)""", "voxels", "line_points"))
def j4_trilinear(spark, d):
    return _sampled(spark, d).select("subject", "bundle", "line_id", "pos", r6("sample"))


def _sampled(spark, d):
    one = image3(spark, d).withColumn("all_", F.lit(1))
    return L.sample_trilinear(fx.line_points(spark, d).withColumn("all_", F.lit(1)), one, GRID, ["all_"]).drop("all_")


CORE = "core AS (SELECT subject,bundle,pos,avg(x) AS x,avg(y) AS y,avg(z) AS z FROM line_points WHERE pos<5 GROUP BY ALL)"


@query(sql(f"+{CORE} SELECT p.subject,p.bundle,line_id,p.pos,CAST(arg_min(c.pos, ROW((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z), c.pos)) AS INT) AS segment FROM line_points p JOIN core c USING (subject,bundle) GROUP BY ALL", "line_points"))
def j5_nearest_point(spark, d):
    p = fx.line_points(spark, d)
    core = p.where("pos < 5").groupBy(*I, "pos").agg(*(F.avg(c).alias(c) for c in C3))
    return L.nearest_point(p, core).select(*L.LINE, "pos", "segment")


@query(sql("SELECT subject,bundle,line_id,CAST(arg_min(pos, ROW((x-t.a)*(x-t.a)+(y-t.b)*(y-t.b)+(z-t.c)*(z-t.c),pos)) AS INT) AS middle FROM line_points JOIN (SELECT subject,bundle,avg(x) AS a,avg(y) AS b,avg(z) AS c FROM line_points GROUP BY ALL) t USING (subject,bundle) GROUP BY ALL", "line_points"))
def j6_closest_to_target(spark, d):
    p = fx.line_points(spark, d)
    return L.closest_to_target(p, p.groupBy(*I).agg(*(F.avg(c).alias(c) for c in C3)))


def cos_sql(a: list[str], b: list[str]) -> str:
    dot = "+".join(f"{x}*{y}" for x, y in zip(a, b, strict=True))
    norm = lambda v: "sqrt(" + "+".join(f"{x}*{x}" for x in v) + ")"
    return f"(({dot})/({norm(a)}*{norm(b)}+1e-7))"


def el(v: str, off: int = 0) -> list[str]:
    return [f"{v}[{off + k}]" for k in (1, 2, 3)]


@query(sql("+s AS (SELECT *, " + ", ".join(f"abs{cos_sql(el('pred'), el('cand', 3 * k))} AS c{k}" for k in range(3)) + f", {N3.format('pred')} AS n FROM vectors), t AS (SELECT *, CASE WHEN c0>=c1 AND c0>=c2 THEN 0 WHEN c1>=c2 THEN 3 ELSE 6 END AS o FROM s) SELECT vec_id, CASE WHEN n<0.1 THEN 0 ELSE round(cand[o+1],6) END AS bx, CASE WHEN n<0.1 THEN 0 ELSE round(cand[o+3],6) END AS bz FROM t", "vectors"))
def j7_best_match(spark, d):
    out = P.best_match_vector(fx.vectors(spark, d), 0.1)
    return out.select("vec_id", r6(F.col("best")[0], "bx"), r6(F.col("best")[2], "bz"))


@query(sql("+p AS (SELECT subject,bundle,line_id AS k,x,y,z FROM line_points WHERE pos=0) SELECT a.subject,a.bundle,a.k AS a,b.k AS b,round(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2),6) AS distance FROM p a JOIN p b ON a.subject=b.subject AND a.bundle=b.bundle AND a.k<b.k WHERE (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2<=64", "line_points"))
def j8_within_eps(spark, d):
    return L.within_eps(fx.line_starts(spark, d).withColumnRenamed("line_id", "k"), 8.0, "k", I, digits=6)


# Aggregations


@query(sql("SELECT bundle,x,y,z, CAST(sum(prob)/3 >= 0.5 AS INT) AS value FROM predictions WHERE direction<=3 GROUP BY ALL", "predictions"))
def a1_mean_fusion(spark, d):
    return D.mean_fusion(fx.predictions(spark, d).where("direction <= 3"), by=["bundle", *C3])


@query(sql("SELECT bundle,x,y,z, CAST(sum(CAST(prob>=0.5 AS INT))>=2 AS INT) AS value FROM predictions WHERE direction<=3 GROUP BY ALL", "predictions"))
def a2_majority_fusion(spark, d):
    return D.majority_fusion(fx.predictions(spark, d).where("direction <= 3"), by=["bundle", *C3])


@query(sql("+w AS (SELECT vec_id, unnest([pred,cand[1:3],cand[4:6]]) AS v FROM vectors), t AS (SELECT vec_id, avg(v[1]*v[1]) AS a,avg(v[1]*v[2]) AS d,avg(v[1]*v[3]) AS e,avg(v[2]*v[2]) AS b,avg(v[2]*v[3]) AS f,avg(v[3]*v[3]) AS c FROM w GROUP BY 1), q AS (SELECT *, (a+b+c)/3 AS q FROM t), p AS (SELECT *, sqrt(((a-q)**2+(b-q)**2+(c-q)**2+2*(d*d+e*e+f*f))/6) AS p FROM q), r AS (SELECT *, ((a-q)*((b-q)*(c-q)-f*f)-d*(d*(c-q)-f*e)+e*(d*f-(b-q)*e))/(2*p*p*p) AS r FROM p) SELECT vec_id, round(sqrt(q+2*p*cos(acos(greatest(-1,least(1,r)))/3)),6) AS length FROM r", "vectors"))
def a3_mean_fusion_vectors(spark, d):
    v = fx.vectors(spark, d).select("vec_id", F.explode(F.array("pred", F.slice("cand", 1, 3), F.slice("cand", 4, 3))).alias("v"))
    out = D.mean_fusion_vectors(v, ["vec_id"])
    return out.select("vec_id", F.round(X.vec_norm("v"), 6).alias("length"))


@query(sql("SELECT bundle,x,y,z, round(stddev_pop(prob),6) AS value FROM predictions GROUP BY ALL", "predictions"))
def a4_uncertainty(spark, d):
    return rounded(D.uncertainty(fx.predictions(spark, d), ["bundle", *C3]), "value")


@query(sql("SELECT subject, min(x) AS x_lo, max(x)+1 AS x_hi, min(y) AS y_lo, max(y)+1 AS y_hi, min(z) AS z_lo, max(z)+1 AS z_hi FROM voxels WHERE value<>0 GROUP BY 1", "voxels"))
def a5_bbox(spark, d):
    return V.bbox(fx.voxels(spark, d))


@query(sql("SELECT subject,bundle,x,y,greatest(max(value),0) AS value FROM voxels GROUP BY ALL", "voxels"))
def a6_project_mip(spark, d):
    return V.project_mip(fx.voxels(spark, d), "z")


@query(sql("SELECT v.subject,v.bundle,x,y,z,round(CASE WHEN h>l THEN (value-l)/(h-l) ELSE 0 END,6) AS value FROM voxels v JOIN (SELECT subject,min(value) AS l,max(value) AS h FROM voxels GROUP BY 1) USING (subject)", "voxels"))
def a7_scale_to_range(spark, d):
    return rounded(V.scale_to_range(fx.voxels(spark, d), 0, 1, ["subject"]), "value")


@query(sql("+s AS (SELECT subject,bundle,sum(value)/125000 AS m,sum(value*value)/125000 AS q FROM voxels GROUP BY ALL) SELECT v.subject,v.bundle,x,y,z,round((value-m)/(sqrt(q-m*m)+1e-5),5) AS value FROM voxels v JOIN s USING (subject,bundle)", "voxels"))
def a8_zscore(spark, d):
    out = V.zscore(fx.voxels(spark, d), 125000, I, 1e-5)
    return out.withColumn("value", F.round("value", 5))


@query(sql("SELECT CAST(floor(value*10) AS INT) AS label, count(*) AS n FROM voxels GROUP BY ALL", "voxels"))
def a9_label_histogram(spark, d):
    return V.label_histogram(fx.voxels(spark, d).withColumn("label", F.floor(F.col("value") * 10).cast("int")))


GAPS = """g AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM line_points WINDOW w AS (PARTITION BY subject,bundle,line_id ORDER BY pos)),
 d AS (SELECT *, sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)+(z2-z)*(z2-z)) AS gap FROM g)"""
FINE = GAPS + """, f AS (SELECT subject,bundle,line_id,x+(x2-x)*j/k AS x,y+(y2-y)*j/k AS y,z+(z2-z)*j/k AS z FROM {parts} UNION ALL SELECT subject,bundle,line_id,x,y,z FROM d WHERE x2 IS NULL)"""
PARTED = "(SELECT *, CAST(greatest(ceil(gap/{step}),1) AS INT) AS k FROM d WHERE x2 IS NOT NULL)"


@query(sql("+" + FINE.format(parts=PARTED.format(step="1.0") + ", range(0,4000) r(j) WHERE j<k") + " SELECT subject,bundle,CAST(trunc(x) AS INT) AS x,CAST(trunc(y) AS INT) AS y,CAST(trunc(z) AS INT) AS z,count(DISTINCT line_id) AS n FROM f GROUP BY ALL", "line_points"))
def a10_density_map(spark, d):
    return L.density_map(fx.lines(spark, d), 1.0)


@query(sql("+" + FINE.format(parts="(SELECT *, unnest(range(k)) AS j FROM " + PARTED.format(step="2.0") + ")") + " SELECT DISTINCT subject,bundle,CAST(trunc(x) AS INT) AS x,CAST(trunc(y) AS INT) AS y,CAST(trunc(z) AS INT) AS z FROM f", "line_points"))
def a11_binary_map(spark, d):
    return L.binary_map(fx.lines(spark, d), 2.0)


@query(sql("+" + GAPS + ", l AS (SELECT subject,bundle,line_id,coalesce(sum(gap),0) AS len,count(gap) AS n,max(gap) AS m FROM d GROUP BY ALL) SELECT subject,bundle,count(*) AS n_lines,round(avg(len),6) AS mean_length,round(sum(len)/sum(n),6) AS mean_gap,round(max(m),6) AS max_gap FROM l GROUP BY ALL", "line_points"))
def a12_line_statistics(spark, d):
    return rounded(L.line_statistics(fx.lines(spark, d)), "mean_length", "mean_gap", "max_gap")


@query(sql("SELECT grp, count(*) AS n FROM cohort GROUP BY 1", "cohort"))
def a13_cohort_summary(spark, d):
    return fx.cohort(spark, d).groupBy("grp").agg(F.count("*").alias("n"))


# Ordered operators


@query(sql(f"SELECT vec_id, round({N3.format('pred')},6) AS amplitude, round(pred[1]/({N3.format('pred')}+1e-20),6) AS dx, row_number() OVER (PARTITION BY bundle ORDER BY x,y,z)-1 AS idx FROM vectors WHERE {N3.format('pred')}>0", "vectors"))
def w1_dense_index(spark, d):
    out = V.dense_index(fx.vectors(spark, d), "pred", ["bundle"])
    return out.select("vec_id", r6("amplitude"), r6(F.col("direction")[0], "dx"), F.col("idx").cast("long").alias("idx"))


@query(sql("SELECT subject,bundle,CAST(x-o AS INT) AS x,y,z,value,CAST(o AS INT) AS \"offset\" FROM voxels, range(-1,2) r(o) WHERE x-o BETWEEN 0 AND 49", "voxels"))
def w2_slice_window(spark, d):
    return V.slice_window(fx.voxels(spark, d), "x", 3, 50)


PV = "pv AS (SELECT bundle, subject, position, abs(mean-0.05)*50 AS p FROM profiles)"
ISLANDS = "isl AS (SELECT *, position-row_number() OVER (PARTITION BY bundle,subject ORDER BY position) AS g FROM pv WHERE p {op} 0.1), runs AS (SELECT bundle,subject,g,count(*) AS n FROM isl GROUP BY ALL)"


def p_values(spark, d):
    return fx.profiles(spark, d).select("bundle", "subject", "position", (F.abs(F.col("mean") - 0.05) * 50).alias("p"))


@query(sql("+" + PV + ", " + ISLANDS.format(op="<=") + " SELECT pv.bundle,pv.subject,pv.position,CAST(coalesce(r.n>=3,false) AS INT) AS significant FROM pv LEFT JOIN isl ON isl.bundle=pv.bundle AND isl.subject=pv.subject AND isl.position=pv.position LEFT JOIN runs r ON r.bundle=isl.bundle AND r.subject=isl.subject AND r.g=isl.g", "profiles"))
def w3_significant_areas(spark, d):
    return C.significant_areas(p_values(spark, d), 3, 0.1, ["bundle", "subject"]).select("bundle", "subject", "position", "significant")


@query(sql("+" + PV + ", " + ISLANDS.format(op="<") + " SELECT bundle,subject,coalesce(max(n)+1,1) AS max_run FROM (SELECT DISTINCT bundle,subject FROM pv) LEFT JOIN runs USING (bundle,subject) GROUP BY ALL", "profiles"))
def w4_max_run(spark, d):
    return C.max_run(p_values(spark, d), 0.1, ["bundle", "subject"])


@query(sql("+t AS (SELECT subject,bundle,avg(x) AS a,avg(y) AS b,avg(z) AS c FROM line_points GROUP BY ALL), m AS (SELECT subject,bundle,line_id,arg_min(pos, ROW((x-a)*(x-a)+(y-b)*(y-b)+(z-c)*(z-c),pos)) AS mid FROM line_points JOIN t USING (subject,bundle) GROUP BY ALL) SELECT subject,bundle,line_id,pos,CAST(pos-mid+1000 AS INT) AS segment FROM line_points JOIN m USING (subject,bundle,line_id) WHERE pos-mid BETWEEN -3 AND 2", "line_points"))
def w5_segment_index(spark, d):
    p = fx.line_points(spark, d)
    return P.segment_index_from_middle(p, p.groupBy(*I).agg(*(F.avg(c).alias(c) for c in C3)), 6).select(*L.LINE, "pos", "segment")


@query(sql("+b AS (SELECT subject,bundle,min(position) AS lo,max(position) AS hi FROM profiles GROUP BY ALL) SELECT subject,bundle,CAST(position+1 AS INT) AS position,round(mean,6) AS mean FROM profiles UNION ALL SELECT p.subject,p.bundle,p.position,round(mean,6) FROM profiles p JOIN b ON p.subject=b.subject AND p.bundle=b.bundle AND position=lo UNION ALL SELECT p.subject,p.bundle,CAST(p.position+2 AS INT),round(mean,6) FROM profiles p JOIN b ON p.subject=b.subject AND p.bundle=b.bundle AND position=hi", "profiles"))
def w6_pad_profile_ends(spark, d):
    return P.pad_profile_ends(rounded(fx.profiles(spark, d), "mean").select(*I, "position", "mean"), I)


@query(sql("+b AS (SELECT subject,bundle,min(mean) AS lo,max(mean) AS hi FROM profiles GROUP BY ALL) SELECT p.subject,p.bundle,position,CAST(floor(CASE WHEN hi>lo THEN round((mean-lo)/(hi-lo)*99,9) ELSE mean*99 END) AS INT) AS bin FROM profiles p JOIN b USING (subject,bundle)", "profiles"))
def w7_profile_to_bins(spark, d):
    return P.profile_to_bins(fx.profiles(spark, d), I).select(*I, "position", "bin")


# Sampling and ranks


@query(sql("+r AS (SELECT *, dense_rank() OVER (PARTITION BY subject,bundle ORDER BY line_id) AS r FROM line_points) SELECT subject,bundle,line_id,count(*) AS n_points FROM r WHERE r<=4 GROUP BY ALL", "line_points"))
def o1_limit_lines(spark, d):
    return L.limit_lines(fx.lines(spark, d), 4).select(*L.LINE, F.size("points").cast("long").alias("n_points"))


@query(sql("+r AS (SELECT *, dense_rank() OVER (PARTITION BY subject,bundle ORDER BY line_id) AS r FROM line_points) SELECT subject,bundle,line_id,count(*) AS n_points FROM r WHERE (r-1)%3=0 GROUP BY ALL", "line_points"))
def o2_every_nth(spark, d):
    return L.every_nth(fx.lines(spark, d), 3).select(*L.LINE, F.size("points").cast("long").alias("n_points"))


@query(sql("+c AS (SELECT subject,x AS label,count(*) AS n FROM voxels GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY n DESC,label) AS INT) AS rank FROM c) SELECT * FROM r WHERE rank<=2", "voxels"))
def o3_two_biggest(spark, d):
    return L.two_biggest_clusters(fx.voxels(spark, d).withColumnRenamed("x", "label"), "label", ["subject"]).select("subject", "label", "n", "rank")


@query(sql("+r AS (SELECT subject,bundle,x,y,z,row_number() OVER (PARTITION BY subject,bundle ORDER BY x,y,z)-1 AS rank FROM mask), n AS (SELECT subject,bundle,count(*) AS n FROM mask GROUP BY ALL), q AS (SELECT subject,bundle,CAST(i AS INT) AS draw,CAST(floor(" + HASH.format("'7:' || subject || ':' || bundle || ':' || i") + "*n) AS INT) AS rank FROM n, range(20) t(i)) SELECT subject,bundle,draw,x,y,z FROM q JOIN r USING (subject,bundle,rank)", "mask"))
def o4_with_replacement(spark, d):
    return D.sample_with_replacement(fx.mask(spark, d), 20, 7, I)


@query(sql("SELECT subject,bundle,x,y,z FROM (SELECT *, row_number() OVER (PARTITION BY subject,bundle ORDER BY md5('9:' || x || ':' || y || ':' || z),x,y,z) AS r FROM mask) WHERE r<=30", "mask"))
def o5_without_replacement(spark, d):
    return D.sample_without_replacement(fx.mask(spark, d), 30, 9, I, C3)


@query(sql("SELECT subject,bundle,round(quantile_cont(value,0.02),6) AS low,round(quantile_cont(value,0.98),6) AS high FROM voxels GROUP BY ALL", "voxels"))
def o6_quantile_band(spark, d):
    return rounded(D.quantile_band(fx.voxels(spark, d), I), "low", "high")


@query(sql("+e AS (SELECT run,epoch,avg(value) AS mean FROM metrics_log WHERE metric='click' AND split='validate' GROUP BY ALL) SELECT run,CAST(arg_min(epoch,ROW(-mean,epoch)) AS INT) AS epoch,round(max(mean),6) AS best FROM e GROUP BY run", "metrics_log"))
def o7_best_epoch(spark, d):
    return rounded(M.best_epoch(fx.metrics_log(spark, d), "click"), "best")


# Sets


@query(sql("SELECT vec_id,CAST(0 AS INT) AS channel,round(pred[1],6) AS vx FROM vectors UNION ALL SELECT vec_id,CAST(1+k AS INT),round(cand[3*k+1],6) FROM vectors, range(3) r(k)", "vectors"))
def u1_stack_channels(spark, d):
    v = fx.vectors(spark, d)
    a = v.select("vec_id", F.lit(0).alias("channel"), r6(F.col("pred")[0], "vx"))
    b = v.select("vec_id", F.posexplode(F.array(*(F.round(F.col("cand")[3 * k], 6) for k in range(3)))).alias("channel", "vx"))
    return V.stack_channels([(a, 1), (b, 3)])


@query(sql(f"+{TWO}, p AS (SELECT subject,x,y,z FROM a), q AS (SELECT subject,x,y,z FROM b) SELECT 'or' AS op,* FROM (SELECT * FROM p UNION SELECT * FROM q) UNION ALL SELECT 'and',* FROM (SELECT * FROM p INTERSECT SELECT * FROM q) UNION ALL SELECT 'minus',* FROM (SELECT * FROM p EXCEPT SELECT * FROM q)", "voxels"))
def u2_mask_sets(spark, d):
    a, b = (t.select(*SC) for t in two(spark, d))
    out = [(n, f(a, b)) for n, f in (("or", V.mask_union), ("and", V.mask_intersect), ("minus", V.mask_difference))]
    frames = [t.select(F.lit(n).alias("op"), *SC) for n, t in out]
    return frames[0].union(frames[1]).union(frames[2])


@query(sql("+r AS (SELECT subject,CAST(least((row_number() OVER (ORDER BY subject)-1)//8,4) AS INT) AS fold FROM cohort) SELECT subject,fold,CASE (fold+4)%5 WHEN 3 THEN 'validate' WHEN 4 THEN 'test' ELSE 'train' END AS part FROM r", "cohort"))
def u3_fold_split(spark, d):
    return D.fold_split(fx.cohort(spark, d), 8, turn=1)


# Functions on vectors


@query(sql(f"SELECT vec_id, round({N3.format('pred')},6) AS n FROM vectors", "vectors"))
def f1_vec_norm(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6(X.vec_norm("pred"), "n"))


@query(sql(f"SELECT vec_id, round({cos_sql(el('pred'), el('cand'))},6) AS c FROM vectors", "vectors"))
def f2_vec_cos(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6(X.vec_cos("pred", F.slice("cand", 1, 3)), "c"))


@query(sql(f"SELECT vec_id, [round(pred[1]/({N3.format('pred')}+1e-20),6),round(pred[2]/({N3.format('pred')}+1e-20),6),round(pred[3]/({N3.format('pred')}+1e-20),6)] AS u FROM vectors", "vectors"))
def f3_unit(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.unit("pred"), "u"))


@query(sql("SELECT vec_id, [" + ",".join(f"round({'-' if k % 3 == 1 else ''}cand[{k + 1}],6)+0.0" for k in range(9)) + "] AS v FROM vectors", "vectors"))
def f4_flip_component(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.flip_component("cand", 1), "v"))


@query(sql("+s AS (SELECT *, CASE WHEN " + "+".join(f"{a}*{b}" for a, b in zip(el("pred"), el("cand"), strict=True)) + "<0 THEN -1.0 ELSE 1.0 END AS g FROM vectors) SELECT vec_id, [" + ",".join(f"round(0.7*pred[{k}]+0.3*g*cand[{k}],6)+0.0" for k in (1, 2, 3)) + "] AS v FROM s", "vectors"))
def f5_weighted_mean(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.weighted_mean_vectors("pred", F.slice("cand", 1, 3), 0.3), "v"))


ROT = X.rotation_from_affine(AFFINE)


@query(sql("SELECT vec_id, [" + ",".join("round(" + "+".join(f"pred[{k + 1}]*({float(ROT[k, j])!r})" for k in range(3)) + ",6)" for j in range(3)) + "] AS v, [" + ",".join("round(" + "+".join(f"pred[{k + 1}]*({float(ROT[j, k])!r})" for k in range(3)) + ",6)" for j in range(3)) + "] AS g FROM vectors", "vectors"))
def f6_rotate(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.rotate_peaks("pred", AFFINE), "v"), r6v(X.rotate_gradients("pred", AFFINE), "g"))


@query(sql("SELECT vec_id, [round(cos(0.5)*pred[1]-sin(0.5)*pred[2],6)+0.0,round(sin(0.5)*pred[1]+cos(0.5)*pred[2],6)+0.0,round(pred[3],6)+0.0] AS v FROM vectors", "vectors"))
def f7_rotate_euler(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.rotate_euler("pred", F.lit(0.0), F.lit(0.0), F.lit(0.5)), "v"))


@query(sql("+s AS (SELECT vec_id, " + ", ".join("+".join(f"({float(ROT[j, k])!r})*pred[{k + 1}]" for k in range(3)) + f" AS r{j}" for j in range(3)) + " FROM vectors) SELECT vec_id, [" + ",".join(f"round(r{i}*r{j},6)+0.0" for i in range(3) for j in range(i, 3)) + "] AS t FROM s", "vectors"))
def f8_rotate_tensor(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.rotate_tensor(X.vec_to_tensor("pred"), ROT), "t"))


@query(sql("SELECT vec_id, [" + ",".join(f"round(pred[{i}]*pred[{j}],6)+0.0" for i in (1, 2, 3) for j in range(i, 4)) + "] AS t FROM vectors", "vectors"))
def f9_vec_to_tensor(spark, d):
    return fx.vectors(spark, d).select("vec_id", r6v(X.vec_to_tensor("pred"), "t"))


@query(sql(f"+s AS (SELECT vec_id, pred, {N3.format('pred')} AS n FROM vectors) SELECT vec_id, [" + ",".join(f"CASE WHEN n*n<0.001 THEN 0 ELSE round(abs(pred[{k}])*n,5) END" for k in (1, 2, 3)) + "] AS v FROM s", "vectors"))
def f10_tensor_to_vec(spark, d):
    out = fx.vectors(spark, d).select("vec_id", X.tensor_to_vec(X.vec_to_tensor("pred")).alias("v"))
    return out.select("vec_id", F.transform("v", lambda x: F.round(F.abs(x), 5) + F.lit(0.0)).alias("v"))


@query(sql("SELECT vec_id, [" + ",".join(f"round(cand[{X.FLAT[i][j] + 1}],6)+0.0" for i in range(3) for j in range(3)) + "] AS m, [" + ",".join(f"round(cand[{k}],6)+0.0" for k in range(1, 7)) + "] AS t FROM vectors", "vectors"))
def f11_tensor_layout(spark, d):
    t = F.slice("cand", 1, 6)
    return fx.vectors(spark, d).select("vec_id", r6v(X.tensor_matrix(t), "m"), r6v(X.tensor_flat(X.tensor_matrix(t)), "t"))


INV = X.affine_inverse(AFFINE)


@query(sql("+w AS (SELECT *, " + ", ".join("+".join(f"{c}*({float(AFFINE[i, k])!r})" for k, c in enumerate("xyz")) + f"+({float(AFFINE[i, 3])!r}) AS w{c2}" for i, c2 in enumerate("xyz")) + " FROM line_points) SELECT subject,bundle,line_id,pos,round(wx,6) AS wx,round(wz,6) AS wz,round(x,6)+0.0 AS x,round(z,6)+0.0 AS z FROM w", "line_points"))
def f12_affine_apply(spark, d):
    p = fx.line_points(spark, d)
    wx, wy, wz = X.affine_apply(F.col("x"), F.col("y"), F.col("z"), AFFINE)
    w = p.select(*L.LINE, "pos", wx.alias("wx"), wy.alias("wy"), wz.alias("wz"))
    x, _, z = X.affine_apply(F.col("wx"), F.col("wy"), F.col("wz"), INV)
    return w.select(*L.LINE, "pos", r6("wx"), r6("wz"), r6(x, "x"), r6(z, "z"))


@query(sql("SELECT subject,bundle,CAST(49-x AS INT) AS x,y,CAST(49-z AS INT) AS z,value FROM voxels", "voxels"))
def f13_flip_grid(spark, d):
    return V.flip_grid(fx.voxels(spark, d), X.flip_axes_for(np.diag([1.0, 1.0, -1.0, 1.0])), GRID)


INVERTED = X.invert_xy_affine(AFFINE)


@query(sql("SELECT subject,bundle,line_id,pos," + ",".join("round(" + "+".join(f"{c}*({float(INVERTED[i, k])!r})" for k, c in enumerate("xyz")) + f"+({float(INVERTED[i, 3])!r}),6) AS w{a}" for i, a in enumerate("xyz")) + " FROM line_points", "line_points"))
def f14_invert_xy_affine(spark, d):
    world = X.affine_apply(F.col("x"), F.col("y"), F.col("z"), INVERTED)
    return fx.line_points(spark, d).select(*L.LINE, "pos", *(r6(w, f"w{a}") for w, a in zip(world, "xyz", strict=True)))


@query(sql("SELECT subject,bundle,line_id,pos,round(-(x+1.5),6) AS x,round(y+1.5,6) AS y FROM line_points", "line_points"))
def f15_move_lines(spark, d):
    moved = L.mirror(L.shift(fx.lines(spark, d), 1.5), (-1, 1, 1))
    return L.explode_points(moved).select(*L.LINE, "pos", r6("x"), r6("y"))


@query("SELECT vec_id, round(abs(round(CAST(embedding[1] AS DOUBLE),2)),6) AS spacing FROM embeddings")
def f16_spacing(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select("vec_id", r6(X.spacing(F.transform("embedding", lambda v: v.cast("double"))), "spacing"))


@query(sql("SELECT subject,bundle,position," + FMT.format(x="mean") + " AS mean," + FMT.format(x="(n*-1e-8)") + " AS small," + FMT.format(x="(n*1e6+0.25)") + " AS large FROM profiles", "profiles"))
def f17_format_number(spark, d):
    return fx.profiles(spark, d).select(*I, "position", X.format_number("mean").alias("mean"), X.format_number(F.col("n") * -1e-8).alias("small"), X.format_number(F.col("n") * 1e6 + 0.25).alias("large"))


@query(sql("+s AS (SELECT vec_id, abs(cand[1]) AS a, abs(cand[2]) AS b, abs(cand[3]) AS c FROM vectors) SELECT vec_id, round(sqrt(0.5)*sqrt((a-b)*(a-b)+(b-c)*(b-c)+(c-a)*(c-a))/sqrt(a*a+b*b+c*c),6) AS fa FROM s", "vectors"))
def f18_fractional_anisotropy(spark, d):
    a, b, c = (F.abs(F.col("cand")[k]) for k in range(3))
    return fx.vectors(spark, d).select("vec_id", r6(X.fractional_anisotropy(a, b, c), "fa"))


@query(sql("SELECT subject,bundle,position,round(" + T2P.format(t="((mean-0.05)*100)", v="n") + ",6) AS p FROM profiles", "profiles"))
def f19_t_to_p(spark, d):
    from ..functions.student import t_to_p

    return fx.profiles(spark, d).select(*I, "position", r6(t_to_p((F.col("mean") - 0.05) * 100, F.col("n")), "p"))


@query("SELECT l_orderkey, round(least(a,b)/greatest(a,b),6) AS ratio FROM (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS a, CAST(max(l_linenumber)+1 AS DOUBLE) AS b FROM lineitem GROUP BY 1)")
def f20_size_ratio(spark, d):
    t = fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("a"), (F.max("l_linenumber") + 1).cast("double").alias("b"))
    return t.select("l_orderkey", r6(X.size_ratio("a", "b"), "ratio"))


@query("SELECT c_custkey, replace('/data/SUBJECT_ID/fa.csv','SUBJECT_ID',CAST(c_custkey AS VARCHAR)) AS path, c_mktsegment || '_left' AS one_side, c_mktsegment || '_e' AS one_end FROM customer")
def f21_subject_path(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select("c_custkey", X.subject_path("/data/SUBJECT_ID/fa.csv", "c_custkey").alias("path"), X.both_sides("c_mktsegment")[0].alias("one_side"), X.both_ends("c_mktsegment")[1].alias("one_end"))
