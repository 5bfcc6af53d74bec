"""The rest of the catalogue: neighbourhoods, polylines, profiles, cohort tests, scores, regions, data preparation."""

from __future__ import annotations

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
from .catalog import C3, CROSS, FMT, GAPS, GRID, HASH, I, INSIDE, N3, T2P, cos_sql, el, image3, query, r6, r6v, rounded
from .fixtures import sql

# Neighbourhoods


@query(sql(f"SELECT DISTINCT subject,bundle,CAST(x+a AS INT) AS x,CAST(y+b AS INT) AS y,CAST(z+c AS INT) AS z FROM mask, {CROSS} WHERE {INSIDE}", "mask"))
def g1_dilate(spark, d):
    return V.dilate(fx.mask(spark, d), 1, GRID)


def box_sql(source: str, out: str, size: int, erode: bool = False) -> str:
    """``out``: ``source`` grown, or worn off, by a box, one axis after the other."""
    low, high = -((size - 1) // 2), size // 2
    steps, last = [], source
    for k, c in enumerate("xyz"):
        moved = f"CAST({c}{'-' if erode else '+'}o AS INT)"
        cols = ",".join(f"{moved} AS {a}" if a == c else a for a in "xyz")
        name = out if k == 2 else f"{out}_{c}"
        rows = f"SELECT subject,bundle,{cols}{',count(*) AS n' if erode else ''} FROM {last}, range({low},{high + 1}) t(o) WHERE {moved} BETWEEN 0 AND 49"
        steps.append(f"{name} AS (SELECT subject,bundle,x,y,z FROM ({rows} GROUP BY ALL) WHERE n={size})" if erode else f"{name} AS (SELECT DISTINCT * FROM ({rows}))")
        last = name
    return ", ".join(steps)


def close_sql(source: str, out: str, size: int) -> str:
    return box_sql(source, f"{out}_wide", size) + ", " + box_sql(f"{out}_wide", out, size, True)


@query(sql("+" + box_sql("mask", "g", 3) + " SELECT * FROM g", "mask"))
def g2_dilate_box(spark, d):
    return V.dilate_box(fx.mask(spark, d), 3, GRID)


@query(sql("+open_ AS (SELECT * FROM mask WHERE bundle<>'A'), " + close_sql("open_", "g", 6) + " SELECT * FROM g UNION ALL SELECT subject,bundle,x,y,z FROM mask WHERE bundle='A'", "mask"))
def g3_close_holes(spark, d):
    return V.close_holes(fx.mask(spark, d), 6, GRID, ["A"])


BLOBS = """wide AS (SELECT DISTINCT subject,x,y,z FROM mask), own AS (SELECT *, (x*50+y)*50+z AS node FROM wide),
 e AS (SELECT a.subject,a.node AS a,b.node AS b FROM own a JOIN own b ON a.subject=b.subject AND abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1 AND b.node IN (a.node+1,a.node-1,a.node+50,a.node-50,a.node+2500,a.node-2500)),
 walk(subject,node,lab) AS (SELECT subject,node,node FROM own UNION SELECT e.subject,e.b,w.lab FROM walk w JOIN e ON e.subject=w.subject AND e.a=w.node),
 blobs AS (SELECT subject,node,min(lab) AS blob FROM walk GROUP BY ALL)"""


def wide_mask(spark, d):
    return fx.mask(spark, d).select("subject", *C3).distinct()


@query(sql("+" + BLOBS + " SELECT o.subject,x,y,z,blob FROM own o JOIN blobs USING (subject,node)", "mask"))
def g4_label_blobs(spark, d):
    return V.label_blobs(wide_mask(spark, d), GRID, ["subject"]).select("subject", *C3, F.col("blob").cast("int").alias("blob"))


@query(sql("+" + BLOBS + ", n AS (SELECT subject,blob,count(*) AS n,row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC,blob) AS r FROM blobs GROUP BY subject,blob) SELECT o.subject,x,y,z FROM own o JOIN blobs USING (subject,node) JOIN n USING (subject,blob) WHERE n.n>1 OR n.r=1", "mask"))
def g5_remove_small_blobs(spark, d):
    return V.remove_small_blobs(wide_mask(spark, d), 1, GRID, ["subject"])


def blobs_sql(source: str) -> str:
    """Blobs within subject and bundle, the two as one key."""
    return BLOBS.replace("SELECT DISTINCT subject,x,y,z FROM mask", f"SELECT DISTINCT subject || bundle AS subject,x,y,z FROM {source}")


KEY = "CAST(left(subject,1) AS INT) AS subject, substr(subject,2) AS bundle"


@query(sql("+" + blobs_sql("mask") + f", n AS (SELECT subject,blob,count(*) AS n FROM blobs GROUP BY ALL), t AS (SELECT subject,sum(CAST(n>1 AS INT))>=2 AS two_big FROM n GROUP BY 1) SELECT {KEY}, two_big FROM t", "mask"))
def g6_two_big_blobs(spark, d):
    return V.has_two_big_blobs(fx.mask(spark, d), {"A": 1, "N": 1, "R": 1}, GRID)


@query(sql("+plain AS (SELECT * FROM mask WHERE bundle='N'), " + blobs_sql("plain") + ", n AS (SELECT subject,blob,count(*) AS n FROM blobs GROUP BY ALL), two AS (SELECT CAST(left(subject,1) AS INT) AS subject FROM n WHERE n>1 GROUP BY subject HAVING count(*)>=2), low AS (SELECT subject,bundle,x,y,z FROM voxels SEMI JOIN two USING (subject) WHERE bundle='N' AND value>0.4), " + close_sql("low", "g", 3) + " SELECT * FROM g UNION ALL SELECT subject,bundle,x,y,z FROM mask WHERE bundle<>'N' UNION ALL SELECT subject,bundle,x,y,z FROM plain ANTI JOIN two USING (subject)", "mask"))
def g7_bundle_rules(spark, d):
    return V.bundle_specific_postprocess(fx.voxels(spark, d), GRID, {"N": (1, 0.4)}, 3)


@query(sql("+" + close_sql("mask", "closed", 2) + ", " + blobs_sql("closed") + f", n AS (SELECT subject,blob,count(*) AS n,row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC,blob) AS r FROM blobs GROUP BY subject,blob) SELECT {KEY},x,y,z FROM own JOIN blobs USING (subject,node) JOIN n USING (subject,blob) WHERE n.n>1 OR n.r=1", "mask"))
def g8_postprocess(spark, d):
    return V.postprocess(fx.mask(spark, d), 1, GRID, 2)


BOX = "box AS (SELECT subject,min(x) AS x0,min(y) AS y0,min(z) AS z0,max(x) AS x1,max(y) AS y1,max(z) AS z1 FROM voxels WHERE bundle='A' AND value<>0 GROUP BY 1)"


@query(sql(f"+{BOX} SELECT subject,bundle,CAST(x-x0 AS INT) AS x,CAST(y-y0 AS INT) AS y,CAST(z-z0 AS INT) AS z,value FROM voxels JOIN box USING (subject) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1", "voxels"))
def g9_crop(spark, d):
    v = fx.voxels(spark, d)
    return V.crop(v, V.bbox(v.where("bundle = 'A'")))


@query(sql(f"+{BOX} SELECT v.* FROM voxels v JOIN box USING (subject) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1", "voxels"))
def g10_uncrop(spark, d):
    v = fx.voxels(spark, d)
    box = V.bbox(v.where("bundle = 'A'"))
    return V.uncrop(V.crop(v, box), box)


@query(sql("SELECT subject,bundle,CAST(x+3 AS INT) AS x,CAST(y+2 AS INT) AS y,z,value FROM voxels", "voxels"))
def g11_pad(spark, d):
    return V.pad(fx.voxels(spark, d), (7, 4, 0))


NEAR = "CAST(floor(o*({n}-1)/({m}-1.0)+0.5) AS INT)"


def nearest(n: int, m: int, name: str) -> str:
    return f"{name} AS (SELECT CAST(o AS INT) AS o, {NEAR.format(n=n, m=m)} AS i FROM range({m}) t(o))"


@query(sql("+" + nearest(60, 36, "m") + " SELECT subject,bundle,a.o AS x,b.o AS y,c.o AS z,value FROM voxels JOIN m a ON a.i=x+5 JOIN m b ON b.i=y JOIN m c ON c.i=z+5", "voxels"))
def g12_square_and_scale(spark, d):
    return V.square_and_scale(fx.voxels(spark, d), (50, 60, 50), 36)[0]


@query(sql("+" + nearest(60, 36, "m") + ", " + nearest(36, 60, "w") + " SELECT subject,bundle,CAST(p.o-5 AS INT) AS x,q.o AS y,CAST(r.o-5 AS INT) AS z,value FROM voxels JOIN m a ON a.i=x+5 JOIN m b ON b.i=y JOIN m c ON c.i=z+5 JOIN w p ON p.i=a.o JOIN w q ON q.i=b.o JOIN w r ON r.i=c.o WHERE p.o-5 BETWEEN 0 AND 49 AND q.o<60 AND r.o-5 BETWEEN 0 AND 49", "voxels"))
def g13_unscale(spark, d):
    return V.unscale(*V.square_and_scale(fx.voxels(spark, d), (50, 60, 50), 36))


@query(sql("+" + nearest(50, 30, "m") + ", " + nearest(50, 70, "w") + " SELECT subject,bundle,a.o AS x,b.o AS y,c.o AS z,value FROM voxels JOIN m a ON a.i=x JOIN w b ON b.i=y JOIN m c ON c.i=z", "voxels"))
def g14_resample_nearest(spark, d):
    return V.resample_nearest(fx.voxels(spark, d), GRID, (30, 70, 30))


@query(sql("+m AS (SELECT CAST(o AS INT) AS o, CAST(floor(o*2.0/1.25+0.5) AS INT) AS i FROM range(31) t(o)) SELECT subject,bundle,a.o AS x,b.o AS y,c.o AS z,value FROM voxels JOIN m a ON a.i=x JOIN m b ON b.i=y JOIN m c ON c.i=z", "voxels"))
def g15_change_spacing(spark, d):
    return V.change_spacing(fx.voxels(spark, d), GRID, 1.25, 2.0)


@query(sql("SELECT 'there' AS way,subject,bundle,CAST(49-x AS INT) AS x,y,CAST(49-z AS INT) AS z,value FROM voxels UNION ALL SELECT 'back',* FROM voxels", "voxels"))
def g16_reorient_and_back(spark, d):
    there = V.flip_grid(fx.voxels(spark, d), [0, 2], GRID)
    frames = {"there": there, "back": V.flip_grid(there, [0, 2], GRID)}
    return frames["there"].withColumn("way", F.lit("there")).unionByName(frames["back"].withColumn("way", F.lit("back")))


@query(sql("+" + nearest(50, 40, "m") + ", " + nearest(40, 50, "w") + ", t AS (SELECT subject,bundle,CAST(a.o+2 AS INT) AS x,CAST(b.o-5 AS INT) AS y,CAST(c.o+2 AS INT) AS z,value FROM voxels JOIN m a ON a.i=x JOIN m b ON b.i=y JOIN m c ON c.i=z WHERE b.o-5 BETWEEN 0 AND 29) SELECT 'there' AS way,* FROM t UNION ALL SELECT 'back',subject,bundle,a.o,b.o,c.o,value FROM t JOIN w a ON a.i=x-2 JOIN w b ON b.i=y+5 JOIN w c ON c.i=z-2", "voxels"))
def g17_model_shape(spark, d):
    recipe = ((40, 40, 40), (-2, 5, -2), (44, 30, 44))
    there = V.to_model_shape(fx.voxels(spark, d), GRID, recipe)
    return there.withColumn("way", F.lit("there")).unionByName(V.from_model_shape(there, GRID, recipe).withColumn("way", F.lit("back")))


@query(sql(f"+g AS (SELECT DISTINCT bundle,CAST(x+a AS INT) AS x,CAST(y+b AS INT) AS y,CAST(z+c AS INT) AS z FROM vectors, {CROSS} WHERE x%3=0) SELECT vec_id,[" + ",".join(f"round(pred[{k}]/({N3.format('pred')}+1e-20),6)+0.0" for k in (1, 2, 3)) + "] AS v FROM vectors SEMI JOIN g USING (bundle,x,y,z)", "vectors"))
def g18_mask_and_normalize(spark, d):
    """x and y run to 10, z as far as the table goes."""
    v = fx.vectors(spark, d).withColumn("subject", F.lit(0)).withColumn("v", F.col("pred"))
    return V.mask_and_normalize(v, v.where("x % 3 = 0"), 1, (10, 10, (1 << 31) - 1)).select("vec_id", r6v("v", "v"))


GRADIENTS = [(0.0, 0.0, 0.0, 0.0)] + [(1.0, a / n, b / n, c / n) for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, -1, 0), (1, 0, -1), (0, 1, -1), (1, 1, 1), (1, -1, 1), (1, 1, -1)) for n in [(a * a + b * b + c * c) ** 0.5]]


def tensor_weights():
    """Rows of the pseudo-inverse of the gradients' design, for the SQL."""
    import numpy as np

    design = [[-b * g[i] * g[j] * (1 if i == j else 2) for i in range(3) for j in range(i, 3)] + [1.0] for b, *g in GRADIENTS]
    return [[float(v) for v in row] for row in np.linalg.pinv(np.array(design))[:6]]


@query(sql("+t AS (SELECT vec_id, " + ", ".join(f"sum(({row!r})[direction]*ln(greatest(prob,1e-6))) AS t{k}" for k, row in enumerate(tensor_weights())) + " FROM predictions WHERE direction<=13 GROUP BY 1), s AS (SELECT *, t0+t3+t5 AS tr, t0*t0+t3*t3+t5*t5+2*(t1*t1+t2*t2+t4*t4) AS sq FROM t) SELECT vec_id, round(sqrt(1.5*(sq-tr*tr/3)/sq),6) AS fa FROM s", "predictions"))
def g19_fit_tensor(spark, d):
    signal = fx.predictions(spark, d).where("direction <= 13").select("vec_id", (F.col("direction") - 1).alias("idx"), F.col("prob").alias("value"))
    fitted = D.fit_tensor(signal, GRADIENTS, ["vec_id"]).withColumn("l", X.eigenvalues("t"))
    return fitted.select("vec_id", F.round(X.fractional_anisotropy(F.col("l")[0], F.col("l")[1], F.col("l")[2]), 6).alias("fa"))


#: Thirty measurements: one without weighting, and the directions above at three strengths.
MEASURED = [GRADIENTS[0]] + [((1.0, 0.5, 2.0)[k // 12], *GRADIENTS[1 + k % 12][1:]) for k in range(29)]


@query()
def g19_fit_tensor_weighted(spark, d):
    signal = fx.predictions(spark, d).select("vec_id", (F.col("direction") - 1).alias("idx"), F.col("prob").alias("value"))
    fitted = D.fit_tensor_weighted(signal, MEASURED, ["vec_id"]).withColumn("l", X.eigenvalues("t"))
    return fitted.select("vec_id", F.round(X.fractional_anisotropy(F.col("l")[0], F.col("l")[1], F.col("l")[2]), 6).alias("fa"), r6("s0"))


# Polylines


@query(sql("+" + GAPS + " SELECT subject,bundle,line_id,round(coalesce(sum(gap),0),6) AS length,count(gap) AS n_gaps FROM d GROUP BY ALL", "line_points"))
def l1_segment_lengths(spark, d):
    return L.segment_lengths(fx.lines(spark, d)).select(*L.LINE, r6("length"), F.size("gaps").cast("long").alias("n_gaps"))


RESAMPLED = """cum AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY subject,bundle,line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS lo FROM d),
 seg AS (SELECT *, lo+gap AS hi FROM cum WHERE gap IS NOT NULL), len AS (SELECT subject,bundle,line_id,max(hi) AS len FROM seg GROUP BY ALL),
 tgt AS (SELECT *, len*i/7 AS t FROM len, range(8) r(i)),
 hit AS (SELECT t.*, s.x,s.y,s.z,s.x2,s.y2,s.z2,s.lo,s.hi,row_number() OVER (PARTITION BY t.subject,t.bundle,t.line_id,i ORDER BY s.pos DESC) AS r FROM tgt t JOIN seg s USING (subject,bundle,line_id) WHERE s.lo<=t.t),
 res AS (SELECT subject,bundle,line_id,CAST(i AS INT) AS pos,x+(x2-x)*w AS x,y+(y2-y)*w AS y,z+(z2-z)*w AS z FROM (SELECT *, CASE WHEN hi>lo THEN least((t-lo)/(hi-lo),1) ELSE 0 END AS w FROM hit WHERE r=1))"""


@query(sql("+" + GAPS + ", " + RESAMPLED + " SELECT subject,bundle,line_id,pos,round(x,5) AS x,round(y,5) AS y,round(z,5) AS z FROM res", "line_points"))
def l2_resample(spark, d):
    many = fx.lines(spark, d).where(F.size("points") > 1)
    return L.explode_points(L.resample(many, 8)).select(*L.LINE, "pos", *((F.round(c, 5) + 0.0).alias(c) for c in C3))


@query(sql("+" + GAPS + ", " + RESAMPLED + " SELECT subject,bundle,line_id,pos,round(x,5) AS x,round(y,5) AS y,round(z,5) AS z FROM res", "line_points"))
def l2_resample_by_rows(spark, d):
    return L.resample_by_rows(fx.line_points(spark, d), 8).select(*L.LINE, "pos", *((F.round(c, 5) + 0.0).alias(c) for c in C3))


@query(sql("+" + GAPS + " SELECT subject,bundle,line_id,CAST(sum(CASE WHEN gap IS NULL THEN 0 ELSE greatest(ceil(gap/0.5),1) END)+1 AS BIGINT) AS n_points FROM d GROUP BY ALL", "line_points"))
def l3_subsegment(spark, d):
    return L.subsegment(fx.lines(spark, d), 0.5).select(*L.LINE, F.size("points").cast("long").alias("n_points"))


@query(sql("+" + GAPS + ", l AS (SELECT subject,bundle,line_id,coalesce(sum(gap),0) AS len FROM d GROUP BY ALL), s AS (SELECT subject,bundle,max(len)/20 AS step FROM l GROUP BY ALL) SELECT subject,bundle,line_id,CASE WHEN step>0 THEN greatest(CAST(trunc(len/step) AS BIGINT),1) ELSE 1 END AS n_points FROM l JOIN s USING (subject,bundle)", "line_points"))
def l4_resample_same_step(spark, d):
    return L.resample_same_step(fx.lines(spark, d), 20).select(*L.LINE, F.size("points").cast("long").alias("n_points"))


FIRST = "st AS (SELECT DISTINCT subject,bundle,CAST(trunc(x+0.5) AS INT) AS cx,CAST(trunc(y+0.5) AS INT) AS cy,CAST(trunc(z+0.5) AS INT) AS cz FROM line_points WHERE pos=0 AND line_id%2=0), f AS (SELECT p.*, max(pos) OVER (PARTITION BY subject,bundle,line_id) AS last FROM line_points p), o AS (SELECT f.*, CAST(trunc(x+0.5) AS INT) AS cx,CAST(trunc(y+0.5) AS INT) AS cy,CAST(trunc(z+0.5) AS INT) AS cz FROM f WHERE pos=0)"


@query(sql("+" + FIRST + ", k AS (SELECT o.subject,o.bundle,o.line_id,o.last,st.cx IS NOT NULL AS ok FROM o LEFT JOIN st USING (subject,bundle,cx,cy,cz) WHERE o.cx<50 AND o.cy<50 AND o.cz<50 AND o.x>=-0.5 AND o.y>=-0.5 AND o.z>=-0.5) SELECT subject,bundle,line_id,round(x,6) AS x,ok FROM k JOIN line_points p USING (subject,bundle,line_id) WHERE p.pos=CASE WHEN ok THEN 0 ELSE last END", "line_points"))
def l5_orient_to_start(spark, d):
    lines = fx.lines(spark, d)
    p = F.element_at("points", 1)
    starts = lines.where("line_id % 2 = 0").select("subject", "bundle", *((p[c] + 0.5).cast("int").alias(c) for c in C3))
    out = L.orient_to_start(lines, starts, GRID)
    before = lines.select(*L.LINE, F.element_at("points", 1).alias("a_"), F.element_at("points", -1).alias("b_"))
    joined = out.join(before, L.LINE)
    hit = joined.select(*L.LINE, F.element_at("points", 1).alias("n_"), "a_", "points")
    known = starts.distinct().withColumn("ok", F.lit(True))
    keyed = hit.select(*L.LINE, "n_", *((F.col("a_")[c] + 0.5).cast("int").alias(c) for c in C3))
    return keyed.join(known, [*I, *C3], "left").select(*L.LINE, r6(F.col("n_")["x"], "x"), F.coalesce("ok", F.lit(False)).alias("ok"))


@query(sql("+c AS (SELECT DISTINCT subject,bundle,line_id,CAST(trunc(x) AS INT) AS x,CAST(trunc(y) AS INT) AS y,CAST(trunc(z) AS INT) AS z FROM line_points), keep AS (SELECT DISTINCT subject,bundle,x,y,z FROM c WHERE line_id%2=0) SELECT DISTINCT subject,bundle,line_id FROM c ANTI JOIN (SELECT DISTINCT c.subject,c.bundle,c.line_id FROM c ANTI JOIN keep USING (subject,bundle,x,y,z)) q USING (subject,bundle,line_id)", "line_points"))
def l6_filter_leaving_mask(spark, d):
    lines = fx.lines(spark, d)
    cells = L.explode_points(lines.where("line_id % 2 = 0")).select(*I, *(F.col(c).cast("int").alias(c) for c in C3))
    return L.filter_leaving_mask(lines, cells, 1e9).select(*L.LINE)


@query(sql("+" + GAPS + " SELECT subject,bundle,line_id FROM d GROUP BY ALL HAVING coalesce(sum(gap),0) BETWEEN 40 AND 160", "line_points"))
def l7_filter_length(spark, d):
    return L.filter_length(fx.lines(spark, d), 50, 200, 1.25).select(*L.LINE)


@query(sql("+e AS (SELECT subject,bundle,line_id,arg_min(z,pos) AS a,arg_max(z,pos) AS b FROM line_points GROUP BY ALL), s AS (SELECT DISTINCT subject,bundle,CAST(trunc(x) AS INT) AS cx,CAST(trunc(y) AS INT) AS cy,CAST(trunc(z) AS INT) AS cz FROM line_points WHERE z<25), ends AS (SELECT subject,bundle,line_id,arg_min(ROW(x,y,z),pos) AS p,arg_max(ROW(x,y,z),pos) AS q FROM line_points GROUP BY ALL), g AS (SELECT *, CAST(trunc(p[1]) AS INT) AS px,CAST(trunc(p[2]) AS INT) AS py,CAST(trunc(p[3]) AS INT) AS pz,CAST(trunc(q[1]) AS INT) AS qx,CAST(trunc(q[2]) AS INT) AS qy,CAST(trunc(q[3]) AS INT) AS qz FROM ends) SELECT g.subject,g.bundle,g.line_id FROM g LEFT JOIN s a ON a.subject=g.subject AND a.bundle=g.bundle AND a.cx=px AND a.cy=py AND a.cz=pz LEFT JOIN s b ON b.subject=g.subject AND b.bundle=g.bundle AND b.cx=qx AND b.cy=qy AND b.cz=qz WHERE (a.cx IS NOT NULL AND b.cx IS NULL) OR (a.cx IS NULL AND b.cx IS NOT NULL)", "line_points"))
def l8_filter_endpoints(spark, d):
    p = fx.line_points(spark, d).select(*I, *(F.col(c).cast("int").alias(c) for c in C3), (F.col("z") < 25).alias("low"))
    low = p.where("low").select(*I, *C3).distinct()
    high = p.where("not low").select(*I, *C3).distinct()
    return L.filter_endpoints(fx.lines(spark, d), low, high.join(low, [*I, *C3], "left_anti")).select(*L.LINE)


@query(sql("+m AS (SELECT *, max(pos) OVER (PARTITION BY subject,bundle,line_id) AS last FROM line_points) SELECT a.subject,a.bundle,a.line_id,a.pos,round(avg(b.x),6) AS x FROM m a JOIN line_points b ON a.subject=b.subject AND a.bundle=b.bundle AND a.line_id=b.line_id AND abs(a.pos-b.pos)<=least(2,a.pos,a.last-a.pos) GROUP BY ALL", "line_points"))
def l9_smooth(spark, d):
    return L.explode_points(L.smooth(fx.lines(spark, d), 2)).select(*L.LINE, "pos", r6("x"))


@query()
def l9_smooth_spline(spark, d):
    return L.explode_points(L.smooth_spline(fx.lines(spark, d), 5.0)).select(*L.LINE, "pos", *(r6(c, c) for c in C3))


@query()
def l10_compress(spark, d):
    return L.compress(fx.lines(spark, d), 5.0).select(*L.LINE, F.size("points").alias("n_points"))


@query(sql("SELECT subject,bundle,line_id,greatest(count(*),25) AS n_points,greatest(25-count(*),0) AS added FROM line_points GROUP BY ALL", "line_points"))
def l11_pad_lines(spark, d):
    out = L.pad_lines(fx.lines(spark, d), 25, (-1.0, -1.0, -1.0))
    return out.select(*L.LINE, F.size("points").cast("long").alias("n_points"), F.size(F.filter("points", lambda p: p["x"] == -1)).cast("long").alias("added"))


@query(sql("SELECT subject,bundle,pos,round(avg(x),6) AS x,round(avg(y),6) AS y,round(avg(z),6) AS z FROM line_points GROUP BY ALL", "line_points"))
def l12_centroid(spark, d):
    return rounded(L.centroid(fx.lines(spark, d)), *C3)


@query()
def l12_threshold_clusters(spark, d):
    from ..operators.bundles import threshold_clusters

    return threshold_clusters(L.resample(fx.lines(spark, d).where(F.size("points") > 1), 12), 18.0)


@query()
def l12_split_bundles(spark, d):
    from ..operators.bundles import split_bundles, threshold_clusters

    return split_bundles(threshold_clusters(L.resample(fx.lines(spark, d).where(F.size("points") > 1), 12), 18.0))


@query(sql("SELECT subject,bundle,line_id,'b' AS \"end\",round(arg_min(x,pos),6) AS x FROM line_points GROUP BY ALL UNION ALL SELECT subject,bundle,line_id,'e',round(arg_max(x,pos),6) FROM line_points GROUP BY ALL", "line_points"))
def l13_endpoints(spark, d):
    return L.endpoints(fx.lines(spark, d)).select(*L.LINE, "end", r6("x"))


def ends_keyed(spark, d):
    return L.endpoints(fx.lines(spark, d)).select(*I, (F.col("line_id") * 2 + (F.col("end") == "e").cast("int")).alias("k"), *C3)


ENDS = """p AS (SELECT subject,bundle,line_id*2 AS k,arg_min(x,pos) AS x,arg_min(y,pos) AS y,arg_min(z,pos) AS z FROM line_points GROUP BY subject,bundle,line_id
 UNION ALL SELECT subject,bundle,line_id*2+1,arg_max(x,pos),arg_max(y,pos),arg_max(z,pos) FROM line_points GROUP BY subject,bundle,line_id)"""


@query(sql("+" + ENDS + """, near AS (SELECT a.subject,a.bundle,a.k AS a,b.k AS b FROM p a JOIN p b ON a.subject=b.subject AND a.bundle=b.bundle AND a.k<>b.k WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)<=12),
 core AS (SELECT subject,bundle,a FROM near GROUP BY ALL HAVING count(*)+1>=3), e AS (SELECT n.* FROM near n SEMI JOIN core USING (subject,bundle,a) WHERE (n.subject,n.bundle,n.b) IN (SELECT (subject,bundle,a) FROM core)),
 walk(subject,bundle,node,lab) AS (SELECT subject,bundle,a,a FROM core UNION SELECT e.subject,e.bundle,e.b,w.lab FROM walk w JOIN e ON e.subject=w.subject AND e.bundle=w.bundle AND e.a=w.node),
 cl AS (SELECT subject,bundle,node,min(lab) AS cluster FROM walk GROUP BY ALL),
 found AS (SELECT subject,bundle,node AS k,cluster FROM cl UNION ALL SELECT n.subject,n.bundle,n.a,min(cluster) FROM near n JOIN cl ON cl.subject=n.subject AND cl.bundle=n.bundle AND cl.node=n.b ANTI JOIN core c ON c.subject=n.subject AND c.bundle=n.bundle AND c.a=n.a GROUP BY ALL)
 SELECT p.subject,p.bundle,p.k,cluster FROM p LEFT JOIN found USING (subject,bundle,k)""", "line_points"))
def l14_cluster_endpoints(spark, d):
    return L.cluster_endpoints(ends_keyed(spark, d), "k", I, 12.0, 3).select(*I, "k", "cluster")


@query()
def l14_split_endpoints(spark, d):
    return L.split_endpoints(ends_keyed(spark, d), "k", I, 12.0, 3).select(*I, "k", "side")


def sided(spark, d):
    """Ends of lines, the clusters' sides as labels, and the side that each bundle's forest gives all of them."""
    return L.classify_endpoints(L.split_endpoints(ends_keyed(spark, d), "k", I, 12.0, 3).withColumnRenamed("side", "known"), "known", "k")


@query()
def l15_classify_endpoints(spark, d):
    return sided(spark, d).select(*I, "k", "known", "side")


@query()
def l16_clustered_endpoint_masks(spark, d):
    """The whole chain: clusters, a forest for each bundle, masks of both ends."""
    return L.endpoint_masks(sided(spark, d), "side")


@query(sql("SELECT DISTINCT subject,bundle,CASE WHEN pos=0 THEN 'b' ELSE 'e' END AS \"end\",CAST(trunc(x) AS INT) AS x,CAST(trunc(y) AS INT) AS y,CAST(trunc(z) AS INT) AS z FROM (SELECT *, max(pos) OVER (PARTITION BY subject,bundle,line_id) AS last FROM line_points) WHERE pos=0 OR pos=last UNION SELECT subject,bundle,'e',CAST(trunc(x) AS INT),CAST(trunc(y) AS INT),CAST(trunc(z) AS INT) FROM (SELECT *, max(pos) OVER (PARTITION BY subject,bundle,line_id) AS last FROM line_points) WHERE pos=0 AND last=0", "line_points"))
def l16_endpoint_masks(spark, d):
    return L.endpoint_masks(L.endpoints(fx.lines(spark, d)))


# Profiles


def profile_inputs(spark, d):
    lines = fx.lines(spark, d).where(F.size("points") > 1)
    p = F.element_at("points", 1)
    starts = lines.where("line_id % 2 = 0").select(*I, *((p[c] + 0.5).cast("int").alias(c) for c in C3)).distinct()
    return lines, image3(spark, d), starts


@query()
def t1_profile(spark, d):
    return rounded(P.profile(*profile_inputs(spark, d), GRID, n=20, dilation=1, least=1, image_on=[]), "mean", "std")


@query(sql("SELECT subject,bundle,pos AS position,round(avg(y),6) AS mean,round(stddev_pop(y),6) AS std,count(*) AS n FROM line_points GROUP BY ALL", "line_points"))
def t2_equal_dist(spark, d):
    return rounded(P.equal_dist_profile(fx.line_points(spark, d), "y"), "mean", "std")


@query()
def t3_cutting_plane(spark, d):
    return rounded(P.profile(*profile_inputs(spark, d), GRID, n=20, method="cutting_plane", dilation=1, least=1, image_on=[]), "mean", "std")


@query()
def t4_weighted(spark, d):
    return rounded(P.profile(*profile_inputs(spark, d), GRID, n=20, method="weighted", dilation=1, least=1, image_on=[]), "mean", "std")


@query(sql("+s AS (SELECT *, " + ", ".join(f"abs{cos_sql(el('pred'), el('cand', 3 * k))} AS c{k}" for k in range(3)) + f", {N3.format('pred')} AS n FROM vectors), t AS (SELECT *, CASE WHEN c0>=c1 AND c0>=c2 THEN 0 WHEN c1>=c2 THEN 3 ELSE 6 END AS o FROM s) SELECT vec_id, CASE WHEN n<1e-5 THEN 0 ELSE round(sqrt(cand[o+1]**2+cand[o+2]**2+cand[o+3]**2),6) END AS value FROM t", "vectors"))
def t5_peak_length(spark, d):
    return P.peak_length_image(fx.vectors(spark, d)).select("vec_id", r6("value"))


@query(sql("SELECT bundle,position,grp,round(avg(mean),6) AS m,round(avg(mean)-1.96*stddev_samp(mean)/sqrt(count(*)),6) AS low,round(avg(mean)+1.96*stddev_samp(mean)/sqrt(count(*)),6) AS high,count(*) AS n FROM profiles JOIN cohort USING (subject) GROUP BY ALL", "profiles", "cohort"))
def t6_profile_band(spark, d):
    return rounded(P.profile_band(fx.profiles(spark, d), fx.cohort(spark, d)), "m", "low", "high")


@query(sql("SELECT bundle,position,round(avg(mean),6) AS mean,count(*) AS n FROM profiles GROUP BY ALL", "profiles"))
def t7_mean_profile(spark, d):
    return rounded(P.mean_profile(fx.profiles(spark, d)), "mean")


# Cohort tests


@query(sql("+j AS (SELECT * FROM profiles JOIN cohort USING (subject)), s AS (SELECT bundle,position,regr_slope(mean,age) AS b FROM j GROUP BY ALL ) SELECT subject,j.bundle,j.position,round((mean-coalesce(b*age,0))*pi(),6) AS mean FROM j JOIN s USING (bundle,position)", "profiles", "cohort"))
def c1_unconfound(spark, d):
    """Times pi, so that no value lies on a rounding tie."""
    out = C.unconfound(fx.profiles(spark, d), fx.cohort(spark, d), ["age"])
    return out.select("subject", "bundle", "position", F.round(F.col("mean") * F.pi(), 6).alias("mean"))


TSTAT = "CASE WHEN n0>0 AND n1>0 AND n0+n1>2 AND (n0*v0+n1*v1)>1e-18 THEN (m0-m1)/sqrt((n0*v0+n1*v1)/(n0+n1-2)*(1.0/n0+1.0/n1)) END"
GROUPED = "count(*) FILTER ({g}=0) AS n0,count(*) FILTER ({g}=1) AS n1,avg(mean) FILTER ({g}=0) AS m0,avg(mean) FILTER ({g}=1) AS m1,var_pop(mean) FILTER ({g}=0) AS v0,var_pop(mean) FILTER ({g}=1) AS v1"


@query(sql("+a AS (SELECT bundle,position," + GROUPED.format(g="grp") + " FROM profiles JOIN cohort USING (subject) GROUP BY ALL) SELECT bundle,position,round(" + TSTAT + ",5) AS t,n0+n1-2 AS df FROM a", "profiles", "cohort"))
def c2_ttest_ind(spark, d):
    return C.ttest_ind(fx.profiles(spark, d), fx.cohort(spark, d)).select("bundle", "position", F.round("t", 5).alias("t"), "df")


@query(sql("SELECT bundle,position,round(corr(mean,target),5) AS r,count(*) AS n FROM profiles JOIN cohort USING (subject) GROUP BY ALL", "profiles", "cohort"))
def c3_pearson(spark, d):
    return C.pearson(fx.profiles(spark, d), fx.cohort(spark, d)).select("bundle", "position", F.round("r", 5).alias("r"), "n")


def perms_sql(seed: int, n: int, column: str = "grp") -> str:
    return f"places AS (SELECT row_number() OVER (ORDER BY subject) AS k,{column} AS label FROM cohort), perms AS (SELECT perm,subject,label FROM (SELECT CAST(p AS INT) AS perm,subject,row_number() OVER (PARTITION BY p ORDER BY md5('{seed}:' || p || ':' || subject),subject) AS k FROM cohort, range({n}) r(p)) JOIN places USING (k))"


PERMS = perms_sql(3, 20)


@query(sql("+" + PERMS + " SELECT * FROM perms", "cohort"))
def c4_permutations(spark, d):
    return C.permutations(fx.cohort(spark, d), 20, 3, "grp")


def shuffled_sql(seed: int, n: int, mode: str = "group", profiles: str = "profiles", cohort: str = "cohort") -> str:
    """``pt(perm,bundle,position,t,v)``: the permutations' statistics and degrees of freedom, ``pp`` with p; ``st``, ``sp``: the real ones."""
    if mode == "group":
        stat = lambda g, by, rows: f"SELECT {by}bundle,position,{TSTAT} AS t,n0+n1-2 AS v FROM (SELECT {by}bundle,position,{GROUPED.format(g=g)} FROM {rows} GROUP BY ALL)"
        t = "t"
    else:
        stat = lambda g, by, rows: f"SELECT {by}bundle,position,corr(mean,{g}) AS t,count(*)-2 AS v FROM {rows} GROUP BY ALL"
        t = "(t*sqrt(v/(1-t*t)))"
    label = "grp" if mode == "group" else "target"
    p = T2P.format(t=t, v="v")
    perms = perms_sql(seed, n, label).replace("FROM cohort", f"FROM {cohort}")
    return f"{perms}, pt AS ({stat('label', 'perm,', f'{profiles} JOIN perms USING (subject)')}), pp AS (SELECT *, {p} AS p FROM pt WHERE t IS NOT NULL), st AS ({stat(label, '', f'{profiles} JOIN {cohort} USING (subject)')}), sp AS (SELECT *, {p} AS p FROM st WHERE t IS NOT NULL)"


@query(sql("+" + PERMS + ", a AS (SELECT perm,bundle,position," + GROUPED.format(g="label") + " FROM profiles JOIN perms USING (subject) GROUP BY ALL) SELECT perm,bundle,position,round(" + TSTAT + ",5)+0.0 AS t,n0+n1-2 AS df FROM a", "profiles", "cohort"))
def c5_permutation_stats(spark, d):
    perms = C.permutations(fx.cohort(spark, d), 20, 3, "grp")
    return C.permutation_stats(fx.profiles(spark, d), perms, "group").select("perm", "bundle", "position", (F.round("t", 5) + F.lit(0.0)).alias("t"), "df")


EXTREMES = "SELECT bundle,perm,CAST(v AS INT) AS df,round(max(coalesce(t,0)),5)+0.0 AS stat_max,round(min(coalesce(t,0)),5)+0.0 AS stat_min,round(max(abs(coalesce(t,0))),5)+0.0 AS abs_max FROM pt GROUP BY ALL"


def extremes(spark, d, mode: str):
    out = C.permutation_matrix(fx.profiles(spark, d), fx.cohort(spark, d), "grp" if mode == "group" else "target", 20, 3, mode, family=["bundle"])
    return out.select("bundle", "perm", "df", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("stat_max", "stat_min", "abs_max")))


@query(sql("+" + shuffled_sql(3, 20) + " " + EXTREMES, "profiles", "cohort"))
def c5_permutation_matrix(spark, d):
    return extremes(spark, d, "group")


@query(sql("+" + shuffled_sql(3, 20, "correlation") + " " + EXTREMES, "profiles", "cohort"))
def c5_permutation_matrix_r(spark, d):
    return extremes(spark, d, "correlation")


def picked_sql(rows: str, value: str, at: int, family: str = "bundle,") -> str:
    """The value at place ``at`` in each family of ``rows(bundle, perm, value)``."""
    over = f"PARTITION BY {family.rstrip(',')} " if family else ""
    return f"SELECT {family}{value} FROM (SELECT *, row_number() OVER ({over}ORDER BY {value},perm)-1 AS r_ FROM {rows}) WHERE r_={at}"


@query(sql("+" + shuffled_sql(3, 200) + ", m AS (SELECT bundle,perm,-max(coalesce(t,0)) AS neg FROM pt GROUP BY ALL), k AS (" + picked_sql("m", "neg", 10) + ") SELECT bundle,round(-neg,5) AS stat_fwe FROM k", "profiles", "cohort"))
def c6_stat_fwe(spark, d):
    e = C.permutation_matrix(fx.profiles(spark, d), fx.cohort(spark, d), "grp", 200, 3, "group", family=["bundle"])
    return C.stat_fwe(e, 0.05, 200, ["bundle"]).withColumn("stat_fwe", F.round("stat_fwe", 5))


ALPHA = ", m AS (SELECT {family}perm,min(p) AS p FROM pp GROUP BY ALL), k AS ({picked})"


@query(sql("+" + shuffled_sql(3, 200) + ALPHA.format(family="bundle,", picked=picked_sql("m", "p", 10)) + " SELECT bundle,round(p,6) AS alpha_fwe FROM k", "profiles", "cohort"))
def c6_alpha_fwe(spark, d):
    e = C.permutation_matrix(fx.profiles(spark, d), fx.cohort(spark, d), "grp", 200, 3, "group", family=["bundle"])
    return C.alpha_fwe(e, 0.05, 200, ["bundle"]).withColumn("alpha_fwe", F.round("alpha_fwe", 6))


def clusters_sql(rows: str, key: str, alpha: float) -> str:
    """``m``: the longest run of p < alpha, plus one, for each ``key`` of ``rows(.., position, p)``; its negative."""
    return f", isl AS (SELECT *, position-row_number() OVER (PARTITION BY {key} ORDER BY position) AS g FROM {rows} WHERE p<{alpha}), runs AS (SELECT {key},g,count(*) AS n FROM isl GROUP BY ALL), m AS (SELECT {key},-coalesce(max(n)+1,1) AS neg FROM (SELECT DISTINCT {key} FROM {rows}) LEFT JOIN runs USING ({key}) GROUP BY ALL)"


@query(sql("+" + shuffled_sql(3, 50) + clusters_sql("pp", "bundle,perm", 0.05) + ", k AS (" + picked_sql("m", "neg", 2) + ") SELECT bundle,-neg AS cluster_fwe FROM k", "profiles", "cohort"))
def c6_cluster_fwe(spark, d):
    return C.corrected_threshold(fx.profiles(spark, d), fx.cohort(spark, d), 50, 0.05, 3, False, "group", "cluster").select("bundle", F.col("cluster_fwe").cast("long").alias("cluster_fwe"))


BEST = "best AS (SELECT bundle,p,t FROM (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY p,position) AS r FROM sp) WHERE r=1)"
TABLE = "SELECT bundle," + FMT.format(x="k.p") + ' AS "alphaFWE",' + FMT.format(x="best.p") + " AS min_pvalue," + FMT.format(x="t") + " AS t_value FROM best "


@query(sql("+" + shuffled_sql(1, 1000) + ALPHA.format(family="", picked=picked_sql("m", "p", 50, "")) + f", {BEST} {TABLE}, k", "profiles", "cohort"))
def c7_c8_result_table(spark, d):
    return C.cohort_test(fx.profiles(spark, d), fx.cohort(spark, d), 1000, joint=True)


@query(sql("+" + shuffled_sql(1, 200) + ALPHA.format(family="bundle,", picked=picked_sql("m", "p", 10)) + f", {BEST} {TABLE} JOIN k USING (bundle)", "profiles", "cohort"))
def c8_result_table_by_bundle(spark, d):
    return C.cohort_test(fx.profiles(spark, d), fx.cohort(spark, d), 200, joint=False)


@query(sql("+" + shuffled_sql(1, 200, "correlation") + ALPHA.format(family="bundle,", picked=picked_sql("m", "p", 10)) + f", {BEST} {TABLE} JOIN k USING (bundle)", "profiles", "cohort"))
def c8_correlation_table(spark, d):
    return C.cohort_test(fx.profiles(spark, d), fx.cohort(spark, d), 1000, joint=False, mode="correlation")


JOINED = ", begins AS (SELECT bundle,coalesce(sum(hi) OVER (ORDER BY bundle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS b FROM (SELECT bundle,max(position)+1 AS hi FROM pt GROUP BY 1)), one AS (SELECT perm,position+b AS position,p FROM pp JOIN begins USING (bundle))"


@query(sql("+" + shuffled_sql(1, 50) + JOINED + clusters_sql("one", "perm", 0.05) + f", k AS ({picked_sql('m', 'neg', 2, '')}), {BEST} SELECT bundle,CAST(-neg AS BIGINT) AS \"clusterFWE\"," + FMT.format(x="t") + " AS t_value FROM best, k", "profiles", "cohort"))
def c7_cluster_table(spark, d):
    return C.cohort_test(fx.profiles(spark, d), fx.cohort(spark, d), 50, correction="cluster").withColumn("clusterFWE", F.col("clusterFWE").cast("long"))


def determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    minors = [determinant([r[:k] + r[k + 1 :] for r in m[1:]]) for k in range(len(m))]
    return "(" + "".join(("+" if k % 2 == 0 else "-") + f"{m[0][k]}*{d}" for k, d in enumerate(minors)) + ")"


def unconfounded_sql(name: str, rows: str, by: str, value: str, confounds: list[str], group: str | None = None) -> str:
    """``name``: ``rows(subject, by.., value)`` with the confounds' slopes taken out, by Cramer's rule on each cell's normal equations."""
    x = [*confounds, *([group] if group else [])]
    s = [[f"covar_pop({a},{b})" for b in x] for a in x]
    y = [f"covar_pop({a},{value})" for a in x]
    slopes = ",".join(f"{determinant([r[:k] + [y[i]] + r[k + 1 :] for i, r in enumerate(s)])}/{determinant(s)} AS b{k}" for k in range(len(confounds)))
    fitted = "+".join(f"b{k}*{c}" for k, c in enumerate(confounds))
    others = "" if value != "target" else ",grp,age,sex"
    keys = f"{by}," if by else ""
    return f"{name}_j AS (SELECT * FROM {rows}), {name}_b AS (SELECT {keys}{slopes} FROM {name}_j GROUP BY ALL), {name} AS (SELECT subject,{keys}{value}-({fitted}) AS {value}{others} FROM {name}_j JOIN {name}_b {'USING (' + by + ')' if by else 'ON true'})"


CORRECTED = unconfounded_sql("pc", "profiles JOIN cohort USING (subject)", "bundle,position", "mean", ["age", "sex"], "grp")
CORRECTED_R = unconfounded_sql("pc", "profiles JOIN cohort USING (subject)", "bundle,position", "mean", ["age", "sex"]) + ", " + unconfounded_sql("cc", "cohort", "", "target", ["age", "sex"])


@query(sql("+" + CORRECTED + ", " + shuffled_sql(1, 200, profiles="pc") + ALPHA.format(family="", picked=picked_sql("m", "p", 10, "")) + f", {BEST} {TABLE}, k", "profiles", "cohort"))
def c8_confounded_table(spark, d):
    return C.cohort_test(fx.profiles(spark, d), fx.cohort(spark, d), 200, confounds=["age", "sex"])


@query(sql("+" + CORRECTED_R + ", " + shuffled_sql(1, 200, "correlation", "pc", "cc") + ALPHA.format(family="bundle,", picked=picked_sql("m", "p", 10)) + f", {BEST} {TABLE} JOIN k USING (bundle)", "profiles", "cohort"))
def c8_confounded_correlation(spark, d):
    return C.cohort_test(fx.profiles(spark, d), fx.cohort(spark, d), 1000, joint=False, mode="correlation", confounds=["age", "sex"])


@query(sql("+" + shuffled_sql(1, 100) + ALPHA.format(family="bundle,", picked=picked_sql("m", "p", 5)) + " SELECT bundle,st.position,coalesce(CAST(sp.p<=k.p AS INT),0) AS significant,round(-log10(sp.p),5)+0.0 AS detail FROM st LEFT JOIN sp USING (bundle,position) JOIN k USING (bundle)", "profiles", "cohort"))
def c9_significant_mask(spark, d):
    p, c = fx.profiles(spark, d), fx.cohort(spark, d)
    found = C.significant_mask(C.ttest_ind(p, c), C.corrected_threshold(p, c, 100, 0.05, 1, False, "group", "alpha"))
    return found.select("bundle", "position", "significant", (F.round("detail", 5) + F.lit(0.0)).alias("detail"))


@query(sql("+" + shuffled_sql(1, 40) + clusters_sql("pp", "bundle,perm", 0.2) + f", k AS ({picked_sql('m', 'neg', 8)}), hits AS (SELECT *, position-row_number() OVER (PARTITION BY bundle ORDER BY position) AS g FROM sp WHERE p<=0.2), long_ AS (SELECT bundle,position,count(*) OVER (PARTITION BY bundle,g) AS n FROM hits) SELECT bundle,st.position,CAST(coalesce(n>=-neg,false) AS INT) AS significant FROM st JOIN k USING (bundle) LEFT JOIN long_ USING (bundle,position)", "profiles", "cohort"))
def c9_significant_clusters(spark, d):
    p, c = fx.profiles(spark, d), fx.cohort(spark, d)
    return C.significant_mask(C.ttest_ind(p, c), C.corrected_threshold(p, c, 40, 0.2, 1, False, "group", "cluster"), 0.2).select("bundle", "position", "significant")


# Scores


PAIRED = "j AS (SELECT bundle,subject,x,y,z,CAST(value>0.5 AS INT) AS pred,CAST((x*7+y*3+z)%5<2 AS INT) AS truth,value AS prob FROM voxels)"


def paired(spark, d):
    v = fx.voxels(spark, d)
    return v.select("bundle", "subject", *C3, (F.col("value") > 0.5).cast("int").alias("pred"), ((F.col("x") * 7 + F.col("y") * 3 + F.col("z")) % 5 < 2).cast("int").alias("truth"), F.col("value").alias("prob"))


@query(sql(f"+{PAIRED} SELECT subject,round(2*sum(pred*truth)/(sum(pred)+sum(truth)+1e-6),6) AS dice FROM j GROUP BY 1", "voxels"))
def m1_dice(spark, d):
    return rounded(M.dice(paired(spark, d), ["subject"]), "dice")


@query(sql(f"+{PAIRED} SELECT round(avg(f),6) AS dice FROM (SELECT bundle,2*sum(pred*truth)/(sum(pred)+sum(truth)+1e-6) AS f FROM j GROUP BY 1)", "voxels"))
def m2_dice_macro(spark, d):
    return rounded(M.dice_macro(paired(spark, d), "bundle"), "dice")


@query(sql(f"+{PAIRED} SELECT bundle,round(avg(f),6) AS f1 FROM (SELECT bundle,subject,CASE WHEN sum(pred)+sum(truth)>0 THEN 2*sum(pred*truth)/(sum(pred)+sum(truth)) ELSE 0 END AS f FROM j GROUP BY 1,2) GROUP BY 1", "voxels"))
def m3_dice_per_bundle(spark, d):
    return rounded(M.dice_per_bundle(paired(spark, d)), "f1")


@query(sql(f"+{PAIRED} SELECT subject,round(1-avg(f),6) AS soft_dice FROM (SELECT subject,bundle,2*sum(prob*truth)/(sum(prob+truth)+1e-6) AS f FROM j GROUP BY 1,2) GROUP BY 1", "voxels"))
def m4_soft_dice(spark, d):
    return rounded(M.soft_dice(paired(spark, d), ["subject"], "bundle"), "soft_dice")


@query(sql(f"+{PAIRED} SELECT subject,bundle,round(CASE WHEN sum(truth)>0 THEN sum(pred*truth)/sum(truth) ELSE 0 END,6) AS overlap,round(CASE WHEN sum(truth)>0 THEN sum(pred*(1-truth))/sum(truth) ELSE 0 END,6) AS overreach FROM j GROUP BY ALL", "voxels"))
def m5_overlap_overreach(spark, d):
    return rounded(M.overlap_overreach(paired(spark, d), ["subject", "bundle"]), "overlap", "overreach")


def vec_pairs(spark, d):
    return fx.vectors(spark, d).withColumn("truth", F.slice("cand", 1, 3))


@query(sql("+j AS (SELECT bundle,CAST(abs(pred[1])+abs(pred[2])+abs(pred[3])>0.2 AS INT) AS p,CAST(abs(cand[1])+abs(cand[2])+abs(cand[3])>1e-3 AS INT) AS t FROM vectors) SELECT bundle,round(2*sum(p*t)/(sum(p)+sum(t)+1e-6),6) AS dice FROM j GROUP BY 1", "vectors"))
def m6_vector_dice_seg(spark, d):
    return rounded(M.vector_dice_seg(vec_pairs(spark, d), ["bundle"]), "dice")


ANGLE = f"j AS (SELECT bundle,thr,CAST(abs{cos_sql(el('pred'), el('cand'))}>thr{{more}} AS INT) AS p,CAST(cand[1]+cand[2]+cand[3]>0 AS INT) AS t FROM vectors, (VALUES (0.3),(0.7)) q(thr))"


@query(sql("+" + ANGLE.format(more="") + " SELECT CAST(thr AS DOUBLE) AS thr,bundle,round(2*sum(p*t)/(sum(p)+sum(t)+1e-6),6) AS dice FROM j GROUP BY ALL", "vectors"))
def m7_vector_dice_angle(spark, d):
    return rounded(M.vector_dice_angle(vec_pairs(spark, d), ["bundle"], [0.3, 0.7]), "dice")


@query(sql("+" + ANGLE.format(more=f" AND abs({N3.format('pred')}-sqrt(cand[1]**2+cand[2]**2+cand[3]**2))<0.5*sqrt(cand[1]**2+cand[2]**2+cand[3]**2)") + " SELECT CAST(thr AS DOUBLE) AS thr,bundle,round(2*sum(p*t)/(sum(p)+sum(t)+1e-6),6) AS dice FROM j GROUP BY ALL", "vectors"))
def m8_vector_dice_length(spark, d):
    return rounded(M.vector_dice_angle(vec_pairs(spark, d), ["bundle"], [0.3, 0.7], length=0.5), "dice")


@query(sql(f"+j AS (SELECT bundle,abs{cos_sql(el('pred'), el('cand'))} AS c,abs({N3.format('pred')}-sqrt(cand[1]**2+cand[2]**2+cand[3]**2)) AS o,(pred[1]-cand[1])**2+(pred[2]-cand[2])**2+(pred[3]-cand[3])**2 AS s FROM vectors) SELECT bundle,round(avg(1-c),6) AS angle,round(avg(1-c+o),6) AS angle_length,round(avg(s),6) AS l2,round(avg(2*s)/3,6) AS mse_weighted FROM j GROUP BY 1", "vectors"))
def m9_vector_scores(spark, d):
    return rounded(M.vector_scores(vec_pairs(spark, d), ["bundle"], weight=F.lit(2.0)), "angle", "angle_length", "l2", "mse_weighted")


@query(sql("SELECT run,split,epoch,metric,round(avg(value),6) AS mean,count(*) AS batches FROM metrics_log GROUP BY ALL", "metrics_log"))
def m10_epoch_summary(spark, d):
    return rounded(M.epoch_summary(fx.metrics_log(spark, d)), "mean")


@query(sql("+a AS (SELECT subject,x,y,z,value FROM voxels WHERE bundle='A'), b AS (SELECT subject,x,y,z,value FROM voxels WHERE bundle='N') SELECT CAST(count(*) FILTER (abs(coalesce(a.value,0)-coalesce(b.value,0))>0.2) AS BIGINT) AS differing,round(max(abs(coalesce(a.value,0)-coalesce(b.value,0))),6) AS largest FROM a FULL OUTER JOIN b USING (subject,x,y,z)", "voxels"))
def m11_compare_images(spark, d):
    v = fx.voxels(spark, d)
    return rounded(M.compare_images(v.where("bundle = 'A'"), v.where("bundle = 'N'"), ["subject", *C3], 0.2), "largest")


# Regions


HITS = """cell AS (SELECT subject,bundle,line_id,pos,CAST(trunc(x) AS INT) AS x,CAST(trunc(y) AS INT) AS y FROM line_points), ends AS (SELECT subject,bundle,line_id,min(pos) AS a,max(pos) AS b FROM cell GROUP BY ALL),
 lr AS (SELECT e.subject,e.bundle,e.line_id,coalesce(list_sort(list(DISTINCT region) FILTER (region IS NOT NULL)),[]) AS regions,min(region) FILTER (pos=a) AS start_region,min(region) FILTER (pos=b) AS end_region FROM ends e LEFT JOIN cell c USING (subject,bundle,line_id) LEFT JOIN regions r USING (x,y) GROUP BY ALL)"""


def line_regions(spark, d):
    return R.line_regions(fx.line_points(spark, d), fx.regions(spark, d), ["x", "y"])


@query(sql(f"+{HITS} SELECT * FROM lr", "line_points", "regions"))
def r1_line_regions(spark, d):
    return line_regions(spark, d)


@query(sql(f"+{HITS} SELECT subject,bundle,line_id FROM lr WHERE list_has_any(regions,['A_left']) AND list_has_any(regions,['N_left','R_right'])", "line_points", "regions"))
def r2_traverses(spark, d):
    return line_regions(spark, d).where(R.traverses("A_left") & R.traverses("N_left", "R_right")).select(*L.LINE)


@query(sql(f"+{HITS} SELECT subject,bundle,line_id FROM lr WHERE start_region IN ('A_left','A_right') OR end_region IN ('A_left','A_right')", "line_points", "regions"))
def r3_endpoints_in(spark, d):
    return line_regions(spark, d).where(R.endpoints_in("A_left", "A_right")).select(*L.LINE)


@query(sql(f"+{HITS} SELECT subject,bundle,line_id FROM lr WHERE len(list_filter(regions, lambda r: r NOT IN ('N_left','N_right')))=0", "line_points", "regions"))
def r4_only(spark, d):
    return line_regions(spark, d).where(R.only("N_left", "N_right")).select(*L.LINE)


@query(sql(f"+{HITS} SELECT subject,bundle,line_id FROM lr WHERE NOT list_has_any(regions,['R_left'])", "line_points", "regions"))
def r5_avoids(spark, d):
    return line_regions(spark, d).where(R.avoids("R_left")).select(*L.LINE)


@query(sql("SELECT subject,bundle,line_id FROM line_points GROUP BY ALL HAVING max(y) < (SELECT min(y) FROM regions WHERE region='A_left' AND y>=20)", "line_points", "regions"))
def r6_posterior_of(spark, d):
    regions = fx.regions(spark, d).where((F.col("region") != "A_left") | (F.col("y") >= 20)).withColumn("z", F.lit(0))
    return R.side_of(fx.line_points(spark, d), regions, "A_left", "posterior_of")


@query(sql("SELECT replace(region,'_left','_right') AS region, bundle FROM (SELECT DISTINCT region, split_part(region,'_',1)||'_right' AS bundle FROM regions WHERE region LIKE '%_left') UNION ALL SELECT DISTINCT region, split_part(region,'_',1)||'_left' FROM regions WHERE region LIKE '%_left'", "regions"))
def r7_expand_sides(spark, d):
    left = R.region_set(fx.regions(spark, d), "*_left").select(F.split("region", "_")[0].alias("bundle")).distinct()
    return R.expand_sides(left.select("bundle", F.concat("bundle", F.lit(".side")).alias("region")))


# Data preparation


@query(sql("+raw AS (SELECT subject,bundle AS image,x,y,z,value FROM voxels), box AS (SELECT subject,min(x) AS x0,min(y) AS y0,min(z) AS z0,max(x) AS x1,max(y) AS y1,max(z) AS z1 FROM raw WHERE image='R' AND value<>0 GROUP BY 1) SELECT subject,image,CAST(x-x0 AS INT) AS x,CAST(y-y0 AS INT) AS y,CAST(z-z0 AS INT) AS z,value,0 AS channel FROM raw JOIN box USING (subject) WHERE value<>0 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1", "voxels"))
def d1_prepare_dataset(spark, d):
    return D.prepare_dataset(fx.voxels(spark, d).withColumnRenamed("bundle", "image"), "R").select("subject", "image", *C3, "value", "channel")


@query(sql("+s AS (SELECT subject,x FROM (SELECT subject,x,row_number() OVER (PARTITION BY subject ORDER BY md5('4:' || subject || ':' || x),subject,x) AS r FROM (SELECT DISTINCT subject,x FROM voxels)) WHERE r<=5) SELECT v.* FROM voxels v SEMI JOIN s USING (subject,x)", "voxels"))
def d2_training_slices(spark, d):
    return D.training_slices(fx.voxels(spark, d), 5, "x", 4).select(*I, *C3, "value")


@query(sql("+h AS (SELECT vec_id,pred,floor(" + HASH.format("'1:axis:' || (vec_id//10)") + "*3) AS axis," + HASH.format("'1:flip:' || vec_id") + "<0.5 AS f FROM vectors) SELECT vec_id,[" + ",".join(f"round(CASE WHEN f AND axis={k} THEN -pred[{k + 1}] ELSE pred[{k + 1}] END,6)+0.0" for k in range(3)) + "] AS v FROM h", "vectors"))
def d3_augment_flip(spark, d):
    v = fx.vectors(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 10))
    return D.augment_flip_vectors(v, 1, key="vec_id", v="pred").select("vec_id", r6v("pred", "v"))


@query(sql("+h AS (SELECT vec_id,pred,(" + HASH.format("'1:angle:' || vec_id") + "*2-1)*0.8 AS a FROM vectors) SELECT vec_id,[round(cos(a)*pred[1]+sin(a)*pred[2],6)+0.0,round(-sin(a)*pred[1]+cos(a)*pred[2],6)+0.0,round(pred[3],6)+0.0] AS v FROM h", "vectors"))
def d4_augment_rotate(spark, d):
    return D.augment_rotate_vectors(fx.vectors(spark, d), 1, 0.8, "vec_id", "pred").select("vec_id", r6v("pred", "v"))


@query(sql("+h AS (SELECT *, " + HASH.format("'1:var:' || subject") + "*0.05 AS var_," + HASH.format("'1:u:' || subject || ':' || x || ':' || y || ':' || z") + " AS u," + HASH.format("'1:a:' || subject || ':' || x || ':' || y || ':' || z") + " AS a FROM voxels) SELECT subject,bundle,x,y,z,round(value+sqrt(var_)*sqrt(-2*ln(greatest(u,1e-12)))*cos(2*pi()*a),6)+0.0 AS value FROM h", "voxels"))
def d5_augment_noise(spark, d):
    return rounded(D.augment_noise(fx.voxels(spark, d), 1), "value")


@query(sql("SELECT subject,bundle," + ",".join("CAST(CASE WHEN " + HASH.format(f"'1:{c}:' || subject") + f"<0.5 THEN 49-{c} ELSE {c} END AS INT) AS {c}" for c in "xyz") + ",value FROM voxels", "voxels"))
def d6_augment_mirror(spark, d):
    return D.augment_mirror(fx.voxels(spark, d), 1, GRID)


@query(sql("+" + nearest(50, 25, "m") + ", " + nearest(25, 50, "w") + " SELECT subject,bundle,p.o AS x,q.o AS y,r.o AS z,value FROM voxels JOIN m a ON a.i=x JOIN m b ON b.i=y JOIN m c ON c.i=z JOIN w p ON p.i=a.o JOIN w q ON q.i=b.o JOIN w r ON r.i=c.o", "voxels"))
def d7_augment_downsample(spark, d):
    return D.augment_downsample(fx.voxels(spark, d), GRID, 0.5)


def stub_model(pdf):
    """Stands for a network: a cell's probability grows with its value."""
    return pdf.assign(prob=(pdf["value"] * 0.9).clip(0, 1))[["bundle", "x", "y", "z", "prob"]]


@query(sql("SELECT subject,bundle,x,y,z,CAST(k AS INT) AS direction,0 AS sample,round(least(greatest(value*0.9,0),1),6) AS prob FROM voxels, range(1,4) r(k)", "voxels"))
def d8_batch_score(spark, d):
    return rounded(D.batch_score(fx.voxels(spark, d), stub_model), "prob")


def noisy_model(pdf, seed):
    return pdf.assign(prob=pdf["value"] * 0.5 + seed / 2**33)


SEEDED = "(concat('0x',substr(md5('5:'||subject||':'||k||':'||CASE k WHEN 1 THEN x WHEN 2 THEN y ELSE z END||':'||s),1,8))::BIGINT)"


@query(sql(f"+p AS (SELECT *,value*0.5+{SEEDED}/8589934592.0 AS prob FROM voxels, range(1,4) r(k), range(4) q(s)), f AS (SELECT subject,bundle,x,y,z,s,sum(prob)/3 AS prob FROM p GROUP BY ALL) SELECT subject,bundle,x,y,z,round(stddev_pop(prob),6)+0.0 AS value FROM f GROUP BY ALL", "voxels"))
def d8_uncertainty(spark, d):
    """Four stochastic samples of each slice, fused over the axes, and their spread."""
    pred = D.batch_score(fx.voxels(spark, d), noisy_model, samples=4, seed=5)
    fused = D.mean_fusion(pred, probs=True, by=[*I, *C3, "sample"]).withColumnRenamed("value", "prob")
    return rounded(D.uncertainty(fused), "value")


@query()
def d9_segment(spark, d):
    return D.segment(fx.voxels(spark, d), stub_model, GRID, 36, {}, 1)


@query(sql("SELECT subject,bundle,x,y,z,value*2 AS value,CAST(CASE bundle WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT) AS channel FROM voxels", "voxels"))
def d10_multi_part(spark, d):
    return D.multi_part(fx.voxels(spark, d), {"one": ["A", "N"], "two": ["R"]}, lambda part: part.withColumn("value", F.col("value") * 2)).select(*I, *C3, "value", "channel")


def flagship(spark, d):
    """Polylines to profiles to a corrected cohort test: subjects by parity in two groups, all bundles at once."""
    from .stash import stash

    found = stash(P.profile(*profile_inputs(spark, d), GRID, n=20, dilation=1, least=1, image_on=[]), "profiles")
    cohort = found.select("subject").distinct().withColumn("grp", F.col("subject") % 2)
    return C.cohort_test(found.select("subject", "bundle", "position", "mean"), cohort, 1000)


@query()
def flagship_cohort_profiles(spark, d):
    return flagship(spark, d)
