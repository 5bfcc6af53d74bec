"""Queries of the other forms of operators that :mod:`catalog` and :mod:`catalog_more` have in one form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import dataset as D
from ..operators import metrics as M
from ..operators import profiles as P
from ..operators import regions as R
from ..operators import voxels as V
from . import fixtures as fx
from .catalog import C3, HASH, I, N3, cos_sql, el, query, r6, r6v, rounded
from .catalog_more import HITS, line_regions
from .fixtures import sql


@query(sql("SELECT subject,x,y,z," + ",".join(f"CAST(label={k} AS INT) AS is_{k}" for k in (1, 2, 3)) + " FROM (SELECT subject,x,y,z,max(CASE bundle WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS label FROM voxels WHERE value>0 GROUP BY ALL)", "voxels"))
def p12_one_hot(spark, d):
    return V.to_one_hot(V.to_label_map(fx.voxels(spark, d), ["A", "N", "R"]), [1, 2, 3])


@query(sql("+a AS (SELECT DISTINCT subject,x,y,z FROM mask WHERE bundle<>'R'), b AS (SELECT DISTINCT subject,x,y,z FROM mask WHERE bundle<>'A'), j AS (SELECT subject,x,y,z,CAST(a.subject IS NOT NULL AS INT) AS pred,CAST(b.subject IS NOT NULL AS INT) AS truth FROM a FULL OUTER JOIN b USING (subject,x,y,z)) SELECT subject,round(2*sum(pred*truth)/(sum(pred)+sum(truth)+1e-6),6) AS dice FROM j GROUP BY 1", "mask"))
def m3_masks_joined(spark, d):
    m = fx.mask(spark, d)
    return rounded(M.dice(M.masks_joined(m.where("bundle <> 'R'"), m.where("bundle <> 'A'"), ["subject", *C3]), ["subject"]), "dice")


@query(sql("SELECT run,epoch,round(avg(value*(10-9*least(epoch/20.0,1))),6) AS weighted FROM metrics_log GROUP BY ALL", "metrics_log"))
def m10_loss_weight(spark, d):
    log = fx.metrics_log(spark, d)
    return log.groupBy("run", "epoch").agg(r6(F.avg(F.col("value") * M.loss_weight(F.col("epoch"), 10.0, 1.0, 20)), "weighted"))


NOISE = "{c}+0.15*sqrt(-2*ln(greatest(" + HASH.format("'4:{c}:r:' || key") + ",1e-12)))*cos(2*pi()*" + HASH.format("'4:{c}:a:' || key") + ")"


@query(sql("+k AS (SELECT *, subject || ':' || bundle || ':' || x || ':' || y || ':' || z AS key FROM mask) SELECT subject,bundle," + ",".join(f"CAST({c} AS INT) AS {c}0,round({NOISE.replace('{c}', c)},5)+0.0 AS {c}" for c in "xyz") + " FROM k", "mask"))
def o4_jittered(spark, d):
    cells = fx.mask(spark, d).withColumns({f"{c}0": F.col(c) for c in C3}).withColumns({c: F.col(c).cast("double") for c in C3})
    return D.jittered(cells, 4, [*I, *(f"{c}0" for c in C3)]).select(*I, *(f"{c}0" for c in C3), *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in C3))


@query(sql("+r AS (SELECT subject,row_number() OVER (ORDER BY subject) AS k,count(*) OVER () AS n FROM cohort) SELECT subject,CASE WHEN k<=floor(n*0.7) THEN 'train' ELSE 'validate' END AS part FROM r", "cohort"))
def u3_prefix_split(spark, d):
    return D.prefix_split(fx.cohort(spark, d), 0.7)


TURNED = ["cos(a)*pred[1]+sin(a)*pred[2]", "-sin(a)*pred[1]+cos(a)*pred[2]", "pred[3]"]


@query(sql("+h AS (SELECT vec_id,pred,(" + HASH.format("'1:angle:' || vec_id") + "*2-1)*0.8 AS a FROM vectors), q AS (SELECT vec_id," + ",".join(f"{e} AS r{k}" for k, e in enumerate(TURNED)) + " FROM h) SELECT vec_id,[" + ",".join(f"round(r{i}*r{j},6)+0.0" for i in range(3) for j in range(i, 3)) + "] AS t FROM q", "vectors"))
def d4_augment_rotate_tensors(spark, d):
    v = fx.vectors(spark, d).select("vec_id", X.vec_to_tensor("pred").alias("t"))
    return D.augment_rotate_tensors(v, 1, 0.8, "vec_id").select("vec_id", r6v("t", "t"))


@query(sql("+s AS (SELECT *, " + ", ".join(f"abs{cos_sql(el('pred'), el('cand', 3 * k))} AS c{k}" for k in range(3)) + f", {N3.format('pred')} AS n FROM vectors), t AS (SELECT *, CASE WHEN c0>=c1 AND c0>=c2 THEN 0 WHEN c1>=c2 THEN 3 ELSE 6 END AS o FROM s) SELECT vec_id, CASE WHEN n<0.1 THEN 0 ELSE round(cand[o+1],6) END AS bx, CASE WHEN n<0.1 THEN 0 ELSE round(cand[o+3],6) END AS bz FROM t", "vectors"))
def j7_best_match_slots(spark, d):
    v = fx.vectors(spark, d)
    slots = v.select("vec_id", F.posexplode(F.array(*(F.slice("cand", 3 * k + 1, 3) for k in range(3)))).alias("slot", "v"))
    return P.best_match_slots(v.select("vec_id", "pred"), slots, 0.1, ["vec_id"]).select("vec_id", r6(F.col("best")[0], "bx"), r6(F.col("best")[2], "bz"))


DRAW = "CAST(floor(" + HASH.format("'6:' || r || ':' || subject") + "*3) AS INT)"


@query(sql(f"+m AS (SELECT bundle,position,grp,r,sum(w*mean)/nullif(sum(w),0) AS m FROM (SELECT *, {DRAW} AS w FROM profiles JOIN cohort USING (subject), range(50) t(r)) GROUP BY ALL) SELECT bundle,position,grp,round(avg(m)*pi(),6) AS m,round(quantile_cont(m,0.025)*pi(),6) AS low,round(quantile_cont(m,0.975)*pi(),6) AS high FROM m GROUP BY ALL", "profiles", "cohort"))
def t6_bootstrap_band(spark, d):
    """Times pi, so that no value lies on a rounding tie."""
    u = X.unit_hash("6", F.col("r"), F.col("subject"))
    band = P.bootstrap_band(fx.profiles(spark, d), fx.cohort(spark, d), F.floor(u * 3), 50)
    return band.select("bundle", "position", "grp", *(F.round(F.col(c) * F.pi(), 6).alias(c) for c in ("m", "low", "high")))


@query(sql(f"+{HITS} SELECT subject,bundle,line_id FROM lr WHERE start_region IN ('A_left','A_right','N_left') AND end_region IN ('A_left','A_right','N_left')", "line_points", "regions"))
def r3_both_endpoints_in(spark, d):
    return line_regions(spark, d).where(R.both_endpoints_in("A_left", "A_right", "N_left")).select("subject", "bundle", "line_id")


SIDES = {"anterior_of": "min(y) > (SELECT max(y) FROM regions WHERE region='N_right')", "superior_of": "min(z) > (SELECT max(z) FROM tall WHERE region='N_right')", "posterior_of": "max(y) < (SELECT min(y) FROM regions WHERE region='N_right')",
         "medial_of": "max(abs(x-(SELECT (min(x)+max(x))/2 FROM regions))) < (SELECT min(abs(x-(SELECT (min(x)+max(x))/2 FROM regions))) FROM regions WHERE region='N_right')"}


@query(sql("+tall AS (SELECT *, (x+y)%8 AS z FROM regions) " + " UNION ALL ".join(f"SELECT '{n}' AS relation,subject,bundle,line_id FROM line_points GROUP BY ALL HAVING {c}" for n, c in SIDES.items()), "line_points", "regions"))
def r6_all_sides(spark, d):
    regions = fx.regions(spark, d).withColumn("z", (F.col("x") + F.col("y")) % 8)
    found = [R.side_of(fx.line_points(spark, d), regions, "N_right", n).select(F.lit(n).alias("relation"), "subject", "bundle", "line_id") for n in SIDES]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
