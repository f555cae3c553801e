"""Scalar functions, geometry and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import features as X
from ..operators import rank_metrics as M
from ..operators import selection as S
from .fixtures import ATOMS, ITEMS, atoms, ranked_items, table
from .registry import query
from .resampling import draw_sql


def _r(c, n=6):
    return F.round(c, n)


def _sql(names_exprs: dict) -> str:
    return ", ".join(f"round({e}, 8) AS {n}" for n, e in names_exprs.items())


@query(f"WITH {ITEMS} SELECT g, idx, round(exp(-d / 10), 6) AS e, round(ln(1 + sb), 6) AS l, round(sqrt(d), 6) AS s, round(ln(greatest(least(sa, 1 - 1e-5), 1e-5) / (1 - greatest(least(sa, 1 - 1e-5), 1e-5))), 6) AS logit FROM items")
def x1_math(spark, sf_dir):
    from ..operators.calibration import logit

    return ranked_items(spark, sf_dir).select("g", "idx", _r(F.exp(-F.col("d") / 10)).alias("e"), _r(F.log1p("sb")).alias("l"), _r(F.sqrt("d")).alias("s"), _r(logit(F.col("sa"))).alias("logit"))


_CLIP = "greatest(least(sa * 9, 1.0), 0.0)"
_BASE = (
    {"distance": "greatest(least(d, 80.0), 0.0)", "log_distance": "ln(1 + greatest(least(d, 80.0), 0.0))"}
    | {f"prior_{X.tag(t)}": f"exp(-d / {t})" for t in X.TAUS}
    | {"score": _CLIP, "score_logit": f"ln(greatest(least({_CLIP}, 1 - 1e-5), 1e-5) / (1 - greatest(least({_CLIP}, 1 - 1e-5), 1e-5)))"}
    | {f"cross_{X.tag(t)}": f"{_CLIP} * exp(-d / {t})" for t in X.TAUS}
    | {"cross_inverse": f"{_CLIP} / (1 + d)"}
)


@query(f"WITH {ITEMS} SELECT g, idx, {_sql(_BASE)} FROM items")
def x2_distance_and_cross(spark, sf_dir):
    """The 12 distance, 2 score and 11 cross columns of the item matrix."""
    i = ranked_items(spark, sf_dir).withColumn("s", F.col("sa") * 9)
    out = X.item_matrix(i, ["g", "idx"], "s", "d", [])
    return out.select("g", "idx", *(_r(c, 8).alias(c) for c in out.columns[2:]))


@query(f"WITH {ITEMS} SELECT g, idx, round(0.55 * sa + 0.45 * exp(-d / 12), 6) AS fusion, -d AS raw_distance, round(exp(-d / 12), 6) AS prior FROM items")
def x3_fe6_fixed_fusion(spark, sf_dir):
    d = F.col("d")
    return ranked_items(spark, sf_dir).select("g", "idx", _r(0.55 * F.col("sa") + 0.45 * F.exp(-d / 12)).alias("fusion"), (-d).alias("raw_distance"), _r(F.exp(-d / 12)).alias("prior"))


_GRID = "grid AS (SELECT a / 4.0::DOUBLE AS alpha, t AS tau FROM range(5) x(a) CROSS JOIN (VALUES (4.0::DOUBLE), (12.0)) v(t))"


def _grid():
    return F.explode(F.array(*(F.struct(F.lit(a / 4).alias("alpha"), F.lit(t).alias("tau")) for a in range(5) for t in (4.0, 12.0)))).alias("p")


@query(
    f"""WITH {ITEMS}, {_GRID}, s AS (SELECT alpha, tau, y, round(alpha * sa + (1 - alpha) * exp(-d / tau), 9) AS s FROM items CROSS JOIN grid), t AS (SELECT alpha, tau, s, sum(y) AS tp, count(*) AS n FROM s GROUP BY ALL),
 w AS (SELECT alpha, tau, tp, sum(tp) OVER (PARTITION BY alpha, tau ORDER BY s DESC) AS ctp, sum(n) OVER (PARTITION BY alpha, tau ORDER BY s DESC) AS cn, sum(tp) OVER (PARTITION BY alpha, tau) AS p FROM t),
 a AS (SELECT alpha, tau, round(sum(tp::DOUBLE / p * (ctp::DOUBLE / cn)), 6) AS ap FROM w GROUP BY ALL) SELECT alpha, tau, ap, row_number() OVER (ORDER BY ap DESC, alpha, tau) AS place FROM a"""
)
def x4_ml10_grid_tuning(spark, sf_dir):
    """AP of each (alpha, tau) of a grid, in order; the first is the choice.  The grid is exploded, not joined."""
    s = ranked_items(spark, sf_dir).select("y", "sa", "d", _grid()).select("y", F.col("p.alpha").alias("alpha"), F.col("p.tau").alias("tau"), F.round(F.col("p.alpha") * F.col("sa") + (1 - F.col("p.alpha")) * F.exp(-F.col("d") / F.col("p.tau")), 9).alias("s"))
    a = M.average_precision(s, ["alpha", "tau"], "y", "s", pieces=None).select("alpha", "tau", _r(F.col("ap")).alias("ap"))
    return a.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("ap"), "alpha", "tau")).cast("bigint"))


_CENTRES = (2.0, 3.5, 5.0, 6.5, 8.0, 10.0, 12.0)


@query(f"WITH {ITEMS}, c AS (SELECT g, idx, greatest(least(d, 20.0), 0.0) AS d, sa * 50 AS e FROM items) SELECT g, idx, round(d / 20, 6) AS scaled, round(1 / (1 + d), 6) AS inverse, " + ", ".join(f"round(exp(-((d - {c}) * (d - {c})) / 4.5), 6) AS rbf_{i}" for i, c in enumerate(_CENTRES)) + ", " + ", ".join(f"round(exp(-((e - {i / 3!r}) * (e - {i / 3!r})) / (2 * {1 / 3!r} * {1 / 3!r})), 6) AS radial_{i}" for i in range(16)) + " FROM c")
def x5_radial_basis(spark, sf_dir):
    """Seven centres of width 1.5 on distances up to 20, and sixteen on [0, 5]."""
    d = F.greatest(F.least(F.col("d"), F.lit(20.0)), F.lit(0.0))
    i = ranked_items(spark, sf_dir, dealt=True).select("g", "idx", d.alias("d"), (F.col("sa") * 50).alias("e"))
    rbf, radial = G.radial_columns(F.col("d"), list(_CENTRES), 1.5), G.radial_columns(F.col("e"), [k / 3 for k in range(16)], 1 / 3)
    return i.select("g", "idx", _r(F.col("d") / 20).alias("scaled"), _r(1 / (1 + F.col("d"))).alias("inverse"), *(_r(c).alias(f"rbf_{k}") for k, c in enumerate(rbf)), *(_r(c).alias(f"radial_{k}") for k, c in enumerate(radial)))


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(
    f"""WITH {ATOMS}, c AS (SELECT g, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms WHERE ligand = 1 GROUP BY g), m AS (SELECT a.g, a.id, min({_D}) AS d FROM atoms a JOIN atoms b ON a.g = b.g AND a.ligand = 0 AND b.ligand = 1 GROUP BY 1, 2)
 SELECT a.g, a.id, round(m.d, 5) AS min_distance, round({_D}, 5) AS centroid_distance FROM atoms a JOIN m USING (g, id) JOIN c b ON a.g = b.g"""
)
def x6_j10_distances(spark, sf_dir):
    """Least distance to the ligand's atoms (a product within the complex, by its key) and distance to its centroid."""
    p = atoms(spark, sf_dir)
    res, lig = p.where("ligand = 0"), p.where("ligand = 1")
    xyz = lambda prefix="": [F.col(prefix + c) for c in "xyz"]
    named = lig.select("g", *(F.col(c).alias(f"l_{c}") for c in "xyz"))
    least = res.join(named, "g").groupBy("g", "id", "x", "y", "z").agg(F.min(G.distance(xyz(), xyz("l_"))).alias("m"))
    centre = lig.groupBy("g").agg(*(F.avg(c).alias(f"c_{c}") for c in "xyz"))
    return least.join(centre, "g").select("g", "id", _r(F.col("m"), 5).alias("min_distance"), _r(G.distance(xyz(), xyz("c_")), 5).alias("centroid_distance"))


@query(
    """WITH e AS (SELECT vec_id AS id, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b FROM embeddings) SELECT id, round(list_dot_product(a, b), 6) AS dot, round(sqrt(list_dot_product(a, a)), 6) AS norm,
 round(degrees(acos(least(abs(list_dot_product(a, b)) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 1.0))), 4) AS angle FROM e"""
)
def x7_vector_algebra(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).alias("a"), F.slice("embedding", 4, 3).alias("b"))
    a, b = F.col("a"), F.col("b")
    return e.select("id", _r(G.dot(a, b)).alias("dot"), _r(G.norm(a)).alias("norm"), _r(G.plane_angle(a, b), 4).alias("angle"))


_ROT = G.rotation((1.0, 2.0, 2.0), 30.0)


@query(f"WITH {ATOMS} SELECT g, id, " + ", ".join(f"round(({s}) + x * ({m[0]}) + y * ({m[1]}) + z * ({m[2]}), 5) AS {n}" for n, m, s in zip(("nx", "ny", "nz"), _ROT, (1.0, -0.5, 0.25))) + " FROM atoms WHERE ligand = 1")
def x8_rigid_motion(spark, sf_dir):
    """Ligand atoms turned about an axis and shifted."""
    p = atoms(spark, sf_dir).where("ligand = 1")
    new = G.moved([F.col(c) for c in "xyz"], _ROT, (1.0, -0.5, 0.25))
    return p.select("g", "id", *(_r(c, 5).alias(n) for n, c in zip(("nx", "ny", "nz"), new)))


@query(
    f"""WITH {ATOMS}, c AS (SELECT g, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM atoms WHERE ligand = 1 GROUP BY g), r AS (SELECT a.g, a.id, round({_D}, 5) AS d FROM atoms a JOIN c b ON a.g = b.g WHERE a.ligand = 0),
 q AS (SELECT g, quantile_cont(d, 0.7) AS cut FROM r GROUP BY g), t AS (SELECT r.g, id, d, row_number() OVER (PARTITION BY r.g ORDER BY {draw_sql("'x9'", 'id')}, id) AS k FROM r JOIN q ON r.g = q.g AND d >= cut)
 SELECT g, id, d FROM t WHERE k = 1"""
)
def x9_wrong_pocket(spark, sf_dir):
    """A residue beyond the 70th percentile of distance, by hash: where the wrong pose goes."""
    from ..operators.resample import draw

    p = atoms(spark, sf_dir)
    centre = p.where("ligand = 1").groupBy("g").agg(*(F.avg(c).alias(f"c_{c}") for c in "xyz"))
    r = p.where("ligand = 0").join(centre, "g").select("g", "id", _r(G.distance([F.col(c) for c in "xyz"], [F.col(f"c_{c}") for c in "xyz"]), 5).alias("d"))
    cut = r.groupBy("g").agg(F.percentile("d", 0.7).alias("cut"))
    far = r.join(cut, "g").where("d >= cut")
    return far.groupBy("g").agg(F.min_by(F.struct("id", "d"), F.struct(draw("x9", F.col("id")), F.col("id"))).alias("m")).select("g", "m.id", "m.d")


@query("SELECT s_suppkey, sha256(s_name) AS h256, sha1(s_name) AS h1, substr(sha256(s_name), 1, 24) AS file_key, ('0x' || substr(sha1(s_name), 1, 12))::BIGINT AS seed FROM supplier")
def x10_hashes(spark, sf_dir):
    b = F.col("s_name").cast("binary")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(b, 256).alias("h256"), F.sha1(b).alias("h1"), F.substring(F.sha2(b, 256), 1, 24).alias("file_key"), F.conv(F.substring(F.sha1(b), 1, 12), 16, 10).cast("bigint").alias("seed"))


@query(
    """WITH f AS (SELECT vec_id AS id, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END)), lambda a, b: a + b)::BIGINT AS w FROM embeddings),
 p AS (SELECT a.id, b.id AS train, coalesce(bit_count(a.w & b.w)::DOUBLE / nullif(bit_count(a.w | b.w), 0), 1) AS t FROM f a JOIN f b ON a.id % 10 = 1 AND b.id % 2 = 0)
 SELECT id, round(max(t), 6) AS max_tanimoto, min(train) FILTER (t = m) AS nearest FROM (SELECT *, max(t) OVER (PARTITION BY id) AS m FROM p) GROUP BY id"""
)
def x11_tanimoto(spark, sf_dir):
    """Greatest Tanimoto similarity of each of a stated query set's fingerprints to the training ones."""
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), G.sign_bits(F.col("embedding"), 32).alias("w"))
    best = S.nearest_tanimoto(f.where("id % 10 = 1"), f.where("id % 2 = 0").select(F.col("id").alias("train"), F.col("w").alias("tw")))
    return best.select("id", _r(F.col("t")).alias("max_tanimoto"), "nearest")


@query(
    """WITH f AS (SELECT vec_id AS id, list_filter(list_transform(range(64), lambda j: CASE WHEN embedding[j + 1] > 0.05 THEN floor(embedding[j + 1]::DOUBLE * 64)::INT % 32 * 64 + j ELSE -1 END), lambda b: b >= 0) AS bits FROM embeddings),
 p AS (SELECT a.id, b.id AS train, len(list_intersect(a.bits, b.bits)) AS shared, len(a.bits) + len(b.bits) AS total FROM f a JOIN f b ON a.id % 50 = 0 AND b.id % 2 = 1),
 s AS (SELECT id, train, coalesce(shared::DOUBLE / nullif(total - shared, 0), 1) AS t FROM p)
 SELECT id, round(max(t), 6) AS max_tanimoto, min(train) FILTER (t = m) AS nearest FROM (SELECT *, max(t) OVER (PARTITION BY id) AS m FROM s) GROUP BY id"""
)
def x11_fingerprints(spark, sf_dir):
    """The same for fingerprints of 2,048 bits: a bit for each coordinate and level, through inverted indexes of blocks."""
    e = F.col("embedding")
    bit = lambda v, j: F.when(v > 0.05, (F.floor(v.cast("double") * 64) % 32 * 64 + j).cast("int"))
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), G.packed_bits(F.filter(F.transform(e, bit), lambda b: b.isNotNull())).alias("w"))
    best = S.nearest_fingerprint(f.where("id % 50 = 0"), f.where("id % 2 = 1").select(F.col("id").alias("train"), F.col("w").alias("tw")))
    return best.select("id", _r(F.col("t")).alias("max_tanimoto"), "nearest")


@query("""SELECT p_partkey, upper(trim(p_name)) AS name, split_part(p_type, ' ', 1) AS head, reverse(split_part(reverse(p_type), ' ', 1)) AS tail, unnest(string_split(p_brand || '+' || p_type, '+')) AS part FROM part""")
def x12_strings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), F.substring_index("p_type", " ", -1).alias("tail"), F.explode(F.split(F.concat_ws("+", "p_brand", "p_type"), r"\+")).alias("part"))


@query(
    """WITH l AS (SELECT vec_id AS id, embedding[1:(vec_id % 4) + 1]::DOUBLE[] AS a, embedding[1:3]::DOUBLE[] AS b FROM embeddings), n AS (SELECT id, a, b, least(len(a), len(b)) AS n FROM l)
 SELECT id, k AS place, round(a[k + 1], 6) AS a, round(b[k + 1], 6) AS b FROM (SELECT *, unnest(range(n)) AS k FROM n)"""
)
def x13_zip_shorter(spark, sf_dir):
    """Two lists cut to the shorter one, row by row."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", F.lit(1), (F.col("vec_id") % 4 + 1).cast("int")).alias("a"), F.slice("embedding", 1, 3).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    z = e.select("id", F.posexplode(F.arrays_zip(F.slice("a", F.lit(1), n).alias("a"), F.slice("b", F.lit(1), n).alias("b"))).alias("place", "z"))
    return z.select("id", F.col("place").cast("bigint").alias("place"), _r(F.col("z.a").cast("double")).alias("a"), _r(F.col("z.b").cast("double")).alias("b"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def x14_json_default(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("SELECT l_suppkey AS g, round(sum(l_tax) / nullif(sum(CASE WHEN l_quantity > 49.5 AND l_discount > 0.095 THEN l_discount END), 0), 6) AS ratio FROM lineitem GROUP BY 1")
def x15_safe_division(spark, sf_dir):
    few = F.sum(F.when((F.col("l_quantity") > 49.5) & (F.col("l_discount") > 0.095), F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(_r(F.try_divide(F.sum("l_tax"), few)).alias("ratio"))


@query("SELECT conv_id, string_agg(upper(substr(role, 1, 1)), '' ORDER BY turn) AS sequence, count(DISTINCT role) AS roles FROM conversations GROUP BY 1")
def x18_sequence(spark, sf_dir):
    """A one-letter sequence from rows in order."""
    letters = F.array_sort(F.collect_list(F.struct("turn", F.upper(F.substring("role", 1, 1)).alias("c"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(letters, lambda s: s["c"]), "").alias("sequence"), F.countDistinct("role").alias("roles"))


@query("SELECT s_suppkey, printf('%+.2f', s_acctbal) AS signed, printf('%.2f [%.2f, %.2f]', s_acctbal, s_acctbal - 1, s_acctbal + 1) AS ci FROM supplier")
def x19_formatting(spark, sf_dir):
    v = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("%+.2f", v).alias("signed"), F.format_string("%.2f [%.2f, %.2f]", v, v - 1, v + 1).alias("ci"))


@query(
    f"""WITH {ITEMS}, p AS (SELECT a.g, a.idx AS pos, b.idx AS neg, a.sa - b.sa AS gap, abs(a.d - b.d) AS dd FROM items a JOIN items b ON a.g = b.g AND a.y = 1 AND b.y = 0 AND abs(a.d - b.d) <= 0.75 AND a.sa > b.sa)
 SELECT g, count(*) AS pairs, round(max(gap - 0.1 * dd), 6) AS best FROM p GROUP BY g"""
)
def j11_matched_contrast(spark, sf_dir):
    """Best (positive, negative) contrast of each complex at nearly the same distance: a band join on rounded distances.
    Equal items are one row with their number, so that pairs are counted and not listed."""
    return S.matched_contrast(ranked_items(spark, sf_dir), "g", "y", "d", "sa", 0.75, 0.1).withColumn("best", _r(F.col("best")))


@query(
    f"""WITH {ATOMS}, d AS (SELECT a.g, a.id, b.id AS target, {_D} AS d FROM atoms a JOIN atoms b ON a.g = b.g AND a.ligand = 1 AND b.ligand = 0), m AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d, target) AS r FROM d WHERE d <= 8) SELECT g, id, target, round(d, 5) AS distance FROM m WHERE r = 1"""
)
def j12_nearest_within(spark, sf_dir):
    p = atoms(spark, sf_dir)
    return X.nearest_within(p.where("ligand = 1"), p.where("ligand = 0"), "g", 8.0).select("g", "id", "target", _r(F.col("distance"), 5).alias("distance"))


@query(f"WITH {ATOMS}, d AS (SELECT a.g, a.id AS a_key, b.id AS b_key, {_D} AS d FROM atoms a JOIN atoms b ON a.g = b.g AND a.id <> b.id AND a.ligand = 0 AND b.ligand = 0) SELECT g, a_key, count(*) AS neighbours, round(min(d), 5) AS nearest, round(sum(d), 3) AS total FROM d WHERE d <= 10 GROUP BY 1, 2")
def j13_neighbours(spark, sf_dir):
    p = X.pairs_within(atoms(spark, sf_dir).where("ligand = 0"), "g", "id", 10.0)
    return p.groupBy("g", "a_key").agg(F.count("*").alias("neighbours"), _r(F.min("distance"), 5).alias("nearest"), _r(F.sum("distance"), 3).alias("total"))


@query(f"WITH {ATOMS}, d AS (SELECT a.g, a.id, b.id AS other, {_D} AS d FROM atoms a JOIN atoms b ON a.g = b.g AND a.id <> b.id AND a.ligand = 0 AND b.ligand = 0), k AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d, other) AS k FROM d) SELECT g, id, other, k, round(d, 5) AS distance FROM k WHERE k <= 3")
def j13_fe2_knn(spark, sf_dir):
    """Three nearest residues of each, among the points of near cubes, which widen for those that have too few."""
    k = X.nearest_k(atoms(spark, sf_dir).where("ligand = 0"), "g", "id", 3, 8.0)
    return k.select("g", F.col("a_key").alias("id"), F.col("b_key").alias("other"), F.col("k").cast("bigint").alias("k"), _r(F.col("distance"), 5).alias("distance"))


_CHANNELS = ["c1", "c2", "c3", "c4", "c5"]
_PAIRS = """pairs AS (SELECT l_suppkey AS g, l_partkey % 30 AS res, l_quantity / 5 AS d, l_quantity / 5 + l_tax * 20 AS e, l_discount * 10 AS c1, l_tax * 12 AS c2, l_linenumber::DOUBLE / 8 AS c3, l_discount * 5 AS c4, l_tax * 6 AS c5,
  l_partkey AS pair FROM lineitem), residues AS (SELECT s_suppkey AS g, r AS res FROM supplier CROSS JOIN range(40) t(r))"""


def _pairs(spark, sf_dir):
    """Pairs of 30 of the 40 residues of each complex: the others have none."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as g", "l_partkey % 30 as res", "l_quantity / 5 as d", "l_quantity / 5 + l_tax * 20 as e", "l_discount * 10 as c1", "l_tax * 12 as c2", "cast(l_linenumber as double) / 8 as c3", "l_discount * 5 as c4", "l_tax * 6 as c5", "l_partkey as pair"
    )


def _residues(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("g"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("res"))


def _typed_sql(channels: list[str]) -> str:
    s = f"greatest({', '.join(channels)})"
    out = {"log_pairs": "ln(1 + count(*))", "centroid_mean": "avg(e)"}
    for r in X.CUTOFFS:
        out |= {f"contacts_{X.tag(r)}": f"count(*) FILTER (d <= {r})::DOUBLE", f"contact_part_{X.tag(r)}": f"avg(CAST(d <= {r} AS DOUBLE))"}
    for t in X.SOFT_TAUS:
        out |= {f"soft_{X.tag(t)}": f"sum(exp(-d / {t}))", f"soft_mean_{X.tag(t)}": f"avg(exp(-d / {t}))"}
    out |= {"any_max": f"max({s})", "any_mean": f"avg({s})"} | {f"any_weighted_{X.tag(t)}": f"avg({s} * exp(-d / {t}))" for t in X.WEIGHT_TAUS}
    for t in X.THRESHOLDS:
        out |= {f"any_count_{X.tag(t)}": f"count(*) FILTER ({s} >= {t})::DOUBLE", f"any_part_{X.tag(t)}": f"avg(CAST({s} >= {t} AS DOUBLE))"}
    out["any_top3"] = f"list_avg(list_reverse_sort(list({s}))[1:3])"
    for c in channels:
        out |= {f"{c}_max": f"max({c})", f"{c}_mean": f"avg({c})", f"{c}_weighted_4": f"avg({c} * exp(-d / 4.0))"}
    inner = ", ".join(f"{e} AS {n}" for n, e in out.items())
    return f"WITH {_PAIRS}, f AS (SELECT g, res, {inner} FROM pairs GROUP BY g, res) SELECT g, res, " + ", ".join(f"round(coalesce({n}, 0), 8) AS {n}" for n in out) + " FROM residues LEFT JOIN f USING (g, res)"


def _typed(spark, sf_dir, channels):
    f = X.typed_features(_residues(spark, sf_dir), _pairs(spark, sf_dir), ["g", "res"], channels, "d", "e")
    return f.select("g", "res", *(_r(F.col(c), 8).alias(c) for c in f.columns[2:]))


@query(_typed_sql(_CHANNELS))
def fe1_typed_features(spark, sf_dir):
    """The 48 multi-scale typed features of each residue in one aggregation."""
    return _typed(spark, sf_dir, _CHANNELS)


@query(_typed_sql(["c1", "c3", "c4", "c5"]))
def fe5_type_removal(spark, sf_dir):
    """The same without one channel: its three columns go and the shared ones are made anew."""
    return _typed(spark, sf_dir, ["c1", "c3", "c4", "c5"])


@query(
    f"""WITH {_PAIRS}, m AS (SELECT g, res, pair, d, unnest([1.0, 0.9, 0.7]) AS f, c1, c2, c3 FROM pairs), p AS (SELECT g, res, pair || '|' || d AS k, c1 * f AS a, least(c2 * f, 1) AS b, c3 * f + (1 - f) AS c FROM m),
 s AS (SELECT g, res, k, min(greatest(a, b, c)) AS any_min, avg(greatest(a, b, c)) - stddev_pop(greatest(a, b, c)) AS any_low, stddev_pop(greatest(a, b, c)) AS any_sd, max(greatest(a, b, c)) - min(greatest(a, b, c)) AS any_range,
 (stddev_pop(a) + stddev_pop(b) + stddev_pop(c)) / 3 AS channel_sd_mean, greatest(stddev_pop(a), stddev_pop(b), stddev_pop(c)) AS channel_sd_max, greatest(min(a), min(b), min(c)) AS consensus FROM p GROUP BY ALL)
 SELECT g, res, """
    + ", ".join(f"round(max({n}), 8) AS {n}_max, round(avg({n}), 8) AS {n}_mean, round(list_avg(list_reverse_sort(list({n}))[1:3]), 8) AS {n}_top3" for n in ("any_min", "any_low", "any_sd", "any_range", "channel_sd_mean", "channel_sd_max", "consensus"))
    + " FROM s GROUP BY g, res"
)
def fe3_ensemble_uncertainty(spark, sf_dir):
    """How three models agree: seven statistics of each pair, pooled three ways."""
    m = _pairs(spark, sf_dir).withColumn("f", F.explode(F.array(F.lit(1.0), F.lit(0.9), F.lit(0.7))))
    f = F.col("f")
    p = m.select("g", "res", F.concat_ws("|", "pair", "d").alias("k"), (F.col("c1") * f).alias("a"), F.least(F.col("c2") * f, F.lit(1.0)).alias("b"), (F.col("c3") * f + (1 - f)).alias("c"))
    u = X.ensemble_uncertainty(p, ["g", "res"], "k", ["a", "b", "c"])
    return u.select("g", "res", *(_r(F.col(c), 8).alias(c) for c in u.columns[2:]))


def _spatial_sql() -> str:
    within, knn = {}, {}
    for r in X.SPATIAL_RADII:
        within |= {f"n_{X.tag(r)}": (f"count(*) FILTER (d <= {r})::DOUBLE", "0"), f"mean_{X.tag(r)}": (f"avg(s) FILTER (d <= {r})", "0"), f"max_{X.tag(r)}": (f"max(s) FILTER (d <= {r})", "0"), f"nearest_{X.tag(r)}": (f"min(l) FILTER (d <= {r})", "80")}
    for k in X.NEIGHBOURS:
        knn |= {f"knn{k}_mean": (f"avg(s) FILTER (k <= {k})", "0"), f"knn{k}_max": (f"max(s) FILTER (k <= {k})", "0"), f"knn{k}_distance": (f"avg(l) FILTER (k <= {k})", "80")}
    every = within | knn
    return f"""WITH {ATOMS}, r AS (SELECT g, id, x, y, z, (id % 97) / 97.0::DOUBLE AS s, (id % 31)::DOUBLE AS l FROM atoms WHERE ligand = 0),
 p AS (SELECT a.g, a.id, b.s, b.l, {_D} AS d, row_number() OVER (PARTITION BY a.g, a.id ORDER BY {_D}, b.id) AS k FROM r a JOIN r b ON a.g = b.g AND a.id <> b.id),
 f AS (SELECT g, id, {", ".join(f"{e} AS {n}" for n, (e, _) in every.items())} FROM p GROUP BY g, id) SELECT g, id, {", ".join(f"round(coalesce({n}, {z}), 6) AS {n}" for n, (_, z) in every.items())} FROM r LEFT JOIN f USING (g, id)"""


@query(_spatial_sql())
def fe2_spatial_context(spark, sf_dir):
    """The 25 features of the residues around each one."""
    r = atoms(spark, sf_dir).where("ligand = 0").select("g", "id", "x", "y", "z", ((F.col("id") % 97) / 97.0).alias("s"), (F.col("id") % 31).cast("double").alias("l"))
    f = X.spatial_features(r, "g", "id", "s", "l")
    return f.select("g", "id", *(_r(F.col(c)).alias(c) for c in f.columns[2:]))


@query(
    f"""WITH {ITEMS} SELECT g, idx, """
    + ", ".join(f"round((row_number() OVER (PARTITION BY g ORDER BY {s}, idx) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY g) - 1, 0), 6) AS rank_{s}, round(({s} - avg({s}) OVER (PARTITION BY g)) / stddev_pop({s}) OVER (PARTITION BY g), 5) AS zscore_{s}" for s in ("sa", "sb", "d"))
    + " FROM items"
)
def fe4_context(spark, sf_dir):
    """Rank and standard score within the complex of several sources."""
    f = X.context_features(ranked_items(spark, sf_dir, dealt=True), ["g"], "idx", ["sa", "sb", "d"])
    return f.select("g", "idx", *(_r(F.col(c), 6 if c.startswith("rank") else 5).alias(c) for c in f.columns if c.startswith(("rank_", "zscore_"))))


@query("SELECT 73::BIGINT AS columns, count(*) AS rows FROM supplier CROSS JOIN range(40)")
def fe4_matrix(spark, sf_dir):
    """The whole item matrix: 12 distance, 2 score, 11 cross and 48 typed columns of each residue."""
    f = X.typed_features(_residues(spark, sf_dir), _pairs(spark, sf_dir), ["g", "res"], _CHANNELS, "d", "e")
    m = X.item_matrix(f, ["g", "res"], "any_max", "centroid_mean", f.columns[2:])
    every = F.struct(*m.columns[2:])
    return m.agg(F.lit(len(m.columns) - 2).cast("bigint").alias("columns"), F.count_if(every.isNotNull()).alias("rows"))


@query(
    """WITH e AS (SELECT label AS g, vec_id AS id, embedding[1:3]::DOUBLE[] AS c, embedding[4:6]::DOUBLE[] AS n FROM embeddings), u AS (SELECT g, id, [c[1] * 20, c[2] * 20, c[3] * 20] AS c, [n[1] / sqrt(list_dot_product(n, n)), n[2] / sqrt(list_dot_product(n, n)), n[3] / sqrt(list_dot_product(n, n))] AS n FROM e),
 p AS (SELECT g, id % 6 AS res, c, n FROM u WHERE id % 2 = 0), l AS (SELECT g, id % 3 AS atom, c, n FROM u WHERE id % 2 = 1), k AS (SELECT DISTINCT g, r AS res, a AS atom FROM u CROSS JOIN range(7) x(r) CROSS JOIN range(3) y(a)),
 j AS (SELECT k.g, k.res, k.atom, [p.c[1] - l.c[1], p.c[2] - l.c[2], p.c[3] - l.c[3]] AS d, p.n AS pn, l.n AS ln FROM k JOIN p USING (g, res) JOIN l ON l.g = k.g AND l.atom = k.atom),
 m AS (SELECT g, res, atom, sqrt(list_dot_product(d, d)) AS dist, degrees(acos(least(abs(list_dot_product(pn, ln)), 1.0))) AS angle, least(sqrt(greatest(list_dot_product(d, d) - pow(list_dot_product(d, pn), 2), 0)), sqrt(greatest(list_dot_product(d, d) - pow(list_dot_product(d, ln), 2), 0))) AS off FROM j)
 SELECT g, res, atom, CAST(min(dist) IS NOT NULL AS INT)::DOUBLE AS has_ring, round(coalesce(least(min(dist) / 10, 2.0), 0), 4) AS ring_distance, round(coalesce(least(arg_min(angle, dist) / 90, 1.0), 0), 4) AS ring_angle, round(coalesce(least(arg_min(off, dist) / 5, 2.0), 0), 4) AS ring_offset FROM k LEFT JOIN m USING (g, res, atom) GROUP BY ALL"""
)
def fe10_ring_geometry(spark, sf_dir):
    """Nearest ring pair of each (residue, ligand atom): rings come as tables of centres and normals."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 20).alias("c"), F.transform(F.slice("embedding", 4, 3), lambda v: v.cast("double")).alias("n"))
    e = e.withColumn("n", F.transform("n", lambda v: v / G.norm(F.col("n"))))
    protein = e.where("id % 2 = 0").select("g", (F.col("id") % 6).alias("res"), F.col("c").alias("p_centre"), F.col("n").alias("p_normal"))
    ligand = e.where("id % 2 = 1").select("g", (F.col("id") % 3).alias("atom"), F.col("c").alias("l_centre"), F.col("n").alias("l_normal"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    pairs = e.select("g").distinct().withColumn("res", numbers(7)).withColumn("atom", numbers(3))
    r = X.ring_geometry(pairs, protein, ligand, ["g", "res", "atom"])
    return r.select("g", "res", "atom", "has_ring", *(_r(F.col(c), 4).alias(c) for c in ("ring_distance", "ring_angle", "ring_offset")))


@query(
    f"""WITH {ITEMS}, s AS (SELECT *, CAST(sa > 0.095 AND d < 8 AS INT) AS pos FROM items), t AS (SELECT *, sum(pos) OVER (PARTITION BY g) AS p, row_number() OVER (PARTITION BY g, pos ORDER BY d, idx) AS r FROM s)
 SELECT g, idx, pos FROM t WHERE pos = 1 OR r <= CASE WHEN p = 0 THEN 32 ELSE least(greatest(p * 4, 1), 20) END"""
)
def fe7_pair_sampling(spark, sf_dir):
    s = ranked_items(spark, sf_dir, dealt=True).withColumn("pos", ((F.col("sa") > 0.095) & (F.col("d") < 8)).cast("int"))
    return X.sampled_pairs(s, "g", "pos", ["d", "idx"], 4, 20).select("g", "idx", "pos")


@query(
    f"""WITH {ATOMS}, m AS (SELECT a.g, a.id, min({_D}) AS d FROM atoms a JOIN atoms b ON a.g = b.g AND a.ligand = 0 AND b.ligand = 1 GROUP BY 1, 2), r AS (SELECT g, count(*) FILTER (d <= 15) AS candidates, count(*) AS residues, count(*) FILTER (d <= 15 AND id % 7 = 0) AS positives FROM m GROUP BY g)
 SELECT g, residues, candidates, positives, CASE WHEN candidates = 0 THEN 'no residue in range' WHEN positives = 0 THEN 'no positive' ELSE 'ok' END AS reason FROM r"""
)
def fe8_candidate_record(spark, sf_dir):
    """Residues near the ligand of each complex, their positives, and why a complex is skipped."""
    p = atoms(spark, sf_dir)
    lig = p.where("ligand = 1").select("g", *(F.col(c).alias(f"l_{c}") for c in "xyz"))
    m = p.where("ligand = 0").join(lig, "g").groupBy("g", "id").agg(F.min(G.distance([F.col(c) for c in "xyz"], [F.col(f"l_{c}") for c in "xyz"])).alias("d"))
    near = F.col("d") <= 15
    r = m.groupBy("g").agg(F.count("*").alias("residues"), F.count_if(near).alias("candidates"), F.count_if(near & (F.col("id") % 7 == 0)).alias("positives"))
    return r.withColumn("reason", F.when(F.col("candidates") == 0, "no residue in range").when(F.col("positives") == 0, "no positive").otherwise("ok"))


@query(
    f"""WITH {ATOMS}, c AS (SELECT g, -1 AS id, 0 AS kind, round(avg(x), 4) AS x FROM atoms WHERE ligand = 0 GROUP BY g), n AS (SELECT * FROM c UNION ALL SELECT g, id, 1 + ligand, round(x, 4) FROM atoms)
 SELECT g, id, kind, row_number() OVER (PARTITION BY g ORDER BY kind, id) - 1 AS node FROM n"""
)
def fe9_graph_nodes(spark, sf_dir):
    """Nodes of each complex: its centroid, then residues, then ligand atoms, numbered."""
    return S.numbered_nodes(atoms(spark, sf_dir), "g", "id", 1 + F.col("ligand"), F.col("ligand") == 0)


@query(
    f"""WITH {ITEMS}, a AS (SELECT g, idx, sa, row_number() OVER (PARTITION BY g ORDER BY idx) AS k FROM items), b AS (SELECT g, sa AS permuted, row_number() OVER (PARTITION BY g ORDER BY {draw_sql("'fe11'", 'g', 'idx')}, idx) AS k FROM items) SELECT g, idx, sa, permuted FROM a JOIN b USING (g, k)"""
)
def fe11_permutation_control(spark, sf_dir):
    from ..operators.resample import draw

    i = ranked_items(spark, sf_dir, dealt=True).select("g", "idx", "sa")
    return X.permuted(i, "g", "idx", "sa", draw("fe11", F.col("g"), F.col("idx"))).select("g", "idx", "sa", "permuted")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def fe12_residue_positives(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')").select("o_custkey", "o_orderpriority").distinct()
