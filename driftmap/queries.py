"""Registered queries over the provided tables, and the SQL that gives the same rows.

All run over whole tables. Points are ``embeddings``; layouts start at ten times
the first two coordinates. Values are rounded to six digits to be compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import affinity, distance, forces, integrate, knn, layout_init, linalg, nbody, quality, symmetrize
from .options import Options
from .plans import fit as plan
from .plans import sweep
from .scratch_tables import shared_folder, stored
from .sources import generate, trajectory, vectors
from .streaming import observer

BETA, OTHERS = 20.0, 31
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vectorise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select("id", (F.element_at("features", 1) * 10).alias("x"), (F.element_at("features", 2) * 10).alias("y"))


def neighbors(spark: SparkSession, sf_dir: str, k: int = OTHERS) -> DataFrame:
    """Written once: what follows reads the edges several times."""
    return stored(knn.knn_exact(points(spark, sf_dir), k), "knn")


def fixed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.at_fixed_beta(neighbors(spark, sf_dir), BETA)


def joint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return symmetrize.one_sided(fixed_edges(spark, sf_dir), p.count())


def r6(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles rounded to six digits, without negative zeros."""
    return df.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes])


EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
LONG = f"{EMB}, m AS (SELECT id AS row, unnest(range(0, len(v)))::INT AS col, unnest(v) AS v FROM e)"
PAIRS = f"{EMB}, pr AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) ^ 2 AS d2 FROM e a, e b WHERE a.id <> b.id)"
KNN = f"{PAIRS}, kn AS MATERIALIZED (SELECT i, j, d2 FROM pr QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= {OTHERS})"
FIXED = f"{KNN}, g AS (SELECT i, j, exp(-{BETA} * d2 / (SELECT max(d2) FROM kn)) AS k FROM kn), fx AS MATERIALIZED (SELECT i, j, k / sum(k) OVER (PARTITION BY i) AS p FROM g)"
JOINT = f"{FIXED}, jt AS MATERIALIZED (SELECT a.i, a.j, (a.p + coalesce(b.p, 0)) / (2 * (SELECT count(*) FROM e)) AS p FROM fx a LEFT JOIN fx b ON a.i = b.j AND a.j = b.i)"
LAYOUT = "l AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings)"
PHI = f"""{LAYOUT}, ph AS MATERIALIZED (
  SELECT a.id, sum(k) AS phi1, sum(k * b.x) AS phi2, sum(k * b.y) AS phi3, sum(k * (b.x * b.x + b.y * b.y)) AS phi4
  FROM (SELECT a.id, a.x AS ax, a.y AS ay, b.x, b.y, 1 / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) ^ 2 AS k FROM l a, l b) b JOIN l a USING (id) GROUP BY a.id)"""
REP = f"{PHI}, rp AS (SELECT id, x * phi1 - phi2 AS rx, y * phi1 - phi3 AS ry, (1 + x * x + y * y) * phi1 - 2 * (x * phi2 + y * phi3) + phi4 AS zi FROM l JOIN ph USING (id))"
ATTR = f"""{JOINT}, {LAYOUT}, att AS (
  SELECT jt.i AS id, sum(p * (a.x - b.x) / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS ax, sum(p * (a.y - b.y) / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS ay
  FROM jt JOIN l a ON a.id = jt.i JOIN l b ON b.id = jt.j GROUP BY jt.i)"""


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


# --- sources, projections, reductions


@query(f"WITH {EMB} SELECT count(*) AS n, count(DISTINCT id) AS ids, min(len(v))::INT AS least_dim, max(len(v))::INT AS most_dim FROM e")
def vector_check(spark, sf_dir):
    return vectors.check_points(points(spark, sf_dir))


@query(f"WITH {EMB} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) + 0.0 AS v FROM e")
def vector_norms(spark, sf_dir):
    m = linalg.to_long(points(spark, sf_dir)).withColumn("v", scalar.square(F.col("v")))
    return r6(linalg.reduce_sum(m, "row").withColumnRenamed("row", "id"))


@query("SELECT false AS bad")
def nan_or_inf_check(spark, sf_dir):
    return linalg.any_nan_or_inf(points(spark, sf_dir))


@query("SELECT round(sum(round(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax, 4)), 3)::DOUBLE AS total, count(*) AS n FROM lineitem")
def wide_vectors(spark, sf_dir):
    """Numeric columns of ``lineitem`` as vectors; the sum of their squared norms."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("row", F.monotonically_increasing_id())
    p = vectors.vectorise(lines, "row", ["l_quantity", "l_discount", "l_tax"])
    one = F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x), 4)
    return p.agg(F.round(F.sum(one), 3).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LONG} SELECT row, col, {_r('increment_inverse', 'squared', 'root', 'exponential', 'power2', 'entropy', 'kl')} FROM (
  SELECT row, col, 1 / (abs(v) + 1) AS increment_inverse, v * v AS squared, sqrt(abs(v)) AS root, exp(v) AS exponential, 2.0 ^ v AS power2,
         CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END AS entropy, CASE WHEN v = 0 THEN 0 ELSE abs(v) * (ln(abs(v)) - ln(abs(v) + 1)) END AS kl FROM m)""")
def scalar_functions(spark, sf_dir):
    m, v = linalg.to_long(points(spark, sf_dir)), F.col("v")
    return r6(m.select("row", "col", scalar.increment_inverse(F.abs(v)).alias("increment_inverse"), scalar.square(v).alias("squared"), F.sqrt(F.abs(v)).alias("root"), F.exp(v).alias("exponential"), scalar.power2(v).alias("power2"), scalar.entropy_term(v).alias("entropy"), scalar.kl_term(F.abs(v), F.abs(v) + 1).alias("kl")))


def _reduction(name: str, axis: str, how: str, sql: str):
    def run(spark, sf_dir):
        m = linalg.to_long(points(spark, sf_dir))
        return r6({"sum": linalg.reduce_sum, "mean": linalg.reduce_mean, "alpha": lambda t, a: linalg.reduce_alpha(t, a, 0.1)}[how](m, axis))

    run.__name__ = name
    query(f"WITH {LONG} SELECT {axis}, round({sql}, 6) + 0.0 AS v FROM m GROUP BY {axis}")(run)


for _name, _axis, _how, _sql in (
    ("row_sum", "row", "sum", "sum(v)"), ("row_mean", "row", "mean", "avg(v)"), ("dim_sum", "col", "sum", "sum(v)"),
    ("dim_mean", "col", "mean", "avg(v)"), ("reduce_alpha_row", "row", "alpha", "0.1 * sum(v)"), ("reduce_alpha_dim", "col", "alpha", "0.1 * sum(v)"),
):
    _reduction(_name, _axis, _how, _sql)


@query(f"WITH {LONG}, s AS (SELECT col, avg(v) AS mu FROM m GROUP BY col) SELECT row, m.col, round(v - 0.5 * mu, 6) + 0.0 AS v FROM m JOIN s ON m.col = s.col")
def broadcast_minus(spark, sf_dir):
    m = linalg.to_long(points(spark, sf_dir))
    return r6(linalg.broadcast_op(m, linalg.reduce_mean(m, "col"), "col", lambda v, s: v - s, 0.5))


@query(f"WITH {LONG}, s AS (SELECT row, sum(abs(v)) AS total FROM m GROUP BY row) SELECT m.row, col, round(v / total, 6) + 0.0 AS v FROM m JOIN s ON m.row = s.row")
def broadcast_divide(spark, sf_dir):
    m = linalg.to_long(points(spark, sf_dir))
    return r6(linalg.broadcast_op(m, linalg.reduce_sum(m.withColumn("v", F.abs("v")), "row"), "row", lambda v, s: v / s))


@query(f"WITH {LONG} SELECT row, col, round((v - avg(v) OVER (PARTITION BY col)) / stddev_samp(v) OVER (PARTITION BY col), 6) + 0.0 AS v FROM m")
def gaussian_normalize(spark, sf_dir):
    return r6(linalg.to_long(linalg.gaussian_normalize(points(spark, sf_dir))))


@query(f"WITH {KNN} SELECT i, j, round(d2 / max(d2) OVER (), 6) + 0.0 AS d2 FROM kn")
def max_normalize(spark, sf_dir):
    return r6(linalg.max_normalize(neighbors(spark, sf_dir).select("i", "j", "d2"), "d2"))


# --- distances and neighbours


def _pairs(name: str, metric: str, sql: str):
    def run(spark, sf_dir):
        return r6(distance.pairwise(points(spark, sf_dir), metric))

    run.__name__ = name
    query(f"WITH {EMB} SELECT a.id AS i, b.id AS j, round({sql}, 6) + 0.0 AS d FROM e a, e b")(run)


for _name, _metric, _sql in (("pairwise_sq_distance", "sqeuclidean", "list_distance(a.v, b.v) ^ 2"), ("inner_product", "innerproduct", "list_inner_product(a.v, b.v)")):
    _pairs(_name, _metric, _sql)


@query(f"WITH {PAIRS} SELECT i, j, round(sqrt(d2), 6) + 0.0 AS d FROM pr UNION ALL SELECT id, id, 0.0 FROM e")
def pairwise_distance(spark, sf_dir):
    """Distances of different points; of a point with itself 0 (products leave a rounding error under the root)."""
    d = distance.pairwise(points(spark, sf_dir), "euclidean")
    return r6(linalg.zero_diagonal(d, "i", "j", "d"))


@query(f"WITH {PAIRS} SELECT i, j, round(d2, 6) + 0.0 AS d2, rank FROM (SELECT i, j, d2, (row_number() OVER (PARTITION BY i ORDER BY d2, j))::INT AS rank FROM pr) WHERE rank <= 10")
def knn_l2(spark, sf_dir):
    return r6(neighbors(spark, sf_dir, 10))


@query(f"WITH {EMB}, pr AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.v, b.v) AS d2 FROM e a, e b WHERE a.id <> b.id) SELECT i, j, round(d2, 6) + 0.0 AS d2, rank FROM (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY d2 DESC, j))::INT AS rank FROM pr) WHERE rank <= 10")
def knn_inner_product(spark, sf_dir):
    return r6(knn.knn_exact(points(spark, sf_dir), 10, "innerproduct"))


@query(f"WITH {PAIRS}, s AS (SELECT * FROM pr UNION ALL SELECT id, id, 0.0 FROM e) SELECT i, j, round(d2, 6) + 0.0 AS d2, rank FROM (SELECT i, j, d2, (row_number() OVER (PARTITION BY i ORDER BY d2, j))::INT AS rank FROM s) WHERE rank <= 11")
def knn_self_included(spark, sf_dir):
    return r6(knn.knn_exact(points(spark, sf_dir), 11, with_self=True))


@query(None)
def knn_ivf(spark, sf_dir):
    return r6(knn.knn_ivf(points(spark, sf_dir), 10))


@query(f"WITH {PAIRS} SELECT i, j, round(d2, 6) + 0.0 AS d2, rank FROM (SELECT i, j, d2, (row_number() OVER (PARTITION BY i ORDER BY d2, j))::INT AS rank FROM pr) WHERE rank <= 10")
def knn_ivf_exhaustive(spark, sf_dir):
    """All cells are probed, so the index gives the exact neighbours."""
    return r6(knn.knn_ivf(points(spark, sf_dir), 10, cells=20, nprobe=20))


@query("SELECT true AS enough")
def knn_ivf_recall(spark, sf_dir):
    """Does the index find nine tenths of the exact neighbours?"""
    p = points(spark, sf_dir)
    return knn.recall(knn.knn_ivf(p, 10), knn.knn_exact(p, 10)).select((F.col("recall") >= 0.9).alias("enough"))


# --- affinities


@query(f"WITH {FIXED} SELECT i, j, round(p, 6) + 0.0 AS p FROM fx")
def pij_fixed_beta(spark, sf_dir):
    return r6(fixed_edges(spark, sf_dir))


@query(f"WITH {FIXED} SELECT i, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM fx GROUP BY i")
def row_entropy(spark, sf_dir):
    return r6(affinity.row_entropy(fixed_edges(spark, sf_dir)))


SEARCH = f"""WITH RECURSIVE {KNN},
  ls AS MATERIALIZED (SELECT i, list(j ORDER BY d2, j) AS js, list(d2 / (SELECT max(d2) FROM kn) ORDER BY d2, j) AS ds FROM kn GROUP BY i),
  b AS (
    SELECT i, 1.0::DOUBLE AS beta, '-inf'::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1 AS it FROM ls
    UNION ALL
    SELECT i, CASE WHEN gap > 0 THEN CASE WHEN isinf(hi) THEN beta * 2 ELSE (beta + hi) / 2 END ELSE CASE WHEN isinf(lo) THEN beta / 2 ELSE (beta + lo) / 2 END END,
           CASE WHEN gap > 0 THEN beta ELSE lo END, CASE WHEN gap > 0 THEN hi ELSE beta END, it + 1
    FROM (SELECT i, beta, lo, hi, it, -list_sum(list_transform(ds, lambda d: exp(-beta * d) * -beta * d)) / list_sum(list_transform(ds, lambda d: exp(-beta * d)))
                 + ln(list_sum(list_transform(ds, lambda d: exp(-beta * d)))) - ln(10) AS gap FROM b JOIN ls USING (i))
    WHERE abs(gap) >= 1e-3 AND it < 200),
  f AS (SELECT i, beta, it, js, ds, list_sum(list_transform(ds, lambda d: exp(-beta * d))) AS total FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY i ORDER BY it DESC) = 1) JOIN ls USING (i))"""


@query(f"{SEARCH} SELECT i, round(beta, 6) + 0.0 AS beta, round(list_sum(list_transform(ds, lambda d: exp(-beta * d) * beta * d)) / total + ln(total), 6) + 0.0 AS entropy, true AS met, it::INT AS rounds FROM f")
def perplexity_search(spark, sf_dir):
    return r6(affinity.search(neighbors(spark, sf_dir), 10.0).select("i", "beta", "entropy", "met", "rounds"))


@query("SELECT true AS met")
def perplexity_all_met(spark, sf_dir):
    return affinity.all_met(affinity.search(neighbors(spark, sf_dir), 10.0))


@query(f"{SEARCH} SELECT i, unnest(js) AS j, round(unnest(list_transform(ds, lambda d: exp(-beta * d) / total)), 6) + 0.0 AS p FROM f")
def conditional_p(spark, sf_dir):
    return r6(affinity.conditional(affinity.search(neighbors(spark, sf_dir), 10.0)))


@query(f"WITH {JOINT} SELECT i, j, round(p * 1000, 6) + 0.0 AS p FROM jt")
def symmetrize_one_sided(spark, sf_dir):
    return r6(joint_edges(spark, sf_dir).withColumn("p", F.col("p") * 1000))


@query(f"WITH {FIXED}, u AS (SELECT i, j, p FROM fx UNION ALL SELECT j, i, p FROM fx) SELECT i, j, round(1000 * sum(p) / (2 * (SELECT count(*) FROM e)), 6) + 0.0 AS p FROM u GROUP BY i, j")
def symmetrize_full(spark, sf_dir):
    n = points(spark, sf_dir).count()
    return r6(symmetrize.full(fixed_edges(spark, sf_dir), n).withColumn("p", F.col("p") * 1000))


@query(f"WITH {KNN} SELECT i, list(j ORDER BY j)::VARCHAR AS js, len(list(j)) AS n FROM kn GROUP BY i")
def coo_to_packed(spark, sf_dir):
    packed = linalg.pack_edges(neighbors(spark, sf_dir).select("i", "j", "d2"), "d2")
    return packed.select("i", F.concat(F.lit("["), F.array_join("js", ", "), F.lit("]")).alias("js"), F.size("js").cast("long").alias("n"))


@query(f"WITH {KNN} SELECT i, j, round(d2, 6) + 0.0 AS d2 FROM kn")
def packed_to_coo(spark, sf_dir):
    return r6(linalg.unpack_edges(linalg.pack_edges(neighbors(spark, sf_dir).select("i", "j", "d2"), "d2"), "d2"))


@query(f"WITH {EMB} SELECT a.id AS i, b.id AS j, round(CASE WHEN a.id = b.id THEN 0 ELSE list_inner_product(a.v, b.v) END, 6) + 0.0 AS d FROM e a, e b")
def zero_diagonal(spark, sf_dir):
    return r6(linalg.zero_diagonal(distance.pairwise(points(spark, sf_dir), "innerproduct"), "i", "j", "d"))


# --- layouts and forces


@query(f"WITH {LAYOUT} SELECT {_r('low', 'high')} FROM (SELECT least(min(x), min(y)) AS low, greatest(max(x), max(y)) AS high FROM l)")
def layout_bounds(spark, sf_dir):
    return r6(nbody.bounds(layout(spark, sf_dir)))


@query(f"WITH {LAYOUT} SELECT id, 1.0::DOUBLE AS q1, {_r('q2', 'q3', 'q4')} FROM (SELECT id, x AS q2, y AS q3, x * x + y * y AS q4 FROM l)")
def charges(spark, sf_dir):
    return r6(forces.charges(layout(spark, sf_dir)))


BOXES = f"""{LAYOUT}, bd AS (SELECT least(min(x), min(y)) AS low, (greatest(max(x), max(y)) - least(min(x), min(y))) / 130 AS w FROM l),
  bx AS MATERIALIZED (SELECT id, x, y, greatest(0, least(129, floor((x - low) / w)))::INT AS ix, greatest(0, least(129, floor((y - low) / w)))::INT AS iy, (x - low) / w AS sx, (y - low) / w AS sy FROM l, bd),
  bt AS (SELECT id, x, y, ix, iy, sx - ix AS tx, sy - iy AS ty FROM bx)"""
WEIGHTS = ", ".join(f"(t{a} - {p}) * (t{a} - {q}) / (({o} - {p}) * ({o} - {q})) AS w{a}{k}" for a in "xy" for k, (o, p, q) in enumerate((("1.0/6", "1.0/2", "5.0/6"), ("1.0/2", "1.0/6", "5.0/6"), ("5.0/6", "1.0/6", "1.0/2")), 1)).replace("1.0/6", "(1::DOUBLE/6)").replace("1.0/2", "0.5::DOUBLE").replace("5.0/6", "(5::DOUBLE/6)")


@query(f"WITH {BOXES} SELECT id, ix, iy, {_r('tx', 'ty')} FROM bt")
def box_index(spark, sf_dir):
    return r6(nbody.box_index(layout(spark, sf_dir)))


@query(f"WITH {BOXES}, lw AS (SELECT id, {WEIGHTS} FROM bt) SELECT id, {_r('wx1', 'wx2', 'wx3', 'wy1', 'wy2', 'wy3')} FROM lw")
def lagrange_weights(spark, sf_dir):
    return r6(nbody.lagrange_weights(nbody.box_index(layout(spark, sf_dir))))


@query(f"""WITH {BOXES}, lw AS (SELECT id, x, y, ix, iy, {WEIGHTS} FROM bt),
  nw AS (SELECT x, y, ix * 3 + a AS gx, iy * 3 + b AS gy, [wx1, wx2, wx3][a + 1] * [wy1, wy2, wy3][b + 1] AS w FROM lw, (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b))
  SELECT gx::INT AS gx, gy::INT AS gy, round(sum(w), 6) + 0.0 AS w1, round(sum(w * x), 6) + 0.0 AS w2, round(sum(w * y), 6) + 0.0 AS w3, round(sum(w * (x * x + y * y)), 6) + 0.0 AS w4 FROM nw GROUP BY ALL""")
def grid_scatter(spark, sf_dir):
    return r6(nbody.scatter(layout(spark, sf_dir)))


@query(f"WITH {BOXES} SELECT ix, iy, round(low + ix * w, 6) + 0.0 AS x0, round(low + (ix + 1) * w, 6) + 0.0 AS x1, round(low + iy * w, 6) + 0.0 AS y0, round(low + (iy + 1) * w, 6) + 0.0 AS y1 FROM bd, (SELECT unnest(range(130))::INT AS ix), (SELECT unnest(range(130))::INT AS iy)")
def box_bounds(spark, sf_dir):
    return r6(nbody.box_bounds(layout(spark, sf_dir)))


@query(f"WITH {BOXES} SELECT kx, ky, round(1 / (1 + (kx * w / 3) ^ 2 + (ky * w / 3) ^ 2) ^ 2, 6) + 0.0 AS k FROM bd, (SELECT unnest(range(390))::INT AS kx), (SELECT unnest(range(390))::INT AS ky)")
def kernel_grid(spark, sf_dir):
    return r6(nbody.kernel_grid(layout(spark, sf_dir)))


@query(f"WITH {PHI} SELECT id, {_r('phi1', 'phi2', 'phi3', 'phi4')} FROM ph")
def potentials_exact(spark, sf_dir):
    return r6(forces.potentials_exact(layout(spark, sf_dir)))


GRID = f"""{BOXES}, lw AS (SELECT id, x, y, ix, iy, {WEIGHTS} FROM bt),
  nw AS MATERIALIZED (SELECT id, x, y, ix * 3 + a AS gx, iy * 3 + b AS gy, [wx1, wx2, wx3][a + 1] * [wy1, wy2, wy3][b + 1] AS w FROM lw, (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b)),
  gr AS MATERIALIZED (SELECT gx, gy, sum(w) AS w1, sum(w * x) AS w2, sum(w * y) AS w3, sum(w * (x * x + y * y)) AS w4 FROM nw GROUP BY gx, gy),
  np AS MATERIALIZED (SELECT gx, gy, sum(k * w1) AS n1, sum(k * w2) AS n2, sum(k * w3) AS n3, sum(k * w4) AS n4
    FROM (SELECT a.gx, a.gy, b.w1, b.w2, b.w3, b.w4, 1 / (1 + ((a.gx - b.gx) ^ 2 + (a.gy - b.gy) ^ 2) * (w / 3) ^ 2) ^ 2 AS k FROM gr a, gr b, bd) GROUP BY gx, gy)"""


@query(f"WITH {GRID} SELECT id, {', '.join(f'round(sum(w * n{k}), 6) + 0.0 AS phi{k}' for k in range(1, 5))} FROM nw JOIN np USING (gx, gy) GROUP BY id")
def potentials_fft(spark, sf_dir):
    """The grid's potentials by FFT; the SQL sums over all pairs of nodes."""
    return r6(nbody.potentials_fft(layout(spark, sf_dir)))


def _repelled(spark, sf_dir):
    at = layout(spark, sf_dir)
    return forces.repulsion(at, forces.potentials_exact(at))


@query(f"WITH {REP} SELECT id, {_r('rx', 'ry', 'zi')} FROM rp")
def repulsion(spark, sf_dir):
    return r6(_repelled(spark, sf_dir))


@query(f"WITH {REP} SELECT round(sum(zi) - count(*), 4) + 0.0 AS z FROM rp")
def z_normaliser(spark, sf_dir):
    return forces.normaliser(_repelled(spark, sf_dir)).select((F.round("z", 4) + 0.0).alias("z"))


@query(f"WITH {ATTR} SELECT id, {_r('ax', 'ay')} FROM (SELECT id, 1000 * coalesce(ax, 0) AS ax, 1000 * coalesce(ay, 0) AS ay FROM l LEFT JOIN att USING (id))")
def attraction(spark, sf_dir):
    a = forces.attraction(joint_edges(spark, sf_dir), layout(spark, sf_dir))
    return r6(a.select("id", (F.col("ax") * 1000).alias("ax"), (F.col("ay") * 1000).alias("ay")))


STEP = f"""{ATTR}, {REP.split(LAYOUT + ', ', 1)[1]}, z AS (SELECT sum(zi) - count(*) AS z FROM rp),
  st AS (SELECT id, x, y, 12.0 * ax - rx / z AS dx, 12.0 * ay - ry / z AS dy FROM l JOIN att USING (id) JOIN rp USING (id), z),
  gn AS (SELECT id, x, y, greatest(0.01, CASE WHEN dx < 0 THEN 1.2 ELSE 0.8 END)::DOUBLE AS gx, greatest(0.01, CASE WHEN dy < 0 THEN 1.2 ELSE 0.8 END)::DOUBLE AS gy, dx, dy FROM st),
  mv AS (SELECT id, x - 200.0 * gx * dx AS x, y - 200.0 * gy * dy AS y, -200.0 * gx * dx AS ux, -200.0 * gy * dy AS uy, gx, gy FROM gn)"""


def _stepped(spark, sf_dir):
    # written once: the normaliser and the step both read it
    at, e, rep = layout(spark, sf_dir), joint_edges(spark, sf_dir), stored(_repelled(spark, sf_dir), "repulsion")
    return integrate.step(layout_init.with_state(at), forces.attraction(e, at), rep, forces.normaliser(rep), 200.0, 12.0, 0.5)


@query(f"WITH {STEP} SELECT id, {_r('x', 'y', 'ux', 'uy', 'gx', 'gy')} FROM mv")
def integrate_step(spark, sf_dir):
    return r6(_stepped(spark, sf_dir))


@query(f"WITH {STEP} SELECT round(sqrt(sum(ux * ux + uy * uy)), 6) + 0.0 AS norm FROM mv")
def update_norm(spark, sf_dir):
    return r6(linalg.l2_norm(_stepped(spark, sf_dir), "ux", "uy"))


STEPS = 5
FIT = f"""WITH RECURSIVE {JOINT}, s AS (
  SELECT vec_id AS id, 10 * embedding[1]::DOUBLE AS x, 10 * embedding[2]::DOUBLE AS y, 0::DOUBLE AS ux, 0::DOUBLE AS uy, 1::DOUBLE AS gx, 1::DOUBLE AS gy, 0 AS it FROM embeddings
  UNION ALL
  SELECT id, x + nux, y + nuy, nux, nuy, ngx, ngy, it + 1 FROM (
    SELECT *, 0.5 * ux - 200.0 * ngx * dx AS nux, 0.5 * uy - 200.0 * ngy * dy AS nuy FROM (
      SELECT *, greatest(0.01, CASE WHEN (dx < 0) <> (ux < 0) THEN gx + 0.2 ELSE gx * 0.8 END)::DOUBLE AS ngx, greatest(0.01, CASE WHEN (dy < 0) <> (uy < 0) THEN gy + 0.2 ELSE gy * 0.8 END)::DOUBLE AS ngy FROM (
        SELECT r.*, 12.0 * f.ax - rep.rx / rep.z AS dx, 12.0 * f.ay - rep.ry / rep.z AS dy
        FROM (SELECT * FROM s WHERE it < {STEPS}) r
        JOIN (SELECT id, rx, ry, sum(zq) OVER () AS z FROM (
                SELECT a.id, sum(1 / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS zq, sum((a.x - b.x) / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) ^ 2) AS rx,
                       sum((a.y - b.y) / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) ^ 2) AS ry FROM s a, s b WHERE a.id <> b.id GROUP BY a.id)) rep ON rep.id = r.id
        JOIN (SELECT a.id, sum(p * (a.x - b.x) / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS ax, sum(p * (a.y - b.y) / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS ay
              FROM jt, s a, s b WHERE jt.i = a.id AND jt.j = b.id GROUP BY a.id) f ON f.id = r.id))))
  SELECT id, {_r('x', 'y')} FROM s WHERE it = {STEPS}"""


def _short_fit(engine: str):
    def run(spark, sf_dir):
        opt = Options(num_neighbors=OTHERS + 1, perplexity=10, n_iter=STEPS, engine=engine, repulsion="exact")
        e = joint_edges(spark, sf_dir)
        return r6(plan.fit(points(spark, sf_dir), opt, layout(spark, sf_dir), edges=e).layout)

    run.__name__ = f"fit_steps_{engine}"
    query(FIT)(run)


for _engine in ("single_task", "distributed", "dataframe"):
    _short_fit(_engine)


@query(f"""WITH {JOINT}, {LAYOUT}, zz AS (SELECT sum(1 / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS z FROM l a, l b WHERE a.id <> b.id)
  SELECT round(sum(p * (ln(p) - ln(1 / (1 + (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) / z))), 6) + 0.0 AS kl FROM jt JOIN l a ON a.id = jt.i JOIN l b ON b.id = jt.j, zz""")
def kl_divergence(spark, sf_dir):
    return r6(forces.kl_divergence(joint_edges(spark, sf_dir), layout(spark, sf_dir), forces.normaliser(_repelled(spark, sf_dir))))


@query("SELECT s::INT AS step FROM generate_series(0, 1000, 250) t(s)")
def snapshot_steps(spark, sf_dir):
    steps = Options(perplexity=10, return_style="snapshots", n_iter=1000, num_snapshots=5).snapshot_steps()
    return spark.createDataFrame([(s,) for s in steps], "step int")


@query("SELECT s::INT AS step FROM generate_series(0, 998, 249) t(s) UNION ALL SELECT 999")
def snapshot_steps_compat(spark, sf_dir):
    steps = Options(perplexity=10, return_style="snapshots", n_iter=999, num_snapshots=5, snapshot_compat=True).snapshot_steps()
    return spark.createDataFrame([(s,) for s in steps], "step int")


RATIO = f"{KNN}, {LAYOUT}, rt AS (SELECT sqrt(d2) / sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS r FROM kn JOIN l a ON a.id = kn.i JOIN l b ON b.id = kn.j)"


@query(f"WITH {RATIO} SELECT " + ", ".join(f"round(quantile_cont(r, {q}), 6) + 0.0 AS p{round(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM rt")
def distance_ratio_percentiles(spark, sf_dir):
    return r6(quality.distance_ratios(neighbors(spark, sf_dir), layout(spark, sf_dir)))


@query(f"WITH {RATIO} SELECT floor(r / 0.001)::BIGINT AS bucket, count(*) AS n FROM rt GROUP BY 1")
def distance_ratio_histogram(spark, sf_dir):
    return quality.ratio_histogram(neighbors(spark, sf_dir), layout(spark, sf_dir))


@query(f"WITH {KNN} SELECT round(avg((a.label = b.label)::INT), 6) + 0.0 AS purity FROM kn JOIN embeddings a ON a.vec_id = kn.i JOIN embeddings b ON b.vec_id = kn.j")
def label_purity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    return r6(quality.label_purity(neighbors(spark, sf_dir), labels))


@query(f"""WITH {PAIRS}, {LAYOUT}, kn AS (SELECT i, j FROM pr QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= 10),
  lo AS (SELECT a.id AS i, b.id AS j FROM l a, l b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2, b.id) <= 10)
  SELECT round(count(lo.i)::DOUBLE / count(*), 6) + 0.0 AS overlap FROM kn LEFT JOIN lo ON kn.i = lo.i AND kn.j = lo.j""")
def neighbor_overlap(spark, sf_dir):
    return r6(quality.neighbor_overlap(neighbors(spark, sf_dir, 10), layout(spark, sf_dir), 10))


@query(f"""WITH {PAIRS}, {LAYOUT}, rk AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS r FROM pr),
  lo AS (SELECT a.id AS i, b.id AS j FROM l a, l b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2, b.id) <= 10),
  c AS (SELECT count(*) AS n FROM e)
  SELECT round(1 - 2.0 / (n * 10 * (2 * n - 31)) * (SELECT sum(greatest(0, r - 10)) FROM lo JOIN rk USING (i, j)), 6) + 0.0 AS trust FROM c""")
def trustworthiness(spark, sf_dir):
    return r6(quality.trustworthiness(points(spark, sf_dir), layout(spark, sf_dir), 10))


@query("SELECT event_type AS config, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS deviation FROM events GROUP BY event_type")
def run_summary(spark, sf_dir):
    """The timing summary of a sweep, over ``events`` as if values were seconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return r6(sweep.summarise(events.select(F.col("event_type").alias("config"), F.col("value").alias("seconds"))))


@query("SELECT min_by(config, mean) AS config, round(min(mean), 6) + 0.0 AS mean FROM (SELECT event_type AS config, avg(value) AS mean FROM events GROUP BY event_type)")
def fastest_config(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return r6(sweep.fastest(sweep.summarise(events.select(F.col("event_type").alias("config"), F.col("value").alias("seconds")))))


# --- whole fits, initialisers, sinks: rows only


@query(None)
def init_gaussian(spark, sf_dir):
    return layout_init.gaussian(points(spark, sf_dir), 1)


@query(None)
def init_uniform(spark, sf_dir):
    return layout_init.uniform(points(spark, sf_dir), 1)


@query(f"WITH {LAYOUT} SELECT id, {_r('x', 'y')} FROM l")
def init_vector(spark, sf_dir):
    return r6(layout_init.vector(points(spark, sf_dir), layout(spark, sf_dir)))


@query(None)
def fit_default(spark, sf_dir):
    """A full fit: perplexity 10 of 31 others, 1000 steps, one task."""
    return plan.fit(points(spark, sf_dir), Options(perplexity=10)).layout


@query(None)
def fit_fft(spark, sf_dir):
    return plan.fit(points(spark, sf_dir), Options(perplexity=10, n_iter=50, repulsion="fft", symmetrize="full")).layout


@query(None)
def fit_snapshots(spark, sf_dir):
    opt = Options(perplexity=10, n_iter=100, return_style="snapshots", num_snapshots=5)
    return plan.fit(points(spark, sf_dir), opt).snapshots


@query(None)
def fit_groups(spark, sf_dir):
    """A fit for every label by itself."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = emb.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return plan.fit_groups(p, Options(perplexity=5, num_neighbors=16, n_iter=200))


@query(f"WITH {LAYOUT} SELECT f::INT AS frame, id AS idx, {_r('x', 'y')} FROM (SELECT f, id, x * (f + 1) AS x, y * (f + 1) AS y FROM l, (SELECT unnest(range(3)) AS f))")
def dump_roundtrip(spark, sf_dir):
    """Three steps written as a text dump and read back."""
    at = layout(spark, sf_dir).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    path = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    trajectory.write_text(at.select("step", "id", (F.col("x") * (F.col("step") + 1)).alias("x"), (F.col("y") * (F.col("step") + 1)).alias("y")), path)
    return r6(trajectory.read_text(spark, path))


@query(f"WITH {LAYOUT} SELECT f::INT AS step, count(*) AS n, round(least(min(x), min(y)), 6) + 0.0 AS low, round(greatest(max(x), max(y)), 6) + 0.0 AS high, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy FROM (SELECT f, id, x * (f + 1) AS x, y * (f + 1) AS y FROM l, (SELECT unnest(range(3)) AS f)) GROUP BY f")
def streamed_steps(spark, sf_dir):
    """Three published steps, summarised by a streaming query."""
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    for k in range(3):
        at = layout(spark, sf_dir)
        observer.publish(at.select(F.lit(k).cast("int").alias("step"), "id", (F.col("x") * (k + 1)).alias("x"), (F.col("y") * (k + 1)).alias("y")), folder)
    return r6(observer.run_to_end(observer.step_summary(observer.watch(spark, folder))))


@query(None)
def synthetic_blobs(spark, sf_dir):
    """A generator's table, summarised."""
    p = generate.ten_blobs(spark, 2000, 50, seed=3)
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.element_at("features", 1)), 1).alias("mean"))


@query("SELECT vec_id AS id, round(10 * embedding[1]::DOUBLE, 6) + 0.0 AS x, round(10 * embedding[2]::DOUBLE, 6) + 0.0 AS y, label FROM embeddings")
def plot_table(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label")
    return r6(trajectory.plot_table(layout(spark, sf_dir), labels))

