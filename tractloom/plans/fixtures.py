"""Views over the test tables that stand in for tract data, in Spark and as SQL text.

Every view grows with its source table. The SQL twins are used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom.functions.geometry import Grid
from tractloom.functions.numeric import lit
from tractloom.functions.ranking import two_stage_rank

# The shared tract space: 2 mm isotropic, origin (-50, -50, -40), 50 x 50 x 60 voxels
GRID = Grid(((2.0, 0.0, 0.0, -50.0), (0.0, 2.0, 0.0, -50.0), (0.0, 0.0, 2.0, -40.0),
             (0.0, 0.0, 0.0, 1.0)), (50, 50, 60))
BAND = (60.0, 200.0)
MIDLINE = 0.123
N_SUBJECTS = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- streamline points (lineitem)

def points(spark: SparkSession, sf: str) -> DataFrame:
    """One streamline per part key; its rows in ship-date order are the vertices."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("streamline_id"), "l_shipdate", "l_orderkey", "l_linenumber",
        "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    o = two_stage_rank(li, ["streamline_id"], F.col("l_shipdate"), [F.col(c) for c in (
        "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax")], out="pt_idx")
    s, i = F.col("streamline_id"), F.col("pt_idx").cast("int")
    x = ((s % 41 - 20).cast("double") + (F.col("l_quantity") - lit(25.5)) / lit(12.5)
         + F.when(s % 17 == 0, (i - 15).cast("double") * lit(1.5)).otherwise(lit(0.0)))
    y = (s * 7 % 31 - 15).cast("double") + (F.col("l_discount") - lit(0.05)) * lit(40.0)
    z = (lit(-30.0) + lit(2.0) * F.when(s % 5 == 0, 40 - i).otherwise(i).cast("double")
         + F.col("l_tax") * lit(10.0))
    return o.select((s % N_SUBJECTS).alias("subject_id"), s, i.alias("pt_idx"),
                    x.alias("x"), y.alias("y"), z.alias("z"))


SQL_POINTS = """pts AS (
  SELECT streamline_id % 8 AS subject_id, streamline_id, pt_idx,
    (streamline_id % 41 - 20) + (q - 255e-1) / 125e-1
      + CASE WHEN streamline_id % 17 = 0 THEN (pt_idx - 15) * 15e-1 ELSE 0e0 END AS x,
    (streamline_id * 7 % 31 - 15) + (d - 5e-2) * 4e1 AS y,
    -3e1 + 2e0 * (CASE WHEN streamline_id % 5 = 0 THEN 40 - pt_idx ELSE pt_idx END) + t * 1e1 AS z
  FROM (SELECT l_partkey AS streamline_id,
          CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
            l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS INT) AS pt_idx,
          l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem))"""

SQL_VOX = SQL_POINTS + """,
vox AS (SELECT *, i >= 0 AND i < 50 AND j >= 0 AND j < 50 AND k >= 0 AND k < 60 AS inb
  FROM (SELECT *, CAST(round_even((x + 5e1) / 2e0, 0) AS INT) AS i,
          CAST(round_even((y + 5e1) / 2e0, 0) AS INT) AS j,
          CAST(round_even((z + 4e1) / 2e0, 0) AS INT) AS k FROM pts))"""

SQL_LENS = """,
lens AS (SELECT subject_id, streamline_id, count(*) AS n_points, coalesce(sum(d), 0e0) AS length
  FROM (SELECT subject_id, streamline_id, sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) AS d
        FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM pts
              WINDOW w AS (PARTITION BY streamline_id ORDER BY pt_idx)))
  GROUP BY 1, 2)"""

SQL_FLAGS = """,
flags AS (SELECT subject_id, streamline_id,
    bool_or(inb AND k BETWEEN 4 AND 9) AS bs,
    bool_or(inb AND k BETWEEN 26 AND 40 AND i < 25) AS ml,
    bool_or(inb AND k BETWEEN 26 AND 40 AND i >= 25) AS mr,
    min(x) AS xmin, max(x) AS xmax, avg(x) AS xmean, min(z) AS zmin,
    arg_min(x, pt_idx) FILTER (WHERE inb AND k BETWEEN 4 AND 9) AS entry_x
  FROM vox GROUP BY 1, 2)"""


def sql_fates(midline: str = "0e0") -> str:
    """points, voxels, lengths, flags and the fate of every streamline, as CTE text."""
    return SQL_VOX + SQL_LENS + SQL_FLAGS + f""",
fates AS (SELECT f.*, n_points, length, length BETWEEN 6e1 AND 2e2 AS in_band,
    CASE WHEN NOT (length BETWEEN 6e1 AND 2e2) THEN 'length'
         WHEN NOT bs THEN 'no_brainstem'
         WHEN ml AND mr THEN 'bilateral_excluded'
         WHEN xmin < {midline} - 8e0 AND xmax > {midline} + 8e0 THEN 'midline_excluded'
         WHEN ml THEN 'left' WHEN mr THEN 'right' ELSE 'no_motor' END AS fate
  FROM flags f JOIN lens l USING (subject_id, streamline_id))"""


# scalar maps of the shared tract space, by closed form of the voxel
SQL_MAPS = {
    "fa": "((i*7 + j*3 + k*11) % 97) / 97e0",
    "md": "(1 + (i + 2*j + 3*k) % 13) * 1e-4",
    "rd": "(1 + (i + 2*j + 3*k + 1) % 13) * 1e-4",
    "ad": "(1 + (i + 2*j + 3*k + 2) % 13) * 1e-4",
}


def _space(spark: SparkSession) -> DataFrame:
    nx, ny, nz = GRID.shape
    per = nx * ny * nz
    v = F.col("id") % per
    return spark.range(N_SUBJECTS * per).select(
        F.floor(F.col("id") / per).cast("bigint").alias("subject_id"),
        F.floor(v / (ny * nz)).cast("int").alias("i"),
        (F.floor(v / nz) % ny).cast("int").alias("j"), (v % nz).cast("int").alias("k"))


def voxels(spark: SparkSession) -> DataFrame:
    """Dense FA/MD/RD/AD maps of the eight subjects of ``points``."""
    i, j, k = F.col("i"), F.col("j"), F.col("k")

    def dif(c: int) -> Column:
        return (1 + (i + 2 * j + 3 * k + c) % 13).cast("double") * lit(1e-4)

    return _space(spark).select(
        "subject_id", "i", "j", "k",
        (((i * 7 + j * 3 + k * 11) % 97).cast("double") / lit(97.0)).alias("fa"),
        dif(0).alias("md"), dif(1).alias("rd"), dif(2).alias("ad"))


def roi_voxels(spark: SparkSession) -> DataFrame:
    i, k = F.col("i"), F.col("k")
    roi = (F.when(k.between(4, 9), "brainstem")
           .when(k.between(26, 40) & (i < 25), "motor_left")
           .when(k.between(26, 40) & (i >= 25), "motor_right"))
    return _space(spark).withColumn("roi", roi).where(F.col("roi").isNotNull())


# ------------------------------------------------ one small volume per supplier (voxel operators)

BOX = 12
#: Volumes that one task makes, about.
TASK_VOLUMES = 64


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    """12^3 voxels per supplier: FA, raw atlas label, brain mask.

    Suppliers are dealt over tasks before their voxels are made, as their file is one small split, and
    a task makes those of about ``TASK_VOLUMES``; the product with the places of a box lets Spark know
    how large the table is, which it does not of an explode.
    """
    s = F.col("subject_id")
    people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-people.count() // TASK_VOLUMES))
    places = spark.range(0, BOX ** 3, 1, 1).select(F.col("id").cast("int").alias("v"))
    v = people.repartition(parts, "subject_id").crossJoin(F.broadcast(places))
    v = v.select("subject_id", F.expr("v div 144").cast("int").alias("i"),
                 F.expr("(v div 12) % 12").cast("int").alias("j"),
                 F.expr("v % 12").cast("int").alias("k"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    label = (F.when((k <= 3) & i.between(4, 7) & j.between(3, 8), 8)
             .when((k >= 8) & ((i * 3 + j * 5 + k + s) % 7 == 0), 7)
             .when((i + j + k + s) % 23 == 0, 16).otherwise(0))
    brain = ((i - 5.5) * (i - 5.5) + (j - 5.5) * (j - 5.5) + (k - 5.5) * (k - 5.5)).cast("double") <= 36.0
    fa = ((i * 7 + j * 3 + k * 11 + s) % 97).cast("double") / lit(97.0)
    return v.select("subject_id", "i", "j", "k", fa.alias("fa"),
                    label.cast("int").alias("label"), brain.alias("brain"))


SQL_VOLUMES = """vol AS (
  SELECT *, ((i*7 + j*3 + k*11 + subject_id) % 97) / 97e0 AS fa,
    CAST(CASE WHEN k <= 3 AND i BETWEEN 4 AND 7 AND j BETWEEN 3 AND 8 THEN 8
         WHEN k >= 8 AND (i*3 + j*5 + k + subject_id) % 7 = 0 THEN 7
         WHEN (i + j + k + subject_id) % 23 = 0 THEN 16 ELSE 0 END AS INT) AS label,
    (i - 55e-1)*(i - 55e-1) + (j - 55e-1)*(j - 55e-1) + (k - 55e-1)*(k - 55e-1) <= 36e0 AS brain
  FROM (SELECT s_suppkey AS subject_id, CAST(v // 144 AS INT) AS i, CAST((v // 12) % 12 AS INT) AS j,
          CAST(v % 12 AS INT) AS k FROM supplier, range(1728) t(v)))"""


def volume_grids(spark: SparkSession, sf: str) -> DataFrame:
    """One grid per supplier: varying voxel size, origin, flips and a small shear."""
    s = F.col("s_suppkey")
    sx = F.when(s % 2 == 0, lit(1.0)).otherwise(lit(-1.0)) * (lit(2.0) + (s % 3).cast("double") * lit(0.5))
    sh = F.when(s % 4 == 1, lit(0.25)).otherwise(lit(0.0))
    ox = -sx * lit(6.0) + (s % 5).cast("double") - lit(2.0)
    zero, one = lit(0.0), lit(1.0)
    return table(spark, sf, "supplier").select(
        s.alias("subject_id"),
        F.array(sx, sh, zero, ox, zero, lit(2.0), zero, lit(-12.0), zero, zero, lit(2.5), lit(-20.0),
                zero, zero, zero, one).alias("affine"),
        F.lit(BOX).alias("nx"), F.lit(BOX).alias("ny"), F.lit(BOX).alias("nz"))


SQL_VOLUME_GRIDS = """grd AS (
  SELECT *, -sx * 6e0 + (subject_id % 5) - 2e0 AS ox FROM (
    SELECT s_suppkey AS subject_id,
      (CASE WHEN s_suppkey % 2 = 0 THEN 1e0 ELSE -1e0 END) * (2e0 + (s_suppkey % 3) * 5e-1) AS sx,
      CASE WHEN s_suppkey % 4 = 1 THEN 25e-2 ELSE 0e0 END::DOUBLE AS sh FROM supplier))"""
# world of a voxel in those grids: x = sx*i + sh*j + ox, y = 2*j - 12, z = 2.5*k - 20
SQL_WORLD_X = "(sx*i + sh*j + ox)"
SQL_WORLD_Y = "(2e0*j - 12e0)"
SQL_WORLD_Z = "(25e-1*k - 2e1)"


# ------------------------------------------------------------------ acquisition (events)

def gradients(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("subject_id"), "ts", "event_id", "event_type")
    r = two_stage_rank(e, ["subject_id"], F.to_date("ts"), [F.col("ts"), F.col("event_id")], out="vol_idx")
    n = F.col("event_id")
    bval = (F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1000)
            .when(F.col("event_type") == "click", 1000 + (n % 4) * 30)
            .when(F.col("event_type") == "purchase", 2000).otherwise(3000))
    return r.select(
        "subject_id", F.col("vol_idx").cast("int").alias("vol_idx"), bval.cast("double").alias("bval"),
        (n % 3 - 1).cast("double").alias("bx"), (F.expr("event_id div 3") % 3 - 1).cast("double").alias("by"),
        (F.expr("event_id div 9") % 3 - 1).cast("double").alias("bz"))


SQL_GRADIENTS = """grad AS (
  SELECT user_id AS subject_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS vol_idx,
    CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1000 WHEN 'click' THEN 1000 + (event_id % 4) * 30
         WHEN 'purchase' THEN 2000 ELSE 3000 END AS DOUBLE) AS bval,
    CAST(event_id % 3 - 1 AS DOUBLE) AS bx, CAST((event_id // 3) % 3 - 1 AS DOUBLE) AS by_,
    CAST((event_id // 9) % 3 - 1 AS DOUBLE) AS bz FROM events)"""


def r6(expr: str, places: int = 6) -> str:
    """SQL twin of ``functions.numeric.rnd``."""
    return f"(round_even(({expr}) * 1e{places}, 0) / 1e{places} + 0e0)"
