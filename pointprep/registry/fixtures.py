"""Point-cloud views over the driver's tables, once for Spark and once as SQL text.

The expressions below are valid in both engines, so they are stated once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

POINT_BASE = {
    "case_id": "user_id",
    "point_id": "event_id",
    "is_surface": "event_type in ('error','signup')",
    "x": "value",
    "y": "cast(regexp_extract(props, '([0-9]+)', 1) as double)",
    "z": "cast(hour(ts) as double) + cast(minute(ts) as double)/60e0",
    "area": "case when event_type = 'signup' then value/100e0 end",
}
POINT_FIELDS = {
    "sdf_raw": "10e0 - x",
    "gx_raw": "y/100e0",
    "gy_raw": "x/500e0",
    "gz_raw": "z/24e0",
    "sdf": "x - 10e0",
    "gx": "-(y/100e0)",
    "gy": "-(x/500e0)",
    "gz": "-(z/24e0)",
    # A few cases are off in one or two fields, so that outlier rules have something to find.
    "ux": "x/10e0*(case when case_id % 47 = 5 then 40e0 else 1e0 end)",
    "uy": "y/10e0*(case when case_id % 47 in (5, 9) then 30e0 else 1e0 end)",
    "uz": "z - 12e0",
    "p": "x*y/100e0",
    "nut": "(x+1e0)/(y+50e0)",
    "wss_x": "y - 50e0",
    "wss_y": "x - z",
    "wss_z": "z*y/100e0",
}
PRED = {
    "case_id": "l_suppkey",
    "order_id": "l_orderkey",
    "line_id": "l_linenumber",
    "part_id": "l_partkey",
    "channel": "l_returnflag",
    "pred": "l_extendedprice*(1e0-l_discount)",
    "target": "l_quantity*p_retailprice",
    "z": "l_quantity",
    "is_surf": "l_linestatus = 'O'",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exprs(spec: dict[str, str]) -> list[str]:
    return [f"{e} as {n}" for n, e in spec.items()]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").selectExpr(*_exprs(POINT_BASE))
    return base.selectExpr("*", *_exprs(POINT_FIELDS))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel means as leaves: every point belongs to one voxel, up to 12 voxels per case."""
    vox = (
        points(spark, sf_dir)
        .groupBy("case_id", F.floor(F.col("y") / 25e0).alias("vy"), F.floor(F.col("z") / 8e0).alias("vz"))
        .agg(*[r(F.avg(c)).alias(c) for c in ("x", "y", "z")])
    )
    dense = F.row_number().over(W.partitionBy("case_id").orderBy("vy", "vz"))
    return vox.select("case_id", (dense - 1).cast("bigint").alias("leaf_id"), "x", "y", "z")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return line.join(part, line.l_partkey == part.p_partkey).selectExpr(*_exprs(PRED))


# Both engines round the same number, but sums differ in the last bit. The shift keeps
# exact half-way values, which short decimals often are, away from the rounding edge.
_SHIFT = 1.2345678e-2


def R(expr: str, digits: int = 6) -> str:
    """Rounded SQL double without negative zero."""
    return f"(round({expr} + {_SHIFT * 10.0**-digits!r}, {digits}) + 0e0)"


def r(col, digits: int = 6):
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(_SHIFT * 10.0**-digits), digits) + F.lit(0.0)


CTES: dict[str, str] = {
    "f_base": f"select {', '.join(_exprs(POINT_BASE))} from events",
    "f_points": f"select *, {', '.join(_exprs(POINT_FIELDS))} from f_base",
    "f_leaves": f"""select case_id, row_number() over (partition by case_id order by vy, vz) - 1 as leaf_id, x, y, z
      from (select case_id, floor(y/25e0) vy, floor(z/8e0) vz, {R('avg(x)')} x, {R('avg(y)')} y, {R('avg(z)')} z
            from f_points group by 1,2,3)""",
    "f_pred": f"select {', '.join(_exprs(PRED))} from lineitem join part on l_partkey = p_partkey",
}


def define(name: str, text: str) -> None:
    CTES[name] = text


def sql(body: str, recursive: bool = False) -> str:
    """``body`` with the common table expressions it needs, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(definition)
    parts = [f"{n} as ({CTES[n]})" for n in CTES if n in needed]
    body = body.strip()
    if body.lower().startswith("with "):
        body = body[5:]
        if body.lower().startswith("recursive "):
            body, recursive = body[10:], True
        parts.append(body)
        head = ", ".join(parts)
    else:
        head = ", ".join(parts) + " " + body
    if not parts:
        return body
    return ("with recursive " if recursive else "with ") + head


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def U(*parts: str) -> str:
    """SQL twin of functions.rng.uniform; parts are SQL expressions."""
    text = f"concat_ws(':', {', '.join(parts)})"
    return f"((cast(('0x' || substr(md5({text}),1,12)) as bigint) + 5e-1) / 281474976710656e0)"
