"""Column functions for URL paths and operation names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def url_path(url: Column) -> Column:
    """The path of an absolute or rooted URL without trailing slashes; the root is ''."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join_path(*parts: Column) -> Column:
    """Parts joined by single slashes, with a leading one and none at the end."""
    return F.concat(F.lit("/"), F.array_join(segments(F.concat_ws("/", *parts)), "/"))


def template(path: Column) -> Column:
    """Numeric segments become {id}."""
    named = F.transform(segments(path), lambda x: F.when(x.rlike("^[0-9]+$"), "{id}").otherwise(x))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def typed_template(path: Column) -> Column:
    """Typed parameters of three router styles to plain ones: {p:path}, <int:p>, <p> become {p}; no trailing slash."""
    out = F.regexp_replace(F.regexp_replace(path, r"\{(\w+):[^}]*\}", "{$1}"), r"<(?:[^:<>]+:)?(\w+)>", "{$1}")
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/+$", "")).otherwise(out)


def is_internal(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the prefixes or lies below one."""
    hits = [(path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/") for p in prefixes]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def pascal(token: Column) -> Column:
    """Runs of letters and digits, each with an upper-case first letter, put together."""
    parts = F.filter(F.split(token, "[^A-Za-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def operation_base(method: Column, path: Column) -> Column:
    """A name from a method and a path: leading api and version segments go, parameters become By<Name>."""
    parts = segments(path)
    lead = lambda x: F.lower(x).rlike("^(api|v[0-9]+)$")
    # leading ones only: all before the first segment that is another one
    first = F.aggregate(parts, F.lit(0), lambda n, x: F.when((n < 0) | ~lead(x), F.when(n < 0, n).otherwise(-n - 1)).otherwise(n + 1))
    skip = F.when(first < 0, -first - 1).otherwise(first)
    skip = F.when(skip >= F.size(parts), 0).otherwise(skip)  # a path of nothing else keeps it all
    kept = F.slice(parts, skip + 1, F.greatest(F.size(parts), F.lit(1)))
    named = F.transform(kept, lambda x: F.when(x.startswith("{"), F.concat(F.lit("By"), pascal(x))).otherwise(pascal(x)))
    return F.concat(F.lower(method), F.array_join(named, ""))


def common_prefix(rows: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(*keys, prefix): the longest run of plain segments that all paths of a key but the root begin with."""
    parts = rows.select(*keys, segments(F.col(path)).alias("_parts")).where(F.size("_parts") > 0)
    total = rows.select(*keys).distinct().join(parts.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left")
    each = parts.select(*keys, F.posexplode("_parts").alias("_at", "_part")).groupBy(*keys, "_at").agg(F.min("_part").alias("_part"), F.max("_part").alias("_top"), F.count("*").alias("_m"))
    each = each.join(total, keys).withColumn("_same", ((F.col("_part") == F.col("_top")) & (F.col("_m") == F.col("_n")) & ~F.startswith("_part", F.lit("{"))).cast("int"))
    kept = each.withColumn("_ok", F.min("_same").over(Window.partitionBy(*keys).orderBy("_at"))).where("_ok = 1")
    kept = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_part"))).alias("_p"))
    return total.join(kept, keys, "left").select(*keys, F.coalesce(F.concat(F.lit("/"), F.array_join("_p._part", "/")), F.lit("")).alias("prefix"))
