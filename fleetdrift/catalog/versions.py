"""Version ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import inventory
from . import query

R = ("version_ranks",)


@query(
    "version_compare",
    """SELECT a.k, CASE WHEN a.pos < b.pos THEN -1 WHEN a.pos > b.pos THEN 1 ELSE 0 END AS sign
       FROM version_ranks a JOIN version_ranks b ON a.k = b.k + 2""",
    R,
)
def _(t):
    v = t.view("versions").select("k", "ecosystem", "version")
    other = v.select((F.col("k") + 2).alias("k"), F.col("version").alias("other"))
    return v.join(other, "k").select("k", V.compare(F.col("ecosystem"), F.col("version"), F.col("other")).alias("sign"))


@query(
    "version_extremes",
    """SELECT pkg, ecosystem, (array_agg(version ORDER BY pos DESC, version DESC))[1] AS highest,
              (array_agg(version ORDER BY pos, version))[1] AS lowest, count(*) FILTER (WHERE pre) AS n_prerelease
       FROM version_ranks GROUP BY pkg, ecosystem""",
    R,
)
def _(t):
    eco, version = F.col("ecosystem"), F.col("version")
    keyed = t.view("versions").withColumn("key", F.struct(V.version_key(eco, version), version))
    return keyed.groupBy("pkg", "ecosystem").agg(
        F.max_by("version", "key").alias("highest"),
        F.min_by("version", "key").alias("lowest"),
        F.count_if(V.is_prerelease(eco, version)).alias("n_prerelease"),
    )


@query("version_scheme", "SELECT ecosystem, CASE WHEN ecosystem = 'PyPI' THEN 'pep440' ELSE 'semver' END AS scheme, count(*) AS n FROM versions GROUP BY ALL", ("versions",))
def _(t):
    return t.view("versions").groupBy("ecosystem", V.scheme_id(F.col("ecosystem")).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "version_up_to_date",
    """SELECT a.pkg, a.ecosystem, count(*) FILTER (WHERE t.pos <= a.pos) AS n_current, count(*) AS n
       FROM version_ranks a JOIN (SELECT pkg, ecosystem, max(pos) FILTER (WHERE NOT pre) AS pos FROM version_ranks GROUP BY ALL) t
         ON a.pkg = t.pkg AND a.ecosystem = t.ecosystem GROUP BY ALL""",
    R,
)
def _(t):
    v = t.view("versions")
    eco = F.col("ecosystem")
    target = inventory.highest_stable(v.select(F.col("pkg").alias("name"), "ecosystem", "version")).withColumnRenamed("name", "pkg")
    return (
        v.join(target, ["pkg", "ecosystem"])
        .groupBy("pkg", "ecosystem")
        .agg(F.count_if(V.is_up_to_date(eco, F.col("version"), F.col("highest"))).alias("n_current"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "target_version",
    """SELECT pkg, ecosystem, CASE WHEN pkg IN ('Brand#1', 'Brand#2', 'Brand#3') THEN (array_agg(version ORDER BY k))[1]
              ELSE (array_agg(version ORDER BY pos DESC, version DESC) FILTER (WHERE NOT pre))[1] END AS target
       FROM version_ranks GROUP BY pkg, ecosystem""",
    R,
)
def _(t):
    """The latest tag counts where it is published; other packages carry a tag that is not."""
    v = t.view("versions").withColumnRenamed("pkg", "name")
    tags = v.groupBy("name", "ecosystem").agg(
        F.when(F.col("name").isin("Brand#1", "Brand#2", "Brand#3"), F.min_by("version", "k")).otherwise(F.lit("999.0.0")).alias("latest")
    )
    return inventory.target_versions(tags, v).select(F.col("name").alias("pkg"), "ecosystem", "target")


view_ranges = """
SELECT k, pkg, CASE k % 8 WHEN 0 THEN '^1.2.0' WHEN 1 THEN '~2.' || CAST(k % 12 AS STRING) || '.0' WHEN 2 THEN '^0.3.0' WHEN 3 THEN '^0.0.2'
         WHEN 4 THEN '*' WHEN 5 THEN '>=1.0.0' WHEN 6 THEN '1.2.3 || 2.0.0' ELSE '^3.1.0 <4' END AS declared FROM version_rows
"""


@query(
    "resolve_range",
    f"""WITH r AS ({view_ranges}), v AS (SELECT DISTINCT pkg, maj, mnr, pat,
                CAST(maj AS STRING) || '.' || CAST(mnr AS STRING) || '.' || CAST(pat AS STRING) AS version,
                (maj * 100 + mnr) * 100 + pat AS pos FROM version_rows),
             top AS (SELECT pkg, arg_max(version, pos) AS latest FROM v GROUP BY pkg),
             m AS (SELECT r.k, arg_max(v.version, v.pos) AS best,
                     bool_or(v.version = '1.2.3') AS has_exact, bool_or(v.version = '0.0.2') AS has_floor3,
                     bool_or(v.version = '1.2.0') AS f0, bool_or(v.version = '0.3.0') AS f2, bool_or(v.version = '3.1.0') AS f7
                   FROM r JOIN v ON r.pkg = v.pkg AND CASE r.k % 8
                     WHEN 0 THEN v.maj = 1 AND v.mnr >= 2 WHEN 1 THEN v.maj = 2 AND v.mnr = r.k % 12 WHEN 2 THEN v.maj = 0 AND v.mnr = 3
                     WHEN 3 THEN v.version = '0.0.2' WHEN 6 THEN v.version = '1.2.3' WHEN 7 THEN v.maj = 3 AND v.mnr >= 1 ELSE false END
                   GROUP BY r.k)
        SELECT r.k, r.pkg, r.declared, coalesce(m.best, top.latest) AS resolved
        FROM r JOIN top ON r.pkg = top.pkg LEFT JOIN m ON r.k = m.k""",
    ("version_rows",),
)
def _(t):
    published = t.sql(
        """SELECT DISTINCT pkg AS name, CAST(maj AS STRING) || '.' || CAST(mnr AS STRING) || '.' || CAST(pat AS STRING) AS version
           FROM version_rows""",
        "version_rows",
    )
    ranges = t.sql(f"WITH r AS ({view_ranges}) SELECT k, pkg AS name, declared FROM r", "version_rows")
    tags = published.groupBy("name").agg(F.lit(None).cast("string").alias("latest"))
    return inventory.resolve_ranges(ranges, published, tags).select("k", F.col("name").alias("pkg"), "declared", "resolved")


@query(
    "declared_forms",
    """SELECT k, CASE WHEN k % 4 IN (0, 1) THEN maj || '.' || mnr || '.' || pat END AS pin,
              CASE WHEN k % 4 = 3 THEN NULL ELSE maj || '.' || mnr || '.' || pat END AS first_version,
              CASE WHEN k % 4 = 3 THEN NULL WHEN k % 3 = 0 THEN maj || '.' || mnr || '.' || pat END AS specifier
       FROM version_rows""",
    ("version_rows",),
)
def _(t):
    v = t.view("version_rows")
    text = F.concat_ws(".", *[F.col(c).cast("string") for c in ("maj", "mnr", "pat")])
    k = F.col("k") % 4
    declared = (
        F.when(k == 0, text).when(k == 1, F.concat(F.lit("="), text)).when(k == 2, F.concat(F.lit("^"), text, F.lit(" <9"))).otherwise("*")
    )
    specifier = F.when(k == 3, F.lit("==1.*")).when(F.col("k") % 3 == 0, F.concat(F.lit("== "), text)).otherwise(F.concat(F.lit(">="), text))
    return v.select(
        "k",
        V.exact_pin(declared).alias("pin"),
        V.first_version_in(declared).alias("first_version"),
        V.pinned_by_specifier(specifier).alias("specifier"),
    )
