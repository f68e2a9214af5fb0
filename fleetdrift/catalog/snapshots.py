"""Snapshot diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signatures as S
from ..operators import snapshot
from . import Tables, query


def type_params(column="tps"):
    """``T,U=`` -> [{T, required}, {U, defaulted}]"""
    names = F.filter(F.split(F.col(column), ","), lambda n: n != "")
    return F.transform(
        names, lambda n: F.struct(F.regexp_replace(n, "=$", "").alias("name"), n.endswith("=").alias("defaulted"))
    )


def symbols(t: Tables, side: str):
    return t.view(f"symbols_{side}").select(
        "pkg", "path", "kind", "signature", "deprecated", "doc", type_params().alias("type_params")
    )


def surfaces(t: Tables, side: str):
    return t.view("surface_headers").select(
        "pkg", F.col(f"{side}_version").alias("version"), F.col(f"{side}_entry").alias("entry"), F.col(f"{side}_truncated").alias("truncated")
    )


def flags(t: Tables):
    return snapshot.suppression_flags(surfaces(t, "from"), surfaces(t, "to"), symbols(t, "from"), symbols(t, "to"))


def changes(t: Tables, with_moves=False):
    out = snapshot.diff_symbols(symbols(t, "from"), symbols(t, "to"), flags(t), t.view("symbol_aliases"))
    return out if with_moves else out.filter("kind <> 'moved'").drop("moved_to")


E_VIEWS = ("expected_changes",)


@query("snapshot_diff", "SELECT * FROM expected_changes", E_VIEWS)
def _(t):
    return changes(t)


@query(
    "snapshot_diff_counts",
    "SELECT kind, severity, confidence, count(*) AS n, count(DISTINCT pkg) AS n_packages FROM expected_changes GROUP BY ALL",
    E_VIEWS,
)
def _(t):
    return changes(t).groupBy("kind", "severity", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pkg").alias("n_packages")
    )


@query(
    "snapshot_alias_fallback",
    """SELECT a.pkg, a.spelling, a.canonical, t.signature FROM symbol_aliases a
       JOIN symbols_to t ON a.pkg = t.pkg AND a.canonical = t.path""",
    ("symbol_aliases", "symbols_to"),
)
def _(t):
    both = snapshot.paired(symbols(t, "from"), symbols(t, "to"), t.view("symbol_aliases"))
    return both.filter("via_alias").select(
        "pkg", F.col("path").alias("spelling"), F.concat("path", F.lit("_canon")).alias("canonical"), F.col("to_signature").alias("signature")
    )


@query(
    "snapshot_moved",
    """SELECT f.pkg, f.path, t.path AS moved_to FROM symbols_from f JOIN symbols_to t ON f.k = t.k
       JOIN surface_headers h ON f.pkg = h.pkg
       WHERE f.k % 17 = 0 AND f.k % 51 <> 0 AND h.to_entry IS NOT NULL AND NOT h.to_truncated""",
    ("symbols_from", "symbols_to", "surface_headers"),
)
def _(t):
    return changes(t, with_moves=True).filter("kind = 'moved'").select("pkg", "path", "moved_to")


@query(
    "snapshot_identity",
    "SELECT kind, count(*) AS n FROM (SELECT 'deprecated' AS kind FROM symbols_to WHERE deprecated) d GROUP BY kind",
    ("symbols_to",),
)
def _(t):
    same = symbols(t, "to")
    return snapshot.diff_symbols(same, same).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "suppression_flags",
    """SELECT pkg, to_entry IS NULL AS unanalyzable, to_truncated OR to_entry IS NULL AS hide_removals,
              from_truncated OR to_entry IS NULL AS hide_additions,
              concat_ws('; ', CASE WHEN to_entry IS NULL THEN pkg || '@' || to_version || ' ships no type declarations' END,
                CASE WHEN to_truncated THEN pkg || '@' || to_version || ' surface was truncated; removals are not reported' END,
                CASE WHEN from_truncated THEN pkg || '@' || from_version || ' surface was truncated; additions are not reported' END
              ) AS note
       FROM surface_headers""",
    ("surface_headers",),
)
def _(t):
    return flags(t).select("pkg", "unanalyzable", "hide_removals", "hide_additions", F.array_join("notes", "; ").alias("note"))


@query("consumer_impacting", "SELECT pkg, path, kind, severity FROM impacting_changes", ("impacting_changes",))
def _(t):
    return snapshot.consumer_impacting(changes(t)).select("pkg", "path", "kind", "severity")


@query(
    "change_reading_order",
    """SELECT pkg, path, kind, CASE severity WHEN 'breaking' THEN 0 WHEN 'deprecation' THEN 1 WHEN 'feature' THEN 2
              WHEN 'safe' THEN 3 ELSE 9 END AS rank, len(string_split(path, '.')) AS depth FROM impacting_changes""",
    ("impacting_changes",),
)
def _(t):
    return snapshot.reading_order(snapshot.consumer_impacting(changes(t))).select(
        "pkg", "path", "kind", "rank", F.col("depth").cast("bigint").alias("depth")
    )


@query(
    "headline_changes",
    "SELECT severity, severity IN ('breaking', 'deprecation') AS headline, count(*) AS n FROM expected_changes GROUP BY ALL",
    E_VIEWS,
)
def _(t):
    return changes(t).groupBy("severity", snapshot.in_headline(F.col("severity")).alias("headline")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "capability_additions",
    """SELECT pkg, path, symbol_kind FROM expected_changes WHERE kind = 'added' AND path NOT LIKE '%.%'
       AND coalesce(symbol_kind, 'unknown') IN ('function', 'class', 'variable', 'enum', 'unknown')""",
    E_VIEWS,
)
def _(t):
    return snapshot.capability_additions(changes(t)).select("pkg", "path", "symbol_kind")


# Signature scanners, each against arithmetic that knows what the text was made of.


@query(
    "signature_required_arity",
    """SELECT k, path, CASE WHEN k % 17 = 0 OR k % 23 = 0 OR k % 29 = 0 THEN NULL WHEN k % 7 = 0 THEN 3 WHEN k % 5 = 0 THEN 1
              ELSE 2 END AS arity FROM symbols_to""",
    ("symbols_to",),
)
def _(t):
    return t.view("symbols_to").select("k", "path", S.required_arity("signature").alias("arity"))


@query(
    "signature_positional_params",
    """SELECT k, path, CASE WHEN k % 17 = 0 OR k % 23 = 0 OR k % 29 = 0 THEN signature
              WHEN k % 7 = 0 THEN '(p0: ' || t || ',p1: number,p2: string) => ' || ret
              WHEN k % 5 = 0 THEN '(p0: ' || t || ',p1?: number) => ' || ret
              WHEN k % 22 = 0 THEN '(p0:  ' || t || ',p1: number) => ' || ret
              ELSE '(p0: ' || t || ',p1: number) => ' || ret END AS positional
       FROM symbols_to JOIN api_parts USING (k)""",
    ("symbols_to",),
)
def _(t):
    return t.view("symbols_to").select("k", "path", S.positional_params("signature").alias("positional"))


@query(
    "signature_change_ladder",
    """SELECT k, CASE WHEN k % 23 = 0 THEN 'feature' WHEN k % 29 = 0 OR k % 7 = 0 THEN 'breaking' ELSE 'drift' END AS severity,
              CASE WHEN k % 23 = 0 OR k % 29 = 0 OR k % 7 = 0 THEN 'high' ELSE 'medium' END AS confidence
       FROM symbols_from WHERE k % 17 <> 0""",
    ("symbols_from",),
)
def _(t):
    a = t.view("symbols_from").select("k", F.col("signature").alias("a"), type_params().alias("ta"))
    b = t.view("symbols_to").select("k", F.col("signature").alias("b"), type_params().alias("tb"))
    both = a.filter(~S.is_typeof(F.col("a"))).join(b, "k")
    ladder = S.signature_change_class("ta", "tb", "a", "b")
    return both.select("k", ladder.alias("c")).select("k", "c.severity", "c.confidence")


@query(
    "signature_printer_suffix",
    """SELECT k, '(a: ' || t || ', b: number) => Type$' || t AS plain FROM api_parts""",
    ("api_parts",),
)
def _(t):
    printed = F.concat(
        F.lit("(a: "), F.col("t"), F.lit("_"), (F.col("k") % 4 + 1).cast("string"), F.lit(", b: number) => Type$"), F.col("t"), F.lit("_12")
    )
    return t.view("api_parts").select("k", S.without_printer_suffixes(printed).alias("plain"))


@query(
    "signature_normalise",
    """SELECT doc_id, flat AS signature
       FROM (SELECT doc_id, 'Map<"pkg/index">' || CASE WHEN trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) = '' THEN ''
             ELSE ' ' || trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) END AS flat FROM documents) d""",
)
def _(t):
    raw = F.concat(F.lit('import("/home/u/x").Map<"/home/u/cache/pkg/1.2.3/package/index">\n  '), F.col("text"))
    return t.table("documents").select("doc_id", S.normalise_signature(raw).alias("signature"))


@query(
    "agreed_type_aliases",
    "SELECT pkg, leaf AS name, t AS expansion FROM api_parts WHERE k % 3 <> 1",
    ("api_parts",),
)
def _(t):
    a = t.sql("SELECT pkg, leaf AS name, t AS expansion FROM api_parts", "api_parts")
    b = t.sql(
        "SELECT pkg, leaf AS name, CASE WHEN k % 3 = 0 THEN t || '_2' WHEN k % 3 = 1 THEN t || 'Other' ELSE t END AS expansion FROM api_parts",
        "api_parts",
    )
    return snapshot.agreed_aliases(a, b)


@query("agreed_type_defaults", "SELECT pkg, leaf AS name FROM api_parts WHERE k % 4 <> 2", ("api_parts",))
def _(t):
    base = t.view("api_parts")
    ours = base.select("pkg", F.col("leaf").alias("name"), F.array("t", F.lit("unknown")).alias("defaults"))
    theirs = base.select(
        "pkg",
        F.col("leaf").alias("name"),
        F.when(F.col("k") % 4 == 1, F.array(F.col("t")))
        .when(F.col("k") % 4 == 2, F.array(F.col("t"), F.lit("never")))
        .when(F.col("k") % 4 == 3, F.array(F.concat("t", F.lit("_3")), F.lit("unknown"), F.lit("x")))
        .otherwise(F.array("t", F.lit("unknown")))
        .alias("defaults"),
    )
    return snapshot.agreed_defaults(ours, theirs)


@query(
    "snapshot_diff_aliased_types",
    "SELECT pkg, 'm' || CAST(k AS STRING) AS path FROM api_parts WHERE k % 3 = 1",
    ("api_parts",),
)
def _(t):
    """Signatures spelled through an alias on one side only: equal where both versions define the alias alike."""
    base = t.view("api_parts").withColumn("alias", F.concat(F.lit("Al"), F.col("leaf")))

    def side(signature):
        return base.select(
            "pkg",
            F.concat(F.lit("m"), F.col("k").cast("string")).alias("path"),
            F.lit("function").alias("kind"),
            signature.alias("signature"),
            F.lit(False).alias("deprecated"),
            F.lit("").alias("doc"),
            F.array().cast("array<struct<name:string,defaulted:boolean>>").alias("type_params"),
        )

    old = side(F.concat(F.lit("(a: "), "alias", F.lit(") => void")))
    new = side(F.concat(F.lit("(b: "), "t", F.lit(") => void")))
    ours = base.select("pkg", F.col("alias").alias("name"), F.col("t").alias("expansion"))
    theirs = base.select(
        "pkg", F.col("alias").alias("name"), F.when(F.col("k") % 3 == 1, F.lit("other")).otherwise(F.col("t")).alias("expansion")
    )
    diff = snapshot.diff_symbols(old, new, agreed_aliases=snapshot.agreed_aliases(ours, theirs))
    return diff.filter("kind = 'signature-changed'").select("pkg", "path")
