"""Package models: roles, pointer edges, capabilities, readiness and corpus scorecards over decoded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions.bytes import BLOCK, virtual_selector
from leafmill.sources.packages import BODY_TYPE, INDEX_TYPES, TITLE_TYPES

from .classify import closure, coverage_status, readiness
from .joins import first_containing

# Title types of the three rules that differ.
TITLES_BY_RULE = {"toolkit": TITLE_TYPES, "menu": [0x03, 0x04, 0x05, 0x06, 0x07], "verifier": [0x04, 0x05, 0x06, 0x07]}
FORWARD, BACKWARD = "^(FK|FH|KW)", "^(BK|BH)"
EDGE = ["package_id", "kind", "method", "from_component", "from_place", "to_component", "to_place", "status"]


def role(ctype: Column, name: Column, rule: str = "toolkit") -> Column:
    """The role of a component by its type and, for stores, its name."""
    upper = F.upper(name)
    return (
        F.when(ctype == BODY_TYPE, "body").when(ctype.isin(TITLES_BY_RULE[rule]), "title").when(ctype.isin(INDEX_TYPES), "index")
        .when(upper.startswith("MENU"), "menu").when(upper.startswith("COLSCR") | upper.startswith("IMAGE"), "image_store").when(upper.startswith("PCM") | upper.startswith("AUDIO"), "audio_store")
        .when(upper.startswith("MULTI"), "selector").otherwise("other")
    )


def index_serves(name: Column, profile: str) -> Column:
    """Whether an index component is searched for a profile: all for exact and native, by name else."""
    return F.lit(True) if profile in ("exact", "native") else F.upper(name).rlike(FORWARD if profile == "forward" else BACKWARD)


def pointer_edges(points: DataFrame, components: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges of (package_id, component, place, block, offset): to the first component, in catalog order, that holds the block.

    Without a kind the points have a column of that name.

    What none holds is a selector if it has that form, else unresolved; a null pointer is null.
    """
    ranges = components.filter("start_block > 0").select("package_id", F.col("component").alias("to_component"), "start_block", "end_block", "idx")
    # Buckets as wide as a chunk's blocks keep most components in a few.
    met = first_containing(points, ranges, "package_id", "block", "start_block", "end_block", "idx", ["to_component", "start_block"], 64)
    null, chosen = (F.col("block") == 0) & (F.col("offset") == 0), virtual_selector(F.col("block"), F.col("offset"))
    status = F.when(F.col("to_component").isNotNull(), "resolved").when(null, "null").when(chosen > 0, "selector").otherwise("unresolved")
    place = F.when(F.col("to_component").isNotNull(), (F.col("block") - F.col("start_block")) * BLOCK + F.col("offset"))
    return met.select("package_id", F.lit(kind).alias("kind") if kind else "kind", F.lit("block_offset").alias("method"), F.col("component").alias("from_component"), F.col("place").alias("from_place"), "to_component", place.alias("to_place"), status.alias("status"))


def index_edges(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Body and title pointers of index rows as edges."""
    at = (F.col("page_idx") * 10_000 + F.col("row_idx")).cast("long")
    # Both pointers of a row in one pass: what the rows are made of is read once.
    ends = F.array(*[F.struct(F.lit(f"index_{c}").alias("kind"), F.col(f"{c}.block").alias("block"), F.col(f"{c}.offset").alias("offset"), F.col(c).isNotNull().alias("there")) for c in ("body", "title")])
    points = rows.select("package_id", "component", at.alias("place"), F.explode(ends).alias("e")).filter("e.there")
    return pointer_edges(points.select("package_id", "component", "place", "e.kind", "e.block", "e.offset"), components)


def menu_edges(lines: DataFrame, components: DataFrame) -> DataFrame:
    """Destinations of menu links as edges."""
    each = lines.select("package_id", "component", "byte_start", F.explode("links").alias("l")).filter("l.block is not null")
    return pointer_edges(each.select("package_id", "component", F.col("byte_start").cast("long").alias("place"), "l.block", "l.offset"), components, "menu_destination")


def media_edges(refs: DataFrame, components: DataFrame) -> DataFrame:
    """Starts of media references as edges."""
    points = refs.select("package_id", "component", F.col("start").cast("long").alias("place"), F.col("start_block").alias("block"), F.col("start_offset").alias("offset"))
    return pointer_edges(points, components, "media")


def anchor_edges(anchors: DataFrame, sidecar: DataFrame, key: str = "id", scale: int = 1) -> DataFrame:
    """Dense anchors to sidecar rows by id, or by id / scale; an id that scale doesn't divide is an invalid pointer."""
    keyed = anchors.withColumn("key_", F.when(F.col("data_id") % scale == 0, (F.col("data_id") / scale).cast("long")))
    there = sidecar.select(F.col("dir").alias("package_id"), F.col(key).cast("long").alias("key_")).distinct().withColumn("hit", F.lit(True))
    met = keyed.join(there, ["package_id", "key_"], "left")
    status = F.when(F.col("key_").isNull(), "invalid_pointer").when(F.col("hit"), "resolved").otherwise("missing_target")
    method = "row_id" if scale == 1 else "scaled_row_id"
    return met.select("package_id", F.lit("dense_anchor").alias("kind"), F.lit(method).alias("method"), F.col("component").alias("from_component"), (F.col("record_idx") * 32).cast("long").alias("from_place"), F.lit("sidecar").alias("to_component"), F.col("key_").alias("to_place"), status.alias("status"))


def component_counts(components: DataFrame) -> DataFrame:
    """(package_id, role, status, n): what a package's components are."""
    return components.groupBy("package_id", role(F.col("ctype"), F.col("component")).alias("role"), "status").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("package_id", "kind", "status").agg(F.count("*").alias("n"))


CAPABILITIES = ["body", "indexes", "titles", "glyphs", "media", "menus"]
#: profile -> (column or count, statuses or None for any count above zero, blocker), in the order in which blockers are named.
BLOCKERS = {
    "read": [("body", ["unknown"], "body_source_unknown"), ("indexes", ["no", "partial", "unknown"], "indexes_not_fully_parsed"), ("issues", None, "unknown_or_structural_text_issues"), ("parse_errors", None, "component_parse_errors")],
    "export": [
        ("body", ["no"], "body_requires_sidecar_or_is_missing"), ("body", ["unknown"], "body_source_unknown"), ("indexes", ["no", "partial", "unknown"], "indexes_not_fully_parsed"),
        ("glyphs", ["no", "partial", "unknown"], "glyphs_not_fully_resolved"), ("media", ["no", "partial", "unknown"], "media_not_fully_resolved"), ("issues", None, "unknown_or_structural_text_issues"),
        ("parse_errors", None, "component_parse_errors"), ("needs_sidecar", None, "raw_body_not_self_contained"),
    ],
    "author_core": [("indexes", ["no", "partial", "unknown"], "indexes_not_fully_parsed"), ("issues", None, "unknown_or_structural_text_issues"), ("parse_errors", None, "component_parse_errors")],
}
BLOCKERS["lossless_repack"] = [("missing", None, "missing_declared_components"), *BLOCKERS["export"], ("titles", ["no", "partial", "unknown"], "titles_not_fully_parsed"), ("menus", ["no", "partial", "unknown"], "menu_not_fully_resolved")]
RED = ["body_requires_sidecar_or_is_missing", "body_source_unknown", "indexes_not_fully_parsed", "unknown_or_structural_text_issues", "component_parse_errors"]


def capabilities(components: DataFrame, edges: DataFrame, coverage: DataFrame, glyphs: DataFrame | None = None, sidecar_bodies: DataFrame | None = None) -> DataFrame:
    """One row a package: CAPABILITIES as yes, partial, no or n/a, each with its reason, with blockers and a colour.

    coverage: (package_id, bytes, issues) of decoded streams; glyphs: (package_id, status, unresolved, occurrences);
    sidecar_bodies: (package_id) whose body is only an anchor table. Media are stores, partial where a reference leads nowhere.
    """
    spark = components.sparkSession
    rolled = components.withColumn("role", role(F.col("ctype"), F.col("component")))
    rolled = rolled.withColumn("role", F.when(F.col("role").isin("image_store", "audio_store"), "media").otherwise(F.col("role")))
    n = lambda r, ok=False: F.count_if((F.col("role") == r) & ((F.col("status") == "ok") | F.lit(not ok)))
    per = rolled.groupBy("package_id").agg(
        *[e for r in ("body", "title", "index", "menu", "media") for e in (n(r).alias(f"n_{r}"), n(r, True).alias(f"ok_{r}"))],
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(~F.col("status").isin("ok", "missing")).alias("parse_errors"))
    lost = lambda test: F.count_if(test & F.col("status").isin("unresolved", "missing_target", "invalid_pointer"))
    kinds = edges.groupBy("package_id").agg(lost(F.col("kind").startswith("index_")).alias("lost_index"), lost(F.col("kind") == "menu_destination").alias("lost_menu"), lost(F.col("kind") == "media").alias("lost_media"))
    issues = coverage.groupBy("package_id").agg(F.sum("issues").alias("issues"))
    seen = glyphs if glyphs is not None else spark.createDataFrame([], "package_id string, status string, unresolved long, occurrences long")
    sided = sidecar_bodies.select("package_id").distinct() if sidecar_bodies is not None else spark.createDataFrame([], "package_id string")
    rows = per.join(kinds, "package_id", "left").join(issues, "package_id", "left").join(sided.withColumn("needs_sidecar", F.lit(1)), "package_id", "left")
    rows = rows.join(seen.select("package_id", F.col("status").alias("glyphs"), "unresolved", "occurrences"), "package_id", "left").fillna(0).fillna("n/a", ["glyphs"])
    state = lambda r: coverage_status(F.col(f"ok_{r}"), F.col(f"n_{r}"))
    lessened = lambda s, lost: F.when((s == "yes") & (lost > 0), "partial").otherwise(s)
    body = F.when(F.col("needs_sidecar") > 0, "no").otherwise(lessened(state("body"), F.col("issues")))
    said = lambda *names: F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in names])
    rows = rows.select(
        "package_id", body.alias("body"), lessened(state("index"), F.col("lost_index")).alias("indexes"), state("title").alias("titles"), "glyphs",
        lessened(state("media"), F.col("lost_media")).alias("media"), lessened(state("menu"), F.col("lost_menu")).alias("menus"),
        said("ok_body", "n_body", "issues", "needs_sidecar").alias("body_reason"), said("ok_index", "n_index", "lost_index").alias("indexes_reason"), said("ok_title", "n_title").alias("titles_reason"),
        said("occurrences", "unresolved").alias("glyphs_reason"), said("ok_media", "n_media", "lost_media").alias("media_reason"), said("ok_menu", "n_menu", "lost_menu").alias("menus_reason"),
        (F.col("lost_index") + F.col("lost_menu") + F.col("lost_media")).alias("residuals"), "issues", "missing", "parse_errors", "needs_sidecar",
    )
    made = readiness(rows, CAPABILITIES)
    return made.withColumn("closure", closure(F.col("residuals"), F.col("issues"))).drop("residuals")


def readiness_profiles(matrix: DataFrame) -> DataFrame:
    """(package_id, purpose, status, blockers): what keeps a package from being read, exported, written anew or repacked; red, yellow or green."""
    made = None
    for purpose, rules in BLOCKERS.items():
        named = [F.when(F.col(c) > 0 if states is None else F.col(c).isin(states), F.lit(blocker)) for c, states, blocker in rules]
        found = F.array_distinct(F.array_compact(F.array(*named)))
        red = RED + (["missing_declared_components"] if purpose == "lossless_repack" else [])
        status = F.when(F.arrays_overlap("blockers", F.array(*map(F.lit, red))), "red").when(F.size("blockers") > 0, "yellow").otherwise("green")
        own = matrix.select("package_id", F.lit(purpose).alias("purpose"), found.alias("blockers")).select("package_id", "purpose", status.alias("status"), "blockers")
        made = own if made is None else made.unionByName(own)
    return made


def scorecard(matrix: DataFrame, components: DataFrame, edges: DataFrame, more: dict[str, tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """(family, key, n): counters of a corpus in long form, of which any level can be summed again.

    more: further families, each a table with the key of its rows (glyph or media statuses, search
    outcomes, heading sources, sidecar roles, page issues, telemetry of decoding ...).
    """
    counted = lambda df, family, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(family).alias("family"), "key", "n")
    tables = {
        "component_status": (components, F.concat_ws(":", role(F.col("ctype"), F.col("component")), "status")),
        "component_type": (components, F.lower(F.lpad(F.hex("ctype"), 2, "0"))), "component_role": (components, role(F.col("ctype"), F.col("component"))),
        "edge_status": (edges, F.concat_ws(":", "kind", "status")), "edge_method": (edges, F.concat_ws(":", "kind", "method")), "edge_target": (edges.filter("to_component is not null"), F.concat_ws(":", "kind", "to_component")),
        **{name: (matrix, F.col(name)) for name in (*CAPABILITIES, "profile", "closure")},
        "blocker": (matrix.select(F.explode("blockers").alias("b")), F.col("b")), "packages_with_issues": (matrix.filter("issues > 0"), F.lit("any")),
    } | (more or {})
    profiles = readiness_profiles(matrix)
    tables |= {"purpose_status": (profiles, F.concat_ws(":", "purpose", "status")), "purpose_blocker": (profiles.select("purpose", F.explode("blockers").alias("b")), F.concat_ws(":", "purpose", "b"))}
    made = None
    for family, (df, key) in tables.items():
        own = counted(df, family, key)
        made = own if made is None else made.unionByName(own)
    return made


def inconsistencies(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, code, detail, n): files that are missing or opaque, ranges that overlap one before them, pointers that lead nowhere."""
    bad = components.filter("status <> 'ok'").groupBy("package_id", F.concat(F.lit("component_"), "status").alias("code"), F.col("component").alias("detail")).agg(F.count("*").alias("n"))
    # In order of their starts, a range overlaps one before it if it begins at or before the furthest end so far.
    before = Window.partitionBy("package_id").orderBy("start_block", "idx").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct("end_block", "component")).over(before)
    over = components.filter("start_block > 0").withColumn("far", furthest).filter("far.end_block >= start_block")
    over = over.select("package_id", F.lit("overlapping_ranges").alias("code"), F.concat_ws("/", "far.component", "component").alias("detail"), F.lit(1).cast("long").alias("n"))
    lost = edges.filter("status in ('unresolved', 'missing_target', 'invalid_pointer')").groupBy("package_id", F.col("status").alias("code"), F.col("kind").alias("detail")).agg(F.count("*").alias("n"))
    return bad.unionByName(over).unionByName(lost)
