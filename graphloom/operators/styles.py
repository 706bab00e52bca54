"""Questions to pages and style sheets: what loads, what a declaration comes to, which one wins, and what stands on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import fixpoint
from graphloom.operators.web import EXACT

#: Shorthand properties and what they set, one step; fixed values of the style language.
SHORTHAND = {
    "background": ["background-color", "background-image", "background-position", "background-repeat", "background-size"],
    "border": ["border-width", "border-style", "border-color"],
    "border-color": ["border-top-color", "border-right-color", "border-bottom-color", "border-left-color"],
    "border-style": ["border-top-style", "border-right-style", "border-bottom-style", "border-left-style"],
    "border-width": ["border-top-width", "border-right-width", "border-bottom-width", "border-left-width"],
    "flex": ["flex-grow", "flex-shrink", "flex-basis"],
    "font": ["font-style", "font-weight", "font-size", "line-height", "font-family"],
    "inset": ["top", "right", "bottom", "left"],
    "list-style": ["list-style-type", "list-style-position", "list-style-image"],
    "margin": ["margin-top", "margin-right", "margin-bottom", "margin-left"],
    "overflow": ["overflow-x", "overflow-y"],
    "padding": ["padding-top", "padding-right", "padding-bottom", "padding-left"],
    "transition": ["transition-property", "transition-duration", "transition-timing-function", "transition-delay"],
}


def longhands() -> dict[str, list[str]]:
    """Each shorthand with all that it sets, over any number of steps."""

    def all_of(name: str) -> list[str]:
        return [y for x in SHORTHAND[name] for y in ([x, *all_of(x)] if x in SHORTHAND else [x])]

    return {name: all_of(name) for name in SHORTHAND}


def expanded(declared: DataFrame) -> DataFrame:
    """declared (property, …) and a row for each longhand that a shorthand sets, with the shorthand's name in via."""
    known = F.create_map(*[x for k, v in longhands().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = F.concat(F.array(F.col("property")), F.coalesce(known[F.col("property")], F.array().cast("array<string>")))
    return declared.withColumn("via", F.col("property")).withColumn("property", F.explode(each))


def colour(value: Column) -> Column:
    """#abc, #AABBCC and rgb(1, 2, 3) as #rrggbb; anything else in small letters."""
    low = F.lower(F.trim(value))
    short = F.regexp_replace(low, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    pattern = r"^rgba?\(\s*(\d+)\s*[, ]\s*(\d+)\s*[, ]\s*(\d+)\s*\)$"
    part = lambda k: F.lower(F.lpad(F.hex(F.regexp_extract(low, pattern, k).cast("int")), 2, "0"))
    return F.when(low.rlike(pattern), F.concat(F.lit("#"), part(1), part(2), part(3))).otherwise(short)


def media_bound(query: Column, side: str) -> Column:
    """Pixels of min-width or max-width (side: min or max) in a media query; em and rem count 16."""
    pattern = rf"{side}-width\s*:\s*([0-9.]+)\s*(px|r?em)"
    number = F.nullif(F.regexp_extract(query, pattern, 1), F.lit("")).try_cast("double")
    return number * F.when(F.regexp_extract(query, pattern, 2) == "px", 1).otherwise(16)


def custom_properties(declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (selector, name, value) and uses (selector, property, name) of --names."""
    defined = declared.filter(F.col("property").startswith("--")).select("selector", F.col("property").alias("name"), "value")
    used = declared.select("selector", "property", F.explode(F.regexp_extract_all("value", F.lit(r"var\(\s*(--[\w-]+)"), 1)).alias("name"))
    return defined, used


def cascade(candidates: DataFrame) -> DataFrame:
    """candidates with place: 1 wins. page_id, element, property, important, inline, specificity, position (later wins), status.

    A declaration that only may apply comes after those that surely do only if it would win: it keeps its place, and winner
    is sure where the first place is."""
    order = Window.partitionBy("page_id", "element", "property").orderBy(F.desc("important"), F.desc("inline"), F.desc("specificity"), F.desc("position"))
    placed = candidates.withColumn("place", F.row_number().over(order))
    return placed.withColumn("sure", F.first("status").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == EXACT)


def loads(links: DataFrame, sheets: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, sheet, place) that pages load, those over imports after their own; and (page_id, href, reason) of links to no known sheet.

    links: page_id, href, place; sheets: sheet; imports: sheet, imported."""
    known = sheets.select("sheet").distinct()
    direct = links.join(known, F.col("href") == F.col("sheet")).select("page_id", "sheet", "place")
    steps = imports.select("sheet", "imported").distinct()
    # a sheet's place on a page is that of the first link that leads to it
    every = fixpoint(direct, lambda fresh: fresh.join(steps, "sheet").select("page_id", F.col("imported").alias("sheet"), "place"), ["page_id", "sheet", "place"])
    every = every.groupBy("page_id", "sheet").agg(F.min("place").alias("place"))
    reason = F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^//"), "external").when(F.col("href") == "", "empty").when(F.col("href").rlike(r"[{<$]"), "template").otherwise("no such file")
    unknown = links.join(known, F.col("href") == F.col("sheet"), "left_anti").select("page_id", "href", reason.alias("reason"))
    return every.join(known, "sheet", "left_semi").select("page_id", "sheet", "place"), unknown


def never_loaded(sheets: DataFrame, loaded: DataFrame) -> DataFrame:
    return sheets.select("sheet").join(loaded, "sheet", "left_anti")


def duplicate_ids(tree: DataFrame) -> DataFrame:
    """page_id, id, n."""
    return tree.filter("id IS NOT NULL").groupBy("page_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def fragment_targets(tree: DataFrame) -> DataFrame:
    """page_id, element, id, target: links to a place on their own page, and the element there (null: none)."""
    wanted = tree.select("page_id", "element", F.col("attributes")["href"].alias("href")).filter(F.col("href").startswith("#") & (F.length("href") > 1)).withColumn("id", F.substring("href", 2, 1 << 30))
    there = tree.filter("id IS NOT NULL").groupBy("page_id", "id").agg(F.min("element").alias("target"))
    return wanted.join(there, ["page_id", "id"], "left").select("page_id", "element", "id", "target")


def handlers(tree: DataFrame) -> DataFrame:
    """page_id, element, event, code of on… attributes."""
    return tree.select("page_id", "element", F.explode(F.map_filter("attributes", lambda k, v: k.rlike("^on[a-z]+$"))).alias("k", "code")).select("page_id", "element", F.substring("k", 3, 1 << 30).alias("event"), "code")


def inline_styles(tree: DataFrame) -> DataFrame:
    """page_id, element, property, value of style attributes."""
    each = tree.select("page_id", "element", F.explode(F.split(F.col("attributes")["style"], ";")).alias("d")).filter(F.col("d").contains(":"))
    return each.select("page_id", "element", F.lower(F.trim(F.substring_index("d", ":", 1))).alias("property"), F.trim(F.regexp_replace("d", "^[^:]*:", "")).alias("value"))


def outline(tree: DataFrame) -> DataFrame:
    """page_id, element, level, title, parent: headings in order, each under the last one before it of a smaller level."""
    heads = tree.filter(F.col("tag").rlike("^h[1-6]$")).select("page_id", "element", F.substring("tag", 2, 1).cast("int").alias("level"), F.trim("text").alias("title"))
    # the last heading of each level so far; the latest of those with a smaller level is the parent
    before = Window.partitionBy("page_id").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.array(*[F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.col("element"))).over(before)) for k in range(1, 6)])
    return heads.select("page_id", "element", "level", "title", F.array_max(lasts).alias("parent"))


def controls(tree: DataFrame) -> DataFrame:
    """page_id, control, form, label: controls with the form and the label that they belong to, by id or by standing inside."""
    own = tree.filter(F.col("tag").isin("input", "select", "textarea", "button")).select("page_id", F.col("element").alias("control"), "id", F.col("attributes")["form"].alias("form_id"), "parent")
    up = tree.select("page_id", F.col("element").alias("at"), F.col("parent").alias("above"), "tag")
    seed = own.select("page_id", "control", F.col("parent").alias("at"), F.lit(1).alias("depth"))
    over = fixpoint(seed, lambda fresh: fresh.join(up, ["page_id", "at"]).select("page_id", "control", F.col("above").alias("at"), (F.col("depth") + 1).alias("depth")), ["page_id", "control", "at"]).join(up, ["page_id", "at"])
    near = over.groupBy("page_id", "control").agg(F.min_by(F.when(F.col("tag") == "form", F.col("at")), F.when(F.col("tag") == "form", F.col("depth"))).alias("form_in"), F.min_by(F.when(F.col("tag") == "label", F.col("at")), F.when(F.col("tag") == "label", F.col("depth"))).alias("label_in"))
    forms = tree.filter("tag = 'form' AND id IS NOT NULL").groupBy("page_id", F.col("id").alias("form_id")).agg(F.min("element").alias("form_by"))
    labels = tree.filter("tag = 'label'").groupBy("page_id", F.col("attributes")["for"].alias("id")).agg(F.min("element").alias("label_by")).filter("id IS NOT NULL")
    found = own.join(near, ["page_id", "control"], "left").join(forms, ["page_id", "form_id"], "left").join(labels, ["page_id", "id"], "left")
    return found.select("page_id", "control", F.coalesce("form_by", "form_in").alias("form"), F.coalesce("label_by", "label_in").alias("label"))


def nested(rules: DataFrame) -> DataFrame:
    """rule, selector of nested rules (rule, parent, selector): & stands for the parent's selector, and what has none comes below it.

    A parent's list stands as :is(…), in & and in front; of a list below it, each selector is joined for itself. A rule has one
    parent, so the recursion ends with the deepest rule; rules in a cycle have no selector."""
    up = rules.select(F.col("rule").alias("child"), F.col("parent").alias("rule"), F.col("selector").alias("inner"))
    top_commas = r",(?![^(\[]*[)\]])"
    outer = F.when(F.col("selector").rlike(top_commas), F.concat(F.lit(":is("), F.col("selector"), F.lit(")"))).otherwise(F.col("selector"))
    each = F.transform(F.split("inner", top_commas), lambda s: F.trim(s))
    joined = F.array_join(F.transform(each, lambda s: F.when(s.contains("&"), F.replace(s, F.lit("&"), outer)).otherwise(F.concat(outer, F.lit(" "), s))), ", ")
    return fixpoint(rules.filter("parent IS NULL").select("rule", "selector"), lambda fresh: fresh.join(up, "rule").select(F.col("child").alias("rule"), joined.alias("selector")), ["rule"])
