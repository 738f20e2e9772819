"""Verdicts over measurements, as Catalyst expressions, and the report of a set of images."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import colour_name, double, round4
from .rules import CODES, RULES, fix_for, rule_for, title_for

VERDICT_TIERS = ("rule_exact", "measured")


def resolution(width: Column, height: Column, kind: Column, rules: dict = RULES) -> Column:
    """Status by format first, then the longer side."""
    r = rules["checks"]["resolution_and_format"]
    longest = F.greatest(width, height)
    return (
        F.when(~F.coalesce(kind, F.lit("")).isin(r["accepted_formats"]), "fail")
        .when((longest > r["max_longest_side"]) | (longest < r["accepted_min_longest_side"]), "fail")
        .when(longest < r["zoom_min_longest_side"], "warn")
        .otherwise("pass")
    )


def ratio_of(width: Column, height: Column) -> Column:
    return F.coalesce(F.try_divide(width.cast("double"), height.cast("double")), double(0))


def aspect(width: Column, height: Column, rules: dict = RULES) -> Column:
    r = rules["checks"]["aspect_ratio"]
    return F.when(F.abs(ratio_of(width, height) - double(r["recommended_ratio"])) > double(r["note_delta"]), "warn").otherwise("pass")


def image_count(n: Column, rules: dict = RULES) -> Column:
    return F.when(n < rules["checks"]["image_count"]["recommended_min"], "warn").otherwise("pass")


def white_background(m: DataFrame | None = None, rules: dict = RULES) -> Column:
    """Status from exact_white_frac, near_white_frac, the modal colour and had_alpha."""
    r = rules["checks"]["white_background"]
    white = (F.col("modal_r") == 255) & (F.col("modal_g") == 255) & (F.col("modal_b") == 255)
    near = F.col("near_white_frac") >= double(r["near_white_pass_frac"])
    passes = (F.col("exact_white_frac") >= double(r["exact_white_pass_frac"])) | (near & white & F.lit(r["modal_white_passes"]))
    return F.when(F.col("exact_white_frac").isNull(), "skipped").when(F.col("had_alpha"), "warn").when(passes, "pass").when(near, "warn").otherwise("fail")


def frame_occupancy(rules: dict = RULES) -> Column:
    least = double(rules["checks"]["frame_occupancy"]["min_bbox_occupancy"])
    return F.when(F.col("bbox_occupancy").isNull(), "skipped").when(F.col("bbox_occupancy") >= least, "pass").otherwise("fail")


def background_artifacts() -> Column:
    return F.when(F.col("n_artifacts") > 0, "fail").otherwise("pass")


def tier_of(check: Column, tier: Column, is_main: Column, rules: dict = RULES) -> Column:
    """Advisory for rules of the main image on an image that isn't known to be it."""
    return F.when(check.isin(rules["main_image_only"]) & ~F.coalesce(is_main, F.lit(False)), "advisory").otherwise(tier)


def main_flag(index: Column, main_index: Column) -> Column:
    """Null if no main image was named."""
    return index == main_index


def checks(images: DataFrame, rules: dict = RULES) -> DataFrame:
    """A row for each image and check, in the fixed order of checks.

    ``images``: set_id, idx, width, height, format, had_alpha, is_main (null: unknown) and the columns that
    ``pixels.measured`` gives. Returns set_id, idx, place, check_id, status, tier, value, reason and rule (what the value is held against).
    """
    tier = {n: c["tier"] for n, c in rules["checks"].items()}
    percent = lambda c: F.concat(F.round(c * 100, 1).cast("string"), F.lit("%"))
    colour = colour_name(F.col("modal_r"), F.col("modal_g"), F.col("modal_b"))
    told = [
        ("resolution_and_format", resolution(F.col("width"), F.col("height"), F.col("format"), rules), F.greatest("width", "height").cast("double"), F.concat(F.greatest("width", "height").cast("string"), F.lit(" pixels on the longer side, saved as "), F.coalesce("format", F.lit("?")))),
        ("white_background", white_background(rules=rules), round4(F.col("exact_white_frac")), F.when(F.col("exact_white_frac").isNull(), "no background to measure").otherwise(F.concat(F.lit("mostly "), colour, F.lit("; pure white on "), percent(F.col("exact_white_frac"))))),
        ("frame_occupancy", frame_occupancy(rules), round4(F.col("bbox_occupancy")), F.when(F.col("bbox_occupancy").isNull(), "no product found").otherwise(F.concat(F.lit("its box fills "), percent(F.col("bbox_occupancy"))))),
        ("background_artifacts", background_artifacts(), F.col("n_artifacts").cast("double"), F.concat(F.col("n_artifacts").cast("string"), F.lit(" other parts on the background"))),
        ("aspect_ratio", aspect(F.col("width"), F.col("height"), rules), round4(ratio_of(F.col("width"), F.col("height"))), F.concat(F.round(ratio_of(F.col("width"), F.col("height")), 2).cast("string"), F.lit(":1"))),
    ]
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("place"),
                F.lit(name).alias("check_id"),
                status.alias("status"),
                tier_of(F.lit(name), F.lit(tier[name]), F.col("is_main"), rules).alias("tier"),
                value.cast("double").alias("value"),
                F.when(status != "pass", reason).otherwise("").alias("reason"),
                F.lit(rule_for(name, rules)).alias("rule"),
            )
            for i, (name, status, value, reason) in enumerate(told)
        )
    )
    out = images.select("set_id", "idx", "is_main", F.explode(rows).alias("c")).select("set_id", "idx", "is_main", "c.*")
    measured_only = (F.col("tier") == "advisory") & F.col("check_id").isin(rules["main_image_only"])
    note = F.when(F.col("is_main").isNull(), "which image is the main one wasn't said").otherwise("a rule of the main image")
    return out.withColumn("reason", F.when(measured_only, F.concat_ws("; ", F.nullif(F.col("reason"), F.lit("")), note)).otherwise(F.col("reason"))).drop("is_main")


def worst(status: Column, tier: Column) -> Column:
    """Aggregate: the worst of the decided verdicts; skipped if there is none."""
    rank = F.when(tier.isin(*VERDICT_TIERS), F.when(status == "pass", 0).when(status == "warn", 1).when(status == "fail", 2))
    return F.coalesce(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.max(rank) + 1), F.lit("skipped"))


def finding_groups(checked: DataFrame) -> DataFrame:
    """Images of a set with the same findings: set_id, indices, n_pass, findings, n_measured_only.

    Findings are (code, status, value) of verdicts that aren't passed; advisory ones are counted.
    """
    code = F.element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), F.col("check_id"))
    verdict, passed = F.col("tier").isin(*VERDICT_TIERS), F.col("status") == "pass"
    finding = F.struct("place", code.alias("code"), "status", round4(F.col("value")).alias("value"))
    per_image = checked.groupBy("set_id", "idx").agg(
        F.array_sort(F.collect_list(F.when(verdict & ~passed, finding))).alias("findings"),
        F.array_sort(F.collect_list(F.when(~verdict & ~passed, finding))).alias("advisory"),
        F.count_if(passed).alias("n_pass"),
    )
    out = per_image.groupBy("set_id", "findings", "advisory", "n_pass").agg(F.array_sort(F.collect_list("idx")).alias("indices"))
    short = F.transform("findings", lambda f: F.struct(f["code"].alias("code"), f["status"].alias("status"), f["value"].alias("value")))
    return out.select("set_id", "indices", "n_pass", short.alias("findings"), F.size("advisory").alias("n_measured_only"))


def headlines(checked: DataFrame, supplied: DataFrame, rules: dict = RULES) -> DataFrame:
    """set_id, n_images, headline, main_index of each set; ``supplied``: set_id, n_images."""
    of_set = supplied.select("set_id", image_count(F.col("n_images"), rules).alias("status"), F.lit("rule_exact").alias("tier"))
    every = checked.select("set_id", "status", "tier").unionByName(of_set)
    main = checked.where(F.col("check_id").isin(rules["main_image_only"]) & F.col("tier").isin(*VERDICT_TIERS)).groupBy("set_id").agg(F.min("idx").alias("main_index"))
    return supplied.join(every.groupBy("set_id").agg(worst(F.col("status"), F.col("tier")).alias("headline")), "set_id").join(main, "set_id", "left")


#: What the parts of a report mean to who reads it.
KEY = {
    "f": "broken rules, as f_schema says; the only verdicts",
    "n_measured_only": "how many measurements are NOT rule verdicts; their values are left out and nothing follows from them",
    "fix": "how to take the photo again so that the rule is met",
}


def _triples(findings: Column) -> Column:
    """JSON of a list of (code, status, value) as lists of three."""
    one = lambda f: F.concat(F.lit('["'), f["code"], F.lit('","'), f["status"], F.lit('",'), F.coalesce(f["value"].cast("string"), F.lit("null")), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(findings, one), ","), F.lit("]"))


def payloads(checked: DataFrame, supplied: DataFrame, rules: dict = RULES, clusters: DataFrame | None = None, mismatches: DataFrame | None = None) -> DataFrame:
    """(set_id, headline, payload): a compact JSON report of each set, told by its set_id.

    The legend names the checks that were not passed and their rules; advice is given for verdicts that failed and for a
    low count. ``clusters`` (set_id, cluster, idx) raise a passing headline to a warning. ``mismatches``: set_id, idx,
    own, nearest.
    """
    heads = headlines(checked, supplied, rules).withColumn("count_status", image_count(F.col("n_images"), rules))
    named = lambda tell: F.try_element_at(F.create_map(*(F.lit(x) for n in CODES for x in (n, tell(n)))), F.col("check_id"))
    each = finding_groups(checked)
    measured_only = F.when(F.col("n_measured_only") > 0, F.concat(F.lit(',"n_measured_only":'), F.col("n_measured_only").cast("string"))).otherwise("")
    spelt = F.concat(F.lit('{"i":'), F.to_json("indices"), F.lit(',"n_pass":'), F.col("n_pass").cast("string"), F.lit(',"f":'), _triples(F.col("findings")), measured_only, F.lit("}"))
    groups = each.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("indices", spelt.alias("json")))).alias("groups"))
    counted = supplied.select("set_id", F.lit("image_count").alias("check_id"), image_count(F.col("n_images"), rules).alias("status"), F.lit("rule_exact").alias("tier"))
    met = checked.select("set_id", "check_id", "status", "tier").unionByName(counted).where("status <> 'pass'")
    legend = met.groupBy("set_id", "check_id").agg(F.max(F.col("tier").isin(*VERDICT_TIERS)).alias("broken"))
    fix = F.when(F.col("broken"), named(lambda n: fix_for(n, rules)))
    entry = F.struct(named(CODES.get).alias("code"), F.struct(F.col("check_id").alias("check"), named(title_for).alias("title"), named(lambda n: rule_for(n, rules)).alias("rule"), fix.alias("fix")).alias("entry"))
    legend = legend.groupBy("set_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).withColumn("fixes", F.exists("entries", lambda e: e["entry"]["fix"].isNotNull()))
    out = heads.join(groups, "set_id", "left").join(legend, "set_id", "left")
    headline = F.col("headline")
    extra = []
    if clusters is not None:
        of = clusters.groupBy("set_id", "cluster").agg(F.array_sort(F.collect_list("idx")).alias("members")).where("size(members) > 1")
        out = out.join(of.groupBy("set_id").agg(F.array_sort(F.collect_list("members")).alias("clusters")), "set_id", "left")
        headline = F.when(F.col("clusters").isNotNull() & (headline == "pass"), "warn").otherwise(headline)
        extra.append("clusters")
    if mismatches is not None:
        out = out.join(mismatches.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("idx", "own", "nearest"))).alias("group_mismatches")), "set_id", "left")
        extra.append("group_mismatches")
    caveat = F.when(F.col("main_index").isNull(), "The main image was not named, so its three rules were measured and not judged.")
    key = F.struct(*(F.lit(KEY[k]).alias(k) for k in ("f", "n_measured_only")), F.when(F.col("fixes"), KEY["fix"]).alias("fix"))
    fields = F.array(*map(F.lit, ("check_code", "status", "measured_value")))
    head = F.struct(F.lit(rules["rules_version"]).alias("rules_version"), F.col("set_id").cast("string").alias("audit_id"), "n_images", headline.alias("headline"), "main_index", caveat.alias("caveat"), fields.alias("f_schema"), key.alias("key"), F.map_from_entries(F.coalesce("entries", F.array())).alias("legend"), *extra)
    low = F.struct(F.lit(CODES["image_count"]).alias("code"), F.col("count_status").alias("status"), F.col("n_images").alias("value"))
    of_set = F.when(F.col("count_status") == "pass", "[]").otherwise(_triples(F.array(low)))
    told = F.array_join(F.transform("groups", lambda g: g["json"]), ",")
    body = F.to_json(head)
    whole = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"set_checks":'), of_set, F.lit(',"groups":['), F.coalesce(told, F.lit("")), F.lit("]}"))
    return out.select("set_id", headline.alias("headline"), whole.alias("payload"))


def latest(audits: DataFrame, n: int = 64) -> DataFrame:
    """The ``n`` latest of ``audits`` (audit_id, at)."""
    return audits.orderBy(F.col("at").desc(), "audit_id").limit(n)


def longest_payload(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(F.length("payload")).alias("characters"))


def as_dict(payload: str) -> dict:
    return json.loads(payload)
