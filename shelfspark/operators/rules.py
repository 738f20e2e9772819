"""The rules that checks apply, as data: thresholds, names, and advice."""

from __future__ import annotations

import json
from pathlib import Path

#: Thresholds and lists of the rule set: fixed values.
RULES = {
    "rules_version": "v1",
    "decode": {"max_pixels": 50_000_000, "work_longest_side": 1024, "max_bytes": 8_388_608},
    "checks": {
        "resolution_and_format": {
            "tier": "rule_exact",
            "zoom_min_longest_side": 1000,
            "accepted_min_longest_side": 500,
            "max_longest_side": 10_000,
            "accepted_formats": ["JPEG", "PNG", "TIFF", "GIF", "WEBP"],
        },
        "aspect_ratio": {"tier": "advisory", "recommended_ratio": 1.0, "note_delta": 0.25},
        "image_count": {"tier": "rule_exact", "recommended_min": 6},
        "white_background": {
            "tier": "measured",
            "border_band_frac": 0.02,
            "border_band_min_px": 2,
            "exact_white_pass_frac": 0.99,
            "near_white_min_channel": 240,
            "near_white_max_spread": 8,
            "near_white_pass_frac": 0.99,
            "modal_white_passes": True,
            "max_band_product_frac": 0.9,
            "ring_bbox_coverage_frac": 0.95,
            "ring_max_area_frac": 0.15,
        },
        "frame_occupancy": {
            "tier": "measured",
            "min_bbox_occupancy": 0.85,
            "component_min_area_frac": 0.0005,
            "gradient_fallback_max_mask_frac": 0.02,
            "gradient_threshold": 12,
            "background_match_tolerance": 24,
            "background_min_band_frac": 0.5,
        },
        "background_artifacts": {"tier": "measured", "min_component_area_frac": 0.0005, "central_region_frac": 0.5, "corner_region_frac": 0.25},
        "off_product_text": {"tier": "model", "enabled": False},
        "image_role": {"tier": "model", "enabled": False},
        "prohibited_content": {"tier": "model", "enabled": False},
    },
    "main_image_only": ["white_background", "frame_occupancy", "background_artifacts"],
}
#: Short codes and plain names of the checks: fixed values.
CODES = {"resolution_and_format": "res", "white_background": "wbg", "frame_occupancy": "occ", "background_artifacts": "art", "aspect_ratio": "asp", "image_count": "cnt"}
TITLES = {
    "resolution_and_format": "Photo size",
    "white_background": "White background",
    "frame_occupancy": "Product size in the photo",
    "background_artifacts": "Anything else on the background",
    "aspect_ratio": "Photo shape",
    "image_count": "Number of photos",
}


def load_rules(path: str | None = None) -> dict:
    """The rules, or those of a JSON file of the same form."""
    return json.loads(Path(path).read_text()) if path else RULES


def enabled_checks(rules: dict = RULES) -> list[str]:
    """Checks that run: enabled unless said otherwise, and not deferred."""
    return sorted(n for n, c in rules["checks"].items() if c.get("enabled", True) and c.get("tier") != "deferred")


def title_for(check: str) -> str:
    return TITLES.get(check, check)


def fix_for(check: str, rules: dict = RULES) -> str | None:
    """What to do about a failed check, with the rule's numbers; None for a check that is no verdict."""
    least = rules["checks"]["resolution_and_format"]["zoom_min_longest_side"]
    return {
        "resolution_and_format": f"Upload the camera's own file, at least {least:,} pixels on its longer side, rather than a screenshot or a copy from a chat.",
        "white_background": "Photograph against a white sheet, lit from two sides, and set what remains of the background to pure white.",
        "frame_occupancy": "Go closer, or crop, until the product nearly reaches the edges of the photo.",
        "background_artifacts": "Take away all but the product for sale: props, other items, badges, text, frames and watermarks.",
        "image_count": "Add photos from other angles, of details, in use, for scale, and of what is in the box.",
    }.get(check)


def rule_for(check: str, rules: dict = RULES) -> str:
    """What a check's value is held against, in words."""
    c = rules["checks"]
    size, white, frame = c["resolution_and_format"], c["white_background"], c["frame_occupancy"]
    return {
        "resolution_and_format": f"longest side from {size['accepted_min_longest_side']} to {size['max_longest_side']} pixels, {size['zoom_min_longest_side']} for zoom, as {', '.join(size['accepted_formats'])}",
        "white_background": f"pure white on {white['exact_white_pass_frac']:.0%} of the border",
        "frame_occupancy": f"the product's box fills {frame['min_bbox_occupancy']:.0%} of the frame",
        "background_artifacts": "nothing but the product",
        "aspect_ratio": f"width to height near {c['aspect_ratio']['recommended_ratio']:g}",
        "image_count": f"{c['image_count']['recommended_min']} photos or more",
    }.get(check, "")
