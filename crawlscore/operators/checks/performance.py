"""Performance checks."""

from crawlscore import fixed_values as fv
from crawlscore.operators.checks.spec import Check, Rule, share, some

_MOBILE, _DESKTOP = "speed.mobile", "speed.desktop"
_ANY = "coalesce(speed.mobile, speed.desktop)"
_FIELD = f"{_ANY}.field"
_MB = 1024 * 1024


def _speed(check_id: str, weight: int, title: str, test: str) -> Check:
    return Check(
        check_id, weight, title,
        why="Slow pages lose visitors before they see anything.",
        fix="Shrink pictures, drop unused scripts, cache and compress.",
        tables=("speed",), requires=("pagespeed",), na=f"{test} IS NULL",
        partial=f"{test}.score",
        rules=(
            Rule("slow", "fail", f"{test}.score < 0.5D", "high", "medium",
                 message=f"concat('Speed is rated ', CAST(round({test}.score * 100) AS INT), "
                         "' of 100.')"),
            Rule("middling", "warn", f"{test}.score >= 0.5D AND {test}.score < 0.9D", "medium",
                 "medium",
                 message=f"concat('Speed is rated ', CAST(round({test}.score * 100) AS INT), "
                         "' of 100.')"),
        ),
    )


def _vital_value(name: str) -> str:
    """The value of one vital from real visitors when known, else from the lab test."""
    lab = "CAST(NULL AS DOUBLE)" if name == "inp_ms" else f"{_ANY}.{name}"
    visitors = "CAST(NULL AS DOUBLE)" if name == "tbt_ms" else f"{_FIELD}.{name}"
    return f"CASE WHEN {_FIELD}.lcp_ms IS NOT NULL THEN {visitors} ELSE {lab} END"


def _rating(name: str) -> str:
    good, poor = fv.VITALS[name]
    return (
        f"CASE WHEN vital_{name} <= {good}D THEN 1.0D WHEN vital_{name} <= {poor}D THEN 0.5D "
        f"WHEN vital_{name} IS NOT NULL THEN 0.0D END"
    )


_ORDER = ["lcp_ms", "cls", "inp_ms", "tbt_ms", "fcp_ms"]
_RATINGS = "array_compact(array(" + ", ".join(f"rating_{n}" for n in _ORDER) + "))"

CHECKS = [
    _speed("performance.mobile_speed", 10, "Speed on phones", _MOBILE),
    _speed("performance.desktop_speed", 5, "Speed on computers", _DESKTOP),
    Check(
        "performance.core_web_vitals", 8, "Core Web Vitals",
        why="The vitals measure what loading feels like.",
        fix="Speed up the largest picture, reserve space, split long scripts.",
        tables=("speed",), requires=("pagespeed",), na=f"size({_RATINGS}) = 0",
        facts={
            **{f"vital_{n}": _vital_value(n) for n in _ORDER},
            **{f"rating_{n}": _rating(n) for n in _ORDER},
        },
        partial=f"aggregate({_RATINGS}, 0.0D, (s, r) -> s + r) / size({_RATINGS})",
        rules=tuple(
            Rule(name, f"CASE WHEN rating_{name} = 0 THEN 'fail' ELSE 'warn' END",
                 f"rating_{name} < 1", f"CASE WHEN rating_{name} = 0 THEN 'high' ELSE 'medium' END",
                 "medium", message=f"concat('{name} is ', vital_{name}, '.')")
            for name in _ORDER
        ),
    ),
    Check(
        "performance.page_weight", 4, "Page weight",
        why="Heavy pages use up data plans.",
        fix="Send pictures in the shown size and a modern format.",
        tables=("speed",), requires=("pagespeed",), na=f"{_ANY}.total_bytes IS NULL",
        rules=(
            Rule("heavy", "fail", f"{_ANY}.total_bytes > {4 * _MB}", "medium", "medium",
                 message="'The homepage is heavier than 4 MB.'"),
            Rule("weighty", "warn",
                 f"{_ANY}.total_bytes > {2 * _MB} AND {_ANY}.total_bytes <= {4 * _MB}", "medium",
                 "medium", message="'The homepage is heavier than 2 MB.'"),
        ),
    ),
    Check(
        "performance.image_dimensions", 3, "Image sizes declared",
        why="Pictures without a size make the page jump.",
        fix="Write width and height into each picture tag.",
        features={"unsized_images": "size(filter(real_images, i -> NOT i.sized))"},
        facts={
            "sized_total": "sum(size(dom_real_images))",
            "sized_bad": "sum(dom_unsized_images)",
            "sized_bad_pages": "count_if(dom_unsized_images > 0)",
        },
        na="sized_total = 0", partial=share("sized_total", "0", "sized_bad"),
        rules=(
            Rule("unsized", "warn", "sized_bad > 0", affected="sized_bad_pages",
                 pages="dom_unsized_images > 0",
                 message=some("sized_bad", "sized_total", "pictures declare no size.")),
        ),
    ),
    Check(
        "performance.lazy_images", 3, "Images load when needed",
        why="Pictures below the first screen slow it down.",
        fix="Load pictures below the first screen lazily.",
        tables=("speed",),
        features={
            "image_heavy": f"size(real_images) >= {fv.MIN_IMAGES_FOR_LAZY}",
            "never_lazy": "image_heavy AND NOT exists(images, i -> i.lazy)",
        },
        facts={
            "heavy_pages": "count_if(dom_image_heavy)",
            "eager_pages": "count_if(dom_never_lazy)",
        },
        na=f"{_MOBILE} IS NULL AND heavy_pages = 0",
        rules=(
            Rule("offscreen", "warn",
                 f"{_MOBILE} IS NOT NULL AND size({_MOBILE}.offscreen_images) > 0",
                 message=f"concat(size({_MOBILE}.offscreen_images), "
                         "' pictures load before they are seen.')"),
            Rule("eager", "warn", f"{_MOBILE} IS NULL AND eager_pages > 0", "low",
                 affected="eager_pages", pages="dom_never_lazy",
                 message=some("eager_pages", "pages", "pages load all pictures at once.")),
        ),
    ),
    Check(
        "performance.render_blocking", 4, "Blocking files",
        why="Files that block rendering keep the page blank.",
        fix="Defer scripts in the head and inline the first styles.",
        tables=("speed",),
        rules=(
            Rule("measured", "warn",
                 f"{_MOBILE} IS NOT NULL AND size({_MOBILE}.render_blocking) > 0",
                 f"CASE WHEN {_MOBILE}.render_blocking_savings_ms >= 500 THEN 'medium' ELSE 'low' "
                 "END", "medium",
                 message=f"concat(size({_MOBILE}.render_blocking), ' files delay the page.')"),
            Rule("scripts", "warn", f"{_MOBILE} IS NULL AND home.blocking_scripts > 0", "low",
                 message="concat(home.blocking_scripts, ' scripts in the head block the page.')"),
        ),
    ),
]
