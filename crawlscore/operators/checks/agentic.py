"""Checks for assistants that read and act on websites."""

from crawlscore import fixed_values as fv
from crawlscore.functions import robots
from crawlscore.operators.checks.spec import Check, Rule, some

_BLOCKED = "({v}.status_code = 0 OR {v}.status_code >= 400 OR {v}.challenge)"
_AI, _BROWSER = "agents.ai", "agents.browser"
_SEARCH = [n for n, kind in fv.AI_CRAWLERS.items() if kind == "search"]
_TRAINING = [n for n, kind in fv.AI_CRAWLERS.items() if kind == "training"]
_RATIO = "least(1.0D, home.visible_length / render.text_length)"
_LANDMARKS_MISSING = " + ".join(
    f"if(home.dom_has_{n}, 0, 1)" for n in ("main", "nav", "header", "footer")
)


def _blocked_of(names: list[str]) -> str:
    quoted = ", ".join(f"'{n}'" for n in names)
    return f"size(array_intersect(blocked_crawlers, array({quoted})))"


CHECKS = [
    Check(
        "agentic.llms_txt", 5, "Guide for assistants",
        why="llms.txt is a short guide to a site for assistants.",
        fix="Publish /llms.txt with a name, a summary and key links.",
        tables=("site_probe",), requires=("probes",),
        facts={"llms": "trim(BOTH ' \\t\\n\\r\\u000C' FROM coalesce(site_probe.llms_txt_text, ''))"},
        pass_when="llms <> ''",
        rules=(
            Rule("missing", "warn", "llms = ''", message="'There is no llms.txt.'"),
            Rule("no_heading", "info", "llms <> '' AND NOT startswith(llms, '# ')", "low",
                 affected="0", message="'llms.txt does not begin with a name.'"),
        ),
    ),
    Check(
        "agentic.ai_crawlers", 8, "Crawlers of assistants allowed",
        why="Blocked assistants cannot recommend a site.",
        fix="Remove the rules in robots.txt that block them.",
        tables=("robots",),
        facts={
            "blocked_crawlers": "array_compact(array(" + ", ".join(
                "CASE WHEN NOT " + robots.allows("robots.robots_groups", name, "home_url")
                + f" THEN '{name}' END"
                for name in fv.AI_CRAWLERS
            ) + "))",
        },
        rules=(
            Rule("search", "fail",
                 f"coalesce(robots.robots_exists, false) AND {_blocked_of(_SEARCH)} > 0", "high",
                 message="'robots.txt blocks search assistants.'"),
            Rule("training", "info",
                 f"coalesce(robots.robots_exists, false) AND {_blocked_of(_TRAINING)} > 0", "low",
                 message="'robots.txt blocks training crawlers.'"),
        ),
    ),
    Check(
        "agentic.bot_blocking", 8, "Assistants not turned away",
        why="Firewalls often turn assistants away unnoticed.",
        fix="Allow verified crawlers in the firewall.",
        tables=("agents",), requires=("probes",), na=f"{_AI} IS NULL OR {_BROWSER} IS NULL",
        rules=(
            Rule("only_assistants", "fail",
                 f"{_BLOCKED.format(v=_AI)} AND NOT {_BLOCKED.format(v=_BROWSER)}", "high",
                 message="'Assistants are turned away, visitors are not.'"),
            Rule("everyone", "warn",
                 f"{_BLOCKED.format(v=_AI)} AND {_BLOCKED.format(v=_BROWSER)}",
                 message="'Automated visitors are turned away.'"),
            Rule("shorter", "warn",
                 f"NOT {_BLOCKED.format(v=_AI)} AND {_BROWSER}.text_length > 0 AND "
                 f"{_AI}.text_length < {_BROWSER}.text_length * 0.5D",
                 message="'Assistants get a much shorter page.'"),
        ),
    ),
    Check(
        "agentic.structured_data", 5, "Facts for machines",
        why="Structured facts are quoted right.",
        fix="Describe the business in a JSON-LD block.",
        rules=(
            Rule("none", "warn", "size(home.dom_json_types) = 0", "medium", "medium",
                 message="'The homepage has no structured facts.'"),
        ),
    ),
    Check(
        "agentic.landmarks", 4, "Page areas",
        why="Landmarks tell content from menus.",
        fix="Use main, nav, header and footer.",
        facts={"landmarks_missing": _LANDMARKS_MISSING},
        partial="1.0D - landmarks_missing / 4",
        rules=(
            Rule("missing", "warn", "landmarks_missing > 0",
                 "CASE WHEN home.dom_has_main THEN 'low' ELSE 'medium' END",
                 message="concat(landmarks_missing, ' page areas are missing.')"),
        ),
    ),
    Check(
        "agentic.named_controls", 4, "Buttons agents can use",
        why="Agents find buttons by their names.",
        fix="Name icon-only links and buttons.",
        na="home.dom_controls_total = 0",
        partial="1.0D - home.dom_controls_nameless / home.dom_controls_total",
        rules=(
            Rule("nameless", "warn", "home.dom_controls_nameless > 0",
                 message=some("home.dom_controls_nameless", "home.dom_controls_total",
                              "controls have no name.")),
        ),
    ),
    Check(
        "agentic.content_without_js", 8, "Readable without scripts",
        why="Most crawlers do not run scripts.",
        fix="Send the important text in the HTML itself.",
        tables=("render",), requires=("render",),
        na=f"render.text_length < {fv.MIN_RENDERED_TEXT}", partial=_RATIO,
        rules=(
            Rule("partly", "warn", f"{_RATIO} >= 0.3D AND {_RATIO} < 0.7D", "medium", "high",
                 message="'Part of the text needs scripts.'"),
            Rule("hardly", "fail", f"{_RATIO} < 0.3D", "high", "high",
                 message="'Hardly any text shows without scripts.'"),
        ),
    ),
    Check(
        "agentic.answer_ready", 4, "Answers to quote",
        why="Questions with short answers are the easiest to quote.",
        fix="Add an FAQ with the questions customers ask.",
        facts={
            "quotable_found": f"count_if(dom_quotable >= {fv.QUESTIONS_NEEDED})",
        },
        rules=(
            Rule("none", "warn", "quotable_found = 0",
                 message="'No questions with answers were found.'"),
        ),
    ),
    Check(
        "agentic.business_identity", 3, "Identity confirmed",
        why="Assistants look for an about page and profiles elsewhere.",
        fix="Link to an about page and to the business profiles.",
        facts={"identity_missing": "if(home.dom_has_about_link, 0, 1) + "
                                   "if(size(home.dom_profiles) > 0, 0, 1)"},
        rules=(
            Rule("missing", "CASE WHEN identity_missing = 2 THEN 'warn' ELSE 'info' END",
                 "identity_missing > 0",
                 message="'An about page or profiles elsewhere are missing.'"),
        ),
    ),
    Check(
        "agentic.up_to_date", 2, "Up to date",
        why="An old year makes a site look abandoned.",
        fix="Let the year in the footer follow the calendar.",
        na="size(home.dom_copyright_years) = 0",
        facts={"latest_year": "array_max(home.dom_copyright_years)"},
        rules=(
            Rule("old", "warn", "latest_year < as_of_year - 1",
                 message="concat('The site still says ', latest_year, '.')"),
        ),
    ),
]
