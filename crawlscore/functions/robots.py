"""robots.txt rules and decisions, local to the row that holds the file.

A file becomes an array of groups (agents, rules) in one pass of a fold over its lines; the
decision for an agent and one address of the site, such as its homepage, is a search in that array. Many
addresses are judged by `operators.robots_access`.
"""

from __future__ import annotations

_RULE = "struct<allow:boolean,path:string>"
_GROUP = f"struct<agents:array<string>,rules:array<{_RULE}>>"
_STATE = (
    f"struct<step:int,agents:array<string>,rules:array<{_RULE}>,groups:array<{_GROUP}>>"
)


def _decoded(text: str) -> str:
    """Percent signs resolved, plus signs kept."""
    return f"coalesce(try_url_decode(replace({text}, '+', '%2B')), {text})"


def _state(step: str, agents: str, rules: str, groups: str) -> str:
    return (
        f"named_struct('step', {step}, 'agents', {agents}, 'rules', {rules}, 'groups', {groups})"
    )


def groups_sql(text: str) -> str:
    """The rule groups of a file in order; a group without agents or rules is dropped."""
    no_agents, no_rules = "CAST(array() AS ARRAY<STRING>)", f"CAST(array() AS ARRAY<{_RULE}>)"
    closed = (
        "concat(s.groups, array(named_struct('agents', s.agents, 'rules', s.rules)))"
    )
    kept = f"CASE WHEN s.step = 2 THEN {closed} ELSE s.groups END"
    key = "lower(trim(substring_index(l, ':', 1)))"
    value = f"{_decoded('trim(substring(l, instr(l, chr(58)) + 1))')}"
    lines = (
        f"transform(split({text}, '\\r\\n|\\r|\\n'), "
        "r -> named_struct('blank', r = '', 'body', trim(BOTH ' \\t' FROM "
        "regexp_replace(r, '#.*$', ''))))"
    )
    # a file line is first cut at '#', then split at its first colon
    agent = _state(
        "1",
        f"CASE WHEN s.step = 2 THEN array({value}) ELSE concat(s.agents, array({value})) END",
        f"CASE WHEN s.step = 2 THEN {no_rules} ELSE s.rules END", kept,
    )

    def rule(allow: str) -> str:
        return _state(
            "2", "s.agents",
            f"concat(s.rules, array(named_struct('allow', {allow}, 'path', {value})))", "s.groups",
        )

    blank = (
        f"CASE WHEN s.step = 0 THEN s ELSE {_state('0', no_agents, no_rules, kept)} END"
    )
    step = (
        f"CASE WHEN b THEN {blank} "
        "WHEN instr(l, ':') = 0 THEN s "
        f"WHEN {key} = 'user-agent' THEN {agent} "
        f"WHEN {key} = 'disallow' AND s.step > 0 THEN {rule(f'{value} = {chr(39)}{chr(39)}')} "
        f"WHEN {key} = 'allow' AND s.step > 0 THEN {rule('true')} "
        f"WHEN {key} IN ('crawl-delay', 'request-rate') AND s.step > 0 THEN "
        f"{_state('2', 's.agents', 's.rules', 's.groups')} ELSE s END"
    )
    step = step.replace("WHEN b THEN", "WHEN x.blank THEN").replace("(l,", "(x.body,")
    start = f"CAST({_state('0', no_agents, no_rules, f'CAST(array() AS ARRAY<{_GROUP}>)')} AS {_STATE})"
    end = f"CASE WHEN s.step = 2 THEN {closed} ELSE s.groups END"
    return f"aggregate({lines}, {start}, (s, x) -> CAST({step} AS {_STATE}), s -> {end})"


def sitemaps_sql(text: str) -> str:
    """Addresses of the Sitemap lines, in order."""
    return (
        f"transform(filter(split({text}, '\\r\\n|\\r|\\n'), "
        "r -> startswith(lower(r), 'sitemap:')), r -> trim(substring(r, 9)))"
    )


def file_exists_sql(status: str, content_type: str, text: str) -> str:
    """A real text file: answered, not HTML, and not an error page in disguise."""
    kind = f"trim(lower(substring_index(coalesce({content_type}, ''), ';', 1)))"
    return (
        f"({status} BETWEEN 200 AND 299 AND {kind} NOT IN ('text/html', 'application/xhtml+xml') "
        f"AND NOT startswith(ltrim(regexp_replace(coalesce({text}, ''), '^\\\\s+', '')), '<'))"
    )


def target(url: str) -> str:
    """SQL of what rules are compared with: path and query of an address."""
    return _decoded(
        f"coalesce(nullif(regexp_extract({url}, r\"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)\", 1), ''), '/')"
    )


def group_of(groups: str, agent: str) -> str:
    """SQL of the group that binds `agent` (a plain name): the first that names it, else the first for all."""
    name = agent.lower().split("/")[0]
    named = (
        f"filter({groups}, g -> NOT array_contains(g.agents, '*') AND "
        f"exists(g.agents, a -> contains('{name}', lower(a))))"
    )
    fallback = f"filter({groups}, g -> array_contains(g.agents, '*'))"
    return f"coalesce(get({named}, 0), get({fallback}, 0))"


def allows(groups: str, agent: str, url: str) -> str:
    """SQL: may `agent` visit `url`? The first fitting rule of its group decides."""
    rule = f"filter({group_of(groups, agent)}.rules, r -> r.path = '*' OR startswith({target(url)}, r.path))"
    return f"coalesce(get({rule}, 0).allow, true)"

