"""What a check is: page facts, a site rule, and the findings it can give.

A check is declared, not run: its SQL texts are merged with those of all other checks into
one aggregation per site, so adding a check adds columns, never a scan or a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

LEVELS = ("low", "medium", "high")


def _sql(value: str, plain: tuple[str, ...]) -> str:
    return f"'{value}'" if value in plain else value


@dataclass(frozen=True)
class Rule:
    """One finding a check can give.

    `when`, `affected` and `message` are SQL over the site's facts; `severity`, `impact` and
    `effort` are a level or SQL giving one. `pages` is SQL over page features telling which
    pages the finding is about; `home_only` means it is about the homepage.
    """

    code: str
    severity: str
    when: str
    impact: str = "medium"
    effort: str = "low"
    affected: str = "1"
    message: str = "''"
    pages: str | None = None

    def struct(self, order: int) -> str:
        severity = _sql(self.severity, ("pass", "info", "warn", "fail"))
        return (
            f"CASE WHEN {self.when} THEN named_struct('finding_ord', {order}, "
            f"'code', '{self.code}', 'severity', {severity}, "
            f"'impact', {_sql(self.impact, LEVELS)}, 'effort', {_sql(self.effort, LEVELS)}, "
            f"'affected', CAST({self.affected} AS BIGINT), 'message', {self.message}) END"
        )


@dataclass(frozen=True)
class Check:
    """One check of the catalogue.

    facts     site measures: aggregate SQL (count_if or sum) over page features, or SQL over
              the site's row. `home.x` is a feature of the homepage as crawled, `home.dom_x`
              as the browser showed it; `dom_x` inside an aggregate counts the homepage as
              the browser showed it and all other pages as crawled
    tables    side tables (one row per site) the rules read
    requires  capabilities the site must have, else the check is skipped
    na        SQL that is true when the check does not apply to a site
    partial   SQL of a partial score; null falls back to the worst finding
    """

    check_id: str
    weight: int
    title: str
    why: str
    fix: str
    rules: tuple[Rule, ...]
    facts: dict[str, str] = field(default_factory=dict)
    tables: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    na: str = "false"
    partial: str = "CAST(NULL AS DOUBLE)"
    passed: str = "'Nothing to fix here.'"
    pass_when: str | None = None
    features: dict[str, str] = field(default_factory=dict)
    findings: str | None = None  # SQL of the whole findings array, where rules are data

    @property
    def category(self) -> str:
        return self.check_id.split(".", 1)[0]

    def validate(self) -> None:
        if not 1 <= self.weight <= 10:
            raise ValueError(f"{self.check_id}: the weight must be 1 to 10")
        if not self.title or not self.why or not self.fix:
            raise ValueError(f"{self.check_id}: title, why and fix must be filled in")
        codes = [rule.code for rule in self.rules]
        if len(set(codes)) != len(codes):
            raise ValueError(f"{self.check_id}: finding codes must be unique")

    def findings_sql(self) -> str:
        """Array of finding structs; a passing one when no rule hits."""
        passing = (
            "named_struct('finding_ord', 0, 'code', 'pass', 'severity', 'pass', 'impact', "
            f"'low', 'effort', 'low', 'affected', CAST(0 AS BIGINT), 'message', {self.passed})"
        )
        if self.findings:
            return _or_passing(self.findings, passing)
        rules = [rule.struct(i) for i, rule in enumerate(self.rules, start=1)]
        hits = f"array_compact(array({', '.join(rules)}))"
        if self.pass_when:  # some checks praise and advise at once
            also = f"CASE WHEN {self.pass_when} THEN {passing} END"
            return f"array_compact(concat(array({also}), {hits}))"
        return _or_passing(hits, passing)


def _or_passing(hits: str, passing: str) -> str:
    """SQL of the hits, or the passing entry when there are none; the hits are computed once."""
    return (
        f"get(transform(array({hits}), h -> CASE WHEN size(h) > 0 THEN h "
        f"ELSE array({passing}) END), 0)"
    )


def share(total: str, fails: str, warns: str = "0") -> str:
    """SQL of partial credit: 1 without faults, 0 when everything fails."""
    return (
        f"CASE WHEN {total} = 0 THEN 1.0D ELSE greatest(0.0D, 1.0D - ({fails} + 0.5D * "
        f"({warns})) / {total}) END"
    )


def some(count: str, total: str, what: str) -> str:
    """SQL of a plain sentence: how many of how many have what."""
    return f"concat({count}, ' of ', {total}, ' {what}')"
