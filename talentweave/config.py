"""Fixed defaults and checked parameters of the matching rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import ClassVar

# Query kinds, in the order in which they are built.
TITLE, WORK, PROJECT, SKILLS = "target_job_title", "work_experience", "project_experience", "skills"
QUERY_TYPES = (TITLE, WORK, PROJECT, SKILLS)

# Title endings that mark a complete position name around a slash.
TITLE_SUFFIXES = (
    "经理", "工程师", "主管", "专员", "顾问", "助理", "组长", "管理员", "管理", "代表", "会计", "出纳", "监理", "文秘",
)

# JD passage sections in order of preference per query kind.
SECTION_PRIORITY = {
    WORK: ("qualification", "responsibility", "competency"),
    PROJECT: ("responsibility", "competency", "qualification"),
    SKILLS: ("competency", "responsibility", "qualification"),
}

# Weights of the five report dimensions.
DIMENSION_WEIGHTS = {"education": 10, "major": 10, "experience": 30, "skills": 25, "responsibilities": 25}

# Columns that identify one requested position of one résumé.
TARGET_KEYS = ["resume_id", "target_id"]


@dataclass(frozen=True)
class Span:
    """Where a number may lie; ``open_low`` leaves out the lower end. ``optional`` admits None."""

    low: float = -math.inf
    high: float = math.inf
    open_low: bool = False
    optional: bool = False

    def admits(self, value: float | None) -> bool:
        if value is None:
            return self.optional
        return math.isfinite(value) and self.low <= value <= self.high and not (self.open_low and value == self.low)

    def __str__(self) -> str:
        return f"{'(' if self.open_low else '['}{self.low}, {self.high}]{' or None' if self.optional else ''}"


SHARE, SHARE_ABOVE_0 = Span(0, 1), Span(0, 1, open_low=True)
ABOVE_0, NOT_NEGATIVE = Span(0, open_low=True), Span(0)


class Checked:
    """Parameters with a span each; the values of a dictionary share one."""

    SPANS: ClassVar[dict[str, Span]] = {}

    def __post_init__(self) -> None:
        for name, span in self.SPANS.items():
            held = getattr(self, name)
            for where, value in held.items() if isinstance(held, dict) else [(None, held)]:
                if not span.admits(value):
                    raise ValueError(f"{name}{'' if where is None else f'[{where}]'} must lie in {span}, got {value}")
        for broken, message in self.relations():
            if broken:
                raise ValueError(message)

    def relations(self) -> list[tuple[bool, str]]:
        """Conditions between parameters that must not hold, with what to say if one does."""
        return []


@dataclass(frozen=True)
class QueryConfig(Checked):
    max_chars: int = 1500
    min_chars: int = 2

    SPANS: ClassVar = {"max_chars": ABOVE_0, "min_chars": ABOVE_0}

    def relations(self):
        return [(self.min_chars > self.max_chars, "min_chars must not exceed max_chars")]


@dataclass(frozen=True)
class RecallConfig(Checked):
    best_weight: float = 0.75
    type_weights: dict = field(default_factory=lambda: {TITLE: 0.40, WORK: 0.30, PROJECT: 0.18, SKILLS: 0.12})
    active_penalties: dict = field(default_factory=lambda: {1: 0.30, 2: 0.70, 3: 0.90, 4: 1.00})
    minimum_similarity: float | None = None
    top_k: int = 30
    top_n: int = 10
    evidence_limit: int | None = 10

    SPANS: ClassVar = {
        "best_weight": SHARE, "type_weights": ABOVE_0, "active_penalties": SHARE_ABOVE_0, "minimum_similarity": Span(optional=True),
        "top_k": ABOVE_0, "top_n": ABOVE_0, "evidence_limit": Span(0, open_low=True, optional=True),
    }

    def relations(self):
        return [
            (not self.type_weights, "type_weights must name a query kind"),
            (any(n < 1 for n in self.active_penalties), "active_penalties are keyed by numbers of kinds from 1 on"),
        ]


@dataclass(frozen=True)
class PassageConfig(Checked):
    max_chars: int = 1200

    SPANS: ClassVar = {"max_chars": ABOVE_0}


@dataclass(frozen=True)
class RerankConfig(Checked):
    max_passages: int = 12
    max_evidence: int = 10
    top_n: int = 5
    type_weights: dict = field(default_factory=lambda: {WORK: 0.50, PROJECT: 0.30, SKILLS: 0.20})
    title_weight: float = 0.60
    support_weight: float = 0.30
    recall_weight: float = 0.10
    minimum_title_similarity: float | None = None
    require_manual_confirmation: bool = True
    auto_confirm_threshold: float = 0.85
    minimum_top_margin: float = 0.08

    SPANS: ClassVar = {
        **dict.fromkeys(("max_passages", "max_evidence", "top_n", "type_weights"), ABOVE_0),
        **dict.fromkeys(("title_weight", "support_weight", "recall_weight", "auto_confirm_threshold", "minimum_top_margin"), SHARE),
        "minimum_title_similarity": Span(0, 1, optional=True),
    }

    def relations(self):
        shares = self.title_weight + self.support_weight + self.recall_weight
        kinds = set(self.type_weights)
        return [
            (abs(shares - 1) > 1e-9, "the weights of title, support and recall must add up to 1"),
            (kinds != set(SECTION_PRIORITY), f"type_weights must name exactly {sorted(SECTION_PRIORITY)}"),
        ]


@dataclass(frozen=True)
class RetryConfig(Checked):
    max_retries: int = 2
    base_delay: float = 1.0
    max_delay: float = 30.0

    SPANS: ClassVar = dict.fromkeys(("max_retries", "base_delay", "max_delay"), NOT_NEGATIVE)

    def relations(self):
        return [(self.base_delay > self.max_delay, "base_delay must not exceed max_delay")]
