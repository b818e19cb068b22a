"""The classroom pipeline: attempts to explained recommendations, for all classes in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.operators.attempts import class_rosters, problems_by_skill
from edupulse.operators.decision import decision_support
from edupulse.operators.mastery import BktRule, bkt_mastery
from edupulse.operators.recommend import class_recommendation, problem_topk, skill_priority
from edupulse.operators.summaries import class_state
from edupulse.session import materialize


@dataclass
class ClassroomReport:
    """Tables of the pipeline, each lazily evaluated."""

    classes: DataFrame
    mastery: DataFrame
    priorities: DataFrame
    recommendation: DataFrame
    decision: DataFrame


def classroom_report(
    attempts: DataFrame, student_classes: DataFrame, problems: DataFrame, *, params: BktRule = BktRule(),
    cap: int | None = None, source_dataset: str = "assistments", context: DataFrame | None = None,
) -> ClassroomReport:
    """D1-D3. Eligibility comes from the states: a student with a state has a scoreable attempt.

    States and class mastery feed several tables, so each is computed and written once.
    """
    states = materialize(bkt_mastery(attempts, params=params))
    rosters = class_rosters(states, student_classes)
    classes, mastery = class_state(rosters, states, cap=cap, keep=materialize)
    priorities = skill_priority(mastery)
    recommendation = class_recommendation(priorities, problem_topk(problems_by_skill(problems)))
    decision = decision_support(
        classes, priorities, recommendation, source_dataset=source_dataset, context=context)
    return ClassroomReport(classes, mastery, priorities, recommendation, decision)


def class_skill_priorities(attempts: DataFrame, student_classes: DataFrame, *, cap: int | None = None) -> DataFrame:
    """The flagship query: every class's reliable skills, weakest first."""
    states = materialize(bkt_mastery(attempts))
    _, mastery = class_state(class_rosters(states, student_classes), states, cap=cap)
    return skill_priority(mastery).select(
        "class_id", "priority_rank", "topic_id", F.round("average_mastery", 6).alias("average_mastery"),
        F.round("priority_score", 6).alias("priority_score"), "observation_count")
