"""The closed vocabularies of the facets and the order in which they decide a headline projection."""

from __future__ import annotations

#: Rules in order; the first whose labels are met on any of its axes names the projection. "!" before an axis: a label outside the given ones.
HEADLINE_RULES: tuple[tuple[str, dict[str, tuple[str, ...]]], ...] = (
    ("Long Context Projection", {"context_pressure": ("long_context_primary",)}),
    (
        "Agentic / Environment Interaction",
        {
            "construct_claim": ("agentic_task_completion", "computer_use", "tool_use", "web_navigation"),
            "task_mechanism": ("browser_navigation", "repository_issue_resolution", "terminal_operation", "tool_calling"),
            "interaction_pattern": (
                "browser_or_web_interaction", "computer_control", "environment_interaction", "human_in_the_loop", "multi_step_planning", "single_turn_tool_use", "terminal_or_codebase_interaction",
            ),
        },
    ),
    (
        "Multimodal / Perceptual Understanding",
        {
            "construct_claim": ("document_understanding", "multimodal_understanding"),
            "task_mechanism": ("document_parsing", "video_question_answering", "visual_question_answering"),
            "!modality": ("code", "text", "tool_api"),
        },
    ),
    ("Constraint / Safety / Control", {"construct_claim": ("instruction_following", "safety_or_refusal"), "task_mechanism": ("adversarial_refusal", "format_constrained_output")}),
    (
        "Generative or Deliberative Reasoning",
        {
            "construct_claim": ("coding", "domain_expertise", "mathematical_reasoning", "reasoning", "scientific_reasoning", "software_engineering"),
            "task_mechanism": ("code_generation", "code_repair", "free_form_generation", "long_context_synthesis", "math_problem_solving", "unit_test_passing"),
        },
    ),
    (
        "Knowledge / Retrieval",
        {
            "construct_claim": ("factual_knowledge", "long_context_retrieval", "preference_or_human_judgment"),
            "task_mechanism": ("human_preference_comparison", "long_context_retrieval", "multiple_choice_qa", "short_answer_qa"),
            "context_pressure": ("long_context_supporting",),
        },
    ),
)
#: Axes that stand for construct_claim.
CONSTRUCT_AXES = ("construct_claim", "benchmark_construct_claim", "provider_construct_claim")
HEADLINE_AXIS = "headline_task_mode"
#: Least confidence of a label that counts as sure, and the confidence of a projection with no rated label.
CONFIDENCE = 0.7
#: Labels of interaction_pattern that count as acting on something.
INTERACTION_LABELS = ("browser_or_web_interaction", "computer_control", "environment_interaction", "single_turn_tool_use", "terminal_or_codebase_interaction")
#: Relationships of an extracted name to a catalogue entry that need no review when an alias confirms them.
SAFE_RELATIONSHIPS = ("abbreviation", "exact")
#: Least confidence of an extracted name that is taken without review, also where none is given.
ACCEPT_CONFIDENCE = 0.75
