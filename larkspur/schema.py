"""Explicit schemas (D1-D16 of the survey); nothing is inferred."""

from __future__ import annotations

MESSAGE = "struct<role: string, content: string>"
HISTORY = f"user_id string, session_id string, raw_conversation_id string, raw_convation_id string, conversation_date_time string, conversation array<{MESSAGE}>"
CONVERSATIONS = (
    f"conversation_id string, raw_conversation_id string, user_id string, conversation_data array<{MESSAGE}>, "
    f"conversation_compressed_data array<{MESSAGE}>, conversation_date_time timestamp, created_at timestamp"
)
TOPICS = (
    "topic_id string, topic_idx int, topic_context string, topic_messages array<struct<index: int, speaker: string, content: string>>, "
    "status string, source_conversation_ids array<string>, derived_from_topic_ids array<string>, derived_topic_count int, created_at timestamp"
)
MEMORIES = (
    "memory_id string, user_id string, memory_content string, memory_type string, memory_category string, status string, created_at timestamp, "
    "importance double, confidence double, retrieval_count int, last_retrieved_at timestamp, source_topic_ids array<string>, "
    "source_topic_cites map<string, array<int>>, derived_from_memory_ids array<string>, derived_memory_count int, metadata string"
)
VECTORS = "memory_id string, dense array<float>, sparse map<int, float>"
RUNS = "id string, runner string, user_id string, session_id string, dry_run boolean, status string, started_at timestamp, finished_at timestamp, report string, error string"
STEPS = "run_id string, seq int, name string, status string, at timestamp, detail string"
USAGE = "model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"
PROFILE_FACTS = "sample_id string, fact_id string, category string, content string, planned_session string"

# Memory types and their categories, as the validator has them.
VALID_CATEGORIES = {
    "profile": ("fact", "preference", "relationship", "goal", "constraint", "skill", "portrait", "communication_style", "instruct"),
    "episodic": ("conversation_event", "life_event", "project_event", "relationship_event", "decision_event", "unresolved_event"),
    "state": ("current_focus", "pending_followups"),
}
# The document store's own categories, where a type is missing; core comes last and wins.
DOC_CATEGORIES = {
    "profile": ("fact", "preference", "relationship", "goal", "constraint", "skill", "portrait", "communication_style"),
    "episodic": ("conversation_event", "life_event", "project_event", "relationship_event", "decision_event", "unresolved_event"),
    "state": ("current_focus", "recent_mood", "emotional_need", "relationship_state", "task_state", "short_term_context"),
    "core": ("identity", "interaction_guide", "current_focus", "emotional_state", "pending_followups"),
}
TYPE_DIRS = {"profile": "Profile Memory", "episodic": "Episodic Memory", "state": "State Memory", "core": "Core Memory"}
ROLES = ("user", "assistant", "system")
