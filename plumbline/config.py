"""Settings and fixed values.

Word lists, thresholds, label names and messages below are fixed values: results only match when they
are spelled exactly like this.  Everything that is a choice rather than a fixed value is a parameter of
the operator that uses it, with its default here.
"""

from __future__ import annotations

# --- label vocabularies (fixed values) ---------------------------------------------------------------
ABSTAIN, SAFE, RISK = -1, 0, 1
BINARY_LABELS = ["SAFE", "RISK"]
CLASS_LABELS = ["Low", "Medium", "High"]

# --- lexicons counted by the symbolic features (fixed values) ----------------------------------------
SATD_TERMS = ["hack", "fixme", "todo", "workaround", "temporary", "ugly", "hardcoded", "quick fix", "spaghetti"]
SECURITY_TERMS = [
    "auth", "token", "jwt", "encrypt", "pii", "gdpr", "role", "permission", "injection", "xss", "secret",
    "oauth", "credential", "certificate",
]
COMPLEXITY_TERMS = [
    "legacy", "mainframe", "wrapper", "migration", "api", "synchronization", "handshake", "middleware",
    "integration", "refactor", "database",
]
WEAK_MODALS = ["might", "could", "should", "may", "ought"]
VAGUE_TERMS = [
    "fast", "easy", "robust", "user-friendly", "seamless", "efficient", "many", "few", "several", "tbd",
    "appropriate", "suitable", "good", "better", "nice",
]

# --- word lists behind the readability, density and passive approximations (our own choice) -----------
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
FUNCTION_WORDS = [
    "a", "about", "after", "all", "an", "and", "any", "are", "as", "at", "be", "been", "before", "being",
    "but", "by", "can", "could", "did", "do", "does", "each", "for", "from", "had", "has", "have", "he",
    "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "may", "me", "might", "must", "my",
    "no", "nor", "not", "of", "off", "on", "or", "ought", "our", "out", "over", "shall", "she", "should",
    "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "those", "to", "under", "up", "us", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "would", "you", "your",
]
BE_FORMS = ["am", "is", "are", "was", "were", "be", "been", "being"]
IRREGULAR_PARTICIPLES = [
    "built", "chosen", "done", "driven", "found", "given", "held", "hidden", "kept", "known", "left",
    "made", "met", "paid", "put", "read", "run", "seen", "sent", "set", "shown", "sold", "spent", "taken",
    "thrown", "told", "understood", "written",
]

FEATURE_NAMES = [
    "flesch_reading_ease", "gunning_fog", "lexical_density", "weak_modal_density", "has_vague_quantifiers",
    "passive_voice_ratio", "satd_count", "security_count", "complexity_count", "char_count", "word_count",
    "sentence_count", "question_count", "code_block_count", "list_item_count",
]

# --- labeling functions: substring lexicons (fixed values) --------------------------------------------
LF_TERMS = {
    "lf_ambiguity_vague": [
        "user-friendly", "easy", "fast", "robust", "flexible", "efficient", "seamless", "intuitive", "clean",
    ],
    "lf_ambiguity_loophole": ["etc", "et cetera", "and so on", "including but not limited to", "..."],
    "lf_quantification_uncertainty": [
        "some", "several", "many", "a few", "various", "multiple", "a lot", "approximately", "minimal",
        "significant",
    ],
    "lf_weak_action_verbs": ["handle", "support", "manage", "facilitate", "enable", "coordinate", "improve"],
    "lf_temporal_ideal": ["ideally", "normally", "usually", "instantly", "immediately", "typically"],
    "lf_integration_keywords": [
        "api integration", "third-party", "external api", "webhook", "oauth", "sso", "authentication",
    ],
    "lf_legacy_refactor": ["legacy", "refactor", "technical debt", "rewrite", "deprecated", "monolith"],
    "lf_security_keywords": ["security", "vulnerability", "encryption", "penetration test", "audit"],
    "lf_performance_keywords": [
        "performance", "optimization", "scalability", "bottleneck", "latency", "memory leak",
    ],
    "lf_bug_fix": ["fix", "bug", "hotfix", "bugfix", "broken", "error"],
    "lf_documentation_story": ["documentation", "readme", "docs", "comments", "docstring", "guide", "tutorial"],
}
# A number may follow, so the terms alone decide.
DEPENDENCY_TERMS = ["blocked by", "depends on", "relates to", "dependency", "blocking"]
DEPENDENCY_PATTERN = rf"({'|'.join(DEPENDENCY_TERMS)})\s*#?\d*"
BULLET_PATTERN = r"[-*•]\s"
NUMBERED_PATTERN = r"[-*•]\s|\d+\.\s"
POINT_SCALE = [1, 2, 3, 5, 8, 13, 20, 40]

LF_NAMES = [
    "lf_ambiguity_vague", "lf_ambiguity_loophole", "lf_quantification_uncertainty", "lf_weak_action_verbs",
    "lf_temporal_ideal", "lf_high_complexity", "lf_low_complexity_safe", "lf_fibonacci_anomaly",
    "lf_missing_acceptance_criteria", "lf_dependency_link", "lf_very_short_description",
    "lf_very_long_description", "lf_integration_keywords", "lf_legacy_refactor", "lf_security_keywords",
    "lf_performance_keywords", "lf_bug_fix", "lf_documentation_story",
]

# --- thresholds (fixed values) ------------------------------------------------------------------------
HIGH_CONFIDENCE = 0.75
TRAIN_CONFIDENCE = 0.5
CLASS_THRESHOLD = 0.99
SEED = 42
ABLATION_SEEDS = [42, 123, 456, 789, 1024]
IMBALANCE_LIMIT = 3.0

# rows = predicted class, columns = true class
COST_MATRIX = [[0.0, 2.0, 50.0], [1.0, 0.0, 10.0], [3.0, 2.0, 0.0]]

# --- data health (fixed values) -----------------------------------------------------------------------
HEALTH_MIN_STORIES = 100
HEALTH_MIN_WORDS = 5
HEALTH_IDEAL_WORDS = 15
HEALTH_SCALE = [1, 2, 3, 5, 8, 13]
HEALTH_GENERIC = ["fix bug", "update", "change", "modify"]
HEALTH_GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
HEALTH_MESSAGES = {
    "volume": (
        "Collect more historical data. You have {n} stories, but 100+ is recommended for reliable predictions."
    ),
    "completeness": (
        "Some stories are missing critical data (descriptions, story points, or completion info). "
        "Ensure all future stories are fully documented."
    ),
    "quality": (
        "Story descriptions are too brief or generic. Add more detail to descriptions "
        "(aim for 15+ words) to improve prediction accuracy."
    ),
    "consistency": (
        "Story point estimates show inconsistent patterns. Consider using standard "
        "Fibonacci sequence (1, 2, 3, 5, 8, 13) and conducting team calibration sessions."
    ),
    "fine": "Excellent data quality! Your historical data is well-suited for accurate predictions.",
}

# --- scope impact (fixed values) ----------------------------------------------------------------------
SCOPE_MESSAGES = {
    "major": "⚠️ Major timeline impact detected. Consider splitting this into a separate sprint.",
    "delay": "⚠️ Significant delay expected. Evaluate if this change is critical for this sprint.",
    "scope": (
        "💡 This represents a {pct}% increase in scope. "
        "Consider removing lower-priority items to maintain sprint predictability."
    ),
    "large": "💡 Large story detected. Can it be broken into smaller, more manageable pieces?",
    "document": "✓ Document this scope change decision and share with all stakeholders.",
}

# --- explanation sentences (fixed values) -------------------------------------------------------------
FACTOR_MESSAGES = {
    "flesch_hard": "Description is very difficult to read (complexity risk)",
    "flesch_mid": "Description is moderately complex",
    "fog_hard": "Description requires graduate-level reading (high complexity)",
    "fog_mid": "Description is somewhat complex",
    "modal": "High ambiguity detected ({n}+ uncertain words: might, could, should)",
    "vague": "Contains vague terms (fast, easy, user-friendly) - unclear requirements",
    "passive": "High passive voice usage - unclear actor/responsibility",
    "satd": "Contains technical debt markers (TODO, hack, fixme: {n} occurrences)",
    "security": "Security-related task (auth, encryption, etc.: {n} keywords)",
    "complexity": "Integration/legacy complexity detected ({n} keywords)",
    "long": "Very lengthy description (information overload risk)",
    "short": "Very short description (insufficient detail risk)",
    "embedding": "Semantic complexity detected in text content",
}
