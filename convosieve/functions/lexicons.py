"""Word lists, patterns, grids and names that results depend on.

Everything here is data.  Lists that look alike differ on purpose: each feature
family is defined over its own list, so none of them may be merged.
"""

from __future__ import annotations

import string

# --- fixed values: stopword lists -------------------------------------------------

STOPWORDS_FULL = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself "
    "just me more most my myself no nor not now of off on once only or other our ours ourselves out "
    "over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which "
    "while who whom why will with you your yours yourself yourselves"
).split()

STOPWORDS_STYLE = (
    "a an and are as at be but by for from has have he her his i in is it its not of on or our she "
    "that the their them there they this to was we were what when which who will with you your"
).split()

STOPWORDS_RULES = (
    "a an and are as at be been by can for from had has have he her his i in is it its may of on or "
    "our she should that the their them there this to was we were will with you your"
).split()

STOPWORDS_TAGS = (
    "a an and are as at be by for from has have he her his i in is it its of on or our she that the "
    "their them this to was we were will with you your"
).split()

# --- fixed values: term lists -----------------------------------------------------

SPAM_TERMS = (
    "affiliate buy click coupon deal free offer order product products promo sale shopping subscribe"
).split()

RISK_TERMS = "attack combat danger exploit fight harm hate kill threat weapon".split()

TAG_KEYWORDS = {
    "coordination": [
        "coordinate", "coordination", "collaborate", "collaboration", "align", "agreement",
        "cooperate", "shared", "together", "schedule", "synchronize", "negotiate",
    ],
    "covert_instruction": [
        "secret", "hidden", "covert", "discreet", "quietly", "undercover", "coded", "codeword",
        "signal", "without detection", "conceal", "mask",
    ],
    "manipulation": [
        "manipulate", "pressure", "exploit", "persuade", "mislead", "influence", "threaten", "force",
        "coerce", "inflate", "rig", "steer",
    ],
    "deception": [
        "deceive", "deception", "fake", "false", "fabricate", "pretend", "lie", "misrepresent",
        "cover story", "forged", "spoof",
    ],
    "policy_evasion": [
        "bypass", "evade", "avoid detection", "workaround", "jailbreak", "ignore policy",
        "circumvent", "loophole", "filter",
    ],
    "tool_or_workflow": [
        "tool", "workflow", "api", "function", "system", "process", "pipeline", "database", "query",
        "task", "automation", "agent",
    ],
    "extract_or_leak": [
        "extract", "leak", "exfiltrate", "password", "credential", "token", "private",
        "confidential", "sensitive", "secret key",
    ],
}

# --- fixed values: closed tag domains ---------------------------------------------

TAG_FAMILIES = [
    "clean_benign", "coordination", "covert_instruction", "manipulation", "deception",
    "policy_evasion", "tool_or_workflow", "code_or_structured", "noise_or_corrupt",
    "generic_filler", "unclear",
]
TAG_INTENTS = [
    "benign_info", "benign_plan", "coordinate", "instruct", "hide_or_obfuscate", "manipulate",
    "evade", "extract_or_leak", "none", "unclear",
]
TAG_RISKS = ["none", "low", "med", "high"]

TEACHER_TAG_DOMAINS = {
    "coherence": ["normal", "awkward", "broken"],
    "semantic_drift": ["none", "low", "medium", "high"],
    "task_clarity": ["clear", "partial", "unclear"],
    "corruption": ["none", "some", "high"],
    "suspicious_intent": ["none", "weak", "strong"],
    "family": [
        "normal_info", "prompt_question", "product_spam", "code_structured", "decode_error",
        "multilingual", "synthetic_drift", "list_poem", "unclear",
    ],
}
TEACHER_TAG_DEFAULTS = {
    "coherence": "awkward",
    "semantic_drift": "low",
    "task_clarity": "partial",
    "corruption": "some",
    "suspicious_intent": "weak",
    "family": "unclear",
}

# --- fixed values: character sets -------------------------------------------------

PUNCTUATION = string.punctuation
BRACKETS = "()[]{}<>"
QUOTES = "\"'`“”‘’"

# --- fixed values: patterns -------------------------------------------------------

URL_PREFIX = r"https?://|www\."
URL_FULL = r"https?://\S+|www\.\S+"
URL_DOMAIN = r"https?://|www\.|\b[a-z0-9-]+\.(?:com|org|net|io|gov|edu)\b"
EMAIL = r"\b\S+@\S+\.\S+\b"
NUMBER = r"\b\d+(?:[.,:/-]\d+)*\b"
MARKUP_RUN = r"[`*_#>\-]{2,}"
CAMEL_GLUE = r"[a-z][A-Z][a-z]"
CAMEL_JOINED = r"\b[a-z]+[A-Z][a-z]+"
ROLE_LINE = r"^\s*(user|assistant|system)\s*:"
ROLE_MARKER = r"\b(user|assistant|system)\s*:"

CODE_FENCED = r"```[\s\S]*?```"
CODE_INLINE = r"`[^`]+`"
CODE_KEYWORDS = (
    r"\b(def|class|import|from|SELECT|INSERT|UPDATE|DELETE|DROP|curl|wget|sudo|#!/bin/bash)\b"
)
HTML_TAG = r"<\/?[a-zA-Z][^>]*>"

STYLE_PROMPT = (
    r"based on the passage above|answer:|question:|could you|can you|what is|how did|why did|paraphrase"
)
STYLE_CODE = (
    r"\{|\}|\[|\]|=>|==|</|/>|function\b|var\b|const\b|let\b|def\b|class\b|model\(|user_story|setvar"
)

NOISE_CODE = (
    r"```|</s>|<s>|\[/inst\]|\b(import|def|class|return|print)\b|console\.log"
    r"|\{[\"']?[A-Za-z_][\w -]*[\"']?\s*:"
)
NOISE_MARKDOWN = r"^\s{0,3}(#{1,6}\s+|[-*]\s+|\d+\.\s+|>\s+)"
NOISE_LIST = r"^\s*([-*]|\d+\.)\s+"
TEMPLATE_PHRASES = ["based on the passage above", "the passage above"]

ERROR_PROMPT_CODE = [
    r"\buser\s*:",
    r"\bassistant\s*:",
    r"\bsystem\s*:",
    r"```",
    r"</s>",
    r"<s>",
    r"\[/inst\]",
    r"\[inst\]",
    r"\bjson\b",
    r"\bimport\s+[a-zA-Z_]",
    r"\bdef\s+[a-zA-Z_]",
    r"\bclass\s+[a-zA-Z_]",
    r"\bprint\s*\(",
    r"\breturn\s+",
    r"\bfunction\s*\(",
    r"\bconsole\.log\s*\(",
    r"\{[\"']?[a-zA-Z_][a-zA-Z0-9_ -]*[\"']?\s*:",
    r"^\s*[-*]\s+",
    r"^\s*#{1,6}\s+",
]

ARTIFACT_DECODE = r"\[decode error\]|decode error|failed to decode|invalid utf-8"
ARTIFACT_PROMPT = (
    r"based on the passage above|question:|answer:|could you|can you|what is|why did|paraphrase"
)
ARTIFACT_CODE = (
    r"\{|\}|\[|\]|</|/>|```|function\b|class\b|def\b|return\b|elif\b|std::|json|assistant|user|system|prompt"
)
ARTIFACT_MOJIBAKE = r"Ã.|â.|�|Å.|Ä.|Ð.|Ñ."

CUE_INSURANCE = (
    r"\b(insurance|insurer|insured|policy|premium|claim|claims|coverage|liability|deductible"
    r"|adjuster|underwriting|settlement|payout|compensation|assessment|valuation|appraisal|damage"
    r"|damages)\b"
)
CUE_COORDINATION = (
    r"\b(coordinate|coordination|cooperate|cooperation|collaborate|collaboration|agree|agreement"
    r"|arrange|align|joint|together|mutual|share|split|signal|timing|schedule|sequence|turn|round"
    r"|between us)\b"
)
CUE_MANIPULATION = (
    r"\b(collude|collusion|cartel|inflate|deflate|fix|rig|manipulate|manipulation|deceive|deception"
    r"|mislead|fraud|fake|conceal|hide|secret|kickback|bribe|exclude|competitor|monopoly|monopolize"
    r"|overstate|understate)\b"
)
CUE_CRYPTIC = (
    r"\b(code word|coded|cryptic|hidden|subtle|quiet|silently|do not mention|don't mention"
    r"|off record|cover story|mask|disguise|innocuous|indirect|without saying|between the lines)\b"
)
CUE_AGENT = (
    r"\b(user|assistant|system|agent|agents|tool|tools|message|messages|instruction|prompt)\b"
    r"|\[[0-9]+_(?:system|user|assistant)"
)

RULE_PATTERNS = {
    "regex::decode_error": r"\[decode error\]|decode error|invalid utf|invalid character|unknown encoding",
    "regex::agent_markers": r"\[[0-9]+_(?:system|user|assistant)|(?:^|[\s,])(?:user|assistant|system):",
    "regex::prompt_roles": r"\b(?:user|assistant|system)\s*:",
    "regex::code_or_json": r"```|[\{\}\[\]]|</?\w+>|\"[A-Za-z0-9_]+\"\s*:",
    "regex::url_or_email": r"https?://|www\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "regex::paraphrase_prompt": r"\bparaphrase\b|\bin simpler terms\b|\bbased on (?:the )?passage\b",
    "regex::instructional": r"\b(?:please|must|should|need to|make sure|ensure|follow|reply|respond|write|generate)\b",
    "regex::coordination_terms": r"\b(?:coordinate|collaborate|cooperate|align|agreement|together|shared|schedule|synchronize)\b",
    "regex::deception_terms": r"\b(?:deceive|fake|false|fabricate|pretend|mislead|secret|hidden|covert|conceal|mask)\b",
    "regex::manipulation_terms": r"\b(?:manipulate|pressure|exploit|persuade|influence|coerce|inflate|rig|steer)\b",
    "regex::evasion_terms": r"\b(?:bypass|evade|avoid detection|workaround|jailbreak|circumvent|loophole)\b",
    "regex::sensitive_data_terms": r"\b(?:password|credential|token|private|confidential|sensitive|secret key|leak|extract)\b",
    "regex::workflow_terms": r"\b(?:tool|workflow|api|function|system|process|pipeline|database|query|automation|agent)\b",
    "regex::seo_or_spam": r"\b(?:best|top|review|reviews|buy|cheap|discount|weight loss|keto|supplement)\b",
}

TAG_CODE_OR_STRUCTURED = r"```|[\{\}\[\]]|^\s*[-*]\s+|user:|assistant:|system:|json|<[^>]+>"
TAG_URL_OR_EMAIL = r"https?://|www\.|@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# --- fixed values: column-name heuristics -----------------------------------------

TEXT_NAME_HINTS = ["text", "conversation", "dialog", "message", "content", "prompt", "response"]
TEXT_COLUMN_PRIORITY = ["text", "conversation", "prompt", "content", "input", "messages"]
PREFERRED_TEXT_KEYS = ["text", "content", "message", "value", "prompt", "response"]
TURN_LIST_KEYS = ["messages", "conversation", "turns", "dialogue"]
PROB_COLUMNS_TEACHER = [
    "oof_prob_TRUE_mean", "oof_prob_TRUE", "pred_prob_TRUE", "teacher_prob_TRUE", "pseudo_prob_TRUE",
]
PROB_COLUMNS_PSEUDO = [
    "teacher_prob_TRUE", "pred_prob_TRUE", "pseudo_prob_TRUE", "oof_prob_TRUE", "oof_prob_TRUE_mean",
]
THRESHOLD_PATHS = [
    "$.threshold_tuning.selected_threshold",
    "$.best_epoch.selected_specialist_threshold",
    "$.best_epoch.best_tuned_threshold",
    "$.validation_final.threshold",
    "$.selected_threshold",
    "$.specialist_threshold",
]
METRIC_BUNDLE_KEYS = ["oof_final", "oof", "validation_final", "metrics"]

# --- fixed values: grids and cut-offs ---------------------------------------------

THRESHOLD_GRID = [round(0.30 + 0.01 * i, 2) for i in range(41)]
THRESHOLD_GRID_WIDE = [round(0.05 + 0.01 * i, 2) for i in range(91)]
BLEND_WEIGHTS = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
BLEND_THRESHOLDS = [0.25, 0.28, 0.30, 0.32, 0.34, 0.36, 0.38, 0.40, 0.45, 0.50]
NAMED_BLENDS = [
    ("count577_r0p90_thr0p34", 0.90, 0.34),
    ("count577_r0p85_thr0p34", 0.85, 0.34),
    ("count578_r0p95_thr0p32", 0.95, 0.32),
    ("count576_r0p95_thr0p34", 0.95, 0.34),
    ("count578_r0p80_thr0p34", 0.80, 0.34),
]
TWO_RUN_WEIGHTS = [0.50, 0.60, 0.70, 0.80, 0.90]
ROUTER_BANDS = [(0.10, 0.90), (0.15, 0.85), (0.20, 0.80), (0.25, 0.75)]
SIMILARITY_CUTOFFS = [0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.98, 0.99]
SIMILARITY_QUANTILES = [0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0]
LENGTH_CANDIDATES = [128, 192, 256, 320, 384, 448, 512]
SELECTION_COUNTS = [568, 572, 577, 582, 586]
CALIBRATOR_COUNTS = [574, 577, 578, 580]
ENSEMBLE_COUNTS = [570, 574, 577, 578, 580, 585, 590]
RANK_BLEND_WEIGHTS = [0.90, 0.85, 0.80]

CALIBRATOR_FEATURE_SETS = {
    "score_only": ["score_logit"],
    "core_style": [
        "score_logit", "char_length", "word_count", "sentence_count", "avg_sentence_word_count",
        "unique_word_ratio", "stopword_ratio", "spam_keyword_count", "risk_keyword_count",
        "prompt_template_flag", "decode_error_flag",
    ],
    "noise_style": [
        "score_logit", "char_length", "word_count", "avg_word_length", "max_word_length",
        "sentence_count", "unique_word_ratio", "stopword_ratio", "digit_ratio", "uppercase_ratio",
        "punctuation_ratio", "non_ascii_ratio", "non_alnum_ratio", "code_symbol_count",
        "weird_token_ratio", "repeated_token_count", "very_long_token_count", "url_domain_count",
        "spam_keyword_count", "risk_keyword_count", "prompt_template_flag", "decode_error_flag",
    ],
}
CALIBRATOR_C = [0.01, 0.03, 0.1, 0.3, 1.0]
