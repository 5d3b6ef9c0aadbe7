"""Given by the data formats and the published rules; results depend on them as they stand.

Nothing here is logic. Formats, labels, word lists and patterns are stated plainly, each list in its given order.
"""

# --- corpus files -------------------------------------------------------------------------------

SEPARATOR = "<sep>"
#: source, page, chunk id
STRICT_HEADER = r"^<sep>\[SOURCE:([^|]+)\|PAGE:(\d+)\|CID:([a-f0-9]+)\]$"
LENIENT_HEADER = r"^<sep>\[SOURCE:([^|]+)\|PAGE:([^|]+)\|CID:([^\]]+)\]"
ROOT_SECTION = "__root__"

# --- grades -------------------------------------------------------------------------------------

#: Labels that judges write before a number.
NUMBER_LABELS = ["score=", "score: ", "D2=", "D3=", "D4="]

# --- boilerplate --------------------------------------------------------------------------------

MIN_BODY_CHARS = 150

#: (what goes, what comes in its place), in order: images, links with their words, marks.
MARKDOWN = [
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\[[^\]]+\]\([^)]+\)", ""),
    (r"[*_`#>|-]+", " "),
    (r"\s+", " "),
]

BOILERPLATE_HEADINGS = [
    "references",
    "reference",
    "bibliography",
    "contents",
    "table of contents",
    "in this chapter",
    "activity",
    "resources",
    "aims",
    "objectives",
    "instructions",
    "instructions for students",
    "summary of module",
    "acknowledgements",
    "acknowledgments",
    "thanks",
    "foreword",
    "preface",
    "suggested citation",
    "endorsed by",
    "how to use this book",
    "facilitator's schedule and preparation activities",
    "reflection on the trigger scenario",
    "reflection on trigger scenario",
    "web resources for clinicians",
    "web resources",
    "role play",
    "role-play",
    "simulated practice",
    "notices",
    "follow-up activities",
    "planning follow-up",
]

#: Reasons with the patterns that give them, in order. Case doesn't matter.
FRONT_MATTER_PATTERNS = [
    ("suggested_citation", [r"\bsuggested citation\b"]),
    ("endorsed_by", [r"\bendorsed by\b"]),
    ("table_of_contents", [r"\btable of contents\b"]),
    ("acknowledgements", [r"\backnowledg(e)?ments?\b"]),
    ("foreword", [r"\bforeword\b"]),
    ("copyright", [r"\bcopyright\b", r"\ball rights reserved\b"]),
    ("license", [r"\blicen[cs]e\b", r"\bisbn\b"]),
]

STRUCTURAL_PATTERNS = [
    ("approved_by", [r"\bapproved by\b", r"\bversion no\.?\b"]),
    ("cataloguing", [r"\bWHO Library Cataloguing\b", r"\bCataloguing-in-Publication\b"]),
    ("facilitator_schedule", [r"\bfacilitator'?s schedule\b", r"\bpreparation activities\b"]),
    ("case_number", [r"\bcase number\s*:"]),
    ("instructions_for", [r"\binstructions for\b", r"\bguidelines for case study\b"]),
    ("reflection_trigger", [r"\breflection on the trigger scenario\b"]),
    (
        "educator_instruction",
        [
            r"\bask (?:(?:the|a|one|each|for) )?(?:students?|learners?)\b",
            r"\basking (?:students?|learners?)\b",
            r"\binvite.*\blearners?\b",
            r"\bfollow.?up meeting\b",
            r"\bsimulated practice\b",
            r"\brole.?play\b",
            r"\bdiscussion groups?\b.*\bconsider\b",
            r"\bwrite.*on the blackboard\b",
            r"\bfacilitator.*\brotates?\b",
            r"\bshow slide\b",
            r"\bfacilitators?\s+explain\b",
            r"\bremind students\b",
        ],
    ),
]

FULL_BODY_PATTERNS = [
    (
        "scenario_reflection",
        [
            r"\bquestions that (?:arise|could be asked|may be asked|need to be addressed|could arise)\b",
            r"\bin order to confirm that a student is competent\b",
            r"\b(?:this|the) module begins with\b",
        ],
    ),
]

# --- messages to models -------------------------------------------------------------------------

#: What a judge and a filter are shown. A part whose value is missing is left out with its label.
SOURCE_LABEL, PAGE_LABEL, BREADCRUMB_LABEL = "Source: ", "Page: ", "Breadcrumb: "
JUDGE_MESSAGE = "## Query\n{query}\n\n## Guideline chunk\n{head}---\n{text}\n---"
FILTER_MESSAGE = "{head}Chunk:\n{text}"

REWRITE_TYPES = [
    "abbreviation",
    "typo",
    "lay_synonym",
    "redundant_context",
    "ambiguous",
    "multi_condition",
    "negation",
    "rare_exact",
]

#: Fields of a label, by rubric: a set of fields is a version.
RUBRIC_FIELDS = {
    "v1_boolean": ["query_id", "chunk_id", "llm_judge_schema_version", "llm_judge_prompt_hash", "llm_backend", "llm_model", "reasoning", "d1_topic", "d2_meaningful", "d3_actionable", "score"],
    "v2_graded": ["query_id", "chunk_id", "llm_judge_schema_version", "llm_judge_prompt_hash", "llm_backend", "llm_model", "d1_topic", "d2_meaningful", "d3_actionable", "d4_density", "_error"],
}
FILTER_FIELDS = ["chunk_id", "llm_filter_schema_version", "llm_filter_prompt_hash", "llm_backend", "llm_model", "query", "reason"]

#: Cosines that tell a sound encoder: of texts on one topic all above the first, of unrelated ones below the second.
SANE_SAME, SANE_UNRELATED = 0.5, 0.3
