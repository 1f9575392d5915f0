"""Fixed values.

Every table in this module has to equal the published behaviour for results to
agree: section names and order, word lists, thresholds, templates and patterns.
They are plain values with no logic attached.
"""

from __future__ import annotations

# --- report sections -------------------------------------------------------

SECTION_ORDER = [
    "At a Glance",
    "Overview",
    "Background",
    "Key Concepts",
    "Methods",
    "Key Results",
    "Figures",
    "Limitations & Open Questions",
    "Why It Matters",
    "Key Takeaways",
    "Study Questions",
]

SECTION_QUESTIONS = {
    "At a Glance": "What is this paper, in five lines?",
    "Overview": "What is this paper, and why does it exist?",
    "Background": "What came before this paper, and why wasn't it enough?",
    "Key Concepts": "Which ideas and terms do I need before the methods make sense?",
    "Methods": "What did the authors actually do?",
    "Key Results": "What did they find, and how strong is the evidence?",
    "Figures": "What do the paper's figures and tables show?",
    "Limitations & Open Questions": "What does this work not show, and what is still unresolved?",
    "Why It Matters": "So what — what changes because of this work?",
    "Key Takeaways": "If I remember only a few things from this paper, what should they be?",
    "Study Questions": "Can I explain this back without looking?",
}

SECTION_BADGES = {
    "At a Glance": "FACT CARD",
    "Overview": "SUMMARY",
    "Background": "CONTEXT",
    "Key Concepts": "CONCEPTS",
    "Methods": None,
    "Key Results": "KEY RESULTS",
    "Figures": "FIGURES",
    "Limitations & Open Questions": "CAVEATS",
    "Why It Matters": "IMPACT",
    "Key Takeaways": "RECAP",
    "Study Questions": "SELF-CHECK",
}

DEFAULT_OPEN_SECTIONS = ["At a Glance", "Overview", "Background"]

AT_A_GLANCE_FIELDS = ["Problem", "Approach", "Evidence", "Headline result", "Read this if"]

SECTION_QUERIES = {
    "At a Glance": "problem statement what is proposed what this paper is about what was evaluated on headline result main contribution in one sentence",
    "Overview": "paper overview abstract summary motivation contribution problem statement",
    "Background": "background related work prior work previous approaches existing methods motivation why this is hard limitations of earlier work context history",
    "Key Concepts": "we define definition preliminaries notation terminology concept intuition refers to denotes is defined as formulation basic idea building block term acronym abbreviation stands for also known as we denote we call this",
    "Methods": "method approach model architecture algorithm framework implementation",
    "Key Results": "results experiments evaluation performance benchmark accuracy findings",
    "Figures": "figure table chart diagram plot visualization illustration",
    "Limitations & Open Questions": "limitations drawbacks weaknesses fails when does not work assumption threats to validity future work remains open not addressed untested",
    "Why It Matters": "implications significance impact applications enables in practice broader why this matters what changes as a result who benefits",
    "Key Takeaways": "key takeaway main finding most important result central claim what to remember bottom line significance impact why it matters we show we find",
    "Study Questions": "main contribution key idea why it works central claim evidence result limitation implication what this means takeaway",
}

SWEEP_QUERIES = [
    "introduction motivation problem statement why this matters",
    "background related work prior approaches previous methods",
    "definition terminology notation concept we define refers to",
    "method approach architecture algorithm implementation steps",
    "experiment dataset benchmark setup evaluation protocol",
    "results performance accuracy comparison baseline improvement",
    "figure table chart diagram shows illustrates",
    "limitation drawback assumption future work open question",
    "conclusion discussion implication application impact",
]

SWEEP_K = 60
POOL_LIMIT = 400
POOL_BUCKETS = 6

# per detail level: section k, figures k, chunk cap, body / deep parts, counts
DETAIL_PARAMS = {
    "concise": {"k": 5, "k_figures": 8, "max_chunks": 5, "body_parts": 2, "deep_parts": 3, "concepts": 5, "takeaways": 4, "questions": 5},
    "standard": {"k": 10, "k_figures": 16, "max_chunks": 10, "body_parts": 6, "deep_parts": 6, "concepts": 8, "takeaways": 6, "questions": 6},
    "detailed": {"k": 20, "k_figures": 28, "max_chunks": 18, "body_parts": 14, "deep_parts": 10, "concepts": 12, "takeaways": 8, "questions": 8},
}
WIDE_NET_BONUS = {"At a Glance": 6, "Key Concepts": 6}
FALLBACK_CHUNKS_PER_SECTION = 18
ABSTRACT_LEAD_CHARS = 900

NARRATIVE_SECTIONS = [
    "At a Glance",
    "Overview",
    "Background",
    "Key Concepts",
    "Methods",
    "Key Results",
    "Limitations & Open Questions",
    "Why It Matters",
    "Key Takeaways",
]

SECTION_KEYWORDS = {
    "At a Glance": ["problem", "propose", "present", "we introduce", "dataset", "experiment", "accuracy", "achiev", "result", "application"],
    "Overview": ["overview", "abstract", "introduc", "motivat", "propose", "contribut", "problem"],
    "Background": ["background", "prior work", "related work", "previously", "existing", "traditional", "motivat", "limitation", "challenge", "difficult", "problem"],
    "Key Concepts": ["we define", "is defined", "definition", "notation", "preliminar", "concept", "intuition", "refers to", "denotes", "terminolog", "formulat"],
    "Methods": ["method", "approach", "architectur", "model", "algorithm", "framework", "design", "implement"],
    "Key Results": ["result", "experiment", "evaluat", "performance", "accuracy", "benchmark", "outperform", "table", "score"],
    "Limitations & Open Questions": ["limitation", "however", "future work", "does not", "cannot", "fail", "assum", "constraint", "restrict", "remains", "open question", "drawback"],
    "Why It Matters": ["impact", "practical", "application", "enable", "useful", "deploy", "real-world", "real world", "significan", "implication", "benefit"],
    "Key Takeaways": ["we show", "we find", "notably", "importantly", "in short", "key finding", "main contribution", "significant", "outperform", "state of the art", "novel"],
}

GLANCE_KEYWORDS = {
    "Problem": ["problem", "challenge", "challenging", "limitation", "difficult", "bottleneck", "suffers from", "fails to", "hard to", "drawback", "unable to", "issue", "shortcoming", "not accurate", "error-prone"],
    "Approach": ["we propose", "we present", "we introduce", "we design", "we develop", "this paper proposes", "this paper presents", "propose", "present a", "introduce", "our approach", "our method", "our system", "we use", "based on", "framework", "algorithm", "presented here", "designed here", "is designed", "we build", "we implement", "implemented", "system for", "method for", "approach to", "vision-based", "-based system", "a new way", "novel"],
    "Evidence": ["dataset", "database", "benchmark", "evaluated on", "experiments on", "we evaluate", "test set", "training set", "corpus", "samples", "subjects", "images", "experimental setup", "we conducted", "trials", "camera", "cameras", "webcam", "hardware", "resolution"],
    "Headline result": ["achieves", "achieved", "accuracy", "outperform", "reduces", "reduced", "improves by", "improvement of", "percent", "%", "precision", "recall", "f1", "error rate", "speedup", "state-of-the-art", "success rate", "frames per second", "fps", "runs at", "operates at", "real time"],
    "Read this if": ["useful", "practical", "application", "applications", "can be used", "enables", "suitable for", "real-time", "real world", "real-world", "deploy", "developers", "researchers", "practitioners", "industry", "human computer interface", "assistive"],
}
GLANCE_UNKNOWN = "Not stated in the retrieved passages."

LIMITATION_MARKERS = ["limitation", "however,", "future work", "in future", "future research", "does not", "do not handle", "cannot", "can not", "fails when", "fail to", "we assume", "assumption", "is constrained by", "restricted to", "only works", "remains an open", "open question", "drawback", "not addressed", "beyond the scope", "left for future", "yet to be"]
SCOPE_MARKERS = ["dataset", "database", "images", "evaluated", "experiment", "tested on", "we test", "samples", "subjects", "environment", "condition", "camera", "resolution", "illumination", "lighting", "we use", "benchmark"]
NO_LIMITATIONS_LEAD = "The retrieved passages do not state the work's limitations directly. What they do show is the scope of what was actually tested:"
NO_LIMITATIONS_ONLY = "The retrieved passages do not state the work's limitations directly, and they do not describe the evaluation in enough detail to say what was left untested."

STUDY_QUESTION_PLAN = [
    ("In one or two sentences, what problem does this paper set out to solve?", ["Background", "Overview"]),
    ("What do the authors propose, and what makes it different from what came before?", ["Overview", "Methods"]),
    ("Walk through the method: what are its main components, and what does each one do?", ["Methods"]),
    ("Which results are offered as evidence, and how large is the improvement over the baselines?", ["Key Results"]),
    ("Why did the earlier approaches fall short where this one succeeds?", ["Background", "Why It Matters"]),
    ("What do the paper's figures and tables show that the running text does not?", ["Figures", "Key Results"]),
    ("What limitations or open questions does the paper leave behind?", ["Limitations & Open Questions"]),
    ("How would you explain this work — and why it matters — to someone new to the field?", ["Why It Matters", "Overview", "Key Results"]),
]

# --- job stages ------------------------------------------------------------

STAGE_ORDER = ["Download", "Extract text", "Extract images", "OCR", "Vision analysis", "Embedding", "Generate report"]
FATAL_STAGES = ["Download", "Extract text", "Embedding"]
STAGE_STATUSES = ["pending", "running", "done", "error"]
JOB_STATES = ["queued", "running", "done", "error"]

# --- ratings ---------------------------------------------------------------

RECALLED_RATINGS = ["almost", "got_it", "hard", "good", "easy"]
REQUEUE_GAPS = {"again": 6, "almost": 12}
CARD_ORIGINS = ["glossary", "key_concept", "takeaway", "fact", "manual"]
QUESTION_KINDS = ["multiple_choice", "true_false", "short_answer"]
DIFFICULTIES = ["recall", "understand", "apply"]
SHORT_ANSWER_OVERLAP = 0.6
NEAR_DUPLICATE_OVERLAP = 0.75
MODALITIES = ["text", "ocr", "vision", "image"]

# --- word lists ------------------------------------------------------------

PROSE_STOPWORDS = (
    "a an the of and or but if then than that this these those to in on at by "
    "from for with as is are was were be been being it its we our you your they "
    "their he she his her which who whom when where while can may might must "
    "should would could has have had do does did not no so such into over under "
    "between about after before during because"
).split()

GRADING_STOPWORDS = (
    "the and for that this these those with from into its it's are was were been "
    "being has have had which who whom whose what when where how why but also "
    "such than then there their they them our ours you your yours his her hers "
    "she him its' can could would should will shall may might must does did "
    "doing done each any some more most much many very about over under between "
    "because while during both either neither same other another used using use uses"
).split()

NON_ANSWER_KEYS = [
    "", "idk", "i don t know", "i do not know", "don t know", "dunno", "no idea",
    "not sure", "unsure", "no clue", "n a", "na", "none", "nothing", "skip",
    "pass", "tbd", "todo",
]

STOP_TERMS = (
    "THE AND FOR BUT NOT ALL ANY ONE TWO WE US IT IS ARE WAS THIS THAT THESE "
    "THOSE WITH FROM INTO OUR ITS CAN MAY USE USED NEW SEE FIG FIGURE TABLE "
    "SECTION APPENDIX EQ PDF URL HTTP HTTPS ARXIV DOI ISBN IEEE ACM ET AL II III "
    "IV VI VII IX XI A I AN OF IN ON TO BY AS AT OR IF SO BE DO NO UP"
).split()

WEAK_SUBJECTS = ["this", "it", "that", "these", "those", "there", "which", "who", "here"]

POOL_SECTION_HINTS = [
    ("Key Concepts", "define defined definition denote denotes term terminology notation refers called means".split()),
    ("Methods", "method approach architecture algorithm propose proposed training trained dataset implementation procedure pipeline module layer step steps network model".split()),
    ("Key Results", "result results accuracy performance score scores baseline outperform outperforms improve improvement improves evaluation benchmark bleu f1".split()),
    ("Limitations & Open Questions", "limitation limitations however fail fails assumption future drawback weakness threat unresolved".split()),
    ("Why It Matters", "conclude conclusion implication implications impact enables significance matters application applications apply".split()),
    ("Background", "prior previous related existing traditionally literature earlier".split()),
    ("Figures", "figure table fig chart illustrates shown depicts".split()),
]

HEADING_KEYWORDS = ["abstract", "references", "acknowledgments", "acknowledgements", "appendix", "introduction", "conclusion", "conclusions", "related work"]
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "professor"]
TITLE_STOPWORDS = ["a", "an", "the", "of", "on", "in", "for", "and", "to"]
CITATION_STYLES = ["apa", "mla", "chicago", "ieee", "bibtex"]
CITATION_STYLE_LABELS = {"apa": "APA (7th edition)", "mla": "MLA (9th edition)", "chicago": "Chicago (author-date)", "ieee": "IEEE", "bibtex": "BibTeX"}
TITLE_MISSING = "[title unavailable]"
SCAFFOLD_FRAGMENTS = ["paper abstract (context", "not to be cited", "hard length limit", "hard count limit", "formatting:", "already covered", "answered elsewhere", "this section answers exactly one question"]

# --- thresholds ------------------------------------------------------------

SHORT_CHUNK_CHARS = 300
MIN_RESIDUE_CHARS = 80
PREFIX_CHARS = 90
MIN_PREFIX_CHARS = 20
MAX_HEADER_CHARS = 400
MIN_HEADER_PAGES = 3
DEDUPE_KEY_CHARS = 120
MIN_PROSE_SCORE = 0.15
MIN_POOL_PROSE_SCORE = 0.2
MAX_JACCARD = 0.6
MIN_DECK_CARDS, MAX_DECK_CARDS = 8, 60
MIN_BACK_CHARS, MAX_BACK_CHARS, MAX_FRONT_CHARS = 20, 320, 240
MAX_CHAPTERS = 300
CHAPTER_BUCKET_PAGES = 10
MAX_UPLOAD_BYTES = 512 * 1024 * 1024
# fixed value: what a study question without a passage is answered with
UNANSWERED_QUESTION = "No grounded passage was retrieved to answer this yet."
CITATION_MATCH_FLOOR = 0.4
WORDS_PER_MINUTE = 200

# --- patterns (portable between Java and RE2: no look-around, no \b) --------

CAPTION = r"(?i)^\s*(fig(?:ure)?|table|chart|plate|scheme)\s*\.?\s*\d+\s*[:.\-—)]?"
CAPTION_LEAD = "^[\\s\\-*+•>\"“”'’]*(?:\\d+[.)]\\s*)?"
COPYRIGHT = r"(?i)(©|\(c\))\s*\d{4}|all rights reserved"
JOURNAL_HEADER = r"(?i)international journal of [a-z ,&]+,?\s*vol\.?\s*\d+,?\s*no\.?\s*\d+,?\s*\d{4}"
AUTHOR_PROFILE = r"(?i)authors?\s+profile"
BIOGRAPHY = (
    r"(?i)received\s+(?:his|her|their|the)\s+[a-z.]*\s*(?:b\.?e\.?|b\.?tech|m\.?e\.?|m\.?tech|ph\.?d\.?|bachelor|master|doctorate)"
    r"|is\s+currently\s+pursuing|(?:bachelor|master)\s+of\s+(?:engineering|science|technology|arts)"
)
LICENCE = (
    r"(?i)grants?\s+permission|permission\s+to\s+(reproduce|copy|use)|licen[sc]ed\s+under|creative\s+commons"
    r"|reproduced\s+with\s+permission|for\s+personal\s+or\s+classroom\s+use"
)
BARE_PAGE_NUMBER = r"(?i)^\s*(page\s*)?[\d\s\-.]+\s*$"
BARE_URL = r"(?i)^\s*(https?://|www\.)\S+\s*$"
NUMBERED_HEADING = r"^(\d{1,2}(\.\d{1,2}){0,2}\.?)\s+[A-Z][A-Za-z].{0,80}$"
MODEL_TOKEN = r"(?i)<\s*/?\s*(eos|bos|pad|unk|s|mask|sep|cls)\s*>"
SCAFFOLD_OPENING = r"(?i)^(?:no |this section|the (?:report|section)|re-?generate|not enough|insufficient|could not be)"
BANNED_OPTION = r"(?i)^\s*(all|none|both|either|neither)\s+of\s+(the\s+)?(above|these|them)"

# --- flashcard and quiz phrasing --------------------------------------------

CARD_STEMS = {
    "term": (
        [
            "What is **{term}**, and why does it matter in this paper?",
            "How would you explain **{term}** to someone new to this paper?",
            "In this paper's context, what does **{term}** mean?",
            "What role does **{term}** play in this paper?",
        ],
        [
            "Why does this paper need **{term}**?",
            "Define **{term}** as this paper uses it.",
            "Where does **{term}** fit into the paper's approach?",
            "What would be missing from this paper without **{term}**?",
        ],
    ),
    "bold": (
        [
            "What does the paper claim about **{subject}**?",
            "According to the paper, what is true of **{subject}**?",
            "What point does the paper make regarding **{subject}**?",
            "How does the paper characterize **{subject}**?",
        ],
        [
            "What is this paper's position on **{subject}**?",
            "State what this paper establishes about **{subject}**.",
            "What is worth remembering about **{subject}**?",
            "Recall the paper's finding on **{subject}**.",
        ],
    ),
    "number": (
        [
            "Fill in the blank: {blanked}",
            "Complete this sentence from the paper: {blanked}",
            "What number completes this claim? {blanked}",
        ],
        [
            "Supply the missing figure: {blanked}",
            "The paper reports a specific number here — what is it? {blanked}",
            "Recall the exact value: {blanked}",
            "From memory, fill this in: {blanked}",
        ],
    ),
    "lead": (
        [
            "Complete this {label} from the paper: “{lead} …”",
            "How does this {label} continue? “{lead} …”",
            "Finish the thought: “{lead} …”",
        ],
        [
            "Continue this {label} in the paper's own terms: “{lead} …”",
            "What comes next? “{lead} …”",
            "Recall the rest of this {label}: “{lead} …”",
            "Pick up where this leaves off: “{lead} …”",
        ],
    ),
}
HEADLINE_FRONT = "What is one of the paper's headline claims?"

QUIZ_STEMS = {
    "tf_definition": [
        "True or false: in this paper, **{term}** refers to {pred}.",
        "True or false — this paper uses **{term}** to mean {pred}.",
        "The paper defines **{term}** as {pred}. True or false?",
        "Is this right? In this paper, **{term}** is {pred}.",
        "True or false: for this paper, **{term}** means {pred}.",
    ],
    "mc_definition": [
        "As this paper uses it, which description best fits **{term}**?",
        "This paper uses **{term}** in a particular way. Which description is it?",
        "Pick the description this paper gives for **{term}**.",
        "Which of these is **{term}**, as this paper defines it?",
    ],
    "sa_definition": [
        "What does this paper call the following? “{masked}”",
        "The paper has a name for this. What is it? “{masked}”",
        "Name the idea this describes: “{masked}”",
        "Which term does this paper use for this? “{masked}”",
    ],
    "numeric_blank": [
        "Fill in the blank with the value this paper reports: “{blanked}”",
        "What value belongs in the blank? “{blanked}”",
        "The paper reports a specific figure here — what is it? “{blanked}”",
        "Recall the number: “{blanked}”",
    ],
    "mc_intro": [
        "The paper introduces an idea this way: “{own}”. Which of its terms is being described?",
        "This description comes from the paper: “{own}”. What is it describing?",
        "The paper says: “{own}”. Which of its ideas is that?",
    ],
    "mc_apply": [
        "You are applying this work to a new problem and need the piece that provides the following: “{own}”. Which of the paper's ideas should you reach for?",
        "Your new system needs this: “{own}”. Which idea from the paper supplies it?",
        "To get this behaviour — “{own}” — which of the paper's components do you need?",
    ],
    "sa_apply": [
        "In a new project you need this capability: “{masked}”. Which idea from this paper would you use? Name it.",
        "You need this in a new build: “{masked}”. Name the idea from this paper that gives it to you.",
        "Which of this paper's ideas would you reach for to get this? “{masked}”",
    ],
    "mc_locator": [
        "If you wanted to find this in the paper, which section would you look in? “{excerpt}”",
        "Which section of the paper does this come from? “{excerpt}”",
        "You remember reading this. Where in the paper was it? “{excerpt}”",
        "Place this passage: which section is it from? “{excerpt}”",
    ],
    "tf_claim": [
        "True or false: {sentence}.",
        "Does this paper say this? {sentence}.",
        "Is this what the paper reports? {sentence}.",
        "True or false, according to this paper: {sentence}.",
    ],
}

# quiz source caps
MAX_DEFINITIONS, MAX_CLAIMS, MAX_POOL_CLAIMS, MAX_CLAIMS_PER_CHUNK, MAX_SOURCES = 18, 16, 30, 3, 60
CLAIM_SECTIONS = ["Key Takeaways", "Key Results", "Methods", "Why It Matters", "Limitations & Open Questions", "Overview", "Background"]

# fixed value: confidence of a section without chunks
EMPTY_SECTION_CONFIDENCE = 0.2
