"""Fixed values that results depend on, stated plainly in one place."""

from __future__ import annotations

# --- Fixed values: ranking -------------------------------------------------
SESSION_COLUMN_WEIGHTS = {"headline": 10.0, "commands": 6.0, "paths": 5.0, "context_text": 2.0, "thinking": 0.5}
USER_HIT_BOOST = 1.5
HITS_PER_SESSION = 3
RANKED_LIMIT = 50
SNIPPET_TOKENS = 32
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
GREP_LIMIT = 50
GREP_RADIUS = 60

# --- Fixed values: digests, context, session columns -----------------------
DIGEST_TOPICS = 10
DIGEST_PATHS = 5
DIGEST_SESSIONS = 10
DIGEST_USER_MESSAGES = 20
DIGEST_MESSAGE_CHARS = 500
DIGEST_HIGHLIGHT_CHARS = 300
DIGEST_HIGHLIGHT_MIN_MESSAGES = 3
CONTEXT_RECENT = 10
CONTEXT_HEADLINES = 40
MAX_FILES = 50
MAX_COMMANDS = 100
MAX_ERRORS = 20
MAX_ERROR_CHARS = 300
MAX_THINKING_CHARS = 20_000
PROMPT_CHARS = 100
CLOSING_CHARS = 500
TOOL_SUMMARY_CHARS = 120
ARC_BUDGET_CHARS = 8_000
ARC_USER_CHARS = 200
ARC_ASSISTANT_CHARS = 300
EVENT_PAGE_CHARS = 20_000
EVENT_PAGE_RECORDS = 100
RESULT_COMMANDS = 5
RESULT_FILES = 10
SNIFF_LINES = 20

# --- Fixed values: time ----------------------------------------------------
SITTING_GAP_MS = 30 * 60 * 1000
TURN_CHARS = 200
COMMIT_SLACK_MS = 2 * 60 * 60 * 1000
SESSIONS_PER_COMMIT = 5
MTIME_SLACK_DAYS = 2
DAY_MS = 86_400_000
HOUR_MS = 3_600_000

# --- Fixed values: money ---------------------------------------------------
TIER_THRESHOLD = 200_000
CACHE_READ_RATIO = 0.1
CACHE_WRITE_RATIO = 1.25
CACHE_WRITE_1H_RATIO = 2.0
TOP_DISPATCHES = 20
TOP_SESSIONS = 15
MODEL_SERIES = 5
FAST_MODELS = ("claude-opus-4-8", "claude-opus-5")
FAMILY_STEMS = ("claude-fable", "claude-opus", "claude-sonnet", "claude-haiku", "gpt-5")
PREFIXED_FAMILY_STEMS = ("kimi-k", "glm-")

# model, input, output, cache write, cache read (USD per token)
OVERRIDE_PRICES = (
    ("claude-opus-4-8", 5e-6, 25e-6, 6.25e-6, 0.5e-6),
    ("claude-opus-4-7", 5e-6, 25e-6, 6.25e-6, 0.5e-6),
    ("claude-opus-4-6", 5e-6, 25e-6, 6.25e-6, 0.5e-6),
    ("claude-opus-4-5", 5e-6, 25e-6, 6.25e-6, 0.5e-6),
    ("claude-opus-4", 15e-6, 75e-6, 18.75e-6, 1.5e-6),
    ("claude-sonnet-4-6", 3e-6, 15e-6, 3.75e-6, 0.3e-6),
    ("claude-haiku-4-5", 1e-6, 5e-6, 1.25e-6, 0.1e-6),
    ("claude-fable-5", 10e-6, 50e-6, 12.5e-6, 1e-6),
    ("gpt-5.5", 5e-6, 30e-6, 5e-6, 0.5e-6),
    ("gpt-5.4", 2.5e-6, 15e-6, 2.5e-6, 0.25e-6),
)

# --- Fixed values: significance --------------------------------------------
HALF_LIFE_DAYS = 7.0
FILES_WEIGHT = 0.5
FILES_CAP = 10
ARTIFACT_BONUS = 2.0
UNDATED_AGE_DAYS = 36_500.0
ARTIFACT_PATTERN = r"(?i)/(?:pull|merge_requests)/\d+|`[0-9a-f]{7,40}`|\([0-9a-f]{7,40}\)"

# --- Fixed values: transcript vocabulary -----------------------------------
INJECTED_BARE_TAGS = (
    "system-reminder", "local-command-caveat", "local-command-stdout",
    "command-name", "command-message", "command-args",
)
INJECTED_ATTR_TAGS = ("task-notification", "bash-input", "bash-stdout", "bash-stderr", "teammate-message")
ROLLOUT_INJECTED = (
    r"^(<environment_context|<user_action|<turn_aborted|<recommended_plugins|<image\b|<skill\b"
    r"|<user_shell_command|# AGENTS\.md instructions for |Warning: )"
)
SKILL_PREAMBLE = "Base directory for this skill:"
TOOL_SUMMARY_KEYS = (
    "command", "file_path", "path", "pattern", "url", "query", "skill", "description", "prompt", "old_string",
)
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
READ_TOOLS = ("Read", "Grep", "Glob")
ROLLOUT_TOOL_CALLS = ("function_call", "custom_tool_call", "web_search_call", "tool_search_call")
PATCH_HEADER = r"(?m)^[ \t]*\*\*\* (?:Add|Update|Delete) File: (.+?)[ \t\r]*$"
AUTOCOMPACT_PREFIX = "acompact-"
JUNK_SUBSTRINGS = ("/var/folders/",)
JUNK_PREFIXES = ("/private/tmp/", "/tmp/")
JUNK_SUFFIXES = ("/ClaudeProbe",)
EXCLUDED_CWD_MARKERS = (".claude/worktrees", "/.bare")
COMPACT_METADATA_TYPES = (
    "turn_context", "file-history-snapshot", "queue-operation", "progress", "last-prompt", "summary",
    "token_usage_record", "system", "source_records",
)
COMPACT_EVENT_METADATA = (
    "token_count", "task_started", "task_complete", "thread_settings_applied", "turn_started", "turn_complete",
    "agent_reasoning", "agent_reasoning_raw_content", "context_compacted",
)
INDEX_TOOL = {"claude-code": "claude"}

# Documents kept next to transcripts: harness, kind, path pattern (searched in the full path).
DOCUMENT_LOCATIONS = (
    ("claude", "memory", r"/\.claude/projects/[^/]+/memory/.*\.md$"),
    ("claude", "instructions", r"/\.claude/CLAUDE\.md$"),
    ("claude", "instructions", r"/\.claude/rules/.*\.md$"),
    ("codex", "memory", r"/\.codex/memories/.*\.md$"),
    ("codex", "instructions", r"/\.codex/AGENTS(\.override)?\.md$"),
    ("cursor", "instructions", r"/\.cursor/rules/.*\.mdc$"),
    ("antigravity", "memory", r"/\.gemini/antigravity[^/]*/knowledge/.*\.md$"),
    ("antigravity", "artifact", r"/\.gemini/antigravity[^/]*/brain/[^/]+/[^/]+\.md$"),
    ("antigravity", "artifact", r"/\.gemini/antigravity[^/]*/brain/[^/]+/\.system_generated/tasks/task-[^/]*\.log$"),
    ("antigravity", "instructions", r"/\.gemini/GEMINI\.md$"),
    ("opencode", "instructions", r"/\.config/opencode/AGENTS\.md$"),
)

# Transcript roots: tool, path pattern (searched in the full path).
TRANSCRIPT_LOCATIONS = (
    ("claude", r"/\.claude/projects/[^/]+/[^/]+\.jsonl$"),
    ("claude", r"/\.claude/projects/[^/]+/[^/]+/subagents/[^/]+\.jsonl$"),
    ("codex", r"/\.codex/(archived_)?sessions/.*\.jsonl(\.zst)?$"),
    ("antigravity", r"/\.gemini/antigravity[^/]*/conversations/[^/]+\.db$"),
    ("antigravity", r"/\.gemini/antigravity[^/]*/brain/[^/]+/\.git/HEAD$"),
    ("antigravity", r"/\.gemini/antigravity[^/]*/brain/[^/]+/\.system_generated/logs/transcript(_full)?\.jsonl$"),
    ("cursor", r"/\.cursor/(chats|acp-sessions)/.*/store\.db$"),
    ("cursor", r"/\.cursor/projects/[^/]+/agent-transcripts/.*\.jsonl$"),
)

# --- Fixed values: year in review ------------------------------------------
# id, role, substrings (any may match)
PHRASES = (
    ("absolutelyRight", "assistant", ("absolutely right",)),
    ("interrupts", "user", ("request interrupted",)),
    ("please", "user", ("please",)),
    ("thanks", "user", ("thanks", "thank you")),
    ("actually", "user", ("actually",)),
    ("tryAgain", "user", ("try again",)),
    ("noWait", "user", ("no, wait", "no wait", "actually wait")),
    ("swears", "user", ("fuck", "shit", "wtf", "damn")),
    ("userSorry", "user", ("sorry", "apolog")),
    ("assistantApology", "assistant", ("apolog",)),
    ("ultrathink", "user", ("ultrathink",)),
    ("quickQuestion", "user", ("quick question", "real quick", "just a quick")),
    ("oneMoreThing", "user", ("one more thing", "one last thing")),
    ("shouldWork", "user", ("should work",)),
    ("stillBroken", "user", ("still not working", "still broken", "still failing", "same error")),
    ("areYouSure", "user", ("are you sure",)),
    ("hallucinate", "user", ("hallucinat",)),
    ("perfectExclaim", "assistant", ("perfect!",)),
)
# Words never crowned, as a space-separated word list.
STOP_WORDS = frozenset(
    """
    the and for that this with have from what when where which will would could should there their they them then than
    been being because before after about above below into over under again further once here both each more most other
    some such only same very just also them these those your yours ours mine hers his its our you are was were has had
    does did doing done can cannot cant dont wont isnt arent wasnt didnt doesnt shouldnt couldnt wouldnt not but who whom
    why how all any few nor too own so as of in on at by to up if or an is it be do we me my no us am let lets like want
    need make makes made making sure look looks looking looked see seen saw says said say going goes went get gets got
    getting give gives gave take takes took keep keeps kept still right left good great okay yes yeah nope now new old
    one two three first second next last thing things something anything everything nothing way ways use uses used using
    work works worked working well better best actually please thanks thank sorry wait maybe probably think thought
    know known knows knew come comes came back down out off between through during without within instead really always
    never sometimes often already currently point start starts started end ends ended run runs ran running
    file files code test tests testing function functions error errors bug bugs fix fixes fixed line lines change
    changes changed update updates updated add adds added remove removes removed delete deleted create creates created
    build builds built command commands branch commit commits push pull merge main master repo repository project
    projects folder directory path paths name names type types value values string values number list array object data
    component components page pages user users server client api call calls called check checks checked version case
    issue issues problem problems result results output input example examples question questions answer time times
    true false null undefined const import export return async await class method methods module script json html css
    text item items set sets setting settings config options option flag flags default logic implement implementation
    implemented feature features support supported supports current existing based instead different single multiple
    able available actual specific proper properly correct correctly wrong empty missing invalid valid every each
    read write edit grep bash tool tools agent agents subagent skill skills task tasks context summary session
    sessions review prompt prompts message messages model models token tokens directory search output plan mode
    claude codex opus sonnet haiku gemini anthropic openai full
    """.split()
)
PLUMBING_COMMANDS = (
    "ls", "cd", "cat", "find", "grep", "rg", "echo", "pwd", "head", "tail", "wc", "which", "mkdir", "rm", "cp", "mv",
    "touch", "sed", "awk", "sort", "uniq", "tr", "cut", "xargs", "chmod", "true", "test", "sleep", "date", "env",
    "export",
)
WORD_MIN_COUNT = 10
WORD_MIN_SESSIONS = 5
WORD_TOP = 5
WORD_OF_YEAR_COUNT = 25
WORD_OF_YEAR_SESSIONS = 8
ABANDONED_SESSIONS = 10
ABANDONED_DAYS = 90
NIGHT_THRESHOLD = 0.25
FOCUS_THRESHOLD = 0.4
DEPTH_THRESHOLD = 40.0
PERSONA_MIN_SESSIONS = 10
CARD_LEAD = 0.4
CARD_STAT = 0.3
CARD_STATS = 3
ARCHETYPES = (
    ("night|focus|deep", "The Midnight Machinist"),
    ("night|focus|quick", "The Nocturnal Sniper"),
    ("night|multi|deep", "The Moonlit Cartographer"),
    ("night|multi|quick", "The 3 AM Tinkerer"),
    ("day|focus|deep", "The Deep-Work Artisan"),
    ("day|focus|quick", "The Surgical Striker"),
    ("day|multi|deep", "The Systems Gardener"),
    ("day|multi|quick", "The Rapid Prototyper"),
)
# id, kind, size: words for prose, lines for source trees, words per minute for spans
WORDS_PER_TOKEN = 0.75
TOKENS_PER_LINE = 9.0
EQUIVALENCE_UNITS = (
    ("gatsby", "words", 47_094.0, "trips through Gatsby"),
    ("hobbit", "words", 95_356.0, "journeys there and back"),
    ("dune", "words", 187_240.0, "crossings of Dune"),
    ("hunger-games", "words", 301_583.0, "Hunger Games trilogies"),
    ("narnia", "words", 345_535.0, "trips through Narnia"),
    ("lotr", "words", 481_103.0, "trips to Mordor and back"),
    ("harry-potter", "words", 1_084_170.0, "Harry Potter marathons"),
    ("asoiaf", "words", 1_770_000.0, "Ice and Fire re-reads"),
    ("wheel-of-time", "words", 4_410_000.0, "Wheel of Time re-reads"),
    ("sqlite", "lines", 156_000.0, "copies of SQLite"),
    ("linux", "lines", 40_000_000.0, "Linux kernels"),
    ("wikipedia", "words", 4_600_000_000.0, "English Wikipedias"),
    ("typing", "span", 80.0, "of non-stop typing"),
    ("stenographer", "span", 225.0, "of a stenographer flat out"),
    ("aloud", "span", 150.0, "of reading aloud"),
)
EQUIVALENCE_MIN = 1.5
EQUIVALENCE_MAX = 999.0
EQUIVALENCE_MIN_HOURS = 24.0
COST_UNITS = ((1999.0, "MacBook Airs"), (249.0, "pairs of AirPods Pro"), (6.0, "oat-milk lattes"))

# --- Fixed values: tenants and archive -------------------------------------
CHUNK_STRIDE = 15_000
CHUNK_SIZE = 16_000
OBJECT_GRACE_SECONDS = 60
DECISION_PAGE_CHARS = 20_000
