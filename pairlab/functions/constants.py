"""Fixed values that must equal the original job's for identical results.

Everything in this module is data, not logic: prompt wording, key-name
candidates, thresholds and numeric guards.  Keep them together and in
their natural order.
"""

# --- fixed values -----------------------------------------------------------

# System turn of every chat message list.
SYSTEM_PROMPT = "You are a helpful assistant."

# Instruction text of the relevance prompt, by number of labels.
INSTRUCTION_BINARY = (
    "Given a web search query, retrieve relevant passages that answer the query. "
    "Your task is to score the relevance between the Query and the Doc: "
    "0 means irrelevant, and 1 means relevant."
)
INSTRUCTION_GRADED = (
    "Given a web search query, retrieve relevant passages that answer the query. "
    "Your task is to score the relevance between the Query and the Doc: "
    "0 means irrelevant, 1 means slightly relevant, "
    "2 means partially relevant, and 3 means highly relevant."
)

# Prompt layout: "<Instruct>: {instruction}\n<Query>: {query}\n<Document>: {doc}"
PROMPT_INSTRUCT_TAG = "<Instruct>: "
PROMPT_QUERY_TAG = "\n<Query>: "
PROMPT_DOCUMENT_TAG = "\n<Document>: "

# Column-name candidates, tried in this order.
QUERY_KEY_CANDIDATES = ("query_id", "qid", "query")
LABEL_KEY_CANDIDATES = ("label", "relevance", "rel", "score", "rating")

# Score-file column names.
SCORE_INDEX_COLUMN = "global_idx"
SCORE_PROBS_COLUMN = "all_digit_scores"
SCORE_TEXT_COLUMN = "output_texts"
SCORE_WEIGHTED_COLUMN = "weighted_scores"

# NDCG cut-offs and the NDCG@10 distribution thresholds.
NDCG_KS = (5, 10)
NDCG_CDF_THRESHOLDS = (0.0, 0.3, 0.5, 0.7, 0.9, 1.0)
WORST_QUERIES_N = 5

# Calibration: number of equal-width bins on [0, 1].
ECE_BINS = 10

# Sharpness: probability clip and softening temperature.
ENTROPY_EPS = 1e-12
SOFTEN_TEMPERATURE = 2.0

# Distribution comparison: two-sided clamp.
DIVERGENCE_EPS = 1e-8
DIVERGENCE_KINDS = ("soft", "jsd", "fkl", "rkl", "hard")

# Low-mass filter for teacher distributions.
MIN_PROB_MASS = 0.99

# Characters Python's str.strip() removes: derived from str.isspace(), whose
# highest member is U+3000.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Full-width block: U+3000 maps to U+0020, U+FF01..U+FF5E map to U+0021..U+007E.
FULLWIDTH_SPACE = "\u3000"
FULLWIDTH_FIRST = 0xFF01
FULLWIDTH_LAST = 0xFF5E
FULLWIDTH_OFFSET = 0xFEE0
