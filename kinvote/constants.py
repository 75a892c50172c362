"""Fixed values that must be exactly these for results to match."""

# The English stop words of Spark ML's StopWordsRemover, in its own order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd "
    "you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't "
    "didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's "
    "how's let's ought that's there's what's when's where's who's why's would"
).split()

# Platform words dropped in addition to the English list.
PLATFORM_STOP_WORDS = ["rt", "amp", "https", "http", "co", "im"]

EXTENDED_STOP_WORDS = ENGLISH_STOP_WORDS + PLATFORM_STOP_WORDS

# Token patterns.
GAP_PATTERN = r"[^\w#@']+"
MATCH_PATTERN = r"[a-zA-ZÀ-ÿ0-9#@']+"

# Label vocabularies (raw value -> dense class).
NUMERIC_BINARY = {0: 0, 4: 1}
NUMERIC_TERNARY = {0: 0, 2: 1, 4: 2}
WORD_BINARY = {"negative": 0, "positive": 1}
WORD_TERNARY = {"negative": 0, "neutral": 1, "positive": 2}

# Defaults of the experiment.
NUM_HASH_TABLES = [128, 250]
K_VALUES = [50, 100, 150, 200]
DISTANCE_THRESHOLD = 0.9
NEAR_THRESHOLD = 0.5
HASH_BUCKETS = 32768
JOB_HASH_BUCKETS = 262144
PATTERN_COLUMN_VOCAB = 20000
HFW_TOP_N = 300
PATTERN_MIN_N = 3
PATTERN_MAX_N = 6
PATTERN_MIN_HFW = 2
SHORT_TEXT_PATTERN_CAP = 80  # for messages; no query uses it
SEQUENCE_LENGTH = 3
SEQUENCE_VOCAB = 600
TEST_FRACTION = 0.2
SEED = 42
SAMPLES_PER_CLASS = 6000
FRACTIONS = [0.2, 0.4, 0.6, 0.8, 1.0]
BASE_SAMPLE = 50000
SCENARIOS = {
    "unigram": "scenario1_unigram",
    "bigram": "scenario2_bigram",
    "patterns": "scenario3_patterns",
    "all": "scenario4_all",
}
