"""Word lists, lookup tables, patterns and templates.

Everything here is data that decides results, kept in one place and in plain
form. Lists that a user may want to vary are defaults of parameters.
"""

# --- fixed values: provenance flag -----------------------------------------
IS_COMMUNITY = 0
IS_ABSTRACT = 1
IS_SYNTHETIC = 2

# --- fixed values: markers ---------------------------------------------------
ABSTRACT_MARKERS = ("abstract", "this paper", "this study", "this article")
REFUSAL_MARKERS = ("I apologize", "sorry", "an AI language model")
SYNTHETIC_MARKERS = ("Web of Science", "abstract")
ANSWER_MARKER = "Abstract"
PATH_SEPARATOR = " > "
CATEGORY_KEYS = ("Communities & Collections:", "Dewey Decimal Classification:")
METADATA_BLOCK_CLASS = "ep_block"
TARGET_TABLE_CLASS = "wikitable"
EXCLUDED_FILE_MARKERS = ("clean", "osdg")

# --- fixed values: patterns --------------------------------------------------
# Body of a character class holding every Unicode blank.
BLANKS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TAG = r"<[^>\n]*>"
URL = rf"https?://[^{BLANKS}]+|www\.[^{BLANKS}]+"
DIGITS = r"\p{Nd}+"
LIST_MARKER = rf"(?md)^\p{{Nd}}+\.[{BLANKS}]+"

# --- fixed values: sizes and shares -----------------------------------------
MIN_AGREEMENT = 0.5
TEST_SHARE = "0.3"
VALIDATION_SHARE = "0.5"
SPLIT_SEED = 42
BATCH_SIZE = 20
HITS_PER_TOPIC = 100
CLASS_SEED_OFFSET = 1234
LENGTH_SPAN = 60
MAX_TOKENS = 256

# --- fixed values: formats ---------------------------------------------------
RUN_TIME_FORMAT = "yyyy-MM-dd_HH-mm"

# --- fixed values: class names -----------------------------------------------
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight",
    "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen",
)

GOAL_NAMES = (
    "None of the goals",
    "No Poverty",
    "Zero Hunger",
    "Good Health and Well-being",
    "Quality Education",
    "Gender Equality",
    "Clean Water and Sanitation",
    "Affordable and Clean Energy",
    "Decent Work and Economic Growth",
    "Industry, Innovation, and Infrastructure",
    "Reduced Inequality",
    "Sustainable Cities and Communities",
    "Responsible Consumption and Production",
    "Climate Action",
    "Life Below Water",
    "Life on Land",
    "Peace, Justice, and Strong Institutions",
    "Partnerships for the Goals",
)

MODEL_SHORT_NAMES = {
    "meta-llama/Llama-3-70b-chat-hf": "llama-3-70b",
    "mistralai/Mixtral-8x22B-Instruct-v0.1": "mixtral-8x22B",
}

# --- fixed values: prompt template -------------------------------------------
# {first}, {main_topic}, {sub_topic}, {low}, {high}, {style} are filled in.
NO_GOAL = "no_sdg"
FIRST_CONDITION_NO_GOAL = "the paper should not be related to any UN SDG goal"
FIRST_CONDITION_GOAL = (
    "the paper should be related to the UN SDG goal of {goal}"
    " but do not mention the SDG goal explicitly;"
)
PROMPT_TEMPLATE = """
                Write an abstract of a {main_topic} paper on Web of Science, following the requirements below: \n

                    1. {first} \n
                    2. the paper abstract should focus on '{sub_topic}'; \n
                    3. should be in length between {low} words and {high} words; \n
                    4. the style of the paper should be '{style}' \n

                Return only the abstract.
            """

# --- fixed values: English stop words (the public 179-word list) -------------
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve
y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()

# Stop words that carry sentiment stay in the text.
SENTIMENT_WORDS = (
    "not", "no", "nor", "never", "yes", "should", "could", "would",
)

REMOVED_STOP_WORDS = tuple(w for w in STOP_WORDS if w not in SENTIMENT_WORDS)

# --- fixed values: tokeniser ---------------------------------------------------
# Abbreviations whose full stop belongs to the word (so "dr." is no word).
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "sr", "jr", "vs", "inc", "corp",
    "co", "ltd", "bros", "gen", "col", "lt", "maj", "capt", "sgt", "sen",
    "rep", "gov", "rev", "jan", "feb", "aug", "sept", "oct", "nov", "dec",
)

# --- fixed values: noun lemmas ---------------------------------------------------
# The published suffix rules for nouns need a dictionary to decide between
# candidates. With no vocabulary table the lists below take its place.
LEMMA_IRREGULAR = {
    "women": "woman", "children": "child", "people": "people",
    "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse",
    "criteria": "criterion", "phenomena": "phenomenon", "genera": "genus",
    "larvae": "larva", "algae": "alga", "fungi": "fungus",
    "stimuli": "stimulus", "nuclei": "nucleus",
    "analyses": "analysis", "hypotheses": "hypothesis", "theses": "thesis",
    "crises": "crisis", "syntheses": "synthesis", "diagnoses": "diagnosis",
    "matrices": "matrix", "indices": "index", "vertices": "vertex",
    "appendices": "appendix", "axes": "ax", "species": "specie",
    "gases": "gas", "biases": "bias", "lenses": "lens", "aliases": "alias",
    "quizzes": "quiz", "assess": "ass",
    "wolves": "wolf", "leaves": "leaf", "lives": "life", "knives": "knife",
    "wives": "wife", "halves": "half", "shelves": "shelf", "selves": "self",
    "calves": "calf", "loaves": "loaf", "thieves": "thief",
    "aches": "ache", "caches": "cache", "niches": "niche",
    "headaches": "headache",
    "shoes": "shoe", "toes": "toe", "canoes": "canoe", "foes": "foe",
    "movies": "movie", "cookies": "cookie", "calories": "calorie",
    "uses": "use", "abuses": "abuse", "excuses": "excuse", "fuses": "fuse",
    "refuses": "refuse", "reuses": "reuse",
    "less": "le",
}

LEMMA_UNCHANGED = (
    "specimen", "regimen", "abdomen", "acumen", "omen", "semen", "stamen",
    "lumen", "amen", "foramen", "rumen", "bitumen", "albumen", "men's",
    "yes", "gas", "series", "news", "always", "perhaps", "besides",
    "towards", "afterwards", "sometimes", "whereas", "bias", "atlas",
    "canvas", "alias", "pancreas", "lens", "mathematics", "economics",
    "politics", "genetics", "robotics", "linguistics", "electronics",
    "diabetes", "thanks", "overseas", "nowadays", "sans",
)

# --- fixed values: function words per language -------------------------------------
LANGUAGE_WORDS = {
    "de": """der die das und ist nicht ein eine zu den von mit dem auf für als
        auch sich des im werden wird bei sind oder einer nach wie über""".split(),
    "en": """the of and to in is that for with was as are this by on be from
        or which an it at we not have has these were their can""".split(),
    "es": """el la los las y en un por con para una es del se lo como más su
        al que de pero sus entre fue esta este son o también""".split(),
    "fr": """le la les des et est dans pour que qui une du par sur au avec ne
        pas sont ce de en un aux plus nous cette ou ces leur""".split(),
    "it": """il di che non per una sono della con dei nel alla anche come più gli
        del si da al delle ma questo è degli dalla le ha essere nella""".split(),
    "nl": """het een van en dat niet zijn op aan met voor er maar om door ook bij
        naar wordt heeft uit worden deze nog hun werd dan ze dit wij""".split(),
    "pt": """que não uma os do da em um para com é no na por mais dos como foi ao
        das tem à seu sua ou pelo pela são isso também""".split(),
}
